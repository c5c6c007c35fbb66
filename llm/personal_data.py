"""Personal data in whole texts: weak supervision over spans, in DataFrame operations only.

How it works
    Base spans (email, ip, card, phone) are found by fixed patterns and checks; they always stay. Wider patterns give
    further candidates that touch no base span: phone and card numbers that stand against other numbers, addresses
    written with (at) and (dot), social security numbers and account numbers. Seven labelers vote on every candidate
    (+1, -1 or 0 for no opinion): shape and plausibility (regex), known endings, codes and issuers, and known
    placeholders (gazetteer), cue words for and against, and a near neighbour (context).
    Expectation-maximisation over the counts of vote patterns (at most 3^7 times the kinds, whatever the corpus)
    estimates how each labeler votes on real and on false spans, without labels. Its soft labels train
    a logistic classifier on votes, kind and length, which decides the further candidates.
    Candidates are worked out in one pass over the texts and written; the decision is an expression on that table.

Positions are found without Python: the pieces between matches (``split``) and the matches alternate, so running sums of
their lengths are code-point offsets.

Defined results: a null or empty text has no spans; repeated rows give one row each; null doc_ids stay null; further
columns are ignored by ``find`` and kept by ``redact``; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.session import cut_lineage

KINDS = ["email", "ip", "card", "phone", "ssn", "iban"]
# Matches start where a run starts, or where the last match ended: the same matches as without, found in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]{1,63}+(?: ?[(\[] ?dot ?[)\]] ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "card": r"(?<![0-9A-Za-z])(?:(?:[0-9]{4}[\x20-]){3}[0-9]{4}|[0-9]{15,16})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
ENDINGS = r"(?i)[.\])]\x20?(com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|ch|at|eu|us|ca|au|jp|br|in)$"
ISSUERS = r"^(3[47]|4|5[1-5]|2[2-7]|6011|65|35|30|36|38)"
CALLING_CODES = r"^\+(1|7|20|27|3[0-46-9]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ACCOUNT_COUNTRIES = r"^(AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
PLACEHOLDERS = r"(.)\1{6,}|123.?456.?789|000.?0000|987.?654.?321"
CUES = r"call|phone|tel|mobile|fax|whatsapp|mail|contact|reach|write|card|visa|credit|account|iban|ssn|social|address"
AGAINST = r"order|invoice|version|isbn|issn|sku|serial|part no|figure|page|section|release|build|tracking"
NEAR = 120
CONTEXT = 40
LABELERS = 7
THRESHOLD = 0.5
_SPAN = "array<struct<s:int,e:int,m:string>>"


def _hits(text: Column, pattern: str) -> Column:
    """Start, end and text of each leftmost non-overlapping match, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(found, between, lambda m, g: F.struct(F.length(g).alias("g"), m.alias("m")))
    steps = F.filter(steps, lambda x: x["m"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, x):
        start = acc["at"] + x["g"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))

    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.concat(F.lit("0"), F.substring(part(p), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _of_kind(text: Column, kind: str, pattern: str, gate: Column, base: bool) -> Column:
    kept = F.filter(_hits(text, pattern), lambda x: _valid(kind if base or kind == "card" else "", x["m"]))
    rows = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), x["m"].alias("m"), F.lit(base).alias("base")))
    return F.when(gate, rows).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,m:string,base:boolean>>"))


def _votes(text: Column, x: Column, near: Column) -> Column:
    """The seven labelers' votes on a candidate."""
    m, k, base = x["m"], x["k"], x["base"]
    digits = _digits(m)
    before = F.lower(F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(F.lit(CONTEXT), x["s"])))
    after = F.lower(F.substring(text, x["e"] + 1, F.lit(CONTEXT // 2)))
    none, yes, no = F.lit(0), F.lit(1), F.lit(-1)
    is_ = lambda kind: k == KINDS.index(kind)
    shape = F.when(base, yes).when(is_("email") | (is_("phone") & m.rlike(r"[+(]")) | (is_("card") & m.rlike("[ -]")), yes)
    shape = shape.when(is_("ssn"), F.when(m.rlike("^(000|666|9)|-00-|-0000$"), no).otherwise(yes)).otherwise(none)
    plausible = (
        F.when(is_("card"), yes)
        .when(is_("ip"), F.when(m.rlike(r"^0*([1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."), yes).otherwise(no))
        .when(is_("email"), F.when(m.rlike(r"(?i)[a-z]{2,}$"), yes).otherwise(no))
        .when(is_("phone"), F.when(digits.rlike(r"^(.)\1+$"), no).otherwise(yes))
        .otherwise(none)
    )
    known = F.when(
        (is_("email") & m.rlike(ENDINGS)) | (is_("card") & digits.rlike(ISSUERS)) | (is_("phone") & m.rlike(CALLING_CODES)) | (is_("iban") & m.rlike(ACCOUNT_COUNTRIES)), yes
    ).otherwise(none)
    return F.array(
        shape, plausible, known,
        F.when(m.rlike(PLACEHOLDERS), no).otherwise(none),
        F.when(before.rlike(CUES) | after.rlike(CUES), yes).otherwise(none),
        F.when(before.rlike(AGAINST), no).otherwise(none),
        F.when(near, yes).otherwise(none),
    )


def candidates(rows: DataFrame) -> DataFrame:
    """Adds to rows with a ``text`` column ``spans``: (s, k, e, base, votes, long) by start, then kind."""
    t = F.col("text")
    digit, plus = t.rlike("[0-9]"), t.rlike(r"\+[0-9]")
    base = F.concat(
        _of_kind(t, "email", BASE["email"], t.contains("@"), True), _of_kind(t, "ip", BASE["ip"], t.rlike(r"[0-9]\.[0-9]"), True),
        _of_kind(t, "card", BASE["card"], digit, True), _of_kind(t, "phone", BASE["phone"], plus, True),
    )
    wider = F.concat(
        _of_kind(t, "email", WIDER["email"], t.rlike(r"(?i)[(\[] ?at ?[)\]]"), False),
        *(_of_kind(t, kind, WIDER[kind], digit, False) for kind in ("card", "phone", "ssn", "iban")),
    )
    out = rows.withColumn("_base", base).withColumn("_wider", wider)
    clear = F.filter("_wider", lambda x: ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    out = out.withColumn("_all", F.when(F.size("_wider") > 0, F.array_sort(F.concat("_base", clear))).otherwise(F.array_sort("_base")))
    all_ = F.col("_all")

    def vote(x, i):
        close = (x["s"] - F.get(all_, i - 1)["e"] < NEAR) | (F.get(all_, i + 1)["s"] - x["e"] < NEAR)
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["base"].alias("base"), _votes(t, x, F.coalesce(close, F.lit(False))).alias("votes"), (x["e"] - x["s"] > 24).alias("long"))

    empty = F.array().cast("array<struct<s:int,k:int,e:int,base:boolean,votes:array<int>,long:boolean>>")
    return out.withColumn("spans", F.when(F.size("_all") > 0, F.transform("_all", vote)).otherwise(empty)).drop("_base", "_wider", "_all")


def reliabilities(votes: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM for conditionally independent labelers. votes: patterns x labelers in -1, 0, 1; weight: how many spans have each.

    Returns the probability that each pattern is a real span, and P(vote | class) as labelers x votes x classes.
    """
    q = 1 / (1 + np.exp(-votes.sum(axis=1)))  # starts from the majority, which fixes which class is the real one
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        both = np.stack([1 - q, q], axis=1) * weight[:, None]
        table = np.einsum("pjv,pc->jvc", hot, both) + 0.5
        table /= table.sum(axis=1, keepdims=True)
        prior = (both.sum(axis=0) + 1) / (weight.sum() + 2)
        logs = np.einsum("pjv,jvc->pc", hot, np.log(table)) + np.log(prior)
        q = 1 / (1 + np.exp(logs[:, 0] - logs[:, 1]))
    return q, table


def _design(votes: np.ndarray, kind: np.ndarray, long: np.ndarray) -> np.ndarray:
    return np.hstack([votes == 1, votes == -1, kind[:, None] == np.arange(len(KINDS)), long[:, None], np.ones((len(kind), 1))]).astype(float)


def train(spans: DataFrame) -> np.ndarray:
    """Weights of the span classifier. What reaches the driver is one row a pattern: at most 3^7 * 6 * 2."""
    each = spans.select(F.explode("spans").alias("x")).select("x.votes", "x.k", "x.long")
    rows = each.groupBy("votes", "k", "long").agg(F.count("*").alias("n")).collect()
    width = 2 * LABELERS + len(KINDS) + 2
    if not rows:
        return np.zeros(width)
    rows = sorted(rows, key=lambda r: (list(r["votes"]), r["k"], r["long"]))
    votes, n = np.array([list(r["votes"]) for r in rows]), np.array([r["n"] for r in rows], dtype=float)
    q, _ = reliabilities(votes, n)
    x = _design(votes, np.array([r["k"] for r in rows]), np.array([r["long"] for r in rows]))
    w = np.zeros(width)
    for _ in range(30):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (n * (p - q)) + 0.5 * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(width)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _chosen(weights: np.ndarray) -> Column:
    """The spans that stay: base ones and those the classifier takes for real."""

    def keep(x):
        z = F.lit(float(weights[-1])) + F.when(x["long"], float(weights[-2])).otherwise(0.0)
        for j in range(LABELERS):
            z = z + F.when(x["votes"][j] == 1, float(weights[j])).when(x["votes"][j] == -1, float(weights[LABELERS + j])).otherwise(0.0)
        for k in range(len(KINDS)):
            z = z + F.when(x["k"] == k, float(weights[2 * LABELERS + k])).otherwise(0.0)
        return x["base"] | (z >= float(np.log(THRESHOLD / (1 - THRESHOLD))))

    return F.filter("spans", keep)


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _equals(value: int):
    return lambda x: x == value


def find(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, numbers and digest of base spans, and all spans as text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = cut_lineage(candidates(rows).drop("text"))
    chosen = spans.withColumn("spans", _chosen(train(spans)))
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.filter(F.transform(base, lambda x: x["k"]), _equals(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return chosen.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The same rows with each span replaced by its kind in brackets, and ``n_chars`` brought up to date if there is one."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # spans are found again where texts are cleaned: to keep them would mean to write every text once more
    weights = train(cut_lineage(candidates(rows.select("text")).select("spans")))
    chosen = candidates(rows).withColumn("chosen", _chosen(weights))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc, x):
        gap = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["k"]))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(gap).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate("chosen", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    chosen = chosen.withColumn("clean", F.when(F.size("chosen") == 0, F.col("row")["text"]).otherwise(cleaned))
    length = F.when(F.col("clean").isNotNull(), F.length("clean"))
    new = {"text": F.col("clean"), "n_chars": F.coalesce(length, F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return chosen.select(*(new.get(f.name, F.col("row").getField(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema))
