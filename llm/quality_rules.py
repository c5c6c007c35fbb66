"""Quality rules as a bitmask ledger, in DataFrame operations only.

How it works
    ``ledger`` measures every whole text once and evaluates every rule once; bit b of ``bits`` is set where rule
    RULES[b] fails. Policies are versioned: a mask of rules of which none may fail and a mask of which only so many may.
    ``apply_policy`` and ``ablation`` read the ledger only: what each rule rejects, and what it alone rejects, are
    bitwise tests and sums that combine before the shuffle, so policies change without a look at the texts.
    Repeated words come from hashes of eight-word windows inside the row; only texts in which a window
    occurs twice are sorted.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows give one row each; further
columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SPACE = r"[\x20\x09-\x0D]"
#: Bit by bit: name and the condition of failing, on the measurements.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("capitals", "100 * n_capitals > 50 * word_chars"),
    ("digits", "100 * n_digits > 30 * word_chars"),
    ("exclamations", "100 * n_exclamations > 10 * word_chars"),
    ("repeated_words", "n_words >= 50 AND 100 * n_distinct_words < 10 * n_words"),
]
BIT = {name: b for b, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")
#: Version: rules of which none may fail, rules of which at most ``allowed`` may.
POLICIES = {
    1: {"hard": BASE, "soft": (), "allowed": 0},
    2: {"hard": (*BASE, "symbols", "capitals", "exclamations"), "soft": ("repeated_lines", "short_words", "long_words", "digits", "repeated_words"), "allowed": 1},
}
CURRENT = 2


def mask(names) -> int:
    return sum(1 << BIT[n] for n in names)


def _measured(rows: DataFrame) -> DataFrame:
    text = F.col("text")
    count = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("bigint")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = rows.select("doc_id", "text", F.filter(F.split(text, SPACE + "+"), lambda w: w != "").alias("w"), lines.alias("lines"))
    out = out.select(
        "doc_id", F.transform("w", lambda w: F.xxhash64(w)).alias("h"), F.aggregate("w", F.lit(0), lambda a, w: a + F.length(w)).cast("bigint").alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"), count(r"[^A-Z\p{Lu}]+").alias("n_capitals"), count("[^0-9]+").alias("n_digits"), count("[^!]+").alias("n_exclamations"),
        F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    h = F.col("h")
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    out = out.withColumn("windows", F.when(F.size(h) > WINDOW, windows))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    out = out.withColumn("sorted", F.when(twice, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("sorted")
    again = F.filter(F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    covered = F.aggregate(
        F.sort_array(again), zero, lambda a, i: F.struct((i + WINDOW).alias("upto"), (a["n"] + i + WINDOW - F.greatest(i, a["upto"])).alias("n")), lambda a: a["n"]
    )
    return out.select(
        "doc_id", F.size("h").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        "n_lines", "n_capitals", "n_digits", "n_exclamations", F.size(F.array_distinct("h")).cast("bigint").alias("n_distinct_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, the measurements and ``bits``, the failed rules."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bits = sum((F.when(F.expr(rule), F.lit(1 << b)).otherwise(F.lit(0)) for b, (_, rule) in enumerate(RULES)), F.lit(0))
    return _measured(rows).withColumn("bits", bits.cast("bigint"))


def accepted(bits: Column, version: int = CURRENT) -> Column:
    p = POLICIES[version]
    return (bits.bitwiseAND(mask(p["hard"])) == 0) & (F.bit_count(bits.bitwiseAND(mask(p["soft"]))) <= p["allowed"])


def apply_policy(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to a ledger."""
    base = F.col("bits").bitwiseAND(mask(BASE)) != 0
    return entries.withColumn("base_failed", base).withColumn("kept", ~base & accepted(F.col("bits"), version))


def ablation(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of a policy: how many documents fail it, and how many more the policy would keep without it."""
    p = POLICIES[version]
    names = [*p["hard"], *p["soft"]]
    rejected = ~accepted(F.col("bits"), version)
    sums = []
    for name in names:
        bit = 1 << BIT[name]
        sums += [F.count_if(F.col("bits").bitwiseAND(bit) != 0).alias(f"f_{name}"), F.count_if(rejected & accepted(F.col("bits").bitwiseAND(~bit), version)).alias(f"a_{name}")]
    one = entries.agg(*sums)
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("failed"), F.col(f"a_{n}").alias("only_here")) for n in names))).alias("x")).select("x.*")
