"""Fuzzy duplicate resolution.

Postings are first reduced to distinct (company, title) signatures; only signatures are compared.
Similar strings are found without comparing all of them (``similar_pairs``), and the
order-dependent resolution (earlier kept posting wins) runs on signatures and URLs with
aggregates, so the pairs inside a group of copies are never written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.similarity import common_length, ratio_parts, rest_ratio, subset_ratio, word_set
from postlake.functions.text import clean_for_match
from postlake.session import cut_lineage

# --- similar strings -------------------------------------------------------------------------------


def _by_rarity(df: DataFrame, id_col: str, items: str, freq: DataFrame) -> DataFrame:
    """``items`` of every row ordered from the rarest to the most common, as an array of that name."""
    flat = df.select(id_col, F.explode(items).alias("_i")).join(freq, "_i")
    # one group per string: its size is the length of that string
    ordered = flat.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_n", "_i"))).alias("_o"))
    return ordered.select(id_col, F.transform("_o", lambda x: x["_i"]).alias(items))


def _bigrams(words: Column) -> Column:
    """Bigrams of every blank-padded word, numbered per repeat so that a bag becomes a set."""
    per_word = F.flatten(
        F.transform(
            words,
            lambda w: F.transform(
                F.sequence(F.lit(0), F.length(w)), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i + 1, F.lit(2))
            ),
        )
    )
    bag = F.array_sort(per_word)
    return F.transform(
        bag,
        lambda g, i: F.concat(g, F.lit("#"), (i - F.array_position(bag, g) + 1).cast("string")),
    )


def _keyed_words(df: DataFrame, id_col: str, text: str) -> DataFrame:
    words = word_set(F.col(text))
    return df.withColumn("_words", words).where(F.size("_words") > 0).withColumn("_len", F.length(F.array_join("_words", " ")))


def prepare_strings(df: DataFrame, id_col: str, text: str, threshold: float) -> DataFrame:
    """Adds to each string its word set, its bigram bag and the two rare prefixes that find partners.

    With e = 1 - threshold/100, a pair reaches the threshold in one of two ways.

    * Shared words dominate one side: that side's other words are shorter than a fixed part of
      it, so its rarest words adding up to that part (``head_words``) cannot all be missing from
      the partner. Subsets are the extreme case.
    * The differing words are spelled alike: at most ``loss`` bigrams of a side are missing from
      the partner, so the ``loss + 1`` rarest bigrams of both sides have one in common
      (``head_grams``).

    Together this is exact for thresholds above 75; no partner is capped or sampled.
    """
    part, loss = _may_differ(threshold)
    base = cut_lineage(_keyed_words(df, id_col, text).withColumn("_grams", _bigrams(F.col("_words"))))
    freq = lambda c: base.select(F.explode(c).alias("_i")).groupBy("_i").agg(F.count(F.lit(1)).alias("_n"))
    words = _by_rarity(base, id_col, "_words", freq("_words")).withColumnRenamed("_words", "_rare_words")
    grams = _by_rarity(base, id_col, "_grams", freq("_grams")).withColumnRenamed("_grams", "_rare_grams")
    out = base.join(words, id_col).join(grams, id_col)
    return cut_lineage(out.withColumns(_heads(part, loss)).drop("_rare_words", "_rare_grams"))


def _may_differ(threshold: float) -> tuple[float, float]:
    """The part of a side's letters that may be missing from a partner, and the bigrams a letter that may."""
    if threshold <= 75:
        raise ValueError("candidate search is exact for thresholds above 75 only")
    e = 1 - threshold / 100
    dominated = 2 * e / (1 - e)
    loss = (1.5 * e + 0.5) + (1 - e) / (1 + e) * (1.5 * e - 0.5)
    # a little slack so that rounding never loses a pair
    return dominated / (1 + dominated) + 1e-9, loss + 1e-9


def _heads(part: float, loss: float) -> dict[str, Column]:
    # shortest run of rare words whose letters exceed the part that may be missing
    reach = lambda k: F.aggregate(F.slice("_rare_words", 1, k), F.lit(0), lambda acc, w: acc + F.length(w))
    steps = F.filter(F.sequence(F.lit(1), F.size("_rare_words")), lambda k: reach(k) >= F.col("_len") * part)
    return {
        "_head_words": F.slice("_rare_words", F.lit(1), F.coalesce(F.get(steps, F.lit(0)), F.size("_rare_words"))),
        "_head_grams": F.slice("_rare_grams", F.lit(1), (F.floor(F.col("_len") * loss) + 1).cast("int")),
    }


def index_items(names: DataFrame, text: str, threshold: float = V.COMPANY_MATCH_THRESHOLD, probe: bool = False) -> DataFrame:
    """(item, text): the items by which a stored index finds every similar string; ``probe`` gives a searcher's items.

    As in ``prepare_strings``, but ordered by a hash instead of by rarity, so the items of a string never change
    as strings are added: similar strings share a head word with the other's words, or a head bigram.
    """
    by_hash = lambda c: F.transform(F.array_sort(F.transform(c, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), lambda s: s["x"])
    base = _keyed_words(names, text, text).withColumn("_grams", _bigrams(F.col("_words")))
    base = base.withColumns({"_rare_words": by_hash("_words"), "_rare_grams": by_hash("_grams")}).withColumns(_heads(*_may_differ(threshold)))
    own, other = ("h:", "w:") if not probe else ("w:", "h:")
    marked = lambda mark, c: F.transform(c, lambda x: F.concat(F.lit(mark), x))
    items = F.concat(marked(own, "_head_words"), marked(other, "_words"), marked("g:", "_head_grams"))
    return base.select(F.explode(items).alias("item"), text)


def _probe(left: DataFrame, right: DataFrame, lid: str, rid: str, equal: list[str], a: str, b: str, lengths: bool,
           e: float) -> DataFrame:
    le = left.select(*equal, F.col(lid).alias("_l"), F.col("_len").alias("_ll"), F.explode(a).alias("_i"))
    ri = right.select(*equal, F.col(rid).alias("_r"), F.col("_len").alias("_rl"), F.explode(b).alias("_i"))
    j = le.join(ri, [*equal, "_i"])
    if lengths:
        j = j.where(F.abs(F.col("_ll") - F.col("_rl")) <= (F.col("_ll") + F.col("_rl")) * (e + 1e-9))
    return j.select(*equal, "_l", "_r")


def similar_pairs(left: DataFrame, right: DataFrame, lid: str, rid: str, threshold: float, equal: list[str] | None = None) -> DataFrame:
    """(lid, rid, ratio) of all pairs with token-set ratio at or above the threshold.

    Both frames come from ``prepare_strings``; ``equal`` columns must agree between partners.
    """
    equal = equal or []
    e = 1 - threshold / 100
    cand = (
        _probe(left, right, lid, rid, equal, "_head_words", "_words", False, e)
        .unionByName(_probe(left, right, lid, rid, equal, "_words", "_head_words", False, e))
        .unionByName(_probe(left, right, lid, rid, equal, "_head_grams", "_head_grams", True, e))
        .distinct()
    )
    a = left.select(*[F.col(c).alias(f"_e_{c}") for c in equal], F.col(lid).alias("_l"), F.col("_words").alias("_wa"))
    b = right.select(*[F.col(c).alias(f"_f_{c}") for c in equal], F.col(rid).alias("_r"), F.col("_words").alias("_wb"))
    ja = cand["_l"] == a["_l"]
    jb = cand["_r"] == b["_r"]
    for c in equal:
        ja = ja & (cand[c] == a[f"_e_{c}"])
        jb = jb & (cand[c] == b[f"_f_{c}"])
    pairs = cand.join(a, ja).drop(a["_l"]).join(b, jb).drop(b["_r"])
    parts = pairs.select(*equal, "_l", "_r", *[v.alias(f"_{k}") for k, v in ratio_parts(F.col("_wa"), F.col("_wb")).items()])
    s, x, y = F.col("_s"), F.col("_x"), F.col("_y")
    subset = (s > 0) & ((x == "") | (y == ""))
    sided = F.when(s > 0, F.greatest(subset_ratio(s, x), subset_ratio(s, y))).otherwise(F.lit(0.0))
    best_case = rest_ratio(s, x, y, F.least(F.length(x), F.length(y)))
    scored = parts.withColumn("_sided", F.when(subset, F.lit(100.0)).otherwise(sided))
    # The rest is only aligned letter by letter where it can still reach the threshold.
    undecided = ~subset & (best_case >= threshold)
    aligned = scored.withColumn("_common", common_length(F.when(undecided, x), F.when(undecided, y)))
    ratio = F.greatest("_sided", F.coalesce(F.when(undecided, rest_ratio(s, x, y, F.col("_common"))), F.lit(0.0)))
    return (
        aligned.select(*equal, F.col("_l").alias(lid), F.col("_r").alias(rid if rid != lid else f"{rid}_b"), ratio.alias("ratio"))
        .where(F.col("ratio") >= threshold)
    )


# --- posting signatures ----------------------------------------------------------------------------


def with_signature(df: DataFrame) -> DataFrame:
    """Cleaned company and title; NULL ``sig`` marks postings that can never match (no company or no words)."""
    company, title = clean_for_match(F.col("company")), clean_for_match(F.col("title"))
    out = df.withColumns({"company_key": company, "title_key": title})
    usable = (F.col("company_key") != "") & (F.col("title_key") != "")
    return out.withColumn("sig", F.when(usable, F.sha2(F.concat_ws("\u0001", "company_key", "title_key"), 256)))


def signature_edges(signatures: DataFrame) -> DataFrame:
    """Matching signature pairs (both directions and each with itself) with their ratios.

    ``signatures`` holds distinct (sig, company_key, title_key). Companies are matched first and
    titles only inside matching companies.
    """
    companies = signatures.select("company_key").distinct()
    c = prepare_strings(companies, "company_key", "company_key", V.COMPANY_MATCH_THRESHOLD)
    company_pairs = cut_lineage(
        similar_pairs(c, c, "company_key", "company_key", V.COMPANY_MATCH_THRESHOLD)
        .select(F.col("company_key").alias("own"), F.col("company_key_b").alias("other"), F.col("ratio").alias("company_ratio"))
    )
    t = prepare_strings(signatures.select("title_key").distinct(), "title_key", "title_key", V.TITLE_MATCH_THRESHOLD)
    sigs = signatures.join(t, "title_key")
    left = sigs.join(company_pairs, sigs["company_key"] == company_pairs["own"]).select(
        F.col("other").alias("partner"), F.col("sig").alias("sig_a"), "company_ratio", "_words", "_len", "_head_words", "_head_grams"
    )
    right = sigs.select(
        F.col("company_key").alias("partner"), F.col("sig").alias("sig_b"), "_words", "_len", "_head_words", "_head_grams"
    )
    pairs = similar_pairs(left, right, "sig_a", "sig_b", V.TITLE_MATCH_THRESHOLD, ["partner"])
    ratios = left.select("partner", "sig_a", "company_ratio")
    return pairs.join(ratios, ["partner", "sig_a"]).select("sig_a", "sig_b", "company_ratio", F.col("ratio").alias("title_ratio"))


# --- order-dependent resolution --------------------------------------------------------------------


def _least_in_reach(mins: DataFrame, edges: DataFrame) -> DataFrame:
    """(sig, least) : smallest order number among the signatures that match ``sig``."""
    return (
        edges.select("sig_a", "sig_b").join(mins, F.col("sig_b") == F.col("sig")).groupBy("sig_a")
        .agg(F.min("least").alias("least")).select(F.col("sig_a").alias("sig"), "least")
    )


def greedy_keep(df: DataFrame, order: str, cliques: list[str], edges: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """Rows that survive when rows are taken in ``order`` and each kept row drops its later conflicts.

    Two rows conflict when they share a non-NULL clique value or their ``sig`` values are joined
    by an edge. ``blocked`` (sig, least) names signatures that are taken from an order number on.
    Each round keeps every undecided row that is the first of all its groups and drops what the
    new rows conflict with; rows only meet through per-group minima, never pair by pair. The
    number of rounds is the longest chain of decisions, not the number of rows.
    """
    slim = [order, *cliques, *(["sig"] if edges is not None else [])]
    undecided = df.select(*slim)
    if blocked is not None:
        undecided = _drop_reached(undecided, order, _least_in_reach(blocked, edges))
    undecided = cut_lineage(undecided)
    kept = None
    while not undecided.isEmpty():
        first = undecided
        for c in cliques:
            least = undecided.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(order).alias("_m"))
            first = first.join(least, c, "left").where(F.col(c).isNull() | (F.col(order) == F.col("_m"))).drop("_m")
        if edges is not None:
            mins = undecided.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min(order).alias("least"))
            reach = _least_in_reach(mins, edges)
            first = first.join(reach, "sig", "left").where(F.col("sig").isNull() | (F.col(order) <= F.col("least"))).drop("least")
        first = cut_lineage(first.select(*slim))
        kept = first if kept is None else kept.unionByName(first)
        rest = undecided.join(first.select(order), order, "left_anti")
        for c in cliques:
            rest = rest.join(first.where(F.col(c).isNotNull()).select(c).distinct(), c, "left_anti")
        if edges is not None:
            taken = first.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min(order).alias("least"))
            rest = _drop_reached(rest, order, _least_in_reach(taken, edges))
        undecided = cut_lineage(rest.select(*slim))
    if kept is None:
        return df.limit(0)
    return df.join(kept.select(order), order, "left_semi")


def _drop_reached(rows: DataFrame, order: str, reach: DataFrame) -> DataFrame:
    return rows.join(reach, "sig", "left").where(F.col("least").isNull() | (F.col("least") > F.col(order))).drop("least")


def resolve(stored: DataFrame, incoming: DataFrame, compat: bool = False) -> DataFrame:
    """Outcome of every landed row: ``merge`` (its URL is stored), ``kept``, ``duplicate_url`` or ``fuzzy``.

    ``fuzzy`` rows that match a stored posting carry its URL in ``refresh_url``. With ``compat``
    a stored URL gives no precedence, so an unchanged re-scrape counts as a fuzzy duplicate.
    """
    old = with_signature(stored.select("ord", "apply_url", "company", "title"))
    new = with_signature(incoming.select("ord", "apply_url", "company", "title", "posted_date"))
    new = cut_lineage(new.select("ord", "apply_url", "sig", "company_key", "title_key"))
    old = cut_lineage(old.select("ord", "apply_url", "sig", "company_key", "title_key"))
    sigs = (
        old.select("sig", "company_key", "title_key").unionByName(new.select("sig", "company_key", "title_key"))
        .where(F.col("sig").isNotNull()).distinct()
    )
    edges = cut_lineage(signature_edges(sigs).select("sig_a", "sig_b"))
    first_old = old.where(F.col("sig").isNotNull()).groupBy("sig").agg(
        F.min("ord").alias("old_ord"), F.min_by("apply_url", "ord").alias("old_url")
    )
    taken = first_old.select("sig", F.lit(-1).cast("bigint").alias("least"))
    pool = new
    if not compat:
        known = new.join(old.select("apply_url").distinct(), "apply_url", "left_semi")
        merging = known.groupBy("apply_url").agg(F.min("ord").alias("ord"))
        forced = cut_lineage(known.join(merging, ["apply_url", "ord"], "left_semi").select("ord", "apply_url", "sig"))
        pool = new.join(forced.select("apply_url").distinct(), "apply_url", "left_anti")
        taken = taken.unionByName(
            forced.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("ord").alias("least"))
        ).groupBy("sig").agg(F.min("least").alias("least"))
    kept = cut_lineage(greedy_keep(pool, "ord", ["apply_url"], edges, taken).select("ord", "apply_url"))
    heads = kept if compat else kept.unionByName(forced.select("ord", "apply_url"))
    by_url = heads.groupBy("apply_url").agg(F.min("ord").alias("head_ord"))
    match = (
        edges.join(first_old, F.col("sig_b") == F.col("sig")).groupBy("sig_a")
        .agg(F.min_by("old_url", "old_ord").alias("refresh_url")).withColumnRenamed("sig_a", "sig")
    )
    marks = kept.select("ord", F.lit("kept").alias("_mark"))
    if not compat:
        marks = marks.unionByName(forced.select("ord", F.lit("merge").alias("_mark")))
    out = new.join(marks, "ord", "left").join(by_url, "apply_url", "left").join(match, "sig", "left")
    outcome = (
        F.when(F.col("_mark").isNotNull(), F.col("_mark"))
        .when(F.col("head_ord") < F.col("ord"), F.lit("duplicate_url"))
        .otherwise(F.lit("fuzzy"))
    )
    return out.select("ord", "apply_url", outcome.alias("outcome"), "refresh_url").withColumn(
        "refresh_url", F.when(F.col("outcome") == "fuzzy", F.col("refresh_url"))
    )


def refresh_candidates(resolved: DataFrame, incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Fuzzy duplicates of stored postings: whether they fill a missing date or are rightly skipped."""
    cand = resolved.where(F.col("refresh_url").isNotNull()).select("ord", "refresh_url")
    dated = incoming.select("ord", F.col("posted_date").alias("new_date"))
    old = stored.select(F.col("apply_url").alias("refresh_url"), F.col("posted_date").alias("old_date"))
    rows = cand.join(dated, "ord").join(old, "refresh_url")
    blank = F.col("old_date").isNull() & F.col("new_date").isNotNull()
    fills = rows.where(blank).groupBy("refresh_url").agg(F.min("ord").alias("_f"))
    return rows.join(fills, "refresh_url", "left").select(
        "ord", "refresh_url", "new_date", "old_date",
        F.when(F.col("ord") == F.col("_f"), F.lit("refreshed")).otherwise(F.lit("skipped")).alias("action"),
    )

