"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

How it works
    Sources ordered by code point (null last) weigh 5, 2, 1, 5, 2, 1, ... and share all words by weight; no source
    takes more than CAP times its own words, and what is over is shared again by weight until none is above.
    Document rates r minimise the relative entropy sum of size * (r log r - r + 1) under one token constraint a source:
    sum of size * r = target. The convex dual has one multiplier a source, and the rates are exponentially tilted:
    r = exp(multiplier). Newton iterations on the dual work on the table of sources' token sums, one pass each,
    and stop when every constraint holds.
    Rates become copies by systematic rounding: in order of falling size, the running sum of rates is rounded, so a
    document gets the whole part of its rate or one more, and a source's words are off by half its largest document at most.
    Ranks come from a range partitioning by (source, size): a source with a third of all documents is spread over many
    tasks, and only the counts of (partition, source) are summed up. Then the document that best closes what is left
    of a source's gap gets a copy more or less, REPAIRS times at most.

Defined results: null and empty texts have size 0 and take 0; null is a source of its own, the last; an empty table gives no
rows; repeated rows count and are mixed each; no document is taken more than CAP times; ties in size are ordered by
a hash of doc_id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.steps import places, small
from postlake.session import cut_lineage

WEIGHTS = (5, 2, 1)
CAP = 3
REPAIRS = 4
NEAR = 0.002
TOLERANCE = 1e-10


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    totals = places(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last()))
    counts = totals.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a task
    weight = F.get(F.array(*(F.lit(w) for w in weights)), F.pmod(F.col("before") + F.col("at"), F.lit(len(weights))).cast("int"))
    table = cut_lineage(totals.join(F.broadcast(before), "part").select("source", "source_size", weight.alias("weight")))
    all_words, all_weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    if not all_words:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    share, above = all_words / all_weight, -1
    while True:
        over = F.col("weight") * F.lit(share) > cap * F.col("source_size")
        r = table.agg(F.count_if(over).alias("n"), F.sum(F.when(over, cap * F.col("source_size"))).alias("fixed"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if r["n"] == above or not r["open"]:
            break
        above, share = r["n"], (all_words - (r["fixed"] or 0)) / r["open"]
    target = F.least(F.col("weight") * F.lit(share), (cap * F.col("source_size")).cast("double"))
    return cut_lineage(table.select("source", "source_size", target.alias("target")))


def source_rates(targets: DataFrame, steps: int = 60) -> DataFrame:
    """Adds ``rate``, solved by Newton's method on the dual: minimise sum of size * exp(m) - target * m."""
    table = cut_lineage(targets.withColumn("m", F.lit(0.0)))
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    for _ in range(steps):
        gap = table.where(live).agg(F.max(F.abs(F.col("source_size") * F.exp("m") / F.col("target") - 1))).first()[0]
        if gap is None or gap <= TOLERANCE:
            break
        # gradient over Hessian; a step of at most 1 keeps the exponential in range
        step = 1 - F.col("target") / (F.col("source_size") * F.exp("m"))
        table = cut_lineage(table.withColumn("m", F.when(live, F.col("m") - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step))).otherwise(F.col("m"))))
    return table.select("source", "source_size", "target", F.when(live, F.exp("m")).otherwise(0.0).alias("rate"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mixed(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Rows of (doc_id, source, size, ...) with source_size, target, rate, copies and taken added."""
    rows = cut_lineage(rows)
    rates = cut_lineage(source_rates(source_targets(rows.select("source", "size"), weights, cap)))
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.xxhash64("doc_id"), F.col("doc_id")]
    placed = places(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    blocks = placed.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")
    blocks = cut_lineage(blocks.select(F.col("part").alias("b_part"), F.col("source").alias("b_source"), "first", before.alias("before")))
    named = rates.withColumnRenamed("source", "r_source")
    out = placed.join(small(blocks), (F.col("part") == F.col("b_part")) & _same("source", "b_source")).join(small(named), _same("source", "r_source"))
    rank = F.col("before") + F.col("at") - F.col("first")
    # a rate a hair under a whole number by rounding of the exponential counts as that number
    rate = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate"))
    part = rate - F.floor(rate)
    copies = F.floor(rate) + F.floor(part * (rank + 1) + 0.5) - F.floor(part * rank + 0.5)
    out = out.withColumn("copies", F.least(F.when(F.col("size") > 0, copies).otherwise(0), F.lit(cap)).cast("bigint"))
    out = out.drop("b_part", "b_source", "first", "before", "r_source")
    more = _repairs(out.select("part", "at", "source", "size", "target", "copies"), cap)
    if more is not None:
        out = out.join(small(more), (F.col("part") == F.col("m_part")) & (F.col("at") == F.col("m_at")), "left")
        out = out.withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("m_part", "m_at", "more")
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("part", "at")


def _repairs(copies: DataFrame, cap: int) -> DataFrame | None:
    """(m_part, m_at, more): documents that get a copy more or less, a few of each source whose words miss its target."""
    copies = cut_lineage(copies)
    gaps = cut_lineage(copies.groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).select(F.col("source").alias("g_source"), "target", (F.col("target") - F.col("taken")).alias("gap")))
    done = None
    for _ in range(REPAIRS):
        open_ = gaps.where(F.abs("gap") > NEAR * F.col("target")).select("g_source", "gap")
        if open_.limit(1).count() == 0:
            break
        rows = copies.join(small(cut_lineage(open_)), _same("source", "g_source"))
        if done is not None:
            rows = rows.join(small(done.select("m_part", "m_at")), (F.col("part") == F.col("m_part")) & (F.col("at") == F.col("m_at")), "left_anti")
        rows = rows.where("size > 0").where(F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0))
        left = F.abs(F.abs("gap") - F.col("size"))
        best = rows.where(left < F.abs("gap")).groupBy("g_source").agg(
            F.min_by(F.struct("part", "at", "size", F.signum("gap").cast("bigint").alias("more")), F.struct(left, "part", "at")).alias("b")
        )
        best = cut_lineage(best.select(F.col("b.part").alias("m_part"), F.col("b.at").alias("m_at"), F.col("b.more").alias("more"), "b.size", F.col("g_source").alias("s")))
        done = best.select("m_part", "m_at", "more") if done is None else cut_lineage(done.union(best.select("m_part", "m_at", "more")))
        change = best.select("s", (F.col("more") * F.col("size")).alias("change"))
        gaps = cut_lineage(gaps.join(small(change), _same("g_source", "s"), "left").select("g_source", "target", (F.col("gap") - F.coalesce("change", F.lit(0))).alias("gap")))
    return done


def mix(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, size, source_size, target, taken, copies and rate."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"))
    return mixed(rows).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def _row_key(docs: DataFrame) -> Column:
    """A hash of the whole row, with its nulls told from missing neighbours."""
    return F.xxhash64(*(docs[c] for c in docs.columns), *(docs[c].isNull() for c in docs.columns))


def mixture(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, and how many copies and words of each it takes.

    Columns of the documents that are themselves called ``copies`` or ``taken`` are replaced by the computed ones. The mix is
    worked out on narrow rows; documents are joined to it at the end by their id and a hash of the row, so texts are never written on the way.
    """
    rows = docs.select(
        _row_key(docs).alias("row_key"), docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"), words(docs["text"].cast("string")).alias("size")
    )
    taken = cut_lineage(mixed(rows).groupBy(F.col("row_key").alias("r_key"), F.col("doc_id").alias("r_id"), "copies", "taken").agg(F.count("*").alias("n")))
    per_row = taken.groupBy("r_key", "r_id").agg(F.sum("n").alias("n"), F.max("copies").alias("copies"), F.max("taken").alias("taken"))
    single = small(cut_lineage(per_row.where("n = 1 AND copies > 0").drop("n")))
    twice = cut_lineage(per_row.where("n > 1 AND copies > 0").select("r_key", "r_id"))
    of = lambda t: (_row_key(docs) == t["r_key"]) & docs["doc_id"].cast("bigint").eqNullSafe(t["r_id"])
    own = [c for c in docs.columns if c.lower() not in ("copies", "taken")]
    out = docs.join(single, of(single)).select(*(docs[c] for c in own), single["copies"], single["taken"])
    if twice.limit(1).count() == 0:
        return out
    # equal rows that stand more than once: one of them, as often as its numbers of copies were dealt
    twice = small(twice)
    same = docs.join(twice, of(twice)).select(F.struct(*(docs[c] for c in own)).alias("row"), twice["r_key"], twice["r_id"])
    same = same.groupBy("r_key", "r_id").agg(F.first("row").alias("row"))
    dealt = taken.where("copies > 0").select(F.col("r_key").alias("d_key"), F.col("r_id").alias("d_id"), "copies", "taken", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    same = same.join(dealt, (F.col("r_key") == F.col("d_key")) & F.col("r_id").eqNullSafe(F.col("d_id")))
    return out.unionByName(same.select(*(F.col("row").getField(c).alias(c) for c in own), "copies", "taken"))
