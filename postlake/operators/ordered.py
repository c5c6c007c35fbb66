"""Order-dependent column operators that survive hot keys.

A plain window over a key sorts all rows of that key in one task. Here every key is cut into
time chunks: the window runs inside (key, chunk), a small table of one row per (key, chunk)
carries the state across chunks, and both are joined back. One key may then hold a third of
all rows and still be worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postlake.session import cut_lineage


def _joined_back(df: DataFrame, per_chunk: DataFrame, keys: list[str], chunk: str) -> DataFrame:
    """Left join on (keys, chunk), NULL keys included."""
    right = per_chunk.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, chunk]], "_prior")
    same = None
    for k in [*keys, chunk]:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = c if same is None else same & c
    return df.join(right, same, "left").drop(*[f"_k_{k}" for k in [*keys, chunk]])


def carry_last(
    df: DataFrame, keys: list[str], chunk: str, order: list[str], values: dict[str, Column], *, strict: bool = False,
    reverse: bool = False,
) -> DataFrame:
    """For every entry of ``values`` the latest non-NULL value at or before each row in ``order``
    (strictly before with ``strict``), as a column of that name.

    ``reverse`` walks the order backwards, which gives the next value instead of the last one.
    ``chunk`` must grow with ``order``.
    """
    rank = [F.desc(c) if reverse else F.asc(c) for c in order]
    inside = W.partitionBy(*keys, chunk).orderBy(*rank).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    across = W.partitionBy(*keys).orderBy(F.desc(chunk) if reverse else F.asc(chunk)).rowsBetween(W.unboundedPreceding, -1)
    edge_of = F.min_by if reverse else F.max_by
    rows = df.withColumns({f"_v_{k}": v for k, v in values.items()})
    at = F.struct(*order)
    edges = rows.groupBy(*keys, chunk).agg(
        *[edge_of(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), at)).alias(f"_e_{k}") for k in values]
    )
    before = F.struct(*[F.last(f"_e_{k}", ignorenulls=True).over(across).alias(k) for k in values])
    state = edges.select(*keys, chunk, before.alias("_prior"))
    within = rows.withColumns({f"_w_{k}": F.last(f"_v_{k}", ignorenulls=True).over(inside) for k in values})
    joined = _joined_back(within, state, keys, chunk)
    kept = [c for c in df.columns if c not in values]
    return joined.select(*kept, *[F.coalesce(f"_w_{k}", F.col(f"_prior.{k}")).alias(k) for k in values])


def running_sum(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, out: str, *,
                strict: bool = False) -> DataFrame:
    """Sum of ``value`` over the rows up to each row (before it with ``strict``)."""
    inside = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    rows = df.withColumn("_value", value)
    across = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    state = rows.groupBy(*keys, chunk).agg(F.sum("_value").alias("_sum")).select(
        *keys, chunk, F.sum("_sum").over(across).alias("_prior")
    )
    within = rows.withColumn("_within", F.sum("_value").over(inside))
    zero = F.lit(0)
    return (
        _joined_back(within, state, keys, chunk)
        .withColumn(out, F.coalesce("_within", zero) + F.coalesce("_prior", zero))
        .drop("_value", "_within", "_prior")
    )


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group.

    ``row_number() <= n`` lets Spark keep only ``n`` rows per group and map task before the
    shuffle, so a hot group sends ``n`` rows per task instead of all of them.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of every row, from 1, in a total ``order`` of the whole table.

    The rows are dealt to tasks by ranges of the order and written; a row's place is its place in
    its range plus the rows of the ranges before, so only one count per range meets in one task.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    placed = cut_lineage(dealt.withColumns({"_range": F.spark_partition_id(), "_at": at.bitwiseAND((1 << 33) - 1)}))
    ranges = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = ranges.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")
