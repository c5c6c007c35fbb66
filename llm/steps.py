"""Small shared steps: written intermediate tables, size-checked broadcasts, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.session import cut_lineage

BROADCAST_ROWS = 2_000_000
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Spark hands Python steps batches of at most BATCH_BYTES (or one row) meanwhile, not of as many rows, however long.

    Every task holds a batch several times, in the executor and in its Python worker. Results don't depend on batches.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ids_as_text(df: DataFrame, *names: str) -> DataFrame:
    """Number columns as text for a Python step: pandas would round large numbers in a column with nulls."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def ids_as_numbers(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table of narrow rows for broadcast if it has at most ``rows``; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def places(df: DataFrame) -> DataFrame:
    """Adds ``part`` and ``at``: the task and the place in it of each row of a range-partitioned table, and writes it."""
    df = df.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return cut_lineage(df)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours (an aggregation that combines
    before the shuffle, so hubs are cheap) and then follows labels once, so distances halve: the rounds
    grow with the logarithm of a component's diameter. Labels are written between rounds.
    """
    both = cut_lineage(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = cut_lineage(labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was")))
        jumped = hooked.join(hooked.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
        new = cut_lineage(jumped.select("node", F.least("to", F.coalesce("next", "to")).alias("label"), "was"))
        if new.where("label <> was").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label")
