"""Call quotas and budgets.

Both rules are first-come-first-served counters that denied calls do not advance, so they have
closed forms: rank inside the period against the limit, with the day's allowance spent hour by
hour. Only the first ``limit`` calls of a period matter, which keeps the ranked part small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postlake.functions.dates import micros
from postlake import fixed_values as V
from postlake.operators.ordered import running_sum, top_per_group


def quota_usage(calls: DataFrame) -> DataFrame:
    """Per source and day: calls used before each call and whether it is allowed.

    ``calls`` carries call_id, source, ts.
    """
    quota = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in V.DAILY_QUOTAS.items() for x in kv]), F.col("source")),
        F.lit(V.DEFAULT_DAILY_QUOTA),
    )
    rows = calls.withColumns(
        {"source": F.lower(F.trim("source")), "day": F.col("ts").cast("date"),
         "_minute": F.floor(micros(F.col("ts")) / 60_000_000)}
    )
    ranked = running_sum(rows, ["source", "day"], "_minute", ["ts", "call_id"], F.lit(1), "_before", strict=True)
    return ranked.select(
        "call_id", "source", "day", quota.cast("bigint").alias("quota"),
        F.least(F.col("_before"), quota.cast("bigint")).alias("used_before"),
        (F.col("_before") < quota).alias("allowed"),
    )


def call_budget(calls: DataFrame, hourly: int = V.HOURLY_CALL_BUDGET, daily: int = V.DAILY_CALL_BUDGET,
                reserve: int = V.BLOCKED_RESERVE) -> DataFrame:
    """Hourly and daily budget with a reserve for blocked sources. ``calls``: call_id, ts, blocked.

    Decisions: ``ok``, ``hourly``, ``daily`` (denied, with the limit that bit) and ``reserve``.
    """
    us = micros(F.col("ts"))
    rows = calls.withColumns({"_hour": F.floor(us / 3_600_000_000), "_day": F.floor(us / 86_400_000_000)})
    spent = F.least(F.count(F.lit(1)), F.lit(hourly))
    hours = rows.groupBy("_day", "_hour").agg(spent.alias("_want"))
    earlier = W.partitionBy("_day").orderBy("_hour").rowsBetween(W.unboundedPreceding, -1)  # at most 24 rows
    grants = hours.withColumn("_used", F.coalesce(F.sum("_want").over(earlier), F.lit(0))).select(
        "_hour", F.greatest(F.least(F.lit(hourly), F.lit(daily) - F.col("_used")), F.lit(0)).alias("_grant")
    )
    order = [F.asc("ts"), F.asc("call_id")]
    first = top_per_group(rows.select("_hour", "ts", "call_id"), ["_hour"], order, hourly)
    last_granted = (
        first.withColumn("_n", F.row_number().over(W.partitionBy("_hour").orderBy(*order)))
        .join(grants, "_hour")
        .where(F.col("_n") == F.col("_grant"))
        .select("_hour", F.struct("ts", "call_id").alias("_last"))
    )
    limits = grants.join(last_granted, "_hour", "left")
    # ``limits`` has one row per hour of the log. No granted row on record means the hour made
    # fewer calls than it was granted.
    inside = F.col("_last").isNull() | (F.struct("ts", "call_id") <= F.col("_last"))
    judged = rows.join(limits, "_hour").withColumn("_ok", (F.col("_grant") > 0) & inside)
    denied = judged.where(~F.col("_ok") & F.col("blocked")).orderBy(*order).limit(reserve).select("call_id", F.lit(True).alias("_spare"))
    return judged.join(denied, "call_id", "left").select(
        "call_id", "ts", "blocked",
        F.when(F.col("_ok"), F.lit("ok"))
        .when(F.col("_spare"), F.lit("reserve"))
        .when(F.col("_grant") >= hourly, F.lit("hourly"))
        .otherwise(F.lit("daily"))
        .alias("decision"),
    )
