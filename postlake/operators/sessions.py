"""Conversation sessions: idle splitting, inherited intent and the least-recently-used cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.dates import micros
from postlake import fixed_values as V
from postlake.functions.prompts import intent_columns
from postlake.operators.ordered import carry_last, running_sum
from postlake.session import cut_lineage

_FIELDS = ["query", "remote_only", "country", "min_salary", "platform"]


def carried_intent(prompts: DataFrame, idle_minutes: int = V.SESSION_IDLE_MINUTES) -> DataFrame:
    """Intent of every prompt with what it inherits from the session so far.

    A field is inherited along a run of follow-ups until a prompt states it itself, so the
    chained inheritance is the last stated value: a prompt that is no follow-up states all fields.
    """
    hour = F.floor(micros(F.col("ts")) / 3_600_000_000)
    own = prompts.select("session_id", "turn", "ts", *[c.alias(k) for k, c in intent_columns(F.col("message")).items()])
    own = own.withColumn("_hour", hour)
    order = ["ts", "turn"]
    own = carry_last(own, ["session_id"], "_hour", order, {"_prev": F.col("ts")}, strict=True)
    idle = F.col("_prev").isNull() | (F.timestamp_diff("SECOND", F.col("_prev"), F.col("ts")) > idle_minutes * 60)
    own = running_sum(own.withColumn("_new", idle), ["session_id"], "_hour", order, F.col("_new").cast("bigint"), "session_no")
    own = cut_lineage(own)  # the next step reads it twice
    own = own.withColumns(
        {
            "is_detail_request": F.col("asks_details") & ~F.col("_new"),
            "is_follow_up": (F.col("refers_back") | F.col("asks_details")) & ~F.col("_new"),
        }
    )
    stated = {f: F.col(f).isNotNull() for f in _FIELDS}
    stated["remote_only"] = F.col("remote_only")
    # one struct per field: NULL means "says nothing", a struct around NULL means "states nothing on purpose"
    boxes = [F.when(stated[f] | ~F.col("is_follow_up"), F.struct(F.col(f).alias("v"))).alias(f) for f in _FIELDS]
    out = own.select("session_id", "turn", "ts", "_hour", "session_no", "is_follow_up", "is_detail_request", *boxes)
    out = carry_last(out, ["session_id", "session_no"], "_hour", order, {f"_c_{f}": F.col(f) for f in _FIELDS})
    return out.select(
        "session_id", "turn", "session_no", "is_follow_up", "is_detail_request",
        *[F.col(f"_c_{f}.v").alias(f) for f in _FIELDS],
    )


def lru_cap(prompts: DataFrame, now: Column, idle_minutes: int, cap: int) -> DataFrame:
    """Sessions alive at ``now``: idle ones expire, then the most recently used ``cap`` stay (a distributed top-k)."""
    last = prompts.groupBy("session_id").agg(F.max("ts").alias("last_accessed"), F.count(F.lit(1)).alias("prompts"))
    alive = last.where(F.timestamp_diff("SECOND", F.col("last_accessed"), now) <= idle_minutes * 60)
    return alive.orderBy(F.desc("last_accessed"), F.asc("session_id")).limit(cap)
