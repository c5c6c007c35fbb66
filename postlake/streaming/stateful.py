"""Keyed streaming operators: cool-down, daily quota, session intent and method health.

The state of a key is a handful of values. A micro-batch hands each key's new rows over in
Arrow chunks; they are put in time order within the batch, so the size of a batch (set on the
source) bounds the work of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postlake.functions.dates import micros
from postlake import fixed_values as V
from postlake.functions.prompts import intent_columns

_NO_TIMEOUT = GroupStateTimeout.NoTimeout


def _batch(chunks: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(chunks), ignore_index=True).sort_values(order, kind="stable")


def cooldown(events: DataFrame, ttl_seconds: int = V.COOLDOWN_SECONDS) -> DataFrame:
    """``events``: key, ts, id. An event is accepted when the last accepted one is old enough."""
    ttl = ttl_seconds * 1_000_000

    def step(key, chunks, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = _batch(chunks, ["us", "id"])
        accepted = []
        for us in rows["us"]:
            ok = last is None or us - last >= ttl
            last = us if ok else last
            accepted.append(ok)
        state.update((int(last),))
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "accepted": accepted})

    us = micros(F.col("ts"))
    return events.select("key", "id", us.alias("us")).groupBy("key").applyInPandasWithState(
        step, "key STRING, id BIGINT, accepted BOOLEAN", "last BIGINT", "append", _NO_TIMEOUT
    )


def daily_quota(calls: DataFrame) -> DataFrame:
    """``calls``: source, ts, id. The count of a source starts again every day.

    The state is kept by source and day, so calls that arrive after the next day has begun still
    count against their own day. It is one number for each of them and is not timed out.
    """
    quotas, default = V.DAILY_QUOTAS, V.DEFAULT_DAILY_QUOTA

    def step(key, chunks, state: GroupState):
        used = state.get[0] if state.exists else 0
        limit = quotas.get(key[0], default)
        rows = _batch(chunks, ["us", "id"])
        # calls are allowed until the limit is reached; none after that adds to the count
        before = [min(used + i, max(limit, used)) for i in range(len(rows))]
        state.update((min(used + len(rows), max(limit, used)),))
        yield pd.DataFrame({"source": key[0], "id": rows["id"], "used_before": before, "allowed": [b < limit for b in before]})

    us = micros(F.col("ts"))
    return calls.select("source", "id", us.alias("us"), F.expr("to_date(ts)").alias("day")).groupBy("source", "day").applyInPandasWithState(
        step, "source STRING, id BIGINT, used_before BIGINT, allowed BOOLEAN", "used BIGINT", "append", _NO_TIMEOUT
    )


_FIELDS = ["query", "remote_only", "country", "min_salary", "platform"]


def session_carry(prompts: DataFrame, idle_minutes: int = V.SESSION_IDLE_MINUTES) -> DataFrame:
    """Intent of each prompt with what it inherits; an idle session forgets."""
    idle = idle_minutes * 60_000_000

    def step(key, chunks, state: GroupState):
        held = list(state.get) if state.exists else None
        out = []
        for r in _batch(chunks, ["us", "turn"]).to_dict("records"):
            live = held is not None and r["us"] - held[0] <= idle
            follow = bool(live and (r["refers_back"] or r["asks_details"]))
            own = [None if pd.isna(r[f]) else r[f] for f in _FIELDS]
            if follow:
                own = [h if (o is None or (f == "remote_only" and not o)) else o for f, o, h in zip(_FIELDS, own, held[1:])]
            held = [int(r["us"]), *own]
            out.append((key[0], r["turn"], follow, *own))
        state.update(tuple(held))
        yield pd.DataFrame(out, columns=["session_id", "turn", "is_follow_up", *_FIELDS])

    fields = "query STRING, remote_only BOOLEAN, country STRING, min_salary DOUBLE, platform STRING"
    us = micros(F.col("ts"))
    return (
        prompts.select("session_id", "turn", us.alias("us"), *[c.alias(k) for k, c in intent_columns(F.col("message")).items()])
        .groupBy("session_id")
        .applyInPandasWithState(
            step, f"session_id BIGINT, turn BIGINT, is_follow_up BOOLEAN, {fields}", f"us BIGINT, {fields}", "append", _NO_TIMEOUT
        )
    )


def session_counts(prompts: DataFrame, idle_minutes: int = V.SESSION_IDLE_MINUTES, late: str = "7 days") -> DataFrame:
    """Prompts per session of activity; a session ends after the idle gap."""
    window = F.session_window("at", f"{idle_minutes} minutes")
    return (
        prompts.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
        .groupBy("session_id", window.alias("w")).agg(F.count(F.lit(1)).alias("prompts"))
        .select("session_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "prompts")
    )


def rolling_health(runs: DataFrame, window: int = 20) -> DataFrame:
    """Health of each (method, portal) over its last runs, emitted after every micro-batch."""

    def step(key, chunks, state: GroupState):
        won, jobs = (list(x) for x in state.get) if state.exists else ([], [])
        rows = _batch(chunks, ["us", "run_id"])
        won = (won + [int(x) for x in rows["won"]])[-window:]
        jobs = (jobs + [float(x) for x in rows["num_jobs_found"]])[-window:]
        state.update((won, jobs))
        rate = sum(won) / len(won)
        status = "CRITICAL" if rate < 0.3 else "DEGRADED" if rate < 0.7 else "HEALTHY"
        yield pd.DataFrame([(key[0], key[1], status, rate, sum(jobs) / len(jobs))],
                           columns=["method", "portal", "health_status", "success_rate", "avg_jobs"])

    us = micros(F.col("ts"))
    won = F.coalesce(F.col("success") & (F.col("num_jobs_found") > 0), F.lit(False))
    return (
        runs.select("method", "portal", "run_id", "num_jobs_found", us.alias("us"), won.cast("int").alias("won"))
        .groupBy("method", "portal")
        .applyInPandasWithState(
            step, "method STRING, portal STRING, health_status STRING, success_rate DOUBLE, avg_jobs DOUBLE",
            "won ARRAY<INT>, jobs ARRAY<DOUBLE>", "update", _NO_TIMEOUT,
        )
    )


def first_urls(postings: DataFrame, late: str = "7 days") -> DataFrame:
    """First sight of each link; the memory of a link ends with the watermark."""
    seen = postings.withColumn("at", F.col("ingest_ts").cast("timestamp")).withWatermark("at", late)
    return seen.dropDuplicatesWithinWatermark(["apply_url"]).drop("at")
