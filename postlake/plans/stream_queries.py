"""Registered queries: the same logs as streams, drained to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postlake.plans import bindings as B
from postlake.plans import payloads as P
from postlake.plans.registry import query
from postlake.session import shared_dir
from postlake.sources.postings import normalize_batch
from postlake.streaming import stateful
from postlake.streaming.ingest import SCHEMA, load, run_ingest
from postlake.streaming.run import drain
from postlake.streaming.store import JobStore

c = F.col


@query("stream_ingest")
def _(spark, d):
    """A filled store (every fourth landed posting), then three landings drained one after the other: the other
    postings and, again, every twelfth of the stored ones."""
    landed = P.landing(spark, d).select("ord", "raw", "source")
    base = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/streams/ingest-{uuid.uuid4().hex[:8]}"
    store = JobStore(spark, base, SCHEMA)
    # payloads stand by source: each source's reader reads its own, and postings meet their texts once
    land = lambda part, name: landed.where(part).write.mode("append").partitionBy("source").parquet(f"{base}/{name}")
    land("ord % 4 = 0", "filled")
    load(store, spark.read.schema(landed.schema).parquet(f"{base}/filled"), P.DISPATCH, B.as_of() - F.expr("INTERVAL 1 DAY"))
    normal = None
    for part in range(3):
        land(f"(ord % 4 <> 0 OR ord % 12 = 0) AND ord div 12 % 3 = {part}", "landing")
        if normal is None:
            normal = normalize_batch(spark.readStream.schema(landed.schema).parquet(f"{base}/landing"), P.DISPATCH, B.as_of())
        rows = run_ingest(normal, store, P.DISPATCH, B.as_of(), F.md5)
    return rows


@query("cooldown_stream")
def _(spark, d):
    r = B.requests_of(B.event_stream(spark, d)).select(F.coalesce("title", F.lit("")).alias("key"), "ts", c("request_id").alias("id"))
    return drain(stateful.cooldown(r, 3600), "cooldown").select("id", "key", "accepted")


@query("rate_budget")
def _(spark, d):
    r = B.runs_of(B.event_stream(spark, d)).select(c("portal").alias("source"), "ts", c("run_id").alias("id"))
    return drain(stateful.daily_quota(r), "quota").select("id", "source", "used_before", "allowed")


@query("session_state")
def _(spark, d):
    p = B.prompts_of(B.event_stream(spark, d, "conversations"))
    return drain(stateful.session_carry(p), "sessions").drop("batch")


@query("session_windows")
def _(spark, d):
    p = B.prompts_of(B.event_stream(spark, d, "conversations"))
    rows = drain(stateful.session_counts(p), "windows", "complete")
    return rows.join(rows.agg(F.max("batch").alias("batch")), "batch").select("session_id", "started", "prompts")


@query("health_stream")
def _(spark, d):
    rows = drain(stateful.rolling_health(B.runs_of(B.event_stream(spark, d))), "health", "update")
    last = rows.groupBy("method", "portal").agg(F.max_by(F.struct("health_status", "success_rate", "avg_jobs"), "batch").alias("r"))
    return last.select(
        "method", "portal", "r.health_status", F.round("r.success_rate", 2).alias("success_rate"), F.round("r.avg_jobs", 1).alias("avg_jobs")
    )


@query("dedup_stream")
def _(spark, d):
    e = B.event_stream(spark, d)
    url = F.regexp_replace(B.job_columns()["apply_url"], "[0-9]{2}$", "")
    return drain(stateful.first_urls(e.select(url.alias("apply_url"), c("ts").alias("ingest_ts"))), "urls").select("apply_url")
