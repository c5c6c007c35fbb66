"""Continuous ingest: landed payloads to the stored table, one version of it per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions.contacts import with_contacts
from postlake.operators import dedup, merge
from postlake.session import cut_lineage
from postlake.sources.postings import POSTING_COLUMNS, normalize_batch
from postlake.streaming.store import JobStore

CONTACTS = ["recruiter_name", "recruiter_email", "company_contact_email"]
STORED = [c for c in POSTING_COLUMNS if c != "ord"] + [*CONTACTS, "id", "fetched_at", "scraped_at", "ord"]
_TYPES = {
    "salary_min": T.DoubleType(), "salary_max": T.DoubleType(), "remote_flag": T.BooleanType(), "posted_date": T.TimestampNTZType(),
    "fetched_at": T.TimestampNTZType(), "scraped_at": T.TimestampNTZType(), "ord": T.LongType(),
}
SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in STORED])
ROWS = ["text_id" if c == "description" else c for c in STORED]  # as they are stored: descriptions stand apart
BATCH_STEP = 1_000_000_000_000  # order numbers: earlier versions first


def posting_rows(store: JobStore, normal: DataFrame, as_of: Column, version: int) -> DataFrame:
    """Normalised postings as stored rows: with contacts, numbered after all earlier versions, their descriptions landed."""
    rows = with_contacts(store.land(version, normal))  # one plan per source ends here
    added = {"id": F.sha2("apply_url", 256), "fetched_at": as_of, "scraped_at": as_of, "ord": F.col("ord") + F.lit(version * BATCH_STEP)}
    return rows.withColumns(added).select(*ROWS)


def load(store: JobStore, landed: DataFrame, sources: list[str], as_of: Column) -> None:
    """Fill an empty store (version 0): the first row of every link, duplicates by name included."""
    rows = cut_lineage(merge.first_per(posting_rows(store, normalize_batch(landed, sources, as_of), as_of, 0), "apply_url"))
    store.rows.add(0, rows)
    store.add_signatures(0, rows, store.signatures.read(-1))


def _dates_to_fill(store: JobStore, version: int, resolved: DataFrame, rows: DataFrame) -> DataFrame:
    """(apply_url, new_date, new_precision): stored postings without a date that a fuzzy duplicate dates."""
    dated = rows.where("posted_date IS NOT NULL").select("ord", F.col("posted_date").alias("new_date"), F.col("posted_date_precision").alias("new_precision"))
    cand = resolved.where("refresh_url IS NOT NULL").select("ord", F.col("refresh_url").alias("apply_url")).join(dated, "ord")
    first = cut_lineage(cand.groupBy("apply_url").agg(F.min_by(F.struct("new_date", "new_precision"), F.col("ord")).alias("n")).select("apply_url", "n.*"))
    old = store.rows.read(version, store.rows.touched(first.select("apply_url"))).select("apply_url", "posted_date")
    return cut_lineage(first.join(old.where("posted_date IS NULL").select("apply_url"), "apply_url", "left_semi"))


def ingest_batch(store: JobStore, version: int, normal: DataFrame, sources: list[str], as_of: Column) -> None:
    """One batch of normalised postings as version ``version`` of the store, from version - 1.

    Fuzzy duplicates of stored postings first fill their missing dates (and bump ``fetched_at`` where they do), then
    new links are inserted with contacts and known ones are merged write-once. Reads and rewrites touch the buckets of
    the batch's links, of the postings it dates, and of the index items and companies it names.
    """
    rows = cut_lineage(posting_rows(store, normal, as_of, version))
    near = cut_lineage(store.matching(version - 1, rows))
    at_links = store.rows.touched(rows.select("apply_url"))
    known = store.rows.read(version - 1, at_links).join(rows.select("apply_url").distinct(), "apply_url", "left_semi")
    named = ["ord", "apply_url", "company", "title"]
    resolved = cut_lineage(dedup.resolve(near.select(*named).unionByName(known.select(*named)).distinct(), rows))
    fills = _dates_to_fill(store, version - 1, resolved, rows)
    used = cut_lineage(rows.join(resolved.where(F.col("outcome").isin("kept", "merge")).select("ord"), "ord", "left_semi"))
    buckets = sorted({*store.rows.touched(used.select("apply_url")), *store.rows.touched(fills.select("apply_url"))})
    old = store.rows.read(version - 1, buckets).join(fills, "apply_url", "left")
    filled = F.col("new_date").isNotNull()
    old = old.withColumns({
        "posted_date": F.coalesce("posted_date", "new_date"),
        "posted_date_precision": F.when(filled, F.coalesce("new_precision", "posted_date_precision")).otherwise(F.col("posted_date_precision")),
        "fetched_at": F.when(filled, as_of).otherwise(F.col("fetched_at")),
    })
    store.rows.rewrite(version, merge.merge_write_once(old, used, as_of, ROWS), buckets)
    store.add_signatures(version, rows.join(resolved.where("outcome = 'kept'").select("ord"), "ord", "left_semi"), near)
    targets = normal.sparkSession.createDataFrame([(s,) for s in sources], "portal STRING")
    log = merge.append_runlog(rows.select(F.col("source_platform").alias("portal")), targets, "5-Tier", as_of)
    log.write.mode("overwrite").parquet(f"{store.base}/runlog/{version}")


def run_ingest(
    normal: DataFrame, store: JobStore, sources: list[str], as_of: Column, shown: Callable[[Column], Column] = lambda text: text
) -> DataFrame:
    """Drain a stream of normalised postings (``normalize_batch`` of the landing stream, which Spark runs per micro-batch)
    into the store; micro-batch n writes version n + 1. Returns the last version's rows, with what ``shown`` makes of a description."""
    last = {"version": 0}

    def step(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(store, batch_id + 1, batch, sources, as_of)
        last["version"] = batch_id + 1

    query = (
        normal.writeStream.option("checkpointLocation", f"{store.base}/checkpoint").trigger(availableNow=True)
        .foreachBatch(step).start()
    )
    query.awaitTermination()
    return store.described(store.rows.read(last["version"]), shown)
