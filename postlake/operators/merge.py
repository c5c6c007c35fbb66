"""Merges into the stored table. Results are new snapshots; the table being read is never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.keys import raw_hash
from postlake.operators.dedup import greedy_keep

MERGE_COLUMNS = [
    "id", "title", "company", "source_platform", "apply_url", "posted_date", "posted_date_precision", "fetched_at", "scraped_at",
]


_MERGED = ["apply_url", "posted_date", "posted_date_precision", "fetched_at", "scraped_at"]


def first_per(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Smallest ``order`` row of every key, as a map-side combinable aggregate (a hot key sends one row per task)."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return picked.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def merge_write_once(stored: DataFrame, incoming: DataFrame, as_of: Column, columns: list[str] = MERGE_COLUMNS) -> DataFrame:
    """Snapshot after a batch, of the given stored columns.

    By ``apply_url``: absent rows are inserted; present rows only fill a missing posting date
    (never move one), always bump ``fetched_at`` and keep ``scraped_at``. ``action`` tells them apart.
    """
    # Several landed rows of one URL: the first inserts, the first dated one fills the blank.
    dated = F.struct("posted_date", "posted_date_precision")
    first = incoming.groupBy("apply_url").agg(
        F.min_by(F.struct(*[c for c in columns if c != "apply_url"]), F.col("ord")).alias("n"),
        F.min_by(dated, F.when(F.col("posted_date").isNotNull(), F.col("ord"))).alias("d"),
        F.max("posted_date").alias("latest"),
    )
    s = stored.select(*columns).alias("s")
    j = s.join(first, F.col("s.apply_url") == first["apply_url"], "full_outer")
    old = F.col("s.apply_url").isNotNull()
    new = F.col("n").isNotNull()
    fills = old & F.col("s.posted_date").isNull() & F.col("d.posted_date").isNotNull()
    plain = [c for c in columns if c not in _MERGED]
    return j.select(
        *[F.when(old, F.col(f"s.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in plain],
        F.coalesce(F.col("s.apply_url"), first["apply_url"]).alias("apply_url"),
        F.coalesce("s.posted_date", "d.posted_date").alias("posted_date"),
        F.when(fills, F.coalesce("d.posted_date_precision", "s.posted_date_precision"))
        .when(old, F.col("s.posted_date_precision"))
        .otherwise(F.coalesce("d.posted_date_precision", "n.posted_date_precision"))
        .alias("posted_date_precision"),
        F.when(new, as_of).otherwise(F.col("s.fetched_at")).alias("fetched_at"),
        F.when(old, F.col("s.scraped_at")).otherwise(as_of).alias("scraped_at"),
        F.when(~old, F.lit("inserted"))
        .when(fills, F.lit("refreshed"))
        .when(new & (F.col("latest") > F.col("s.posted_date")), F.lit("bump_ignored"))
        .when(new, F.lit("reconfirmed"))
        .otherwise(F.lit("untouched"))
        .alias("action"),
    )


def insert_absent(stored: DataFrame, incoming: DataFrame, key: str = "apply_url") -> DataFrame:
    """Landed rows whose key is not stored, the first of each key."""
    return first_per(incoming.join(stored.select(key).distinct(), key, "left_anti"), key)


def absent_by_url_or_hash(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Two anti joins instead of one OR join, which could only run as a nested loop.

    Links and hashes meet by 16 bytes of their digests: both joins move every landed row, and the texts are most of it.
    """
    short = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 32))
    url, text = short(F.col("apply_url")).alias("_url"), short(F.col("raw_hash")).alias("_hash")
    by_url = incoming.select("*", url, text).join(stored.select(url).distinct(), "_url", "left_anti")
    return by_url.join(stored.select(text).distinct(), "_hash", "left_anti").select(*incoming.columns)


def with_raw_hash(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "raw_hash", raw_hash(F.col("title"), F.col("company"), F.col("source_platform"), F.col("posted_date"))
    )


def insert_hash_dedup(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """First row wins by URL or hash inside the batch, then only rows unknown to the store by either.

    A row that is already stored is not inserted but still shadows later copies of its URL or
    hash, exactly like a kept row, so both kinds take part in the first-wins pass.
    """
    valid = incoming.where((F.trim("title") != "") & (F.trim("apply_url") != ""))
    first = greedy_keep(valid, "ord", cliques=["apply_url", "raw_hash"])
    return absent_by_url_or_hash(stored, first)


def append_runlog(found: DataFrame, targets: DataFrame, layer: str, as_of: Column) -> DataFrame:
    """One row per target portal and run."""
    n = found.groupBy("portal").agg(F.count(F.lit(1)).alias("n"))
    hits = F.coalesce(F.col("n"), F.lit(0))
    return targets.select("portal").join(n, "portal", "left").select(
        "portal", as_of.alias("ts"), F.lit(layer).alias("layer_used"), (hits > 0).alias("success"),
        hits.cast("double").alias("num_jobs_found"),
        F.when(hits == 0, F.lit("Returned 0 results for this query")).alias("error_message"),
    )


def append_guard_audit(reasons: DataFrame, filter_hash: Column, as_of: Column) -> DataFrame:
    return reasons.where(F.col("reason").isNotNull()).select(
        F.col("id").alias("job_id"), filter_hash.alias("filter_hash"), F.lit("Step 5 Validator").alias("check_level"),
        F.lit("EXCLUDE").alias("outcome"), "reason", as_of.alias("ts"),
    )


SEARCH_DOC_FIELDS = [
    "id", "title", "company", "city", "country", "salary_min", "salary_max", "currency", "remote_flag", "job_type",
    "source_platform", "apply_url", "description_snippet", "posted_date", "recruiter_name", "recruiter_email",
    "company_contact_email",
]


def search_documents(df: DataFrame) -> DataFrame:
    """One JSON document per posting for the search index."""
    return df.select("id", F.to_json(F.struct(*SEARCH_DOC_FIELDS), {"ignoreNullFields": "false"}).alias("doc"))


def merge_partial(paid: DataFrame, free: DataFrame) -> DataFrame:
    """Paid rows first, then free rows whose URL is set and new."""
    extra = free.where(F.coalesce(F.col("apply_url"), F.lit("")) != "").join(
        paid.select("apply_url").distinct(), "apply_url", "left_anti"
    )
    return paid.unionByName(first_per(extra, "apply_url"))
