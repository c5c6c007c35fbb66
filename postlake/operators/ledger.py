"""Search ledger: which requests are served from stored rows and which trigger a refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.dates import cache_policy, date_bucket, seconds_between, window_minutes
from postlake.functions.keys import cache_key_json
from postlake.operators.cooldown import with_accepted
from postlake.session import cut_lineage


def keyed_requests(requests: DataFrame) -> DataFrame:
    parts = [F.col(c) for c in ("title", "q", "platform", "country", "remote_only", "job_type", "date_posted")]
    out = requests.select(
        "request_id", "ts", cache_key_json(*parts).alias("filter_json"),
        date_bucket(window_minutes(F.col("date_posted"))).alias("bucket"),
    )
    policy = cache_policy(F.col("bucket"))
    return out.select(
        "*", F.sha2("filter_json", 256).alias("cache_key"), *[policy[k].alias(k) for k in ("serve_minutes", "refresh_mode", "delta_hours")]
    )


def decisions(requests: DataFrame) -> DataFrame:
    """One decision per request: a hit while the last refresh is younger than the serve window, else a refresh.

    A refresh stamps the ledger and a hit does not, so a request is a refresh exactly when the
    cool-down rule with the serve window as TTL accepts it.
    """
    keyed = cut_lineage(keyed_requests(requests))  # read by every pass of the chain
    out = with_accepted(keyed, "cache_key", "ts", "request_id", F.col("serve_minutes") * 60)
    age = seconds_between(F.col("ts"), F.col("last_accepted_at")) / 60
    hit = ~F.col("accepted")
    first = F.col("last_accepted_at").isNull()
    mode = F.when(hit, F.lit(None).cast("string")).when(first, F.lit("full")).otherwise(F.col("refresh_mode"))
    return out.select(
        "request_id", "ts", "cache_key", "filter_json", "bucket", "serve_minutes",
        F.col("last_accepted_at").alias("last_scraped_at"),
        age.alias("age_minutes"),
        F.col("accepted").alias("should_scrape"),
        mode.alias("mode"),
        F.when(mode == "delta", F.col("delta_hours")).alias("since_hours"),
    )


def ledger(decided: DataFrame) -> DataFrame:
    """Ledger state after all requests: one row per key."""
    scrape = F.col("should_scrape")
    at = F.struct("ts", "request_id")
    return decided.groupBy("cache_key").agg(
        F.max(F.when(scrape, F.col("ts"))).alias("last_scraped_at"),
        F.min(F.when(scrape, F.col("ts"))).alias("created_at"),
        F.first("filter_json").alias("filter_json"),
        F.first("bucket").alias("date_bucket"),
        F.count_if(scrape).alias("scrape_count"),
        F.count_if(~scrape).alias("hit_count"),
        F.max_by(F.col("mode"), F.when(scrape, at)).alias("last_refresh_mode"),
    )


def merge_ledger(stored: DataFrame, update: DataFrame) -> DataFrame:
    """Add a batch's ledger rows to the stored ledger."""
    s, u = stored.alias("s"), update.alias("u")
    col = lambda side, c: F.col(f"{side}.{c}")
    newer = lambda c: F.coalesce(col("u", c), col("s", c)).alias(c)
    added = lambda c: (F.coalesce(col("s", c), F.lit(0)) + F.coalesce(col("u", c), F.lit(0))).alias(c)
    return s.join(u, F.col("s.cache_key") == F.col("u.cache_key"), "full_outer").select(
        newer("cache_key"), newer("last_scraped_at"), F.coalesce(col("s", "created_at"), col("u", "created_at")).alias("created_at"),
        newer("filter_json"), newer("date_bucket"), added("scrape_count"), added("hit_count"), newer("last_refresh_mode"),
    )


def stats(book: DataFrame) -> DataFrame:
    total = F.sum("scrape_count") + F.sum("hit_count")
    return book.agg(
        F.count(F.lit(1)).alias("combinations"),
        F.sum("scrape_count").alias("scrapes"),
        F.sum("hit_count").alias("hits"),
        F.coalesce(F.round(F.sum("hit_count") / total * 100, 1), F.lit(0.0)).alias("avoided_pct"),
    )


def purge(book: DataFrame, as_of: Column, days: int) -> DataFrame:
    return book.where(~F.coalesce(F.col("last_scraped_at") < as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(False)))
