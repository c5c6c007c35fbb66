"""Date-integrity audits and table repair. Every repair returns a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.dates import is_fresh, is_impossible, precision_from_stored, seconds_between
from postlake.functions.jobs import canonical_title, city_country, normalize_job_type
from postlake.functions.text import contains_any
from postlake.operators.guard import with_freshness
from postlake.operators.stats import n_rows, percent

_impossible = lambda: is_impossible(F.col("posted_date"), F.col("scraped_at"))


def _same_moment(a: str, b: str) -> Column:
    return F.coalesce(F.abs(seconds_between(F.col(a), F.col(b))) < 2, F.lit(False))


def date_overview(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        n_rows().alias("total"), F.count("posted_date").alias("dated"),
        F.count_if(F.col("posted_date").isNull()).alias("undated"),
    )


def corrupted_by_platform(jobs: DataFrame) -> DataFrame:
    gap = F.floor(seconds_between(F.col("posted_date"), F.col("scraped_at")) / 86400)
    return jobs.groupBy("source_platform").agg(
        F.count("posted_date").alias("dated"), F.count_if(_impossible()).alias("corrupted"),
        percent(F.count_if(_impossible()), F.count("posted_date")).alias("share_pct"),
        F.max(F.when(_impossible(), gap)).alias("worst_gap_days"),
    ).where(F.col("corrupted") > 0)


def backfill_fingerprint(jobs: DataFrame) -> DataFrame:
    eq = F.count_if(_same_moment("posted_date", "fetched_at"))
    dated = F.count("posted_date")
    return jobs.agg(
        dated.alias("dated"), eq.alias("equals_fetched"),
        F.count_if(_same_moment("posted_date", "scraped_at")).alias("equals_scraped"),
    ).withColumn("fabricated", F.col("equals_fetched") > F.greatest(F.lit(20.0), F.col("dated") * 0.05))


def busiest_hours(jobs: DataFrame, k: int = 3) -> DataFrame:
    hour = F.date_trunc("hour", "posted_date").cast("timestamp_ntz")
    return (
        jobs.where(F.col("posted_date").isNotNull()).groupBy(hour.alias("hour")).agg(n_rows().alias("n"))
        .orderBy(F.desc("n"), F.asc("hour")).limit(k)
    )


def verify_windows(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Rows every window admits and those among them that are older than it: the latter must be none."""
    w = with_freshness(jobs)
    hours = seconds_between(as_of, F.col("freshness_ts")) / 3600
    out = w.agg(*[
        F.struct(
            F.count_if(is_fresh(F.col("freshness_ts"), F.col("freshness_field"), F.lit(m), as_of)).alias("admitted"),
            F.count_if(
                is_fresh(F.col("freshness_ts"), F.col("freshness_field"), F.lit(m), as_of) & (hours > m / 60 + 0.05)
            ).alias("violations"),
        ).alias(name)
        for name, _, m in V.UI_WINDOWS
    ])
    rows = F.array(*[
        F.struct(F.lit(name).alias("window"), F.col(f"{name}.admitted").alias("admitted"), F.col(f"{name}.violations").alias("violations"))
        for name, _, _ in V.UI_WINDOWS
    ])
    return out.select(F.inline(rows))


def retention_purge(jobs: DataFrame, as_of: Column, days: int = V.RETENTION_DAYS) -> DataFrame:
    cut = as_of - F.expr(f"INTERVAL {days} DAYS")
    old = (F.col("posted_date") < cut) | (
        F.col("posted_date").isNull() & (F.col("fetched_at") < cut) & (F.col("scraped_at").isNull() | (F.col("scraped_at") < cut))
    )
    return jobs.where(~F.coalesce(old, F.lit(False)))


def purge_unusable_urls(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.coalesce(contains_any(F.col("apply_url"), V.PURGE_LINK_PARTS), F.lit(False)))


def repair_dates(jobs: DataFrame) -> DataFrame:
    """Impossible dates become unknown; so do dates a backfill fabricated, when its fingerprint is there."""
    mark = backfill_fingerprint(jobs).select("fabricated")  # one row
    wrong = _impossible() | (F.col("fabricated") & _same_moment("posted_date", "fetched_at"))
    return jobs.crossJoin(F.broadcast(mark)).withColumn("_wrong", wrong).withColumns(
        {
            "posted_date": F.when(~F.col("_wrong"), F.col("posted_date")),
            "posted_date_precision": F.when(F.col("_wrong"), F.lit("unknown")).otherwise(F.col("posted_date_precision")),
        }
    ).drop("fabricated", "_wrong")


def repair_to_first_seen(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("_wrong", _impossible()).withColumns(
        {
            "posted_date": F.when(F.col("_wrong"), F.col("scraped_at")).otherwise(F.col("posted_date")),
            "posted_date_precision": F.when(F.col("_wrong"), F.lit("day")).otherwise(F.col("posted_date_precision")),
        }
    ).drop("_wrong")


def backfill_precision(jobs: DataFrame) -> DataFrame:
    graded = precision_from_stored(F.col("posted_date"), F.col("source_platform"))
    return jobs.withColumn("posted_date_precision", F.coalesce("posted_date_precision", graded))


def backfill_normalization(jobs: DataFrame) -> DataFrame:
    place = city_country(F.coalesce("city", "country"), F.col("country"))["country"]
    iso = F.when(place.rlike("^[A-Za-z]{2}$"), F.upper(place))
    return jobs.withColumns(
        {
            "canonical_title": canonical_title(F.col("title")),
            "job_type": normalize_job_type(F.col("source_platform"), F.col("job_type"), F.col("title"), F.coalesce("description", F.lit(""))),
            "country": iso,
            "remote_flag": F.coalesce("remote_flag", F.lit(False)),
        }
    )


def fix_locations(jobs: DataFrame) -> DataFrame:
    """Re-derive city and country from the stored pair; ``changed`` marks the rows that differ."""
    text = F.concat_ws(", ", "city", "country")
    out = jobs.withColumn("_p", city_country(F.nullif(text, F.lit("")), F.col("country")))
    out = out.select("*", F.col("_p.city").alias("new_city"), F.col("_p.country").alias("new_country")).drop("_p")
    same = F.col("new_city").eqNullSafe(F.col("city")) & F.col("new_country").eqNullSafe(F.col("country"))
    return out.withColumn("changed", ~same)
