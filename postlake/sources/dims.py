"""Small fixed dimensions (portals, capabilities, companies) as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake import fixed_values as V


def portals(spark: SparkSession) -> DataFrame:
    rows = [
        (*p, i, V.PORTAL_TIERS[p[0]], *V.PORTAL_CAPABILITIES[p[0]], V.DAILY_QUOTAS[p[0]]) for i, p in enumerate(V.PORTALS)
    ]
    caps = ", ".join(
        f"{f} {'STRING' if f in ('freshness_precision', 'primary_method', 'needs_api_key') else 'BOOLEAN'}"
        for f in V.CAPABILITY_FIELDS
    )
    return spark.createDataFrame(
        rows, f"portal STRING, portal_name STRING, portal_type STRING, category STRING, pos INT, tiers ARRAY<INT>, {caps}, daily_quota INT"
    )


def companies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.ATS_COMPANIES, "company STRING, ats STRING")


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.UI_WINDOWS, "window STRING, label STRING, minutes INT")


def can_honor_window(precision: Column, supports_dates: Column, minutes: Column) -> Column:
    """Whether a portal's dates are fine enough for the window."""
    ok = F.when(precision == "exact", F.lit(True)).when(precision == "relative_text", minutes >= 60).otherwise(F.lit(False))
    return F.coalesce(supports_dates, F.lit(False)) & ok


def matches_text(name: Column, category: Column, text: str) -> Column:
    t = text.strip().lower()
    return F.lower(name).contains(t) | F.lower(category).contains(t)
