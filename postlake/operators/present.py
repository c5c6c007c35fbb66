"""Fields shown on a result card and constant provenance tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import fixed_values as V


def _age_label(t: Column, as_of: Column) -> Column:
    minutes = F.floor(F.timestamp_diff("MICROSECOND", t, as_of) / 60_000_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    one = lambda n, unit: F.concat(
        F.lit("Posted "), n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago")
    )
    return (
        F.when(t.isNull() | (t > as_of), F.lit("Posting date unknown"))
        .when(minutes < 1, F.lit("Posted just now"))
        .when(minutes < 60, one(minutes, "minute"))
        .when(hours < 24, one(hours, "hour"))
        .when(days < 30, one(days, "day"))
        .otherwise(F.concat(F.lit("Posted on "), F.date_format(t, "M/d/yyyy")))
    )


def display_columns(as_of: Column) -> dict[str, Column]:
    """Salary, posting age, discovery age and place labels; discovery is never shown as posting."""
    lo, hi = F.nullif(F.col("salary_min"), F.lit(0.0)), F.nullif(F.col("salary_max"), F.lit(0.0))
    cur = F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit("$"))
    money = lambda x: F.concat(cur, F.format_number(F.round(x), 0))
    found = F.coalesce(F.col("scraped_at"), F.col("fetched_at"))
    return {
        "salary_label": F.when(lo.isNotNull() & hi.isNotNull(), F.concat(money(lo), F.lit(" - "), money(hi)))
        .when(lo.isNotNull(), F.concat(F.lit("From "), money(lo)))
        .when(hi.isNotNull(), F.concat(F.lit("Up to "), money(hi))),
        "posted_label": F.when(F.col("posted_date").isNull(), F.lit("Posting date not published")).otherwise(
            _age_label(F.col("posted_date"), as_of)
        ),
        "found_label": F.when(
            F.col("posted_date").isNull() & found.isNotNull(),
            F.regexp_replace(_age_label(found, as_of), "^Posted ", "we found it "),
        ),
        "place_label": F.coalesce(
            F.when(F.col("city").isNotNull(), F.concat_ws(", ", "city", "country")), F.col("country"),
            F.lit("Location Unspecified"),
        ),
    }


def provenance(df: DataFrame, teaser_only: tuple[str, ...] = ()) -> DataFrame:
    """Constant tags of a posting's source; ``teaser_only`` names the portals that are set up to show teasers only."""
    p = F.col("source_platform")
    return df.withColumns(
        {
            "data_completeness": F.when(p.isin(*teaser_only), F.lit("teaser_only")).when(p == "hired", F.lit("limited")),
            "low_yield": p == "hired",
            "source_note": F.when(p.isin(V.AGGREGATED_ONLY_PORTALS), F.lit(V.AGGREGATED_NOTE)),
            "country_code": F.when(p == "usajobs", F.lit("US")),
            "eligibility_note": F.when(p == "usajobs", F.lit(V.US_ELIGIBILITY_NOTE)),
        }
    )
