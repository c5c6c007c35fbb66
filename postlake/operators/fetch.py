"""Fetch requests: how a search is scoped at each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.dates import cache_policy, date_bucket, window_minutes


def _fill(template: str, parts: dict[str, Column]) -> Column:
    """A URL template as a concatenation of literals and columns."""
    out: list[Column] = []
    rest = template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        out += [F.lit(head), parts[name]]
    out.append(F.lit(rest))
    return F.concat(*out)


def fetch_requests(requests: DataFrame) -> DataFrame:
    """One row per request and asked portal, with the portal's own recency parameters and search URL."""
    everything = F.array(*[F.lit(p) for p in V.PORTAL_IDS])
    asked = F.lower(F.trim(F.coalesce(F.col("platform"), F.lit("all"))))
    rows = requests.select(
        "request_id",
        F.when(F.lower("title") == "all", F.lit("developer")).otherwise(F.col("title")).alias("keyword"),
        cache_policy(date_bucket(window_minutes(F.col("date_posted"))))["recency_hours"].alias("hours"),
        F.explode(F.when(asked.isin("all", ""), everything).otherwise(F.array(asked))).alias("portal"),
    )
    h = F.col("hours")
    days = F.greatest(F.lit(1), F.round(h / 24).cast("int"))
    parts = {
        "kw": F.url_encode("keyword"),
        "loc": F.lit(""),
        "fromage": days.cast("string"),
        "tpr": F.concat(F.lit("r"), (h * 3600).cast("string")),
        "dice_age": F.when(days <= 1, F.lit("ONE")).when(days <= 7, F.lit("SEVEN")).otherwise(F.lit("THIRTY")),
    }
    url = None
    for portal, template in V.SEARCH_URLS.items():
        hit = F.col("portal") == portal
        url = F.when(hit, _fill(template, parts)) if url is None else url.when(hit, _fill(template, parts))
    chip = (
        F.when(h <= 24, F.lit("date_posted:today")).when(h <= 72, F.lit("date_posted:3days"))
        .when(h <= 168, F.lit("date_posted:week")).otherwise(F.lit("date_posted:month"))
    )
    return rows.select(
        "request_id", "portal", "hours", chip.alias("chip"), days.alias("from_days"), parts["tpr"].alias("f_tpr"),
        parts["dice_age"].alias("dice_age"), url.alias("search_url"),
    )
