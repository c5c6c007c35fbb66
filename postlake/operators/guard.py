"""Exact filters, the ordered guard with its first failing reason, and request validation.

Two rules hold everywhere: a row that violates a set filter is never returned, and a missing
value is never a reason to reject.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.dates import add_minutes, age_hours, effective_freshness, freshness_reason, is_fresh, window_minutes_literal
from postlake.functions.expansion import Expansion, expand
from postlake.functions.jobs import canonical_job_type, canonical_job_type_literal
from postlake.functions.keys import filter_hash
from postlake.functions.links import valid_direct_url
from postlake.functions.relevance import body_text, match_tier, matches_term_groups, tier_hay
from postlake.functions.text import contains_any, strip, term_groups_literal


@dataclass(frozen=True)
class SearchRequest:
    title: str | None = "all"
    platform: str | None = "all"
    country: str | None = "all"
    remote_only: bool = False
    date_posted: str | None = "past_7d"
    job_type: str | None = "all"
    q: str | None = None
    mode: str = "hybrid"

    @property
    def window(self) -> int:
        return window_minutes_literal(self.date_posted)

    @property
    def expansion(self) -> Expansion:
        t = self.title or ""
        return expand("" if t.strip().lower() == "all" else t, self.mode)


def _off(value: str | None) -> bool:
    return not value or value.strip().lower() in ("", "all")


def platform_ok(r: SearchRequest) -> Column:
    if _off(r.platform):
        return F.lit(True)
    return F.col("source_platform") == F.lit(r.platform.strip().lower())


def remote_ok(r: SearchRequest) -> Column:
    """Only an explicit "not remote" is rejected."""
    return F.coalesce(F.col("remote_flag"), F.lit(True)) if r.remote_only else F.lit(True)


def country_ok(r: SearchRequest) -> Column:
    if _off(r.country):
        return F.lit(True)
    c = F.upper(F.trim(F.col("country")))
    return c.isNull() | (c == "") | (c == r.country.strip().upper()) | c.isin(V.GLOBAL_COUNTRY_VALUES)


def job_type_ok(r: SearchRequest) -> Column:
    """``onsite`` asks about the place of work, every other value about the contract."""
    want = canonical_job_type_literal(r.job_type)
    if want in (None, "all"):
        return F.lit(True)
    if want == "onsite_only":
        return ~F.coalesce(F.col("remote_flag"), F.lit(False))
    have = canonical_job_type(F.col("job_type"))
    return have.isNull() | (have == want)


def with_freshness(df: DataFrame) -> DataFrame:
    eff = effective_freshness(
        F.col("posted_date"), F.col("posted_date_precision"), F.col("scraped_at"), F.col("fetched_at"),
        F.col("source_platform"),
    )
    return df.withColumn("eff", eff).select(
        *df.columns,
        F.col("eff.ts").alias("freshness_ts"),
        F.col("eff.precision").alias("freshness_precision"),
        F.col("eff.field").alias("freshness_field"),
    )


def fresh_ok(r: SearchRequest, as_of: Column) -> Column:
    return is_fresh(F.col("freshness_ts"), F.col("freshness_field"), F.lit(r.window), as_of)


def body_column() -> Column:
    return body_text(F.col("company"), F.col("skills"), F.col("description"))


def title_expanded_ok(r: SearchRequest) -> Column:
    """Any expanded term inside a title, or any skill of the family inside the skills field."""
    exp = r.expansion
    if not exp.terms:
        return F.lit(True)
    lower = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    terms = [t.lower() for t in exp.terms]
    out = contains_any(lower("title"), terms) | contains_any(lower("canonical_title"), terms)
    return out | contains_any(lower("skills"), exp.skills) if exp.skills else out


def free_text_ok(r: SearchRequest) -> Column:
    if not (r.q or "").strip():
        return F.lit(True)
    fields = ["title", "canonical_title", "company", "skills", "description"]
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields])).contains(r.q.strip().lower())


def with_tier(df: DataFrame, r: SearchRequest, needed: Column | None = None) -> DataFrame:
    """Adds ``mt``, the match tier; where ``needed`` is false the text is not looked at."""
    hay = tier_hay(F.col("title"), F.col("canonical_title"))
    out = df.withColumns({"_hay": hay, "_text": body_column()})
    mt = match_tier(F.col("_hay"), F.col("_text"), r.expansion)
    return out.withColumn("mt", mt if needed is None else F.when(needed, mt)).drop("_hay", "_text")


def with_reason(df: DataFrame, r: SearchRequest, as_of: Column) -> DataFrame:
    """Adds ``reason``: the first failing check in order, NULL when the row passes.

    The text of a posting is only read for rows that passed every cheaper check.
    """
    out = with_freshness(df) if "freshness_ts" not in df.columns else df
    want = canonical_job_type_literal(r.job_type)
    type_code = "job_type_mismatch_remote_when_onsite_requested" if want == "onsite_only" else "job_type_mismatch"
    checks = [
        (valid_direct_url(F.col("source_platform"), F.col("apply_url")), "invalid_or_indirect_url"),
        (platform_ok(r), "platform_mismatch"),
        (remote_ok(r), "not_remote"),
        (country_ok(r), "country_mismatch"),
        (job_type_ok(r), type_code),
        (fresh_ok(r, as_of), "stale_date"),
    ]
    first = None
    for ok, code in checks:
        first = F.when(~ok, F.lit(code)) if first is None else first.when(~ok, F.lit(code))
    cols = out.columns
    out = out.withColumn("_failed", first)
    words = matches_term_groups(F.col("title"), F.col("canonical_title"), term_groups_literal(r.title))
    if r.expansion.widened:
        out = with_tier(out, r, needed=F.col("_failed").isNull())
        words = (F.col("mt.tier") != "none") | words
    reason = (
        F.when(F.col("_failed").isNotNull(), F.col("_failed"))
        .when(~words, F.lit("title_mismatch"))
        .when(~free_text_ok(r), F.lit("query_mismatch"))
    )
    return out.select(*cols, reason.alias("reason"))


def exact_filters(df: DataFrame, r: SearchRequest, as_of: Column) -> DataFrame:
    """The filters that reach the scan: portal (a table partition), place, remote flag and the date bound.

    Each is implied by the guard, so they change no result; the date bound lets the reader skip
    row groups that are too old as a whole.
    """
    dated = F.col("posted_date").isNull() | (F.col("posted_date") >= add_minutes(as_of, -r.window))
    return df.where(dated).where(platform_ok(r)).where(remote_ok(r)).where(country_ok(r)).where(job_type_ok(r))


def prefilter(df: DataFrame, r: SearchRequest, as_of: Column) -> DataFrame:
    """All exact filters as one conjunction over the stored postings."""
    return with_freshness(exact_filters(df, r, as_of)).where(fresh_ok(r, as_of)).where(title_expanded_ok(r)).where(free_text_ok(r))


def freshness_debug(df: DataFrame, window: int, as_of: Column) -> DataFrame:
    out = with_freshness(df)
    reason = freshness_reason(F.col("freshness_ts"), F.col("freshness_field"), F.lit(window), as_of)
    return out.withColumns(
        {
            "age_hours": F.round(age_hours(F.col("freshness_ts"), as_of), 1),
            "fresh_reason": reason,
            "passes": reason.startswith("ok"),
            "is_future": F.coalesce(F.col("freshness_ts") > as_of, F.lit(False)),
        }
    )


def locked_requests(requests: DataFrame) -> DataFrame:
    """Cleaned requests with their integrity hash; a bad job type is an error, a bad date falls back."""
    clean = lambda c: F.coalesce(F.nullif(strip(F.col(c)), F.lit("")), F.lit("all"))
    known_dates = list(V.DATE_WINDOWS) + V.DATE_WINDOW_ALL
    out = requests.select(
        "request_id",
        clean("title").alias("job_title"),
        F.lower(clean("platform")).alias("platform"),
        F.upper(clean("country")).alias("country"),
        F.coalesce(F.col("remote_only"), F.lit(False)).alias("remote_only"),
        F.when(F.lower(clean("date_posted")).isin(known_dates), F.lower(clean("date_posted")))
        .otherwise(F.lit("past_7d")).alias("date_posted"),
        F.lower(clean("job_type")).alias("job_type"),
        F.nullif(strip(F.col("q")), F.lit("")).alias("q"),
    )
    error = F.when(~F.col("job_type").isin(V.VALID_REQUEST_JOB_TYPES), F.lit("invalid_job_type"))
    parts = [F.col(c) for c in ("job_title", "platform", "country", "remote_only", "date_posted", "job_type", "q")]
    return out.withColumn("error", error).withColumn(
        "integrity_hash", F.when(F.col("error").isNull(), filter_hash(*parts))
    )
