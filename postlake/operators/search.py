"""Ranked search: relevance, tiers, ordering, paging and the counts shown next to a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.relevance import reason_of_rank, relevance_rank, score_of_rank, title_of
from postlake.operators.guard import SearchRequest, body_column, exact_filters, with_reason, with_tier


def scored(df: DataFrame, query: str | None, compat: bool = False) -> DataFrame:
    """Adds the relevance columns; helper columns are projected first so each is worked out once per row."""
    title = title_of(F.col("title"), F.col("canonical_title"))
    return (
        df.withColumns({"_title": title, "_body": body_column()})
        .withColumn("_rank", relevance_rank(F.col("_title"), F.col("_body"), query, compat))
        .select(
            *df.columns,
            score_of_rank(F.col("_rank")).alias("relevance_score"),
            reason_of_rank(F.col("_rank"), query).alias("relevance_reason"),
            (score_of_rank(F.col("_rank")) >= V.EXACT_MATCH_SCORE).alias("is_exact"),
        )
    )


def tiered(df: DataFrame, r: SearchRequest) -> DataFrame:
    return with_tier(df, r).select(
        *df.columns, F.col("mt.tier").alias("match_tier"), F.col("mt.term").alias("matched_term")
    )


#: What the orders below read besides the relevance columns.
ORDER_COLUMNS = ["posted_date", "scraped_at", "fetched_at", "ord"]


def recency() -> Column:
    return F.coalesce(F.col("posted_date"), F.col("scraped_at"), F.col("fetched_at"))


def tier_rank() -> Column:
    out = None
    for name, rank in V.TIER_RANK.items():
        hit = F.col("match_tier") == name
        out = F.when(hit, F.lit(rank)) if out is None else out.when(hit, F.lit(rank))
    return out.otherwise(F.lit(3))


def relevance_order() -> list[Column]:
    return [F.desc("relevance_score"), recency().desc_nulls_last(), F.asc("ord")]


def tier_order() -> list[Column]:
    return [tier_rank().asc(), *relevance_order()]


def recent_order() -> list[Column]:
    return [F.col("posted_date").desc_nulls_last(), F.col("fetched_at").desc_nulls_last(), F.asc("ord")]


def search_rows(jobs: DataFrame, r: SearchRequest, as_of: Column) -> DataFrame:
    """Rows that pass the guard, scored and tiered, not yet ordered."""
    passed = with_reason(exact_filters(jobs, r, as_of), r, as_of).where(F.col("reason").isNull()).drop("reason")
    query = ", ".join(r.expansion.core)
    return tiered(scored(passed, query), r)


def search_page(jobs: DataFrame, r: SearchRequest, as_of: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page; sort and limit become a distributed top-k, never a full sort on one node."""
    limit = max(1, min(limit, 200))
    return search_rows(jobs, r, as_of).orderBy(*tier_order()).offset(offset).limit(limit)


def match_yield(scored_rows: DataFrame) -> DataFrame:
    exact = F.count_if(F.col("is_exact"))
    n = F.count(F.lit(1))
    percent = F.round(F.col("relevance_score") * 100).cast("bigint")  # whole numbers add up exactly in any order
    return scored_rows.agg(
        n.alias("total"),
        exact.alias("exact_matches"),
        F.coalesce(F.round(exact / n, 3), F.lit(0.0)).alias("match_yield"),
        F.coalesce(F.round(F.sum(percent) / n, 1) / 100, F.lit(0.0)).alias("avg_score"),
    )


def page_info(df: DataFrame, limit: int, offset: int) -> DataFrame:
    limit = max(1, min(limit, 200))
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(limit).cast("bigint").alias("page_size"),
        F.lit(offset // limit + 1).cast("bigint").alias("page_number"),
        F.ceil(F.col("total") / limit).cast("bigint").alias("page_count"),
    )


def structured_search(
    jobs: DataFrame, query: str | None = None, remote_only: bool = False, country: str | None = None,
    min_salary: float | None = None, max_salary: float | None = None, platform: str | None = None, limit: int = 20,
) -> DataFrame:
    """Substring search with salary bounds; newest fetched first."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    out = jobs
    if query:
        term = query.strip().lower()
        hit = F.lit(False)
        for c in ("title", "company", "city", "description"):
            hit = hit | low(c).contains(term)
        out = out.where(hit)
    if remote_only:
        out = out.where(F.col("remote_flag"))
    if country:
        code = country.strip().upper()
        if code in ("IN", "INDIA"):
            out = out.where((F.col("country") == "IN") | low("country").contains("india") | low("city").contains("india"))
        else:
            out = out.where((F.col("country") == code) | low("country").contains(code.lower()))
    if min_salary is not None:
        out = out.where((F.col("salary_min") >= min_salary) | (F.col("salary_max") >= min_salary))
    if max_salary is not None:
        out = out.where((F.col("salary_max") <= max_salary) | (F.col("salary_min") <= max_salary))
    if platform and platform.lower() != "all":
        out = out.where(F.col("source_platform") == platform.lower())
    return out.orderBy(F.col("fetched_at").desc_nulls_last(), F.asc("ord")).limit(limit)
