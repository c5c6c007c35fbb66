"""Registered queries: filters, guard, ranking and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.functions.links import usable_apply_url, valid_direct_url
from postlake.functions.relevance import matches_term_groups
from postlake.functions.text import term_groups_literal
from postlake.operators import guard as G
from postlake.operators import search as S
from postlake.operators.guard import SearchRequest
from postlake.operators.ordered import ranked
from postlake.plans import bindings as B
from postlake.plans.registry import query

FLAGSHIP = SearchRequest(title="cloud engineer", date_posted="past_7d", mode="hybrid")
STRICT = SearchRequest(
    title="data scientist, python", platform="all", country="us", remote_only=True, date_posted="past_30d",
    job_type="fulltime", q="docker",
)


@query("filter_platform")
def _(spark, d):
    r = SearchRequest(platform="Dice")
    return B.jobs(spark, d).where(G.platform_ok(r)).select("id", "source_platform")


@query("filter_remote")
def _(spark, d):
    return B.jobs(spark, d).where(G.remote_ok(SearchRequest(remote_only=True))).select("id", "remote_flag")


@query("filter_country")
def _(spark, d):
    return B.jobs(spark, d).where(G.country_ok(SearchRequest(country="us"))).select("id", "country")


@query("filter_job_type")
def _(spark, d):
    return B.jobs(spark, d).where(G.job_type_ok(SearchRequest(job_type="fulltime"))).select("id", "job_type")


@query("filter_onsite")
def _(spark, d):
    return B.jobs(spark, d).where(G.job_type_ok(SearchRequest(job_type="onsite"))).select("id", "remote_flag")


@query("filter_fresh")
def _(spark, d):
    r = SearchRequest(date_posted="past_7d")
    return G.with_freshness(B.jobs(spark, d)).where(G.fresh_ok(r, B.as_of())).select("id", "freshness_ts", "freshness_field")


@query("filter_title_expanded")
def _(spark, d):
    return B.jobs(spark, d).where(G.title_expanded_ok(FLAGSHIP)).select("id", "title", "skills")


@query("filter_freetext")
def _(spark, d):
    return B.jobs(spark, d, text=True).where(G.free_text_ok(SearchRequest(q="Docker"))).select("id", "title")


@query("match_term_groups")
def _(spark, d):
    groups = term_groups_literal("senior python developer, data scientist, lead")
    hit = matches_term_groups(F.col("title"), F.col("canonical_title"), groups)
    return B.jobs(spark, d).select("id", hit.alias("matches"))


@query("valid_direct_url")
def _(spark, d):
    return B.jobs(spark, d).select("id", valid_direct_url(F.col("source_platform"), F.col("apply_url")).alias("is_direct"))


@query("usable_apply_url")
def _(spark, d):
    return B.jobs(spark, d).select("id", usable_apply_url(F.col("apply_url")).alias("is_usable"))


@query("search_prefilter")
def _(spark, d):
    r = SearchRequest(title="cloud engineer", country="us", job_type="contract", date_posted="past_30d", q="aws")
    return (
        G.prefilter(B.jobs(spark, d, text=True), r, B.as_of())
        .orderBy(*S.recent_order())
        .select("id", "title", "posted_date", "fetched_at")
    )


@query("guard_with_reason")
def _(spark, d):
    return G.with_reason(B.jobs(spark, d, text=True), FLAGSHIP, B.as_of()).select("id", "reason")


@query("guard_strict")
def _(spark, d):
    return G.with_reason(B.jobs(spark, d, text=True), STRICT, B.as_of()).select("id", "reason")


@query("final_sweep")
def _(spark, d):
    """Stale rows among those the guard admitted: always empty."""
    passed = G.with_reason(B.jobs(spark, d, text=True), FLAGSHIP, B.as_of()).where(F.col("reason").isNull())
    return passed.where(~G.fresh_ok(FLAGSHIP, B.as_of())).select("id", "title", "freshness_field")


@query("search_structured")
def _(spark, d):
    return S.structured_search(
        B.jobs(spark, d, text=True), query="engineer", remote_only=True, country="india", min_salary=20000, limit=100
    ).select("id", "title", "company", "city", "country", "salary_min", "salary_max", "fetched_at")


@query("lookup_by_id")
def _(spark, d):
    return B.jobs(spark, d).where(F.col("id") == "777").select("id", "title", "company", "apply_url", "posted_date")


@query("validate_requests")
def _(spark, d):
    return G.locked_requests(B.requests(spark, d))


@query("debug_freshness")
def _(spark, d):
    return G.freshness_debug(B.jobs(spark, d), 1440, B.as_of()).select(
        "id", "posted_date", "scraped_at", "fetched_at", "freshness_field", "freshness_precision", "age_hours",
        "passes", "fresh_reason", "is_future",
    )


@query("debug_freshness_summary")
def _(spark, d):
    return (
        G.freshness_debug(B.jobs(spark, d), 1440, B.as_of())
        .groupBy("freshness_field", "freshness_precision")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("passes")).alias("n_pass"),
            F.count_if(F.col("is_future")).alias("n_future"),
        )
    )


@query("order_recent")
def _(spark, d):
    return ranked(B.jobs(spark, d).select("id", "ord", "posted_date", "fetched_at"), S.recent_order()).drop("ord")


@query("relevance_score")
def _(spark, d):
    return S.scored(B.jobs(spark, d, text=True), "cloud engineer, senior python developer").select(
        "id", "relevance_score", "relevance_reason", "is_exact"
    )


@query("match_tier")
def _(spark, d):
    return S.tiered(B.jobs(spark, d, text=True), FLAGSHIP).select("id", "match_tier", "matched_term")


@query("rank_relevance")
def _(spark, d):
    shown = ["id", "title", "relevance_score", "relevance_reason", "is_exact"]
    rows = S.scored(B.jobs(spark, d, text=True), "python developer").select(*shown, *S.ORDER_COLUMNS)
    return ranked(rows, S.relevance_order()).select("rank", *shown)


@query("rank_tiered")
def _(spark, d):
    shown = ["id", "title", "match_tier", "relevance_score"]
    rows = S.tiered(S.scored(B.jobs(spark, d, text=True), "cloud engineer"), FLAGSHIP).select(*shown, *S.ORDER_COLUMNS)
    return ranked(rows, S.tier_order()).select("rank", *shown)


@query("page")
def _(spark, d):
    return B.jobs(spark, d).orderBy(*S.recent_order()).offset(40).limit(20).select("id", "posted_date")


@query("page_info")
def _(spark, d):
    return S.page_info(B.jobs(spark, d).where(G.country_ok(SearchRequest(country="in"))), 20, 40)


@query("search")
def _(spark, d):
    return S.search_page(B.jobs(spark, d, text=True), FLAGSHIP, B.as_of()).select(
        "id", "title", "company", "source_platform", "posted_date", "freshness_field", "match_tier", "matched_term",
        "relevance_score", "relevance_reason", "is_exact",
    )


@query("match_yield")
def _(spark, d):
    return S.match_yield(S.search_rows(B.jobs(spark, d, text=True), FLAGSHIP, B.as_of()))


@query("results_by_tier")
def _(spark, d):
    rows = S.search_rows(B.jobs(spark, d, text=True), FLAGSHIP, B.as_of())
    return rows.agg(*[F.count_if(F.col("match_tier") == t).alias(t) for t in ("core", "strong", "related")])
