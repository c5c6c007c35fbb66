"""Registered queries: reports, audits, repairs and health over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions import contacts, keys, links
from postlake.functions.dates import add_minutes
from postlake.operators import audit as A
from postlake.operators import guard as G
from postlake.operators import health as H
from postlake.operators import search as S
from postlake.operators import stats as T
from postlake.operators.guard import SearchRequest
from postlake.operators.ordered import top_per_group
from postlake.plans import bindings as B
from postlake.plans import payloads as P
from postlake.plans.registry import query
from postlake.plans.search_queries import FLAGSHIP
from postlake.sources import dims, markup

c = F.col


def _found(spark, d):
    """Postings the flagship search admits."""
    return G.with_reason(B.jobs(spark, d, text=True), FLAGSHIP, B.as_of()).where(c("reason").isNull())


@query("stats_overview")
def _(spark, d):
    return T.overview(B.jobs(spark, d))


@query("count_by_platform")
def _(spark, d):
    return T.by_platform(B.jobs(spark, d))


@query("top_companies")
def _(spark, d):
    return T.top_companies(B.jobs(spark, d))


@query("market_insights")
def _(spark, d):
    return T.market_insights(B.jobs(spark, d, text=True), "Engineer")


@query("rejection_histogram")
def _(spark, d):
    return T.rejection_histogram(G.with_reason(B.jobs(spark, d, text=True), FLAGSHIP, B.as_of()))


@query("empty_state")
def _(spark, d):
    r = SearchRequest(title="astronaut", mode="exact", date_posted="past_30d")
    return T.empty_state(G.with_reason(B.jobs(spark, d, text=True), r, B.as_of()))


@query("portal_coverage")
def _(spark, d):
    return T.portal_coverage(dims.portals(spark), _found(spark, d)).select("portal", "n", "contributes")


@query("portal_coverage_summary")
def _(spark, d):
    return T.coverage_summary(T.portal_coverage(dims.portals(spark), _found(spark, d)))


@query("silent_portals")
def _(spark, d):
    """Portals that contributed nothing to a strict search."""
    r = SearchRequest(title="nurse practitioner", mode="exact", country="de", date_posted="past_24h")
    rows = G.with_reason(B.jobs(spark, d, text=True), r, B.as_of()).where(c("reason").isNull())
    return dims.portals(spark).select("portal").join(
        rows.select(c("source_platform").alias("portal")).distinct(), "portal", "left_anti"
    )


@query("stage_funnel")
def _(spark, d):
    r = SearchRequest(country="US", date_posted="past_24h")
    j = G.with_reason(B.jobs(spark, d, text=True), r, B.as_of())
    direct = links.valid_direct_url(c("source_platform"), c("apply_url"))
    known = F.coalesce("posted_date", "fetched_at", "scraped_at", B.as_of())
    return T.stage_funnel(
        j, links.usable_apply_url(c("apply_url")) & (F.trim("title") != ""), direct,
        known >= add_minutes(B.as_of(), -1440), c("reason").isNull(),
    )


@query("quality_audit")
def _(spark, d):
    return T.quality_audit(B.jobs(spark, d))


@query("date_overview")
def _(spark, d):
    return A.date_overview(B.jobs(spark, d))


@query("corrupted_by_platform")
def _(spark, d):
    return A.corrupted_by_platform(B.jobs(spark, d))


@query("backfill_fingerprint")
def _(spark, d):
    return A.backfill_fingerprint(B.jobs(spark, d))


@query("busiest_hours")
def _(spark, d):
    return A.busiest_hours(B.jobs(spark, d))


@query("verify_windows")
def _(spark, d):
    return A.verify_windows(B.jobs(spark, d), B.as_of())


@query("enrichment_report")
def _(spark, d):
    return T.enrichment_report(contacts.with_contacts(B.jobs(spark, d, text=True).select("description", "company")))


@query("batch_enrich")
def _(spark, d):
    return contacts.with_contacts(B.jobs(spark, d, text=True).select("id", "description", "company")).drop("description", "company")


@query("corroboration")
def _(spark, d):
    rows = B.jobs(spark, d).withColumn("tier", F.concat(F.lit("Tier "), (F.floor(c("ord") / 10) % 4 + 1).cast("string")))
    return T.corroboration(rows, keys.tier_key(c("title"), c("company"), c("source_platform")))


@query("distinct_platforms")
def _(spark, d):
    return B.jobs(spark, d).select("source_platform").distinct()


@query("page_verdict")
def _(spark, d):
    return _verdicts(spark, d)


def _verdicts(spark, d):
    p = B.pages(spark, d)
    blocks = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    count = F.aggregate(
        blocks, F.lit(0), lambda n, b: n + F.regexp_count(b, F.lit(r'"@type"\s*:\s*(?:\[[^\]]*)?"JobPosting"'))
    )
    dated = markup.dated_hosts(P.host_sitemaps(p)).withColumn("has_lastmod", F.lit(True))
    p = p.select(
        "page_id", "status", links.detect_block_vendor(c("status"), c("headers"), c("html")).alias("vendor"),
        count.alias("jsonld"), links.count_job_links(c("html")).alias("cards"), links.visible_words(c("html")).alias("words"),
        markup.page_host(c("url")).alias("host"),
    ).join(dated, "host", "left")
    verdict = (
        F.when(c("vendor") == "LOCAL_PROXY_DENY", F.lit("INVALID"))
        .when(c("vendor").isNotNull(), F.lit("BLOCKED"))
        .when(c("status") != 200, F.lit("UNREACHABLE"))
        .when(c("jsonld") > 0, F.lit("FREE_JSONLD"))
        .when(c("cards") >= V.STATIC_CARD_MINIMUM, F.lit("FREE_STATIC"))
        .when(c("has_lastmod"), F.lit("FREE_SITEMAP"))
        .when((c("cards") == 0) & (c("words") < V.JS_SHELL_WORDS), F.lit("JS_ONLY"))
        .otherwise(F.lit("INCONCLUSIVE"))
    )
    return p.select("page_id", c("jsonld").cast("bigint").alias("jsonld"), c("cards").cast("bigint").alias("cards"), verdict.alias("verdict"))


@query("source_probe_summary")
def _(spark, d):
    v = _verdicts(spark, d)
    free = F.count_if(c("verdict").startswith("FREE"))
    return v.agg(
        T.n_rows().alias("pages"), free.alias("free"), F.count_if(c("verdict") == "JS_ONLY").alias("js_only"),
        F.count_if(c("verdict") == "BLOCKED").alias("blocked"), T.percent(free, T.n_rows()).alias("paid_call_reduction_pct"),
    )


# --- windows over runs and postings ----------------------------------------------------------------


@query("latest_run_per_portal")
def _(spark, d):
    return H.latest_runs(B.runs(spark, d)).drop("method")


@query("latest_n_per_platform")
def _(spark, d):
    order = [c("fetched_at").desc_nulls_last(), F.asc("ord")]
    return top_per_group(B.jobs(spark, d).select("ord", "id", "source_platform", "fetched_at"), ["source_platform"], order, 20).drop("ord")


@query("method_health")
def _(spark, d):
    return H.method_health(B.runs(spark, d))


@query("method_routing")
def _(spark, d):
    return H.method_routing(spark, H.method_health(B.runs(spark, d)))


@query("portal_status")
def _(spark, d):
    return H.portal_status(dims.portals(spark), B.runs(spark, d), B.jobs(spark, d), B.as_of())


@query("portal_diagnostics")
def _(spark, d):
    return H.portal_diagnostics(dims.portals(spark), B.runs(spark, d), B.jobs(spark, d))


@query("portal_diagnostics_credentials")
def _(spark, d):
    """The same with only one credential at hand."""
    held = ["actor_runs"]
    rows = H.portal_diagnostics(dims.portals(spark), B.runs(spark, d), B.jobs(spark, d), held)
    return rows.withColumn("missing_credentials", H.missing_credentials(c("portal"), held))


def _layers(spark, d):
    down = ["hired", "careerbuilder"]
    live = B.jobs(spark, d).where((c("ord") % 4 != 0) & ~c("source_platform").isin(down)).withColumn(
        "layer", F.when(c("source_platform") == "dice", F.lit(2)).otherwise((c("ord") % 3 + 1).cast("int"))
    )
    return live, B.stored_jobs(spark, d)


@query("first_nonempty_source")
def _(spark, d):
    live, cache = _layers(spark, d)
    rows = T.first_nonempty_source(live, cache, dims.portals(spark))
    return rows.select("id", "source_platform", "layer")


@query("fallback_alerts")
def _(spark, d):
    live, cache = _layers(spark, d)
    rows = T.first_nonempty_source(live, cache, dims.portals(spark))
    return T.fallback_alerts(rows, H.latest_runs(B.runs(spark, d)), B.as_of())


@query("tier_cache_fallback")
def _(spark, d):
    live, cache = _layers(spark, d)
    return T.cache_fallback(live.drop("layer"), cache, dims.portals(spark)).select("id", "source_platform", "stale")


def _ladder(spark, d, query="nurse practitioner"):
    rows = S.scored(B.jobs(spark, d, text=True), query).withColumn("tier", (F.floor(c("ord") / 10) % 4).cast("int"))
    return T.escalation_ladder(rows, query)


@query("escalation_ladder")
def _(spark, d):
    return _ladder(spark, d)


@query("escalation_ladder_no_query")
def _(spark, d):
    return _ladder(spark, d, "")


@query("ladder_stats")
def _(spark, d):
    return T.ladder_stats(_ladder(spark, d))


# --- repairs ---------------------------------------------------------------------------------------

_DATES = ["id", "posted_date", "posted_date_precision"]


@query("retention_purge")
def _(spark, d):
    return A.retention_purge(B.jobs(spark, d), B.as_of()).select("id", "posted_date", "fetched_at", "scraped_at")


@query("purge_unusable_urls")
def _(spark, d):
    return A.purge_unusable_urls(B.jobs(spark, d)).select("id", "apply_url")


@query("repair_dates")
def _(spark, d):
    return A.repair_dates(B.jobs(spark, d)).select(*_DATES)


@query("repair_to_first_seen")
def _(spark, d):
    return A.repair_to_first_seen(B.jobs(spark, d)).select(*_DATES)


@query("backfill_precision")
def _(spark, d):
    return A.backfill_precision(B.jobs(spark, d)).select(*_DATES)


@query("backfill_normalization")
def _(spark, d):
    return A.backfill_normalization(B.jobs(spark, d, text=True)).select("id", "canonical_title", "job_type", "country", "remote_flag")


@query("fix_locations")
def _(spark, d):
    return A.fix_locations(B.jobs(spark, d)).select("id", "city", "country", "new_city", "new_country", "changed")
