"""Registered queries: source readers and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.functions.dates import window_minutes
from postlake.functions.links import direct_url_for_portal
from postlake.functions.text import iso_text
from postlake.plans import bindings as B
from postlake.plans import payloads as P
from postlake.plans.registry import query
from postlake.sources import boards, dims, markup, postings

c = F.col


def _digest(df):
    """Long texts compared by digest."""
    return df.withColumn("description", F.md5(F.coalesce("description", F.lit(""))))


def _posting_query(name, reader, *args):
    @query(name)
    def _(spark, d):
        return _digest(reader(P.payload(spark, d, args[0]), B.as_of(), *args[1:]))


_posting_query("norm_adzuna", postings.adzuna, "adzuna", "us")
_posting_query("norm_jsearch", postings.jsearch, "jsearch", "us")
_posting_query("norm_greenhouse", postings.greenhouse, "greenhouse")
_posting_query("norm_lever", postings.lever, "lever")
_posting_query("norm_remotive", postings.remotive, "remotive", "us")
_posting_query("norm_google_jobs", postings.google_jobs, "google_jobs", "us")
_posting_query("norm_connector", postings.connector, "linkedin", "linkedin", "IN")


@query("norm_dispatch")
def _(spark, d):
    return _digest(postings.normalize_batch(P.landing(spark, d), P.DISPATCH, B.as_of(), "us"))


@query("src_usajobs")
def _(spark, d):
    return _digest(boards.usajobs(P.payload(spark, d, "usajobs")))


@query("src_careerbuilder")
def _(spark, d):
    return _digest(boards.careerbuilder(P.payload(spark, d, "careerbuilder")))


@query("src_ziprecruiter")
def _(spark, d):
    return _digest(boards.ziprecruiter(P.payload(spark, d, "ziprecruiter")))


@query("src_actor_items")
def _(spark, d):
    out = None
    for portal in boards.ACTOR_ALIASES:
        one = boards.actor_items(P.actor_payload(spark, d, portal), portal)
        out = one if out is None else out.unionByName(one)
    return _digest(out)


@query("src_extracted_json")
def _(spark, d):
    return _digest(boards.extracted_json(P.payload(spark, d, "extracted"), "glassdoor"))


@query("src_json_api")
def _(spark, d):
    a = boards.remoteok(P.payload(spark, d, "remoteok"))
    return _digest(a.unionByName(boards.remotive_api(P.payload(spark, d, "remotive_api"))))


@query("src_rss")
def _(spark, d):
    return _digest(markup.rss_items(P.payload(spark, d, "rss")))


@query("src_jsonld")
def _(spark, d):
    return markup.jsonld_postings(B.pages(spark, d))


@query("src_embedded_state")
def _(spark, d):
    return markup.embedded_state(B.pages(spark, d), "dice")


@query("src_page_links")
def _(spark, d):
    return markup.page_links(B.pages(spark, d))


@query("src_sitemap")
def _(spark, d):
    return markup.sitemap_jobs(P.payload(spark, d, "sitemap"))


@query("sitemap_probe")
def _(spark, d):
    return markup.sitemap_probe(P.payload(spark, d, "sitemap"))


@query("src_scoped_serp")
def _(spark, d):
    return _digest(boards.scoped_serp(P.payload(spark, d, "google_jobs")))


@query("direct_url_for_portal")
def _(spark, d):
    related = F.array(F.concat(F.lit(" https://www.linkedin.com/jobs/rel-"), c("id")))
    return B.jobs(spark, d).select(
        "id", direct_url_for_portal(c("source_platform"), P.google_options()["link"], related).alias("direct_url")
    )


@query("scan_jobs")
def _(spark, d):
    stamps = [iso_text(c(x)).alias(x) for x in ("posted_date", "fetched_at", "scraped_at")]
    return B.jobs(spark, d).select(
        "id", "title", "canonical_title", "company", "skills", "city", "country", "salary_min", "salary_max", "currency",
        "remote_flag", "job_type", "source_platform", "apply_url", "posted_date_precision", *stamps,
    )


@query("dim_portals")
def _(spark, d):
    """The portal dimension with the number of stored postings behind each row."""
    counts = B.jobs(spark, d).groupBy(c("source_platform").alias("portal")).agg(F.count(F.lit(1)).alias("n"))
    return dims.portals(spark).join(counts, "portal", "left").select(
        "portal", "portal_name", "portal_type", "category", "freshness_precision", "primary_method", "needs_api_key",
        F.size("tiers").cast("bigint").alias("tiers"), F.coalesce("n", F.lit(0)).alias("postings"),
    )


@query("portals_supporting")
def _(spark, d):
    """Postings per capability of the portal they came from."""
    p = dims.portals(spark)
    caps = ["supports_country", "supports_remote_filter", "supports_date_filtering", "supports_pagination", "supports_salary_filter"]
    counts = B.jobs(spark, d).groupBy(c("source_platform").alias("portal")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(p), "portal").agg(*[F.sum(F.when(c(x), c("n")).otherwise(0)).alias(x) for x in caps])


@query("ats_postings")
def _(spark, d):
    """Postings of the companies in the index, by tracking system."""
    j = B.jobs(spark, d).groupBy(F.lower("company").alias("company")).agg(F.count(F.lit(1)).alias("n"))
    return j.join(F.broadcast(dims.companies(spark)), "company").groupBy("ats", "company").agg(F.sum("n").alias("postings"))


@query("can_honor_window")
def _(spark, d):
    r = B.requests(spark, d).select("request_id", c("platform").alias("portal"), window_minutes(c("date_posted")).alias("minutes"))
    j = r.join(F.broadcast(dims.portals(spark)), "portal", "left")
    return j.select(
        "request_id", "minutes",
        dims.can_honor_window(c("freshness_precision"), c("supports_date_filtering"), c("minutes")).alias("honored"),
    )


@query("filter_portals")
def _(spark, d):
    """Postings of the portals whose name or category contains the text."""
    p = dims.portals(spark).where(dims.matches_text(c("portal_name"), c("category"), "Remote"))
    return B.jobs(spark, d).join(F.broadcast(p), c("source_platform") == c("portal")).select("id", "portal", "category")


@query("required_fields")
def _(spark, d):
    """Rows a source batch loses for a missing title or link, and rows that got the default company."""
    landed = P.payload(spark, d, "adzuna")
    kept = postings.adzuna(landed, B.as_of(), "us")
    return kept.agg(
        F.count(F.lit(1)).alias("kept"), F.count_if(c("company") == "Unknown Company").alias("default_company")
    )


@query("default_company")
def _(spark, d):
    """Company shown where the source names none."""
    rows = postings.connector(P.payload(spark, d, "dice"), B.as_of(), "dice", "US")
    return rows.where(c("company") == "Dice Employer").select("ord", "company")
