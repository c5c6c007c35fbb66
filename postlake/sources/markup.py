"""Feeds, structured data and links inside fetched XML and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.text import blank_to_null, capitalize, company_from_title, first_filled, strip, strip_html

_ITEM = "title STRING, link STRING, description STRING, pubDate STRING, updated STRING"


def rss_items(feeds: DataFrame) -> DataFrame:
    """Feed items; the company is split off the title."""
    schema = f"channel STRUCT<item: ARRAY<STRUCT<{_ITEM.replace(' STRING', ': STRING')}>>>"
    items = feeds.select("ord", F.explode(F.from_xml("raw", schema)["channel"]["item"]).alias("i"))
    title, company = company_from_title(F.col("t"), "Remote Partner")
    return (
        items.select("ord", strip(F.col("i.title")).alias("t"), "i")
        .where(F.col("t").isNotNull() & (F.col("t") != ""))
        .select(
            "ord", title.alias("title"), company.alias("company"), strip(F.col("i.link")).alias("url"),
            F.coalesce("i.pubDate", "i.updated").alias("posted_text"), F.col("i.description").alias("description"),
        )
    )


_LD = (
    "`@type` STRING, title STRING, name STRING, hiringOrganization STRING, jobLocation STRING, url STRING, "
    "datePosted STRING, description STRING, employmentType STRING"
)


def jsonld_postings(pages: DataFrame) -> DataFrame:
    """Postings in ``application/ld+json`` blocks: a list, a ``@graph`` or a single object."""
    block = r"(?is)<script[^>]*type=\"application/ld\+json\"[^>]*>(.*?)</script>"
    node = "STRUCT<" + _LD.replace(" STRING", ": STRING") + ">"
    top = f"ARRAY<STRUCT<{_LD.replace(' STRING', ': STRING')}, `@graph`: ARRAY<{node}>>>"
    objects = (
        pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(block), F.lit(1))).alias("block", "js"))
        .select("page_id", "url", "block", F.posexplode(F.from_json("js", top)).alias("pos", "o"))
        .select(
            "page_id", "url", "block", "pos",
            F.posexplode(
                F.coalesce(F.col("o.`@graph`"), F.array(F.col("o").dropFields("`@graph`")))
            ).alias("node", "n"),
        )
    )
    address = F.get_json_object("n.jobLocation", "$.address")
    place = F.coalesce(
        blank_to_null(F.get_json_object("n.jobLocation", "$.address.addressLocality")),
        blank_to_null(F.get_json_object("n.jobLocation", "$.address.addressRegion")),
        blank_to_null(F.get_json_object("n.jobLocation", "$.address.addressCountry")),
        F.when(~address.startswith("{"), blank_to_null(address)),
        F.when(F.col("n.jobLocation").startswith("["), F.array_join(F.from_json("n.jobLocation", "ARRAY<STRING>"), ", ")),
        F.lit("Remote"),
    )
    company = F.coalesce(
        blank_to_null(F.get_json_object("n.hiringOrganization", "$.name")),
        F.when(~F.col("n.hiringOrganization").startswith("{"), blank_to_null(F.col("n.hiringOrganization"))),
    )
    rows = objects.where(F.lower("n.`@type`").contains("jobposting")).select(
        "page_id", "block", "pos", "node",
        first_filled(F.col("n.title"), F.col("n.name")).alias("title"),
        company.alias("company"),
        strip(F.coalesce(F.nullif("n.url", F.lit("")), "url")).alias("job_url"),
        place.alias("location"),
        F.col("n.datePosted").alias("posted_text"),
        F.coalesce(strip(F.col("n.description")), F.lit("")).alias("description"),
        F.coalesce(blank_to_null(F.col("n.employmentType")), F.lit("full_time")).alias("contract_type"),
    )
    return rows.where(F.col("title").isNotNull() & F.col("company").isNotNull())


def embedded_state(pages: DataFrame, portal: str) -> DataFrame:
    """Postings in the page's embedded application state."""
    state = r"(?is)<script[^>]*id=\"__NEXT_DATA__\"[^>]*>(.*?)</script>"
    props = F.from_json(
        F.regexp_extract("html", state, 1),
        "props STRUCT<pageProps: STRUCT<jobs: ARRAY<STRING>, initialJobs: ARRAY<STRING>, listings: ARRAY<STRING>>>",
    )["props"]["pageProps"]
    some = lambda k: F.when(F.size(props[k]) > 0, props[k])
    items = pages.select(
        "page_id", "url", F.posexplode(F.coalesce(some("jobs"), some("initialJobs"), some("listings"))).alias("pos", "js")
    ).select(
        "*",
        F.from_json(
            "js",
            "title STRING, role STRING, name STRING, companyName STRING, company STRING, url STRING, link STRING, "
            "description STRING, summary STRING",
        ).alias("i"),
    )
    return items.select(
        "page_id", "pos",
        F.coalesce(first_filled(F.col("i.title"), F.col("i.role"), F.col("i.name")), F.lit("")).alias("title"),
        F.coalesce(
            blank_to_null(F.col("i.companyName")), blank_to_null(F.get_json_object("i.company", "$.name")),
            F.when(~F.col("i.company").startswith("{"), F.col("i.company")), F.lit(""),
        ).alias("company"),
        F.lower("js").contains("remote").alias("remote"),
        F.lit("contract" if portal in ("braintrust", "upwork", "fiverr") else "full_time").alias("job_type"),
        F.coalesce(first_filled(F.col("i.url"), F.col("i.link")), F.col("url")).alias("apply_url"),
        F.coalesce(first_filled(F.col("i.description"), F.col("i.summary")), F.lit("")).alias("description"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Anchors that look like single postings, as absolute links with their text; all of them, each link once per page."""
    anchor = r'(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>'
    anchors = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(anchor), F.lit(0))).alias("pos", "a"))
    href = F.regexp_extract("a", r'(?i)href="([^"]*)"', 1)
    job = F.lit(False)
    for p in V.JOB_LINK_PATTERNS:
        job = job | F.regexp_extract("a", r"(?is)^<a\b[^>]*>", 0).rlike("(?i)" + p)
    origin = F.concat(F.lit("https://"), F.parse_url("url", F.lit("HOST")))
    absolute = (
        F.when(F.col("href").startswith("http"), F.col("href"))
        .when(F.col("href").startswith("/"), F.concat(origin, "href"))
        .otherwise(F.concat(origin, F.lit("/"), "href"))
    )
    rows = (
        anchors.where(job)
        .select("page_id", "pos", "url", href.alias("href"), strip_html(F.col("a")).alias("title"))
        .where(F.length("title") >= 3)
        .select("page_id", "pos", absolute.alias("link"), "title")
    )
    return rows.groupBy("page_id", "link").agg(F.min_by("title", "pos").alias("title"))


def sitemap_jobs(maps: DataFrame) -> DataFrame:
    """Job locations of a sitemap with a title read off the last path segment."""
    locs = maps.select("ord", F.explode(F.regexp_extract_all("raw", F.lit("<loc>(.*?)</loc>"), F.lit(1))).alias("loc"))
    last = F.substring_index("loc", "/", -1)
    return locs.where(F.col("loc").contains("job") | F.col("loc").contains("role")).select(
        "ord", "loc", capitalize(F.regexp_replace(last, "-", " ")).alias("title")
    )


def sitemap_probe(maps: DataFrame, key: str = "ord") -> DataFrame:
    n = lambda tag: F.regexp_count("raw", F.lit(f"(?i)<{tag}>")).cast("bigint")
    return maps.select(key, n("sitemap").alias("child_maps"), n("url").alias("urls"), n("lastmod").alias("lastmods")).select(
        "*", (F.col("child_maps") > 0).alias("is_index"), (F.col("lastmods") > 0).alias("gives_exact_freshness")
    )


def dated_hosts(maps: DataFrame) -> DataFrame:
    """Hosts whose landed sitemap files (host, raw) state a modification time in at least one file."""
    return sitemap_probe(maps, "host").where("gives_exact_freshness").select("host").distinct()


def page_host(url: Column) -> Column:
    """Lower-cased host of an absolute URL; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[^:/?#]+://([^/?#]*)", 1))
