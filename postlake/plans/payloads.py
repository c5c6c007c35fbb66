"""Landed source payloads rendered by Spark from the postings and pages, one document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.dates import micros
from postlake.functions.text import iso_text, pick
from postlake.plans import bindings as B
from postlake.sources.boards import ACTOR_ALIASES
from postlake.sources.markup import page_host

c = F.col

def n() -> Column:
    return F.col("ord")


def key() -> Column:
    return F.col("ord").cast("string")


def _iso() -> Column:
    return F.concat(iso_text(c("posted_date")), F.lit("Z"))


def _obj(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _title() -> Column:
    return (
        F.when(n() % 4 == 0, F.concat(F.lit("<b>"), "title", F.lit("</b> &amp; more")))
        .when(n() % 23 == 0, F.lit("")).otherwise(c("title"))
    )




def _adzuna() -> Column:
    return F.to_json(_obj(
        title=_title(), company=_obj(display_name=c("company")), redirect_url=F.when(n() % 9 != 0, c("apply_url")),
        location=_obj(display_name=F.when(n() % 2 == 0, c("location_raw")), area=F.when(n() % 2 == 1, F.array("location_raw"))),
        description=c("description"), salary_min=c("salary_min"), salary_max=c("salary_max"),
        contract_time=F.when(n() % 3 == 0, F.lit("full_time")), contract_type=F.when(n() % 2 == 0, F.lit("permanent")),
        created=_iso(),
    ))


def _jsearch() -> Column:
    return F.to_json(_obj(
        job_title=_title(), employer_name=c("company"), company_name=F.lit("Backup Co"),
        job_apply_link=F.when(n() % 3 == 0, c("apply_url")), job_google_link=F.when(n() % 3 == 1, c("apply_url")),
        apply_options=F.when(n() % 6 == 2, F.array(_obj(apply_link=c("apply_url")))), job_city=c("location_raw"),
        job_description=c("description"), job_is_remote=c("remote_raw"), job_min_salary=c("salary_min"),
        job_max_salary=c("salary_max"), job_salary_currency=F.when(n() % 2 == 0, F.lit("EUR")),
        job_employment_type=F.upper("job_type_raw"), job_posted_at_datetime_utc=_iso(),
    ))


def _greenhouse() -> Column:
    return F.to_json(_obj(
        title=_title(), _company_token=F.when(n() % 5 != 0, F.lower(F.regexp_replace("company", " ", "-"))),
        absolute_url=c("apply_url"), location=_obj(name=c("location_raw")), content=c("description"),
        first_published=F.when(n() % 3 == 0, _iso()), created_at=F.when(n() % 3 == 1, _iso()), published_at=F.when(n() % 3 == 2, _iso()),
        updated_at=F.lit("2024-01-30T00:00:00Z"),
    ))


def _lever() -> Column:
    millis = F.floor(micros(c("posted_date")) / 1000)
    return F.to_json(_obj(
        text=_title(), _company_slug=F.lit("globex-labs"), hostedUrl=c("apply_url"),
        categories=_obj(location=c("location_raw"), commitment=c("job_type_raw")),
        descriptionPlain=F.when(n() % 2 == 0, c("description")), description=c("description"), createdAt=millis,
    ))


def _remotive() -> Column:
    return F.to_json(_obj(
        title=_title(), company_name=c("company"), url=c("apply_url"), candidate_required_location=c("location_raw"),
        description=c("description"), publication_date=F.date_format("posted_date", "yyyy-MM-dd"), job_type=c("job_type_raw"),
    ))


def google_options() -> Column:
    second = F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/alt-"), key())
    return F.array(_obj(link=c("apply_url"), apply_link=F.lit("x")), _obj(link=F.lit(""), apply_link=F.when(n() % 2 == 0, second)))


def _google() -> Column:
    return F.to_json(_obj(
        title=_title(), company_name=c("company"), apply_options=google_options(),
        related_links=F.array(_obj(link=F.concat(F.lit(" https://www.linkedin.com/jobs/rel-"), key()))),
        url=F.when(n() % 5 == 0, F.concat(F.lit(" https://x.example.com/j/"), key())),
        share_link=F.lit("https://www.google.com/search?ibp=htl;jobs#x"), location=c("location_raw"),
        description=c("description"),
        detected_extensions=_obj(
            work_from_home=F.when(n() % 7 == 0, F.lit(True)),
            posted_at=F.when(n() % 4 != 3, F.concat((n() % 30 + 1).cast("string"), F.lit(" days ago"))),
            schedule_type=F.when(n() % 3 != 0, F.lit("Full-time")),
        ),
    ))


def _connector() -> Column:
    rest = F.to_json(_obj(
        title=c("title"), url=c("apply_url"), applyUrl=F.when(n() % 3 == 0, F.concat(F.lit("https://alt.example.com/job/"), key())),
        companyName=F.when(n() % 4 == 0, F.lit("Alt Co")), location=c("location_raw"), description=c("description"),
        remote=c("remote_raw"), postedAt=F.date_format("posted_date", "yyyy-MM-dd"), contract_type=c("job_type_raw"),
    ))
    name = F.concat(F.lit('"'), "company", F.lit('"'))
    company = F.when(n() % 2 == 0, F.concat(F.lit('{"name":'), name, F.lit("}"))).otherwise(name)
    return F.concat(F.lit('{"company":'), company, F.lit(","), F.substring(rest, 2, 100_000_000))


POSTINGS = {
    "adzuna": _adzuna, "jsearch": _jsearch, "greenhouse": _greenhouse, "lever": _lever, "remotive": _remotive,
    "google_jobs": _google, "linkedin": _connector, "dice": _connector,
}


def _usajobs() -> Column:
    item = _obj(MatchedObjectDescriptor=_obj(
        PositionTitle=c("title"), OrganizationName=F.when(n() % 3 == 0, c("company")), DepartmentName=F.when(n() % 3 == 1, F.lit("Dept X")),
        ApplyURI=F.when(n() % 2 == 0, F.array(F.concat(F.lit("https://www.usajobs.gov/job/"), key()))),
        PositionURI=F.when(n() % 4 != 1, F.concat(F.lit("https://www.usajobs.gov/position/"), key())),
        PositionLocation=F.when(n() % 5 != 0, F.array(
            _obj(CityName=F.lit("Austin"), StateCountrySubDivisionCode=F.lit("Texas")),
            _obj(CityName=F.lit("Reston"), StateCountrySubDivisionCode=F.lit("Virginia")),
        )),
        PositionRemuneration=F.array(_obj(
            Description=F.when(n() % 6 == 0, F.lit("Remote eligible")), MinimumRange=F.when(n() % 2 == 0, F.lit("90000")),
            MaximumRange=F.lit("120000"), RateIntervalCode=F.lit("PA"),
        )),
        PositionSchedule=F.array(_obj(Code=(n() % 6 + 1).cast("string"), Name=F.when(n() % 6 == 0, F.lit("Full-time")))),
        PublicationStartDate=iso_text(c("posted_date")), QualificationSummary=c("description"),
        UserArea=_obj(Details=_obj(JobSummary=F.when(n() % 2 == 1, F.lit("Summary of duties")))),
    ))
    return F.to_json(_obj(SearchResult=_obj(SearchResultItems=F.array(item))))


def _careerbuilder() -> Column:
    return F.to_json(_obj(ResponseJobSearch=_obj(Results=F.array(
        _obj(JobTitle=F.concat(F.lit(" "), "title"), JobDetailsURL=c("apply_url"), DescriptionTeaser=c("description"),
             EmploymentType=c("job_type_raw"), Company=c("company"), Location=c("location_raw"), PostedDate=iso_text(c("posted_date"))),
        _obj(JobTitle=F.lit(""), JobDetailsURL=c("apply_url"), DescriptionTeaser=F.lit(None).cast("string"),
             EmploymentType=F.lit(None).cast("string"), Company=F.lit("x"), Location=F.lit("x"), PostedDate=F.lit("x")),
    ))))


def _ziprecruiter() -> Column:
    return F.to_json(_obj(jobs=F.array(_obj(
        name=F.when(n() % 2 == 0, c("title")), title=c("title"), job_detail_url=F.when(n() % 3 == 0, c("apply_url")), url=c("apply_url"),
        snippet=F.when(n() % 2 == 1, F.lit("Short part-time note")), description=c("description"),
        employment_type=c("job_type_raw"), hiring_company=_obj(name=c("company")), location=c("location_raw"),
        remote_position=c("remote_raw"), date_posted=iso_text(c("posted_date")),
    ))))


def _extracted() -> Column:
    return F.to_json(_obj(data=_obj(json=_obj(jobs=F.array(_obj(
        title=F.concat(F.lit(" "), "title"), company=c("company"), url=c("apply_url"), location=c("location_raw"),
        remote=F.when(n() % 3 == 0, c("remote_raw")), job_type=c("job_type_raw"), posted_date=iso_text(c("posted_date")),
        description=c("description"),
    ))))))


def _remoteok() -> Column:
    blank = F.lit(None).cast("string")
    item = lambda first: _obj(
        position=F.lit("Legal notice") if first else c("title"), company=blank if first else c("company"),
        url=blank if first else F.when(n() % 2 == 0, c("apply_url")), id=key(), location=blank if first else c("location_raw"),
        date=blank if first else iso_text(c("posted_date")), description=blank if first else c("description"),
    )
    return F.to_json(F.array(item(True), item(False)))


def _remotive_api() -> Column:
    return F.to_json(_obj(jobs=F.array(_obj(
        title=c("title"), company=c("company"), url=F.when(n() % 2 == 0, c("apply_url")), link=c("apply_url"),
        location=c("location_raw"), job_type=c("job_type_raw"), sub_date=iso_text(c("posted_date")), description=c("description"),
    ))))


def _actor(portal: str) -> Column:
    alias = ACTOR_ALIASES[portal]
    values = {
        "title": c("title"), "url": c("apply_url"), "company": c("company"), "location": c("location_raw"),
        "kind": c("job_type_raw"), "description": c("description"), "posted": iso_text(c("posted_date")),
    }
    return F.to_json(F.create_map(*[x for f, v in values.items() for x in (pick(alias[f], F.floor(n() / 4)), v)]))


def _rss() -> Column:
    shown = F.when(n() % 3 == 0, F.concat("title", F.lit(" at "), "company")).when(
        n() % 3 == 1, F.concat("company", F.lit(": "), "title")).otherwise(c("title"))
    item = F.concat(
        F.lit("<item><title>"), F.regexp_replace(shown, "&", "&amp;"), F.lit("</title><link>"),
        F.regexp_replace("apply_url", "&", "&amp;"), F.lit("</link><description><![CDATA["), "description",
        F.lit("]]></description>"),
        F.coalesce(F.concat(F.lit("<pubDate>"), F.date_format("posted_date", "EEE, dd MMM yyyy HH:mm:ss '+0000'"), F.lit("</pubDate>")), F.lit("")),
        F.lit("</item>"),
    )
    return F.concat(F.lit('<rss version="2.0"><channel><title>Feed</title>'), item, F.lit("<item><title></title><link>x</link></item></channel></rss>"))


def _sitemap() -> Column:
    urls = F.array_join(F.transform(F.sequence(F.lit(1), (n() % 3 + 1).cast("int")), lambda i: F.concat(
        F.lit("<url><loc>https://s.example.com/"), F.when(i == 2, F.lit("blog")).otherwise(F.lit("jobs")), F.lit("/Data-ENGINEER-"), key(), F.lit("-"),
        i.cast("string"), F.lit("</loc>"), F.when(n() % 2 == 0, F.lit("<lastmod>2024-01-01</lastmod>")).otherwise(F.lit("")), F.lit("</url>"))), "")
    index = F.when(n() % 10 == 0, F.lit("<sitemap><loc>https://s.example.com/more.xml</loc></sitemap>")).otherwise(F.lit(""))
    return F.concat(F.lit("<urlset>"), urls, index, F.lit("</urlset>"))


RESPONSES = {
    "usajobs": _usajobs, "careerbuilder": _careerbuilder, "ziprecruiter": _ziprecruiter, "extracted": _extracted,
    "remoteok": _remoteok, "remotive_api": _remotive_api, "rss": _rss, "sitemap": _sitemap, "google_jobs": _google,
}
DISPATCH = list(POSTINGS)


def payload(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Every posting in the shape of one source."""
    build = POSTINGS.get(source) or RESPONSES[source]
    return B.jobs(spark, sf_dir, text=True).select("ord", c("source_platform").alias("portal"), build().alias("raw"))


def actor_payload(spark: SparkSession, sf_dir: str, portal: str) -> DataFrame:
    at = list(ACTOR_ALIASES).index(portal)
    return B.jobs(spark, sf_dir, text=True).where(n() % 4 == at).select("ord", _actor(portal).alias("raw"))


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landing table: each posting in the shape of the source it came from."""
    return landed(B.jobs(spark, sf_dir, text=True))


def landed(postings: DataFrame) -> DataFrame:
    """Postings with their descriptions as landed rows. Rendered where they are read: stored payloads would repeat
    a document for each of its postings."""
    raw = None
    for i, s in enumerate(DISPATCH):
        hit = n() % len(DISPATCH) == i
        raw = F.when(hit, POSTINGS[s]()) if raw is None else raw.when(hit, POSTINGS[s]())
    return postings.select("ord", pick(DISPATCH, n()).alias("source"), raw.alias("raw"))


def host_sitemaps(pages: DataFrame) -> DataFrame:
    """(host, raw): the sitemap files of the pages' hosts, one file a page; some hosts state modification times."""
    host = page_host(F.col("url"))
    dated = F.when(F.length(host) % 4 == 2, F.lit("<lastmod>2024-01-09</lastmod>")).otherwise(F.lit(""))
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    return pages.where(host != "").select(
        host.alias("host"), F.concat(F.lit("<urlset><url><loc>"), escaped, F.lit("</loc>"), dated, F.lit("</url></urlset>")).alias("raw")
    )
