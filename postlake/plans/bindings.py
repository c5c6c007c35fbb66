"""Job-posting tables derived by Spark from the given test tables.

Every row of the given table yields one row here, so the work of each query grows with its
input. Values are picked with integer arithmetic so that the same table can be written in SQL.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.dates import micros, precision_from_stored, ts
from postlake.functions.jobs import (
    canonical_title,
    city_country,
    currency_for_country,
    detect_remote,
    normalize_job_type,
)
from postlake.functions.text import pick
from postlake.session import written_once

AS_OF = "2024-01-31 00:00:00"

TITLES = [
    "Cloud Engineer", "Senior Cloud Engineer (AWS)", "Cloud Sales Executive", "Cloud Infrastructure Engineer II",
    "Site Reliability Engineer", "Platform Engineer", "DevOps Engineer", "Backend Engineer", "Network Engineer",
    "Engineer II", "Data Scientist", "Lead Data Scientist", "Data Engineer (Spark/Snowflake)",
    "Machine Learning Engineer", "ServiceNow Administrator", "Technical Product Manager", "QA Test Automation Lead",
    "Sr Python Dev", "Senior Python Developer", "Nurse Practitioner", "Salesforce Developer",
    "Business Development Manager", "Marketing Manager",
]
COMPANIES = [
    "Acme Corp", "Acme Corp Inc", "ACME", "Globex LLC", "Globex", "Initech", "Initech Ltd", "Umbrella Co", "Hooli",
    "Hooli Inc", "Stripe", "Datadog", "Soylent Foods", "Soylent", "",
]
LOCATIONS = [
    "Bengaluru, India", "San Francisco, CA, USA", "London, United Kingdom", "Toronto, ON, Canada", "Westerville, IN",
    "Remote", "Worldwide", "Sydney, Australia", "Berlin, Germany", "EMEA", "IN-Pune", "Springfield", None,
]
JOB_TYPES = ["fulltime", "Contract", "part-time", "permanent", "internship", "unknown", None, "temporary"]
SKILLS = [None, "aws, kubernetes, terraform", "python, django", "spark, airflow", "aws", ""]
SENTENCES = [
    "Candidates must be authorized to work in the US! Ask careers@acme.com.",
    "Recruiter: Sarah Connor (sarah.connor@cyberdyne.com). Uses aws, docker and terraform.",
    "We are unable to sponsor visas\nWFH is fine, docker and spring boot help.",
    "This is a full-time position.",
    "Contract-to-hire, write to jane.doe@globex.com or jobs@globex.com.",
    "<p>Build &amp; run <b>kubernetes</b> on aws &copy; with python</p>",
    "Office based.",
]

REQUEST_TITLES = ["cloud engineer", "data scientist", "Python, React", "react ,  PYTHON", "all", "devops engineer"]
REQUEST_DATES = ["past_12h", "past_24h", "7d", "past_7d", "past_30d", "all", "junk", None]
REQUEST_PLATFORMS = ["all", "dice", None]
REQUEST_COUNTRIES = ["us", "all", None]
REQUEST_JOB_TYPES = ["all", "fulltime", "full_time", "parttime", "onsite", "bogus"]
REQUEST_MODES = ["hybrid", "strict", "exact"]

RUN_ERRORS = [None, "HTTP 429 rate limit", "403 forbidden", "No module named x", "timeout", "quota exceeded"]

PROMPTS = [
    "Find me remote python developer roles in US paying over $130k", "only remote", "show details", "jobs in India",
    "data scientist in UK above 90000", "from those narrow down", "just business roles", "list them",
]


def as_of() -> Column:
    return ts(AS_OF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_name(kind: str, sf_dir: str) -> str:
    return f"{kind}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}"


def job_columns(e: str = "event_id") -> dict[str, Column]:
    """Landed fields of a posting, from the ``events`` columns."""
    n, stamp = F.col(e), F.col("ts")
    portal = pick(V.PORTAL_IDS, n)
    site = F.concat(F.lit("https://www."), portal, F.lit(".com"))
    key = n.cast("string")
    url = (
        F.when(n % 6 == 0, F.concat(site, F.lit("/jobs/view/job-"), key))
        .when(n % 6 == 1, F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/"), key))
        .when(n % 6 == 2, F.concat(F.lit("https://www.google.com/search?q="), key))
        .when(n % 6 == 3, F.concat(site, F.lit("/jobs/search?keywords="), key))
        .when(n % 6 == 4, F.concat(F.lit("https://www.indeed.com/pagead/clk?"), key))
        .otherwise(F.concat(F.lit("ftp://x/"), key))
    )
    day = F.date_trunc("day", stamp).cast("timestamp_ntz")
    posted = F.when(n % 5 == 0, F.lit(None).cast("timestamp_ntz")).when(n % 5 == 1, day).otherwise(stamp)
    hours = lambda k: F.timestamp_add("HOUR", k.cast("int"), stamp)
    scraped = (
        F.when(n % 50 == 0, F.lit(None).cast("timestamp_ntz"))
        .when(n % 37 == 0, hours(F.lit(-240)))
        .otherwise(hours(n % 97))
    )
    fetched = (
        F.when(n % 100 == 0, F.lit(None).cast("timestamp_ntz"))
        .when(n % 41 == 0, posted)
        .otherwise(hours((n % 11) * 24))
    )
    pay = F.when(n % 3 == 0, F.col("value") * 1000)
    return {
        "ord": n,
        "id": key,
        "title": pick(TITLES, n * 7),
        "company": pick(COMPANIES, F.col("user_id")),
        "location_raw": pick(LOCATIONS, n),
        "source_platform": portal,
        "job_type_raw": pick(JOB_TYPES, n),
        "remote_raw": n % 4 == 0,
        "skills": pick(SKILLS, n),
        "salary_min": pay,
        "salary_max": pay + 20000,
        "apply_url": url,
        "posted_date": posted,
        "scraped_at": scraped,
        "fetched_at": fetched,
    }


def raw_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed posting per event and document of it; ``doc`` numbers an event's documents from 1 (1: none)."""
    docs = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count(F.lit(1)).alias("docs"))
    # only the columns of a posting move, to tasks enough for the work on them
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", F.floor(F.col("event_id") / 10).alias("at"))
    events = events.repartition(3 * spark.sparkContext.defaultParallelism, "at").join(docs, F.col("at") == F.col("doc_id"), "left")
    numbers = F.sequence(F.lit(1), F.coalesce(F.col("docs").cast("int"), F.lit(1)))
    return events.withColumn("doc", F.explode(numbers)).select(*[c.alias(k) for k, c in job_columns().items()], "doc")


def with_description(spark: SparkSession, sf_dir: str, postings: DataFrame) -> DataFrame:
    """Postings (one row an event) with the whole text of each document as description: a text moves once, not per posting."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = postings.join(docs, F.floor(F.col("ord") / 10) == F.col("doc_id"), "left").drop("doc_id")
    return out.withColumn("description", F.concat_ws(" ", pick(SENTENCES, F.col("ord")), F.col("text"))).drop("text")


def build_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise every landed posting into the stored table's columns."""
    raw = raw_jobs(spark, sf_dir)
    none = F.lit("")
    place = city_country(F.col("location_raw"), F.lit("US"))
    return (
        raw.withColumn("place", place)
        .withColumns(
            {
                "canonical_title": canonical_title(F.col("title")),
                "city": F.col("place.city"),
                "country": F.col("place.country"),
                "job_type": normalize_job_type(F.col("source_platform"), F.col("job_type_raw"), F.col("title"), none),
                "remote_flag": F.coalesce(F.col("remote_raw"), F.lit(False))
                | detect_remote(F.col("title"), none, F.coalesce(F.col("location_raw"), none)),
                "posted_date_precision": F.when(F.col("ord") % 7 == 0, F.lit(None).cast("string")).otherwise(
                    precision_from_stored(F.col("posted_date"), F.col("source_platform"))
                ),
            }
        )
        .drop("place")
        .withColumn("currency", currency_for_country(F.col("country")))
    )


def jobs(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """The stored postings table, written once per session; queries scan only the columns they use.

    It holds no descriptions, which would repeat a document for each of its postings; ``text`` joins them.
    """
    stored = stored_rows(spark, sf_dir)
    return with_description(spark, sf_dir, one_per_event(stored)) if text else stored.drop("doc")


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(spark, table_name("jobs", sf_dir), lambda: build_jobs(spark, sf_dir), [])


def one_per_event(stored: DataFrame) -> DataFrame:
    return stored.where(F.col("doc") == 1).drop("doc")


def stored_jobs(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    return jobs(spark, sf_dir, text).where(F.col("ord") % 4 == 0)


def incoming_jobs(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """The landed batch: the other postings plus re-scrapes of stored ones under their own URL."""
    j = jobs(spark, sf_dir, text)
    fresh = j.where(F.col("ord") % 4 != 0)
    again = j.where(F.col("ord") % 12 == 0).withColumns(
        {
            "ord": F.col("ord") + F.lit(1_000_000_000),
            "posted_date": F.coalesce(F.col("posted_date"), F.col("scraped_at")) + F.expr("INTERVAL 1 HOUR"),
            "posted_date_precision": F.lit("hour"),
        }
    )
    return fresh.unionByName(again)


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The same table as a file stream. The pattern matches its path alone: a stream reads a folder of files by its
    path, but a single file only by a pattern."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(table(spark, sf_dir, "events"))


def runs_of(events: DataFrame) -> DataFrame:
    n = F.col("event_id")
    error = F.col("event_type") == "error"
    return events.select(
        n.alias("run_id"),
        pick(V.PORTAL_IDS, F.col("user_id")).alias("portal"),
        F.concat(F.lit("Method "), (n % 4 + 1).cast("string")).alias("method"),
        F.col("ts"),
        (~error).alias("success"),
        (F.floor(F.col("value")) % 60).cast("double").alias("num_jobs_found"),
        F.col("event_type").alias("layer_used"),
        F.when(error, pick(RUN_ERRORS, n)).alias("error_message"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(table(spark, sf_dir, "events"))


def requests_of(events: DataFrame) -> DataFrame:
    n = F.col("event_id")
    return events.select(
        n.alias("request_id"),
        F.col("ts"),
        pick(REQUEST_TITLES, F.col("user_id")).alias("title"),
        F.lit(None).cast("string").alias("q"),
        pick(REQUEST_DATES, n).alias("date_posted"),
        pick(REQUEST_PLATFORMS, n).alias("platform"),
        pick(REQUEST_COUNTRIES, n).alias("country"),
        pick(REQUEST_JOB_TYPES, n).alias("job_type"),
        pick(REQUEST_MODES, F.floor(n / 3)).alias("search_mode"),
        (n % 2 == 0).alias("remote_only"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts_of(table(spark, sf_dir, "conversations"))


def prompts_of(conversations: DataFrame) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    minutes = conv * 60 + turn * 7 + F.when((turn >= 4) & (conv % 3 == 0), 60).otherwise(0)
    return (
        conversations.where(F.col("role") == "user")
        .select(
            conv.alias("session_id"),
            turn.alias("turn"),
            F.timestamp_add("MINUTE", minutes.cast("int"), ts("2024-01-01 00:00:00")).alias("ts"),
            F.concat(pick(PROMPTS, conv + turn), F.lit(". "), F.coalesce("text", F.lit(""))).alias("message"),
        )
    )


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting-date texts in every shape the sources use, one per event."""
    n, stamp = F.col("event_id"), F.col("ts")
    fmt = lambda p: F.date_format(stamp, p)
    seconds = F.floor(micros(stamp) / 1_000_000)
    millis = F.floor(micros(stamp) / 1_000)
    number = lambda k: (n % k + 1).cast("string")
    shapes = [
        F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")), fmt("yyyy-MM-dd"), seconds.cast("string"),
        millis.cast("string"), fmt("EEE, dd MMM yyyy HH:mm:ss '+0000'"), F.lit("Today"), F.lit("yesterday"),
        F.concat(number(28), F.lit(" days ago")), F.concat(number(9), F.lit("+ weeks ago")), F.lit("a few days ago"),
        fmt("EEEE, d MMMM yyyy"), fmt("MMMM d, yyyy"), fmt("MM/dd/yyyy"), F.lit("soon"),
        F.concat(number(50), F.lit(" minutes ago")), fmt("EEE, dd MMM yyyy HH:mm:ss '-0530'"), F.lit(None).cast("string"),
        fmt("yyyy-MM-dd 00:00:00"),
    ]
    raw = None
    for i, shape in enumerate(shapes):
        hit = n % len(shapes) == i
        raw = F.when(hit, shape) if raw is None else raw.when(hit, shape)
    return table(spark, sf_dir, "events").select(n.alias("ord"), raw.alias("raw_date"), pick(V.PORTAL_IDS, n).alias("portal"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages: the whole html plus job anchors, structured data and refusals on some of them."""
    n = F.col("page_id")
    key = n.cast("string")
    anchors = F.array_join(
        F.transform(
            F.sequence(F.lit(0), (n % 7).cast("int")),
            lambda i: F.concat(
                F.lit('<a href="/jobs/view/'), key, F.lit("-"), i.cast("string"), F.lit('">Job '), i.cast("string"),
                F.lit(" on <b>page</b> "), key, F.lit("</a>"),
            ),
        ),
        "",
    )
    other = F.concat(
        F.lit('<a class="x" href="https://jobs.example.com/job/'), key, F.lit('">Open &amp; free role '), key,
        F.lit('</a><a href="viewjob?jk='), key, F.lit('">ab</a>'),
    )
    company = F.concat(F.lit("Firm "), key)
    posting = lambda title: F.concat(
        F.lit('{"@type":"JobPosting","title":"'), title, F.lit('","hiringOrganization":{"name":"'), company,
        F.lit('"},"jobLocation":{"address":{"addressLocality":"Pune","addressCountry":"IN"}},"datePosted":"2024-01-09",'
              '"description":"Build things","url":"https://jobs.example.com/job/'), key, F.lit('"}'),
    )
    flat = F.concat(
        F.lit('{"@type":["Thing","JobPosting"],"name":"Flat role '), key, F.lit('","hiringOrganization":"'), company,
        F.lit('","jobLocation":{"address":"Remote desk"},"employmentType":"CONTRACT"}'),
    )
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    graph = F.concat(
        F.lit('{"@graph":['), posting(F.concat(F.lit("Graph role "), key)), F.lit(',{"@type":"Person","name":"x"}]}')
    )
    listed = F.concat(F.lit("["), posting(F.concat(F.lit("Listed role "), key)), F.lit(","), flat, F.lit("]"))
    state = F.concat(
        F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"'),
        F.when(n % 2 == 0, F.lit("jobs")).otherwise(F.lit("listings")),
        F.lit('":[{"title":"State role '), key, F.lit('","company":{"name":"'), company, F.lit('"},"url":"https://s.example.com/'),
        key, F.lit('","summary":"remote work"},{"role":"Second role '), key, F.lit('","companyName":"'), company,
        F.lit('","description":"on site"}]}}}</script>'),
    )
    none = F.lit("")
    html = F.concat(
        F.col("html"),
        F.when(n % 2 == 0, anchors).otherwise(none),
        F.when(n % 3 == 0, other).otherwise(none),
        F.when(n % 5 == 1, F.lit("<p>Access Denied</p>")).otherwise(none),
        F.when(n % 4 == 0, script(graph)).when(n % 4 == 1, script(listed)).otherwise(none),
        F.when(n % 6 == 0, state).otherwise(none),
    )
    status = F.when(n % 7 == 3, 403).when(n % 11 == 5, 503).otherwise(200)
    headers = F.when(n % 9 == 4, F.lit("CF-RAY:abc")).otherwise(F.lit("server:nginx"))
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", status.alias("status"), headers.alias("headers"), html.alias("html")
    )
