"""Golden cases of the column functions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions import contacts, dates, expansion, jobs, keys, links, prompts, relevance, text
from postlake.operators import search
from postlake.operators.guard import SearchRequest, with_reason

AS_OF = "2026-08-12 12:00:00"


@pytest.mark.parametrize(
    "portal,title,raw,kind,canonical",
    [
        ("upwork", "Senior Python Developer", "freelance", "contract", "Software Engineer"),
        ("fiverr", "AI Engineer & LLM Specialist", "gig", "contract", "AI Engineer"),
        ("toptal", "DevOps Architect", "contract", "contract", "DevOps Engineer"),
        ("freelancer", "Data Scientist for Predictive Model", "freelance", "contract", "Data Scientist"),
        ("guru", "ServiceNow Administrator", "contract", "contract", "ServiceNow Engineer"),
        ("peopleperhour", "Cloud AWS Migration Specialist", "project", "contract", "Cloud Engineer / Architect"),
        ("truelancer", "QA Test Automation Lead", "contract", "contract", "QA / Test Automation Engineer"),
        ("contra", "Technical Product Manager", "freelance", "contract", "Product Manager"),
        ("greenhouse", "Site Reliability Engineer", "full_time", "full_time", "Site Reliability Engineer (SRE)"),
        ("lever", "Cybersecurity Analyst", "full_time", "full_time", "Cybersecurity Engineer"),
        ("remotive", "Data Engineer (Spark/Snowflake)", "full_time", "full_time", "Data Engineer"),
        ("remoteok", "Machine Learning Engineer", "full_time", "full_time", "Machine Learning Engineer"),
        ("x", "GenAI / LLM / AI Engineer", "", "unknown", "AI Engineer"),
        ("x", "Senior Software Engineer - React/Node", "", "unknown", "Software Engineer"),
    ],
)
def test_title_and_type(one, portal, title, raw, kind, canonical):
    assert one(jobs.canonical_title, t=title) == canonical
    assert one(lambda p, r, t: jobs.normalize_job_type(p, r, t, F.lit("")), p=portal, r=raw, t=title) == kind


@pytest.mark.parametrize(
    "place,city,country",
    [
        ("Bengaluru, India", "Bengaluru", "IN"), ("San Francisco, CA, USA", "San Francisco", "US"),
        ("London, United Kingdom", "London", "GB"), ("Toronto, ON, Canada", "Toronto", "CA"),
        ("Toronto, Canada", "Toronto", "CA"), ("Dublin, Ireland", "Dublin", "NZ"), ("Westerville, IN", "Westerville", "US"),
        ("IN-Bengaluru", "Bengaluru", "IN"), ("Worldwide", None, "Remote / Global"), ("EMEA", None, "Europe"),
        ("", None, "NZ"), ("Canada", None, "CA"), ("Gary, Indiana", "Gary", "NZ"),
    ],
)
def test_places(one, place, city, country):
    got = one(lambda p: jobs.city_country(p, F.lit("nz")), p=place)
    assert (got["city"], got["country"]) == (city, country)


def test_places_compat(one):
    got = one(lambda p: jobs.city_country(p, F.lit("nz"), compat=True), p="Dublin, Ireland")
    assert got["country"] == "US"


def test_strip_html(one):
    raw = "<strong>Senior</strong> &amp; <em>Lead</em> &quot;Python&quot; Developer&#39;s &nbsp; Role"
    assert one(text.strip_html, x=raw) == 'Senior & Lead "Python" Developer\'s Role'
    assert one(text.strip_html, x="a &lt;b&gt;c&lt;/b&gt; &hellip; d") == "a c … d"


@pytest.mark.parametrize(
    "t,want", [("100% remote role", True), ("WFH Backend Engineer", True), ("Onsite Developer / Office based in Austin", False)]
)
def test_remote(one, t, want):
    assert one(lambda x: jobs.detect_remote(x, F.lit(""), F.lit("")), x=t) is want


def test_work_auth(one):
    assert one(text.work_auth_note, x="Hi. Must be authorized to work in the US! Bye") == "Must be authorized to work in the US"
    assert one(text.work_auth_note, x="We are unable to sponsor visas\nnow") == "We are unable to sponsor visas"
    assert one(text.work_auth_note, x="nothing here") is None
    long = "x" * 190 + " green card holders only please"
    assert one(text.work_auth_note, x=long) == long[:200]


def test_contacts(spark):
    rows = [
        ("Recruiter: Sarah Connor (sarah.connor@cyberdyne.com)", "Acme", ("sarah.connor@cyberdyne.com", "careers@acme.com", "Sarah Connor")),
        ("Hiring Manager: John Smith (john.smith@acme.com) or careers@acme.com", "Big Corp", ("john.smith@acme.com", "careers@acme.com", "John Smith")),
        ("write careers@x.com", "Datadog", (None, "careers@x.com", None)),
        ("no mail", "Datadog", (None, "careers@datadoghq.com", None)),
        ("mail jane.doe@acme.com now", "", ("jane.doe@acme.com", None, "Jane Doe")),
        ("Ann\tLee <Ann.lee@acme.com>", "", ("ann.lee@acme.com", None, "Ann\tLee")),
        ("contact: Apply Now, or reach out to mary jones, mj@acme.com", "", ("mj@acme.com", None, "Mary Jones")),
        ("contact Max Moritz " + "x " * 100 + "mm@acme.com", "", ("mm@acme.com", None, None)),
    ]
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i INT, description STRING, company STRING")
    got = contacts.with_contacts(df).orderBy("i").collect()
    for g, r in zip(got, rows):
        assert (g.recruiter_email, g.company_contact_email, g.recruiter_name) == r[2]


@pytest.mark.parametrize(
    "portal,good,bad",
    [
        ("linkedin", "https://www.linkedin.com/jobs/view/3829104821/", "https://www.linkedin.com/jobs/search/?keywords=developer"),
        ("linkedin", "https://boards.greenhouse.io/acme/jobs/1", "https://www.google.com/search?q=linkedin+developer+jobs"),
        ("indeed", "https://www.indeed.com/viewjob?jk=7c8d9e0f1a2b3c4d", "https://www.indeed.com/jobs?q=developer&l=Remote"),
        ("glassdoor", "https://www.glassdoor.com/job-listing/a-JV_IC1147401.htm?jl=1", "https://www.glassdoor.com/Job/jobs.htm?suggestCount=0"),
        ("dice", "https://www.dice.com/job-detail/38a910bf-1", "https://www.dice.com/jobs?q=developer&location=Remote"),
        ("ziprecruiter", "https://www.ziprecruiter.com/jobs/acme-corp-1234/senior-developer-5678", "https://www.ziprecruiter.com/candidate/search?search=developer"),
        ("usajobs", "https://www.usajobs.gov/job/789101100", "https://www.usajobs.gov/Search/Results?k=developer"),
        ("careerbuilder", "https://www.careerbuilder.com/job/J3N58R67T80B3Y9W0L0", "https://www.careerbuilder.com/jobs?keywords=python"),
        ("simplyhired", "https://www.simplyhired.com/job/A8B9C0D1E2F3", "https://www.simplyhired.com/search?q=developer"),
        ("weworkremotely", "https://weworkremotely.com/remote-jobs/acme-inc-senior-backend-engineer", "https://weworkremotely.com/categories/remote-full-stack-programming-jobs"),
        ("hired", "https://hired.com/jobs/12345-senior-python-engineer", "https://hired.com/employers"),
        ("other", "https://x.example.com/ab", "https://x.example.com/"),
    ],
)
def test_direct_url(one, portal, good, bad):
    assert one(links.valid_direct_url, p=portal, u=good) is True
    assert one(links.valid_direct_url, p=portal, u=bad) is False


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Today", "2026-08-12 12:00:00"), ("yesterday", "2026-08-11 12:00:00"), ("3 days ago", "2026-08-09 12:00:00"),
        ("30+ days ago", "2026-07-13 12:00:00"), ("2 weeks ago", "2026-07-29 12:00:00"), ("1 month ago", "2026-07-13 12:00:00"),
        ("a few days ago", None), ("Monday, 18 July 2026", "2026-07-18 00:00:00"), ("1754906400", "2025-08-11 10:00:00"),
        ("1754906400000", "2025-08-11 10:00:00"), ("Tue, 11 Aug 2026 10:00:00 +0000", "2026-08-11 10:00:00"),
        ("Tue, 11 Aug 2026 10:00:00 EST", "2026-08-11 15:00:00"), ("11 Aug 26 10:00 PDT", "2026-08-11 17:00:00"), ("11 Aug 69", "1969-08-11 00:00:00"),
        ("2026-08-11", "2026-08-11 00:00:00"), ("2026-08-11T10:00:00+05:30", "2026-08-11 04:30:00"), ("junk", None), ("", None),
        ("July 18, 2026", "2026-07-18 00:00:00"), ("07/18/2026", "2026-07-18 00:00:00"), ("2026-13-40", None),
        ("99999999999999 years ago", None),
    ],
)
def test_dates(one, raw, want):
    got = one(lambda x: dates.parse_posted_date(x, dates.ts(AS_OF)), x=raw)
    assert got == (dt.datetime.fromisoformat(want) if want else None)


def _candidate(i, age_hours, url, dated=True):
    posted = dt.datetime.fromisoformat(AS_OF) - dt.timedelta(hours=age_hours) if dated else None
    return (i, f"job{i}", "Backend Developer", "Co", "linkedin", url, "US", True, "full_time", posted, None, None, None, None, None, "")


JOB = (
    "ord BIGINT, id STRING, title STRING, company STRING, source_platform STRING, apply_url STRING, country STRING, "
    "remote_flag BOOLEAN, job_type STRING, posted_date TIMESTAMP_NTZ, posted_date_precision STRING, scraped_at TIMESTAMP_NTZ, "
    "fetched_at TIMESTAMP_NTZ, canonical_title STRING, skills STRING, description STRING"
)


def test_freshness_end_to_end(spark):
    good = "https://www.linkedin.com/jobs/view/123456789/"
    rows = [
        _candidate(1, 20, good), _candidate(2, 20, good), _candidate(3, 36, good), _candidate(4, 120, good),
        _candidate(5, 20, "https://www.google.com/search?q=x"), _candidate(6, 0, good, dated=False),
    ]
    out = with_reason(spark.createDataFrame(rows, JOB), SearchRequest(country="US", date_posted="past_24h"), dates.ts(AS_OF))
    got = {r.id: r.reason for r in out.collect()}
    assert [k for k, v in sorted(got.items()) if v is None] == ["job1", "job2"]
    assert got["job5"] == "invalid_or_indirect_url" and got["job6"] == "stale_date"


def test_leak_matrix(spark):
    """No admitted row is older than its window, whichever stamps are set; undated rows fail tight windows."""
    now = dt.datetime.fromisoformat(AS_OF)
    rows = []
    for age in (1, 10, 20, 30, 72, 240, 720, 1440):
        t = now - dt.timedelta(hours=age)
        for mask in range(8):
            rows.append((float(age), *(t if mask & b else None for b in (1, 2, 4))))
    df = spark.createDataFrame(rows, "age DOUBLE, posted_date TIMESTAMP_NTZ, scraped_at TIMESTAMP_NTZ, fetched_at TIMESTAMP_NTZ")
    eff = dates.effective_freshness(F.col("posted_date"), F.lit(None).cast("string"), F.col("scraped_at"), F.col("fetched_at"), F.lit("dice"))
    df = df.withColumn("e", eff)
    for window in (720, 1440, 10080, 43200):
        ok = df.where(dates.is_fresh(F.col("e.ts"), F.col("e.field"), F.lit(window), dates.ts(AS_OF))).collect()
        for r in ok:
            if r.e["ts"] is not None:
                assert r.age <= window / 60
            else:
                assert window > 1440
            if window <= 1440:
                assert r.posted_date is not None


def test_relevance(spark):
    titles = {
        "Cloud Engineer": 1.0, "Senior Cloud Engineer (AWS)": 1.0, "Cloud Infrastructure Engineer II": 0.85,
        "Cloud Sales Executive": 0.35, "Salesforce Engineer": 0.6, "Nurse": 0.0,
    }
    df = spark.createDataFrame([(t, None, "Co", None, "") for t in titles], "title STRING, canonical_title STRING, company STRING, skills STRING, description STRING")
    got = {r.title: r.relevance_score for r in search.scored(df, "cloud engineer").collect()}
    assert got == titles


def test_relevance_body_and_phrases(spark):
    df = spark.createDataFrame(
        [("Nurse", None, "Co", None, "We use python, and hire a developer"), ("Lead Developer", None, "Co", None, "java")],
        "title STRING, canonical_title STRING, company STRING, skills STRING, description STRING",
    )
    got = {r.title: (r.relevance_score, r.relevance_reason) for r in search.scored(df, "cloud engineer, python developer").collect()}
    assert got["Nurse"] == (0.4, "all_tokens_but_only_in_body")
    assert got["Lead Developer"] == (0.6, "majority_tokens_plus_synonym_in_title")
    assert relevance.parse_query("the senior") == []


def test_cache_key(spark):
    cols = "title STRING, q STRING, platform STRING, country STRING, remote BOOLEAN, job_type STRING, date_posted STRING"
    rows = [
        ("Python, React", None, "all", None, False, "all", "7d"), ("react ,  PYTHON", None, None, "all", False, None, "past_7d"),
        ("Python, React", None, "all", None, True, "all", "7d"), ("python", "react", "all", None, False, "all", "past week"),
    ]
    df = spark.createDataFrame(rows, cols)
    k = [r.k for r in df.select(keys.cache_key(*[F.col(c) for c in df.columns]).alias("k")).collect()]
    assert k[0] == k[1] == k[3] != k[2] and len(k[0]) == 64


def test_filter_spec(spark):
    from postlake.operators.guard import locked_requests

    cols = "request_id BIGINT, title STRING, q STRING, platform STRING, country STRING, remote_only BOOLEAN, job_type STRING, date_posted STRING"
    rows = [(1, "x", None, None, None, None, "all", "past_10m"), (2, "x", None, None, None, None, "bogus", "past_24h")]
    a, b = locked_requests(spark.createDataFrame(rows, cols)).orderBy("request_id").collect()
    assert a.date_posted == "past_7d" and len(a.integrity_hash) == 64 and a.error is None
    assert b.error == "invalid_job_type" and b.integrity_hash is None and b.date_posted == "past_24h"


def test_expansion():
    e = expansion.expand("cloud engineer")
    assert e.families == ["cloud_infra"] and "cloud engineer" not in e.strong and "sre" in e.strong
    assert expansion.expand("cloud engineer", "strict").related == []
    assert expansion.expand("cloud engineer", "exact").strong == []
    assert expansion.expand("web development", compat=False).families == []
    assert "mobile" in expansion.expand("bios lead", compat=True).families
    assert "mobile" not in expansion.expand("bios lead").families


def test_intent(spark):
    df = spark.createDataFrame([("Find me remote senior python developer roles in US paying over $130k",), ("just business roles",)], "m STRING")
    a, b = df.select(*[c.alias(k) for k, c in prompts.intent_columns(F.col("m")).items()]).collect()
    assert a.remote_only and a.country == "US" and a.min_salary == 130000 and "python" in a.query
    assert b.country is None


def test_json_strings_are_ascii(one):
    for raw in ['plain', 'a "b" \\ c', "développeur", "tab\there\n", "\x7f\x01", "日本 😀"]:
        assert one(keys.json_string, x=raw) == json.dumps(raw)


def test_block_signatures_anywhere(one):
    far = "x" * 250_000 + V.BLOCK_SIGNATURES[0]
    assert one(lambda b: links.detect_block(F.lit(200), b), b=far) == V.BLOCK_SIGNATURES[0]


def test_note_behind_the_snippet_length(spark):
    """The work authorisation note and the description come from the whole text."""
    from postlake.sources import postings

    body = "We build things. " * 200 + "No sponsorship is offered."
    raw = json.dumps({"text": "Engineer", "hostedUrl": "https://jobs.lever.co/acme/1", "descriptionPlain": body})
    landed = spark.createDataFrame([(1, raw)], "ord BIGINT, raw STRING")
    row = postings.lever(landed, F.lit(AS_OF).cast("timestamp_ntz")).collect()[0]
    assert row.description == body and "sponsorship" in row.work_authorization_note
