"""Landed source payloads (one JSON document per posting) to the canonical posting row.

Each reader takes a frame with a ``raw`` JSON column, parses it once against the source's
declared schema and projects. Rows without a title or a link are dropped, never invented.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.dates import parse_epoch, parse_posted_date, precision_from_raw
from postlake.functions.jobs import canonical_title, city_country, currency_for_country, detect_remote, normalize_job_type
from postlake.functions.links import first_usable
from postlake.functions.text import blank_to_null, first_filled, strip, strip_html, title_case, work_auth_note

POSTING_COLUMNS = [
    "ord", "title", "canonical_title", "company", "city", "country", "salary_min", "salary_max", "currency",
    "remote_flag", "job_type", "source_platform", "apply_url", "description", "posted_date", "posted_date_precision",
    "work_authorization_note",
]
_none = lambda kind: F.lit(None).cast(kind)


def _parsed(landed: DataFrame, schema: str) -> DataFrame:
    """Payloads as structs. The one-element explode keeps later filters from parsing every payload a second time."""
    return landed.select("ord", F.explode(F.array(F.from_json("raw", schema))).alias("r"))


def _posting(df: DataFrame, source: str, as_of: Column, *, country: str | None,
             number_date: bool = False, remote_from_city: bool = False) -> DataFrame:
    """Common tail: required fields, lengths, place, dates, remote flag and the derived columns.

    ``df`` carries: ord, title, company, apply_url, place_text, description, remote_given,
    salary_min, salary_max, currency, job_type, date_text (or a numeric ``date_text``).
    """
    kept = df.where((F.col("title") != "") & (F.coalesce(F.col("apply_url"), F.lit("")) != ""))
    default = F.lit(country).cast("string")
    posted = parse_epoch(F.col("date_text")) if number_date else parse_posted_date(F.col("date_text"), as_of)
    raw_text = F.col("date_text").cast("string")
    out = kept.withColumn("place", city_country(F.col("place_text"), default)).select(
        "ord",
        F.substring("title", 1, 255).alias("title"),
        canonical_title(F.col("title")).alias("canonical_title"),
        F.substring("company", 1, 255).alias("company"),
        F.col("place.city").alias("city"),
        F.coalesce(F.col("place.country"), F.upper(default)).alias("country"),
        "salary_min",
        "salary_max",
        "currency",
        (
            F.coalesce("remote_given", F.lit(False))
            | detect_remote(
                F.col("title"), F.col("description"),
                F.coalesce("place.city" if remote_from_city else "place_text", F.lit("")),
            )
        ).alias("remote_flag"),
        F.substring("job_type", 1, 50).alias("job_type"),
        F.lit(source).alias("source_platform") if source else F.col("source_platform"),
        "apply_url",
        F.nullif(F.col("description"), F.lit("")).alias("description"),
        posted.alias("posted_date"),
        precision_from_raw(raw_text, F.lit(source or ""), F.lit(number_date)).alias("posted_date_precision"),
    )
    return out.withColumn("work_authorization_note", work_auth_note(F.col("description"))).select(*POSTING_COLUMNS)


def adzuna(landed: DataFrame, as_of: Column, country: str = "us") -> DataFrame:
    r = _parsed(
        landed,
        "title STRING, company STRUCT<display_name: STRING>, redirect_url STRING, description STRING, "
        "location STRUCT<name: STRING, display_name: STRING, area: ARRAY<STRING>>, salary_min DOUBLE, "
        "salary_max DOUBLE, contract_time STRING, contract_type STRING, created STRING",
    )
    kind = F.concat_ws("-", blank_to_null(F.col("r.contract_time")), blank_to_null(F.col("r.contract_type")))
    df = r.select(
        "ord",
        strip_html(F.col("r.title")).alias("title"),
        F.coalesce(blank_to_null(F.col("r.company.display_name")), F.lit("Unknown Company")).alias("company"),
        strip(F.col("r.redirect_url")).alias("apply_url"),
        F.coalesce(
            blank_to_null(F.col("r.location.name")), blank_to_null(F.col("r.location.display_name")),
            F.array_join("r.location.area", ", "),
        ).alias("place_text"),
        strip_html(F.col("r.description")).alias("description"),
        F.lit(False).alias("remote_given"),
        "r.salary_min", "r.salary_max",
        F.coalesce(currency_for_country(F.lit(country)), F.lit("USD")).alias("currency"),
        F.coalesce(F.nullif(kind, F.lit("")), F.lit("full_time")).alias("job_type"),
        F.col("r.created").alias("date_text"),
    )
    return _posting(df, "adzuna", as_of, country=country)


def jsearch(landed: DataFrame, as_of: Column, country: str = "us") -> DataFrame:
    r = _parsed(
        landed,
        "job_title STRING, employer_name STRING, company_name STRING, job_apply_link STRING, job_google_link STRING, "
        "apply_options ARRAY<STRUCT<apply_link: STRING>>, job_city STRING, job_description STRING, "
        "job_is_remote BOOLEAN, job_min_salary DOUBLE, job_max_salary DOUBLE, job_salary_currency STRING, "
        "job_employment_type STRING, job_posted_at_datetime_utc STRING",
    )
    df = r.select(
        "ord",
        strip_html(F.col("r.job_title")).alias("title"),
        F.coalesce(
            blank_to_null(F.col("r.employer_name")), blank_to_null(F.col("r.company_name")), F.lit("Unknown Company")
        ).alias("company"),
        first_filled(
            F.col("r.job_apply_link"), F.col("r.job_google_link"), F.get(F.col("r.apply_options.apply_link"), F.lit(0))
        ).alias("apply_url"),
        F.col("r.job_city").alias("place_text"),
        strip_html(F.col("r.job_description")).alias("description"),
        F.col("r.job_is_remote").alias("remote_given"),
        F.col("r.job_min_salary").alias("salary_min"), F.col("r.job_max_salary").alias("salary_max"),
        F.coalesce(F.col("r.job_salary_currency"), currency_for_country(F.lit(country)), F.lit("USD")).alias("currency"),
        F.lower(F.coalesce(F.col("r.job_employment_type"), F.lit("FULLTIME"))).alias("job_type"),
        F.col("r.job_posted_at_datetime_utc").alias("date_text"),
    )
    return _posting(df, "jsearch", as_of, country=country, remote_from_city=True)


def _plain(df: DataFrame, **cols: Column) -> DataFrame:
    """Projection for sources that publish no pay."""
    return df.select(
        "ord", *[c.alias(k) for k, c in cols.items()],
        *[_none("double").alias(k) for k in ("salary_min", "salary_max")],
    )


def greenhouse(landed: DataFrame, as_of: Column, company: str | None = None) -> DataFrame:
    """The edit stamp (``updated_at``) is never read as a posting date."""
    r = _parsed(
        landed,
        "title STRING, _company_token STRING, absolute_url STRING, location STRUCT<name: STRING>, content STRING, "
        "first_published STRING, created_at STRING, published_at STRING",
    )
    df = _plain(
        r,
        title=strip_html(F.col("r.title")),
        company=F.lit(company) if company else title_case(F.coalesce(F.col("r._company_token"), F.lit("Greenhouse Board"))),
        apply_url=strip(F.col("r.absolute_url")),
        place_text=F.col("r.location.name"),
        description=strip_html(F.col("r.content")),
        remote_given=F.lit(False),
        currency=_none("string"),
        job_type=F.lit("full_time"),
        date_text=first_filled(F.col("r.first_published"), F.col("r.created_at"), F.col("r.published_at")),
    )
    return _posting(df, "greenhouse", as_of, country=None)


def lever(landed: DataFrame, as_of: Column, company: str | None = None) -> DataFrame:
    r = _parsed(
        landed,
        "text STRING, _company_slug STRING, hostedUrl STRING, categories STRUCT<location: STRING, commitment: STRING>, "
        "descriptionPlain STRING, description STRING, createdAt BIGINT",
    )
    df = _plain(
        r,
        title=strip_html(F.col("r.text")),
        company=F.lit(company) if company else title_case(F.coalesce(F.col("r._company_slug"), F.lit("Lever Board"))),
        apply_url=strip(F.col("r.hostedUrl")),
        place_text=F.col("r.categories.location"),
        description=F.coalesce(F.nullif(F.col("r.descriptionPlain"), F.lit("")), strip_html(F.col("r.description"))),
        remote_given=F.lit(False),
        currency=_none("string"),
        job_type=F.coalesce(F.col("r.categories.commitment"), F.lit("full_time")),
        date_text=F.col("r.createdAt"),
    )
    return _posting(df, "lever", as_of, country=None, number_date=True)


def remotive(landed: DataFrame, as_of: Column, country: str = "us") -> DataFrame:
    r = _parsed(
        landed,
        "title STRING, company_name STRING, url STRING, candidate_required_location STRING, description STRING, "
        "publication_date STRING, job_type STRING",
    )
    df = _plain(
        r,
        title=strip_html(F.col("r.title")),
        company=strip(F.coalesce(F.col("r.company_name"), F.lit("Unknown Company"))),
        apply_url=strip(F.col("r.url")),
        place_text=F.col("r.candidate_required_location"),
        description=strip_html(F.col("r.description")),
        remote_given=F.lit(True),
        currency=_none("string"),
        job_type=F.coalesce(F.col("r.job_type"), F.lit("full_time")),
        date_text=F.col("r.publication_date"),
    )
    return _posting(df, "remotive", as_of, country=country)


GOOGLE_SCHEMA = (
    "title STRING, company_name STRING, apply_options ARRAY<STRUCT<link: STRING, apply_link: STRING>>, "
    "related_links ARRAY<STRUCT<link: STRING>>, job_apply_link STRING, apply_link STRING, url STRING, link STRING, "
    "share_link STRING, location STRING, description STRING, "
    "detected_extensions STRUCT<work_from_home: BOOLEAN, posted_at: STRING, schedule_type: STRING>"
)


def google_jobs(landed: DataFrame, as_of: Column, country: str = "us") -> DataFrame:
    """Every apply option is tried before the scalar links; a row without a usable link is dropped."""
    from postlake.functions.links import usable_apply_url

    r = _parsed(landed, GOOGLE_SCHEMA)
    options = F.transform(
        F.coalesce(F.col("r.apply_options"), F.array().cast("array<struct<link:string,apply_link:string>>")),
        lambda o: strip(F.coalesce(F.nullif(o["link"], F.lit("")), o["apply_link"], F.lit(""))),
    )
    scalar = [F.col(f"r.{k}") for k in ("job_apply_link", "apply_link", "url", "link", "share_link")]
    df = _plain(
        r,
        title=strip_html(F.col("r.title")),
        company=strip(F.coalesce(F.col("r.company_name"), F.lit("Unknown Company"))),
        apply_url=F.coalesce(F.get(F.filter(options, usable_apply_url), F.lit(0)), first_usable(*scalar)),
        place_text=F.col("r.location"),
        description=strip_html(F.col("r.description")),
        remote_given=F.col("r.detected_extensions.work_from_home"),
        currency=_none("string"),
        job_type=F.coalesce(F.col("r.detected_extensions.schedule_type"), F.lit("full_time")),
        date_text=F.col("r.detected_extensions.posted_at"),
    )
    return _posting(df, "google_jobs", as_of, country=country)


CONNECTOR_URL_KEYS = ["url", "link", "apply_url", "applyUrl", "jobUrl", "job_url", "apply_link", "detail_url"]


def company_name(value: Column) -> Column:
    """Name of a company field that is either text or an object."""
    return F.coalesce(
        blank_to_null(F.get_json_object(value, "$.name")),
        blank_to_null(F.get_json_object(value, "$.display_name")),
        F.when(~value.startswith("{"), blank_to_null(value)),
    )


def connector(landed: DataFrame, as_of: Column, source: str, country: str = "IN") -> DataFrame:
    keys = ", ".join(f"{k} STRING" for k in CONNECTOR_URL_KEYS)
    r = _parsed(
        landed,
        f"title STRING, {keys}, company STRING, companyName STRING, location STRING, description STRING, "
        "remote BOOLEAN, posted_date STRING, postedAt STRING, postedDate STRING, job_type STRING, "
        "contract_type STRING, employmentType STRING",
    )
    kind = F.coalesce(
        first_filled(F.col("r.job_type"), F.col("r.contract_type"), F.col("r.employmentType")), F.lit("unknown")
    )
    df = _plain(
        r,
        title=strip(F.coalesce(F.col("r.title"), F.lit(""))),
        company=F.coalesce(
            company_name(F.col("r.company")), blank_to_null(F.col("r.companyName")),
            F.lit(f"{source.capitalize()} Employer"),
        ),
        apply_url=first_usable(*[F.col(f"r.{k}") for k in CONNECTOR_URL_KEYS]),
        place_text=F.coalesce(blank_to_null(F.col("r.location")), F.lit(country)),
        description=strip_html(F.col("r.description")),
        remote_given=F.col("r.remote"),
        currency=currency_for_country(F.lit(country)),
        kind=kind,
        date_text=first_filled(F.col("r.posted_date"), F.col("r.postedAt"), F.col("r.postedDate")),
    )
    typed = df.withColumn(
        "job_type", normalize_job_type(F.lit(source), F.col("kind"), F.col("title"), F.col("description"))
    )
    return _posting(typed, source, as_of, country=country)


READERS: dict[str, Callable[..., DataFrame]] = {
    "adzuna": adzuna, "jsearch": jsearch, "greenhouse": greenhouse, "lever": lever, "remotive": remotive,
    "google_jobs": google_jobs,
}


def normalize_batch(landed: DataFrame, sources: list[str], as_of: Column, country: str = "us") -> DataFrame:
    """Route each landed row to its source's reader; one partition-pruned branch per source."""
    out = None
    for s in sources:
        rows = landed.where(F.col("source") == s)
        if s in ("greenhouse", "lever"):
            one = READERS[s](rows, as_of)
        elif s in READERS:
            one = READERS[s](rows, as_of, country)
        else:
            one = connector(rows, as_of, s, country)
        out = one if out is None else out.unionByName(one)
    return out
