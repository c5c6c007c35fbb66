"""Board and actor responses (lists of items) to listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.jobs import job_type_from_text, schedule_job_type
from postlake.functions.links import direct_url_for_portal
from postlake.functions.text import blank_to_null, first_filled, strip
from postlake.sources.postings import GOOGLE_SCHEMA, company_name

LISTING_COLUMNS = ["ord", "title", "company", "url", "location", "remote", "job_type", "posted_text", "description", "portal"]


def _items(landed: DataFrame, schema: str, path: str) -> DataFrame:
    parsed = landed.select("ord", F.from_json("raw", schema).alias("p"))
    return parsed.select("ord", F.posexplode(path).alias("pos", "i"))


def _listing(items: DataFrame, portal: str | Column, **cols: Column) -> DataFrame:
    named = items.select("ord", *[c.alias(k) for k, c in cols.items()],
                         (F.lit(portal) if isinstance(portal, str) else portal).alias("portal"))
    extra = [k for k in cols if k not in LISTING_COLUMNS]
    kept = named.where(F.col("title").isNotNull() & (F.col("title") != "") & F.col("url").isNotNull() & (F.col("url") != ""))
    return kept.select(*LISTING_COLUMNS, *extra)


def _is_remote(location: Column) -> Column:
    return F.lower(F.coalesce(location, F.lit(""))).contains("remote")


def _or(value: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(value), F.lit(default))


def usajobs(landed: DataFrame) -> DataFrame:
    items = _items(
        landed,
        "SearchResult STRUCT<SearchResultItems: ARRAY<STRUCT<MatchedObjectDescriptor: STRUCT<PositionTitle: STRING, "
        "OrganizationName: STRING, DepartmentName: STRING, ApplyURI: ARRAY<STRING>, PositionURI: STRING, "
        "PositionLocation: ARRAY<STRUCT<CityName: STRING, StateCountrySubDivisionCode: STRING>>, "
        "PositionRemuneration: ARRAY<STRUCT<Description: STRING, MinimumRange: STRING, MaximumRange: STRING, "
        "RateIntervalCode: STRING>>, PositionSchedule: ARRAY<STRUCT<Code: STRING, Name: STRING>>, "
        "PublicationStartDate: STRING, QualificationSummary: STRING, "
        "UserArea: STRUCT<Details: STRUCT<JobSummary: STRING>>>>>>",
        "p.SearchResult.SearchResultItems",
    )
    d = "i.MatchedObjectDescriptor."
    places = F.col(d + "PositionLocation")
    place = F.when(
        F.size(places) > 0,
        F.array_join(
            F.transform(
                places,
                lambda x: F.concat(
                    F.coalesce(x["CityName"], F.lit("")), F.lit(", "), F.coalesce(x["StateCountrySubDivisionCode"], F.lit(""))
                ),
            ),
            ", ",
        ),
    ).otherwise(F.lit("United States"))
    pay = F.col(d + "PositionRemuneration")
    empty = F.array().cast("array<string>")
    schedule = F.concat(
        F.coalesce(F.col(d + "PositionSchedule.Name"), empty), F.coalesce(F.col(d + "PositionSchedule.Code"), empty)
    )
    first_pay = F.get(pay, F.lit(0))
    lo, hi = blank_to_null(first_pay["MinimumRange"]), blank_to_null(first_pay["MaximumRange"])
    return _listing(
        items,
        "usajobs",
        title=strip(F.col(d + "PositionTitle")),
        company=F.coalesce(
            first_filled(F.col(d + "OrganizationName"), F.col(d + "DepartmentName")), F.lit("U.S. Federal Government")
        ),
        url=first_filled(F.get(F.col(d + "ApplyURI"), F.lit(0)), F.col(d + "PositionURI")),
        location=strip(place),
        remote=F.coalesce(F.exists(pay, lambda x: _is_remote(x["Description"])), F.lit(False)) | _is_remote(place),
        job_type=schedule_job_type(F.transform(schedule, lambda x: F.lower(F.coalesce(x, F.lit(""))))),
        posted_text=F.col(d + "PublicationStartDate"),
        description=F.coalesce(
            first_filled(F.col(d + "UserArea.Details.JobSummary"), F.col(d + "QualificationSummary")), F.lit("")
        ),
        salary_text=F.when(
            lo.isNotNull() & hi.isNotNull(),
            strip(F.concat(F.lit("$"), lo, F.lit("–$"), hi, F.lit(" "), F.coalesce(first_pay["RateIntervalCode"], F.lit("")))),
        ).otherwise(F.lit("")),
        eligibility_note=F.lit(V.US_ELIGIBILITY_NOTE),
    )


def careerbuilder(landed: DataFrame) -> DataFrame:
    items = _items(
        landed,
        "ResponseJobSearch STRUCT<Results: ARRAY<STRUCT<JobTitle: STRING, JobDetailsURL: STRING, "
        "DescriptionTeaser: STRING, EmploymentType: STRING, Company: STRING, Location: STRING, PostedDate: STRING>>>",
        "p.ResponseJobSearch.Results",
    )
    return _listing(
        items,
        "careerbuilder",
        title=strip(F.col("i.JobTitle")),
        company=strip(F.coalesce("i.Company", F.lit("CareerBuilder Employer"))),
        url=strip(F.col("i.JobDetailsURL")),
        location=strip(F.coalesce("i.Location", F.lit("Remote"))),
        remote=_is_remote(F.col("i.Location")),
        job_type=job_type_from_text(F.concat_ws(" ", "i.EmploymentType", "i.DescriptionTeaser")),
        posted_text=F.col("i.PostedDate"),
        description=strip(F.coalesce("i.DescriptionTeaser", F.lit(""))),
    )


def ziprecruiter(landed: DataFrame) -> DataFrame:
    items = _items(
        landed,
        "jobs ARRAY<STRUCT<name: STRING, title: STRING, job_detail_url: STRING, url: STRING, snippet: STRING, "
        "description: STRING, job_type: STRING, employment_type: STRING, hiring_company: STRUCT<name: STRING>, "
        "location: STRING, remote_position: BOOLEAN, posted_time: STRING, date_posted: STRING>>",
        "p.jobs",
    )
    text = F.coalesce(first_filled(F.col("i.snippet"), F.col("i.description")), F.lit(""))
    kind = first_filled(F.col("i.job_type"), F.col("i.employment_type"))
    return _listing(
        items,
        "ziprecruiter",
        title=first_filled(F.col("i.name"), F.col("i.title")),
        company=_or(F.col("i.hiring_company.name"), "ZipRecruiter Employer"),
        url=first_filled(F.col("i.job_detail_url"), F.col("i.url")),
        location=_or(F.col("i.location"), "Remote"),
        remote=F.coalesce("i.remote_position", F.lit(False)) | _is_remote(F.col("i.location")),
        job_type=job_type_from_text(F.concat_ws(" ", kind, text)),
        posted_text=first_filled(F.col("i.posted_time"), F.col("i.date_posted")),
        description=text,
    )


# Field aliases per actor family, tried in order.
ACTOR_ALIASES = {
    "indeed": {
        "title": ["title", "positionName", "position", "jobTitle"],
        "url": ["url", "externalApplyLink", "jobUrl", "link", "externalApplyUrl"],
        "company": ["company", "companyName", "employer"],
        "location": ["location", "displayLocation", "city"],
        "kind": ["jobType", "contractType"],
        "description": ["description", "snippet", "summary"],
        "posted": ["postedAt", "postedDate", "created"],
    },
    "dice": {
        "title": ["title", "positionName", "jobTitle"],
        "url": ["url", "link", "jobUrl", "applyUrl"],
        "company": ["company", "companyName"],
        "location": ["location"],
        "kind": ["employmentType", "jobType", "contractType"],
        "description": ["description", "summary"],
        "posted": ["postedAt", "postedDate"],
    },
    "linkedin": {
        "title": ["title", "positionName", "jobTitle", "role"],
        "url": ["link", "url", "jobUrl", "jobURL", "applyUrl"],
        "company": ["companyName", "company"],
        "location": ["location"],
        "kind": ["employmentType", "contractType"],
        "description": ["descriptionText", "description"],
        "posted": ["postedAt", "postedDate"],
    },
    "glassdoor": {
        "title": ["title", "jobTitle", "positionName", "position"],
        "url": ["url", "link", "jobUrl", "applyUrl"],
        "company": ["companyName", "company"],
        "location": ["location"],
        "kind": ["contractType"],
        "description": ["description"],
        "posted": ["postedAt", "postedDate"],
    },
}
ACTOR_DEFAULTS = {  # (location, kind when the item names none)
    "indeed": ("US", "full_time"), "dice": ("Remote", ""), "linkedin": ("US", "Full-time"), "glassdoor": ("US", "full_time"),
}


def actor_items(landed: DataFrame, portal: str) -> DataFrame:
    alias = ACTOR_ALIASES[portal]
    # Alias names differ by case only in places, so the item is read as a map.
    items = landed.select("ord", F.from_json("raw", "MAP<STRING, STRING>").alias("i"))
    field = lambda k: F.try_element_at("i", F.lit(k))
    place, kind = ACTOR_DEFAULTS[portal]
    of = lambda f: first_filled(*[field(k) for k in alias[f]])
    company = F.coalesce(*[company_name(field(k)) for k in alias["company"]], F.lit(f"{V_NAMES[portal]} Employer"))
    description = F.coalesce(of("description"), F.lit(""))
    remote = _is_remote(of("location"))
    job_type = F.coalesce(of("kind"), F.lit(kind))
    if portal == "dice":
        job_type = job_type_from_text(F.concat_ws(" ", job_type, description))
    if portal == "indeed":
        remote = remote | F.lower(F.coalesce(of("location"), F.lit(""))).contains("wfh") | F.lower(of("title")).contains("work from home")
    return _listing(
        items, portal, title=of("title"), company=company, url=of("url"), location=F.coalesce(of("location"), F.lit(place)),
        remote=remote, job_type=job_type, posted_text=of("posted"), description=description,
    )


V_NAMES = {"indeed": "Indeed", "dice": "Dice", "linkedin": "LinkedIn", "glassdoor": "Glassdoor"}


def extracted_json(landed: DataFrame, portal: str) -> DataFrame:
    items = _items(
        landed,
        "data STRUCT<json: STRUCT<jobs: ARRAY<STRUCT<title: STRING, company: STRING, url: STRING, location: STRING, "
        "remote: BOOLEAN, job_type: STRING, posted_date: STRING, description: STRING>>>>",
        "p.data.json.jobs",
    )
    rows = _listing(
        items,
        portal,
        title=strip(F.col("i.title")),
        company=_or(F.col("i.company"), f"{portal.title()} Employer"),
        url=strip(F.col("i.url")),
        location=F.coalesce(strip(F.col("i.location")), F.lit("")),
        remote=F.coalesce("i.remote", F.lit(False)),
        job_type=_or(F.col("i.job_type"), "unknown"),
        posted_text=F.col("i.posted_date"),
        description=F.coalesce(strip(F.col("i.description")), F.lit("")),
    )
    return rows.where(F.col("url").startswith("http"))


def remoteok(landed: DataFrame) -> DataFrame:
    """Element 0 of the list is a notice, not a posting."""
    parsed = landed.select(
        "ord",
        F.posexplode(
            F.from_json(
                "raw",
                "ARRAY<STRUCT<position: STRING, company: STRING, url: STRING, id: STRING, location: STRING, date: STRING, "
                "description: STRING>>",
            )
        ).alias("pos", "i"),
    )
    return _listing(
        parsed.where(F.col("pos") > 0),
        "remoteok",
        title=F.col("i.position"),
        company=F.col("i.company"),
        url=F.coalesce(blank_to_null(F.col("i.url")), F.concat(F.lit("https://remoteok.com/l/"), F.col("i.id"))),
        location=_or(F.col("i.location"), "Remote"),
        remote=F.lit(True),
        job_type=F.lit("contract"),
        posted_text=F.col("i.date"),
        description=F.col("i.description"),
    )


def remotive_api(landed: DataFrame) -> DataFrame:
    items = _items(
        landed,
        "jobs ARRAY<STRUCT<title: STRING, company_name: STRING, company: STRING, url: STRING, link: STRING, "
        "candidate_required_location: STRING, location: STRING, job_type: STRING, publication_date: STRING, "
        "sub_date: STRING, description: STRING>>",
        "p.jobs",
    )
    return _listing(
        items,
        "remotive",
        title=F.col("i.title"),
        company=first_filled(F.col("i.company_name"), F.col("i.company")),
        url=first_filled(F.col("i.url"), F.col("i.link")),
        location=F.coalesce(first_filled(F.col("i.candidate_required_location"), F.col("i.location")), F.lit("Remote")),
        remote=F.lit(True),
        job_type=F.coalesce("i.job_type", F.lit("contract")),
        posted_text=first_filled(F.col("i.publication_date"), F.col("i.sub_date")),
        description=F.col("i.description"),
    )


def scoped_serp(landed: DataFrame) -> DataFrame:
    """Aggregator items kept only where they carry a direct link for the wanted ``portal`` column."""
    items = landed.select("ord", "portal", F.from_json("raw", GOOGLE_SCHEMA).alias("i"))
    link = direct_url_for_portal(F.col("portal"), F.col("i.apply_options.link"), F.col("i.related_links.link"))
    text = F.concat_ws(" ", "i.detected_extensions.schedule_type", "i.description")
    return _listing(
        items.withColumn("_p", F.col("portal")),
        F.col("_p"),
        title=strip(F.col("i.title")),
        company=strip(F.coalesce("i.company_name", F.concat(F.initcap("portal"), F.lit(" Employer")))),
        url=link,
        location=F.coalesce("i.location", F.lit("")),
        remote=_is_remote(F.col("i.location")),
        job_type=job_type_from_text(
            text, ["contract", "freelance", "c2c"], ["part-time", "part time"], ["full-time", "full time", "permanent"]
        ),
        posted_text=F.col("i.detected_extensions.posted_at"),
        description=strip(F.coalesce("i.description", F.lit(""))),
        source_note=F.when(F.col("portal").isin(V.AGGREGATED_ONLY_PORTALS), F.lit(V.AGGREGATED_NOTE)),
    )
