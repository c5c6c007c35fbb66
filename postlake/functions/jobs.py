"""Titles, job types, remote flags, currencies and places of a posting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.text import contains_any, let, strip


def canonical_title(title: Column) -> Column:
    t = F.lower(F.trim(title))
    out = None
    for name, parts, words in V.CANONICAL_TITLE_RULES:
        hit = contains_any(t, parts)
        for w in words:
            hit = hit | t.rlike(rf"(?U)\b{w}\b")
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def normalize_job_type(portal: Column, raw: Column, title: Column, description: Column) -> Column:
    def by_words(text: Column) -> Column:
        out = None
        for name, words in V.JOB_TYPE_WORDS:
            hit = contains_any(text, words)
            out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
        return out.otherwise(F.lit("unknown"))

    text = F.lower(F.concat_ws(" ", F.coalesce(raw, F.lit("")), title, description))
    fixed = F.lower(F.trim(portal)).isin(V.CONTRACT_ONLY_PORTALS)
    return F.when(fixed, F.lit("contract")).otherwise(let(text, by_words))


def canonical_job_type(raw: Column) -> Column:
    """Filter vocabulary; NULL means "no usable signal"."""
    s = F.lower(strip(raw))
    out = None
    for name, spellings in V.JOB_TYPE_ALIASES.items():
        hit = s.isin(spellings)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def canonical_job_type_literal(raw: str | None) -> str | None:
    s = (raw or "").strip().lower()
    for name, spellings in V.JOB_TYPE_ALIASES.items():
        if s in spellings:
            return name
    return None


def ledger_job_type(raw: Column) -> Column:
    """The same for the ledger key: blank is ``all``, unknown spellings pass through."""
    s = F.coalesce(F.nullif(F.lower(strip(raw)), F.lit("")), F.lit("all"))
    out = None
    for name, spellings in V.LEDGER_JOB_TYPE_ALIASES.items():
        hit = s.isin(spellings)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(s)


def job_type_from_text(
    text: Column,
    contract_words: list[str] = V.LISTING_CONTRACT_WORDS,
    part_words: list[str] = V.LISTING_PART_WORDS,
    full_words: list[str] = V.LISTING_FULL_WORDS,
) -> Column:
    return let(
        F.lower(F.coalesce(text, F.lit(""))),
        lambda t: F.when(contains_any(t, contract_words), F.lit("contract"))
        .when(contains_any(t, part_words), F.lit("part_time"))
        .when(contains_any(t, full_words), F.lit("full_time"))
        .otherwise(F.lit("unknown")),
    )


def schedule_job_type(codes: Column) -> Column:
    """Job type of a list of schedule names and codes."""
    combined = F.lower(F.array_join(codes, " "))
    clean = F.transform(codes, lambda c: F.trim(c))
    return (
        F.when(F.exists(clean, lambda c: (c == "1") | (c == "full") | c.contains("full")), F.lit("full_time"))
        .when(F.exists(clean, lambda c: (c == "2") | (c == "part") | c.contains("part")), F.lit("part_time"))
        .when(contains_any(combined, ["contract", "intermittent", "4"]), F.lit("contract"))
        .otherwise(F.lit("unknown"))
    )


def detect_remote(title: Column, description: Column, location: Column) -> Column:
    pattern = r"(?U)\b(" + "|".join(V.REMOTE_WORDS) + r")\b"
    # The plain substring test rules out most texts before the pattern runs.
    return let(
        F.lower(F.concat_ws(" ", title, description, location)),
        lambda text: contains_any(text, V.REMOTE_WORDS) & text.rlike(pattern),
    )


def currency_for_country(country: Column) -> Column:
    pairs = [F.lit(x) for kv in V.CURRENCY_BY_COUNTRY.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(country))


def _any_equal_or_prefix(text: Column, names: list[str], prefixes: list[str]) -> Column:
    hit = text.isin(names)
    for p in prefixes:
        hit = hit | text.startswith(p)
    return hit


def city_country(location: Column, default_country: Column, compat: bool = False) -> Column:
    """``struct(city, country)`` of a location text.

    The state token must be exactly two letters and cities match whole words; ``compat``
    brings back the two looser readings (first two letters, bare substrings).
    """
    default = F.upper(F.trim(default_country))
    loc = strip(location)
    low = F.lower(loc)

    whole = None  # location that names a place wider than a city
    rules = [(_any_equal_or_prefix(low, V.GLOBAL_PLACES, V.GLOBAL_PLACE_PREFIXES), "Remote / Global")]
    rules += [(contains_any(low, words), region) for region, words in V.REGIONS]
    rules += [(_any_equal_or_prefix(low, exact, prefixes), code) for code, prefixes, exact in V.COUNTRY_ONLY]
    for hit, name in rules:
        whole = F.when(hit, F.lit(name)) if whole is None else whole.when(hit, F.lit(name))

    head = strip(F.get(F.split(loc, "-", 2), F.lit(0)))
    coded = loc.contains("-") & head.rlike("^[A-Za-z]{2}$")
    rest = F.nullif(strip(F.get(F.split(loc, "-", 2), F.lit(1))), F.lit(""))
    parts = F.filter(F.transform(F.split(loc, ","), strip), lambda p: p != "")
    first_part = F.coalesce(F.get(parts, F.lit(0)), loc)
    city = F.coalesce(F.when(coded, rest), first_part)

    state = F.regexp_replace(F.upper(F.get(parts, F.lit(1))), "[^A-Z]", "")
    if compat:
        state = F.substring(state, 1, 2)
    country = F.when(coded, F.upper(head)).when(state.isin(V.US_STATES), F.lit("US"))
    for code, cities, names in V.CITY_COUNTRY:
        if compat:
            hit = contains_any(low, cities + names)
        else:
            hit = low.rlike(r"\b(" + "|".join(re.escape(w) for w in cities + names) + r")\b")
        country = country.when(hit, F.lit(code))
    country = country.otherwise(default)
    kept_city = F.when(~F.upper(city).eqNullSafe(country), F.substring(city, 1, 100))

    empty = loc.isNull() | (loc == "")
    return F.struct(
        F.when(empty | whole.isNotNull(), F.lit(None).cast("string")).otherwise(kept_city).alias("city"),
        F.when(empty, default).otherwise(F.coalesce(whole, F.substring(country, 1, 100), default)).alias("country"),
    )
