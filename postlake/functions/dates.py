"""Posting dates: parsing, precision grades, windows and the freshness predicate.

All timestamps are ``TIMESTAMP_NTZ`` holding UTC and "now" is always an explicit ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.text import strip

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_RFC = (
    r"^(?:[a-z]{3,9},?\s+)?(\d{1,2})\s+([a-z]{3,9})\s+(\d{4}|\d{2})"
    r"(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(z|gmt|utc|ut|[ecmp][sd]t|[+-]\d{4})?)?$"
)
_ISO = (
    r"^(\d{4})-(\d{2})-(\d{2})(?:[t ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?\s*(z|[+-]\d{2}:?\d{2})?)?$"
)
_MONTH_FIRST = r"^([a-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})$"
_SLASHES = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
_RELATIVE = r"(\d+)\s*\+?\s*(minute|min|hour|hr|day|week|month|year)s?\s*ago"


def ts(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def micros(t: Column) -> Column:
    """Microseconds since the epoch of a UTC wall-clock stamp."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), t)


def from_micros(us: Column) -> Column:
    """The UTC wall-clock stamp that many microseconds after the epoch."""
    return F.timestamp_add("MICROSECOND", us, F.expr(_EPOCH))


def add_minutes(t: Column, minutes: Column | int) -> Column:
    return F.timestamp_add("MINUTE", minutes if isinstance(minutes, Column) else F.lit(minutes), t)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact difference in seconds (microsecond resolution)."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1_000_000.0)


def age_hours(t: Column, as_of: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", t, as_of) / F.lit(3_600_000_000.0)


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def _month_number(word: Column) -> Column:
    at = F.instr(F.lit(_MONTHS), F.substring(word, 1, 3))
    return F.when((at > 0) & ((at - 1) % 3 == 0), ((at + 2) / 3).cast("int"))


def _offset_minutes(zone: Column) -> Column:
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    hours = F.create_map(*(F.lit(x) for pair in V.MAIL_ZONE_HOURS.items() for x in pair))
    named = F.coalesce(F.try_element_at(hours, zone), F.lit(0)) * 60
    return F.when(zone.startswith("+"), minutes).when(zone.startswith("-"), -minutes).otherwise(named)


def _full_year(y: Column) -> Column:
    """Two-digit years of mail dates: 69 and later are of the last century."""
    return F.when(y < 69, y + 2000).when(y < 100, y + 1900).otherwise(y)


def _build(y: Column, mo: Column, d: Column, h: Column, mi: Column, sec: Column, zone: Column) -> Column:
    zero = F.lit(0)
    local = F.try_make_timestamp_ntz(
        y, mo, d, F.coalesce(h, zero), F.coalesce(mi, zero), F.coalesce(sec, zero).cast("decimal(8,6)")
    )
    return add_minutes(local, -F.coalesce(_offset_minutes(zone), zero))


def _calendar(text: Column) -> Column:
    """RFC 822, ISO and the three free forms; anything else is NULL."""
    rfc = lambda i: F.regexp_extract(text, _RFC, i)
    iso = lambda i: F.regexp_extract(text, _ISO, i)
    named = lambda i: F.regexp_extract(text, _MONTH_FIRST, i)
    slash = lambda i: F.regexp_extract(text, _SLASHES, i)
    none = F.lit(None).cast("int")
    fraction = F.concat(iso(6), F.lit("."), F.rpad(iso(7), 6, "0")).try_cast("decimal(8,6)")
    return (
        F.when(
            text.rlike(_RFC),
            _build(_full_year(_int(rfc(3))), _month_number(rfc(2)), _int(rfc(1)), _int(rfc(4)), _int(rfc(5)), _int(rfc(6)), rfc(7)),
        )
        .when(
            text.rlike(_ISO),
            _build(_int(iso(1)), _int(iso(2)), _int(iso(3)), _int(iso(4)), _int(iso(5)), fraction, iso(8)),
        )
        .when(
            text.rlike(_MONTH_FIRST),
            _build(_int(named(3)), _month_number(named(1)), _int(named(2)), none, none, none, F.lit("")),
        )
        .when(
            text.rlike(_SLASHES),
            _build(_int(slash(3)), _int(slash(1)), _int(slash(2)), none, none, none, F.lit("")),
        )
    )


def _relative_minutes(text: Column) -> Column:
    n = F.regexp_extract(text, _RELATIVE, 1).try_cast("bigint")
    unit = F.regexp_extract(text, _RELATIVE, 2)
    scale = (
        F.when(unit.isin("minute", "min"), 1).when(unit.isin("hour", "hr"), 60).when(unit == "day", 1440)
        .when(unit == "week", 10080).when(unit == "month", 43200).when(unit == "year", 525600)
    )
    # Offsets that leave the calendar are unparseable, not an arithmetic error.
    return F.when(n <= F.lit(1_000_000_000) / scale, n * scale)


def parse_posted_date(value: Column, as_of: Column) -> Column:
    """Date text, relative text or epoch (seconds, or milliseconds above 1e11) to a UTC timestamp."""
    s = strip(value)
    low = F.lower(s)
    num = s.try_cast("double")
    seconds = F.when(num > 1e11, num / 1000.0).otherwise(num)
    epoch = F.when(
        seconds < 253402300800.0,
        F.timestamp_add("MICROSECOND", F.round(seconds * 1_000_000).cast("bigint"), F.expr(_EPOCH)),
    )
    weekday = F.lit(False)
    for d in V.WEEKDAYS:
        weekday = weekday | low.contains(d)
    return (
        F.when(s.isNull() | (s == ""), F.lit(None).cast("timestamp_ntz"))
        .when(s.rlike("^[0-9]+$"), epoch)
        .when(low.isin("today", "just now", "just posted", "posted today"), as_of)
        .when(low.isin("yesterday", "posted yesterday"), add_minutes(as_of, -1440))
        .when(~weekday & low.rlike(_RELATIVE), add_minutes(as_of, -_relative_minutes(low)))
        .when(~weekday & low.contains("ago"), F.lit(None).cast("timestamp_ntz"))
        .otherwise(_calendar(low))
    )


def parse_epoch(value: Column) -> Column:
    """Numeric epoch field (seconds, or milliseconds above 1e11)."""
    v = value.cast("double")
    seconds = F.when(v > 1e11, v / 1000.0).otherwise(v)
    return F.when(v != 0, F.timestamp_add("MICROSECOND", F.round(seconds * 1_000_000).cast("bigint"), F.expr(_EPOCH)))


def precision_from_raw(raw: Column, portal: Column, is_number: Column | None = None) -> Column:
    t = F.lower(strip(raw))
    has = lambda *w: F.greatest(*[t.contains(x) for x in w]) if len(w) > 1 else t.contains(w[0])
    number = is_number if is_number is not None else F.lit(False)
    return (
        F.when(t.isNull() | (t == ""), F.lit("unknown"))
        .when(number, F.lit("exact"))
        .when(has("week", "month", "year"), F.lit("week"))
        .when(has("day", "yesterday"), F.lit("day"))
        .when(has("hour", "hr", "minute", "min"), F.lit("hour"))
        .when(has("just posted", "just now"), F.lit("hour"))
        .when(has("today"), F.lit("day"))
        .when(F.lower(F.trim(portal)).isin(V.EXACT_PRECISION_PORTALS), F.lit("exact"))
        .when(
            (t.contains("t") | t.contains(" ")) & t.contains(":"),
            F.when(t.endswith("00:00:00") | t.contains(" 00:00:00"), F.lit("day")).otherwise(F.lit("exact")),
        )
        .otherwise(F.lit("day"))
    )


def precision_from_stored(posted: Column, portal: Column) -> Column:
    return (
        F.when(posted.isNull(), F.lit("unknown"))
        .when(posted == F.date_trunc("day", posted).cast("timestamp_ntz"), F.lit("day"))
        .when(F.lower(F.trim(portal)).isin(V.EXACT_PRECISION_PORTALS), F.lit("exact"))
        .otherwise(F.lit("day"))
    )


def effective_freshness(posted: Column, precision: Column, scraped: Column, fetched: Column, portal: Column) -> Column:
    """``struct(ts, precision, field)``: the posting date, else the earlier sighting, else nothing."""
    seen = F.least(scraped, fetched)  # skips NULLs
    known = precision.isin(V.PRECISIONS)
    return F.struct(
        F.coalesce(posted, seen).alias("ts"),
        F.when(posted.isNull(), F.lit("unknown"))
        .when(known, precision)
        .otherwise(precision_from_stored(posted, portal))
        .alias("precision"),
        F.when(posted.isNotNull(), F.lit("posted_date"))
        .when(seen.isNotNull(), F.lit("first_seen"))
        .otherwise(F.lit("none"))
        .alias("field"),
    )


def freshness_reason(eff_ts: Column, field: Column, window_minutes: Column, as_of: Column) -> Column:
    """Reason code of the freshness check; codes that start with ``ok`` pass.

    A tight window (24 h or less) never admits a row without a published date: the first
    sighting is not the posting age.
    """
    tight = window_minutes <= V.TIGHT_WINDOW
    inside = eff_ts >= add_minutes(as_of, -window_minutes)
    return (
        F.when(eff_ts.isNull() & tight, F.lit("no_date_signal_excluded_from_tight_window"))
        .when(eff_ts.isNull(), F.lit("ok_no_date_signal_passes_wide_window"))
        .when((field == "first_seen") & tight, F.lit("posting_date_not_published_excluded_from_tight_window"))
        .when((field == "first_seen") & inside, F.lit("ok_first_seen"))
        .when(field == "first_seen", F.lit("stale_first_seen"))
        .when(inside, F.lit("ok_posted_date"))
        .otherwise(F.lit("stale_posted_date"))
    )


def is_fresh(eff_ts: Column, field: Column, window_minutes: Column, as_of: Column) -> Column:
    return freshness_reason(eff_ts, field, window_minutes, as_of).startswith("ok")


def window_minutes(date_posted: Column) -> Column:
    key = F.lower(strip(date_posted))
    out = F.when(key.isNull() | (key == ""), F.lit(V.DEFAULT_WINDOW)).when(key.isin(V.DATE_WINDOW_ALL), F.lit(V.MAX_WINDOW))
    for name, minutes in V.DATE_WINDOWS.items():
        out = out.when(key == name, F.lit(minutes))
    return out.otherwise(F.lit(V.DEFAULT_WINDOW))


def window_minutes_literal(date_posted: str | None) -> int:
    key = (date_posted or "").strip().lower()
    if not key:
        return V.DEFAULT_WINDOW
    if key in V.DATE_WINDOW_ALL:
        return V.MAX_WINDOW
    return V.DATE_WINDOWS.get(key, V.DEFAULT_WINDOW)


def date_bucket(minutes: Column) -> Column:
    return (
        F.when(minutes <= 720, F.lit("12h")).when(minutes <= 1440, F.lit("24h"))
        .when(minutes <= 10080, F.lit("7d")).otherwise(F.lit("30d"))
    )


def cache_policy(bucket: Column) -> dict[str, Column]:
    """serve_minutes, refresh_mode, delta_hours and recency_hours of a bucket."""
    out: dict[str, Column] = {}
    for i, (field, kind) in enumerate(
        [("serve_minutes", "int"), ("refresh_mode", "string"), ("delta_hours", "int"), ("recency_hours", "int")]
    ):
        e = None
        for name, policy in V.CACHE_POLICY.items():
            value = F.lit(policy[i]).cast(kind)
            e = F.when(bucket == name, value) if e is None else e.when(bucket == name, value)
        out[field] = e
    return out


def is_impossible(posted: Column, scraped: Column, hours: float = V.IMPOSSIBLE_DATE_HOURS) -> Column:
    """Posted well after the posting was first seen."""
    return F.coalesce(posted > add_minutes(scraped, int(hours * 60)), F.lit(False))
