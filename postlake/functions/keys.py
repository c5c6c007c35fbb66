"""Hash keys; JSON text is built with a fixed key order so that hashes are byte-exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.dates import date_bucket, window_minutes
from postlake.functions.jobs import ledger_job_type
from postlake.functions.text import keyword_key, strip


_SHORT_ESCAPES = {"\n": "n", "\r": "r", "\t": "t", "\b": "b", "\f": "f"}


def _escaped(ch: Column) -> Column:
    """A character as JSON in ASCII; one beyond the basic plane becomes two escapes."""
    out = F.when(ch.isin("\\", '"'), F.concat(F.lit("\\"), ch))
    for raw, letter in _SHORT_ESCAPES.items():
        out = out.when(ch == raw, F.lit("\\" + letter))
    units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
    return out.when(ch.between(" ", "~"), ch).otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))


def json_string(c: Column) -> Column:
    """JSON string literal, ASCII-only like the default Python encoder."""
    text = F.when(c.rlike(r'[^ -~]|[\\"]'), F.array_join(F.transform(F.split(c, ""), _escaped), "")).otherwise(c)
    return F.concat(F.lit('"'), text, F.lit('"'))


def _scalar(c: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(strip(c)), F.lit("")), F.lit("all"))


def cache_key_json(title: Column, q: Column, platform: Column, country: Column, remote: Column, job_type: Column,
                   date_posted: Column) -> Column:
    keywords = keyword_key(F.concat_ws(",", keyword_key(title), keyword_key(q)))
    return F.concat(
        F.lit('{"country":'), json_string(_scalar(country)),
        F.lit(',"date_bucket":'), json_string(date_bucket(window_minutes(date_posted))),
        F.lit(',"job_type":'), json_string(ledger_job_type(job_type)),
        F.lit(',"keywords":'), json_string(keywords),
        F.lit(',"platform":'), json_string(_scalar(platform)),
        F.lit(',"remote_only":'), F.when(F.coalesce(remote, F.lit(False)), F.lit("true")).otherwise(F.lit("false")),
        F.lit("}"),
    )


def cache_key(*parts: Column) -> Column:
    return F.sha2(cache_key_json(*parts), 256)


def filter_hash(title: Column, platform: Column, country: Column, remote: Column, date_posted: Column,
                job_type: Column, q: Column) -> Column:
    text = F.concat(
        F.lit('{"country": '), json_string(country),
        F.lit(', "date_posted": '), json_string(date_posted),
        F.lit(', "job_title": '), json_string(title),
        F.lit(', "job_type": '), json_string(job_type),
        F.lit(', "platform": '), json_string(platform),
        F.lit(', "q": '), json_string(F.coalesce(q, F.lit(""))),
        F.lit(', "remote_only": '), F.when(remote, F.lit("true")).otherwise(F.lit("false")),
        F.lit("}"),
    )
    return F.sha2(text, 256)


def raw_hash(title: Column, company: Column, portal: Column, posted: Column) -> Column:
    """sha256 of title, company, portal and date, trimmed and lower-cased, joined by a bar."""
    stamp = F.coalesce(F.date_format(posted, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("none"))
    return F.sha2(F.concat_ws("|", *[F.lower(strip(c)) for c in (title, company, portal)], stamp), 256)


def tier_key(title: Column, company: Column, portal: Column) -> Column:
    return F.md5(F.concat_ws("_", F.lower(title), F.lower(company), portal))
