"""HTML character references as a Column expression, with the standard library's names and corrections."""

from __future__ import annotations

import html
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference after its "&": a number, or a name of up to 32 characters, with or without ";".
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_UNKNOWN = "\ufffd"
_LAST = 0x10FFFF
_TO_END = 2**31 - 1
#: Looked up first; a map literal is searched from its start.
_COMMON = ["amp;", "nbsp;", "lt;", "gt;", "quot;", "apos;"]


def _map_literal(entries: dict[str, str]) -> Column:
    """A constant map made from one string, so that the plan does not carry a literal for each key and value."""
    text = "\u0002".join(f"{k}\u0001{v}" for k, v in entries.items())
    return F.str_to_map(F.lit(text), F.lit("\u0002"), F.lit("\u0001"))


@cache
def _names() -> dict[str, str]:
    legacy = {k for k in html5 if not k.endswith(";")}
    rank = lambda k: (_COMMON.index(k) if k in _COMMON else len(_COMMON), k.rstrip(";") not in legacy, k)
    return {k: html5[k] for k in sorted(html5, key=rank)}


@cache
def _open_names() -> str:
    """Pattern of the names that need no ";", longest first."""
    return "^(" + "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))) + ")"


@cache
def _corrected() -> dict[str, str]:
    """Control codes and the like, which the standard library replaces or drops."""
    return {str(n): html.unescape(f"&#{n};") for n in range(160) if html.unescape(f"&#{n};") != chr(n)}


def _character(digits: Column, base: int) -> Column:
    """Text of a numeric reference; ``digits`` may be longer than any number type."""
    bare = F.ltrim(digits, F.lit("0"))
    number = F.coalesce(F.conv(F.when(F.length(bare) <= 7, bare), base, 10).cast("bigint"), F.lit(_LAST + 1))

    def text(n: Column) -> Column:
        low = n.bitwiseAND(F.lit(0xFFFF))
        code = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return (
            F.when(n < 160, F.coalesce(F.try_element_at(_map_literal(_corrected()), n.cast("string")), code))
            .when(n.between(0xD800, 0xDFFF) | (n > _LAST), F.lit(_UNKNOWN))
            .when(n.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE), F.lit(""))
            .when(n == 0xFEFF, F.lit("\ufeff"))  # the decoder would take it for a byte order mark
            .otherwise(code)
        )

    return F.get(F.transform(F.array(F.when(bare == "", F.lit(0).cast("bigint")).otherwise(number)), text), F.lit(0))


def _decode(piece: Column) -> Column:
    """A piece of text that followed an "&"."""
    names = _map_literal(_names())
    after = lambda ref: F.substring(piece, F.length(ref) + 1, F.lit(_TO_END))

    def named(ref: Column) -> Column:
        short = F.regexp_extract(piece, _open_names(), 1)
        whole = F.concat(F.try_element_at(names, ref), after(ref))
        start = F.concat(F.try_element_at(names, F.nullif(short, F.lit(""))), after(short))
        return F.coalesce(whole, start, F.concat(F.lit("&"), piece))

    def numbered(ref: Column) -> Column:
        digits = F.rtrim(F.substring(ref, F.lit(2), F.lit(_TO_END)), F.lit(";"))
        hexadecimal = F.lower(F.substring(digits, 1, 1)) == "x"
        text = F.when(hexadecimal, _character(F.substring(digits, F.lit(2), F.lit(_TO_END)), 16)).otherwise(_character(digits, 10))
        return F.concat(text, after(ref))

    def decoded(ref: Column) -> Column:
        return F.when(ref == "", F.concat(F.lit("&"), piece)).when(ref.startswith("#"), numbered(ref)).otherwise(named(ref))

    return F.get(F.transform(F.array(F.regexp_extract(piece, _REFERENCE, 1)), decoded), F.lit(0))


def unescape(text: Column) -> Column:
    """Named and numeric character references to characters; texts without "&" are left as they are."""

    def pieces(p: Column) -> Column:
        rest = F.transform(F.slice(p, F.lit(2), F.size(p)), _decode)
        return F.concat(F.get(p, F.lit(0)), F.array_join(rest, ""))

    return F.when(text.contains("&"), F.get(F.transform(F.array(F.split(text, "&")), pieces), F.lit(0))).otherwise(text)
