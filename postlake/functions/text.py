"""Text clean-up and tokenising, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.entities import unescape

_BLANK = " \t\n\r\f\u000b "


def strip(c: Column) -> Column:
    """Trim every kind of blank, not only the space character."""
    return F.btrim(c, F.lit(_BLANK))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither NULL nor blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once.

    Conditions are short-circuited, so Spark repeats an expression that several branches share;
    over a long text (a lower-cased description, say) binding it to a lambda variable is far cheaper.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pick(items: list, index: Column) -> Column:
    """``items[index % len(items)]`` as an expression; ``None`` entries stay NULL."""
    arr = F.array(*[F.lit(x).cast("string") if x is None else F.lit(x) for x in items])
    return F.get(arr, F.pmod(index, F.lit(len(items))).cast("int"))


# Blanks as Python's str.split sees them.
_SPACES = "".join(chr(n) for n in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def even_blanks(c: Column) -> Column:
    """Every run of blanks of any kind as one space, none at the ends. A pattern runs only where two spaces meet."""

    def single(t: Column) -> Column:
        return F.trim(F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t))

    return let(F.translate(c, _SPACES, " " * len(_SPACES)), single)


def strip_html(c: Column) -> Column:
    """Entities first, then tags, then blanks; NULL becomes the empty string."""

    def plain(t: Column) -> Column:
        return even_blanks(F.when(t.contains("<"), F.regexp_replace(t, "<[^>]*>", "")).otherwise(t))

    return let(F.coalesce(c, F.lit("")), lambda raw: let(unescape(raw), plain))


def clean_for_match(c: Column) -> Column:
    """Lower-cased words with the common abbreviations rewritten, one blank apart."""
    out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " ")
    for word, full in V.MATCH_REWRITES:
        out = F.regexp_replace(out, rf"(?U)\b{word}\b", full)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def match_signature(title: Column, company: Column, city: Column) -> Column:
    parts = F.array(clean_for_match(title), clean_for_match(company), clean_for_match(city))
    joined = F.array_join(parts, " ")
    return F.trim(joined)


def norm_text(c: Column) -> Column:
    """Keep ``[a-z0-9+#. ]`` and collapse the rest to single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9+#.]+", " "))


def norm_literal(s: str | None) -> str:
    return re.sub("[^a-z0-9+#.]+", " ", (s or "").lower()).strip()


def tokens_of(norm: Column, stop_words: list[str]) -> Column:
    """Words of an already normalised text without the stop words, in order."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(F.split(norm, " "), lambda t: (t != "") & ~F.array_contains(stop, t))


def token_literals(s: str | None, stop_words: list[str]) -> list[str]:
    stop = set(stop_words)
    return [t for t in norm_literal(s).split(" ") if t and t not in stop]


def has_norm_token(raw_lower: Column, token: str) -> Column:
    """Whether ``token`` is a whole word of the normalised text, read straight off the raw text."""
    edge = "[^a-z0-9+#.]"
    # The plain substring test is far cheaper and rules out almost every text.
    return raw_lower.contains(token) & raw_lower.rlike(f"(^|{edge}){re.escape(token)}($|{edge})")


def has_norm_phrase(raw_lower: Column, phrase: str) -> Column:
    """Whether a normalised phrase is a substring of the normalised text, read off the raw text."""
    if " " not in phrase:
        return raw_lower.contains(phrase)
    words = phrase.split(" ")
    return raw_lower.contains(words[0]) & raw_lower.rlike("[^a-z0-9+#.]+".join(re.escape(p) for p in words))


def query_tokens(c: Column) -> Column:
    """Search words: ``[a-zA-Z0-9+#.-]+`` lower-cased, stop words out, edge dots and dashes off."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-zA-Z0-9+#.\-]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in V.QUERY_STOP_WORDS])
    kept = F.filter(raw, lambda t: ~F.array_contains(stop, t))
    return F.filter(F.transform(kept, lambda t: F.btrim(t, F.lit("-."))), lambda t: t != "")


def split_required(tokens: Column) -> tuple[Column, Column]:
    """(required words, modifier words)."""
    mods = F.array(*[F.lit(w) for w in V.MODIFIER_WORDS])
    return (
        F.filter(tokens, lambda t: ~F.array_contains(mods, t)),
        F.filter(tokens, lambda t: F.array_contains(mods, t)),
    )


def term_groups(title: Column) -> Column:
    """Comma phrases to arrays of required words; phrases without any are dropped."""
    phrases = F.split(F.coalesce(title, F.lit("")), ",")
    groups = F.transform(phrases, lambda p: split_required(query_tokens(p))[0])
    return F.filter(groups, lambda g: F.size(g) > 0)


def query_tokens_literal(s: str | None) -> list[str]:
    stop = set(V.QUERY_STOP_WORDS)
    found = [t for t in re.findall(r"[a-zA-Z0-9+#.\-]+", (s or "").lower()) if t not in stop]
    return [t.strip("-.") for t in found if t.strip("-.")]


def term_groups_literal(title: str | None) -> list[list[str]]:
    if not title or title.strip().lower() == "all":
        return []
    mods = set(V.MODIFIER_WORDS)
    groups = [[t for t in query_tokens_literal(p) if t not in mods] for p in title.split(",")]
    return [g for g in groups if g]


def combined_keyword(groups: Column) -> Column:
    """Distinct required words in order of first use; ``developer`` when there are none."""
    words = F.array_distinct(F.flatten(groups))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.lit("developer"))


def keyword_key(c: Column) -> Column:
    """Order- and case-free key of a comma list."""
    parts = F.transform(
        F.split(F.coalesce(c, F.lit("")), ","),
        lambda p: F.lower(F.trim(F.regexp_replace(p, r"(?U)\s+", " "))),
    )
    kept = F.filter(parts, lambda p: (p != "") & (p != "all"))
    return F.array_join(F.array_sort(F.array_distinct(kept)), ",")


def work_auth_note(c: Column) -> Column:
    """First sentence naming a work-authorization rule, at most 200 characters.

    The first phrase is located once and the sentence is cut out around it; splitting the text into
    sentences would touch every one of them.
    """
    pattern = "(?iu)" + "|".join(re.escape(p) for p in V.WORK_AUTH_PHRASES)
    ends = lambda t: F.translate(t, "!?\n", "...")

    def sentence(at: Column) -> Column:
        head, tail = F.substring(c, F.lit(1), at - 1), F.substr(c, at)
        start = at - F.length(F.substring_index(ends(head), ".", -1))
        stop = at + F.length(F.substring_index(ends(tail), ".", 1))
        return F.substring(strip(F.substring(c, start, stop - start)), 1, 200)

    named = let(F.lower(c), lambda low: contains_any(low, V.WORK_AUTH_PHRASES))
    return F.when(named, let(F.regexp_instr(c, F.lit(pattern)), sentence))


def company_from_title(title: Column, default: str) -> tuple[Column, Column]:
    """(title, company) of feed titles: ``X at Co`` first, else ``Co: X``."""
    at, colon = F.instr(title, " at "), F.instr(title, ":")
    new_title = (
        F.when(at > 0, strip(F.get(F.split(title, " at ", 2), F.lit(0))))
        .when(colon > 0, strip(F.get(F.split(title, ":", 2), F.lit(1))))
        .otherwise(title)
    )
    company = (
        F.when(at > 0, strip(F.get(F.split(title, " at ", 2), F.lit(1))))
        .when(colon > 0, strip(F.get(F.split(title, ":", 2), F.lit(0))))
        .otherwise(F.lit(default))
    )
    return new_title, company


def company_after_dash(title: Column, default: str) -> Column:
    """Company of ``X at Co`` or ``X - Co`` titles."""
    return (
        F.when(F.instr(title, " at ") > 0, strip(F.get(F.split(title, " at ", 2), F.lit(1))))
        .when(F.instr(title, " - ") > 0, strip(F.get(F.split(title, " - ", 2), F.lit(1))))
        .otherwise(F.lit(default))
    )


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters."""
    runs = F.regexp_extract_all(c, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def iso_text(t: Column) -> Column:
    """ISO stamp; the fraction is only written where there is one."""
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(t, ".SSSSSS")
    return F.when(fraction == ".000000", whole).otherwise(F.concat(whole, fraction))
