"""Search intent of a free-text prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.text import contains_any


def _whole_words(text: Column, words: list[str]) -> Column:
    return text.rlike(r"\b(" + "|".join(words) + r")\b")


def intent_columns(message: Column, compat: bool = False) -> dict[str, Column]:
    """The part of the intent that the prompt states itself; country words match whole by default."""
    low = F.lower(message)
    country = None
    for code, words in V.PROMPT_COUNTRIES:
        hit = contains_any(low, words) if compat else _whole_words(low, words)
        country = F.when(hit, F.lit(code)) if country is None else country.when(hit, F.lit(code))
    platform = None
    for name, word in V.PROMPT_PLATFORMS:
        hit = low.contains(word)
        platform = F.when(hit, F.lit(name)) if platform is None else platform.when(hit, F.lit(name))
    thousands = F.regexp_extract(low, r"(\d{2,3})\s*k\b", 1)
    plain = F.regexp_extract(low, r"(?:over|above|min|\$)\s*(\d{5,7})\b", 1)
    salary = F.when(thousands != "", thousands.try_cast("double") * 1000).when(plain != "", plain.try_cast("double"))
    stop = F.array(*[F.lit(w) for w in V.PROMPT_STOP_WORDS])
    words = F.filter(
        F.regexp_extract_all(message, F.lit(r"(?U)\b[a-zA-Z]{2,}\b"), F.lit(0)),
        lambda w: ~F.array_contains(stop, F.lower(w)),
    )
    return {
        "query": F.nullif(F.array_join(F.slice(words, 1, 4), " "), F.lit("")),
        "remote_only": contains_any(low, V.PROMPT_REMOTE_WORDS),
        "country": country,
        "min_salary": salary,
        "platform": platform,
        "asks_details": contains_any(low, V.PROMPT_DETAIL_WORDS),
        "refers_back": contains_any(low, V.PROMPT_FOLLOW_UP_WORDS),
    }
