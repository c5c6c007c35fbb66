"""Relevance score and match tier of a posting for one query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.expansion import Expansion
from postlake.functions.text import (
    has_norm_phrase,
    has_norm_token,
    norm_literal,
    norm_text,
    token_literals,
    tokens_of,
)


@dataclass(frozen=True)
class QueryGroup:
    phrase: str
    tokens: list[str]


def parse_query(query: str | None) -> list[QueryGroup]:
    """Comma phrases with at least one meaningful word."""
    out = []
    for p in (query or "").split(","):
        toks = list(dict.fromkeys(token_literals(p, V.RELEVANCE_STOP_WORDS)))
        if toks:
            out.append(QueryGroup(norm_literal(p), toks))
    return out


def negative_title(title_norm: Column, compat: bool = False) -> Column:
    padded = F.concat(F.lit(" "), title_norm, F.lit(" "))
    out = F.lit(False)
    for sig in V.NEGATIVE_SIGNALS:
        out = out | (title_norm.contains(sig) if compat else padded.contains(f" {sig} "))
    return out


def body_text(company: Column, skills: Column, description: Column) -> Column:
    return F.lower(F.concat_ws(" ", company, skills, description))


_RULES = {
    100: "exact_phrase_in_title",
    85: "all_tokens_in_title",
    60: "majority_tokens_plus_synonym_in_title",
    40: "all_tokens_but_only_in_body",
    15: "partial_title_overlap",
    0: "no_overlap",
}


def title_of(title: Column, canonical: Column) -> Column:
    return norm_text(F.coalesce(F.nullif(title, F.lit("")), canonical))


def relevance_rank(title_norm: Column, body_lower: Column, query: str | None, compat: bool = False) -> Column:
    """One sortable integer: score in percent, then the earlier comma phrase, then the rule that fired.

    The body is only read when the title decides nothing (CASE branches are lazy), and it is
    probed once per query word instead of being tokenised.
    """
    words = tokens_of(title_norm, V.RELEVANCE_STOP_WORDS)
    negative = negative_title(title_norm, compat)
    ranks = []
    for i, g in enumerate(parse_query(query)):
        hits = F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in g.tokens])))
        everywhere = F.lit(True)
        for t in g.tokens:
            everywhere = everywhere & (F.array_contains(words, t) | has_norm_token(body_lower, t))
        n = len(g.tokens)
        rule = (
            F.when(title_norm.contains(g.phrase), F.lit(100))
            .when(hits == n, F.lit(85))
            .when(hits * 2 >= n, F.lit(60))
            .when(everywhere, F.lit(40))
            .when(hits > 0, F.lit(15))
            .otherwise(F.lit(0))
        )
        # let-binding, so that the rule is worked out once
        scored = F.transform(F.array(rule), lambda r: F.when((r >= 60) & negative, F.lit(35)).otherwise(r) * 1_000_000 + r)
        ranks.append(F.get(scored, F.lit(0)) + F.lit((999 - i) * 1000))
    if not ranks:
        return F.lit(100_000_000)
    return ranks[0] if len(ranks) == 1 else F.greatest(*ranks)


def score_of_rank(rank: Column) -> Column:
    return F.floor(rank / 1_000_000).cast("double") / 100.0


def reason_of_rank(rank: Column, query: str | None) -> Column:
    if not parse_query(query):
        return F.lit("no_query_all_match")
    rule = F.pmod(rank, F.lit(1000))
    out = None
    for code, name in _RULES.items():
        out = F.when(rule == code, F.lit(name)) if out is None else out.when(rule == code, F.lit(name))
    capped = F.floor(rank / 1_000_000) == 35
    return F.concat(out, F.when(capped, F.lit("_but_negative_title_signal")).otherwise(F.lit("")))


def tier_hay(title: Column, canonical: Column) -> Column:
    return norm_text(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(canonical, F.lit(""))))


def match_tier(hay: Column, body_lower: Column, exp: Expansion) -> Column:
    """``struct(tier, term)``: core, strong, related, else the skills rescue, else none."""

    def hit(term: str) -> Column:
        n = norm_literal(term)
        if " " not in n:  # a single word that is a token is also a substring
            return hay.contains(n)
        every = F.lit(True)
        for w in n.split(" "):
            every = every & F.contains(F.concat(F.lit(" "), hay, F.lit(" ")), F.lit(f" {w} "))
        return hay.contains(n) | every

    def tier(name: str, term: Column) -> Column:
        return F.struct(F.lit(name).alias("tier"), term.alias("term"))

    named = [("core", t) for t in exp.core] + [("strong", t) for t in exp.strong] + [("related", t) for t in exp.related]
    tries = [F.when(hit(t), tier(name, F.lit(t))) for name, t in named if norm_literal(t)]
    if exp.skills:
        found = F.array_compact(
            F.array(*[F.when(has_norm_phrase(body_lower, norm_literal(s)), F.lit(s)) for s in exp.skills])
        )
        enough = F.filter(
            F.array(found), lambda f: (F.size(f) >= 3) | ((F.size(f) >= 2) & hay.contains("engineer"))
        )
        rescued = F.transform(enough, lambda f: tier("related", F.array_join(F.slice(f, 1, 3), "+")))
        tries.append(F.get(rescued, F.lit(0)))
    return F.coalesce(*tries, tier("none", F.lit("")))


def matches_term_groups(title: Column, canonical: Column, groups: list[list[str]]) -> Column:
    """OR over phrases of AND over required words, whole words, each in the title or the canonical title."""
    if not groups:
        return F.lit(True)
    hay = [F.lower(F.coalesce(c, F.lit(""))) for c in (title, canonical)]

    def word(w: str) -> Column:
        import re

        pattern = r"(?U)\b" + re.escape(w) + r"\b"
        return hay[0].rlike(pattern) | hay[1].rlike(pattern)

    out = F.lit(False)
    for g in groups:
        every = F.lit(True)
        for w in g:
            every = every & word(w)
        out = out | every
    return out & (F.coalesce(F.nullif(title, F.lit("")), F.nullif(canonical, F.lit(""))).isNotNull())
