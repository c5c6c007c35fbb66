"""Query expansion: which role families a query belongs to and the tiers of terms it widens to.

One request is expanded on the driver into literals (``expand``); a table of requests is
expanded with the column functions, which read the families from an array literal, so no
join and no shuffle is needed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.text import norm_literal, norm_text, token_literals, tokens_of


@dataclass(frozen=True)
class Expansion:
    core: list[str]
    strong: list[str] = field(default_factory=list)
    related: list[str] = field(default_factory=list)
    skills: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return [*self.core, *self.strong, *self.related]

    @property
    def widened(self) -> bool:
        return bool(self.strong or self.related)


def _in_family(fam: dict, query: str, words: set[str], compat: bool) -> bool:
    for key in map(norm_literal, fam["match"]):
        whole = key in query if compat else f" {key} " in f" {query} "
        if whole or (" " in key and set(key.split()) <= words) or key in words:
            return True
    return False


def expand(query: str | None, mode: str = "hybrid", compat: bool = False) -> Expansion:
    """``exact``: core only; ``strict``: core and strong; ``hybrid``: adjacent roles too."""
    core = [t.strip() for t in (query or "").split(",") if t.strip()]
    if not core or mode == "exact":
        return Expansion(core)
    q, words = norm_literal(query), set(token_literals(query, V.EXPANSION_STOP_WORDS))
    fams = [f for f in V.ROLE_FAMILIES if _in_family(f, q, words, compat)]
    own = {norm_literal(c) for c in core}
    strong = {s for f in fams for s in f["strong"] if norm_literal(s) not in own}
    related = {r for f in fams for r in f["related"] if norm_literal(r) not in own} if mode == "hybrid" else set()
    skills = {s for f in fams for s in f["skills"]}
    return Expansion(core, sorted(strong), sorted(related - strong), sorted(skills), [f["name"] for f in fams])


def scrape_keywords(exp: Expansion, limit: int = 4) -> list[str]:
    return [*exp.core, *exp.strong][:limit]


# --- the same over a table of requests -----------------------------------------------------------


def families_literal() -> Column:
    """The role families as one array-of-struct literal (13 entries), terms already normalised."""
    strings = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.array(
        *[
            F.struct(
                F.lit(f["name"]).alias("name"),
                strings([norm_literal(m) for m in f["match"]]).alias("match"),
                strings(f["strong"]).alias("strong"),
                strings(f["related"]).alias("related"),
                strings(f["skills"]).alias("skills"),
            )
            for f in V.ROLE_FAMILIES
        ]
    )


def core_terms(title: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(title, F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def matching_families(title: Column) -> Column:
    query = F.concat(F.lit(" "), norm_text(title), F.lit(" "))
    words = tokens_of(norm_text(title), V.EXPANSION_STOP_WORDS)

    def hit(fam: Column) -> Column:
        return F.exists(
            fam["match"],
            lambda k: F.contains(query, F.concat(F.lit(" "), k, F.lit(" ")))
            | (k.contains(" ") & (F.size(F.array_except(F.split(k, " "), words)) == 0))
            | F.array_contains(words, k),
        )

    return F.filter(families_literal(), hit)


def _gather(fams: Column, name: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(fams, lambda f: f[name]))))


def expansion_columns(title: Column, mode: Column) -> dict[str, Column]:
    """core, strong, related, skills and families arrays of a request."""
    core = core_terms(title)
    none = F.array().cast("array<string>")
    active = (F.size(core) > 0) & (mode != "exact")
    fams = F.when(active, matching_families(title)).otherwise(F.filter(families_literal(), lambda f: F.lit(False)))
    own = F.transform(core, norm_text)
    strong = F.array_except(_gather(fams, "strong"), own)
    related = F.when(mode == "hybrid", F.array_except(_gather(fams, "related"), own)).otherwise(none)
    return {
        "core": core,
        "strong": strong,
        "related": F.array_except(related, strong),
        "skills": _gather(fams, "skills"),
        "families": F.transform(fams, lambda f: f["name"]),
    }


def expand_requests(requests: DataFrame) -> DataFrame:
    """Requests with their expansion arrays; each distinct (title, mode) is expanded once and joined back."""
    title = F.when(F.lower("title") == "all", F.lit("")).otherwise(F.coalesce("title", F.lit("")))
    req = requests.withColumns({"_title": title, "_mode": F.coalesce("search_mode", F.lit("hybrid"))})
    arrays = expansion_columns(F.col("_title"), F.col("_mode"))
    widened = req.select("_title", "_mode").distinct().select("*", *[x.alias(k) for k, x in arrays.items()])
    return req.join(widened, ["_title", "_mode"]).drop("_title", "_mode")


def synonym_expansion(tokens: Column) -> Column:
    """Tokens plus every synonym group one of whose members occurs; groups are tried in order and grow the set."""
    joined = F.array_join(tokens, " ")
    groups = F.array(*[F.array(*[F.lit(t) for t in g]) for g in V.SYNONYM_GROUPS])
    return F.aggregate(
        groups,
        F.array_distinct(tokens),
        lambda acc, g: F.when(
            F.exists(g, lambda t: F.contains(joined, t) | F.array_contains(acc, t)), F.array_union(acc, g)
        ).otherwise(acc),
    )
