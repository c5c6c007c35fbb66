"""SQL oracles of the filters, the guard and the ranked search."""

from __future__ import annotations

from oracle import base as S
from oracle.registry import ORACLES
from postlake import fixed_values as V

J, T = S.with_jobs, S.with_text

# The expansion of "cloud engineer" (hybrid), written out from the cloud family.
_fam = next(f for f in V.ROLE_FAMILIES if f["name"] == "cloud_infra")
CORE = ["cloud engineer"]
STRONG = sorted(x for x in _fam["strong"] if x not in CORE)
RELATED = sorted(set(_fam["related"]) - set(STRONG))
SKILLS = sorted(_fam["skills"])
# and of "data scientist, python": only the data science family.
_ds = next(f for f in V.ROLE_FAMILIES if f["name"] == "data_sci")
CORE2 = ["data scientist", "python"]
STRONG2 = sorted(x for x in _ds["strong"] if x not in CORE2)
RELATED2 = sorted(set(_ds["related"]) - set(STRONG2))
SKILLS2 = sorted(_ds["skills"])

HAY = S.norm("title || ' ' || coalesce(canonical_title, '')")
BODY = S.norm("concat_ws(' ', company, skills, description)")


def first_term(terms, hay="hay") -> str:
    hit = f"contains({hay}, t) OR len(list_filter(string_split(t, ' '), lambda w: NOT list_contains(string_split({hay}, ' '), w))) = 0"
    return f"list_filter({S.arr(terms)}, lambda t: {hit})[1]"


def tier_cte(src: str, core, strong, related, skills) -> str:
    """CTE text adding match_tier and matched_term to ``src``."""
    found = f"list_filter({S.arr(skills)}, lambda s: contains(body, trim(regexp_replace(s, '[^a-z0-9+#.]+', ' ', 'g'))))"
    return f"""
h AS (SELECT *, {HAY} AS hay, {BODY} AS body FROM {src}),
f AS (SELECT *, {first_term(core)} AS c1, {first_term(strong)} AS c2, {first_term(related)} AS c3, {found} AS sk FROM h),
tier AS (SELECT * EXCLUDE (hay, body, c1, c2, c3, sk),
  CASE WHEN c1 IS NOT NULL THEN 'core' WHEN c2 IS NOT NULL THEN 'strong' WHEN c3 IS NOT NULL THEN 'related'
    WHEN len(sk) >= 3 OR (len(sk) >= 2 AND contains(hay, 'engineer')) THEN 'related' ELSE 'none' END AS match_tier,
  coalesce(c1, c2, c3, CASE WHEN len(sk) >= 3 OR (len(sk) >= 2 AND contains(hay, 'engineer'))
    THEN array_to_string(sk[1:3], '+') END, '') AS matched_term FROM f)"""


def score_cte(src: str, groups: list[tuple[str, list[str]]]) -> str:
    """CTE ``score`` adding relevance columns; groups are (phrase, tokens)."""
    neg = " OR ".join(f"contains(' ' || tn || ' ', {S.q(' ' + s + ' ')})" for s in V.NEGATIVE_SIGNALS)
    per = []
    for phrase, toks in groups:
        n = len(toks)
        tk = S.arr(toks)
        hits = f"len(list_filter({tk}, lambda t: list_contains(tt, t)))"
        every = f"len(list_filter({tk}, lambda t: list_contains(tt, t) OR contains(' ' || bn || ' ', ' ' || t || ' '))) = {n}"
        per.append(
            f"CASE WHEN contains(tn, {S.q(phrase)}) THEN 100 WHEN {hits} = {n} THEN 85 WHEN {hits} * 2 >= {n} THEN 60 "
            f"WHEN {every} THEN 40 WHEN {hits} > 0 THEN 15 ELSE 0 END"
        )
    raws = ", ".join(per)
    return f"""
s0 AS (SELECT *, {S.norm("coalesce(nullif(title, ''), canonical_title)")} AS tn, {BODY} AS bn FROM {src}),
s1 AS (SELECT *, {S.tokens('tn', V.RELEVANCE_STOP_WORDS)} AS tt, ({neg}) AS neg FROM s0),
s2 AS (SELECT *, [{raws}] AS raws FROM s1),
s3 AS (SELECT *, list_transform(raws, lambda r: CASE WHEN r >= 60 AND neg THEN 35 ELSE r END) AS codes FROM s2),
s4 AS (SELECT *, list_max(codes) AS best, raws[list_position(codes, list_max(codes))] AS rule FROM s3),
score AS (SELECT * EXCLUDE (tn, bn, tt, neg, raws, codes, best, rule), best / 100.0::DOUBLE AS relevance_score,
  CASE rule WHEN 100 THEN 'exact_phrase_in_title' WHEN 85 THEN 'all_tokens_in_title'
    WHEN 60 THEN 'majority_tokens_plus_synonym_in_title' WHEN 40 THEN 'all_tokens_but_only_in_body'
    WHEN 15 THEN 'partial_title_overlap' ELSE 'no_overlap' END
    || CASE WHEN best = 35 THEN '_but_negative_title_signal' ELSE '' END AS relevance_reason,
  best >= 60 AS is_exact FROM s4)"""


def words_hit(groups) -> str:
    ors = []
    for g in groups:
        ands = []
        for w in g:
            rx = S.q("\\b" + w + "\\b")
            ands.append(f"(regexp_matches(lower(title), {rx}) OR regexp_matches(lower(coalesce(canonical_title, '')), {rx}))")
        ors.append("(" + " AND ".join(ands) + ")")
    return "(" + " OR ".join(ors) + ")"


TYPE = S.canonical_job_type("job_type")
COUNTRY_US = f"(country IS NULL OR trim(country) = '' OR upper(trim(country)) = 'US' OR upper(trim(country)) IN {S.in_list(V.GLOBAL_COUNTRY_VALUES)})"
COUNTRY_IN = COUNTRY_US.replace("'US'", "'IN'")
GUARDED = tier_cte("tjobs", CORE, STRONG, RELATED, SKILLS) + f""",
guarded AS (SELECT *, {S.EFF_FIELD} AS freshness_field,
  CASE WHEN NOT {S.direct_url('source_platform', 'apply_url')} THEN 'invalid_or_indirect_url'
    WHEN NOT ({S.fresh('10080')}) THEN 'stale_date'
    WHEN match_tier = 'none' AND NOT {words_hit([['cloud', 'engineer']])} THEN 'title_mismatch' END AS reason FROM tier)"""
GROUPS = [("cloud engineer", ["cloud", "engineer"])]
FOUND = GUARDED + ", passed AS (SELECT * FROM guarded WHERE reason IS NULL)," + score_cte("passed", GROUPS)
RECENCY = "coalesce(posted_date, scraped_at, fetched_at)"
TIER_ORDER = f"CASE match_tier WHEN 'core' THEN 0 WHEN 'strong' THEN 1 WHEN 'related' THEN 2 ELSE 3 END, relevance_score DESC, {RECENCY} DESC NULLS LAST, ord"
RECENT = "posted_date DESC NULLS LAST, fetched_at DESC NULLS LAST, ord"

O = ORACLES
O["filter_platform"] = J("SELECT id, source_platform FROM jobs WHERE source_platform = 'dice'")
O["filter_remote"] = J("SELECT id, remote_flag FROM jobs WHERE coalesce(remote_flag, true)")
O["filter_country"] = J(f"SELECT id, country FROM jobs WHERE {COUNTRY_US}")
O["filter_job_type"] = J(f"SELECT id, job_type FROM jobs WHERE coalesce({TYPE}, 'full_time') = 'full_time'")
O["filter_onsite"] = J("SELECT id, remote_flag FROM jobs WHERE NOT coalesce(remote_flag, false)")
O["filter_fresh"] = J(
    f"SELECT id, {S.EFF_TS} AS freshness_ts, {S.EFF_FIELD} AS freshness_field FROM jobs WHERE {S.fresh('10080')}"
)
_terms = CORE + STRONG + RELATED
O["filter_title_expanded"] = J(
    f"SELECT id, title, skills FROM jobs WHERE {S.any_of('lower(title)', _terms)} "
    f"OR {S.any_of('lower(coalesce(canonical_title, chr(32)))', _terms)} "
    f"OR {S.any_of('lower(coalesce(skills, chr(32)))', SKILLS)}"
)
_HAY5 = "lower(concat_ws(' ', title, coalesce(canonical_title, ''), company, coalesce(skills, ''), description))"
O["filter_freetext"] = T(f"SELECT id, title FROM tjobs WHERE contains({_HAY5}, 'docker')")
O["match_term_groups"] = J(f"SELECT id, {words_hit([['python', 'developer'], ['data', 'scientist']])} AS matches FROM jobs")
O["valid_direct_url"] = J(f"SELECT id, {S.direct_url('source_platform', 'apply_url')} AS is_direct FROM jobs")
O["usable_apply_url"] = J(f"SELECT id, {S.usable_url('apply_url')} AS is_usable FROM jobs")
O["search_prefilter"] = T(
    f"SELECT id, title, posted_date, fetched_at FROM tjobs WHERE {COUNTRY_US} AND coalesce({TYPE}, 'contract') = 'contract' "
    f"AND {S.fresh('43200')} AND ({S.any_of('lower(title)', _terms)} "
    f"OR {S.any_of('lower(coalesce(canonical_title, chr(32)))', _terms)} "
    f"OR {S.any_of('lower(coalesce(skills, chr(32)))', SKILLS)}) AND contains({_HAY5}, 'aws') ORDER BY {RECENT}"
)
O["guard_with_reason"] = T(f", {GUARDED} SELECT id, reason FROM guarded")
O["guard_strict"] = T(
    f", {tier_cte('tjobs', CORE2, STRONG2, RELATED2, SKILLS2)} SELECT id, CASE "
    f"WHEN NOT {S.direct_url('source_platform', 'apply_url')} THEN 'invalid_or_indirect_url' "
    f"WHEN NOT coalesce(remote_flag, true) THEN 'not_remote' WHEN NOT {COUNTRY_US} THEN 'country_mismatch' "
    f"WHEN coalesce({TYPE}, 'full_time') <> 'full_time' THEN 'job_type_mismatch' "
    f"WHEN NOT ({S.fresh('43200')}) THEN 'stale_date' "
    f"WHEN match_tier = 'none' AND NOT {words_hit([['data', 'scientist'], ['python']])} THEN 'title_mismatch' "
    f"WHEN NOT contains({_HAY5}, 'docker') THEN 'query_mismatch' END AS reason FROM tier"
)
O["final_sweep"] = T(
    f", {GUARDED} SELECT id, title, freshness_field FROM guarded WHERE reason IS NULL AND NOT ({S.fresh('10080')})"
)
O["search_structured"] = T(
    "SELECT id, title, company, city, country, salary_min, salary_max, fetched_at FROM tjobs "
    "WHERE (contains(lower(title), 'engineer') OR contains(lower(company), 'engineer') "
    "OR contains(lower(coalesce(city, '')), 'engineer') OR contains(lower(description), 'engineer')) "
    "AND remote_flag AND (country = 'IN' OR contains(lower(coalesce(country, '')), 'india') "
    "OR contains(lower(coalesce(city, '')), 'india')) AND (salary_min >= 20000 OR salary_max >= 20000) "
    "ORDER BY fetched_at DESC NULLS LAST, ord LIMIT 100"
)
O["lookup_by_id"] = J("SELECT id, title, company, apply_url, posted_date FROM jobs WHERE id = '777'")
_clean = lambda c: f"coalesce(nullif(trim({c}), ''), 'all')"
_dates = list(V.DATE_WINDOWS) + V.DATE_WINDOW_ALL
O["validate_requests"] = S.with_requests(f""",
c AS (SELECT request_id, {_clean('title')} AS job_title, lower({_clean('platform')}) AS platform,
  upper({_clean('country')}) AS country, remote_only,
  CASE WHEN lower({_clean('date_posted')}) IN {S.in_list(_dates)} THEN lower({_clean('date_posted')}) ELSE 'past_7d' END AS date_posted,
  lower({_clean('job_type')}) AS job_type, nullif(trim(q), '') AS q FROM requests),
e AS (SELECT *, CASE WHEN job_type NOT IN {S.in_list(V.VALID_REQUEST_JOB_TYPES)} THEN 'invalid_job_type' END AS error FROM c)
SELECT *, CASE WHEN error IS NULL THEN sha256('{{"country": "' || country || '", "date_posted": "' || date_posted ||
  '", "job_title": "' || job_title || '", "job_type": "' || job_type || '", "platform": "' || platform ||
  '", "q": "' || coalesce(q, '') || '", "remote_only": ' || remote_only::VARCHAR || '}}') END AS integrity_hash FROM e""")
_reason = (
    f"CASE WHEN {S.EFF_TS} IS NULL THEN 'no_date_signal_excluded_from_tight_window' "
    "WHEN posted_date IS NULL THEN 'posting_date_not_published_excluded_from_tight_window' "
    f"WHEN {S.EFF_TS} >= {S.AS_OF} - INTERVAL 24 HOUR THEN 'ok_posted_date' ELSE 'stale_posted_date' END"
)
_prec = (
    f"CASE WHEN posted_date IS NULL THEN 'unknown' WHEN posted_date_precision IN {S.in_list(V.PRECISIONS)} "
    f"THEN posted_date_precision ELSE {S.stored_precision('posted_date', 'source_platform')} END"
)
_debug = (
    f"SELECT id, posted_date, scraped_at, fetched_at, {S.EFF_FIELD} AS freshness_field, {_prec} AS freshness_precision, "
    f"round(epoch_us({S.AS_OF} - {S.EFF_TS}) / 3600000000.0, 1) AS age_hours, ({_reason}) = 'ok_posted_date' AS passes, "
    f"{_reason} AS fresh_reason, coalesce({S.EFF_TS} > {S.AS_OF}, false) AS is_future FROM jobs"
)
O["debug_freshness"] = J(_debug)
O["debug_freshness_summary"] = J(
    f", dbg AS ({_debug}) SELECT freshness_field, freshness_precision, count(*) AS n, "
    "count(*) FILTER (passes) AS n_pass, count(*) FILTER (is_future) AS n_future FROM dbg GROUP BY ALL"
)
O["order_recent"] = J(f"SELECT id, posted_date, fetched_at, row_number() OVER (ORDER BY {RECENT}) AS rank FROM jobs")
_PY = ("senior python developer", ["python", "developer"])
O["relevance_score"] = T(
    f", {score_cte('tjobs', [GROUPS[0], _PY])} SELECT id, relevance_score, relevance_reason, is_exact FROM score"
)
O["match_tier"] = T(f", {tier_cte('tjobs', CORE, STRONG, RELATED, SKILLS)} SELECT id, match_tier, matched_term FROM tier")
O["rank_relevance"] = T(
    f", {score_cte('tjobs', [('python developer', ['python', 'developer'])])} SELECT id, title, relevance_score, "
    f"relevance_reason, is_exact, row_number() OVER (ORDER BY relevance_score DESC, {RECENCY} DESC NULLS LAST, ord) AS rank FROM score"
)
O["rank_tiered"] = T(
    f", {tier_cte('tjobs', CORE, STRONG, RELATED, SKILLS)}, {score_cte('tier', GROUPS)} "
    f"SELECT id, title, match_tier, relevance_score, row_number() OVER (ORDER BY {TIER_ORDER}) AS rank FROM score"
)
O["page"] = J(f"SELECT id, posted_date FROM jobs ORDER BY {RECENT} LIMIT 20 OFFSET 40")
O["page_info"] = J(
    "SELECT count(*) AS total, 20::BIGINT AS page_size, 3::BIGINT AS page_number, "
    f"ceil(count(*) / 20.0)::BIGINT AS page_count FROM jobs WHERE {COUNTRY_IN}"
)
O["search"] = T(
    f", {FOUND} SELECT id, title, company, source_platform, posted_date, freshness_field, match_tier, matched_term, "
    f"relevance_score, relevance_reason, is_exact FROM score ORDER BY {TIER_ORDER} LIMIT 50"
)
O["match_yield"] = T(
    f", {FOUND} SELECT count(*) AS total, count(*) FILTER (is_exact) AS exact_matches, "
    "coalesce(round(count(*) FILTER (is_exact) / count(*), 3), 0.0)::DOUBLE AS match_yield, "
    "coalesce(round(sum(round(relevance_score * 100)::BIGINT) / count(*), 1) / 100, 0.0)::DOUBLE AS avg_score FROM score"
)
O["results_by_tier"] = T(
    f", {FOUND} SELECT count(*) FILTER (match_tier = 'core') AS core, count(*) FILTER (match_tier = 'strong') AS strong, "
    "count(*) FILTER (match_tier = 'related') AS related FROM score"
)
