"""The derived tables as DuckDB SQL, plus SQL text helpers shared by the oracles."""

from __future__ import annotations

import re

from postlake import fixed_values as V
from postlake.plans import bindings as B

AS_OF = f"TIMESTAMP '{B.AS_OF}'"


def q(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def in_list(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def arr(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]::VARCHAR[]"


def pick(xs, idx: str) -> str:
    return f"({arr(xs)})[({idx}) % {len(xs)} + 1]"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def alt(words) -> str:
    return "|".join(re.escape(w) for w in words)


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9+#.]+', ' ', 'g'))"


def tokens(n: str, stop) -> str:
    return f"list_filter(string_split({n}, ' '), lambda t: t <> '' AND NOT list_contains({arr(stop)}, t))"


def canonical_title(t: str) -> str:
    t = f"lower(trim({t}))"
    out = "CASE"
    for name, parts, words in V.CANONICAL_TITLE_RULES:
        cond = any_of(t, parts)
        for w in words:
            cond += f" OR regexp_matches({t}, '\\b{w}\\b')"
        out += f" WHEN {cond} THEN {q(name)}"
    return out + " END"


def job_type(portal: str, text: str) -> str:
    out = f"CASE WHEN lower(trim({portal})) IN {in_list(V.CONTRACT_ONLY_PORTALS)} THEN 'contract'"
    for name, words in V.JOB_TYPE_WORDS:
        out += f" WHEN {any_of(f'lower({text})', words)} THEN {q(name)}"
    return out + " ELSE 'unknown' END"


def canonical_job_type(x: str, table=V.JOB_TYPE_ALIASES) -> str:
    out = "CASE"
    for name, spellings in table.items():
        out += f" WHEN lower(trim({x})) IN {in_list(spellings)} THEN {q(name)}"
    return out + " END"


def text_job_type(text: str, contract=V.LISTING_CONTRACT_WORDS) -> str:
    t = f"lower({text})"
    return (
        f"CASE WHEN {any_of(t, contract)} THEN 'contract' WHEN {any_of(t, V.LISTING_PART_WORDS)} THEN 'part_time' "
        f"WHEN {any_of(t, V.LISTING_FULL_WORDS)} THEN 'full_time' ELSE 'unknown' END"
    )


def is_remote(text: str) -> str:
    return f"regexp_matches(lower({text}), '\\b({alt(V.REMOTE_WORDS)})\\b')"


def currency(c: str) -> str:
    return "CASE lower(" + c + ")" + "".join(f" WHEN {q(k)} THEN {q(v)}" for k, v in V.CURRENCY_BY_COUNTRY.items()) + " END"


def _starts(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(p)})" for p in prefixes) + ")"


def whole_place(low: str) -> str:
    out = f"CASE WHEN {low} IN {in_list(V.GLOBAL_PLACES)} OR {_starts(low, V.GLOBAL_PLACE_PREFIXES)} THEN 'Remote / Global'"
    for region, words in V.REGIONS:
        out += f" WHEN {any_of(low, words)} THEN {q(region)}"
    for code, prefixes, exact in V.COUNTRY_ONLY:
        out += f" WHEN {low} IN {in_list(exact)} OR {_starts(low, prefixes)} THEN {q(code)}"
    return out + " END"


def place(loc: str, default: str) -> tuple[str, str]:
    """(city, country) expressions of a location text."""
    s = f"trim({loc})"
    low = f"lower({s})"
    whole = whole_place(low)
    coded = f"regexp_matches({s}, '^\\s*[A-Za-z]{{2}}\\s*-')"
    head = f"trim(split_part({s}, '-', 1))"
    rest = f"nullif(trim(substr({s}, instr({s}, '-') + 1)), '')"
    parts = f"list_filter(list_transform(string_split({s}, ','), lambda p: trim(p)), lambda p: p <> '')"
    city = f"coalesce(CASE WHEN {coded} THEN {rest} END, ({parts})[1], {s})"
    state = f"regexp_replace(upper(({parts})[2]), '[^A-Z]', '', 'g')"
    country = f"CASE WHEN {coded} THEN upper({head}) WHEN {state} IN {in_list(V.US_STATES)} THEN 'US'"
    for code, cities, names in V.CITY_COUNTRY:
        country += f" WHEN regexp_matches({low}, '\\b({alt(cities + names)})\\b') THEN {q(code)}"
    country += f" ELSE upper({default}) END"
    empty = f"({loc} IS NULL OR {s} = '')"
    city_sql = (
        f"CASE WHEN {empty} OR ({whole}) IS NOT NULL THEN NULL "
        f"WHEN upper({city}) IS NOT DISTINCT FROM ({country}) THEN NULL ELSE left({city}, 100) END"
    )
    country_sql = f"CASE WHEN {empty} THEN upper({default}) ELSE coalesce({whole}, {country}) END"
    return city_sql, country_sql


def stored_precision(posted: str, portal: str) -> str:
    return (
        f"CASE WHEN {posted} IS NULL THEN 'unknown' WHEN {posted} = date_trunc('day', {posted}) THEN 'day' "
        f"WHEN lower(trim({portal})) IN {in_list(V.EXACT_PRECISION_PORTALS)} THEN 'exact' ELSE 'day' END"
    )


_URL = (
    "CASE event_id % 6 "
    "WHEN 0 THEN 'https://www.' || portal || '.com/jobs/view/job-' || event_id "
    "WHEN 1 THEN 'https://boards.greenhouse.io/acme/jobs/' || event_id "
    "WHEN 2 THEN 'https://www.google.com/search?q=' || event_id "
    "WHEN 3 THEN 'https://www.' || portal || '.com/jobs/search?keywords=' || event_id "
    "WHEN 4 THEN 'https://www.indeed.com/pagead/clk?' || event_id "
    "ELSE 'ftp://x/' || event_id END"
)
_CITY, _COUNTRY = place("location_raw", "'US'")

JOBS = f"""
ev AS (SELECT *, {pick(V.PORTAL_IDS, 'event_id')} AS portal,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN date_trunc('day', ts) ELSE ts END AS posted
  FROM events),
raw_jobs AS (SELECT
  event_id AS ord, event_id::VARCHAR AS id, {pick(B.TITLES, 'event_id * 7')} AS title,
  {pick(B.COMPANIES, 'user_id')} AS company, {pick(B.LOCATIONS, 'event_id')} AS location_raw,
  portal AS source_platform, {pick(B.JOB_TYPES, 'event_id')} AS job_type_raw, event_id % 4 = 0 AS remote_raw,
  {pick(B.SKILLS, 'event_id')} AS skills,
  CASE WHEN event_id % 3 = 0 THEN value * 1000 END AS salary_min,
  CASE WHEN event_id % 3 = 0 THEN value * 1000 + 20000 END AS salary_max,
  {_URL} AS apply_url, posted::TIMESTAMP AS posted_date,
  CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 37 = 0 THEN ts - INTERVAL 10 DAY
       ELSE ts + INTERVAL 1 HOUR * (event_id % 97)::INTEGER END AS scraped_at,
  CASE WHEN event_id % 100 = 0 THEN NULL WHEN event_id % 41 = 0 THEN posted::TIMESTAMP
       ELSE ts + INTERVAL 1 DAY * (event_id % 11)::INTEGER END AS fetched_at,
  event_id // 10 AS doc_key FROM ev),
jobs AS MATERIALIZED (SELECT *, {canonical_title('title')} AS canonical_title, {_CITY} AS city, {_COUNTRY} AS country,
  {job_type('source_platform', "coalesce(job_type_raw, '') || ' ' || title")} AS job_type,
  coalesce(remote_raw, false) OR {is_remote("title || ' ' || coalesce(location_raw, '')")} AS remote_flag,
  {currency(_COUNTRY)} AS currency,
  CASE WHEN ord % 7 = 0 THEN NULL ELSE {stored_precision('posted_date', 'source_platform')} END AS posted_date_precision
  FROM raw_jobs)"""

TEXT_JOBS = JOBS + f""",
tjobs AS (SELECT j.*, concat_ws(' ', {pick(B.SENTENCES, 'j.ord')}, d.text) AS description
  FROM jobs j LEFT JOIN documents d ON d.doc_id = j.doc_key)"""

INCOMING = JOBS + """,
stored AS (SELECT * FROM jobs WHERE ord % 4 = 0),
incoming AS (SELECT * FROM jobs WHERE ord % 4 <> 0
  UNION ALL BY NAME
  SELECT * REPLACE (ord + 1000000000 AS ord,
    coalesce(posted_date, scraped_at) + INTERVAL 1 HOUR AS posted_date, 'hour' AS posted_date_precision)
  FROM jobs WHERE ord % 12 = 0)"""

RUNS = f"""
runs AS (SELECT event_id AS run_id, {pick(V.PORTAL_IDS, 'user_id')} AS portal,
  'Method ' || (event_id % 4 + 1) AS method, ts, event_type <> 'error' AS success,
  (floor(value)::BIGINT % 60)::DOUBLE AS num_jobs_found, event_type AS layer_used,
  CASE WHEN event_type = 'error' THEN {pick(B.RUN_ERRORS, 'event_id')} END AS error_message FROM events)"""

REQUESTS = f"""
requests AS (SELECT event_id AS request_id, ts, {pick(B.REQUEST_TITLES, 'user_id')} AS title, NULL::VARCHAR AS q,
  {pick(B.REQUEST_DATES, 'event_id')} AS date_posted, {pick(B.REQUEST_PLATFORMS, 'event_id')} AS platform,
  {pick(B.REQUEST_COUNTRIES, 'event_id')} AS country, {pick(B.REQUEST_JOB_TYPES, 'event_id')} AS job_type,
  {pick(B.REQUEST_MODES, 'event_id // 3')} AS search_mode, event_id % 2 = 0 AS remote_only FROM events)"""

PROMPTS = f"""
prompts AS (SELECT conv_id AS session_id, turn,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE *
    (conv_id * 60 + turn * 7 + CASE WHEN turn >= 4 AND conv_id % 3 = 0 THEN 60 ELSE 0 END)::INTEGER AS ts,
  {pick(B.PROMPTS, 'conv_id + turn')} || '. ' || coalesce(text, '') AS message FROM conversations WHERE role = 'user')"""


def with_jobs(body: str) -> str:
    return f"WITH {JOBS} {body}"


def with_text(body: str) -> str:
    return f"WITH {TEXT_JOBS} {body}"


def with_incoming(body: str) -> str:
    return f"WITH {INCOMING} {body}"


def with_runs(body: str) -> str:
    return f"WITH {RUNS} {body}"


def with_requests(body: str) -> str:
    return f"WITH {REQUESTS} {body}"


def with_prompts(body: str) -> str:
    return f"WITH {PROMPTS} {body}"


def minutes(d: str) -> str:
    key = f"lower(trim({d}))"
    out = f"CASE WHEN {d} IS NULL OR {key} = '' THEN {V.DEFAULT_WINDOW} WHEN {key} IN {in_list(V.DATE_WINDOW_ALL)} THEN {V.MAX_WINDOW}"
    for name, m in V.DATE_WINDOWS.items():
        out += f" WHEN {key} = {q(name)} THEN {m}"
    return out + f" ELSE {V.DEFAULT_WINDOW} END"


def bucket(m: str) -> str:
    return f"CASE WHEN {m} <= 720 THEN '12h' WHEN {m} <= 1440 THEN '24h' WHEN {m} <= 10080 THEN '7d' ELSE '30d' END"


EFF_TS = "coalesce(posted_date, least(coalesce(scraped_at, fetched_at), coalesce(fetched_at, scraped_at)))"
EFF_FIELD = (
    "CASE WHEN posted_date IS NOT NULL THEN 'posted_date' "
    "WHEN scraped_at IS NOT NULL OR fetched_at IS NOT NULL THEN 'first_seen' ELSE 'none' END"
)


def fresh(minutes_sql: str) -> str:
    """Boolean freshness of a jobs row for a window in minutes."""
    inside = f"{EFF_TS} >= {AS_OF} - INTERVAL 1 MINUTE * ({minutes_sql})::INTEGER"
    return (
        f"CASE WHEN posted_date IS NOT NULL THEN {inside} WHEN ({minutes_sql}) <= 1440 THEN false "
        f"WHEN {EFF_TS} IS NULL THEN true ELSE {inside} END"
    )


def direct_url(portal: str, url: str) -> str:
    u, low, pid = f"trim({url})", f"lower(trim({url}))", f"lower(trim({portal}))"
    own = f"CASE {pid}" + "".join(
        f" WHEN {q(p)} THEN regexp_matches({low}, {q(rx)})" for p, rx in V.PORTAL_LINK_PATTERNS.items()
    ) + " ELSE false END"
    direct = f"regexp_matches({low}, {q('|'.join(V.DIRECT_POSTING_PATTERNS))})"
    other = f"({pid} NOT IN {in_list(V.PORTAL_LINK_PATTERNS)} AND length(coalesce(array_to_string((string_split({low}, '/'))[4:], '/'), '')) > 1)"
    return (
        f"((starts_with({u}, 'http://') OR starts_with({u}, 'https://')) AND NOT {any_of(low, V.SEARCH_PAGE_PARTS)} "
        f"AND (({own}) OR {direct} OR {other}))"
    )


def usable_url(url: str) -> str:
    low = f"lower(trim(coalesce({url}, '')))"
    return f"(starts_with({low}, 'http') AND NOT {any_of(low, V.UNUSABLE_LINK_PARTS)})"
