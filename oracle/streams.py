"""SQL oracles of the streams: what the whole input gives when taken in time order."""

from __future__ import annotations

from oracle import base as S
from oracle.registry import ORACLES as O
from oracle.scalars import CONTACT_GUESS, NAMES
from oracle.tables import FUZZY, HEALTH, fold

O["cooldown_stream"] = S.with_requests(f""", kk AS (SELECT request_id, ts, title AS key FROM requests), {fold('kk', 'key', '3600000000::BIGINT')}
SELECT kk.request_id AS id, key, acc.request_id IS NOT NULL AS accepted FROM kk LEFT JOIN acc USING (request_id)""")
O["rate_budget"] = O["quota_usage"].replace("SELECT call_id, source, day, quota, least", "SELECT call_id AS id, source, least")
_carry = O["session_intent_carry"]
O["session_state"] = f"SELECT session_id, turn, is_follow_up, query, remote_only, country, min_salary, platform FROM ({_carry})"
O["session_windows"] = S.with_prompts(""", p AS (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts) AS prev FROM prompts),
n AS (SELECT *, sum((prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY session_id ORDER BY ts) AS s FROM p)
SELECT session_id, min(ts) AS started, count(*) AS prompts FROM n GROUP BY session_id, s""")
O["health_stream"] = S.with_runs(f", {HEALTH} SELECT method, portal, health_status, success_rate, avg_jobs FROM health")
O["dedup_stream"] = f"WITH {S.JOBS} SELECT DISTINCT regexp_replace(apply_url, '[0-9]{{2}}$', '') AS apply_url FROM jobs"


# --- ingest: a filled store and three batches, each resolved against all that is stored by then -------
STEP = 1_000_000_000_000
_landed = O["norm_dispatch"].replace("md5(coalesce(nullif(de, ''), '')) AS description", "nullif(de, '') AS description")
_columns = (
    "title, canonical_title, company, city, country, salary_min, salary_max, currency, remote_flag, job_type, source_platform, apply_url, "
    "description, posted_date, posted_date_precision, work_authorization_note"
)


def _after(k: int) -> str:
    """CTEs of batch k: its rows, their outcome and the store after it."""
    return f"""
in{k} AS MATERIALIZED (SELECT * REPLACE (ord + {(k + 1) * STEP} AS ord) FROM whole WHERE (ord % 4 <> 0 OR ord % 12 = 0) AND ord // 12 % 3 = {k}),
r{k} AS MATERIALIZED (WITH stored AS (SELECT * FROM v{k}), incoming AS (SELECT * FROM in{k}) {FUZZY} SELECT ord, outcome, refresh_url FROM res),
v{k + 1} AS MATERIALIZED (
  WITH dated AS (SELECT i.ord, coalesce(refresh_url, apply_url) AS u, outcome, posted_date AS d, posted_date_precision AS p
    FROM r{k} JOIN in{k} AS i USING (ord) WHERE posted_date IS NOT NULL AND (refresh_url IS NOT NULL OR outcome = 'merge')),
  fill AS (SELECT u, arg_min(d, ord) AS d, arg_min(p, ord) AS p FROM dated WHERE outcome = 'fuzzy' GROUP BY u),
  own AS (SELECT u, arg_min(d, ord) AS d, arg_min(p, ord) AS p FROM dated WHERE outcome = 'merge' GROUP BY u),
  seen AS (SELECT DISTINCT apply_url AS u FROM in{k} JOIN r{k} USING (ord) WHERE outcome = 'merge')
  SELECT v.* REPLACE (coalesce(v.posted_date, fill.d, own.d) AS posted_date,
    CASE WHEN v.posted_date IS NULL THEN coalesce(fill.p, own.p, v.posted_date_precision) ELSE v.posted_date_precision END AS posted_date_precision,
    CASE WHEN seen.u IS NOT NULL OR v.posted_date IS NULL AND fill.d IS NOT NULL THEN {S.AS_OF} ELSE v.fetched_at END AS fetched_at)
  FROM v{k} AS v LEFT JOIN fill ON fill.u = v.apply_url LEFT JOIN own ON own.u = v.apply_url LEFT JOIN seen ON seen.u = v.apply_url
  UNION ALL BY NAME SELECT i.*, {S.AS_OF} AS fetched_at, {S.AS_OF} AS scraped_at FROM in{k} AS i JOIN r{k} USING (ord) WHERE outcome = 'kept')"""


O["stream_ingest"] = f"""WITH landed AS MATERIALIZED ({_landed}), tjobs AS (SELECT *, sha256(apply_url) AS id FROM landed){NAMES},
whole AS MATERIALIZED (SELECT ord, {_columns}, recruiter AS recruiter_name, mail AS recruiter_email, coalesce(cmail, {CONTACT_GUESS}) AS company_contact_email, id FROM fin),
v0 AS MATERIALIZED (SELECT *, {S.AS_OF} - INTERVAL 1 DAY AS fetched_at, {S.AS_OF} - INTERVAL 1 DAY AS scraped_at FROM whole WHERE ord % 4 = 0
  QUALIFY row_number() OVER (PARTITION BY apply_url ORDER BY ord) = 1),{_after(0)},{_after(1)},{_after(2)}
SELECT * REPLACE (md5(description) AS description) FROM v3"""
