"""SQL oracles of reports, audits, repairs, health, merges, ledger, budgets and sessions."""

from __future__ import annotations

from oracle import base as S
from oracle.registry import ORACLES as O
from oracle.scalars import CACHE_JSON, LINKS, RAW_HASH, TIER_KEY, VENDOR, WORDS, cause, intent, with_pages
from oracle.search import COUNTRY_US, GUARDED, score_cte
from oracle.sources import DIM
from postlake import fixed_values as V

J, T, N = S.with_jobs, S.with_text, S.with_incoming

O["stats_overview"] = J("SELECT count(*) AS total, count(*) FILTER (remote_flag) AS remote, round(100.0 * count(*) FILTER (remote_flag) / count(*), 1)::DOUBLE AS remote_pct FROM jobs")
O["count_by_platform"] = J(", g AS (SELECT source_platform, count(*) AS n FROM jobs GROUP BY 1) SELECT *, round(n * 100.0 / (SELECT max(n) FROM g), 1)::DOUBLE AS bar_pct FROM g")
O["top_companies"] = J("SELECT company, count(*) AS n FROM jobs GROUP BY 1 ORDER BY n DESC, company LIMIT 5")
O["market_insights"] = T(""", m AS (SELECT * FROM tjobs WHERE contains(lower(title), 'engineer') OR contains(lower(company), 'engineer') OR contains(lower(description), 'engineer')),
o AS (SELECT count(*) AS total, count(*) FILTER (remote_flag) AS remote, coalesce(round(100.0 * count(*) FILTER (remote_flag) / count(*), 1), 0)::DOUBLE AS remote_pct FROM m),
a AS (SELECT company, count(*) AS n, 'all' AS scope FROM tjobs GROUP BY 1 ORDER BY n DESC, company LIMIT 5),
b AS (SELECT company, count(*) AS n, 'matching' AS scope FROM m GROUP BY 1 ORDER BY n DESC, company LIMIT 5)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b), o""")
O["rejection_histogram"] = T(f""", {GUARDED}, g AS (SELECT reason, count(*) AS n FROM guarded GROUP BY 1)
SELECT reason, n, reason IS NOT NULL AND row_number() OVER (ORDER BY reason IS NULL, n DESC, reason) <= 3 AS leading,
  CASE WHEN coalesce((SELECT n FROM g WHERE reason IS NULL), 0) = 0 THEN 'all_candidates_filtered_out' END AS empty_code FROM g""")
O["empty_state"] = T("SELECT count(*) AS candidates, 0::BIGINT AS passed, 'all_candidates_filtered_out' AS empty_code FROM tjobs")
_cov = f", {GUARDED}, {DIM}, cov AS (SELECT dim.pos, portal, count(g.id) AS n, count(g.id) > 0 AS contributes FROM dim LEFT JOIN (SELECT * FROM guarded WHERE reason IS NULL) g ON g.source_platform = portal GROUP BY 1, 2)"
O["portal_coverage"] = T(_cov + " SELECT portal, n, contributes FROM cov")
O["portal_coverage_summary"] = T(_cov + " SELECT count(*) FILTER (contributes) AS contributing, count(*) AS portals, coalesce(string_agg(portal, ',' ORDER BY pos) FILTER (NOT contributes), '') AS silent FROM cov")
_de = COUNTRY_US.replace("'US'", "'DE'")
O["silent_portals"] = J(f""", {DIM} SELECT portal FROM dim WHERE portal NOT IN (SELECT source_platform FROM jobs WHERE {S.direct_url('source_platform', 'apply_url')}
  AND {_de} AND {S.fresh('1440')} AND regexp_matches(lower(title), '\\bnurse\\b') AND regexp_matches(lower(title), '\\bpractitioner\\b'))""")
O["stage_funnel"] = T(f""", s AS (SELECT *, {S.usable_url('apply_url')} AND trim(title) <> '' AS a, {S.direct_url('source_platform', 'apply_url')} AS du,
  coalesce(posted_date, fetched_at, scraped_at, {S.AS_OF}) >= {S.AS_OF} - INTERVAL 24 HOUR AS dt,
  {S.direct_url('source_platform', 'apply_url')} AND {COUNTRY_US} AND {S.fresh('1440')} AS gd FROM jobs),
bad AS (SELECT source_platform, ord, apply_url FROM s WHERE a AND NOT du QUALIFY row_number() OVER (PARTITION BY source_platform ORDER BY ord) <= 5)
SELECT source_platform, count(*) AS raw, count(*) FILTER (a) AS normalised, count(*) FILTER (a AND du) AS url_valid, count(*) FILTER (a AND du AND dt) AS date_passed,
  count(*) FILTER (a AND du AND dt AND gd) AS guard_passed, count(*) FILTER (a AND du AND dt AND gd) AS "final",
  coalesce((SELECT string_agg(b.apply_url, ' ' ORDER BY b.ord) FROM bad b WHERE b.source_platform = s.source_platform), '') AS rejected_sample
FROM s GROUP BY source_platform""")
O["quality_audit"] = J(""", n AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY source_platform ORDER BY fetched_at DESC NULLS LAST, ord) <= 50)
SELECT source_platform, count(*) AS sampled, round(avg((coalesce(canonical_title, '') = '')::INT) * 100, 1) AS null_canonical_pct,
  round(avg((coalesce(country, '') = '')::INT) * 100, 1) AS null_country_pct, round(avg((posted_date IS NULL)::INT) * 100, 1) AS null_posted_pct,
  round(avg((job_type = 'unknown')::INT) * 100, 1) AS unknown_type_pct, avg((job_type = 'unknown')::INT) > 0.75 AS alert FROM n GROUP BY 1""")
O["date_overview"] = J("SELECT count(*) AS total, count(posted_date) AS dated, count(*) - count(posted_date) AS undated FROM jobs")
_imp = "coalesce(posted_date > scraped_at + INTERVAL 6 HOUR, false)"
O["corrupted_by_platform"] = J(f"""SELECT source_platform, count(posted_date) AS dated, count(*) FILTER ({_imp}) AS corrupted,
  round(100.0 * count(*) FILTER ({_imp}) / count(posted_date), 1)::DOUBLE AS share_pct,
  max(floor(epoch_us(posted_date - scraped_at) / 86400000000.0)::BIGINT) FILTER ({_imp}) AS worst_gap_days FROM jobs GROUP BY 1 HAVING count(*) FILTER ({_imp}) > 0""")
_same = lambda b: f"coalesce(abs(epoch_us(posted_date - {b})) < 2000000, false)"
_fp = f"fp AS (SELECT count(posted_date) AS dated, count(*) FILTER ({_same('fetched_at')}) AS equals_fetched, count(*) FILTER ({_same('scraped_at')}) AS equals_scraped FROM jobs)"
O["backfill_fingerprint"] = J(f", {_fp} SELECT *, equals_fetched > greatest(20, dated * 0.05) AS fabricated FROM fp")
O["busiest_hours"] = J("SELECT date_trunc('hour', posted_date) AS hour, count(*) AS n FROM jobs WHERE posted_date IS NOT NULL GROUP BY 1 ORDER BY n DESC, hour LIMIT 3")
O["verify_windows"] = J(" UNION ALL ".join(f"SELECT {S.q(n)} AS \"window\", count(*) FILTER ({S.fresh(str(m))}) AS admitted, count(*) FILTER (({S.fresh(str(m))}) AND epoch_us({S.AS_OF} - {S.EFF_TS}) / 3600000000.0 > {m} / 60.0 + 0.05) AS violations FROM jobs" for n, _, m in V.UI_WINDOWS))
O["corroboration"] = J(f""", k AS (SELECT {TIER_KEY} AS tier_key, 'Tier ' || ((ord // 10) % 4 + 1) AS tier, ord, id FROM jobs),
p AS (SELECT tier_key, tier, count(*) AS n, min(ord) AS o, arg_min(id, ord) AS id FROM k GROUP BY 1, 2)
SELECT tier_key, sum(n)::BIGINT AS copies, arg_min(id, o) AS first_id, string_agg(tier, ',' ORDER BY o) AS tiers FROM p GROUP BY 1""")
O["distinct_platforms"] = J("SELECT DISTINCT source_platform FROM jobs")
_ld = "CASE WHEN page_id % 4 = 0 THEN 1 WHEN page_id % 4 = 1 THEN 2 ELSE 0 END"
VERD = f""", v AS (SELECT page_id, ({_ld})::BIGINT AS jsonld, {LINKS} AS cards, {VENDOR} AS vendor, status, {WORDS} AS words FROM vpages),
vv AS (SELECT page_id, jsonld, cards, CASE WHEN vendor IS NOT NULL THEN 'BLOCKED' WHEN status <> 200 THEN 'UNREACHABLE' WHEN jsonld > 0 THEN 'FREE_JSONLD'
  WHEN cards >= 5 THEN 'FREE_STATIC' WHEN page_id IN (SELECT page_id FROM pages WHERE length(regexp_extract(url, '://([^/?#]*)', 1)) % 4 = 2) THEN 'FREE_SITEMAP' WHEN cards = 0 AND words < 250 THEN 'JS_ONLY' ELSE 'INCONCLUSIVE' END AS verdict FROM v)"""
O["page_verdict"] = with_pages(VERD + " SELECT * FROM vv")
O["source_probe_summary"] = with_pages(VERD + " SELECT count(*) AS pages, count(*) FILTER (starts_with(verdict, 'FREE')) AS free, count(*) FILTER (verdict = 'JS_ONLY') AS js_only, count(*) FILTER (verdict = 'BLOCKED') AS blocked, round(100.0 * count(*) FILTER (starts_with(verdict, 'FREE')) / count(*), 1)::DOUBLE AS paid_call_reduction_pct FROM vv")

LAST = "last_run AS (SELECT *, count(*) OVER (PARTITION BY portal) AS runs FROM runs QUALIFY row_number() OVER (PARTITION BY portal ORDER BY ts DESC, run_id DESC) = 1)"
O["latest_run_per_portal"] = S.with_runs(f", {LAST} SELECT portal, ts, run_id, layer_used, success, num_jobs_found, error_message, runs FROM last_run")
O["latest_n_per_platform"] = J("SELECT id, source_platform, fetched_at FROM jobs QUALIFY row_number() OVER (PARTITION BY source_platform ORDER BY fetched_at DESC NULLS LAST, ord) <= 20")
HEALTH = """h0 AS (SELECT *, coalesce(success AND num_jobs_found > 0, false) AS won, row_number() OVER (PARTITION BY method, portal ORDER BY ts DESC, run_id DESC) AS rn FROM runs),
h1 AS (SELECT method, portal, avg(won::INT) FILTER (rn <= 20) AS rate, avg(num_jobs_found) FILTER (rn <= 20) AS jobs, count(*) AS total_runs, count(*) FILTER (won) AS successful_runs,
  max(ts) FILTER (won) AS last_success, arg_max(error_message, (ts, run_id)) FILTER (NOT won AND error_message IS NOT NULL) AS last_error FROM h0 GROUP BY 1, 2),
health AS (SELECT method, portal, CASE WHEN rate < 0.3 THEN 'CRITICAL' WHEN rate < 0.7 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health_status, round(rate, 2) AS success_rate,
  round(jobs, 1) AS avg_jobs, total_runs, successful_runs, last_success, last_error, rate < 0.7 AS falls_back FROM h1)"""
O["method_health"] = S.with_runs(f", {HEALTH} SELECT * FROM health")
_routes = " UNION ALL ".join(f"SELECT {i}::INTEGER AS step, {m}::INTEGER AS method, {S.q(lab)} AS label, {S.q(p)} AS portal, false AS is_fallback" for i, (m, lab, ps) in enumerate(V.METHOD_ROUTES) for p in ps)
_m2 = next(ps for m, _, ps in V.METHOD_ROUTES if m == 2)
O["method_routing"] = S.with_runs(f", {HEALTH} {_routes} UNION ALL SELECT 4, 3, {S.q(V.FALLBACK_METHOD[1])}, portal, true FROM health WHERE method = 'Method 2' AND falls_back AND portal IN {S.in_list(_m2)}")
_vis = f"CASE WHEN posted_date IS NOT NULL THEN posted_date >= {S.AS_OF} - INTERVAL 7 DAY ELSE coalesce(fetched_at >= {S.AS_OF} - INTERVAL 7 DAY, false) OR coalesce(scraped_at >= {S.AS_OF} - INTERVAL 7 DAY, false) END"
_both = f"WITH {S.JOBS}, {S.RUNS}, {DIM}, {LAST}"
O["portal_status"] = f"""{_both}, k AS (SELECT source_platform, count(*) AS stored, count(*) FILTER ({_vis}) AS visible FROM jobs GROUP BY 1)
SELECT d.portal, portal_name, portal_type, layer_used AS operating_layer, CASE WHEN ts IS NULL THEN 'UNKNOWN' WHEN success THEN 'HEALTHY' ELSE 'DEGRADED_CACHED' END AS status,
  CASE WHEN success AND num_jobs_found > 0 THEN 'ACTIVE' ELSE 'DEACTIVATED' END AS runtime_status, ts AS last_run, coalesce(num_jobs_found, 0) AS last_jobs_found,
  coalesce(stored, 0) AS total_jobs, coalesce(visible, 0) AS visible_7d, error_message AS last_error
FROM dim d LEFT JOIN last_run l ON l.portal = d.portal LEFT JOIN k ON k.source_platform = d.portal"""
O["portal_diagnostics"] = f"""{_both}, k AS (SELECT source_platform, count(*) AS stored FROM jobs GROUP BY 1), x AS (SELECT d.portal, portal_name, ts, layer_used, success, num_jobs_found, error_message, stored,
  {cause('d.portal')} AS cause FROM dim d LEFT JOIN last_run l ON l.portal = d.portal LEFT JOIN k ON k.source_platform = d.portal)
SELECT portal, portal_name, ts AS last_attempt, layer_used AS last_layer, success AS last_success, coalesce(num_jobs_found, 0) AS last_jobs_found, error_message AS last_error, cause AS diagnosed_cause,
  cause IN ('MISSING_PYTHON_DEPENDENCY', 'NEVER_RUN', 'HEALTHY', 'ZERO_RESULTS_OR_CONNECTOR_ISSUE') AS fixable_in_code, coalesce(stored, 0) AS jobs_in_db FROM x"""
_cause1 = f"CASE WHEN d.portal = 'usajobs' AND {cause('d.portal')} <> 'NEEDS_PARTNER_API_KEY' THEN 'MISSING_CREDENTIALS' ELSE {cause('d.portal')} END"
O["portal_diagnostics_credentials"] = f"""{_both}, k AS (SELECT source_platform, count(*) AS stored FROM jobs GROUP BY 1), x AS (SELECT d.portal, portal_name, ts, layer_used, success, num_jobs_found, error_message, stored,
  {_cause1} AS cause FROM dim d LEFT JOIN last_run l ON l.portal = d.portal LEFT JOIN k ON k.source_platform = d.portal)
SELECT portal, portal_name, ts AS last_attempt, layer_used AS last_layer, success AS last_success, coalesce(num_jobs_found, 0) AS last_jobs_found, error_message AS last_error, cause AS diagnosed_cause,
  cause IN ('MISSING_PYTHON_DEPENDENCY', 'NEVER_RUN', 'HEALTHY', 'ZERO_RESULTS_OR_CONNECTOR_ISSUE') AS fixable_in_code, coalesce(stored, 0) AS jobs_in_db,
  CASE portal WHEN 'weworkremotely' THEN '' WHEN 'linkedin' THEN 'serp_search' WHEN 'usajobs' THEN 'usajobs_key,usajobs_email' ELSE 'serp_search,page_crawl' END AS missing_credentials FROM x"""
LAYERS = """, live AS (SELECT *, CASE WHEN source_platform = 'dice' THEN 2 ELSE ord % 3 + 1 END::INTEGER AS layer FROM jobs WHERE ord % 4 <> 0 AND source_platform NOT IN ('hired', 'careerbuilder')),
cache AS (SELECT * FROM jobs WHERE ord % 4 = 0 AND source_platform NOT IN (SELECT source_platform FROM live)),
best AS (SELECT source_platform, min(layer) AS layer FROM live GROUP BY 1)"""
_cached = lambda n: f"SELECT * FROM cache QUALIFY row_number() OVER (PARTITION BY source_platform ORDER BY fetched_at DESC NULLS LAST, ord) <= {n}"
O["first_nonempty_source"] = J(LAYERS + f" SELECT id, source_platform, layer FROM live SEMI JOIN best USING (source_platform, layer) UNION ALL SELECT id, source_platform, 4 FROM ({_cached(10)})")
O["fallback_alerts"] = f"""{_both} {LAYERS}
SELECT portal, 'Layers 1-3' AS failed_layer, coalesce(error_message, 'All live layers unreachable') AS failure, 'DEGRADED_SERVED_CACHE' AS status, {S.AS_OF} AS ts
FROM (SELECT DISTINCT source_platform FROM cache) k LEFT JOIN last_run l ON l.portal = k.source_platform""".replace("SELECT portal,", "SELECT k.source_platform AS portal,")
O["tier_cache_fallback"] = J(LAYERS + f" SELECT id, source_platform, false AS stale FROM live UNION ALL SELECT id, source_platform, true FROM ({_cached(20)})")
LADDER = f""", {score_cte('tjobs', [('nurse practitioner', ['nurse', 'practitioner'])])},
l0 AS (SELECT source_platform, ((ord // 10) % 4)::INTEGER AS tier, count(*) AS n, count(*) FILTER (is_exact) AS exact FROM score GROUP BY 1, 2),
l1 AS (SELECT *, (sum(n) OVER w)::BIGINT AS cum_n, (sum(exact) OVER w)::BIGINT AS cum_exact FROM l0 WINDOW w AS (PARTITION BY source_platform ORDER BY tier)),
l2 AS (SELECT *, round(cum_exact / cum_n, 3) AS match_yield FROM l1),
l3 AS (SELECT *, CASE WHEN cum_exact >= 12 THEN 'satisfied' WHEN cum_exact >= 5 AND match_yield >= 0.25 THEN 'sufficient' WHEN cum_exact < 5 THEN 'too_few_exact' ELSE 'low_yield' END AS decision FROM l2),
l4 AS (SELECT *, decision IN ('satisfied', 'sufficient') AS stop FROM l3),
ladder AS (SELECT *, NOT coalesce(bool_or(stop) OVER (PARTITION BY source_platform ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS runs FROM l4)"""
O["escalation_ladder"] = T(LADDER + " SELECT * FROM ladder")
O["escalation_ladder_no_query"] = J(""", l0 AS (SELECT source_platform, ((ord // 10) % 4)::INTEGER AS tier, count(*) AS n, count(*) AS exact FROM jobs GROUP BY 1, 2),
l1 AS (SELECT *, (sum(n) OVER w)::BIGINT AS cum_n, (sum(exact) OVER w)::BIGINT AS cum_exact, 1.0::DOUBLE AS match_yield FROM l0 WINDOW w AS (PARTITION BY source_platform ORDER BY tier)),
l2 AS (SELECT *, CASE WHEN cum_n >= 5 THEN 'no_query_sufficient_rows' ELSE 'no_query_too_few_rows' END AS decision, cum_n >= 5 AS stop FROM l1)
SELECT *, coalesce(lag(cum_n) OVER (PARTITION BY source_platform ORDER BY tier), 0) < 5 AS runs FROM l2""")
O["ladder_stats"] = T(LADDER + """, p AS (SELECT source_platform, bool_or(tier = 0 AND stop) AS free, bool_or(tier = 1 AND runs) AS t1, bool_or(tier = 2 AND runs) AS t2, bool_or(tier = 3 AND runs) AS t3 FROM ladder GROUP BY 1)
SELECT count(*) AS portals, count(*) FILTER (free) AS answered_free, count(*) FILTER (NOT free) AS escalated, round(100.0 * count(*) FILTER (free) / count(*), 1)::DOUBLE AS free_coverage_pct,
  count(*) FILTER (t1) AS tier1_calls, count(*) FILTER (t2) AS tier2_calls, count(*) FILTER (t3) AS tier3_calls FROM p""")

_cut = f"{S.AS_OF} - INTERVAL 15 DAY"
O["retention_purge"] = J(f"SELECT id, posted_date, fetched_at, scraped_at FROM jobs WHERE NOT coalesce(posted_date < {_cut} OR (posted_date IS NULL AND fetched_at < {_cut} AND (scraped_at IS NULL OR scraped_at < {_cut})), false)")
O["purge_unusable_urls"] = J("SELECT id, apply_url FROM jobs WHERE apply_url NOT LIKE '%google.com/search%' AND apply_url NOT LIKE '%ibp=htl;jobs%' AND apply_url NOT LIKE '%bing.com/search%' AND apply_url NOT LIKE '%google.com/url?%'")
_wrong = f"({_imp} OR ((SELECT equals_fetched > greatest(20, dated * 0.05) FROM fp) AND {_same('fetched_at')}))"
O["repair_dates"] = J(f", {_fp} SELECT id, CASE WHEN NOT {_wrong} THEN posted_date END AS posted_date, CASE WHEN {_wrong} THEN 'unknown' ELSE posted_date_precision END AS posted_date_precision FROM jobs")
O["repair_to_first_seen"] = J(f"SELECT id, CASE WHEN {_imp} THEN scraped_at ELSE posted_date END AS posted_date, CASE WHEN {_imp} THEN 'day' ELSE posted_date_precision END AS posted_date_precision FROM jobs")
O["backfill_precision"] = J(f"SELECT id, posted_date, coalesce(posted_date_precision, {S.stored_precision('posted_date', 'source_platform')}) AS posted_date_precision FROM jobs")
_c1, _k1 = S.place("coalesce(city, country)", "country")
O["backfill_normalization"] = T(f"""SELECT id, {S.canonical_title('title')} AS canonical_title, {S.job_type('source_platform', "concat_ws(' ', job_type, title, description)")} AS job_type,
  CASE WHEN regexp_matches({_k1}, '^[A-Za-z]{{2}}$') THEN upper({_k1}) END AS country, coalesce(remote_flag, false) AS remote_flag FROM tjobs""")
_c2, _k2 = S.place("nullif(concat_ws(', ', city, country), '')", "country")
O["fix_locations"] = J(f", f AS (SELECT id, city, country, {_c2} AS new_city, {_k2} AS new_country FROM jobs) SELECT *, new_city IS DISTINCT FROM city OR new_country IS DISTINCT FROM country AS changed FROM f")

# --- merges ----------------------------------------------------------------------------------------
MERGED = f""", f AS (SELECT apply_url, min(ord) AS o, arg_min(id, ord) AS id, arg_min(title, ord) AS title, arg_min(company, ord) AS company, arg_min(source_platform, ord) AS source_platform,
  min(ord) FILTER (posted_date IS NOT NULL) AS od, max(posted_date) AS latest FROM incoming GROUP BY 1),
g AS (SELECT f.*, d.posted_date AS dpd, d.posted_date_precision AS dpp, n.posted_date_precision AS npp FROM f LEFT JOIN incoming d ON d.ord = f.od JOIN incoming n ON n.ord = f.o),
m AS (SELECT CASE WHEN s.id IS NOT NULL THEN s.id ELSE g.id END AS id, CASE WHEN s.id IS NOT NULL THEN s.title ELSE g.title END AS title,
  CASE WHEN s.id IS NOT NULL THEN s.company ELSE g.company END AS company, CASE WHEN s.id IS NOT NULL THEN s.source_platform ELSE g.source_platform END AS source_platform,
  coalesce(s.apply_url, g.apply_url) AS apply_url, coalesce(s.posted_date, dpd) AS posted_date,
  CASE WHEN s.id IS NOT NULL AND s.posted_date IS NULL AND dpd IS NOT NULL THEN coalesce(dpp, s.posted_date_precision) WHEN s.id IS NOT NULL THEN s.posted_date_precision ELSE coalesce(dpp, npp) END AS posted_date_precision,
  CASE WHEN g.id IS NOT NULL THEN {S.AS_OF} ELSE s.fetched_at END AS fetched_at, CASE WHEN s.id IS NOT NULL THEN s.scraped_at ELSE {S.AS_OF} END AS scraped_at,
  CASE WHEN s.id IS NULL THEN 'inserted' WHEN s.posted_date IS NULL AND dpd IS NOT NULL THEN 'refreshed' WHEN g.latest > s.posted_date THEN 'bump_ignored' WHEN g.id IS NOT NULL THEN 'reconfirmed' ELSE 'untouched' END AS action
  FROM stored s FULL JOIN g ON s.apply_url = g.apply_url)"""
O["merge_write_once"] = N(MERGED + " SELECT * FROM m")
O["merge_counts"] = N(MERGED + " SELECT action, count(*) AS n FROM m GROUP BY 1")
O["insert_absent"] = N(" SELECT arg_min(id, ord) AS id, apply_url, min(ord) AS ord FROM incoming WHERE apply_url NOT IN (SELECT apply_url FROM stored) GROUP BY apply_url")
_ihash = f", i AS (SELECT *, {RAW_HASH} AS raw_hash FROM incoming), s AS (SELECT apply_url, {RAW_HASH} AS raw_hash FROM stored)"
O["insert_hash_dedup"] = N(_ihash + """, u AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY apply_url ORDER BY ord) = 1), h AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY raw_hash ORDER BY ord) = 1)
SELECT id, ord, raw_hash FROM h WHERE apply_url NOT IN (SELECT apply_url FROM s) AND raw_hash NOT IN (SELECT raw_hash FROM s)""")
O["anti_url_or_hash"] = N(_ihash + " SELECT id, ord FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.apply_url = i.apply_url) AND NOT EXISTS (SELECT 1 FROM s WHERE s.raw_hash = i.raw_hash)")
O["append_runlog"] = N(f""", {DIM} SELECT portal, {S.AS_OF} AS ts, '5-Tier' AS layer_used, count(i.id) > 0 AS success, count(i.id)::DOUBLE AS num_jobs_found,
  CASE WHEN count(i.id) = 0 THEN 'Returned 0 results for this query' END AS error_message FROM dim LEFT JOIN incoming i ON i.source_platform = portal AND portal <> 'hired' GROUP BY portal""")
O["append_guard_audit"] = T(f""", {GUARDED} SELECT id AS job_id, sha256('{{"country": "ALL", "date_posted": "past_7d", "job_title": "cloud engineer", "job_type": "all", "platform": "all", "q": "", "remote_only": false}}') AS filter_hash,
  'Step 5 Validator' AS check_level, 'EXCLUDE' AS outcome, reason, {S.AS_OF} AS ts FROM guarded WHERE reason IS NOT NULL""")
_mails = f"list_filter(list_transform(regexp_extract_all(description, {S.q(V.EMAIL_PATTERN)}), lambda e: lower(e)), lambda e: NOT list_contains({S.arr(V.GENERIC_MAILBOXES)}, split_part(e, '@', 1)))[1]"
O["export_search_docs"] = T(f"""SELECT id, title, salary_max, CASE WHEN posted_date = date_trunc('second', posted_date) THEN strftime(posted_date, '%Y-%m-%dT%H:%M:%S') ELSE strftime(posted_date, '%Y-%m-%dT%H:%M:%S.%f') END AS posted_date,
  {_mails} AS recruiter_email, md5(description) AS snippet_md5, 17::BIGINT AS fields FROM tjobs""")
O["copy_missing_by_id"] = J("SELECT id, title, company FROM jobs WHERE ord % 4 <> 0")
PF = """, paid AS (SELECT ord, id, CASE WHEN ord % 4 = 0 THEN 'https://boards.greenhouse.io/acme/jobs/' || (ord // 40) ELSE apply_url END AS apply_url FROM jobs WHERE ord % 2 = 0),
free AS (SELECT ord, id, CASE WHEN ord % 14 = 3 THEN '' WHEN ord % 10 = 1 THEN 'https://boards.greenhouse.io/acme/jobs/' || (ord // 30) ELSE apply_url END AS apply_url FROM jobs WHERE ord % 2 = 1)"""
O["merge_partial"] = J(PF + " SELECT id, apply_url FROM paid UNION ALL SELECT arg_min(id, ord), apply_url FROM free WHERE apply_url <> '' AND apply_url NOT IN (SELECT apply_url FROM paid) GROUP BY apply_url")
O["distinct_union_url"] = J(PF + " SELECT arg_min(id, p) AS id, apply_url FROM (SELECT *, ord AS p FROM paid UNION ALL SELECT *, ord + 1000000000000 FROM free) WHERE apply_url <> '' GROUP BY apply_url")
O["union_tiers"] = J("SELECT id, title, CASE WHEN ord % 3 = 0 THEN salary_min END AS salary_min, CASE WHEN ord % 3 = 1 THEN skills END AS skills, CASE WHEN ord % 3 = 2 THEN source_platform END AS source_platform, CASE ord % 3 WHEN 0 THEN 'Tier 1' WHEN 1 THEN 'Tier 2' ELSE 'Tier 4' END AS source_tier FROM jobs")
VERDICT = f""", {DIM}, new AS (SELECT * FROM incoming WHERE source_platform <> 'dice'), ins AS (SELECT arg_min(source_platform, ord) AS sp FROM new WHERE apply_url NOT IN (SELECT apply_url FROM stored) GROUP BY apply_url),
vd AS (SELECT portal, (SELECT count(*) FROM new WHERE source_platform = portal) AS found, (SELECT count(*) FROM ins WHERE sp = portal) AS inserted,
  (SELECT count(*) FROM stored WHERE source_platform = portal) + (SELECT count(*) FROM ins WHERE sp = portal) AS total FROM dim)"""
O["run_verdict"] = N(VERDICT + " SELECT *, CASE WHEN found > 0 THEN 'ACTIVE' ELSE 'ZERO_RESULTS' END AS status FROM vd")
O["run_verdict_summary"] = N(VERDICT + " SELECT count(*) AS attempted, count(*) FILTER (found > 0) AS returning, string_agg(portal, ',' ORDER BY portal) FILTER (found > 0) AS working, string_agg(portal, ',' ORDER BY portal) FILTER (found = 0) AS silent FROM vd")


# --- ledger: a sequential fold over each key's sorted requests ---------------------------------------
def fold(src: str, key: str, ttl_us: str) -> str:
    """CTEs ``acc`` (accepted ids) from ``src``(id, ts, key) by folding each key's sorted list."""
    return f"""
ev0 AS (SELECT {key} AS k, list({{'us': epoch_us(ts), 'id': request_id, 'ttl': {ttl_us}}} ORDER BY ts, request_id) AS xs FROM {src} GROUP BY 1),
ev1 AS (SELECT k, list_reduce(list_transform(xs, lambda x: {{'us': x.us, 'ttl': x.ttl, 'ids': [x.id]}}),
  lambda a, x: CASE WHEN x.us - a.us >= x.ttl THEN {{'us': x.us, 'ttl': x.ttl, 'ids': list_concat(a.ids, x.ids)}} ELSE a END) AS r FROM ev0),
acc AS (SELECT unnest(r.ids) AS request_id FROM ev1)"""


DEC = f""", kq AS (SELECT request_id, ts, {CACHE_JSON} AS js, sha256({CACHE_JSON}) AS cache_key, {S.bucket(S.minutes('date_posted'))} AS bucket FROM requests),
kp AS (SELECT *, CASE bucket WHEN '12h' THEN 90 WHEN '24h' THEN 180 ELSE 1440 END AS serve FROM kq), {fold('kp', 'cache_key', 'serve * 60000000::BIGINT')},
de AS (SELECT kp.*, acc.request_id IS NOT NULL AS should_scrape FROM kp LEFT JOIN acc USING (request_id)),
dec AS (SELECT *, max(CASE WHEN should_scrape THEN ts END) OVER (PARTITION BY cache_key ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_scraped_at FROM de),
dm AS (SELECT *, CASE WHEN NOT should_scrape THEN NULL WHEN last_scraped_at IS NULL THEN 'full' WHEN bucket IN ('12h', '24h') THEN 'full' ELSE 'delta' END AS mode FROM dec),
book AS (SELECT cache_key, max(ts) FILTER (should_scrape) AS last_scraped_at, min(ts) FILTER (should_scrape) AS created_at, any_value(bucket) AS date_bucket, count(*) FILTER (should_scrape) AS scrape_count,
  count(*) FILTER (NOT should_scrape) AS hit_count, arg_max(mode, (ts, request_id)) FILTER (should_scrape) AS last_refresh_mode FROM dm GROUP BY 1)"""
R = S.with_requests
O["ledger_lookup"] = R(DEC + " SELECT request_id, cache_key, last_scraped_at FROM dm")
O["cache_decision"] = R(DEC + " SELECT request_id, should_scrape, mode, CASE WHEN mode = 'delta' THEN 24 END AS since_hours, round(epoch_us(ts - last_scraped_at) / 60000000.0, 3) AS age_minutes FROM dm")
O["ledger_record"] = R(DEC + " SELECT * FROM book")
O["ledger_merge"] = R(DEC + " SELECT cache_key, scrape_count, hit_count, date_bucket FROM book")
O["cache_stats"] = R(DEC + " SELECT count(*) AS combinations, sum(scrape_count)::BIGINT AS scrapes, sum(hit_count)::BIGINT AS hits, round(100.0 * sum(hit_count) / (sum(scrape_count) + sum(hit_count)), 1)::DOUBLE AS avoided_pct FROM book")
O["cache_stats_by_bucket"] = R(DEC + " SELECT date_bucket, count(*) AS combinations FROM book GROUP BY 1")
O["purge_ledger"] = R(DEC + " SELECT cache_key, last_scraped_at FROM book WHERE last_scraped_at >= TIMESTAMP '2024-01-29 12:00:00'")
O["cooldown_suppress"] = R(f""", kk AS (SELECT request_id, ts, title AS key FROM requests), {fold('kk', 'key', '3600000000::BIGINT')},
m AS (SELECT kk.*, acc.request_id IS NOT NULL AS accepted FROM kk LEFT JOIN acc USING (request_id))
SELECT request_id, key, accepted, max(CASE WHEN accepted THEN ts END) OVER (PARTITION BY key ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_accepted_at FROM m""")
_quota = "CASE portal" + "".join(f" WHEN {S.q(p)} THEN {n}" for p, n in V.DAILY_QUOTAS.items()) + " ELSE 1000 END::BIGINT"
O["quota_usage"] = S.with_runs(f""", r AS (SELECT run_id AS call_id, portal AS source, ts::DATE AS day, {_quota} AS quota, row_number() OVER (PARTITION BY portal, ts::DATE ORDER BY ts, run_id) - 1 AS n FROM runs)
SELECT call_id, source, day, quota, least(n, quota) AS used_before, n < quota AS allowed FROM r""")
O["call_budget"] = S.with_runs(""", r AS (SELECT run_id AS call_id, ts, coalesce(error_message = '403 forbidden', false) AS blocked, date_trunc('hour', ts) AS h, date_trunc('day', ts) AS d,
  row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, run_id) AS rn FROM runs),
hh AS (SELECT d, h, least(count(*), 12) AS want FROM r GROUP BY 1, 2), g AS (SELECT h, coalesce(sum(want) OVER (PARTITION BY d ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM hh),
j AS (SELECT r.*, greatest(least(12, 150 - used), 0) AS gr FROM r JOIN g USING (h)),
k AS (SELECT *, rn <= gr AS ok, count(*) FILTER (rn > gr AND blocked) OVER (ORDER BY ts, call_id) AS dn FROM j)
SELECT call_id, ts, blocked, CASE WHEN ok THEN 'ok' WHEN blocked AND dn <= 75 THEN 'reserve' WHEN gr >= 12 THEN 'hourly' ELSE 'daily' END AS decision FROM k""")
_it = intent()
O["session_intent_carry"] = S.with_prompts(f""", i AS (SELECT session_id, turn, ts, {', '.join(f'{e} AS {k}' for k, e in _it.items())} FROM prompts),
p AS (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, turn) AS prev FROM i),
n AS (SELECT *, prev IS NULL OR ts - prev > INTERVAL 30 MINUTE AS isnew FROM p),
s AS (SELECT *, (sum(isnew::BIGINT) OVER (PARTITION BY session_id ORDER BY ts, turn))::BIGINT AS session_no, asks_details AND NOT isnew AS is_detail_request, (refers_back OR asks_details) AND NOT isnew AS is_follow_up FROM n),
z AS (SELECT session_id, session_no, list({{'turn': turn, 'f': is_follow_up, 'd': is_detail_request, 'query': query, 'remote_only': remote_only, 'country': country, 'min_salary': min_salary, 'platform': platform}} ORDER BY ts, turn) AS xs FROM s GROUP BY 1, 2),
w AS (SELECT session_id, session_no, list_reduce(list_transform(xs, lambda x: [x]), lambda a, b: list_concat(a, [{{'turn': b[1].turn, 'f': b[1].f, 'd': b[1].d,
  'query': CASE WHEN b[1].f AND b[1].query IS NULL THEN a[-1].query ELSE b[1].query END, 'remote_only': CASE WHEN b[1].f AND NOT b[1].remote_only THEN a[-1].remote_only ELSE b[1].remote_only END,
  'country': CASE WHEN b[1].f AND b[1].country IS NULL THEN a[-1].country ELSE b[1].country END, 'min_salary': CASE WHEN b[1].f AND b[1].min_salary IS NULL THEN a[-1].min_salary ELSE b[1].min_salary END,
  'platform': CASE WHEN b[1].f AND b[1].platform IS NULL THEN a[-1].platform ELSE b[1].platform END}}])) AS r FROM z),
u AS (SELECT session_id, session_no, unnest(r) AS x FROM w)
SELECT session_id, x.turn AS turn, session_no, x.f AS is_follow_up, x.d AS is_detail_request, x.query AS query, x.remote_only AS remote_only, x.country AS country, x.min_salary AS min_salary, x.platform AS platform FROM u""")
O["lru_cap"] = S.with_prompts("""SELECT session_id, max(ts) AS last_accessed, count(*) AS prompts FROM prompts GROUP BY 1
HAVING TIMESTAMP '2024-01-04 00:00:00' - max(ts) <= INTERVAL 60 DAY ORDER BY last_accessed DESC, session_id LIMIT 1000""")


# --- fuzzy matching: distinct strings compared pair by pair -----------------------------------------
def _words(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> '')))"


def _pairs(src: str, col: str, out: str, threshold: float) -> str:
    """CTEs ending in ``out``(a, b, ratio): every pair of distinct ``col`` values of ``src``, with the full letter alignment."""
    p = out + "_"
    row = (
        "list_transform(range(1, len(mask) + 1), lambda j: list_max(list_transform(range(1, j + 1), "
        "lambda k: CASE WHEN mask[k] = 1 THEN coalesce(prev[k - 1], 0) + 1 ELSE prev[k] END)))"
    )
    return f"""
{p}s AS (SELECT DISTINCT {col} AS v, {_words(col)} AS w FROM {src} WHERE {col} IS NOT NULL AND {col} <> ''),
{p}c AS (SELECT l.v AS a, r.v AS b, list_filter(l.w, lambda x: list_contains(r.w, x)) AS i, array_to_string(list_filter(l.w, lambda x: NOT list_contains(r.w, x)), ' ') AS x,
  array_to_string(list_filter(r.w, lambda x: NOT list_contains(l.w, x)), ' ') AS y FROM {p}s l, {p}s r),
{p}m AS (SELECT *, length(array_to_string(i, ' ')) AS s, CASE WHEN len(i) > 0 THEN 1 ELSE 0 END AS g,
  list_transform(string_split(x, ''), lambda c: list_transform(string_split(y, ''), lambda d: (c = d)::INTEGER)) AS masks,
  list_transform(string_split(y, ''), lambda d: 0) AS zero FROM {p}c),
{p}l AS (SELECT *, CASE WHEN x = '' OR y = '' THEN 0 ELSE list_reduce(list_prepend(zero, masks), lambda prev, mask: {row})[-1] END AS lcs FROM {p}m),
{p}r AS (SELECT a, b, CASE WHEN len(i) > 0 AND (x = '' OR y = '') THEN 100.0 ELSE greatest(
  100.0 * (1 - (length(x) + length(y) - 2 * lcs) / (2.0 * s + 2 * g + length(x) + length(y))),
  CASE WHEN s > 0 THEN 100.0 * (1 - (g + length(x)) / (2.0 * s + g + length(x))) ELSE 0 END,
  CASE WHEN s > 0 THEN 100.0 * (1 - (g + length(y)) / (2.0 * s + g + length(y))) ELSE 0 END) END::DOUBLE AS ratio FROM {p}l),
{out} AS (SELECT * FROM {p}r WHERE ratio >= {threshold})"""


from oracle.scalars import match_key  # noqa: E402

_KEYED = f"kj AS (SELECT *, {match_key('company')} AS ck, {match_key('title')} AS tk FROM jobs)"
O["token_set_ratio"] = J(f", {_KEYED}, {_pairs('kj', 'tk', 'tp', 76)} SELECT a AS t, b AS t_b, round(ratio, 6) AS ratio FROM tp")
O["fuzzy_pairs"] = J(f""", {_KEYED}, {_pairs('kj', 'tk', 'tp', V.TITLE_MATCH_THRESHOLD)}, {_pairs('kj', 'ck', 'cp', V.COMPANY_MATCH_THRESHOLD)},
sg AS (SELECT ck, tk, count(*) AS n FROM kj WHERE ck <> '' AND tk <> '' GROUP BY 1, 2)
SELECT l.ck AS company_a, l.tk AS title_a, r.ck AS company_b, r.tk AS title_b, round(cp.ratio, 6) AS company_ratio, round(tp.ratio, 6) AS title_ratio, l.n AS n_a, r.n AS n_b
FROM sg l JOIN cp ON cp.a = l.ck JOIN sg r ON r.ck = cp.b JOIN tp ON tp.a = l.tk AND tp.b = r.tk""")

# Sequential resolution: stored postings and merged re-scrapes are taken first by order; the remaining
# rows are folded signature by signature in order of first appearance (a signature blocks its own repeats,
# and the links of these rows are all different).
FUZZY = f""", al AS (SELECT ord, apply_url, company, title, posted_date, 0 AS new FROM stored UNION ALL SELECT ord, apply_url, company, title, posted_date, 1 FROM incoming),
kj AS (SELECT *, {match_key('company')} AS ck, {match_key('title')} AS tk FROM al), {_pairs('kj', 'tk', 'tp', V.TITLE_MATCH_THRESHOLD)}, {_pairs('kj', 'ck', 'cp', V.COMPANY_MATCH_THRESHOLD)},
k2 AS (SELECT *, CASE WHEN ck <> '' AND tk <> '' THEN ck || '|' || tk END AS sig FROM kj),
sg AS (SELECT DISTINCT ck, tk, sig FROM k2 WHERE sig IS NOT NULL),
ed AS MATERIALIZED (SELECT l.sig AS a, r.sig AS b FROM sg l JOIN cp ON cp.a = l.ck JOIN sg r ON r.ck = cp.b JOIN tp ON tp.a = l.tk AND tp.b = r.tk),
st AS (SELECT sig, min(ord) AS o, arg_min(apply_url, ord) AS u FROM k2 WHERE new = 0 AND sig IS NOT NULL GROUP BY 1),
mt AS (SELECT ed.a AS sig, arg_min(st.u, st.o) AS url FROM ed JOIN st ON st.sig = ed.b GROUP BY 1),
nw AS (SELECT k2.*, k2.apply_url IN (SELECT apply_url FROM stored) AS known FROM k2 WHERE new = 1),
mg AS (SELECT ed.a AS sig, min(nw.ord) AS o FROM nw JOIN ed ON ed.b = nw.sig WHERE known GROUP BY 1),
fr AS (SELECT nw.sig, min(nw.ord) AS o FROM nw LEFT JOIN mt ON mt.sig = nw.sig LEFT JOIN mg ON mg.sig = nw.sig AND mg.o < nw.ord
  WHERE NOT known AND nw.sig IS NOT NULL AND mt.sig IS NULL AND mg.sig IS NULL GROUP BY 1),
nb AS (SELECT fr.sig, fr.o, list(ed.b) AS near FROM fr JOIN ed ON ed.a = fr.sig GROUP BY 1, 2),
fo AS (SELECT list_reduce(list_prepend([]::VARCHAR[], list_transform(list({{'s': sig, 'n': near}} ORDER BY o), lambda e: list_prepend(e.s, e.n))),
  lambda kept, e: CASE WHEN list_has_any(kept, e[2:]) THEN kept ELSE list_append(kept, e[1]) END) AS kept FROM nb),
rs AS (SELECT nw.ord, CASE WHEN known THEN 'merge' WHEN nw.sig IS NULL THEN 'kept' WHEN fr.sig IS NOT NULL AND fr.o = nw.ord AND list_contains((SELECT kept FROM fo), nw.sig) THEN 'kept' ELSE 'fuzzy' END AS outcome,
  mt.url, nw.posted_date FROM nw LEFT JOIN mt ON mt.sig = nw.sig LEFT JOIN fr ON fr.sig = nw.sig),
res AS (SELECT ord, outcome, CASE WHEN outcome = 'fuzzy' THEN url END AS refresh_url, posted_date FROM rs)"""
O["greedy_dedup"] = N(FUZZY + " SELECT ord, outcome, refresh_url FROM res")
O["refresh_candidates"] = N(FUZZY + """, rc AS (SELECT r.ord, r.refresh_url, r.posted_date AS new_date, s.posted_date AS old_date FROM res r JOIN stored s ON s.apply_url = r.refresh_url)
SELECT *, CASE WHEN old_date IS NULL AND new_date IS NOT NULL AND ord = min(ord) FILTER (old_date IS NULL AND new_date IS NOT NULL) OVER (PARTITION BY refresh_url) THEN 'refreshed' ELSE 'skipped' END AS action FROM rc""")
O["ingest_metrics"] = N(FUZZY + """ SELECT count(*) AS normalised, count(*) FILTER (outcome = 'fuzzy') AS duplicates, count(*) FILTER (outcome = 'kept') AS inserted, count(*) FILTER (outcome = 'merge') AS reconfirmed,
  round(100.0 * count(*) FILTER (outcome = 'fuzzy') / count(*), 1)::DOUBLE AS dedup_pct, round(100.0 * count(*) FILTER (outcome <> 'fuzzy') / count(*), 1)::DOUBLE AS clean_pct FROM res""")
