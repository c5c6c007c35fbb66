"""SQL oracles of the source readers: computed from the postings, never from the payload text."""

from __future__ import annotations

from oracle import base as S
from oracle.registry import ORACLES as O
from oracle.scalars import strip_html, with_pages
from postlake import fixed_values as V
from postlake.plans import bindings as B

T, J = S.with_text, S.with_jobs

_TRIM = "chr(32) || chr(9) || chr(10) || chr(13)"
TITLE = "CASE WHEN ord % 4 = 0 THEN title || ' & more' WHEN ord % 23 = 0 THEN '' ELSE title END"
DESC = strip_html("description")


def note(x: str) -> str:
    sent = f"list_transform(regexp_split_to_array({x}, '[.!?\\n]'), lambda s: trim(s, {_TRIM}))"
    return f"left(list_filter({sent}, lambda s: {S.any_of('lower(s)', V.WORK_AUTH_PHRASES)})[1], 200)"


def tail(source: str, country: str | None, base: str, city_remote=False, platform=None) -> str:
    """``base`` selects ord, t, co, url, pl, de, rem, smin, smax, cur, jt, posted, prec."""
    dflt = S.q(country)
    ci, ct = S.place("pl", dflt)
    where = f"({ci})" if city_remote else "pl"
    return f"""SELECT ord, left(t, 255) AS title, {S.canonical_title('t')} AS canonical_title, left(co, 255) AS company,
  {ci} AS city, {ct} AS country, smin AS salary_min, smax AS salary_max, cur AS currency,
  coalesce(rem, false) OR {S.is_remote(f"t || ' ' || de || ' ' || coalesce({where}, '')")} AS remote_flag,
  left(jt, 50) AS job_type, {S.q(source)} AS source_platform, url AS apply_url, md5(coalesce(nullif(de, ''), '')) AS description,
  posted AS posted_date, prec AS posted_date_precision, {note('de')} AS work_authorization_note
FROM ({base}) WHERE t <> '' AND coalesce(url, '') <> ''"""


_exact = "CASE WHEN posted_date IS NULL THEN 'unknown' ELSE 'exact' END"
_nopay = "NULL::DOUBLE AS smin, NULL::DOUBLE AS smax"
BASES = {}
BASES["adzuna"] = tail("adzuna", "US", f"""SELECT ord, {TITLE} AS t, coalesce(nullif(company, ''), 'Unknown Company') AS co,
  CASE WHEN ord % 9 <> 0 THEN apply_url END AS url, location_raw AS pl, {DESC} AS de, false AS rem, salary_min AS smin, salary_max AS smax,
  'USD' AS cur, CASE WHEN ord % 6 = 0 THEN 'full_time-permanent' WHEN ord % 3 = 0 THEN 'full_time' WHEN ord % 2 = 0 THEN 'permanent' ELSE 'full_time' END AS jt,
  posted_date AS posted, {_exact} AS prec FROM tjobs""")
BASES["jsearch"] = tail("jsearch", "US", f"""SELECT ord, {TITLE} AS t, coalesce(nullif(company, ''), 'Backup Co') AS co,
  CASE WHEN ord % 3 < 2 OR ord % 6 = 2 THEN apply_url END AS url, location_raw AS pl, {DESC} AS de, remote_raw AS rem,
  salary_min AS smin, salary_max AS smax, CASE WHEN ord % 2 = 0 THEN 'EUR' ELSE 'USD' END AS cur,
  coalesce(lower(job_type_raw), 'fulltime') AS jt, posted_date AS posted, {_exact} AS prec FROM tjobs""", city_remote=True)
_tok = "CASE WHEN ord % 5 = 0 THEN 'greenhouse board' ELSE lower(replace(company, ' ', '-')) END"
_tcase = (f"array_to_string(list_transform(string_split({_tok}, '-'), lambda w: array_to_string(list_transform(string_split(w, ' '), "
          "lambda v: upper(left(v, 1)) || substr(v, 2)), ' ')), '-')")
BASES["greenhouse"] = tail("greenhouse", None, f"""SELECT ord, {TITLE} AS t, {_tcase} AS co, apply_url AS url, location_raw AS pl, {DESC} AS de,
  false AS rem, {_nopay}, NULL::VARCHAR AS cur, 'full_time' AS jt, posted_date AS posted, {_exact} AS prec FROM tjobs""")
BASES["lever"] = tail("lever", None, f"""SELECT ord, {TITLE} AS t, 'Globex-Labs' AS co, apply_url AS url, location_raw AS pl,
  CASE WHEN ord % 2 = 0 THEN description ELSE {DESC} END AS de, false AS rem, {_nopay}, NULL::VARCHAR AS cur,
  coalesce(job_type_raw, 'full_time') AS jt, date_trunc('millisecond', posted_date) AS posted, {_exact} AS prec FROM tjobs""")
_day = "date_trunc('day', posted_date)::TIMESTAMP"
_dayp = "CASE WHEN posted_date IS NULL THEN 'unknown' ELSE 'day' END"
BASES["remotive"] = tail("remotive", "US", f"""SELECT ord, {TITLE} AS t, company AS co, apply_url AS url, location_raw AS pl, {DESC} AS de,
  true AS rem, {_nopay}, NULL::VARCHAR AS cur, coalesce(job_type_raw, 'full_time') AS jt, {_day} AS posted, {_dayp} AS prec FROM tjobs""")
_alt = "CASE WHEN ord % 2 = 0 THEN 'https://boards.greenhouse.io/acme/jobs/alt-' || ord END"
_x = "CASE WHEN ord % 5 = 0 THEN 'https://x.example.com/j/' || ord END"
BASES["google_jobs"] = tail("google_jobs", "US", f"""SELECT ord, {TITLE} AS t, company AS co,
  coalesce(CASE WHEN {S.usable_url('apply_url')} THEN apply_url END, {_alt}, {_x}) AS url, location_raw AS pl, {DESC} AS de,
  ord % 7 = 0 AS rem, {_nopay}, NULL::VARCHAR AS cur, CASE WHEN ord % 3 <> 0 THEN 'Full-time' ELSE 'full_time' END AS jt,
  CASE WHEN ord % 4 <> 3 THEN {S.AS_OF} - INTERVAL 1 DAY * (ord % 30 + 1)::INTEGER END AS posted,
  CASE WHEN ord % 4 <> 3 THEN 'day' ELSE 'unknown' END AS prec FROM tjobs""")


def _connector(source: str, country: str, dict_country: str) -> str:
    exact = "exact" if source in V.EXACT_PRECISION_PORTALS else "day"
    return tail(source, country, f"""SELECT ord, title AS t,
  coalesce(nullif(company, ''), CASE WHEN ord % 4 = 0 THEN 'Alt Co' END, {S.q(source.capitalize() + ' Employer')}) AS co,
  coalesce(CASE WHEN {S.usable_url('apply_url')} THEN apply_url END, CASE WHEN ord % 3 = 0 THEN 'https://alt.example.com/job/' || ord END) AS url,
  coalesce(location_raw, {S.q(dict_country)}) AS pl, {DESC} AS de, remote_raw AS rem, {_nopay}, {S.q(V.CURRENCY_BY_COUNTRY[country.lower()])} AS cur,
  {S.job_type(S.q(source), f"coalesce(job_type_raw, 'unknown') || ' ' || title || ' ' || {DESC}")} AS jt,
  {_day} AS posted, CASE WHEN posted_date IS NULL THEN 'unknown' ELSE {S.q(exact)} END AS prec FROM tjobs""")


for _name, _sql in BASES.items():
    O["norm_" + _name] = T(_sql)
O["norm_connector"] = T(_connector("linkedin", "IN", "IN"))
_all = {**BASES, "linkedin": _connector("linkedin", "US", "us"), "dice": _connector("dice", "US", "us")}
O["norm_dispatch"] = T(" UNION ALL ".join(
    f"SELECT * FROM ({sql}) WHERE ord % 8 = {i}" for i, sql in enumerate(_all.values())))
O["required_fields"] = T(
    f"SELECT count(*) AS kept, count(*) FILTER (company = 'Unknown Company') AS default_company FROM ({BASES['adzuna']})")

_iso = "CASE WHEN posted_date IS NULL THEN NULL WHEN posted_date = date_trunc('second', posted_date) THEN strftime(posted_date, '%Y-%m-%dT%H:%M:%S') ELSE strftime(posted_date, '%Y-%m-%dT%H:%M:%S.%f') END"
_md5 = lambda x: f"md5(coalesce({x}, ''))"
_dtrim = f"trim(description, {_TRIM})"
O["src_usajobs"] = T(f"""
SELECT ord, title, CASE WHEN ord % 3 = 0 THEN coalesce(nullif(company, ''), 'U.S. Federal Government') WHEN ord % 3 = 1 THEN 'Dept X' ELSE 'U.S. Federal Government' END AS company,
  CASE WHEN ord % 2 = 0 THEN 'https://www.usajobs.gov/job/' || ord ELSE 'https://www.usajobs.gov/position/' || ord END AS url,
  CASE WHEN ord % 5 <> 0 THEN 'Austin, Texas, Reston, Virginia' ELSE 'United States' END AS location, ord % 6 = 0 AS remote,
  CASE ord % 6 WHEN 0 THEN 'full_time' WHEN 1 THEN 'part_time' WHEN 3 THEN 'contract' ELSE 'unknown' END AS job_type,
  {_iso} AS posted_text, {_md5(f"CASE WHEN ord % 2 = 1 THEN 'Summary of duties' ELSE {_dtrim} END")} AS description, 'usajobs' AS portal,
  CASE WHEN ord % 2 = 0 THEN '$90000–$120000 PA' ELSE '' END AS salary_text, {S.q(V.US_ELIGIBILITY_NOTE)} AS eligibility_note
FROM tjobs WHERE ord % 2 = 0 OR ord % 4 <> 1""")
_rem = "contains(lower(coalesce(location_raw, '')), 'remote')"
O["src_careerbuilder"] = T(f"""
SELECT ord, title, company, apply_url AS url, coalesce(location_raw, 'Remote') AS location, {_rem} AS remote,
  {S.text_job_type("concat_ws(' ', job_type_raw, description)")} AS job_type, {_iso} AS posted_text, {_md5(_dtrim)} AS description, 'careerbuilder' AS portal FROM tjobs""")
O["src_ziprecruiter"] = T(f"""
WITH z AS (SELECT *, CASE WHEN ord % 2 = 1 THEN 'Short part-time note' ELSE {_dtrim} END AS x FROM tjobs)
SELECT ord, title, coalesce(nullif(company, ''), 'ZipRecruiter Employer') AS company, apply_url AS url, coalesce(location_raw, 'Remote') AS location,
  remote_raw OR {_rem} AS remote, {S.text_job_type("concat_ws(' ', job_type_raw, x)")} AS job_type, {_iso} AS posted_text, {_md5('x')} AS description, 'ziprecruiter' AS portal FROM z""".replace("\nWITH z AS", ", z AS", 1))
_kind = "CASE ord % 4 WHEN 0 THEN coalesce(job_type_raw, 'full_time') WHEN 2 THEN coalesce(job_type_raw, 'Full-time') WHEN 3 THEN coalesce(job_type_raw, 'full_time') ELSE {} END".format(
    S.text_job_type(f"concat_ws(' ', coalesce(job_type_raw, ''), {_dtrim})"))
O["src_actor_items"] = T(f"""
SELECT ord, title, coalesce(nullif(company, ''), {S.pick(['Indeed', 'Dice', 'LinkedIn', 'Glassdoor'], 'ord')} || ' Employer') AS company, apply_url AS url,
  coalesce(location_raw, CASE WHEN ord % 4 = 1 THEN 'Remote' ELSE 'US' END) AS location, {_rem} AS remote, {_kind} AS job_type, {_iso} AS posted_text,
  {_md5(_dtrim)} AS description, {S.pick(['indeed', 'dice', 'linkedin', 'glassdoor'], 'ord')} AS portal FROM tjobs""")
O["src_extracted_json"] = T(f"""
SELECT ord, title, coalesce(nullif(company, ''), 'Glassdoor Employer') AS company, apply_url AS url, coalesce(location_raw, '') AS location,
  ord % 3 = 0 AND remote_raw AS remote, coalesce(job_type_raw, 'unknown') AS job_type, {_iso} AS posted_text, {_md5(_dtrim)} AS description, 'glassdoor' AS portal
FROM tjobs WHERE starts_with(apply_url, 'http')""")
O["src_json_api"] = T(f"""
SELECT ord, title, company, CASE WHEN ord % 2 = 0 THEN apply_url ELSE 'https://remoteok.com/l/' || ord END AS url, coalesce(location_raw, 'Remote') AS location,
  true AS remote, 'contract' AS job_type, {_iso} AS posted_text, {_md5('description')} AS description, 'remoteok' AS portal FROM tjobs
UNION ALL SELECT ord, title, nullif(company, ''), apply_url, coalesce(location_raw, 'Remote'), true, coalesce(job_type_raw, 'contract'), {_iso}, {_md5('description')}, 'remotive' FROM tjobs""")
O["src_rss"] = T(f"""
SELECT ord, CASE WHEN ord % 3 = 0 AND company = '' THEN title || ' at' ELSE title END AS title,
  CASE WHEN ord % 3 = 1 OR (ord % 3 = 0 AND company <> '') THEN company ELSE 'Remote Partner' END AS company, apply_url AS url,
  strftime(posted_date, '%a, %d %b %Y %H:%M:%S +0000') AS posted_text, {_md5('description')} AS description FROM tjobs""")
O["src_jsonld"] = with_pages("""
SELECT page_id, 0::INTEGER AS block, 0::INTEGER AS pos, 0::INTEGER AS node, 'Graph role ' || page_id AS title, 'Firm ' || page_id AS company,
  'https://jobs.example.com/job/' || page_id AS job_url, 'Pune' AS location, '2024-01-09' AS posted_text, 'Build things' AS description, 'full_time' AS contract_type
  FROM pages WHERE page_id % 4 = 0
UNION ALL SELECT page_id, 0, 0, 0, 'Listed role ' || page_id, 'Firm ' || page_id, 'https://jobs.example.com/job/' || page_id, 'Pune', '2024-01-09', 'Build things', 'full_time'
  FROM pages WHERE page_id % 4 = 1
UNION ALL SELECT page_id, 0, 1, 0, 'Flat role ' || page_id, 'Firm ' || page_id, url, 'Remote desk', NULL, '', 'CONTRACT' FROM pages WHERE page_id % 4 = 1""")
O["src_embedded_state"] = with_pages("""
SELECT page_id, 0::INTEGER AS pos, 'State role ' || page_id AS title, 'Firm ' || page_id AS company, true AS remote, 'full_time' AS job_type,
  'https://s.example.com/' || page_id AS apply_url, 'remote work' AS description FROM pages WHERE page_id % 6 = 0
UNION ALL SELECT page_id, 1, 'Second role ' || page_id, 'Firm ' || page_id, false, 'full_time', url, 'on site' FROM pages WHERE page_id % 6 = 0""")
_host = "'https://' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
O["src_page_links"] = with_pages(f"""
SELECT page_id, {_host} || '/jobs/view/' || page_id || '-' || i AS link, 'Job ' || i || ' on page ' || page_id AS title
  FROM (SELECT page_id, url, unnest(range(0, page_id % 7 + 1)) AS i FROM pages WHERE page_id % 2 = 0)
UNION ALL SELECT page_id, 'https://jobs.example.com/job/' || page_id, 'Open & free role ' || page_id FROM pages WHERE page_id % 3 = 0""")
O["src_sitemap"] = J("""
SELECT ord, 'https://s.example.com/' || CASE WHEN i = 2 THEN 'blog' ELSE 'jobs' END || '/Data-ENGINEER-' || ord || '-' || i AS loc,
  'Data engineer ' || ord || ' ' || i AS title FROM (SELECT ord, unnest(range(1, ord % 3 + 2)) AS i FROM jobs) WHERE i <> 2""")
O["sitemap_probe"] = J("""
SELECT ord, CASE WHEN ord % 10 = 0 THEN 1 ELSE 0 END::BIGINT AS child_maps, ord % 3 + 1 AS urls, CASE WHEN ord % 2 = 0 THEN ord % 3 + 1 ELSE 0 END AS lastmods,
  ord % 10 = 0 AS is_index, ord % 2 = 0 AS gives_exact_freshness FROM jobs""")
_needles = "CASE source_platform" + "".join(f" WHEN {S.q(p)} THEN {S.arr(x)}" for p, x in V.PORTAL_LINK_NEEDLES.items()) + " END"
_rel = "'https://www.linkedin.com/jobs/rel-' || ord"
_onp = lambda u: f"len(list_filter({_needles}, lambda n: contains(lower({u}), n))) > 0"
DIRECT = (f"CASE WHEN {_onp('apply_url')} THEN apply_url WHEN {_onp(_rel)} THEN {_rel} "
          "WHEN NOT contains(lower(apply_url), 'google.com') THEN apply_url END")
O["direct_url_for_portal"] = J(f"SELECT id, {DIRECT} AS direct_url FROM jobs")
_stype = "concat_ws(' ', CASE WHEN ord % 3 <> 0 THEN 'Full-time' END, description)"
_lj = f"lower({_stype})"
O["src_scoped_serp"] = T(f"""
, d AS (SELECT *, {DIRECT} AS direct, CASE WHEN ord % 4 = 0 THEN '<b>' || title || '</b> &amp; more' WHEN ord % 23 = 0 THEN '' ELSE title END AS tt FROM tjobs)
SELECT ord, tt AS title, company, direct AS url, coalesce(location_raw, '') AS location, {_rem} AS remote,
  CASE WHEN {S.any_of(_lj, ['contract', 'freelance', 'c2c'])} THEN 'contract' WHEN {S.any_of(_lj, ['part-time', 'part time'])} THEN 'part_time'
    WHEN {S.any_of(_lj, ['full-time', 'full time', 'permanent'])} THEN 'full_time' ELSE 'unknown' END AS job_type,
  CASE WHEN ord % 4 <> 3 THEN (ord % 30 + 1) || ' days ago' END AS posted_text, {_md5(_dtrim)} AS description, source_platform AS portal,
  CASE WHEN source_platform IN {S.in_list(V.AGGREGATED_ONLY_PORTALS)} THEN {S.q(V.AGGREGATED_NOTE)} END AS source_note
FROM d WHERE tt <> '' AND direct IS NOT NULL""")
_isox = lambda x: _iso.replace("posted_date", x)
O["scan_jobs"] = J(f"""
SELECT id, title, canonical_title, company, skills, city, country, salary_min, salary_max, currency, remote_flag, job_type, source_platform, apply_url,
  posted_date_precision, {_isox('posted_date')} AS posted_date, {_isox('fetched_at')} AS fetched_at, {_isox('scraped_at')} AS scraped_at FROM jobs""")
DIM = "dim AS (" + " UNION ALL ".join(
    f"SELECT {i} AS pos, {S.q(p[0])} AS portal, {S.q(p[1])} AS portal_name, {S.q(p[2])} AS portal_type, {S.q(p[3])} AS category, "
    f"{S.q(V.PORTAL_CAPABILITIES[p[0]][4])} AS freshness_precision, {S.q(V.PORTAL_CAPABILITIES[p[0]][8])} AS primary_method, "
    f"{S.q(V.PORTAL_CAPABILITIES[p[0]][9])}::VARCHAR AS needs_api_key, {len(V.PORTAL_TIERS[p[0]])}::BIGINT AS tiers, "
    f"{V.PORTAL_CAPABILITIES[p[0]][3]} AS dates_ok, {V.DAILY_QUOTAS[p[0]]} AS quota" for i, p in enumerate(V.PORTALS)) + ")"
O["dim_portals"] = J(f""", {DIM}
SELECT portal, portal_name, portal_type, category, freshness_precision, primary_method, needs_api_key, tiers,
  (SELECT count(*) FROM jobs WHERE source_platform = portal) AS postings FROM dim""")
_capn = {k: [p for p, v in V.PORTAL_CAPABILITIES.items() if v[i]] for i, k in enumerate(
    ["supports_keyword", "supports_country", "supports_remote_filter", "supports_date_filtering", "", "supports_pagination", "supports_salary_filter"]) if k}
del _capn["supports_keyword"]
O["portals_supporting"] = J("SELECT " + ", ".join(
    f"count(*) FILTER (source_platform IN {S.in_list(p)}) AS {k}" for k, p in _capn.items()) + " FROM jobs")
O["ats_postings"] = J(", c AS (" + " UNION ALL ".join(f"SELECT {S.q(a)} AS company, {S.q(b)} AS ats" for a, b in V.ATS_COMPANIES)
                      + ") SELECT c.ats, c.company, count(*) AS postings FROM jobs j JOIN c ON lower(j.company) = c.company GROUP BY ALL")
O["can_honor_window"] = S.with_requests(f"""
SELECT request_id, {S.minutes('date_posted')} AS minutes, coalesce(platform, '') = 'dice' AND {S.minutes('date_posted')} >= 60 AS honored FROM requests""")
_remote_portals = [p[0] for p in V.PORTALS if "remote" in p[1].lower() or "remote" in p[3]]
O["filter_portals"] = J(f"""
SELECT id, source_platform AS portal, CASE WHEN source_platform = 'hired' THEN 'remote_staffing_vendors' ELSE 'remote_boards_aggregators' END AS category
FROM jobs WHERE source_platform IN {S.in_list(_remote_portals)}""")
del B
O["default_company"] = T(f"SELECT ord, company FROM ({_connector('dice', 'US', 'us')}) WHERE company = 'Dice Employer'")
