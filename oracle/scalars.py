"""SQL oracles of the column functions."""

from __future__ import annotations

from oracle import base as S
from oracle.registry import ORACLES as O
from postlake import fixed_values as V
from postlake.plans import bindings as B

J, T, R = S.with_jobs, S.with_text, S.with_requests

WS = "[\\s\\x{00A0}\\x{0085}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x1c-\\x1f]+"


def unescape(x: str) -> str:
    """The entities that occur in the tables; the ampersand goes last so nothing is decoded twice."""
    for rx, ch in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        x = f"regexp_replace({x}, {S.q(rx)}, {S.q(ch)}, 'g')"
    return x


def strip_html(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({unescape(x)}, '<[^>]*>', '', 'g'), {S.q(WS)}, ' ', 'g'))"


def match_key(x: str) -> str:
    out = f"regexp_replace(lower(coalesce({x}, '')), '[^\\w\\s]', ' ', 'g')"
    for w, full in V.MATCH_REWRITES:
        out = f"regexp_replace({out}, '\\b{w}\\b', {S.q(full)}, 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def qtokens(x: str) -> str:
    raw = f"regexp_extract_all(lower(coalesce({x}, '')), '[a-zA-Z0-9+#.\\-]+')"
    kept = f"list_filter({raw}, lambda t: NOT list_contains({S.arr(V.QUERY_STOP_WORDS)}, t))"
    return f"list_filter(list_transform({kept}, lambda t: trim(t, '-.')), lambda t: t <> '')"


def required(x: str, neg: str = "NOT ") -> str:
    return f"list_filter({qtokens(x)}, lambda t: {neg}list_contains({S.arr(V.MODIFIER_WORDS)}, t))"


def join(x: str, sep: str = ",") -> str:
    return f"coalesce(array_to_string({x}, {S.q(sep)}), '')"


O["strip_html"] = f"SELECT page_id, {strip_html('html')} AS plain FROM pages"
O["clean_for_match"] = J(
    f"SELECT id, {match_key('title')} AS title_key, {match_key('company')} AS company_key, "
    f"trim({match_key('title')} || ' ' || {match_key('company')} || ' ' || {match_key('city')}) AS signature FROM jobs"
)
_n = S.norm("title")
O["norm_text"] = J(
    f"SELECT id, {_n} AS norm_title, {join(S.tokens(_n, V.RELEVANCE_STOP_WORDS), ' ')} AS relevance_tokens, "
    f"{join(S.tokens(_n, V.EXPANSION_STOP_WORDS), ' ')} AS expansion_tokens, "
    f"len({S.tokens(S.norm('skills'), V.RELEVANCE_STOP_WORDS)}) AS skill_tokens FROM jobs"
)
O["query_tokenize"] = J(
    f"SELECT id, {join(qtokens('title'), ' ')} AS tokens, {join(required('title'), ' ')} AS required, "
    f"{join(required('title', ''), ' ')} AS modifiers FROM jobs"
)
_groups = f"list_filter(list_transform(string_split(title, ','), lambda p: {required('p')}), lambda g: len(g) > 0)"
O["combined_keyword"] = R(f""",
g AS (SELECT request_id, CASE WHEN lower(trim(title)) = 'all' THEN [] ELSE {_groups} END AS g FROM requests),
w AS (SELECT request_id, len(g) AS groups, flatten(g) AS words FROM g)
SELECT request_id, CASE WHEN len(words) > 0 THEN array_to_string(
  list_filter(words, lambda w, i: list_position(words, w) = i), ' ') ELSE 'developer' END AS keyword, groups FROM w""")
_toks = S.tokens(S.norm("part"), V.RELEVANCE_STOP_WORDS)
_syn_steps, _prev = [], "p1"
for _i, _g in enumerate(V.SYNONYM_GROUPS):
    _syn_steps.append(
        f"y{_i} AS (SELECT * REPLACE (CASE WHEN len(list_filter({S.arr(_g)}, lambda t: contains(array_to_string(toks, ' '), t) "
        f"OR list_contains(ex, t))) > 0 THEN list_distinct(list_concat(ex, {S.arr(_g)})) ELSE ex END AS ex) FROM {_prev})"
    )
    _prev = f"y{_i}"
O["parse_query"] = R(f""",
p0 AS (SELECT request_id, unnest(string_split(title, ',')) AS part, generate_subscripts(string_split(title, ','), 1) - 1 AS pos FROM requests),
p1 AS (SELECT *, {_toks} AS toks, list_distinct({_toks}) AS ex FROM p0),
{', '.join(_syn_steps)}
SELECT request_id, pos, {S.norm('part')} AS phrase, array_to_string(toks, ' ') AS tokens,
  array_to_string(list_sort(ex), ',') AS expanded FROM {_prev} WHERE len(toks) > 0""")

_fam_rows = " UNION ALL ".join(
    f"SELECT {i} AS pos, {S.q(f['name'])} AS name, {S.arr(f['match'])} AS keys, {S.arr(f['strong'])} AS strong, "
    f"{S.arr(f['related'])} AS related, {S.arr(f['skills'])} AS skills" for i, f in enumerate(V.ROLE_FAMILIES)
)
_knorm = "trim(regexp_replace(k, '[^a-z0-9+#.]+', ' ', 'g'))"
EXPANDED = f""",
fam AS ({_fam_rows}),
titles AS (SELECT DISTINCT CASE WHEN lower(title) = 'all' THEN '' ELSE title END AS title FROM requests),
tt AS (SELECT title, list_filter(list_transform(string_split(title, ','), lambda p: trim(p)), lambda p: p <> '') AS core,
  {S.norm('title')} AS qn, {S.tokens(S.norm('title'), V.EXPANSION_STOP_WORDS)} AS qt FROM titles),
hit AS (SELECT tt.title, fam.* FROM tt, fam WHERE len(list_filter(fam.keys, lambda k:
  contains(' ' || qn || ' ', ' ' || {_knorm} || ' ') OR (contains({_knorm}, ' ') AND
  len(list_filter(string_split({_knorm}, ' '), lambda w: NOT list_contains(qt, w))) = 0)
  OR list_contains(qt, {_knorm}))) > 0),
g AS (SELECT title, list_distinct(flatten(list(strong))) AS strong, list_distinct(flatten(list(related))) AS related,
  list_sort(list_distinct(flatten(list(skills)))) AS skills, list(name ORDER BY pos) AS families FROM hit GROUP BY title),
x AS (SELECT r.request_id, r.search_mode, tt.core,
  CASE WHEN search_mode = 'exact' OR g.title IS NULL THEN [] ELSE list_sort(list_filter(g.strong, lambda s:
    NOT list_contains(list_transform(tt.core, lambda c: {S.norm('c')}), s))) END AS strong,
  CASE WHEN search_mode <> 'hybrid' OR g.title IS NULL THEN [] ELSE list_sort(list_filter(g.related, lambda s:
    NOT list_contains(list_transform(tt.core, lambda c: {S.norm('c')}), s) AND NOT list_contains(g.strong, s))) END AS related,
  CASE WHEN search_mode = 'exact' OR g.title IS NULL THEN [] ELSE g.skills END AS skills,
  CASE WHEN search_mode = 'exact' OR g.title IS NULL THEN [] ELSE g.families END AS families
  FROM requests r JOIN tt ON tt.title = CASE WHEN lower(r.title) = 'all' THEN '' ELSE r.title END
  LEFT JOIN g ON g.title = tt.title)"""
O["expand_query"] = R(EXPANDED + " SELECT request_id, " + ", ".join(
    f"{join(k)} AS {k}" for k in ("core", "strong", "related", "skills", "families")) + " FROM x")
O["expand_terms"] = R(EXPANDED + " SELECT request_id, 'core' AS tier, unnest(core) AS term FROM x UNION ALL "
                      "SELECT request_id, 'strong', unnest(strong) FROM x UNION ALL SELECT request_id, 'related', unnest(related) FROM x")
O["set_difference_terms"] = R(EXPANDED + f"""
SELECT request_id, {join("list_filter(strong, lambda s: NOT list_contains(core, s))")} AS strong_only,
  {join("list_filter(related, lambda s: NOT list_contains(core, s) AND NOT list_contains(strong, s))")} AS related_only FROM x""")
O["scrape_keywords"] = R(EXPANDED + f" SELECT request_id, {join('list_concat(core, strong)[1:4]', ' OR ')} AS keywords FROM x")
O["canonical_title"] = J(f"SELECT id, title, {S.canonical_title('title')} AS canonical FROM jobs")
_text3 = "coalesce(job_type_raw, '') || ' ' || title || ' ' || description"
O["normalize_job_type"] = T(f"SELECT id, {S.job_type('source_platform', _text3)} AS normal_type FROM tjobs")
_led = S.canonical_job_type("job_type_raw", V.LEDGER_JOB_TYPE_ALIASES)
O["canonical_job_type"] = J(
    f"SELECT id, {S.canonical_job_type('job_type_raw')} AS filter_type, "
    f"CASE WHEN job_type_raw IS NULL THEN 'all' ELSE coalesce({_led}, lower(trim(job_type_raw))) END AS ledger_type FROM jobs"
)
_lt = "concat_ws(' ', job_type_raw, description)"
_codes = "[lower(coalesce(job_type_raw, '')), (ord % 6)::VARCHAR]"
_raw_codes = "[coalesce(job_type_raw, ''), (ord % 6)::VARCHAR]"
O["job_type_from_text"] = T(
    f"SELECT id, {S.text_job_type(_lt)} AS listing_type, {S.text_job_type(_lt, ['freelance', 'c2c'])} AS narrow_type, "
    f"CASE WHEN len(list_filter({_raw_codes}, lambda c: c = '1' OR contains(c, 'full'))) > 0 THEN 'full_time' "
    f"WHEN len(list_filter({_raw_codes}, lambda c: c = '2' OR contains(c, 'part'))) > 0 THEN 'part_time' "
    f"WHEN {S.any_of(f'array_to_string({_codes}, chr(32))', ['contract', 'intermittent', '4'])} THEN 'contract' "
    "ELSE 'unknown' END AS schedule_type FROM tjobs"
)
_dr = S.is_remote("title || ' ' || description || ' ' || coalesce(location_raw, '')")
O["detect_remote"] = T(f"SELECT id, {_dr} AS is_remote FROM tjobs")
_ci, _co = S.place("location_raw", "'au'")
O["city_country"] = J(f"SELECT id, {_ci} AS city, {_co} AS country FROM jobs")
_sent = "list_transform(regexp_split_to_array(description, '[.!?\\n]'), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13)))"
O["work_auth_note"] = T(
    f"SELECT id, left(list_filter({_sent}, lambda s: {S.any_of('lower(s)', V.WORK_AUTH_PHRASES)})[1], 200) AS note FROM tjobs"
)
O["currency_for_country"] = J(f"SELECT id, country, {S.currency('country')} AS cur FROM jobs")
_mails = lambda x: f"list_transform(regexp_extract_all({x}, {S.q(V.EMAIL_PATTERN)}), lambda e: lower(e))"
_gen = f"list_contains({S.arr(V.GENERIC_MAILBOXES)}, split_part(e, '@', 1))"
_rec = lambda x: f"list_filter({_mails(x)}, lambda e: NOT {_gen})[1]"
_com = lambda x: f"list_filter({_mails(x)}, lambda e: {_gen})[1]"
O["extract_contacts"] = (
    f"SELECT doc_id, {_rec('text')} AS recruiter_email, {_com('text')} AS company_email, len({_mails('text')}) AS emails FROM documents"
)
_word = "trim(regexp_replace(lower(coalesce(company, '')), '[^\\w\\s]', '', 'g'))"
CONTACT_GUESS = (
    f"'careers@' || CASE {_word}" + "".join(f" WHEN {S.q(k)} THEN {S.q(v)}" for k, v in V.COMPANY_DOMAINS.items())
    + f" ELSE CASE WHEN length({_word}) > 2 AND NOT contains({_word}, ' ') THEN {_word} || '.com' END END"
)
O["company_contact_email"] = J(f"SELECT id, {CONTACT_GUESS} AS guess FROM jobs")
_cue = "(?i)(?:recruiter|hiring manager|contact|posted by|reach out to)\\s*:\\s*([A-Z][a-z]+\\s+[A-Z][a-z]+)"
_pl = "(?i)(?:reach out to|contact)\\s+([A-Z][a-z]+\\s+[A-Z][a-z]+)\\b"
_okname = lambda n: f"CASE WHEN {n} <> '' AND length({n}) <= 50 AND NOT {S.any_of(f'lower({n})', V.NAME_STOP_WORDS)} THEN {n} END"
_cap = lambda w: f"upper(left({w}, 1)) || lower(substr({w}, 2))"
NAMES = f""",
m AS (SELECT *, {_rec('description')} AS mail, {_com('description')} AS cmail FROM tjobs),
blk AS (SELECT *, instr(lower(description), mail) AS pos FROM m),
cut AS (SELECT *, substr(description, greatest(1, pos - {V.NAME_WINDOW}),
  pos + length(mail) + {V.NAME_WINDOW} - greatest(1, pos - {V.NAME_WINDOW})) AS block, split_part(mail, '@', 1) AS loc FROM blk),
nm AS (SELECT *, regexp_extract(block, {S.q(_cue)}, 1) AS n1,
  regexp_extract(block, '(?i)([A-Z][a-z]+\\s+[A-Z][a-z]+)\\s*[\\(<]\\s*' || regexp_escape(mail), 1) AS n2,
  regexp_extract(block, {S.q(_pl)}, 1) AS n3 FROM cut),
named AS (SELECT *, coalesce({_okname('n1')}, {_okname('n2')}, {_okname('n3')}) AS found FROM nm),
fin AS (SELECT *, CASE WHEN found IS NOT NULL THEN array_to_string(list_transform(string_split(found, ' '), lambda w: {_cap('w')}), ' ')
  WHEN regexp_matches(loc, '^[a-z]{{2,}}\\.[a-z]{{2,}}$') THEN {_cap("split_part(loc, '.', 1)")} || ' ' || {_cap("split_part(loc, '.', 2)")}
  END AS recruiter FROM named)"""
O["recruiter_name"] = T(NAMES + " SELECT id, mail, recruiter AS name FROM fin WHERE mail IS NOT NULL")
O["enrich_contacts"] = T(
    NAMES + f" SELECT id, mail AS recruiter_email, coalesce(cmail, {CONTACT_GUESS}) AS company_contact_email, recruiter AS recruiter_name FROM fin"
)
O["enrichment_report"] = T(NAMES + f""",
e AS (SELECT mail AS a, coalesce(cmail, {CONTACT_GUESS}) AS b, recruiter AS n FROM fin)
SELECT count(*) AS total, count(a) AS recruiter_emails, count(b) AS company_emails, count(n) AS recruiter_names,
  count(*) FILTER (a IS NOT NULL OR b IS NOT NULL OR n IS NOT NULL) AS enriched,
  round(100.0 * count(*) FILTER (a IS NOT NULL OR b IS NOT NULL OR n IS NOT NULL) / count(*), 2)::DOUBLE AS hit_rate FROM e""")
O["batch_enrich"] = O["enrich_contacts"]
O["company_from_title"] = J("""
SELECT id, trim(CASE WHEN ord % 3 = 0 THEN title WHEN ord % 3 = 1 THEN title ELSE title || ' - ' || company END) AS feed_title,
  CASE WHEN ord % 3 < 2 THEN company ELSE 'Remote Partner' END AS feed_company,
  CASE WHEN ord % 3 = 1 THEN 'Dice Employer' ELSE company END AS dash_company
FROM (SELECT * REPLACE (CASE WHEN ord % 3 = 2 THEN title ELSE title END AS title) FROM jobs)""".replace(
    "trim(CASE WHEN ord % 3 = 0", "(CASE WHEN ord % 3 = 0"))
_kk = ("array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(title, ','), "
       "lambda p: lower(trim(regexp_replace(p, '\\s+', ' ', 'g')))), lambda p: p <> '' AND p <> 'all'))), ',')")
O["keyword_key"] = R(f"SELECT request_id, {_kk} AS keyword_key FROM requests")
_sc = lambda x: f"coalesce(nullif(lower(trim({x})), ''), 'all')"
_ljt = f"coalesce({S.canonical_job_type('job_type', V.LEDGER_JOB_TYPE_ALIASES)}, {_sc('job_type')})"
CACHE_JSON = (
    f"'{{\"country\":\"' || {_sc('country')} || '\",\"date_bucket\":\"' || {S.bucket(S.minutes('date_posted'))} || "
    f"'\",\"job_type\":\"' || {_ljt} || '\",\"keywords\":\"' || {_kk} || '\",\"platform\":\"' || {_sc('platform')} || "
    "'\",\"remote_only\":' || remote_only::VARCHAR || '}'"
).replace(f"|| {S.bucket(S.minutes('date_posted'))} ||", f"|| ({S.bucket(S.minutes('date_posted'))}) ||")
O["cache_key"] = R(f"SELECT request_id, {CACHE_JSON} AS filter_json, sha256({CACHE_JSON}) AS cache_key FROM requests")
_lo = lambda x: f"lower(coalesce({x}, 'all'))"
O["filter_hash"] = R(
    f"SELECT request_id, sha256('{{\"country\": \"' || upper({_lo('country')}) || '\", \"date_posted\": \"' || {_lo('date_posted')} || "
    f"'\", \"job_title\": \"' || title || '\", \"job_type\": \"' || {_lo('job_type')} || '\", \"platform\": \"' || {_lo('platform')} || "
    "'\", \"q\": \"\", \"remote_only\": ' || remote_only::VARCHAR || '}') AS filter_hash FROM requests"
)
RAW_HASH = ("sha256(lower(title) || '|' || lower(company) || '|' || source_platform || '|' || "
            "coalesce(strftime(posted_date, '%Y-%m-%d %H:%M:%S.%f'), 'none'))")
O["raw_hash"] = J(f"SELECT id, {RAW_HASH} AS raw_hash FROM jobs")
TIER_KEY = "md5(lower(title) || '_' || lower(company) || '_' || source_platform)"
O["tier_dedup_key"] = J(f"SELECT id, {TIER_KEY} AS tier_key FROM jobs")
_hours = f"(CASE WHEN {S.minutes('date_posted')} <= 1440 THEN 24 WHEN {S.minutes('date_posted')} <= 10080 THEN 168 ELSE 720 END)::INTEGER"
_urls = "CASE portal" + "".join(
    f" WHEN {S.q(p)} THEN {S.q(u)}" for p, u in V.SEARCH_URLS.items()) + " END"
O["source_recency_params"] = R(f""",
f AS (SELECT request_id, CASE WHEN lower(title) = 'all' THEN 'developer' ELSE title END AS kw, {_hours} AS hours,
  unnest(CASE WHEN coalesce(platform, 'all') = 'all' THEN {S.arr(V.PORTAL_IDS)} ELSE [platform] END) AS portal FROM requests),
g AS (SELECT *, greatest(1, round(hours / 24))::INTEGER AS from_days FROM f)
SELECT request_id, portal, hours, CASE hours WHEN 24 THEN 'date_posted:today' WHEN 168 THEN 'date_posted:week' ELSE 'date_posted:month' END AS chip,
  from_days, 'r' || (hours * 3600) AS f_tpr, CASE hours WHEN 24 THEN 'ONE' WHEN 168 THEN 'SEVEN' ELSE 'THIRTY' END AS dice_age,
  replace(replace(replace(replace(replace({_urls}, '{{kw}}', replace(url_encode(kw), '%20', '+')), '{{loc}}', ''), '{{fromage}}', from_days::VARCHAR),
    '{{tpr}}', 'r' || (hours * 3600)), '{{dice_age}}', CASE hours WHEN 24 THEN 'ONE' WHEN 168 THEN 'SEVEN' ELSE 'THIRTY' END) AS search_url FROM g""")


def cause(portal="portal", err="error_message", success="success") -> str:
    e = f"lower(coalesce({err}, ''))"
    keyed = [p for p, caps in V.PORTAL_CAPABILITIES.items() if caps[-1]]
    return (
        f"CASE WHEN {portal} IN {S.in_list(keyed)} THEN 'NEEDS_PARTNER_API_KEY' "
        f"WHEN {S.any_of(e, V.QUOTA_ERROR_WORDS)} THEN 'QUOTA_OR_CREDIT_EXHAUSTED' "
        f"WHEN {S.any_of(e, V.BLOCK_ERROR_WORDS)} THEN 'BLOCKED_OR_NETWORK_DENIED' "
        f"WHEN {S.any_of(e, V.MODULE_ERROR_WORDS)} THEN 'MISSING_PYTHON_DEPENDENCY' "
        f"WHEN {success} IS NULL THEN 'NEVER_RUN' WHEN {success} THEN 'HEALTHY' ELSE 'ZERO_RESULTS_OR_CONNECTOR_ISSUE' END"
    )


O["classify_run_error"] = S.with_runs(f"SELECT run_id, portal, {cause()} AS cause FROM runs")

_key = "page_id"
_post = lambda t: (
    f"'{{\"@type\":\"JobPosting\",\"title\":\"' || {t} || '\",\"hiringOrganization\":{{\"name\":\"Firm ' || page_id || "
    "'\"},\"jobLocation\":{\"address\":{\"addressLocality\":\"Pune\",\"addressCountry\":\"IN\"}},\"datePosted\":\"2024-01-09\","
    "\"description\":\"Build things\",\"url\":\"https://jobs.example.com/job/' || page_id || '\"}'"
)
_flat = ("'{\"@type\":[\"Thing\",\"JobPosting\"],\"name\":\"Flat role ' || page_id || '\",\"hiringOrganization\":\"Firm ' || page_id || "
         "'\",\"jobLocation\":{\"address\":\"Remote desk\"},\"employmentType\":\"CONTRACT\"}'")
_ld = lambda b: f"'<script type=\"application/ld+json\">' || {b} || '</script>'"
_graph = "'{\"@graph\":[' || " + _post("'Graph role ' || page_id") + " || ',{\"@type\":\"Person\",\"name\":\"x\"}]}'"
_listed = "'[' || " + _post("'Listed role ' || page_id") + " || ',' || " + _flat + " || ']'"
_state = ("'<script id=\"__NEXT_DATA__\" type=\"application/json\">{\"props\":{\"pageProps\":{\"' || CASE WHEN page_id % 2 = 0 THEN 'jobs' ELSE 'listings' END || "
          "'\":[{\"title\":\"State role ' || page_id || '\",\"company\":{\"name\":\"Firm ' || page_id || '\"},\"url\":\"https://s.example.com/' || page_id || "
          "'\",\"summary\":\"remote work\"},{\"role\":\"Second role ' || page_id || '\",\"companyName\":\"Firm ' || page_id || '\",\"description\":\"on site\"}]}}}</script>'")
PAGES = f"""
vpages AS (SELECT page_id, url, CASE WHEN page_id % 7 = 3 THEN 403 WHEN page_id % 11 = 5 THEN 503 ELSE 200 END AS status,
  CASE WHEN page_id % 9 = 4 THEN 'CF-RAY:abc' ELSE 'server:nginx' END AS headers,
  html || CASE WHEN page_id % 2 = 0 THEN array_to_string(list_transform(range(0, page_id % 7 + 1), lambda i:
    '<a href="/jobs/view/' || page_id || '-' || i || '">Job ' || i || ' on <b>page</b> ' || page_id || '</a>'), '') ELSE '' END
  || CASE WHEN page_id % 3 = 0 THEN '<a class="x" href="https://jobs.example.com/job/' || page_id || '">Open &amp; free role ' || page_id ||
    '</a><a href="viewjob?jk=' || page_id || '">ab</a>' ELSE '' END
  || CASE WHEN page_id % 5 = 1 THEN '<p>Access Denied</p>' ELSE '' END
  || CASE WHEN page_id % 4 = 0 THEN {_ld(_graph)} WHEN page_id % 4 = 1 THEN {_ld(_listed)} ELSE '' END
  || CASE WHEN page_id % 6 = 0 THEN {_state} ELSE '' END AS html FROM pages)"""


def with_pages(body: str) -> str:
    return f"WITH {PAGES} {body}"


def first_sig(text: str, sigs) -> str:
    return "CASE" + "".join(f" WHEN contains({text}, {S.q(s)}) THEN {S.q(s)}" for s in sigs)


_low = "lower(html)"
_hay = "lower(html) || ' ' || lower(headers)"
SIGNATURE = first_sig(_low, V.BLOCK_SIGNATURES) + " WHEN status IN (403, 429) THEN 'http_' || status END"
VENDOR = (
    f"CASE WHEN {S.any_of('lower(html)', V.PROXY_DENY_SIGNATURES)} THEN 'LOCAL_PROXY_DENY'"
    + "".join(f" WHEN {S.any_of('(' + _hay + ')', sigs)} THEN {S.q(v)}" for v, sigs in V.BLOCK_VENDORS)
    + " WHEN status IN (403, 429) THEN 'http_' || status WHEN status >= 500 THEN 'server_' || status END"
)
WORDS = (
    "len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), "
    f"'<[^>]+>', ' ', 'g'), {S.q(WS)}), lambda w: w <> ''))"
)
LINKS = "len(list_distinct(flatten([" + ", ".join(
    f"regexp_extract_all(html, {S.q('(?i)' + p)}, 1)" for p in V.JOB_LINK_PATTERNS) + "])))"
O["detect_block"] = with_pages(f"SELECT page_id, {SIGNATURE} AS signature, {VENDOR} AS vendor FROM vpages")
O["is_js_shell"] = with_pages(
    f"SELECT page_id, {WORDS} AS words, {LINKS} = 0 AND {WORDS} < {V.JS_SHELL_WORDS} AS js_shell FROM vpages"
)
_age = lambda t: (
    f"CASE WHEN {t} IS NULL OR {t} > {S.AS_OF} THEN 'Posting date unknown' "
    + f"WHEN epoch_us({S.AS_OF} - {t}) // 60000000 < 1 THEN 'Posted just now' "
    + "".join(
        f"WHEN epoch_us({S.AS_OF} - {t}) // {unit} < {cap} THEN 'Posted ' || (epoch_us({S.AS_OF} - {t}) // {unit}) || ' {name}' || "
        f"CASE WHEN epoch_us({S.AS_OF} - {t}) // {unit} = 1 THEN '' ELSE 's' END || ' ago' "
        for unit, cap, name in ((60_000_000, 60, "minute"), (3_600_000_000, 24, "hour"), (86_400_000_000, 30, "day"))
    )
    + f"ELSE 'Posted on ' || strftime({t}, '%-m/%-d/%Y') END"
)
_money = lambda x: f"coalesce(nullif(currency, ''), '$') || format('{{:,}}', round({x})::BIGINT)"
O["display_fields"] = J(
    f"SELECT id, CASE WHEN nullif(salary_min, 0) IS NOT NULL AND nullif(salary_max, 0) IS NOT NULL THEN {_money('salary_min')} || ' - ' || {_money('salary_max')} "
    f"WHEN nullif(salary_min, 0) IS NOT NULL THEN 'From ' || {_money('salary_min')} "
    f"WHEN nullif(salary_max, 0) IS NOT NULL THEN 'Up to ' || {_money('salary_max')} END AS salary_label, "
    f"CASE WHEN posted_date IS NULL THEN 'Posting date not published' ELSE {_age('posted_date')} END AS posted_label, "
    f"CASE WHEN posted_date IS NULL AND coalesce(scraped_at, fetched_at) IS NOT NULL THEN regexp_replace({_age('coalesce(scraped_at, fetched_at)')}, '^Posted ', 'we found it ') END AS found_label, "
    "coalesce(CASE WHEN city IS NOT NULL THEN concat_ws(', ', city, country) END, country, 'Location Unspecified') AS place_label FROM jobs"
)


def intent(m="message") -> dict[str, str]:
    low = f"lower({m})"
    country = "CASE" + "".join(
        f" WHEN regexp_matches({low}, '\\b({'|'.join(ws)})\\b') THEN {S.q(c)}" for c, ws in V.PROMPT_COUNTRIES) + " END"
    platform = "CASE" + "".join(f" WHEN contains({low}, {S.q(w)}) THEN {S.q(p)}" for p, w in V.PROMPT_PLATFORMS) + " END"
    k = f"regexp_extract({low}, '(\\d{{2,3}})\\s*k\\b', 1)"
    n = f"regexp_extract({low}, '(?:over|above|min|\\$)\\s*(\\d{{5,7}})\\b', 1)"
    # whole words of any script are cut out first: its \b knows ASCII letters only
    words = (f"list_filter(regexp_extract_all({m}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{2,}}') "
             f"AND NOT list_contains({S.arr(V.PROMPT_STOP_WORDS)}, lower(w)))")
    return {
        "query": f"nullif(array_to_string(({words})[1:4], ' '), '')",
        "remote_only": S.any_of(low, V.PROMPT_REMOTE_WORDS),
        "country": country,
        "min_salary": f"CASE WHEN {k} <> '' THEN {k}::DOUBLE * 1000 WHEN {n} <> '' THEN {n}::DOUBLE END",
        "platform": platform,
        "asks_details": S.any_of(low, V.PROMPT_DETAIL_WORDS),
        "refers_back": S.any_of(low, V.PROMPT_FOLLOW_UP_WORDS),
    }


O["prompt_intent"] = S.with_prompts("SELECT session_id, turn, " + ", ".join(f"{e} AS {k}" for k, e in intent().items()) + " FROM prompts")
O["truncate_fields"] = T(
    "SELECT id, left(title, 255) AS title, left(company, 255) AS company, left(city, 100) AS city, "
    "left(canonical_title, 100) AS canonical_title, left(job_type, 50) AS job_type, md5(left(description, 2000)) AS snippet_md5, "
    "length(left(description, 2000)) AS snippet_length FROM tjobs"
)
O["provenance_tags"] = J(
    "SELECT id, source_platform, CASE WHEN source_platform = 'hired' THEN 'limited' END AS data_completeness, "
    "source_platform = 'hired' AS low_yield, "
    f"CASE WHEN source_platform IN {S.in_list(V.AGGREGATED_ONLY_PORTALS)} THEN {S.q(V.AGGREGATED_NOTE)} END AS source_note, "
    f"CASE WHEN source_platform = 'usajobs' THEN 'US' END AS country_code, "
    f"CASE WHEN source_platform = 'usajobs' THEN {S.q(V.US_ELIGIBILITY_NOTE)} END AS eligibility_note FROM jobs"
)
_k = "event_id % 18"
O["parse_posted_date"] = f"""
SELECT event_id AS ord, CASE {_k} WHEN 0 THEN ts WHEN 1 THEN date_trunc('day', ts)::TIMESTAMP WHEN 2 THEN date_trunc('second', ts)
  WHEN 3 THEN date_trunc('millisecond', ts) WHEN 4 THEN date_trunc('second', ts) WHEN 5 THEN {S.AS_OF} WHEN 6 THEN {S.AS_OF} - INTERVAL 1 DAY
  WHEN 7 THEN {S.AS_OF} - INTERVAL 1 DAY * (event_id % 28 + 1)::INTEGER WHEN 8 THEN {S.AS_OF} - INTERVAL 7 DAY * (event_id % 9 + 1)::INTEGER
  WHEN 10 THEN date_trunc('day', ts)::TIMESTAMP WHEN 11 THEN date_trunc('day', ts)::TIMESTAMP WHEN 12 THEN date_trunc('day', ts)::TIMESTAMP
  WHEN 14 THEN {S.AS_OF} - INTERVAL 1 MINUTE * (event_id % 50 + 1)::INTEGER WHEN 15 THEN date_trunc('second', ts) + INTERVAL 330 MINUTE
  WHEN 17 THEN date_trunc('day', ts)::TIMESTAMP END AS posted_at FROM events"""
_raw = f"""CASE {_k} WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' WHEN 1 THEN strftime(ts, '%Y-%m-%d')
  WHEN 2 THEN (epoch_us(ts) // 1000000)::VARCHAR WHEN 3 THEN (epoch_us(ts) // 1000)::VARCHAR
  WHEN 4 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') WHEN 5 THEN 'Today' WHEN 6 THEN 'yesterday'
  WHEN 7 THEN (event_id % 28 + 1) || ' days ago' WHEN 8 THEN (event_id % 9 + 1) || '+ weeks ago' WHEN 9 THEN 'a few days ago'
  WHEN 10 THEN strftime(ts, '%A, %-d %B %Y') WHEN 11 THEN strftime(ts, '%B %-d, %Y') WHEN 12 THEN strftime(ts, '%m/%d/%Y')
  WHEN 13 THEN 'soon' WHEN 14 THEN (event_id % 50 + 1) || ' minutes ago' WHEN 15 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S -0530')
  WHEN 17 THEN strftime(ts, '%Y-%m-%d 00:00:00') END"""
O["precision_from_raw"] = f"""
WITH r AS (SELECT event_id AS ord, {_raw} AS raw_date, lower({_raw}) AS t, {S.pick(V.PORTAL_IDS, 'event_id')} AS portal FROM events)
SELECT ord, raw_date, CASE WHEN t IS NULL THEN 'unknown' WHEN regexp_matches(t, 'week|month|year') THEN 'week'
  WHEN contains(t, 'day') THEN 'day' WHEN regexp_matches(t, 'hour|hr|min') THEN 'hour'
  WHEN contains(t, 'just posted') OR contains(t, 'just now') THEN 'hour'
  WHEN portal IN {S.in_list(V.EXACT_PRECISION_PORTALS)} THEN 'exact'
  WHEN contains(t, ':') AND (contains(t, 't') OR contains(t, ' ')) THEN CASE WHEN contains(t, ' 00:00:00') OR ends_with(t, '00:00:00') THEN 'day' ELSE 'exact' END
  ELSE 'day' END AS grade FROM r"""
O["precision_from_stored"] = J(f"SELECT id, {S.stored_precision('posted_date', 'source_platform')} AS grade FROM jobs")
O["to_naive_utc"] = "SELECT event_id, ts - INTERVAL 330 MINUTE AS utc FROM events"
O["effective_freshness"] = J(
    f"SELECT id, {S.EFF_TS} AS ts, CASE WHEN posted_date IS NULL THEN 'unknown' ELSE coalesce(posted_date_precision, "
    f"{S.stored_precision('posted_date', 'source_platform')}) END AS precision, {S.EFF_FIELD} AS field FROM jobs"
)
O["is_fresh"] = J("SELECT id, " + ", ".join(f"{S.fresh(str(m))} AS {n}" for n, _, m in V.UI_WINDOWS) + " FROM jobs")
_m = S.minutes("date_posted")
O["window_minutes"] = R(f""", w AS (SELECT request_id, {_m} AS minutes FROM requests), b AS (SELECT *, {S.bucket('minutes')} AS bucket FROM w)
SELECT *, CASE bucket WHEN '12h' THEN 90 WHEN '24h' THEN 180 ELSE 1440 END AS serve_minutes,
  CASE WHEN bucket IN ('12h', '24h') THEN 'full' ELSE 'delta' END AS refresh_mode,
  CASE WHEN bucket IN ('7d', '30d') THEN 24 END AS delta_hours,
  CASE bucket WHEN '7d' THEN 168 WHEN '30d' THEN 720 ELSE 24 END AS recency_hours FROM b""")
O["impossible_date"] = J("SELECT id, coalesce(posted_date > scraped_at + INTERVAL 6 HOUR, false) AS impossible FROM jobs")
_sk = S.tokens(S.norm("skills"), V.RELEVANCE_STOP_WORDS)
O["tokens"] = J(f"SELECT id, (unnest(range(1, len({_sk}) + 1)) - 1)::INTEGER AS pos, unnest({_sk}) AS token FROM jobs")
O["date_bucket"] = R(f"SELECT {S.bucket(S.minutes('date_posted'))} AS bucket, count(*) AS n FROM requests GROUP BY 1")
O["cache_policy"] = f"SELECT request_id, serve_minutes, refresh_mode, delta_hours, recency_hours FROM ({O['window_minutes']})"
