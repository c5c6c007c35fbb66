"""Constants that decide results (word lists, lookup tables, patterns, limits).

They are stated here plainly and in their natural order; every operator and every
oracle reads them from this module so that a value is written down exactly once.
"""

from __future__ import annotations

# --- portals -----------------------------------------------------------------------------------
PORTALS = [
    # id, display name, type, category
    ("linkedin", "LinkedIn Jobs", "enterprise_board", "official_enterprise"),
    ("indeed", "Indeed", "enterprise_board", "official_enterprise"),
    ("glassdoor", "Glassdoor", "enterprise_board", "official_enterprise"),
    ("dice", "Dice", "tech_job_board", "remote_boards_aggregators"),
    ("ziprecruiter", "ZipRecruiter", "job_aggregator", "remote_boards_aggregators"),
    ("usajobs", "USAJOBS", "government_board", "remote_boards_aggregators"),
    ("careerbuilder", "CareerBuilder", "job_aggregator", "remote_boards_aggregators"),
    ("simplyhired", "SimplyHired", "job_aggregator", "remote_boards_aggregators"),
    ("weworkremotely", "We Work Remotely", "remote_board", "remote_boards_aggregators"),
    ("hired", "Hired", "staffing_vendor", "remote_staffing_vendors"),
]
PORTAL_IDS = [p[0] for p in PORTALS]

# Tiers switched on per portal (1 direct API or feed, 2 actor, 3 page parse, 4 aggregator, 5 cache).
PORTAL_TIERS = {
    "linkedin": [4, 5],
    "indeed": [4, 5],
    "glassdoor": [4, 5],
    "dice": [1, 2, 3, 4, 5],
    "ziprecruiter": [2, 3, 4, 5],
    "usajobs": [1, 5],
    "careerbuilder": [2, 3, 4, 5],
    "simplyhired": [2, 3, 4, 5],
    "weworkremotely": [1, 3, 4, 5],
    "hired": [2, 3, 4, 5],
}

# id: (keyword, country, remote, date filter, precision, pagination, salary filter, live fetch, primary, needs key)
PORTAL_CAPABILITIES = {
    "linkedin": (True, True, True, True, "relative_text", True, False, True, "serpapi_google_jobs", None),
    "indeed": (True, True, True, True, "relative_text", True, False, True, "firecrawl", None),
    "glassdoor": (True, True, True, True, "relative_text", True, False, True, "firecrawl", None),
    "dice": (True, False, True, True, "relative_text", False, False, True, "firecrawl", None),
    "ziprecruiter": (True, False, True, True, "relative_text", False, False, True, "firecrawl", "ZIPRECRUITER_PARTNER_API_KEY"),
    "usajobs": (True, False, True, True, "exact", True, True, True, "official_api", None),
    "careerbuilder": (True, True, True, True, "relative_text", False, False, True, "firecrawl", "CAREERBUILDER_API_KEY"),
    "simplyhired": (True, True, True, True, "relative_text", False, False, True, "firecrawl", None),
    "weworkremotely": (True, False, True, True, "exact", False, False, True, "rss", None),
    "hired": (True, False, False, False, "unknown", False, False, False, "firecrawl", None),
}
CAPABILITY_FIELDS = [
    "supports_keyword", "supports_country", "supports_remote_filter", "supports_date_filtering",
    "freshness_precision", "supports_pagination", "supports_salary_filter", "supports_live_fetch",
    "primary_method", "needs_api_key",
]

PRESET_TITLES = [
    "Software Engineer", "Data Scientist", "Machine Learning Engineer", "AI Engineer", "DevOps Engineer",
    "Cloud Engineer / Architect", "Product Manager", "Data Engineer", "QA / Test Automation Engineer",
    "Site Reliability Engineer (SRE)", "Cybersecurity Engineer", "ServiceNow Engineer",
]

CONTRACT_ONLY_PORTALS = ["upwork", "fiverr", "toptal", "freelancer", "guru", "peopleperhour", "truelancer", "contra"]
EXACT_PRECISION_PORTALS = ["usajobs", "weworkremotely"]
AGGREGATED_ONLY_PORTALS = ["linkedin", "indeed", "glassdoor"]
AGGREGATED_NOTE = "via Google Jobs aggregation, not scraped directly"
US_ELIGIBILITY_NOTE = "U.S. federal employment — typically requires U.S. citizenship"

DAILY_QUOTAS = {
    "linkedin": 150, "indeed": 150, "glassdoor": 150, "dice": 150, "ziprecruiter": 150,
    "usajobs": 500, "careerbuilder": 150, "simplyhired": 150, "weworkremotely": 500, "hired": 150,
}
DEFAULT_DAILY_QUOTA = 1000
HOURLY_CALL_BUDGET = 40
DAILY_CALL_BUDGET = 300
BLOCKED_RESERVE = 75  # max(5, a quarter of the daily budget)

# Fetch-method routing: method number, label, portals it serves, in running order.
METHOD_ROUTES = [
    (1, "Direct-ATS Capture", ["greenhouse", "lever", "workday", "smartrecruiters", "ashby"]),
    (5, "Aggregator APIs", ["adzuna", "jsearch", "jooble", "arbeitnow", "the_muse", "reed", "remotive"]),
    (4, "Structured Data (JSON-LD)", ["linkedin", "naukri", "indeed", "glassdoor"]),
    (2, "Apify Actors", ["naukri", "indeed", "linkedin", "glassdoor"]),
]
FALLBACK_METHOD = (3, "Self-Hosted Fallback Scraper")

# A portal needs one of these; with an empty list it needs none.
REQUIRED_CREDENTIALS = {
    "linkedin": ["serp_search", "actor_runs"],
    "indeed": ["serp_search", "actor_runs", "page_crawl"],
    "glassdoor": ["serp_search", "actor_runs", "page_crawl"],
    "dice": ["serp_search", "actor_runs", "page_crawl"],
    "ziprecruiter": ["serp_search", "actor_runs", "page_crawl"],
    "usajobs": ["usajobs_key", "usajobs_email"],
    "careerbuilder": ["serp_search", "actor_runs", "page_crawl"],
    "simplyhired": ["serp_search", "actor_runs", "page_crawl"],
    "weworkremotely": [],
    "hired": ["serp_search", "actor_runs", "page_crawl"],
}

# Company index: (company, applicant tracking system)
ATS_COMPANIES = [
    ("stripe", "greenhouse"), ("airbnb", "greenhouse"), ("gitlab", "greenhouse"), ("cloudflare", "greenhouse"),
    ("datadog", "greenhouse"), ("figma", "greenhouse"), ("plaid", "greenhouse"), ("ramp", "greenhouse"),
    ("okta", "greenhouse"), ("atlassian", "greenhouse"), ("razorpay", "greenhouse"), ("freshworks", "greenhouse"),
    ("cred", "greenhouse"), ("meesho", "greenhouse"), ("zepto", "greenhouse"), ("postman", "greenhouse"),
    ("browserstack", "greenhouse"), ("netflix", "lever"), ("spotify", "lever"), ("palantir", "lever"),
    ("zapier", "lever"), ("chime", "lever"), ("robinhood", "lever"), ("gitbook", "lever"), ("hotjar", "lever"),
    ("sourcegraph", "lever"), ("nvidia", "workday"), ("adobe", "workday"), ("salesforce", "workday"),
    ("bosch", "smartrecruiters"), ("visa", "smartrecruiters"), ("ubisoft", "smartrecruiters"),
    ("linear", "ashby"), ("rippling", "ashby"), ("deel", "ashby"), ("notion", "ashby"),
]

# --- text --------------------------------------------------------------------------------------
CURRENCY_BY_COUNTRY = {
    "us": "USD", "gb": "GBP", "uk": "GBP", "in": "INR", "ca": "CAD", "au": "AUD",
    "de": "EUR", "fr": "EUR", "nl": "EUR", "sg": "SGD", "nz": "NZD",
}

WORK_AUTH_PHRASES = [
    "must be authorized to work", "authorized to work in the", "eligible to work in the", "no sponsorship",
    "visa sponsorship", "sponsorship is not available", "sponsorship not available", "unable to sponsor",
    "cannot sponsor", "not offer sponsorship", "us citizen", "citizenship required", "citizen only",
    "green card", "work authorization required", "work authorisation required",
]

REMOTE_WORDS = ["remote", "work from home", "wfh", "telecommute", "hybrid"]

# Whole-word rewrites applied in this order before fuzzy matching.
MATCH_REWRITES = [
    ("sr", "senior"), ("jr", "junior"), ("dev", "developer"), ("eng", "engineer"), ("mgr", "manager"),
    ("inc", ""), ("corp", ""), ("llc", ""), ("ltd", ""), ("co", ""),
]
TITLE_MATCH_THRESHOLD = 88.0
COMPANY_MATCH_THRESHOLD = 90.0

# Canonical title rules in order: (canonical title, substrings, whole words).
CANONICAL_TITLE_RULES = [
    ("ServiceNow Engineer", ["servicenow"], []),
    ("Data Scientist", ["data scientist", "data science"], []),
    ("Machine Learning Engineer", ["machine learning", "deep learning"], ["ml"]),
    ("AI Engineer", ["ai engineer", "artificial intelligence", "llm engineer", "genai"], []),
    ("Data Engineer", ["data engineer"], []),
    ("DevOps Engineer", ["devops", "infrastructure engineer", "platform engineer"], []),
    ("Cloud Engineer / Architect", ["cloud", "aws", "azure", "gcp"], []),
    ("Product Manager", ["product manager", "technical product manager"], ["tpm"]),
    ("QA / Test Automation Engineer", ["qa", "test engineer", "sdet", "quality assurance"], []),
    ("Site Reliability Engineer (SRE)", ["sre", "site reliability"], []),
    ("Cybersecurity Engineer", ["cyber", "security engineer", "information security"], []),
    ("Software Engineer", ["software", "engineer", "developer", "swe", "full stack", "fullstack", "backend", "frontend"], []),
]

# Job type from free text, in order of precedence.
JOB_TYPE_WORDS = [
    ("contract", ["contract", "contractor", "freelance", "temporary", "consultant"]),
    ("full_time", ["full time", "full-time", "full_time", "permanent"]),
    ("part_time", ["part time", "part-time", "part_time"]),
    ("onsite_only", ["onsite", "on-site"]),
]
# Job type from listing text of page, feed and actor sources (the contract list differs per source).
LISTING_CONTRACT_WORDS = ["contract", "contractor", "freelance", "c2c", "corp-to-corp", "c-corp"]
LISTING_PART_WORDS = ["part-time", "part time", "parttime"]
LISTING_FULL_WORDS = ["full-time", "full time", "fulltime", "permanent"]

# Exact job type spellings of a filter value.
JOB_TYPE_ALIASES = {
    "all": ["all", "all types", "all job types"],
    "contract": ["contract", "contractor", "freelance", "contract-to-hire", "c2c", "temporary", "temp"],
    "full_time": ["fulltime", "full-time", "full_time", "permanent", "full time"],
    "part_time": ["parttime", "part-time", "part_time", "part time"],
    "onsite_only": ["onsite", "onsite_only", "on-site", "on site"],
    "internship": ["internship", "intern"],
}
# The same for the search ledger key, where unknown spellings pass through.
LEDGER_JOB_TYPE_ALIASES = {
    "all": ["all", "all types", "all job types"],
    "contract": ["contract", "contractor", "freelance", "contract-to-hire", "c2c"],
    "full_time": ["fulltime", "full-time", "full_time", "permanent"],
    "part_time": ["parttime", "part-time", "part_time"],
    "onsite_only": ["onsite", "onsite_only", "on-site"],
}
VALID_REQUEST_JOB_TYPES = [
    "all", "full_time", "fulltime", "contract", "contractor", "freelance",
    "part_time", "parttime", "onsite_only", "onsite",
]

# --- places ------------------------------------------------------------------------------------
GLOBAL_PLACES = ["worldwide", "global", "anywhere", "remote", "wfh", "work from home"]
GLOBAL_PLACE_PREFIXES = ["worldwide,", "global,", "anywhere,", "remote,"]
REGIONS = [
    ("Americas", ["americas", "latin america", "latam"]),
    ("Europe", ["europe", "emea"]),
    ("Asia Pacific", ["apac", "asia pacific"]),
]
# (ISO code, prefixes, exact names)
COUNTRY_ONLY = [
    ("US", ["usa,", "united states,", "us,"], ["usa", "united states", "us"]),
    ("IN", ["india,", "in,"], ["india", "in"]),
    ("GB", ["uk,", "united kingdom,", "gb,"], ["uk", "united kingdom", "gb", "great britain"]),
    ("CA", ["canada,", "ca,"], ["canada", "ca"]),
    ("AU", ["australia,", "au,"], ["australia", "au"]),
    ("DE", ["germany,", "de,"], ["germany", "de", "deutschland"]),
]
# (ISO code, cities, country names)
CITY_COUNTRY = [
    ("IN", ["bengaluru", "bangalore", "hyderabad", "mumbai", "delhi", "new delhi", "gurgaon", "gurugram", "noida",
            "pune", "chennai", "kolkata", "ahmedabad", "kochi", "trivandrum", "thiruvananthapuram", "indore",
            "jaipur"], ["india"]),
    ("US", ["washington", "mclean", "reston", "silver spring", "adelphi", "san francisco", "sf", "new york", "nyc",
            "austin", "seattle", "chicago", "boston", "denver", "los angeles", "la", "san jose", "atlanta", "dallas",
            "houston", "miami", "phoenix", "portland", "san diego", "baltimore", "pittsburgh", "philadelphia",
            "charlotte", "raleigh"], ["united states", "usa"]),
    ("GB", ["london", "manchester", "haddenham", "birmingham", "leeds", "edinburgh", "bristol", "glasgow",
            "cambridge", "oxford", "liverpool"], ["united kingdom"]),
    ("CA", ["toronto", "vancouver", "montreal", "ottawa", "calgary", "edmonton", "quebec"], ["canada"]),
    ("AU", ["sydney", "melbourne", "brisbane", "perth", "adelaide", "canberra"], ["australia"]),
    ("DE", ["berlin", "munich", "frankfurt", "hamburg", "cologne", "stuttgart", "dusseldorf"], ["germany"]),
]
US_STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK "
    "OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC"
).split()
GLOBAL_COUNTRY_VALUES = ["REMOTE / GLOBAL", "GLOBAL", "WORLDWIDE", "REMOTE", "ANYWHERE"]

# --- contacts ----------------------------------------------------------------------------------
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
GENERIC_MAILBOXES = [
    "careers", "jobs", "job", "hiring", "hr", "recruitment", "recruiting", "privacy", "support", "info", "help",
    "contact", "admin", "sales", "inquiries",
]
COMPANY_DOMAINS = {
    "stripe": "stripe.com", "datadog": "datadoghq.com", "okta": "okta.com", "cloudflare": "cloudflare.com",
    "airbnb": "airbnb.com", "figma": "figma.com", "gitlab": "gitlab.com", "spotify": "spotify.com",
    "palantir": "palantir.com", "netflix": "netflix.com", "zapier": "zapier.com", "chime": "chime.com",
    "robinhood": "robinhood.com",
}
NAME_WINDOW = 150
NAME_STOP_WORDS = ["email", "apply", "job", "career"]
NAME_AFTER_CUE = r"(?:recruiter|hiring manager|contact|posted by|reach out to)\s*:\s*([A-Z][a-z]+\s+[A-Z][a-z]+)"
NAME_BEFORE_ADDRESS = r"([A-Z][a-z]+\s+[A-Z][a-z]+)\s*[\(<]\s*{address}"
NAME_AFTER_VERB = r"(?:reach out to|contact)\s+([A-Z][a-z]+\s+[A-Z][a-z]+)\b"

# --- links -------------------------------------------------------------------------------------
UNUSABLE_LINK_PARTS = [
    "google.com/search", "google.com/url?", "bing.com/search", "duckduckgo.com/?q=", "ibp=htl;jobs",
    "search_query=", "/jobs/search/?keywords=", "/jobs/search?keywords=",
]
SEARCH_PAGE_PARTS = [
    "google.com/search", "google.com/url?", "bing.com/search", "duckduckgo.com/?q=", "ibp=htl;jobs",
    "search_query=", "/jobs/search", "/jobs-search", "/search?", "/search/", "jobs.htm", "/browse",
    "/categories", "/companies",
]
PURGE_LINK_PARTS = ["google.com/search", "ibp=htl;jobs", "bing.com/search", "google.com/url?"]
PORTAL_LINK_PATTERNS = {
    "linkedin": r"linkedin\.com/(jobs/view|in/|comm/jobs/view)",
    "indeed": r"indeed\.[a-z.]+/(.*viewjob|.*jk=|rc/clk|pagead/clk|job/)",
    "glassdoor": r"glassdoor\.[a-z.]+/(.*job-listing|.*joblisting|.*partner/joblisting)",
    "dice": r"dice\.com/(job-detail/|jobs/detail)",
    "ziprecruiter": r"ziprecruiter\.[a-z.]+/(jobs/|c/.*|job/|job-redirect)",
    "usajobs": r"usajobs\.gov/(job/|getjob/)",
    "careerbuilder": r"careerbuilder\.[a-z.]+/(job/|job-details/|job-detail/)",
    "simplyhired": r"simplyhired\.[a-z.]+/(job/|view/)",
    "weworkremotely": r"weworkremotely\.com/(remote-jobs/|jobs/)",
    "hired": r"hired\.com/(jobs/|co/|job/)",
}
DIRECT_POSTING_PATTERNS = [
    r"/jobs?/(view|info|detail|details|posting|opening)/[a-z0-9\-_]{3,}",
    r"/jobs?/[a-z0-9\-_]{6,}(\?|$|/)",
    r"[?&](jk|jobid|job_id|joblistingid|gh_jid|lever|postingid)=",
    r"/viewjob",
    r"(greenhouse|lever|workday|myworkdayjobs|smartrecruiters|recruiterflow|ashbyhq|jobvite|icims|taleo)\.",
    r"/(job-redirect|pagead/clk|apply)\b",
]
PORTAL_LINK_NEEDLES = {
    "linkedin": ["linkedin.com/jobs", "linkedin.com/in/", "linkedin.com/comm/jobs", "linkedin.com"],
    "indeed": ["indeed.com/viewjob", "indeed.com/rc/clk", "indeed.com/job", "indeed.com/m/", "indeed."],
    "glassdoor": ["glassdoor.com/job-listing", "glassdoor.com/partner/jobListing", "glassdoor.com/job", "glassdoor."],
    "dice": ["dice.com/job-detail/", "dice.com/jobs/detail", "dice.com"],
    "ziprecruiter": ["ziprecruiter.com/jobs", "ziprecruiter.com/c/", "ziprecruiter.com/job", "ziprecruiter."],
    "usajobs": ["usajobs.gov/job/", "usajobs.gov/GetJob/", "usajobs.gov"],
    "careerbuilder": ["careerbuilder.com/job-details", "careerbuilder.com/job", "careerbuilder.com/jobs", "careerbuilder."],
    "simplyhired": ["simplyhired.com/job", "simplyhired.com/view", "simplyhired."],
    "weworkremotely": ["weworkremotely.com/remote-jobs", "weworkremotely.com"],
    "hired": ["hired.com/jobs", "hired.com/co", "hired.com"],
}
JOB_LINK_PATTERNS = [
    r'href="([^"]*/jobs?/view/[^"]*)"',
    r'href="([^"]*/job-detail/[^"]*)"',
    r'href="([^"]*/job/[^"]*)"',
    r'href="([^"]*viewjob\?jk=[^"]*)"',
    r'href="([^"]*/remote-jobs/[^"]*)"',
    r'href="([^"]*jobListingId=[^"]*)"',
]
SEARCH_URLS = {
    "linkedin": "https://www.linkedin.com/jobs/search?keywords={kw}&location={loc}&sortBy=DD&f_TPR={tpr}",
    "indeed": "https://www.indeed.com/jobs?q={kw}&l={loc}&sort=date&fromage={fromage}",
    "glassdoor": "https://www.glassdoor.com/Job/jobs.htm?sc.keyword={kw}&locT=N&fromAge={fromage}",
    "dice": "https://www.dice.com/jobs?q={kw}&location={loc}&filters.postedDate={dice_age}",
    "ziprecruiter": "https://www.ziprecruiter.com/jobs-search?search={kw}&location={loc}&days={fromage}",
    "usajobs": "https://www.usajobs.gov/search/results/?k={kw}",
    "careerbuilder": "https://www.careerbuilder.com/jobs?keywords={kw}&location={loc}&posted={fromage}",
    "simplyhired": "https://www.simplyhired.com/search?q={kw}&l={loc}&t={fromage}",
    "weworkremotely": "https://weworkremotely.com/remote-jobs/search?term={kw}",
    "hired": "https://hired.com/jobs?query={kw}",
}

# --- pages -------------------------------------------------------------------------------------
BLOCK_SIGNATURES = [
    "just a moment", "checking your browser", "cf_chl", "datadome", "px-captcha", "perimeterx", "_abck",
    "unusual traffic", "access denied", "are you a robot", "enable javascript and cookies",
]
BLOCK_VENDORS = [
    ("cloudflare", ["cf-ray", "just a moment", "checking your browser", "cf_chl", "__cf_bm"]),
    ("datadome", ["datadome", "dd_cookie", "geo.captcha-delivery.com"]),
    ("perimeterx", ["_px", "perimeterx", "px-captcha"]),
    ("akamai", ["akamai", "_abck", "ak_bmsc"]),
    ("incapsula", ["incap_ses", "_incapsula_", "imperva"]),
    ("generic_captcha", ["captcha", "are you a robot", "unusual traffic", "access denied"]),
]
PROXY_DENY_SIGNATURES = [
    "host not in allowlist", "host_not_allowed", "egress settings", "blocked by proxy", "proxy denied",
    "not permitted by policy",
]
JS_SHELL_WORDS = 250
STATIC_CARD_MINIMUM = 5

# --- dates -------------------------------------------------------------------------------------
MAIL_ZONE_HOURS = {"est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
# filter value: window in minutes
DATE_WINDOWS = {
    "past_12h": 720, "12h": 720,
    "past_24h": 1440, "24h": 1440, "1d": 1440, "today": 1440, "past 24 hours": 1440,
    "past_7d": 10080, "7d": 10080, "7 days": 10080, "past week": 10080,
    "past_30d": 43200, "30d": 43200, "30 days": 43200,
}
DATE_WINDOW_ALL = ["all", "all_time", "all time"]
DEFAULT_WINDOW = 10080
MAX_WINDOW = 43200
TIGHT_WINDOW = 1440
UI_WINDOWS = [
    ("past_12h", "Past 12 Hours", 720), ("past_24h", "Past 24 Hours", 1440),
    ("past_7d", "Past 7 Days", 10080), ("past_30d", "Past 30 Days", 43200),
]
# bucket: (serve minutes, refresh mode, delta hours, hours asked from the source)
CACHE_POLICY = {
    "12h": (90, "full", None, 24),
    "24h": (180, "full", None, 24),
    "7d": (1440, "delta", 24, 168),
    "30d": (1440, "delta", 24, 720),
}
PRECISIONS = ["exact", "hour", "day", "week", "unknown"]
IMPOSSIBLE_DATE_HOURS = 6
RETENTION_DAYS = 15
COOLDOWN_SECONDS = 180
SESSION_IDLE_MINUTES = 30
SESSION_CAP = 1000

# --- search ------------------------------------------------------------------------------------
EXACT_MATCH_SCORE = 0.60
SYNONYM_GROUPS = [
    ["engineer", "developer", "programmer", "swe"],
    ["ml", "machine learning", "ai", "artificial intelligence"],
    ["devops", "sre", "site reliability", "platform engineer"],
    ["frontend", "front end", "front-end", "ui engineer"],
    ["backend", "back end", "back-end", "server side"],
    ["fullstack", "full stack", "full-stack"],
    ["qa", "quality assurance", "test automation", "sdet"],
    ["data scientist", "data science"],
    ["cybersecurity", "security engineer", "infosec", "appsec"],
    ["cloud", "aws", "azure", "gcp"],
    ["pm", "product manager", "product management"],
]
RELEVANCE_STOP_WORDS = (
    "a an the and or of for in at to with job jobs role roles position positions opening openings hiring career "
    "careers opportunity remote senior junior sr jr lead principal staff i ii iii iv entry level mid experienced"
).split()
EXPANSION_STOP_WORDS = (
    "a an the and or of for in at to with job jobs role roles position opening hiring remote senior junior sr jr "
    "lead principal staff i ii iii entry level mid"
).split()
NEGATIVE_SIGNALS = [
    "sales", "recruiter", "recruiting", "account executive", "business development", "marketing",
    "customer success", "support representative", "intern", "internship", "volunteer", "unpaid",
]
MODIFIER_WORDS = (
    "senior sr junior jr lead principal staff i ii iii iv v entry entry-level mid mid-level associate intern "
    "internship trainee"
).split()
QUERY_STOP_WORDS = "a an the of for in and or to with on".split()

TIER_WEIGHT = {"core": 1.0, "strong": 0.70, "related": 0.50, "skills": 0.45}
TIER_RANK = {"core": 0, "strong": 1, "related": 2, "none": 3}
SATISFIED_EXACT = 12
MIN_EXACT = 5
MIN_YIELD = 0.25

ROLE_FAMILIES = [
    {"name": "cloud_infra",
     "match": ["cloud engineer", "cloud", "devops", "sre", "site reliability", "platform engineer",
               "infrastructure engineer", "cloud architect"],
     "strong": ["devops engineer", "site reliability engineer", "platform engineer", "infrastructure engineer",
                "cloud engineer", "cloud architect", "systems engineer", "sre"],
     "related": ["backend engineer", "build engineer", "release engineer", "network engineer", "solutions architect"],
     "skills": ["aws", "azure", "gcp", "kubernetes", "terraform", "docker", "ansible", "cloudformation", "openshift"]},
    {"name": "backend",
     "match": ["backend", "back end", "back-end", "server side", "api engineer"],
     "strong": ["backend engineer", "backend developer", "software engineer", "api engineer", "server side engineer"],
     "related": ["full stack engineer", "platform engineer", "microservices engineer"],
     "skills": ["java", "python", "golang", "node.js", "spring boot", ".net", "django", "fastapi", "microservices"]},
    {"name": "frontend",
     "match": ["frontend", "front end", "front-end", "ui engineer", "ui developer"],
     "strong": ["frontend engineer", "frontend developer", "ui engineer", "web developer", "javascript developer"],
     "related": ["full stack engineer", "mobile developer", "ux engineer"],
     "skills": ["react", "angular", "vue", "typescript", "next.js", "tailwind"]},
    {"name": "fullstack",
     "match": ["full stack", "fullstack", "full-stack"],
     "strong": ["full stack engineer", "full stack developer", "software engineer"],
     "related": ["backend engineer", "frontend engineer", "web developer"],
     "skills": ["react", "node.js", "python", "typescript", "mern"]},
    {"name": "data_eng",
     "match": ["data engineer", "etl", "data pipeline", "analytics engineer"],
     "strong": ["data engineer", "etl developer", "analytics engineer", "big data engineer", "data platform engineer"],
     "related": ["data scientist", "business intelligence engineer", "backend engineer", "database engineer"],
     "skills": ["spark", "airflow", "snowflake", "dbt", "kafka", "databricks", "redshift", "bigquery"]},
    {"name": "data_sci",
     "match": ["data scientist", "data science"],
     "strong": ["data scientist", "applied scientist", "research scientist", "quantitative analyst"],
     "related": ["machine learning engineer", "data analyst", "data engineer", "statistician"],
     "skills": ["pandas", "scikit-learn", "r", "statistics", "sql", "jupyter"]},
    {"name": "ml_ai",
     "match": ["machine learning", "ml engineer", "ai engineer", "artificial intelligence", "deep learning", "nlp"],
     "strong": ["machine learning engineer", "ai engineer", "ml engineer", "deep learning engineer", "nlp engineer",
                "mlops engineer"],
     "related": ["data scientist", "research engineer", "computer vision engineer", "data engineer"],
     "skills": ["pytorch", "tensorflow", "llm", "hugging face", "mlops", "computer vision", "transformers"]},
    {"name": "qa",
     "match": ["qa", "quality assurance", "test automation", "sdet", "tester"],
     "strong": ["qa engineer", "sdet", "test automation engineer", "quality assurance engineer",
                "automation engineer"],
     "related": ["software engineer", "performance engineer", "release engineer"],
     "skills": ["selenium", "cypress", "playwright", "junit", "pytest", "appium"]},
    {"name": "security",
     "match": ["security", "cybersecurity", "infosec", "appsec", "soc analyst"],
     "strong": ["security engineer", "cybersecurity engineer", "application security engineer",
                "information security analyst", "soc analyst"],
     "related": ["devsecops engineer", "cloud engineer", "network engineer", "penetration tester"],
     "skills": ["siem", "penetration testing", "owasp", "iam", "splunk", "soc2"]},
    {"name": "mobile",
     "match": ["mobile", "android", "ios", "flutter", "react native"],
     "strong": ["mobile developer", "android developer", "ios developer", "flutter developer",
                "react native developer"],
     "related": ["frontend engineer", "full stack engineer"],
     "skills": ["swift", "kotlin", "jetpack compose", "swiftui", "dart"]},
    {"name": "product",
     "match": ["product manager", "product owner", "pm", "product management"],
     "strong": ["product manager", "senior product manager", "product owner", "technical product manager"],
     "related": ["program manager", "business analyst", "project manager"],
     "skills": ["roadmap", "stakeholder", "agile", "scrum", "backlog"]},
    {"name": "servicenow",
     "match": ["servicenow", "service now"],
     "strong": ["servicenow developer", "servicenow engineer", "servicenow administrator", "servicenow consultant",
                "servicenow architect"],
     "related": ["itsm engineer", "salesforce developer", "workday consultant"],
     "skills": ["itsm", "itom", "cmdb", "glide", "flow designer"]},
    {"name": "workday",
     "match": ["workday"],
     "strong": ["workday consultant", "workday analyst", "workday integration consultant", "workday hcm consultant"],
     "related": ["hris analyst", "servicenow consultant", "erp consultant"],
     "skills": ["hcm", "peci", "eib", "studio", "prism"]},
]

# --- run diagnosis -----------------------------------------------------------------------------
QUOTA_ERROR_WORDS = ["quota", "402", "payment", "credit", "insufficient", "429", "rate limit"]
BLOCK_ERROR_WORDS = ["403", "forbidden", "allowlist", "blocked"]
MODULE_ERROR_WORDS = ["no module named"]

# --- prompts -----------------------------------------------------------------------------------
PROMPT_DETAIL_WORDS = [
    "detail", "details", "here in chat", "in chat", "give me details", "show details", "tell me more", "list them",
    "list jobs", "explain", "summarize",
]
PROMPT_FOLLOW_UP_WORDS = [
    "from that", "from those", "from them", "only remote", "narrow down", "filter by", "those", "these", "only",
]
PROMPT_REMOTE_WORDS = ["remote", "work from home", "wfh", "telecommute"]
PROMPT_COUNTRIES = [
    ("IN", ["india"]), ("GB", ["uk", "united kingdom", "london"]), ("CA", ["canada"]),
    ("US", ["us", "united states", "america"]),
]
PROMPT_PLATFORMS = [
    ("greenhouse", "greenhouse"), ("lever", "lever"), ("adzuna", "adzuna"), ("jsearch", "jsearch"),
    ("google_jobs", "google"),
]
PROMPT_STOP_WORDS = (
    "find me show jobs job roles role positions paying over above remote in the for with at a an from that those "
    "them only ones give details here chat tell more list explain"
).split()
