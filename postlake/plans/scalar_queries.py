"""Registered queries: the column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions import contacts, dates, expansion, jobs as FJ, keys, links, prompts, text
from postlake.operators.fetch import fetch_requests
from postlake.operators.present import display_columns, provenance
from postlake.plans import bindings as B
from postlake.plans.registry import query

c = F.col


def joined(x, sep=","):
    return F.array_join(x, sep)


@query("strip_html")
def _(spark, d):
    return B.table(spark, d, "pages").select("page_id", text.strip_html(c("html")).alias("plain"))


@query("clean_for_match")
def _(spark, d):
    return B.jobs(spark, d).select(
        "id",
        text.clean_for_match(c("title")).alias("title_key"),
        text.clean_for_match(c("company")).alias("company_key"),
        text.match_signature(c("title"), c("company"), c("city")).alias("signature"),
    )


@query("norm_text")
def _(spark, d):
    n = text.norm_text(c("title"))
    return B.jobs(spark, d).select(
        "id", n.alias("norm_title"),
        joined(text.tokens_of(n, V.RELEVANCE_STOP_WORDS), " ").alias("relevance_tokens"),
        joined(text.tokens_of(n, V.EXPANSION_STOP_WORDS), " ").alias("expansion_tokens"),
        F.size(text.tokens_of(text.norm_text(c("skills")), V.RELEVANCE_STOP_WORDS)).cast("bigint").alias("skill_tokens"),
    )


@query("query_tokenize")
def _(spark, d):
    toks = text.query_tokens(c("title"))
    required, modifiers = text.split_required(toks)
    return B.jobs(spark, d).select(
        "id", joined(toks, " ").alias("tokens"), joined(required, " ").alias("required"),
        joined(modifiers, " ").alias("modifiers"),
    )


@query("combined_keyword")
def _(spark, d):
    groups = F.when(F.lower(F.trim(c("title"))) == "all", F.array().cast("array<array<string>>")).otherwise(
        text.term_groups(c("title"))
    )
    return B.requests(spark, d).select(
        "request_id", text.combined_keyword(groups).alias("keyword"), F.size(groups).cast("bigint").alias("groups")
    )


@query("parse_query")
def _(spark, d):
    phrases = B.requests(spark, d).select("request_id", F.posexplode(F.split("title", ",")).alias("pos", "part"))
    toks = text.tokens_of(text.norm_text(c("part")), V.RELEVANCE_STOP_WORDS)
    return phrases.where(F.size(toks) > 0).select(
        "request_id", c("pos").cast("bigint").alias("pos"), text.norm_text(c("part")).alias("phrase"),
        joined(toks, " ").alias("tokens"),
        joined(F.array_sort(expansion.synonym_expansion(toks))).alias("expanded"),
    )


def _expanded(spark, d):
    return expansion.expand_requests(B.requests(spark, d))


@query("expand_query")
def _(spark, d):
    e = _expanded(spark, d)
    return e.select("request_id", *[joined(c(k)).alias(k) for k in ("core", "strong", "related", "skills", "families")])


@query("expand_terms")
def _(spark, d):
    """One row per widened search term and tier."""
    e = _expanded(spark, d)
    tier = lambda k: F.transform(c(k), lambda t: F.struct(F.lit(k).alias("tier"), t.alias("term")))
    return e.select("request_id", F.explode(F.concat(tier("core"), tier("strong"), tier("related"))).alias("t")).select(
        "request_id", "t.tier", "t.term"
    )


@query("set_difference_terms")
def _(spark, d):
    e = _expanded(spark, d)
    return e.select(
        "request_id",
        joined(F.array_except("strong", "core")).alias("strong_only"),
        joined(F.array_except("related", F.array_union("strong", "core"))).alias("related_only"),
    )


@query("scrape_keywords")
def _(spark, d):
    e = _expanded(spark, d)
    return e.select("request_id", joined(F.slice(F.concat("core", "strong"), 1, 4), " OR ").alias("keywords"))


@query("canonical_title")
def _(spark, d):
    return B.jobs(spark, d).select("id", "title", FJ.canonical_title(c("title")).alias("canonical"))


@query("normalize_job_type")
def _(spark, d):
    return B.jobs(spark, d, text=True).select(
        "id",
        FJ.normalize_job_type(c("source_platform"), c("job_type_raw"), c("title"), c("description")).alias("normal_type"),
    )


@query("canonical_job_type")
def _(spark, d):
    return B.jobs(spark, d).select(
        "id", FJ.canonical_job_type(c("job_type_raw")).alias("filter_type"),
        FJ.ledger_job_type(c("job_type_raw")).alias("ledger_type"),
    )


@query("job_type_from_text")
def _(spark, d):
    t = F.concat_ws(" ", "job_type_raw", "description")
    return B.jobs(spark, d, text=True).select(
        "id", FJ.job_type_from_text(t).alias("listing_type"),
        FJ.job_type_from_text(t, ["freelance", "c2c"]).alias("narrow_type"),
        FJ.schedule_job_type(F.array(F.coalesce("job_type_raw", F.lit("")), (c("ord") % 6).cast("string"))).alias("schedule_type"),
    )


@query("detect_remote")
def _(spark, d):
    none = F.lit("")
    return B.jobs(spark, d, text=True).select(
        "id", FJ.detect_remote(c("title"), c("description"), F.coalesce("location_raw", none)).alias("is_remote")
    )


@query("city_country")
def _(spark, d):
    p = B.jobs(spark, d).select("id", FJ.city_country(c("location_raw"), F.lit("au")).alias("p"))
    return p.select("id", "p.city", "p.country")


@query("work_auth_note")
def _(spark, d):
    return B.jobs(spark, d, text=True).select("id", text.work_auth_note(c("description")).alias("note"))


@query("currency_for_country")
def _(spark, d):
    return B.jobs(spark, d).select("id", "country", FJ.currency_for_country(c("country")).alias("cur"))


@query("extract_contacts")
def _(spark, d):
    t = B.table(spark, d, "documents").select("doc_id", contacts.emails_in(c("text")).alias("mails"))
    return t.select(
        "doc_id", contacts.first_personal(c("mails")).alias("recruiter_email"),
        contacts.first_generic(c("mails")).alias("company_email"), F.size("mails").cast("bigint").alias("emails"),
    )


@query("recruiter_name")
def _(spark, d):
    j = contacts.with_contacts(B.jobs(spark, d, text=True).select("id", "description", "company"))
    return j.where(c("recruiter_email").isNotNull()).select("id", c("recruiter_email").alias("mail"), c("recruiter_name").alias("name"))


@query("company_contact_email")
def _(spark, d):
    return B.jobs(spark, d).select("id", contacts.guessed_company_email(c("company")).alias("guess"))


@query("enrich_contacts")
def _(spark, d):
    j = contacts.with_contacts(B.jobs(spark, d, text=True).select("id", "description", "company"))
    return j.drop("description", "company")


@query("company_from_title")
def _(spark, d):
    shown = F.when(c("ord") % 3 == 0, F.concat("title", F.lit(" at "), "company")).when(
        c("ord") % 3 == 1, F.concat("company", F.lit(": "), "title")
    ).otherwise(F.concat("title", F.lit(" - "), "company"))
    j = B.jobs(spark, d).select("id", shown.alias("shown"))
    t, co = text.company_from_title(c("shown"), "Remote Partner")
    return j.select("id", t.alias("feed_title"), co.alias("feed_company"),
                    text.company_after_dash(c("shown"), "Dice Employer").alias("dash_company"))


@query("keyword_key")
def _(spark, d):
    return B.requests(spark, d).select("request_id", text.keyword_key(c("title")).alias("keyword_key"))


@query("cache_key")
def _(spark, d):
    parts = [c(x) for x in ("title", "q", "platform", "country", "remote_only", "job_type", "date_posted")]
    return B.requests(spark, d).select(
        "request_id", keys.cache_key_json(*parts).alias("filter_json"), keys.cache_key(*parts).alias("cache_key")
    )


@query("filter_hash")
def _(spark, d):
    low = lambda x: F.lower(F.coalesce(c(x), F.lit("all")))
    h = keys.filter_hash(
        c("title"), low("platform"), F.upper(low("country")), c("remote_only"), low("date_posted"), low("job_type"), c("q")
    )
    return B.requests(spark, d).select("request_id", h.alias("filter_hash"))


@query("raw_hash")
def _(spark, d):
    return B.jobs(spark, d).select(
        "id", keys.raw_hash(c("title"), c("company"), c("source_platform"), c("posted_date")).alias("raw_hash")
    )


@query("tier_dedup_key")
def _(spark, d):
    return B.jobs(spark, d).select("id", keys.tier_key(c("title"), c("company"), c("source_platform")).alias("tier_key"))


@query("source_recency_params")
def _(spark, d):
    return fetch_requests(B.requests(spark, d))


@query("classify_run_error")
def _(spark, d):
    from postlake.operators.health import run_cause

    return B.runs(spark, d).select(
        "run_id", "portal", run_cause(c("portal"), c("error_message"), c("success"), F.lit(True)).alias("cause")
    )


@query("detect_block")
def _(spark, d):
    return B.pages(spark, d).select(
        "page_id", links.detect_block(c("status"), c("html")).alias("signature"),
        links.detect_block_vendor(c("status"), c("headers"), c("html")).alias("vendor"),
    )


@query("is_js_shell")
def _(spark, d):
    return B.pages(spark, d).select(
        "page_id", links.visible_words(c("html")).cast("bigint").alias("words"),
        links.is_js_shell(c("html"), links.count_job_links(c("html"))).alias("js_shell"),
    )


@query("display_fields")
def _(spark, d):
    return B.jobs(spark, d).select("id", *[x.alias(k) for k, x in display_columns(B.as_of()).items()])


@query("prompt_intent")
def _(spark, d):
    return B.prompts(spark, d).select(
        "session_id", "turn", *[x.alias(k) for k, x in prompts.intent_columns(c("message")).items()]
    )


@query("truncate_fields")
def _(spark, d):
    return B.jobs(spark, d, text=True).select(
        "id", F.substring("title", 1, 255).alias("title"), F.substring("company", 1, 255).alias("company"),
        F.substring("city", 1, 100).alias("city"), F.substring("canonical_title", 1, 100).alias("canonical_title"),
        F.substring("job_type", 1, 50).alias("job_type"),
        F.md5(F.substring("description", 1, 2000)).alias("snippet_md5"),
        F.length(F.substring("description", 1, 2000)).cast("bigint").alias("snippet_length"),
    )


@query("provenance_tags")
def _(spark, d):
    return provenance(B.jobs(spark, d)).select(
        "id", "source_platform", "data_completeness", "low_yield", "source_note", "country_code", "eligibility_note"
    )


@query("parse_posted_date")
def _(spark, d):
    return B.dated(spark, d).select("ord", dates.parse_posted_date(c("raw_date"), B.as_of()).alias("posted_at"))


@query("precision_from_raw")
def _(spark, d):
    return B.dated(spark, d).select("ord", "raw_date", dates.precision_from_raw(c("raw_date"), c("portal")).alias("grade"))


@query("precision_from_stored")
def _(spark, d):
    return B.jobs(spark, d).select("id", dates.precision_from_stored(c("posted_date"), c("source_platform")).alias("grade"))


@query("to_naive_utc")
def _(spark, d):
    """Stamps carrying an offset brought to plain UTC."""
    shifted = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:30"))
    return B.table(spark, d, "events").select("event_id", dates.parse_posted_date(shifted, B.as_of()).alias("utc"))


@query("effective_freshness")
def _(spark, d):
    e = dates.effective_freshness(c("posted_date"), c("posted_date_precision"), c("scraped_at"), c("fetched_at"), c("source_platform"))
    return B.jobs(spark, d).select("id", e.alias("e")).select("id", "e.ts", "e.precision", "e.field")


@query("is_fresh")
def _(spark, d):
    from postlake.operators.guard import with_freshness

    w = with_freshness(B.jobs(spark, d))
    test = lambda m: dates.is_fresh(c("freshness_ts"), c("freshness_field"), F.lit(m), B.as_of())
    return w.select("id", *[test(m).alias(name) for name, _, m in V.UI_WINDOWS])


@query("window_minutes")
def _(spark, d):
    r = B.requests(spark, d).select("request_id", dates.window_minutes(c("date_posted")).alias("minutes"))
    r = r.withColumn("bucket", dates.date_bucket(c("minutes")))
    return r.select("*", *[x.alias(k) for k, x in dates.cache_policy(c("bucket")).items()])


@query("impossible_date")
def _(spark, d):
    return B.jobs(spark, d).select("id", dates.is_impossible(c("posted_date"), c("scraped_at")).alias("impossible"))


@query("tokens")
def _(spark, d):
    """Meaningful words of the skills field, one row per posting and word."""
    words = text.tokens_of(text.norm_text(c("skills")), V.RELEVANCE_STOP_WORDS)
    return B.jobs(spark, d).select("id", F.posexplode(words).alias("pos", "token"))


@query("date_bucket")
def _(spark, d):
    """Requests per cache bucket."""
    bucket = dates.date_bucket(dates.window_minutes(c("date_posted")))
    return B.requests(spark, d).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("cache_policy")
def _(spark, d):
    """Refresh policy in force for each request."""
    policy = dates.cache_policy(dates.date_bucket(dates.window_minutes(c("date_posted"))))
    return B.requests(spark, d).select("request_id", *[x.alias(k) for k, x in policy.items()])
