"""Registered queries: merges, duplicate resolution, the search ledger, budgets and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.functions import contacts
from postlake.functions.dates import ts
from postlake.functions.keys import filter_hash
from postlake.functions.text import iso_text
from postlake.operators import budgets, dedup, ledger, merge, sessions
from postlake.operators import guard as G
from postlake.operators import health as H
from postlake.operators import stats as T
from postlake.operators.cooldown import with_accepted
from postlake.plans import bindings as B
from postlake.plans.registry import query
from postlake.plans.search_queries import FLAGSHIP
from postlake.session import written_once
from postlake.sources import dims

c = F.col


@query("merge_write_once")
def _(spark, d):
    return merge.merge_write_once(B.stored_jobs(spark, d), B.incoming_jobs(spark, d), B.as_of())


@query("merge_counts")
def _(spark, d):
    return merge.merge_write_once(B.stored_jobs(spark, d), B.incoming_jobs(spark, d), B.as_of()).groupBy("action").agg(
        T.n_rows().alias("n")
    )


@query("insert_absent")
def _(spark, d):
    return merge.insert_absent(B.stored_jobs(spark, d), B.incoming_jobs(spark, d)).select("id", "apply_url", "ord")


@query("insert_hash_dedup")
def _(spark, d):
    new = merge.with_raw_hash(B.incoming_jobs(spark, d)).select("ord", "id", "title", "apply_url", "raw_hash")
    old = merge.with_raw_hash(B.stored_jobs(spark, d)).select("apply_url", "raw_hash")
    return merge.insert_hash_dedup(old, new).select("id", "ord", "raw_hash")


@query("anti_url_or_hash")
def _(spark, d):
    new = merge.with_raw_hash(B.incoming_jobs(spark, d)).select("ord", "id", "apply_url", "raw_hash")
    old = merge.with_raw_hash(B.stored_jobs(spark, d)).select("apply_url", "raw_hash")
    return merge.absent_by_url_or_hash(old, new).select("id", "ord")


@query("append_runlog")
def _(spark, d):
    found = B.incoming_jobs(spark, d).where(c("source_platform") != "hired").select(c("source_platform").alias("portal"))
    return merge.append_runlog(found, dims.portals(spark), "5-Tier", B.as_of())


@query("append_guard_audit")
def _(spark, d):
    reasons = G.with_reason(B.jobs(spark, d, text=True), FLAGSHIP, B.as_of())
    lit = F.lit
    h = filter_hash(lit("cloud engineer"), lit("all"), lit("ALL"), lit(False), lit("past_7d"), lit("all"), lit(None).cast("string"))
    return merge.append_guard_audit(reasons, h, B.as_of())


@query("export_search_docs")
def _(spark, d):
    j = contacts.with_contacts(B.jobs(spark, d, text=True)).withColumns(
        {"description_snippet": F.col("description"), "posted_date": iso_text(c("posted_date"))}
    )
    docs = merge.search_documents(j)
    field = lambda k: F.get_json_object("doc", f"$.{k}")
    return docs.select(
        "id", field("title").alias("title"), field("salary_max").cast("double").alias("salary_max"), field("posted_date").alias("posted_date"),
        field("recruiter_email").alias("recruiter_email"), F.md5(field("description_snippet")).alias("snippet_md5"),
        F.json_object_keys("doc").alias("k"),
    ).withColumn("fields", F.size("k").cast("bigint")).drop("k")


@query("copy_missing_by_id")
def _(spark, d):
    return merge.insert_absent(B.stored_jobs(spark, d), B.jobs(spark, d), "id").select("id", "title", "company")


def _paid_and_free(spark, d):
    j = B.jobs(spark, d).select("ord", "id", "apply_url")
    near = F.when(c("ord") % 10 == 1, F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/"), F.floor(c("ord") / 30).cast("string")))
    free = j.where(c("ord") % 2 == 1).withColumn("apply_url", F.when(c("ord") % 14 == 3, F.lit("")).otherwise(F.coalesce(near, c("apply_url"))))
    paid = j.where(c("ord") % 2 == 0).withColumn(
        "apply_url", F.when(c("ord") % 4 == 0, F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/"), F.floor(c("ord") / 40).cast("string")))
        .otherwise(c("apply_url")))
    return paid, free


@query("merge_partial")
def _(spark, d):
    return merge.merge_partial(*_paid_and_free(spark, d)).select("id", "apply_url")


@query("distinct_union_url")
def _(spark, d):
    paid, free = _paid_and_free(spark, d)
    both = paid.withColumn("p", c("ord")).unionByName(free.withColumn("p", c("ord") + 1_000_000_000_000))
    return merge.first_per(both.where(c("apply_url") != ""), "apply_url", "p").select("id", "apply_url")


@query("union_tiers")
def _(spark, d):
    """Rows of all tiers side by side; each tier brings its own columns."""
    j = B.jobs(spark, d)
    one = j.where(c("ord") % 3 == 0).select("id", "title", "salary_min", F.lit("Tier 1").alias("source_tier"))
    two = j.where(c("ord") % 3 == 1).select("id", "title", "skills", F.lit("Tier 2").alias("source_tier"))
    four = j.where(c("ord") % 3 == 2).select("id", "title", "source_platform", F.lit("Tier 4").alias("source_tier"))
    return one.unionByName(two, allowMissingColumns=True).unionByName(four, allowMissingColumns=True)


@query("fuzzy_pairs")
def _(spark, d):
    """Matching signatures with both similarity ratios and the number of postings behind each side."""
    s = dedup.with_signature(B.jobs(spark, d).select("company", "title")).where(c("sig").isNotNull())
    sigs = s.groupBy("sig", "company_key", "title_key").agg(T.n_rows().alias("n"))
    edges = dedup.signature_edges(sigs.select("sig", "company_key", "title_key"))
    side = lambda x: sigs.select(c("sig").alias(f"sig_{x}"), c("company_key").alias(f"company_{x}"), c("title_key").alias(f"title_{x}"), c("n").alias(f"n_{x}"))
    return edges.join(side("a"), "sig_a").join(side("b"), "sig_b").select(
        "company_a", "title_a", "company_b", "title_b", F.round("company_ratio", 6).alias("company_ratio"),
        F.round("title_ratio", 6).alias("title_ratio"), "n_a", "n_b",
    )


@query("token_set_ratio")
def _(spark, d):
    """Title pairs at or above the title threshold, over all distinct titles."""
    t = B.jobs(spark, d).select(dedup.clean_for_match(c("title")).alias("t")).distinct()
    p = dedup.prepare_strings(t, "t", "t", 76.0)
    return dedup.similar_pairs(p, p, "t", "t", 76.0).select("t", "t_b", F.round("ratio", 6).alias("ratio"))


def _resolved(spark, d):
    """Outcome of the landed batch, written once: the reports below read it."""
    build = lambda: dedup.resolve(B.stored_jobs(spark, d), B.incoming_jobs(spark, d))
    return written_once(spark, B.table_name("resolved", d), build, ["outcome"])


@query("greedy_dedup")
def _(spark, d):
    return dedup.resolve(B.stored_jobs(spark, d), B.incoming_jobs(spark, d)).select("ord", "outcome", "refresh_url")


@query("refresh_candidates")
def _(spark, d):
    old, new = B.stored_jobs(spark, d), B.incoming_jobs(spark, d)
    return dedup.refresh_candidates(_resolved(spark, d), new, old)


@query("ingest_metrics")
def _(spark, d):
    return T.ingest_metrics(_resolved(spark, d))


@query("run_verdict")
def _(spark, d):
    old = B.stored_jobs(spark, d)
    new = B.incoming_jobs(spark, d).where(c("source_platform") != "dice")
    return H.run_verdict(dims.portals(spark), new, merge.insert_absent(old, new), old)


@query("run_verdict_summary")
def _(spark, d):
    old = B.stored_jobs(spark, d)
    new = B.incoming_jobs(spark, d).where(c("source_platform") != "dice")
    return H.verdict_summary(H.run_verdict(dims.portals(spark), new, merge.insert_absent(old, new), old))


# --- ledger, budgets, sessions ---------------------------------------------------------------------


def _decided(spark, d):
    """One decision per request, written once: the ledger reports read it. No report reads a bucket alone, and a table
    kept by bucket is sorted by it as it is written, in tasks that hold as many rows as there are of a bucket."""
    return written_once(spark, B.table_name("decisions", d), lambda: ledger.decisions(B.requests(spark, d)), [])


@query("ledger_lookup")
def _(spark, d):
    return ledger.decisions(B.requests(spark, d)).select("request_id", "cache_key", "last_scraped_at")


@query("cache_decision")
def _(spark, d):
    return _decided(spark, d).select(
        "request_id", "should_scrape", "mode", "since_hours", F.round("age_minutes", 3).alias("age_minutes")
    )


@query("ledger_record")
def _(spark, d):
    return ledger.ledger(_decided(spark, d)).drop("filter_json")


@query("ledger_merge")
def _(spark, d):
    """Two half-month batches merged: counters add up, the newer stamp wins."""
    dec = _decided(spark, d)
    half = ts("2024-01-16 00:00:00")
    a, b = ledger.ledger(dec.where(c("ts") < half)), ledger.ledger(dec.where(c("ts") >= half))
    return ledger.merge_ledger(a, b).select("cache_key", "scrape_count", "hit_count", "date_bucket")


@query("cache_stats")
def _(spark, d):
    return ledger.stats(ledger.ledger(_decided(spark, d)))


@query("cache_stats_by_bucket")
def _(spark, d):
    return ledger.ledger(_decided(spark, d)).groupBy("date_bucket").agg(T.n_rows().alias("combinations"))


@query("purge_ledger")
def _(spark, d):
    book = ledger.ledger(_decided(spark, d))
    return ledger.purge(book, ts("2024-02-13 12:00:00"), 15).select("cache_key", "last_scraped_at")


@query("cooldown_suppress")
def _(spark, d):
    """Refresh starts per title with a long cool-down, so that chains form."""
    r = B.requests(spark, d).select("request_id", "ts", F.coalesce("title", F.lit("")).alias("key"))
    return with_accepted(r, "key", "ts", "request_id", F.lit(3600)).select("request_id", "key", "accepted", "last_accepted_at")


@query("quota_usage")
def _(spark, d):
    calls = B.runs(spark, d).select(c("run_id").alias("call_id"), c("portal").alias("source"), "ts")
    return budgets.quota_usage(calls)


@query("call_budget")
def _(spark, d):
    calls = B.runs(spark, d).select(
        c("run_id").alias("call_id"), "ts", F.coalesce(c("error_message") == "403 forbidden", F.lit(False)).alias("blocked")
    )
    return budgets.call_budget(calls, hourly=12, daily=150, reserve=75)


@query("session_intent_carry")
def _(spark, d):
    return sessions.carried_intent(B.prompts(spark, d))


@query("lru_cap")
def _(spark, d):
    return sessions.lru_cap(B.prompts(spark, d), ts("2024-01-04 00:00:00"), 60 * 24 * 60, 1000)
