"""Counts and reports over postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.text import contains_any
from postlake.operators.ordered import top_per_group
from postlake.session import cut_lineage

n_rows = lambda: F.count(F.lit(1))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.coalesce(F.round(part / F.nullif(whole, F.lit(0)) * 100, digits), F.lit(0.0))


def overview(jobs: DataFrame) -> DataFrame:
    remote = F.count_if("remote_flag")
    return jobs.agg(n_rows().alias("total"), remote.alias("remote"), percent(remote, n_rows()).alias("remote_pct"))


def by_platform(jobs: DataFrame) -> DataFrame:
    counts = jobs.groupBy("source_platform").agg(n_rows().alias("n"))
    # one row per portal at this point
    return counts.withColumn("bar_pct", F.round(F.col("n") * 100 / F.max("n").over(W.partitionBy()), 1))


def top_companies(jobs: DataFrame, k: int = 5) -> DataFrame:
    return jobs.groupBy("company").agg(n_rows().alias("n")).orderBy(F.desc("n"), F.asc("company")).limit(k)


def market_insights(jobs: DataFrame, keyword: str, k: int = 5) -> DataFrame:
    """Keyword totals next to the top companies, both of the matching postings and of all.

    The texts are searched in one pass; totals and both rankings come from the per-company counts.
    """
    kw = keyword.strip().lower()
    hit = F.lit(False)
    for c in ("title", "company", "description"):
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(kw)
    per = cut_lineage(
        jobs.select("company", "remote_flag", hit.alias("hit")).groupBy("company").agg(
            n_rows().alias("n"), F.count_if("hit").alias("m"), F.count_if(F.col("hit") & F.col("remote_flag")).alias("r")
        )
    )
    total, remote = F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))
    totals = per.agg(total.alias("total"), remote.alias("remote"), percent(remote, total).alias("remote_pct"))
    top = lambda c, scope: (
        per.where(F.col(c) > 0).select("company", F.col(c).alias("n"), F.lit(scope).alias("scope"))
        .orderBy(F.desc("n"), F.asc("company")).limit(k)
    )
    return top("m", "matching").unionByName(top("n", "all")).crossJoin(F.broadcast(totals))  # the right side is one row


def rejection_histogram(reasons: DataFrame, top: int = 3) -> DataFrame:
    """Rejections per reason with the leading ones marked, and the empty-state code when nothing passed."""
    counts = reasons.groupBy("reason").agg(n_rows().alias("n"))
    whole = W.partitionBy()  # at most ten reasons at this point
    passed = F.coalesce(F.max(F.when(F.col("reason").isNull(), F.col("n"))).over(whole), F.lit(0))
    code = F.when(passed == 0, F.lit("all_candidates_filtered_out"))
    rank = F.row_number().over(W.partitionBy().orderBy(F.col("reason").isNull(), F.desc("n"), F.asc("reason")))
    return counts.select("reason", "n", (F.col("reason").isNotNull() & (rank <= top)).alias("leading"), code.alias("empty_code"))


def empty_state(reasons: DataFrame) -> DataFrame:
    return reasons.agg(n_rows().alias("candidates"), F.count_if(F.col("reason").isNull()).alias("passed")).select(
        "*",
        F.when(F.col("candidates") == 0, F.lit("no_candidates_in_db"))
        .when(F.col("passed") == 0, F.lit("all_candidates_filtered_out")).alias("empty_code"),
    )


def portal_coverage(portals: DataFrame, rows: DataFrame) -> DataFrame:
    counts = rows.groupBy(F.col("source_platform").alias("portal")).agg(n_rows().alias("n"))
    return portals.select("portal", "pos").join(counts, "portal", "left").select(
        "portal", "pos", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("contributes")
    )


def coverage_summary(coverage: DataFrame) -> DataFrame:
    silent = F.array_sort(F.collect_list(F.when(~F.col("contributes"), F.struct("pos", "portal"))))
    return coverage.agg(
        F.count_if("contributes").alias("contributing"), n_rows().alias("portals"),
        F.array_join(F.transform(silent, lambda s: s["portal"]), ",").alias("silent"),
    )


def stage_funnel(jobs: DataFrame, normalised: Column, direct: Column, dated: Column, guarded: Column, samples: int = 5) -> DataFrame:
    """Rows per portal left after each stage, with the first rejected links. One pass plus a top-k for the samples."""
    flags = jobs.select(
        "ord", "source_platform", "apply_url", normalised.alias("a"), (normalised & direct).alias("b"),
        (normalised & direct & dated).alias("c"), (normalised & direct & dated & guarded).alias("d"),
    )
    counts = flags.groupBy("source_platform").agg(
        n_rows().alias("raw"), F.count_if("a").alias("normalised"), F.count_if("b").alias("url_valid"),
        F.count_if("c").alias("date_passed"), F.count_if("d").alias("guard_passed"), F.count_if("d").alias("final"),
    )
    bad = top_per_group(flags.where(F.col("a") & ~F.col("b")).select("source_platform", "ord", "apply_url"),
                        ["source_platform"], [F.asc("ord")], samples)
    shown = bad.groupBy("source_platform").agg(F.array_sort(F.collect_list(F.struct("ord", "apply_url"))).alias("s"))
    links = F.array_join(F.transform("s", lambda s: s["apply_url"]), " ")
    return counts.join(shown, "source_platform", "left").select(*counts.columns, F.coalesce(links, F.lit("")).alias("rejected_sample"))


def quality_audit(jobs: DataFrame, sample: int = 50) -> DataFrame:
    """Missing-field rates of the newest postings per portal; an alert when job types stop being recognised."""
    newest = top_per_group(
        jobs.select("ord", "source_platform", "canonical_title", "country", "posted_date", "job_type", "fetched_at"),
        ["source_platform"], [F.col("fetched_at").desc_nulls_last(), F.asc("ord")], sample,
    )
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    unknown = F.col("job_type").isNull() | (F.col("job_type") == "unknown")
    rate = lambda cond: F.avg(cond.cast("int"))
    return newest.groupBy("source_platform").agg(
        n_rows().alias("sampled"),
        F.round(rate(blank("canonical_title")) * 100, 1).alias("null_canonical_pct"),
        F.round(rate(blank("country")) * 100, 1).alias("null_country_pct"),
        F.round(rate(F.col("posted_date").isNull()) * 100, 1).alias("null_posted_pct"),
        F.round(rate(unknown) * 100, 1).alias("unknown_type_pct"),
        ((rate(unknown) > 0.75) & ~F.first("source_platform").isin("workable", "custom")).alias("alert"),
    )


def corroboration(rows: DataFrame, key: Column) -> DataFrame:
    """Copies of one posting across tiers: how many, which tiers in order of first sight, and the first row.

    Tiers are counted per key first, so the list holds one entry per tier however many copies there are.
    """
    per_tier = rows.groupBy(key.alias("tier_key"), "tier").agg(
        n_rows().alias("n"), F.min(F.struct("ord", "id")).alias("first")
    )
    seen = F.array_sort(F.collect_list(F.struct(F.col("first.ord").alias("o"), F.col("tier").alias("t"))))
    return per_tier.groupBy("tier_key").agg(
        F.sum("n").alias("copies"), F.min("first").alias("f"), seen.alias("seen")
    ).select("tier_key", "copies", F.col("f.id").alias("first_id"), F.array_join(F.transform("seen", lambda s: s["t"]), ",").alias("tiers"))


def ingest_metrics(resolved: DataFrame) -> DataFrame:
    """Counts of a resolved batch and its duplicate and clean shares."""
    dup = F.count_if(F.col("outcome").isin("fuzzy", "duplicate_url"))
    return resolved.agg(
        n_rows().alias("normalised"), dup.alias("duplicates"), F.count_if(F.col("outcome") == "kept").alias("inserted"),
        F.count_if(F.col("outcome") == "merge").alias("reconfirmed"), percent(dup, n_rows()).alias("dedup_pct"),
        percent(n_rows() - dup, n_rows()).alias("clean_pct"),
    )


def enrichment_report(enriched: DataFrame) -> DataFrame:
    cols = ["recruiter_email", "company_contact_email", "recruiter_name"]
    some = F.coalesce(*cols).isNotNull()
    return enriched.agg(
        n_rows().alias("total"), F.count("recruiter_email").alias("recruiter_emails"),
        F.count("company_contact_email").alias("company_emails"), F.count("recruiter_name").alias("recruiter_names"),
        F.count_if(some).alias("enriched"), percent(F.count_if(some), n_rows(), 2).alias("hit_rate"),
    )


# --- source choice ---------------------------------------------------------------------------------


def escalation_ladder(rows: DataFrame, query: str | None) -> DataFrame:
    """Per portal and tier: what has accumulated and whether the gate was already satisfied before.

    ``rows`` carries source_platform, tier (0 free, then the paid tiers) and is_exact. Without a query
    (none, empty or blank) every row is a valid answer, so the number of rows alone decides.
    """
    per = rows.groupBy("source_platform", "tier").agg(n_rows().alias("n"), F.count_if("is_exact").alias("exact"))
    upto = W.partitionBy("source_platform").orderBy("tier").rowsBetween(W.unboundedPreceding, 0)  # at most four rows
    before = W.partitionBy("source_platform").orderBy("tier").rowsBetween(W.unboundedPreceding, -1)
    acc = per.withColumns({"cum_n": F.sum("n").over(upto), "cum_exact": F.sum("exact").over(upto)})
    acc = acc.withColumn("match_yield", F.round(F.col("cum_exact") / F.col("cum_n"), 3))
    reason = (
        F.when(F.col("cum_exact") >= V.SATISFIED_EXACT, F.lit("satisfied"))
        .when((F.col("cum_exact") >= V.MIN_EXACT) & (F.col("match_yield") >= V.MIN_YIELD), F.lit("sufficient"))
        .when(F.col("cum_exact") < V.MIN_EXACT, F.lit("too_few_exact"))
        .otherwise(F.lit("low_yield"))
    )
    if not (query or "").strip():
        enough = F.col("cum_n") >= V.MIN_EXACT
        reason = F.when(enough, F.lit("no_query_sufficient_rows")).otherwise(F.lit("no_query_too_few_rows"))
    acc = acc.withColumns({"decision": reason, "stop": reason.isin("satisfied", "sufficient", "no_query_sufficient_rows")})
    ended = F.coalesce(F.bool_or("stop").over(before), F.lit(False))
    return acc.withColumn("runs", ~ended)


def ladder_stats(ladder: DataFrame) -> DataFrame:
    per = ladder.groupBy("source_platform").agg(
        F.bool_or((F.col("tier") == 0) & F.col("stop")).alias("free"),
        *[F.bool_or((F.col("tier") == t) & F.col("runs")).alias(f"t{t}") for t in (1, 2, 3)],
    )
    return per.agg(
        n_rows().alias("portals"), F.count_if("free").alias("answered_free"), F.count_if(~F.col("free")).alias("escalated"),
        percent(F.count_if("free"), n_rows()).alias("free_coverage_pct"),
        *[F.count_if(f"t{t}").alias(f"tier{t}_calls") for t in (1, 2, 3)],
    )


def first_nonempty_source(live: DataFrame, cache: DataFrame, portals: DataFrame, keep: int = 10) -> DataFrame:
    """Rows of the best layer that has any, else the newest cached rows as layer 4."""
    best = live.groupBy("source_platform").agg(F.min("layer").alias("layer"))  # one row per portal
    fresh = live.join(best, ["source_platform", "layer"], "left_semi")
    return fresh.unionByName(_cached(cache, best, portals, keep).withColumn("layer", F.lit(4)), allowMissingColumns=True)


def _cached(cache: DataFrame, answered: DataFrame, portals: DataFrame, keep: int) -> DataFrame:
    silent = portals.select(F.col("portal").alias("source_platform")).join(answered, "source_platform", "left_anti")
    rows = cache.join(F.broadcast(silent), "source_platform", "left_semi")  # at most one row per portal
    return top_per_group(rows, ["source_platform"], [F.col("fetched_at").desc_nulls_last(), F.asc("ord")], keep)


def cache_fallback(live: DataFrame, cache: DataFrame, portals: DataFrame, keep: int = 20) -> DataFrame:
    """Live rows of portals that answered, the newest stored rows (marked stale) of those that did not."""
    answered = live.select("source_platform").distinct()
    old = _cached(cache, answered, portals, keep).withColumn("stale", F.lit(True))
    return live.withColumn("stale", F.lit(False)).unionByName(old)


def fallback_alerts(sourced: DataFrame, last_runs: DataFrame, as_of: Column) -> DataFrame:
    """One alert per portal that had to be served from stored rows."""
    down = sourced.groupBy("source_platform").agg(F.min("layer").alias("layer")).where(F.col("layer") == 4)
    runs = last_runs.select(F.col("portal").alias("source_platform"), "error_message")
    return down.join(runs, "source_platform", "left").select(
        F.col("source_platform").alias("portal"), F.lit("Layers 1-3").alias("failed_layer"),
        F.coalesce("error_message", F.lit("All live layers unreachable")).alias("failure"),
        F.lit("DEGRADED_SERVED_CACHE").alias("status"), as_of.alias("ts"),
    )


def keyword_hit(column: str, words: list[str]) -> Column:
    return contains_any(F.lower(F.col(column)), words)
