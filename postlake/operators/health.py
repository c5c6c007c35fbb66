"""Run health: latest runs, method health, routing, portal status and diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.text import contains_any


def run_cause(portal: Column, error: Column, success: Column, has_credentials: Column) -> Column:
    """Why a portal is silent; a missing key outranks whatever the last run said."""
    e = F.lower(F.coalesce(error, F.lit("")))
    needs_key = portal.isin([p for p, caps in V.PORTAL_CAPABILITIES.items() if caps[-1]])
    return (
        F.when(needs_key, F.lit("NEEDS_PARTNER_API_KEY"))
        .when(~has_credentials, F.lit("MISSING_CREDENTIALS"))
        .when(contains_any(e, V.QUOTA_ERROR_WORDS), F.lit("QUOTA_OR_CREDIT_EXHAUSTED"))
        .when(contains_any(e, V.BLOCK_ERROR_WORDS), F.lit("BLOCKED_OR_NETWORK_DENIED"))
        .when(contains_any(e, V.MODULE_ERROR_WORDS), F.lit("MISSING_PYTHON_DEPENDENCY"))
        .when(success.isNull(), F.lit("NEVER_RUN"))
        .when(success, F.lit("HEALTHY"))
        .otherwise(F.lit("ZERO_RESULTS_OR_CONNECTOR_ISSUE"))
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run per portal; a map-side combinable aggregate, so a busy portal is no hot spot."""
    row = F.struct("ts", "run_id", "method", "layer_used", "success", "num_jobs_found", "error_message")
    newest = runs.groupBy("portal").agg(F.max_by(row, F.struct("ts", "run_id")).alias("r"), F.count(F.lit(1)).alias("runs"))
    return newest.select("portal", "r.*", "runs")


def method_health(runs: DataFrame, window: int = 20) -> DataFrame:
    """Health of every (method, portal) over its last runs, with lifetime totals."""
    won = F.col("success") & (F.col("num_jobs_found") > 0)
    rows = runs.withColumn("won", F.coalesce(won, F.lit(False)))
    keys = ["method", "portal"]
    w = W.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("run_id"))
    recent = (
        rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= window)
        .groupBy(*keys)
        .agg(F.avg(F.col("won").cast("int")).alias("rate"), F.avg("num_jobs_found").alias("jobs"))
    )
    at = F.struct("ts", "run_id")
    failed = ~F.col("won") & F.col("error_message").isNotNull()
    life = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if("won").alias("successful_runs"),
        F.max(F.when(F.col("won"), F.col("ts"))).alias("last_success"),
        F.max_by("error_message", F.when(failed, at)).alias("last_error"),
    )
    status = (
        F.when(F.col("rate") < 0.3, F.lit("CRITICAL")).when(F.col("rate") < 0.7, F.lit("DEGRADED")).otherwise(F.lit("HEALTHY"))
    )
    return life.join(recent, keys).select(
        *keys, status.alias("health_status"), F.round("rate", 2).alias("success_rate"), F.round("jobs", 1).alias("avg_jobs"),
        "total_runs", "successful_runs", "last_success", "last_error", status.isin("DEGRADED", "CRITICAL").alias("falls_back"),
    )


def method_routing(spark: SparkSession, health: DataFrame) -> DataFrame:
    """Ordered fetch plan: the fixed methods, then the self-hosted fallback for unhealthy method-2 portals."""
    rows = [(i, m, label, p) for i, (m, label, ps) in enumerate(V.METHOD_ROUTES) for p in ps]
    routes = spark.createDataFrame(rows, "step INT, method INT, label STRING, portal STRING")
    failing = health.where((F.col("method") == "Method 2") & F.col("falls_back")).select("portal")
    number, label = V.FALLBACK_METHOD
    fallback = routes.where(F.col("method") == 2).join(failing, "portal", "left_semi").select(
        F.lit(len(V.METHOD_ROUTES)).alias("step"), F.lit(number).alias("method"), F.lit(label).alias("label"), "portal"
    )
    return routes.withColumn("is_fallback", F.lit(False)).unionByName(fallback.withColumn("is_fallback", F.lit(True)))


def portal_status(portals: DataFrame, runs: DataFrame, jobs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row per portal: last run, stored and visible postings. One pass over the postings, one over the runs."""
    cut = as_of - F.expr(f"INTERVAL {days} DAYS")
    seen = (F.col("fetched_at") >= cut) | (F.col("scraped_at") >= cut)
    visible = F.coalesce(F.when(F.col("posted_date").isNotNull(), F.col("posted_date") >= cut).otherwise(seen), F.lit(False))
    counts = jobs.groupBy(F.col("source_platform").alias("portal")).agg(
        F.count(F.lit(1)).alias("stored"), F.count_if(visible).alias("visible")
    )
    j = portals.select("portal", "portal_name", "portal_type").join(latest_runs(runs), "portal", "left").join(counts, "portal", "left")
    active = F.col("success") & (F.coalesce("num_jobs_found", F.lit(0.0)) > 0)
    zero = F.lit(0)
    return j.select(
        "portal", "portal_name", "portal_type", F.col("layer_used").alias("operating_layer"),
        F.when(F.col("ts").isNull(), F.lit("UNKNOWN")).when(F.col("success"), F.lit("HEALTHY"))
        .otherwise(F.lit("DEGRADED_CACHED")).alias("status"),
        F.when(active, F.lit("ACTIVE")).otherwise(F.lit("DEACTIVATED")).alias("runtime_status"),
        F.col("ts").alias("last_run"), F.coalesce("num_jobs_found", F.lit(0.0)).alias("last_jobs_found"),
        F.coalesce("stored", zero).alias("total_jobs"), F.coalesce("visible", zero).alias("visible_7d"),
        F.col("error_message").alias("last_error"),
    )


def missing_credentials(portal: Column, held: list[str]) -> Column:
    """Credentials of a portal that are not held, comma-joined in their order; empty without any."""
    out = F.lit("")
    for p, names in V.REQUIRED_CREDENTIALS.items():
        out = F.when(portal == p, F.lit(",".join(n for n in names if n not in held))).otherwise(out)
    return out


def portal_diagnostics(portals: DataFrame, runs: DataFrame, jobs: DataFrame, held: list[str] | None = None) -> DataFrame:
    """Why each portal is silent. ``held`` names the credentials at hand (None: all); one of a portal's list is enough."""
    counts = jobs.groupBy(F.col("source_platform").alias("portal")).agg(F.count(F.lit(1)).alias("stored"))
    j = portals.select("portal", "portal_name").join(latest_runs(runs), "portal", "left").join(counts, "portal", "left")
    short = [p for p, names in V.REQUIRED_CREDENTIALS.items() if held is not None and names and not set(names) & set(held)]
    cause = run_cause(F.col("portal"), F.col("error_message"), F.col("success"), ~F.col("portal").isin(short) if short else F.lit(True))
    fixable = cause.isin("MISSING_PYTHON_DEPENDENCY", "NEVER_RUN", "HEALTHY", "ZERO_RESULTS_OR_CONNECTOR_ISSUE")
    return j.select(
        "portal", "portal_name", F.col("ts").alias("last_attempt"), F.col("layer_used").alias("last_layer"),
        F.col("success").alias("last_success"), F.coalesce("num_jobs_found", F.lit(0.0)).alias("last_jobs_found"),
        F.col("error_message").alias("last_error"), cause.alias("diagnosed_cause"), fixable.alias("fixable_in_code"),
        F.coalesce("stored", F.lit(0)).alias("jobs_in_db"),
    )


def run_verdict(portals: DataFrame, found: DataFrame, inserted: DataFrame, stored: DataFrame) -> DataFrame:
    """Per portal: rows found, rows newly stored and the total afterwards."""
    n = lambda df, name: df.groupBy(F.col("source_platform").alias("portal")).agg(F.count(F.lit(1)).alias(name))
    zero = F.lit(0)
    j = portals.select("portal", "pos").join(n(found, "f"), "portal", "left").join(n(inserted, "i"), "portal", "left")
    j = j.join(n(stored, "s"), "portal", "left")
    f, i, s = (F.coalesce(c, zero) for c in ("f", "i", "s"))
    return j.select(
        "portal", f.alias("found"), i.alias("inserted"), (s + i).alias("total"),
        F.when(f > 0, F.lit("ACTIVE")).otherwise(F.lit("ZERO_RESULTS")).alias("status"),
    )


def verdict_summary(verdict: DataFrame) -> DataFrame:
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("portal")))), ",")
    return verdict.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("found") > 0).alias("returning"),
        names(F.col("found") > 0).alias("working"), names(F.col("found") == 0).alias("silent"),
    )
