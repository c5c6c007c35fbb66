"""Gates of the source ladder with and without a query; credentials and tags of sources."""

from postlake.operators.health import missing_credentials, portal_diagnostics
from postlake.operators.present import provenance
from postlake.operators.stats import escalation_ladder


def ladder(spark, rows, query):
    df = spark.createDataFrame(rows, "source_platform STRING, tier INT, is_exact BOOLEAN")
    return {(r["source_platform"], r["tier"]): (r["decision"], r["runs"]) for r in escalation_ladder(df, query).collect()}


def test_without_a_query_the_number_of_rows_decides(spark):
    rows = [("a", 0, False)] * 4 + [("a", 1, False)] + [("a", 2, False)] + [("b", 0, False)] * 5 + [("b", 1, False)]
    few, enough = "no_query_too_few_rows", "no_query_sufficient_rows"
    for query in (None, "", "  "):
        assert ladder(spark, rows, query) == {("a", 0): (few, True), ("a", 1): (enough, True), ("a", 2): (enough, False), ("b", 0): (enough, True), ("b", 1): (enough, False)}
    assert ladder(spark, [], "") == {}


def test_with_a_query_exact_rows_and_yield_decide(spark):
    rows = [("a", 0, False)] * 5 + [("b", 0, True)] * 12 + [("c", 0, True)] * 5 + [("c", 0, False)] * 15 + [("d", 0, True)] * 5 + [("d", 0, False)] * 16
    got = ladder(spark, rows, "nurse")
    assert {k[0]: v[0] for k, v in got.items()} == {"a": "too_few_exact", "b": "satisfied", "c": "sufficient", "d": "low_yield"}


def test_one_of_a_portals_credentials_is_enough(spark):
    names = ["indeed", "usajobs", "weworkremotely", "linkedin"]
    portals = spark.createDataFrame([(p, p) for p in names], "portal STRING, portal_name STRING")
    runs = spark.createDataFrame([], "portal STRING, ts TIMESTAMP_NTZ, run_id BIGINT, method STRING, layer_used STRING, success BOOLEAN, num_jobs_found DOUBLE, error_message STRING")
    jobs = spark.createDataFrame([], "source_platform STRING")

    def causes(held):
        return {r["portal"]: (r["diagnosed_cause"], r["fixable_in_code"]) for r in portal_diagnostics(portals, runs, jobs, held).collect()}

    never, missing = ("NEVER_RUN", True), ("MISSING_CREDENTIALS", False)
    assert causes(None) == dict.fromkeys(names, never)
    assert causes([]) == {"indeed": missing, "usajobs": missing, "weworkremotely": never, "linkedin": missing}
    assert causes(["page_crawl", "usajobs_email"]) == {"indeed": never, "usajobs": never, "weworkremotely": never, "linkedin": missing}
    got = portals.select("portal", missing_credentials(portals["portal"], ["page_crawl"]).alias("m")).collect()
    assert dict(got) == {"indeed": "serp_search,actor_runs", "usajobs": "usajobs_key,usajobs_email", "weworkremotely": "", "linkedin": "serp_search,actor_runs"}


def test_teaser_portals_are_tagged(spark):
    df = spark.createDataFrame([("hired",), ("dice",), (None,)], "source_platform STRING")
    tags = lambda rows: [r["data_completeness"] for r in rows.collect()]
    assert tags(provenance(df)) == ["limited", None, None]
    assert tags(provenance(df, ("dice",))) == ["limited", "teaser_only", None]
    assert tags(provenance(df, ("dice", "hired"))) == ["teaser_only", "teaser_only", None]
