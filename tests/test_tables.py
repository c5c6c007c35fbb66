"""Tables derived once: what they hold, how they are written, and that odd rows keep their number."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

import __spark_entry__ as entry
from postlake.operators import merge
from postlake.plans import bindings as B
from postlake.plans import payloads as P
from postlake.session import _written

T0 = dt.datetime(2024, 1, 3, 4, 5)


def _tables(spark, path, events=60):
    """Events, some twice, and documents: some ids twice, one null, some missing."""
    rows = [(i, T0 + dt.timedelta(minutes=7 * i), i % 9, "view", float(i), "{}") for i in [*range(events), 3, 25, 25]]
    columns = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    spark.createDataFrame(rows, columns).write.parquet(f"{path}/events.parquet")
    docs = [(0, "zero"), (1, "one"), (2, "two"), (2, "two again"), (4, None), (None, "none"), (4, "four")]
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING").write.parquet(f"{path}/documents.parquet")
    return rows, docs


def _expected(rows, docs):
    """(event, description) of every posting, by loops."""
    out = []
    for r in rows:
        sentence = B.SENTENCES[r[0] % len(B.SENTENCES)]
        texts = [t for d, t in docs if d is not None and d == r[0] // 10] or [None]
        out += [(r[0], " ".join(x for x in (sentence, t) if x is not None)) for t in texts]
    return sorted(out)


def test_stored_table_holds_no_texts_and_joins_them_row_by_row(spark, tmp_path):
    rows, docs = _tables(spark, tmp_path)
    d, want = str(tmp_path), _expected(*map(list, (rows, docs)))
    assert sorted(map(tuple, B.jobs(spark, d, text=True).select("ord", "description").collect())) == want
    assert sorted(r.ord for r in B.jobs(spark, d).collect()) == [o for o, _ in want]
    stored = spark.read.parquet(_written[spark.sparkContext.applicationId, B.table_name("jobs", d)])
    assert "description" not in stored.columns and "text" not in stored.columns


def test_landed_payloads_are_rendered_not_stored(spark, tmp_path):
    rows, docs = _tables(spark, tmp_path)
    d = str(tmp_path)
    got = P.landing(spark, d).select("ord", "source").collect()
    assert sorted(map(tuple, got)) == sorted((o, P.DISPATCH[o % len(P.DISPATCH)]) for o, _ in _expected(rows, docs))
    assert not [k for k in _written if k[1] == B.table_name("landing", d)]
    kept = entry.queries()["norm_dispatch"](spark, d).where("source_platform = 'linkedin'").select("ord", "description").collect()
    whole = {o: hashlib.md5(t.encode()).hexdigest() for o, t in _expected(rows, docs) if o in (6, 14)}
    assert {tuple(r) for r in kept if r[0] in whole} <= set(whole.items())


def test_decisions_are_written_without_a_sort(spark, tmp_path):
    rows, _ = _tables(spark, tmp_path)
    d = str(tmp_path)
    book = entry.queries()["cache_stats"](spark, d).first()
    assert book["scrapes"] + book["hits"] == len(rows)
    path = _written[spark.sparkContext.applicationId, B.table_name("decisions", d)]
    files = spark.read.parquet(path).select(F.input_file_name()).distinct().collect()
    assert files and not any("bucket=" in r[0] for r in files)


def test_absent_rows_are_compared_by_short_digests(spark):
    columns = "ord BIGINT, apply_url STRING, raw_hash STRING"
    old = spark.createDataFrame([(1, "u1", "h1"), (2, "u2", None), (3, None, "h3"), (4, "u1", "h1")], columns)
    rows = [(1, "u1", "x"), (2, "y", "h3"), (3, None, None), (4, "y", "z"), (5, "y", "z"), (6, "u2", None), (7, None, "h1"), (8, "u9", None)]
    absent = merge.absent_by_url_or_hash(old, spark.createDataFrame(rows, columns))
    assert absent.columns == ["ord", "apply_url", "raw_hash"]
    assert sorted(r.ord for r in absent.collect()) == [3, 4, 5, 8]
    joins = [x for x in absent._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftAnti" in x]
    assert len(joins) == 2 and not any("apply_url" in x or "raw_hash" in x for x in joins)
