"""Streams fed in several micro-batches give what the batch operators give on the whole input."""

import datetime as dt
import random
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as entry
from postlake.functions.dates import ts
from postlake.operators.cooldown import with_accepted
from postlake.operators.sessions import carried_intent
from postlake.plans import bindings as B
from postlake.session import shared_dir
from postlake.sources.postings import normalize_batch
from postlake.streaming import stateful
from postlake.streaming.ingest import SCHEMA, ingest_batch, load, run_ingest
from postlake.streaming.run import drain
from postlake.streaming.store import JobStore

T0 = dt.datetime(2024, 1, 1)


def _stream(spark, df, order, path, parts=3):
    """The frame written as time-ordered files, read one file per micro-batch."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    import time

    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their modification time
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_cooldown_parity(spark, tmp_path):
    rng = random.Random(4)
    rows, t = [], T0
    for i in range(120):
        t += dt.timedelta(seconds=rng.choice([5, 60, 200]))
        rows.append((f"k{rng.randrange(3)}", t, i))
    df = spark.createDataFrame(rows, "key STRING, ts TIMESTAMP_NTZ, id BIGINT")
    got = drain(stateful.cooldown(_stream(spark, df, "ts", str(tmp_path / "in"))), "t-cool")
    want = with_accepted(df, "key", "ts", "id", F.lit(180))
    assert {(r.id, r.accepted) for r in got.collect()} == {(r.id, r.accepted) for r in want.collect()}


def test_session_parity(spark, tmp_path):
    df = B.prompts(spark, "/root/testdata/sf0.001")
    got = drain(stateful.session_carry(_stream(spark, df, "ts", str(tmp_path / "in"))), "t-sess")
    cols = ["session_id", "turn", "is_follow_up", "query", "remote_only", "country", "min_salary", "platform"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, carried_intent(df).select(*cols).collect()))


def _item(url, title, date, company="Acme", text=""):
    return f'{{"title":"{title}","url":"{url}","company":"{company}","postedAt":{date},"description":"{text}"}}'


def test_ingest_is_write_once_refreshes_and_replay_safe(spark, tmp_path):
    land = "ord BIGINT, source STRING, raw STRING"
    first = [
        (1, "dice", _item("https://x.com/job/1", "Nurse", "null")), (2, "dice", _item("https://x.com/job/2", "Pilot", '"2024-01-02"')),
        (3, "dice", _item("https://x.com/job/4", "Welder", "null", "Globex LLC", "Ask jane.doe@globex.com")),
    ]
    second = [
        (3, "dice", _item("https://x.com/job/1", "Nurse", '"2024-01-05"')),  # fills the blank
        (4, "dice", _item("https://x.com/job/2", "Pilot", '"2024-01-09"')),  # bump: ignored
        (5, "dice", _item("https://x.com/job/3", "Baker", "null")),
        (6, "dice", _item("https://x.com/job/9", "Pilot", "null")),  # fuzzy duplicate of a stored posting without a date to give
        (7, "dice", _item("https://x.com/job/8", "Welder", "null", "Globex")),  # likewise
        (8, "dice", _item("https://x.com/job/7", "Welder", '"2024-01-07"', "Globex")),  # dates the stored posting
        (9, "dice", _item("https://x.com/job/6", "Welder", '"2024-01-01"', "Globex")),  # too late: it has a date
    ]
    third = [(1, "dice", _item("https://x.com/job/5", "Baker", '"2024-01-11"')), (2, "dice", _item("https://x.com/job/7", "Diver", "null", "Globex"))]
    path = str(tmp_path / "land")
    store = JobStore(spark, str(tmp_path / "store"), SCHEMA, buckets=8)
    begin, as_of = ts("2024-01-30 00:00:00"), ts("2024-01-31 00:00:00")
    load(store, spark.createDataFrame(first, land), ["dice"], begin)
    for part in (second, third):
        spark.createDataFrame(part, land).coalesce(1).write.mode("append").parquet(path)
        rows = run_ingest(normalize_batch(spark.readStream.schema(land).parquet(path), ["dice"], as_of), store, ["dice"], as_of)
    out = {r.apply_url[-1]: r for r in rows.collect()}
    assert sorted(out) == ["1", "2", "3", "4", "7"]
    assert out["1"].posted_date == dt.datetime(2024, 1, 5) and out["1"].posted_date_precision == "day"
    assert out["2"].posted_date == dt.datetime(2024, 1, 2) and out["2"].fetched_at == dt.datetime(2024, 1, 31)
    assert out["3"].posted_date == dt.datetime(2024, 1, 11)  # a link of the first batch, dated by a duplicate of the second
    assert out["4"].posted_date == dt.datetime(2024, 1, 7) and out["4"].fetched_at == dt.datetime(2024, 1, 31)
    assert out["4"].recruiter_email == "jane.doe@globex.com" and out["4"].recruiter_name == "Jane Doe"
    assert {r.scraped_at for r in (out["1"], out["4"])} == {dt.datetime(2024, 1, 30)}
    log = {r.portal: r.num_jobs_found for r in spark.read.parquet(f"{store.base}/runlog/1").collect()}
    assert log == {"dice": 7.0}
    # a replayed batch writes the same version again; untouched buckets keep their older files
    before = {r.apply_url: r.posted_date for r in store.rows.read(1).collect()}
    ingest_batch(store, 1, normalize_batch(spark.createDataFrame(second, land), ["dice"], as_of), ["dice"], as_of)
    assert {r.apply_url: r.posted_date for r in store.rows.read(1).collect()} == before
    assert 0 in store.rows._versions(2).values() or len(store.rows._versions(2)) < 8


def test_ingest_writes_descriptions_once_apart_from_rows(spark, tmp_path):
    """A batch that dates every stored posting rewrites all rows, but no text again."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    texts = [" ".join(word() for _ in range(1000)) for _ in range(40)]
    land = "ord BIGINT, source STRING, raw STRING"
    rows = lambda date: [(i, "dice", _item(f"https://x.com/job/{i}", f"Role {word()}", date, word(), t)) for i, t in enumerate(texts)]
    store = JobStore(spark, str(tmp_path / "store"), SCHEMA, buckets=4)
    load(store, spark.createDataFrame(rows("null"), land), ["dice"], ts("2024-01-30 00:00:00"))
    spark.createDataFrame(rows('"2024-01-05"'), land).coalesce(1).write.parquet(str(tmp_path / "land"))
    as_of = ts("2024-01-31 00:00:00")
    normal = normalize_batch(spark.readStream.schema(land).parquet(str(tmp_path / "land")), ["dice"], as_of)
    out = run_ingest(normal, store, ["dice"], as_of).collect()
    assert {int(r.apply_url.rsplit("/", 1)[1]): r.description for r in out} == dict(enumerate(texts))
    assert {r.posted_date for r in out} == {dt.datetime(2024, 1, 5)} and out[0].asDict().keys() == set(SCHEMA.names)
    shown = store.described(store.rows.read(1), F.length).collect()
    assert {r.description for r in shown} == {len(t) for t in texts} and len(shown) == len(texts)
    assert sum(f.stat().st_size for f in (tmp_path / "store" / "jobs").rglob("*.parquet")) < sum(map(len, texts)) / 3


def test_batch_reads_and_rewrites_only_touched_buckets(spark, tmp_path):
    """One landed row in a store of 2,000: one bucket of links is written anew."""
    land = "ord BIGINT, source STRING, raw STRING"
    store = JobStore(spark, str(tmp_path / "store"), SCHEMA, buckets=16)
    many = [(i, "dice", _item(f"https://x.com/job/{i}", f"Role w{i % 97} v{i % 89}", "null", f"Firm q{i % 53}")) for i in range(2000)]
    load(store, spark.createDataFrame(many, land), ["dice"], ts("2024-01-30 00:00:00"))
    as_of = ts("2024-01-31 00:00:00")
    one = spark.createDataFrame([(1, "dice", _item("https://x.com/job/new", "Astronaut", "null", "Zyx Orbital"))], land)
    ingest_batch(store, 1, normalize_batch(one, ["dice"], as_of), ["dice"], as_of)
    at = store.rows._versions(1)
    assert sorted(at.values()).count(1) == 1 and len(at) == 16
    assert store.rows.read(1).count() == 2001
    assert sorted(store.signatures._versions(1).values()).count(1) == 1


def test_signatures_of_a_batch_are_worked_out_once(spark, tmp_path):
    """The index writes two tables of buckets from the inserted postings and reads the postings once."""
    store = JobStore(spark, str(tmp_path / "store"), SCHEMA, buckets=4)
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    rows = [(i, f"https://x.com/job/{i}", f"Firm q{i % 7}", f"Role v{i % 11}") for i in range(200)]
    schema = "ord BIGINT, apply_url STRING, company STRING, title STRING"
    store.add_signatures(0, spark.createDataFrame(rows, schema).mapInPandas(counted, schema), store.signatures.read(-1))
    assert read.value == 200
    assert store.signatures.read(0).count() == 77 and store.companies.read(0).select("company_key").distinct().count() == 7


def test_landings_stand_by_source(spark, tmp_path):
    """The readers of the eight sources scan a landing once, not eight times; a first landing without rows is no harm."""
    for name in ("events", "documents"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        rows.where("event_id BETWEEN 12 AND 35" if name == "events" else "doc_id < 4").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    seen = []
    query = entry.queries()["stream_ingest"](spark, str(tmp_path))
    assert query.count() > 0 and query.columns == SCHEMA.names
    for folder in Path(shared_dir(spark), spark.sparkContext.applicationId, "streams").glob("ingest-*"):
        seen.append({p.parent.name for p in folder.glob("filled/**/*.parquet")})
    assert any(s and all(n.startswith("source=") for n in s) for s in seen)


def test_quota_counts_late_calls_on_their_own_day(spark, tmp_path):
    """200 calls of one day around a call of the next, in three micro-batches: 150 are allowed."""
    day = [0] * 133 + [1] + [0] * 67
    rows = [("linkedin", T0 + dt.timedelta(days=d, seconds=i), i) for i, d in enumerate(day)]
    df = spark.createDataFrame(rows, "source STRING, ts TIMESTAMP_NTZ, id BIGINT")
    got = drain(stateful.daily_quota(_stream(spark, df, "id", str(tmp_path / "in"))), "t-quota").collect()
    assert len(got) == 201
    assert sum(r.allowed for r in got if r.id != 133) == 150
    assert [r.used_before for r in got if r.id == 133] == [0]
    assert sorted(r.used_before for r in got if r.id != 133) == sorted([*range(150), *[150] * 50])


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    rows = spark.createDataFrame([(i // 4, i % 4, "user", f"text {i}") for i in range(40)], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    (tmp_path / "one").mkdir()
    rows.toPandas().to_parquet(tmp_path / "one" / "conversations.parquet")
    want = sorted(map(tuple, carried_intent(B.prompts_of(rows)).select("session_id", "turn", "is_follow_up", "query").collect()))
    for folder in ("one", "many"):
        got = entry.queries()["session_state"](spark, str(tmp_path / folder)).select("session_id", "turn", "is_follow_up", "query")
        assert sorted(map(tuple, got.collect())) == want
        windows = entry.queries()["session_windows"](spark, str(tmp_path / folder))
        assert windows.agg(F.sum("prompts")).first()[0] == 40
