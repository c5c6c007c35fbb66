"""Order-dependent operators against sequential folds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postlake.operators import budgets, cooldown
from postlake.operators.cooldown import with_accepted
from postlake.operators.ordered import carry_last, running_sum

T0 = dt.datetime(2024, 1, 1)


def test_carry_and_sum_across_chunks(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else "b", i // 5, i, rng.choice([None, None, i])) for i in range(120)]
    df = spark.createDataFrame(rows, "k STRING, chunk INT, o INT, v INT")
    last, total, want = {}, {}, {}
    for k, _, o, v in rows:
        prev = last.get(k)
        if v is not None:
            last[k] = v
        total[k] = total.get(k, 0) + 1
        want[o] = (last.get(k), prev, total[k] - 1)
    nxt, after = {}, {}
    for k, _, o, v in reversed(rows):
        if v is not None:
            nxt[k] = v
        after[o] = nxt.get(k)
    d = carry_last(df, ["k"], "chunk", ["o"], {"at": F.col("v")})
    d = carry_last(d, ["k"], "chunk", ["o"], {"before": F.col("v")}, strict=True)
    d = carry_last(d, ["k"], "chunk", ["o"], {"next": F.col("v")}, reverse=True)
    d = running_sum(d, ["k"], "chunk", ["o"], F.lit(1), "n", strict=True)
    for r in d.collect():
        assert (r["at"], r["before"], r["n"]) == want[r["o"]]
        assert r["next"] == after[r["o"]]


def test_cooldown_chain(spark):
    rng = random.Random(2)
    rows, t = [], T0
    for i in range(400):
        t += dt.timedelta(seconds=rng.choice([1, 5, 20, 20, 60, 400]))
        rows.append(("hot" if rng.random() < 0.8 else f"k{i % 3}", t, i))
    last, want = {}, {}
    for k, t, i in rows:
        ok = k not in last or (t - last[k]).total_seconds() >= 180
        want[i] = (ok, last.get(k))
        if ok:
            last[k] = t
    df = spark.createDataFrame(rows, "key STRING, ts TIMESTAMP_NTZ, id BIGINT")
    got = {r.id: (r.accepted, r.last_accepted_at) for r in with_accepted(df, "key", "ts", "id", F.lit(180)).collect()}
    assert got == want


@pytest.mark.parametrize(("chunk", "fan", "gaps"), [(1, 2, [1, 5, 20, 60, 400]), (2, 3, [90]), (1, 4, [0, 0, 1, 179, 180, 181]), (4, 2, [30_000, 100])])
def test_cooldown_over_many_chunks(spark, monkeypatch, chunk, fan, gaps):
    """Exit maps composed over several levels; regular gaps never let chains meet; null keys, null times and ties."""
    monkeypatch.setattr(cooldown, "CHUNK", chunk)
    monkeypatch.setattr(cooldown, "FAN", fan)
    rng = random.Random(chunk)
    rows, t = [], T0
    for i in range(600):
        t += dt.timedelta(seconds=rng.choice(gaps))
        rows.append((rng.choice(["hot", "hot", "hot", "b", None]), t, i, "x"))
    last, want = {}, {}
    for k, t, i, _ in rows:
        ok = k not in last or (t - last[k]).total_seconds() >= 180
        want[i] = (ok, last.get(k))
        if ok:
            last[k] = t
    rows += [("hot", None, 1000, "x"), (None, None, 1001, "x")]
    want |= {1000: (False, None), 1001: (False, None)}
    df = spark.createDataFrame(rows, "key STRING, ts TIMESTAMP_NTZ, id BIGINT, note STRING")
    out = with_accepted(df, "key", "ts", "id", F.lit(180))
    assert out.columns == [*df.columns, "accepted", "last_accepted_at"]
    assert {r.id: (r.accepted, r.last_accepted_at) for r in out.collect()} == want
    assert with_accepted(df.limit(0), "key", "ts", "id", F.lit(180)).collect() == []


def test_call_budget(spark):
    rng = random.Random(3)
    rows, t = [], T0
    for i in range(700):
        t += dt.timedelta(seconds=rng.choice([5, 30, 200, 900]))
        rows.append((i, t, rng.random() < 0.3))
    hour = day = None
    hc = dc = spare = 0
    want = {}
    for i, t, blocked in rows:
        h, d = (t.date(), t.hour), t.date()
        if h != hour:
            hour, hc = h, 0
        if d != day:
            day, dc = d, 0
        denied = "hourly" if hc >= 10 else "daily" if dc >= 60 else None
        if denied is None:
            hc, dc = hc + 1, dc + 1
        elif blocked and spare < 25:
            spare, denied = spare + 1, "reserve"
        want[i] = denied or "ok"
    df = spark.createDataFrame(rows, "call_id BIGINT, ts TIMESTAMP_NTZ, blocked BOOLEAN")
    got = {r.call_id: r.decision for r in budgets.call_budget(df, 10, 60, 25).collect()}
    assert got == want


def test_quota_denies_after_limit(spark):
    rows = [(i, "linkedin", T0 + dt.timedelta(minutes=i)) for i in range(152)] + [(500, "linkedin", T0 + dt.timedelta(days=1))]
    df = spark.createDataFrame(rows, "call_id BIGINT, source STRING, ts TIMESTAMP_NTZ")
    got = {r.call_id: (r.used_before, r.allowed) for r in budgets.quota_usage(df).collect()}
    assert got[149] == (149, True) and got[150] == (150, False) and got[151] == (150, False) and got[500] == (0, True)


def test_ranked_counts_over_all_ranges(spark):
    """Ties are broken by the last column; every row has its place in the whole order."""
    from postlake.operators.ordered import ranked

    df = spark.range(500, numPartitions=7).select("id", (F.col("id") % 3).alias("v"))
    got = {r.id: r["rank"] for r in ranked(df, [F.desc("v"), F.asc("id")]).collect()}
    want = sorted(range(500), key=lambda i: (-(i % 3), i))
    assert got == {i: n + 1 for n, i in enumerate(want)}
    assert ranked(df.where("id < 0"), [F.asc("id")]).count() == 0
