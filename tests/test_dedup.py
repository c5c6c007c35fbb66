"""Duplicate resolution against sequential models."""

import random

from postlake.functions.similarity import token_set_ratio_py as ratio
from postlake.functions.text import clean_for_match
from postlake.operators import dedup, merge


def _words(rng):
    base = ["acme", "globex", "initech", "umbrella", "soylent", "labs", "technologies", "global", "a", "of", "data"]
    out = []
    for _ in range(rng.choice([1, 1, 2, 2, 3, 4])):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w.insert(rng.randrange(len(w) + 1), rng.choice("abcxyz")) if rng.random() < 0.5 else (w.pop() if len(w) > 1 else None)
        out.append("".join(w))
    return " ".join(out)


def test_similar_pairs_lose_nothing(spark):
    rng = random.Random(11)
    names = sorted({_words(rng) for _ in range(260)})
    df = spark.createDataFrame([(s,) for s in names], "k STRING")
    for t in (90.0, 80.0):
        p = dedup.prepare_strings(df, "k", "k", t)
        got = {(r.k, r.k_b): round(r.ratio, 9) for r in dedup.similar_pairs(p, p, "k", "k", t).collect()}
        want = {(a, b): round(ratio(a, b), 9) for a in names for b in names if ratio(a, b) >= t}
        assert got == want


def test_ratio_model():
    assert ratio("senior python developer", "senior python developer") == 100
    assert ratio("acme", "acme labs") == 100
    assert ratio("", "acme") == 0
    assert abs(ratio("kitten", "sitting") - 100 * (1 - 5 / 13)) < 1e-9


def _clean(s):
    import re

    s = re.sub(r"[^\w\s]", " ", s.lower())
    for w, full in [("sr", "senior"), ("jr", "junior"), ("dev", "developer"), ("eng", "engineer"), ("mgr", "manager"),
                    ("inc", ""), ("corp", ""), ("llc", ""), ("ltd", ""), ("co", "")]:
        s = re.sub(rf"\b{w}\b", full, s)
    return " ".join(s.split())


def _sequential(stored, incoming):
    """Row-at-a-time model: earlier kept postings win."""
    match = lambda a, b: bool(a[1] and b[1]) and ratio(a[1], b[1]) >= 90 and ratio(a[0], b[0]) >= 88
    seen = [((_clean(t), _clean(c)), u) for _, u, c, t in stored]
    urls, known, out = set(), {r[1] for r in stored}, {}
    for o, u, c, t in incoming:
        parts = (_clean(t), _clean(c))
        if u in urls:
            out[o] = ("duplicate_url", None)
            continue
        if u not in known:
            hit = next((s for s in seen if match(parts, s[0])), None)
            if hit:
                out[o] = ("fuzzy", hit[1])
                continue
        out[o] = ("merge" if u in known else "kept", None)
        urls.add(u)
        seen.append((parts, None))
    return out


COLS = "ord BIGINT, apply_url STRING, company STRING, title STRING, posted_date TIMESTAMP_NTZ"


def _resolve(spark, stored, incoming):
    add = lambda rows: spark.createDataFrame([(*r, None) for r in rows], COLS)
    return {r.ord: (r.outcome, r.refresh_url) for r in dedup.resolve(add(stored), add(incoming)).collect()}


def test_resolve_matches_the_sequential_model(spark):
    rng = random.Random(5)
    companies = ["Acme Corp", "Acme", "ACME Inc", "Globex LLC", "Globex", "Acme Globex", "", "Initech", "Initechs"]
    titles = ["Senior Python Developer", "Sr Python Dev", "Python Developer", "Engineer", "Data Engineer", "Data Scientist", "Python Developers II", ""]
    row = lambda o, pool: (o, f"u{rng.randrange(pool)}", rng.choice(companies), rng.choice(titles))
    stored = [(i, f"u{i}", rng.choice(companies), rng.choice(titles)) for i in range(4)]
    incoming = [row(100 + i, 60) for i in range(90)]
    assert _resolve(spark, stored, incoming) == _sequential(stored, incoming)


def test_golden_dedup(spark):
    one = lambda rows: {o: v[0] for o, v in _resolve(spark, [(0, "s", "Zeta", "Nurse")], rows).items()}
    assert one([(1, "u", "Acme", "A role"), (2, "u", "Globex", "B role")]) == {1: "kept", 2: "duplicate_url"}
    assert one([(1, "a", "Acme Corp", "Senior Python Developer"), (2, "b", "Acme Corp Inc", "Sr Python Dev")]) == {1: "kept", 2: "fuzzy"}
    assert one([(1, "a", "Acme", "Python Developer"), (2, "b", "Globex", "Python Developer")]) == {1: "kept", 2: "kept"}
    assert one([(1, "a", "", "Python Developer"), (2, "b", "", "Python Developer")]) == {1: "kept", 2: "kept"}
    chain = [(1, "a", "Acme", "data engineer"), (2, "b", "Acme", "engineer"), (3, "c", "Acme", "network engineer")]
    assert one(chain) == {1: "kept", 2: "fuzzy", 3: "kept"}  # greedy, not transitive


def test_hash_dedup_chain(spark):
    """A row dropped by URL leaves no hash behind; a stored row shadows later copies."""
    cols = "ord BIGINT, id STRING, title STRING, apply_url STRING, raw_hash STRING"
    new = spark.createDataFrame(
        [(1, "1", "t", "u1", "h1"), (2, "2", "t", "u1", "h2"), (3, "3", "t", "u3", "h2"), (4, "4", "t", "s", "h4"),
         (5, "5", "t", "u5", "h4"), (6, "6", "", "u6", "h6")], cols)
    old = spark.createDataFrame([("s", "hs")], "apply_url STRING, raw_hash STRING")
    assert sorted(r.ord for r in merge.insert_hash_dedup(old, new).collect()) == [1, 3]


def test_clean_for_match(one):
    assert one(clean_for_match, x="Sr. Python Dev @ Acme, Inc.") == "senior python developer acme"


def test_greedy_keep_hot_group(spark):
    """One URL and one signature hold most rows; the first of each survives."""
    rows = [(i, "u" if i % 3 else f"v{i}", "s" if i % 2 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "ord BIGINT, url STRING, sig STRING")
    edges = spark.createDataFrame([("s", "s")], "sig_a STRING, sig_b STRING")
    seen_u, seen_s, want = set(), False, []
    for o, u, s in rows:
        if u in seen_u or (s and seen_s):
            continue
        seen_u.add(u)
        seen_s = seen_s or bool(s)
        want.append(o)
    got = dedup.greedy_keep(df, "ord", ["url"], edges).select("ord").collect()
    assert sorted(r.ord for r in got) == want
