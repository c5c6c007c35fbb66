"""Every operator on awkward tables and against brute force on small ones."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, n INT, row STRING, th STRING, size STRING, target STRING, spans STRING"


def table(spark, texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["b", "a", None, "c"]
    return spark.createDataFrame([(i, t, "en", sources[k % 4], None if t is None else len(t), 1, "r", "t", "s", "g", "p") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOC)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(f"x{i}" for i in range(30_000))
ODD = [None, "", " \t\n ", "one", "two words", LONG, "zzz" * 40_000]


@pytest.fixture(scope="module")
def near(spark):
    """Copies, near copies, unrelated texts and odd ones; doc_id null and repeated rows too."""
    rng = random.Random(3)
    texts = list(ODD)
    for _ in range(12):
        base = sentence(rng, 120).split()
        texts += [" ".join(base)] * 2
        for _ in range(3):
            changed = list(base)
            changed[rng.randrange(120)] = "changed"
            texts.append(" ".join(changed))
        texts.append(" ".join(base[:60]) + " " + sentence(rng, 60))
    ids = list(range(len(texts)))
    texts += [texts[8], texts[8], sentence(rng, 30)]
    ids += [8, None, None]
    return ids, texts


def shingles(text):
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(ids, texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, d in enumerate(ids):
        group = [ids[j] for j in range(len(ids)) if label[j] == label[i] and ids[j] is not None]
        out.append((d, len(sets[i]), min(group) if group else None))
    return out


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_jaccard_components_equal_brute_force(spark, near):
    from llm.jaccard_join import jaccard_components, keep_one

    ids, texts = near
    docs = table(spark, texts, ids)
    assert rows(jaccard_components(docs), "doc_id", "n_shingles", "component_id") == sorted(brute_components(ids, texts), key=repr)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = Counter(d for d, _, c in set(brute_components(ids, texts)) if d is None or d == c)
    want[None] = 2
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    assert jaccard_components(docs.limit(0)).count() == 0


def test_large_buckets_go_through_the_tree(spark, monkeypatch):
    """Many texts around one passage: buckets of more than a leaf, with links that only the tree finds."""
    import llm.jaccard_join as j

    rng = random.Random(5)
    passage = sentence(rng, 60)
    texts = [passage + " " + sentence(rng, rng.choice([4, 8, 12, 20])) for _ in range(150)]
    ids = list(range(150))
    got = rows(j.jaccard_components(table(spark, texts, ids)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute_components(ids, texts), key=repr)


def test_the_commonest_shingles_are_no_routes(spark):
    """400 texts of one common passage and one of 20 texts, nothing rare: all meet by the lesser one."""
    from llm.jaccard_join import nodes_of

    passage = lambda k: " ".join(f"p{k}x{i}" for i in range(12))
    docs = table(spark, [f"{passage('all')} {passage(i // 20)}" for i in range(400)]).select("doc_id", "text").withColumn("th", F.col("doc_id"))
    keys = nodes_of(docs).select("sid", F.explode("keys").alias("key")).groupBy("key").agg(F.countDistinct("sid").alias("n"))
    assert keys.agg(F.max("n")).first()[0] == 1  # the 20 texts are one set


def test_packed_blocks_lose_no_pair(monkeypatch):
    """Buckets of many blocks, packed from small batches: blocks joined with themselves and with each other give every pair the bounds allow."""
    import llm.jaccard_join as j

    monkeypatch.setattr(j, "BLOCK", 16)
    monkeypatch.setattr(j, "LEAF", 4)
    rng = np.random.default_rng(3)
    families = [np.unique(rng.integers(0, 2**63, 80).astype(np.uint64)) for _ in range(4)]
    sets = [np.unique(np.concatenate([f[rng.random(len(f)) < 0.93], rng.integers(0, 2**63, 4).astype(np.uint64)])) for f in families for _ in range(25)]
    label = rng.integers(0, 9, len(sets))
    rows_ = sorted((1, int(label[i]), len(s), i, j.point(s)) for i, s in enumerate(sets))
    frame = pd.DataFrame(rows_, columns=["key", "label", "n", "sid", "point"])
    out = pd.concat(j._pack(iter([frame[k : k + 7] for k in range(0, len(frame), 7)]), 75, True))
    found = set(zip(out.loc[out["kind"] == 0, "a"], out.loc[out["kind"] == 0, "b"], strict=True))
    members = out[out["kind"] == 3].groupby("a")["b"].apply(list).to_dict()
    boxes = out[out["kind"] == 2].set_index("a")
    assert len(members) == -(-len(sets) // 16) and sorted(x for m in members.values() for x in m) == list(range(len(sets)))
    block = {k: j.Block(m, [len(sets[i]) for i in m], label[m], [j.point(sets[i]) for i in m]) for k, m in members.items()}
    for a in members:
        for b in members:
            if a < b:
                pairs, cut = j.tree_join(block[a], block[b])
                assert not cut
                sum_ = np.minimum(*(np.frombuffer(boxes["box"][k], np.int32) for k in (a, b))).sum()
                assert not len(pairs) or j.fits(sum_, boxes["least"][a], boxes["least"][b])
                found |= set(map(tuple, pairs.tolist()))
    true = {
        (a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
        if label[a] != label[b] and j.fits(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
    }
    assert true and true <= found
    assert len(found) < 2 * len(true) + 50


def test_likeliest_pairs_say_when_others_are_left_out():
    import llm.jaccard_join as j

    s = np.unique(np.random.default_rng(4).integers(0, 2**63, 50).astype(np.uint64))
    block = j.Block([1, 2, 3], [len(s)] * 3, [7, 8, 8], [j.point(s)] * 3)
    pairs, cut = j.tree_join(block, block, every=False)
    assert cut and (1, 2) in set(map(tuple, pairs.tolist()))
    pairs, cut = j.tree_join(block, block)
    assert not cut and set(map(tuple, pairs.tolist())) == {(1, 2), (1, 3)}


def test_overlap_bound_is_an_upper_bound():
    from llm.jaccard_join import overlap_bound, point

    rng = np.random.default_rng(1)
    for _ in range(30):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        y = np.unique(np.concatenate([x[: len(x) // 2], rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)]))
        assert overlap_bound([point(x)], [point(y)])[0] >= len(np.intersect1d(x, y))


def test_points_are_short_and_keep_their_counts():
    """A byte for each count was several times as long as the counts are."""
    from llm.jaccard_join import groups_for, point, unpack

    rng = np.random.default_rng(6)
    for n in (1, 40, 70, 900, 3000, 15_000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        g = groups_for(n)
        counts = np.bincount((s >> np.uint64(40)).astype(np.int64) & (g - 1), minlength=g)
        assert (unpack([point(s), point(s)]) == counts).all() and len(point(s)) <= 1 + g // 8 * int(counts.max()).bit_length()
        assert len(point(s)) < 0.55 * g or n > 2048
    assert groups_for(15_000) == 2048
    assert point(np.arange(300, dtype=np.uint64)) == b""  # one group counts 300


def test_size_classes_of_linked_sets_are_neighbours(spark):
    import llm.jaccard_join as j

    sizes = spark.range(1, 4000).select(F.col("id").cast("int").alias("n"))
    for percent in (75, 90, 100):
        c = {r["n"]: r["c"] for r in sizes.select("n", j._size_class(F.col("n"), percent).alias("c")).collect()}
        assert all(0 <= c[100 * n // percent] - c[n] <= 1 for n in c if 100 * n // percent in c)


def test_very_large_buckets_meet_more_than_one_head(monkeypatch):
    """Half of a bucket is near none but the second member: the links to it are found without the tree."""
    import llm.jaccard_join as j

    monkeypatch.setattr(j, "LEAF", 3)
    for block in (8, 100):
        monkeypatch.setattr(j, "BLOCK", block)
        frame = pd.DataFrame({"key": [5] * 20 + [6] * 2, "sid": [*range(20), 3, 4], "n": [10] * 22, "before": [0] * 22})
        out = pd.concat(j._meet(iter([frame[k : k + 6] for k in range(0, 22, 6)]), 75))
        found = list(zip(out["a"][out["kind"] == 0], out["b"][out["kind"] == 0], strict=True))
        heads = j.HEADS if block == 8 else 1
        want = [(a, b) for a in range(heads) for b in range(a + 1, 20)]
        assert sorted(set(found)) == sorted({*want, (3, 4)}) and (out["kind"] == 1).sum() == 20


def test_a_pair_of_many_buckets_is_told_once_a_task():
    import llm.jaccard_join as j

    s = np.unique(np.random.default_rng(4).integers(0, 2**63, 50).astype(np.uint64))
    frame = pd.DataFrame([(k, i, len(s), i, j.point(s), False) for k in range(30) for i in (1, 2)], columns=["key", "label", "n", "sid", "point", "many"])
    out = pd.concat(j._pack(iter([frame]), 75, True))
    assert out[["kind", "a", "b"]].to_numpy().tolist() == [[0, 1, 2]]


def test_unlike_sizes_do_not_crowd_a_bucket():
    """A bucket of 120 sets, none with more than six of a size that fits: all of them were members of a large bucket."""
    import llm.jaccard_join as j

    n = [int(200 * 1.05**i) for i in range(120)]
    frame = pd.DataFrame({"key": 5, "sid": range(120), "n": n, "before": 0})
    out = pd.concat(j._meet(iter([frame[k : k + 7] for k in range(0, 120, 7)]), 75))
    assert (out["kind"] == 0).all()
    assert set(zip(out["a"], out["b"], strict=True)) == {(a, b) for b in range(120) for a in range(b) if j.fits(n[a], n[a], n[b])}


def test_every_fitting_pair_of_a_bucket_meets(monkeypatch):
    """As a pair, as two members, or in the bucket of the common key that both have before."""
    import llm.jaccard_join as j

    monkeypatch.setattr(j, "LEAF", 4)
    monkeypatch.setattr(j, "BLOCK", 12)
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"key": rng.integers(0, 5, 300), "sid": rng.integers(0, 250, 300)})
    frame["n"] = (20 * 1.3 ** (frame["sid"] % 23)).astype(int)
    frame["before"] = rng.choice([0, 8, 9], 300)
    frame = frame.sort_values(["key", "n", "sid"]).drop_duplicates(["key", "sid"])
    out = pd.concat(j._meet(iter([frame[k : k + 11] for k in range(0, len(frame), 11)]), 75))
    pairs = set(zip(out["a"][out["kind"] == 0], out["b"][out["kind"] == 0], strict=True))
    members = set(zip(out["a"][out["kind"] == 1], out["b"][out["kind"] == 1], strict=True))
    assert pairs and members and len(members) < len(frame)
    for k, g in frame.groupby("key"):
        rows_ = list(zip(g["sid"], g["n"], g["before"], strict=True))
        for i, (a, na, pa) in enumerate(rows_):
            for b, nb, pb in rows_[:i]:
                if j.fits(min(na, nb), na, nb) and not (pa and pa == pb):
                    assert (min(a, b), max(a, b)) in pairs or {(k, a), (k, b)} <= members


def test_blocks_are_full_whatever_the_number_of_tasks(spark, monkeypatch):
    """A large bucket over many tasks became a block a task, so the rows that blocks of it exchange grew with the tasks."""
    import llm.jaccard_join as j

    monkeypatch.setattr(j, "BLOCK", 16)
    rows_ = spark.range(105).select(F.when(F.col("id") < 100, 1).otherwise(2).alias("key"), F.col("id").alias("sid"), F.col("id").alias("label"), F.lit(9).alias("n"), (F.col("id") % 3).alias("class"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        got = j._blocks(rows_).groupBy("key", "many", "block").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r["key"], r["many"], r["block"], r["count"]) for r in got) == [*((1, True, k, 16) for k in range(6)), (1, True, 6, 4), (2, False, 0, 5)]


def test_stages_set_small_batches_themselves(spark, monkeypatch):
    """A stage that is called without ``run`` has its Python steps in small batches too."""
    import corpus_pipeline as p
    from llm.steps import BATCH_BYTES

    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    for step in ("keep_clean", "keep_one", "clean"):
        monkeypatch.setattr(p, step, lambda docs, *_: seen.append(int(spark.conf.get(name))) or docs)
    for _, stage in p.STAGES[:3]:
        stage(spark, spark.range(1), SF)
    assert seen == [BATCH_BYTES] * 3 and spark.conf.get(name) == before


KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m.group())
            ok = {0: True, 1: all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else False, 2: 14 <= len(d) <= 19 and luhn(d), 3: 10 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


PII = [
    "mail a.b@c.de_f@g.hi and x@y.z, ñandú é 😀 q@w.er", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 1.1.1.256", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (262) 555-3752",
    "+1 (568) 555-6437 4918187128635271 x", "a@b.c@d.e..f@g", "@@@ +++ 1..2 +1( +(", "9" * 5000, "a." * 5000 + "@b.c", "+1 22 33 44 55 66 77 88 99 00 11 22 4111111111111111", "john (at) example (dot) com call 262-555-3752 ssn 123-45-6789",
]


def test_personal_data_base_spans_equal_the_patterns(spark):
    from llm.personal_data import find, redact

    texts = ODD[:5] + PII + [PII[0]]
    docs = table(spark, texts)
    for r in find(docs).collect():
        spans = base_spans(texts[r["doc_id"]])
        listed = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x == i for _, x, _ in spans) for i in range(4)]
        assert set(listed) <= set(r["spans"].split(",")) | {""}
    cleaned = redact(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(texts)
    by = {r["doc_id"]: r for r in cleaned.collect()}
    assert by[0]["text"] is None and by[1]["text"] == ""
    assert by[8]["text"] == "[PHONE]" and by[8]["n_chars"] == 7
    assert "@y.z" not in by[5]["text"] and "😀" in by[5]["text"]
    assert find(docs.limit(0)).count() == 0 and redact(docs.limit(0)).count() == 0


def test_em_finds_the_reliable_labelers():
    from llm.personal_data import reliabilities

    rng = np.random.default_rng(0)
    real = rng.random(4000) < 0.6
    good = np.where(rng.random((4000, 4)) < 0.9, real[:, None], ~real[:, None])
    noise = rng.random((4000, 3)) < 0.5
    votes = np.where(np.hstack([good, noise]), 1, -1)
    q, tables = reliabilities(votes, np.ones(4000))
    assert ((q > 0.5) == real).mean() > 0.95
    assert (tables[:4, 2, 1] > 0.85).all() and (abs(tables[4:, 2, 1] - 0.5) < 0.1).all()


def test_quality_measurements_equal_brute_force(spark):
    from llm.quality_rules import BIT, ablation, apply_policy, ledger

    rng = random.Random(1)
    texts = [*ODD[:5], "a b c d e f g h a b c d e f g h", "the the " * 40, "#$% && ||", sentence(rng, 100), "x\ny\nx\n\n \n \nx", "ABC! " * 30, sentence(rng, 30) + "\n" + sentence(rng, 30)]
    texts.append(texts[-1])
    entries = apply_policy(ledger(table(spark, texts)))
    for r in entries.collect():
        t = texts[r["doc_id"]] or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)), t[:40]
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in entries.where("kept").collect()}
    assert texts.index(texts[-1]) in kept
    found = {r["rule"]: r for r in ablation(entries).collect()}
    bits = [r["bits"] for r in entries.collect()]
    assert found["few_words"]["failed"] == sum(b >> BIT["few_words"] & 1 for b in bits)
    assert found["few_words"]["only_here"] == sum(b == 1 << BIT["few_words"] for b in bits) or found["few_words"]["only_here"] >= 1


def test_decontamination_finds_planted_passages_only(spark):
    from llm.decontaminate import clean, overlaps

    rng = random.Random(2)
    items = [sentence(rng, 40) for _ in range(6)] + [None, "", "too short", "seven words make a short item here", LONG[:600]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id BIGINT, text STRING")
    changed = items[1].split()
    changed[5], changed[17], changed[29] = "aa", "bb", "cc"
    texts = [
        *ODD[:5], sentence(rng, 50) + " " + items[0] + " " + sentence(rng, 50), sentence(rng, 20) + " " + " ".join(changed), items[2].upper(),
        " ".join(items[3].split()[10:30]), sentence(rng, 300), "so seven words make a short item here it is", items[0], LONG,
    ]
    texts.append(texts[5])
    docs = table(spark, texts, [*range(len(texts) - 1), 5])
    got = rows(overlaps(docs, bench), "doc_id", "item_id")
    assert got == [(10, 9), (11, 0), (12, 10), (5, 0), (5, 0), (6, 1), (7, 2), (8, 3)]
    kept = clean(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 9] and kept.columns == docs.columns
    assert overlaps(docs, bench.limit(0)).count() == 0 and overlaps(docs.limit(0), bench).count() == 0


def test_short_items_with_replaced_words_are_found(spark):
    """Items of 5 to 9 words, every choice of words replaced: found where FULL of the item agrees, and only there."""
    from itertools import combinations

    from llm.decontaminate import FULL, MIN_ITEM, clean, overlaps

    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(3, 10)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id BIGINT, text STRING")
    texts, want = [], set()
    for n, w in items.items():
        for gone in (g for k in range(4) for g in combinations(range(n), k)):
            for before, after in (("", ""), ("so it was ", " and more")):
                if n - len(gone) >= max(MIN_ITEM, FULL * n):
                    want.add((len(texts), n))
                texts.append(before + " ".join("other" if k in gone else x for k, x in enumerate(w)) + after)
    texts += [" ".join(items[9][2:]), " ".join(items[9][:7]), " ".join(items[9][3:])]
    want |= {(len(texts) - 3, 9), (len(texts) - 2, 9)}
    docs = table(spark, texts)
    assert set(rows(overlaps(docs, bench), "doc_id", "item_id")) == want
    assert clean(docs, bench).count() == len(texts) - len(want)


def test_toxicity_on_held_out_rows_and_odd_texts(spark):
    from llm.toxicity import keep_clean, score, train

    rng = random.Random(4)
    texts = [". ".join(sentence(rng, 12) for _ in range(6)) for _ in range(600)]
    toxic = [rng.random() < 0.3 for _ in texts]
    bad = ["scoundrel", "villainous"]
    texts = [t + f" you {rng.choice(bad)} fool. " + sentence(rng, 5) if y else t for t, y in zip(texts, toxic, strict=True)]
    docs = table(spark, [*texts, None, "", LONG, texts[0]], [*range(600), 600, 601, 602, None])
    labels = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic)] + [(None, 1, 1), (5, 1, None)], "doc_id BIGINT, quality INT, toxic INT")
    model = train(docs, labels)
    got = {r["doc_id"]: r for r in score(docs, model).collect()}
    held = [i for i in range(600) if got[i]["held_out"]]
    assert 80 < len(held) < 220 and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[i]["predicted"] == toxic[i] for i in held]) > 0.95
    assert got[600]["score"] == 0 and got[601]["score"] == 0 and got[602]["predicted"] == 0
    located = [i for i in held if toxic[i] and got[i]["predicted"]]
    assert np.mean([got[i]["worst_sentence"] in (5, 6) for i in located]) > 0.9
    kept = keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 1
    assert score(docs, train(docs, labels.limit(0))).where("score > 0").count() == 0
    assert score(docs.limit(0), model).count() == 0


def test_toxicity_ignores_held_out_labels(spark):
    from llm.toxicity import held_out, train

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = train(docs, labels), train(docs, turned)
    assert np.array_equal(a[0], b[0]) and np.allclose(a[1], b[1])


def test_warc_round_trip_and_damage(spark, tmp_path):
    from llm.warc_archive import _record, parse_record, read_archives, round_trip, write_archives

    html = [None, "", "short", "short", "é" * 60, "é" * 60, "é" * 60, "<p>\r\n\r\n</p>" * 20_000, "x" * 99, "x" * 99]
    ids = [9, 8, 7, 6, 5, 3, 4, 2, 1, 0]
    pages = spark.createDataFrame([(i, "http://a/\r\nb é", h, "x") for i, h in zip(ids, html, strict=True)] + [(3, "u", "é" * 60, "x"), (None, None, "é" * 60, "x")], "page_id BIGINT, url STRING, html STRING, payload STRING")
    got = rows(round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, h in [*zip(ids, html, strict=True), (3, "é" * 60), (None, "é" * 60)]:
        b = (h or "").encode()
        revisit = h == "é" * 60 and i != 3
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=repr)
    folder = f"file://{tmp_path}/warc"
    write_archives(pages, folder)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in read_archives(spark, folder).where("record_type = 'response'").collect()}
    assert payloads[2].decode() == html[7] and payloads[9] == b""
    assert round_trip(pages.limit(0)).count() == 0
    record = _record(1, "http://a", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert parse_record(record)["payload"] == b"abc"
    for broken in (record.replace(b"abc", b"abd"), record[:-1], record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(ValueError):
            parse_record(broken)


def test_mixing_meets_targets(spark):
    from llm.mixing import mix, mixture

    rng = random.Random(6)
    texts = [sentence(rng, rng.randrange(1, 60)) for _ in range(800)] + [None, "", texts_same := "a b c", texts_same]
    docs = table(spark, texts)
    got = mix(docs).toPandas()
    sizes = [len(WORD.findall(t or "")) for t in texts]
    assert sorted(got["size"]) == sorted(sizes) and len(got) == len(texts)
    source = {k: ["b", "a", None, "c"][k % 4] for k in range(len(texts))}
    per = Counter()
    for k, n in enumerate(sizes):
        per[source[k]] += n
    weight = {"a": 5, "b": 2, "c": 1, None: 5}
    total, targets, fixed = sum(sizes), {}, set()
    while True:  # the rule as stated
        share = (total - sum(3 * per[s] for s in fixed)) / sum(w for s, w in weight.items() if s not in fixed)
        targets = {s: 3 * per[s] if s in fixed else weight[s] * share for s in per}
        over = {s for s in per if s not in fixed and targets[s] > 3 * per[s]}
        if not over:
            break
        fixed |= over
    taken = Counter()
    for r in got.itertuples():
        assert r.target == pytest.approx(targets[source[r.doc_id]]) and r.source_size == per[source[r.doc_id]]
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.01 * targets[s] for s in per)
    again = mix(docs.repartition(7)).toPandas()
    assert sorted(zip(got.doc_id, got.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))
    out = mixture(docs)
    assert out.columns == [*docs.columns, "copies", "taken"] and out.agg(F.sum("taken")).first()[0] == sum(taken.values())
    assert mix(docs.limit(0)).count() == 0


def _written(monkeypatch, module):
    """The columns of every table that the module's steps write between."""
    seen = []
    real = module.cut_lineage

    def cut(df):
        seen.append(df.schema.simpleString())
        return real(df)

    monkeypatch.setattr(module, "cut_lineage", cut)
    return seen


def test_mixing_and_redaction_write_no_texts_between(spark, monkeypatch):
    """The mix wrote whole rows twice and sorted them, the redaction wrote each text twice beside its spans."""
    import llm.mixing
    import llm.personal_data

    rng = random.Random(8)
    docs = table(spark, [sentence(rng, rng.randrange(1, 60)) + " +49 30 1234567 12" for _ in range(60)])
    for module, stage in ((llm.mixing, llm.mixing.mixture), (llm.personal_data, llm.personal_data.redact)):
        seen = _written(monkeypatch, module)
        assert stage(docs).count() <= 60
        assert not [x for x in seen if "text:" in x]


def test_mixing_deals_copies_to_equal_rows_each(spark):
    """Rows that are equal, share an id, or have none: as many rows with as many copies as the mix by itself has."""
    from llm.mixing import mix, mixture

    rng = random.Random(9)
    texts = [sentence(rng, rng.randrange(5, 40)) for _ in range(120)]
    ids = list(range(120))
    texts += texts[:40] * 3 + [sentence(rng, 7) for _ in range(8)] + ["same text"] * 6
    ids += ids[:40] * 3 + [3] * 4 + [None] * 10
    docs = table(spark, texts, ids)
    want = Counter((r["doc_id"], r["size"], r["copies"], r["taken"]) for r in mix(docs).collect() if r["copies"] > 0)
    out = mixture(docs)
    assert out.columns == [*docs.columns, "copies", "taken"]
    got = out.collect()
    assert Counter((r["doc_id"], len(WORD.findall(r["text"])), r["copies"], r["taken"]) for r in got) == want
    have = Counter(zip(ids, texts, strict=True))
    assert all(n <= have[k] for k, n in Counter((r["doc_id"], r["text"]) for r in got).items())


def test_blocks_leave_pairs_with_one_common_key_before_to_that_key():
    """In a bucket, two nodes with the same common key before it meet in that key's bucket; 0 stands for none."""
    import llm.jaccard_join as j

    sets = np.arange(1, 61, dtype=np.uint64) << np.uint64(40)
    n = 2 * j.LEAF
    before = [7] * j.LEAF + [8, 0] * (j.LEAF // 2)
    block = j.Block(list(range(n)), [len(sets)] * n, list(range(n)), [j.point(sets)] * n, before)
    pairs, cut = j.tree_join(block, block)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if before[a] != before[b] or before[a] == 0}
    assert {tuple(p) for p in pairs.tolist()} == want and not cut
    frame = pd.DataFrame({"key": 9, "label": range(n), "n": len(sets), "sid": range(n), "point": [j.point(sets)] * n, "many": False, "before": before})
    out = pd.concat(j._pack(iter([frame]), 75, True))
    assert {(r.a, r.b) for r in out[out["kind"] == 0].itertuples()} == want


def test_the_sample_that_orders_shingles_grows_with_the_input(spark, monkeypatch):
    """A line in one of 20 documents counts as common, however many documents there are; components stay the same."""
    import llm.jaccard_join as j

    monkeypatch.setattr(j, "SAMPLE_DOCS", 20)
    texts = [" ".join(f"c{k}" for k in range(12)) if i % 20 == 0 else " ".join(f"r{i}x{k}" for k in range(12)) for i in range(4000)]
    texts = [f"{t} {i}" for i, t in enumerate(texts)]
    docs = table(spark, texts).select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    levels = np.frombuffer(j._common(docs), np.uint8)
    levels = np.stack([levels & 15, levels >> 4], axis=1).ravel()
    at = lambda i: levels[(next(j.shingle_sets(*j.word_hashes([texts[i]]), 5)) & np.uint64(len(levels) - 1)).astype(np.int64)]
    assert len(levels) > 1 << j._COMMON_BITS and (at(0) > 0).sum() == 8 and not at(1).any()


def test_passages_across_documents(spark):
    from llm.passage_chains import passages

    rng = random.Random(7)
    passage = sentence(rng, 70).split()
    fuzzy = list(passage)
    fuzzy[20] = "other"
    del fuzzy[45]
    texts = [*ODD[:5], *(sentence(rng, 80) + " " + " ".join(p) + " " + sentence(rng, 80) for p in (passage, passage, fuzzy)), sentence(rng, 200), " ".join(passage[:40]) + " " + sentence(rng, 90)]
    copy = sentence(rng, 90)
    texts += [copy, copy, LONG]
    docs = table(spark, texts)
    got = passages(docs).collect()
    assert {r["doc_id"] for r in got} | {r["other_doc_id"] for r in got} == {5, 6, 7, 10, 11}
    for r in got:
        a, b = WORD.findall(texts[r["doc_id"]]), WORD.findall(texts[r["other_doc_id"]])
        x, y = a[r["start_word"] : r["end_word"]], b[r["other_start"] : r["other_end"]]
        assert min(len(x), len(y)) >= 50 and len(set(x) & set(y)) >= 0.8 * len(set(x)) and r["agree"] <= min(len(x), len(y))
        if not r["copy"]:
            assert abs(r["start_word"] - 80) <= 3 and abs(r["end_word"] - 150) <= 3
    assert passages(docs.limit(0)).count() == 0


def test_a_passage_is_found_beside_a_further_phrase(spark):
    """One chain holds an exact passage, differing words and a shared phrase, so the chain as a whole agrees too little."""
    from llm.passage_chains import passages

    rng = random.Random(11)
    fresh = (f"u{i}" for i in range(100_000))
    new = lambda n: " ".join(next(fresh) for _ in range(n))
    texts = []
    for _ in range(40):
        passage, phrase = new(60), new(rng.choice([10, 12, 14]))
        texts += [f"{new(50)} {passage} {new(25)} {phrase} {new(50)}" for _ in range(2)]
    got = [r for r in passages(table(spark, texts)).collect() if r["start_word"] == 50 and r["end_word"] == 110 and r["agree"] == 60]
    assert len({r["doc_id"] // 2 for r in got}) == 40


def test_passages_with_substituted_words_are_found(spark):
    """Every 10th word replaced (90 % agree), and 60 words of lines that also stand in other texts."""
    from llm.passage_chains import passages

    fresh = (f"v{i}" for i in range(100_000))
    new = lambda n: [next(fresh) for _ in range(n)]
    texts = []
    for _ in range(40):
        passage = new(60)
        texts += [" ".join([*new(50), *passage, *new(50)]), " ".join([*new(50), *(next(fresh) if i % 10 == 5 else w for i, w in enumerate(passage)), *new(50)])]
    lines = [new(12) for _ in range(5)]
    texts += [" ".join([*new(40), *line, *new(40)]) for line in lines] + [" ".join([*new(40), *sum(lines, []), *new(40)]) for _ in range(2)]
    pairs = {(min(r["doc_id"], r["other_doc_id"]), max(r["doc_id"], r["other_doc_id"])) for r in passages(table(spark, texts)).collect()}
    assert pairs == {(2 * i, 2 * i + 1) for i in range(40)} | {(85, 86)}


def test_every_exact_repeat_is_in_a_passage(spark):
    """Repeats of 50 words of which every part stands in other texts too, and texts that repeat a word or two, by brute force."""
    from llm.passage_chains import MIN_WORDS, passages

    rng = random.Random(29)
    fresh = (f"e{i}" for i in range(100_000))
    new = lambda n: [next(fresh) for _ in range(n)]
    texts = []
    for _ in range(25):
        passage = new(51)
        texts += [[*new(30), *passage[k : k + 40], *new(30)] for k in (0, 4, 8, 11) for _ in range(3)] + [[*new(30), *passage, *new(30)] for _ in range(2)]
    for _ in range(40):
        texts.append([*new(20), *sum(([rng.choice(["the", "be"])] * rng.choice([10, 48, 60, 150]) for _ in range(4)), []), *new(5), *["a", "b"] * rng.choice([20, 30, 60])])
    rows = passages(table(spark, [" ".join(t) for t in texts])).collect()
    held = [np.zeros(len(t), dtype=bool) for t in texts]
    for r in rows:
        held[r["doc_id"]][r["start_word"] : r["end_word"]] = True
        held[r["other_doc_id"]][r["other_start"] : r["other_end"]] = True
    where = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - MIN_WORDS + 1):
            where.setdefault(tuple(t[i : i + MIN_WORDS]), set()).add((k, i))
    repeats = [place for places in where.values() if len({k for k, _ in places}) > 1 for place in places]
    assert len({k for k, _ in repeats}) == 90 and all(held[k][i : i + MIN_WORDS].all() for k, i in repeats)


def test_stretches_of_an_alignment():
    from llm.passage_chains import stretches

    edges = lambda ok: (np.arange(len(ok) + 1), np.arange(len(ok) + 1), np.array(ok), 0, len(ok))
    same, other = [True], [False]
    assert list(stretches(*edges(same * 60 + other * 10 + same * 60))) == [(0, 130)]
    assert sorted(stretches(*edges(same * 60 + other * 40 + same * 55))) == [(0, 60), (100, 155)]
    assert list(stretches(*edges(same * 49 + other * 40 + same * 20))) == []
    assert list(stretches(*edges((other * 1 + same * 4) * 10 + other * 60))) == [(0, 50)]


def test_chain_equals_quadratic_program():
    from llm.passage_chains import GAP_COST, K, chain

    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 30))
        pairs = np.unique(rng.integers(0, 40, (n, 2)), axis=0)
        x, y = pairs[:, 0], pairs[:, 1]
        best = []
        for i in range(len(x)):
            gains = [best[j] - GAP_COST * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            best.append(K + max([0.0, *gains]))
        first = chain(x, y)[0]
        got = K * len(first) - GAP_COST * (x[first[-1]] - x[first[0]] + y[first[-1]] - y[first[0]])
        assert (np.diff(x[first]) > 0).all() and (np.diff(y[first]) > 0).all()
        assert got == pytest.approx(max(best)) or len(first) == len(x)


def test_license_scan(spark):
    from llm.licenses import CONTAINED, GATES, SHINGLE, TEMPLATES, bands_for, scan

    for parts in TEMPLATES.values():  # no match can lack a gate word
        for t in parts:
            w = re.findall(r"[^\W_]+", t.lower())
            open_ = [i for i in range(len(w) - SHINGLE + 1) if not any(g in " ".join(w[i : i + SHINGLE]) for g in GATES)]
            text_has = any(g in " ".join(w) for g in GATES)
            assert text_has and len(open_) < CONTAINED * (len(w) - SHINGLE + 1)
    assert (1 - 0.5) ** bands_for(0.5, 1e-4) <= 1e-4
    rng = random.Random(8)
    texts = [*ODD]
    want = set()
    for name, parts in TEMPLATES.items():
        for t in parts:
            texts.append(sentence(rng, rng.randrange(0, 90)) + ". " + t + " " + sentence(rng, 40))
            want.add((len(texts) - 1, name))
    texts += ["a license is a permission", sentence(rng, 100)]
    got = {(r["doc_id"], r["license"]) for r in scan(table(spark, texts)).collect()}
    assert want <= got and {d for d, _ in got} == {d for d, _ in want}
    assert scan(table(spark, texts).limit(0)).count() == 0


def test_bands_keep_the_stated_miss_for_every_template():
    from llm.licenses import BANDS, CONTAINED, MISS, SHINGLE, TEMPLATES, template_words, window_class

    for text in (t for texts in TEMPLATES.values() for t in texts):
        w = template_words(text)
        grams = {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
        # every window with a share CONTAINED of the template, the rest of it other words
        window = window_class(text) * 3 // 2 - SHINGLE + 1
        for shared in range(len(grams) + 1):
            if shared >= CONTAINED * len(grams):
                assert (1 - shared / (window + len(grams) - shared)) ** BANDS <= MISS


def test_license_gate_loses_no_match(spark):
    from llm.licenses import CONTAINED, TEMPLATES, gates_of, lacking, scan, window_class

    for parts in TEMPLATES.values():
        for t in parts:
            assert lacking(t, set(gates_of(window_class(t)))) < CONTAINED, t
    texts = ["Available under CC BY-NC 4.0.", "So it is:\nis available under CC\nBY-SA 4.0, as said", "nothing of the kind"]
    got = {(r["doc_id"], r["license"]) for r in scan(table(spark, texts)).collect()}
    assert got == {(0, "CC-BY-NC-4.0"), (1, "CC-BY-SA-4.0")}


def test_license_notices_of_their_own(spark):
    from llm.licenses import scan

    rng = random.Random(12)
    notices = {
        "All rights reserved.": "All-Rights-Reserved", "Licensed under the Mozilla Public License, Version 2.0.": "MPL-2.0", "Released under the ISC License.": "ISC", "Licensed under CC0 1.0.": "CC0-1.0",
        "This is free and unencumbered software released into the public domain.": "Unlicense", "Licensed under the Eclipse Public License, Version 2.0.": "EPL-2.0",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "AGPL-3.0",
    }
    texts = [f"{sentence(rng, rng.randrange(60))}\n{n}\n{sentence(rng, rng.randrange(3))}" for n in notices for _ in range(5)]
    got = {(r["doc_id"], r["license"]) for r in scan(table(spark, texts)).collect()}
    assert got == {(5 * i + k, name) for i, name in enumerate(notices.values()) for k in range(5)}


def test_url_filter(spark):
    from llm.url_filter import judge

    rng = random.Random(9)
    pages, labels = [], []
    for i in range(400):
        spam = i % 4 == 0
        pages.append((i, f"https://{'casino' if spam else 'news'}.host{i % 5}.info/{rng.choice(['a', 'b'])}/{i}?p=1", "x"))
        if i % 2 == 0:
            labels.append((i, spam))
    fixed = [
        (1000, "http://x.NET/de/1", "net/", "block"), (1001, "http://a.example.net/en/1", "example.net/en/", "allow"), (1002, "ftp://example.com/de/", "example.com/de/", "block"),
        (1003, "http://q.org/fr/x", "org/fr/", "allow"), (1004, "http://example.com/de", None, "allow"), (1005, "http://internet/x", None, "allow"), (1006, None, None, "allow"), (1007, "nothing", None, "allow"),
        (1008, "http://b.org?x=/fr/", None, "allow"), (1009, "http://net", None, "allow"),
    ]
    df = spark.createDataFrame(pages + [(i, u, "x") for i, u, _, _ in fixed] + [pages[0]], "page_id BIGINT, url STRING, tokens STRING")
    marked = spark.createDataFrame([*labels, (None, True)], "page_id BIGINT, blocked BOOLEAN")
    got = judge(df, marked).collect()
    assert len(got) == len(pages) + len(fixed) + 1
    by = {r["page_id"]: r for r in got}
    assert all((by[i]["verdict"] == "block") == (i % 4 == 0) for i in range(400))
    for i, _, rule, verdict in fixed:
        assert (by[i]["rule"], by[i]["verdict"]) == (rule, verdict), i
    assert (by[1000]["host"], by[1000]["path"], by[1008]["host"], by[1008]["path"], by[1006]["host"]) == ("x.net", "/de/1", "b.org", "", "")
    assert judge(df, marked.limit(0)).where("verdict = 'block'").count() == 2 and judge(df.limit(0), marked).count() == 0


def test_url_rules_rest_on_every_part_of_a_url(spark):
    """Signs in the second path part, the third key, a value and a fifth host label; two that only count together."""
    from llm.url_filter import judge, mine

    rng = random.Random(13)
    bad = ["https://x.example.com/en/casino/{i}", "https://x.example.com/en/{i}?a=1&b=2&spam=3", "https://x.example.com/en/{i}?kind=adult", "https://ads.a.b.example.com/en/{i}", "https://x.example.com/en/{i}.download", "https://x.example.com/en/left/right/{i}"]
    good = ["https://x.example.com/en/{i}?a=1&b=2&c=3", "https://x.example.com/en/{i}?kind=news", "https://news.a.b.example.com/en/{i}", "https://x.example.com/en/{i}", "https://x.example.com/en/left/{i}", "https://x.example.com/en/right/{i}"]
    pages = [(i, (bad if i % 2 else good)[i // 2 % 6].replace("{i}", str(rng.randrange(10**6)))) for i in range(720)]
    df = spark.createDataFrame(pages, "page_id BIGINT, url STRING")
    marked = spark.createDataFrame([(i, i % 2 == 1) for i in range(0, 720)], "page_id BIGINT, blocked BOOLEAN")
    got = {r["page_id"]: r for r in judge(df, marked).collect()}
    surest = {i: r["confidence"] for i, r in got.items()}
    assert all(surest[i] == 1 for i in range(720) if i % 2)
    assert all(surest[i] is None or surest[i] < 1 for i in range(720) if not i % 2)
    # brute force: what a combination's pages say
    rows = [(sorted({rng.choice("abcdef") for _ in range(5)} | {"all"}), rng.random() < 0.5) for _ in range(300)]
    from itertools import combinations

    want = {}
    for n in range(1, 8):
        for c in combinations([*"abcdef"] + ["all"], n):
            on = [y for t, y in rows if set(c) <= set(t)]
            if sum(on) >= 20 and sum(on) / len(on) >= 0.5:
                want[tuple(sorted(c))] = sum(on) / len(on)
    want = {c: v for c, v in want.items() if not any(set(d) < set(c) and want[d] >= v for d in want)}
    rules = {tuple(r["items"]): r["confidence"] for r in mine(spark.createDataFrame(rows, "tokens ARRAY<STRING>, blocked BOOLEAN"), min_confidence=0.5).collect()}
    assert rules == pytest.approx(want)


def test_url_rules_of_any_length_and_tokens_of_the_same_pages(spark):
    """Six tokens that only together block; tokens on the same pages are one item that any of them fires."""
    from itertools import combinations

    from llm.url_filter import matches, mine

    full = [*"abcdef"]
    rows = [(full + ["g", "twin"], True)] * 40
    rows += [(list(c) + ["g", "twin"], False) for c in combinations(full, 5) for _ in range(30)] + [(["other"], False)] * 50
    rules = mine(spark.createDataFrame(rows, "tokens ARRAY<STRING>, blocked BOOLEAN"), min_confidence=0.9).collect()
    assert [(r["items"], r["confidence"]) for r in rules] == [(full, 1.0)]
    rows = [(["x", "y", "z"] if i % 3 else ["w"], i % 3 > 0) for i in range(120)] + [(["z"], False)] * 40 + [([], True), (None, None)]
    mined = mine(spark.createDataFrame(rows, "tokens ARRAY<STRING>, blocked BOOLEAN"))
    found = {tuple(r["items"]): (r["alike"], r["confidence"]) for r in mined.collect()}
    assert found == {("x",): ([["x", "y"]], 1.0), ("z",): ([["z"]], pytest.approx(80 / 120))}
    baskets = spark.createDataFrame([(["x"],), (["q", "y"],), (["z"],), (["w"],), ([],)], "tokens ARRAY<STRING>")
    fired = {(tuple(r["tokens"]), r["confidence"]) for r in matches(baskets, mined).collect()}
    assert fired == {(("x",), 1.0), (("q", "y"), 1.0), (("z",), 80 / 120)}
    everywhere = [(["all", "k"] if i % 2 else ["all"], i % 2 == 1 or i % 4 == 0) for i in range(100)]
    rules = mine(spark.createDataFrame(everywhere, "tokens ARRAY<STRING>, blocked BOOLEAN"), min_confidence=0.5).collect()
    assert {tuple(r["items"]): r["confidence"] for r in rules} == {("all",): 0.75, ("k",): 1.0}


def test_rows_are_judged_each_by_its_own_text(spark):
    """Null and repeated doc_ids: only the rows that were judged go."""
    from llm.decontaminate import clean
    from llm.jaccard_join import keep_one
    from llm.toxicity import keep_clean

    rng = random.Random(14)
    a, b, c, d = (sentence(rng, 40) for _ in range(4))
    bench = spark.createDataFrame([(1, a)], "item_id BIGINT, text STRING")
    ids, texts = [None, None, 7, 7, 8], [a, b, a, c, d]
    assert sorted(r["text"] for r in clean(table(spark, texts, ids), bench).collect()) == sorted([b, c, d])
    ids, texts = [5, 5, 5, 6, None], [a, b, b, b, b]
    assert sorted(((r["doc_id"], r["text"]) for r in keep_one(table(spark, texts, ids)).collect()), key=repr) == sorted([(5, a), (5, b), (None, b)], key=repr)
    many = [". ".join(sentence(rng, 12) for _ in range(6)) + (" you villainous scoundrel fool." if i % 3 == 0 else "") for i in range(400)]
    bad, good = sentence(rng, 12) + ". you villainous scoundrel fool.", sentence(rng, 30)
    docs = table(spark, [*many, bad, good, bad, good], [*range(400), None, None, 900, 900])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id BIGINT, quality INT, toxic INT")
    kept = keep_clean(docs, labels).where("doc_id IS NULL OR doc_id = 900").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(None, good), (900, good)], key=repr)


def test_small_batches_bound_bytes_not_rows(spark):
    from llm.steps import BATCH_BYTES, small_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.sha2(F.col("id").cast("string"), 256), 100).alias("text"))  # 6,400 characters each

    def sizes(frames):
        for f in frames:
            yield pd.DataFrame({"n": [int(f["text"].str.len().sum())]})

    with small_batches(spark):
        found = [r["n"] for r in texts.mapInPandas(sizes, "n BIGINT").collect()]
    assert sum(found) == 3000 * 6400 and max(found) < BATCH_BYTES * 1.1
    assert spark.conf.get(name) == before


def test_pipeline_runs_in_small_batches(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from llm.steps import BATCH_BYTES

    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage)])
    table(spark, ["a b", "c"]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2 and seen == [BATCH_BYTES]


def test_regions_are_handed_on_slice_by_slice():
    """What a task holds of the regions follows a slice, not the batch that Spark hands it."""
    import llm.decontaminate as D

    class Docs:
        def withColumns(self, _):
            return self

        def mapInPandas(self, build, _):
            return build

    text = " ".join(f"y{i}" for i in range(200_000))
    frame = pd.DataFrame({"doc_id": [str(i) for i in range(8)], "row": range(8), "text": [text] * 8})
    full = np.full(1 << (D._BITS - 6), -1, dtype=np.int64).tobytes()  # every window hits
    out = list(D._regions(Docs(), full, [])([frame]))
    assert len(out) > 1 and sum(map(len, out)) == 8


def test_pipeline_keeps_columns_and_clean_documents(spark):
    import corpus_pipeline as p
    from llm.decontaminate import overlaps
    from llm.jaccard_join import jaccard_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    deduped = p.near_duplicates(spark, docs, SF)
    assert deduped.columns == docs.columns and deduped.count() == jaccard_components(docs).select("component_id").distinct().count()
    cleaned = p.decontamination(spark, docs, SF)
    assert overlaps(cleaned, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    result = p.run(spark, SF)
    assert result.columns == [*docs.columns, "copies", "taken"] and result.count() > 0
