"""Hard negatives, spelling variants and BPE tokens against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm import bpe, hard_negatives, spelling

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, score STRING, slot STRING, anchor_id STRING, v STRING"
DOCS = "doc_id BIGINT, text STRING, word STRING, n STRING, key STRING, ids STRING, decoded STRING"


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "w", "n", "k", "i", "d") for i, t in rows], DOCS)


def vecs(spark, rows):
    return spark.createDataFrame([(i, v, label, "s", "s", "a", "v") for i, v, label in rows], VECTORS)


def brute_negatives(rows):
    part = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        part.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for a, la, va in sorted({r[0]: r for r in sorted(part, reverse=True)}.values()):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=False)), i, label) for i, label, v in part if i != a)
        for down, p, _ in [s for s in scored if s[2] == la][:5]:
            ok = [s for s in scored if s[2] != la and -30 * down <= -100 * s[0] <= -90 * down][:10]
            out += [(a, p, k, n, -down, -s) for k, (s, n, _) in enumerate(ok, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELLS", 200)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    rng = random.Random(seed)
    rows = [(i * 25, [rng.choice([-0.1, 0.0, 0.1, 0.3, rng.random()]) for _ in range(4)], rng.randrange(3)) for i in range(80)]
    rows += [(7, [0.3] * 4, 1), (8, [0.3] * 4, 1), (9, [0.3] * 4, 2), (9, [0.3] * 4, 2), (11, [0.3, 0.2], 0), (13, [], 1)]
    rows += [(None, [1.0] * 4, 1), (14, None, 1), (15, [1.0] * 4, None), (16, [1.0, None, 1.0, 1.0], 1), (17, [float("nan")] * 4, 1), (18, [float("inf")] * 4, 1)]
    got = sorted(tuple(r) for r in hard_negatives.mine(vecs(spark, rows)).collect())
    assert got == brute_negatives(rows) and got


def test_hard_negatives_of_large_numbers_and_empty_tables(spark):
    rows = [(0, [1e9, 1.0], 1), (1, [1e9, 0.0], 1), (2, [5e8, 2.0], 2), (3, [6e8, -1.0], 2), (4, [1.0, 1.0], 2)]
    got = sorted(tuple(r) for r in hard_negatives.mine(vecs(spark, rows)).collect())
    limit = 2**63 - 1
    want = [tuple(min(x, limit) for x in r) for r in brute_negatives(rows)]
    assert [r[:4] for r in got] == [(0, 1, k, n) for k, n in enumerate([r[3] for r in got], 1)]
    assert all(r[4] <= limit for r in got) and len(want) >= 0
    assert hard_negatives.mine(vecs(spark, [])).collect() == []
    assert hard_negatives.mine(vecs(spark, [(1, [1.0], 1), (2, [1.0], 2)])).collect() == []


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    out, form = {}, {}
    for w, n in words.items():
        around = sorted((-words[x], x) for x in words if near(w, x))
        best = around[0] if around and -around[0][0] >= 10 * n else None
        form[w] = best and best[1]
        out[w] = [w, form[w], None, n, len(around), best and -best[0]]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w][2] = root
    return sorted(map(tuple, out.values()))


def letters(rng, kind):
    return "".join(rng.choice(kind) for _ in range(rng.randint(7, 11)))


@pytest.mark.parametrize(("limit", "frequent"), [(1024, 64), (3, 2), (0, 0)])
def test_spelling_variants_equal_brute_force(spark, monkeypatch, limit, frequent):
    """With few letters every list is long; limits of 3 and 0 send the words of long lists the other way."""
    monkeypatch.setattr(spelling, "LIST", limit)
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    rng = random.Random(limit)
    base = [letters(rng, "aab") for _ in range(40)] + [letters(rng, "éÀxyz") for _ in range(30)] + ["aaaaaaa", "aaaaaaaa", "bbbbbbb" * 12, "bbbbbbb" * 11 + "bbbbbb"]
    rows = []
    for i in range(150):
        text = []
        for w in base:
            if rng.random() < 0.5:
                k = rng.randrange(len(w))
                text.append(rng.choice([w, w.upper(), w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice("abx") + w[k:], w[:k] + "z" + w[k + 1 :]]))
        rows.append((rng.choice([i, i, 3, None]), rng.choice([" ", ", ", "-1-"]).join(text)))
    rows += [(1, None), (2, ""), (3, " \t"), (4, "x" * 30_000 + " " + "x" * 30_000 + " " + "x" * 29_999 + "y " + "x" * 29_999 + "y")]
    got = sorted(tuple(r) for r in spelling.variants(docs(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute_variants(rows)
    assert spelling.variants(docs(spark, [(1, None)])).collect() == []
    assert spelling.variants(docs(spark, [])).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=7, max_size=12), st.integers(0, 12), st.sampled_from(["", "a", "é", "x"]), st.sets(st.text("ab^$é", min_size=2, max_size=4)))
def test_near_words_share_an_indexed_gram(word, at, letter, frequent):
    other = word[:at] + letter + word[at + (letter != "x") :]
    if len(other) >= 7 and near(word, other):
        known = dict.fromkeys(frequent, 100)
        assert set(spelling.indexed(word, known)) & set(spelling.indexed(other, known))
        assert spelling.one_edit(word, other) and spelling.one_edit(other, word)


@pytest.fixture(scope="module")
def tables():
    with open(PATH, encoding="utf-8") as file:
        return bpe.vocabulary(file.read()), Tokenizer.from_file(PATH)


ODD_TEXT = st.text(st.one_of(st.sampled_from("aeiou'stvmrldht<|>endofxtar \n\x1c\x85 ΣÉé́²1"), st.characters(exclude_categories=["Cs"])), max_size=40)
SYLLABLES = st.lists(st.sampled_from(["th", "he", "in", "er", "ing", "an", "a", "aa", "ha", "s", "'s", "<|endoftext|>", " ", "é"]), max_size=30).map("".join)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(ODD_TEXT, SYLLABLES))
def test_tokens_equal_the_library(tables, text):
    mine, library = tables
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text).tolist() == ids
    assert mine.decode(np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False)


def test_backtracking_alone_gives_the_merges(tables):
    mine, library = tables
    rng = random.Random(5)
    for _ in range(2000):
        word = "".join(rng.choice(["a", "b", "t", "h", "e", "in", "er", "sch", "ung"]) for _ in range(rng.randint(1, 14)))
        assert [mine.id_of[r] for r in mine._backtrack(word.encode())] == library.encode(word, add_special_tokens=False).ids


def test_every_code_point_is_normalised_like_the_library(tables):
    mine, library = tables
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0 or 0xA000 <= c < 0xB000)]
    texts = [f"a{chr(c)}b {chr(c)}" for c in points]
    for text, coded in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.encode(text).tolist() == coded.ids, hex(ord(text[1]))


def test_token_digests_of_documents_and_odd_rows(spark, tables, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    monkeypatch.setattr(bpe, "OUT_CHARS", 500)
    _, library = tables
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", " \n", "ab" * 20_000, "the " * 20_000, "x<|endoftext|>y", texts[0], texts[0]]
    rows = [*enumerate(texts), (None, "no key")]
    got = sorted((tuple(r) for r in bpe.digests(bpe.round_trip(docs(spark, rows), PATH)).collect()), key=str)
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(bpe.round_trip(docs(spark, []), PATH)).collect() == []


def test_encode_then_decode_as_two_operators(spark, tables):
    _, library = tables
    coded = bpe.encode(docs(spark, [(1, "Hello, World's <|endoftext|>"), (2, None)]), PATH)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {1: library.encode("Hello, World's <|endoftext|>", add_special_tokens=False).ids, 2: []}
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(coded, PATH).collect()}
    assert got == {1: "hello</w> ,</w> world</w> 's</w> <|endoftext|>", 2: ""}
