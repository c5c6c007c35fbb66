"""Benchmark passages in documents by spaced seeds.

How it works
    Each benchmark item gives seeds: over every window of SPAN words, each mask of MASKS hashes the words at
    its 1 places and ignores those at its 0 places. A document's windows are hashed alike. A bitmap of all
    benchmark seeds (its size is fixed, so it may be broadcast; it has no false negatives) leaves few windows
    of the corpus, which are joined with the seeds exactly. Around each hit, item and document are laid side by
    side without gaps, and the best-scoring run (+1 a word that agrees, -2 one that doesn't) is kept. It is a leak if
    it has MIN_AGREE agreeing words, or FULL of the item, and at least IDENTITY of its words agree. Any run of
    12 words with one or two substitutions at most every few words keeps a seed; so does each exact one.
    Items of MIN_ITEM to SPAN - 1 words have masks of their own, one for every choice of words that may differ in a run which
    passes the check: FULL of the whole item agrees, and at least MIN_ITEM words (``short_masks``). So none is missed. Items of
    fewer than MIN_ITEM words are too common to prove anything and are left out.

Defined results: null or empty texts and items contain nothing, and items without an id are left out; an empty benchmark gives no rows; repeated items
with other ids are reported each; repeated document rows give one row each per item; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.steps import ids_as_text, small
from llm.wordhash import gram_hashes, slices, word_hashes
from postlake.session import cut_lineage

SPAN = 10
MASKS = ("1110110111", "1101101011", "1111100111")
MIN_ITEM = 5
MIN_AGREE = 10
FULL = 0.75
IDENTITY = 0.75
MARGIN = 96
_BITS = 24


def short_masks(n: int) -> list[list[int]]:
    """Places of an item of n words, fewer than SPAN: every set of as many words as a leak must have at least."""
    return [list(c) for c in combinations(range(n), least(n))]


def least(n: int) -> int:
    """How many words of an item of n words, fewer than SPAN, must agree."""
    return max(MIN_ITEM, math.ceil(FULL * n))


def _patterns(lengths: list[int]) -> list[tuple[int, list[int], int]]:
    """(mask, places, words that a window spans) of the fixed masks and of those for short items of these lengths."""
    fixed = [(m, [i for i, c in enumerate(mask) if c == "1"], SPAN) for m, mask in enumerate(MASKS)]
    return fixed + [(100 * n + k, places, n) for n in lengths for k, places in enumerate(short_masks(n))]


def _seeds(items: DataFrame) -> DataFrame:
    """(item_id, mask, seed, at): every seed of every item. Masks from 100 on are those of short items: 100 times the length, and a number.

    A mask's places count from its first one, so that it also fits where a text begins or ends within the item; ``at`` is where that stands in the item.
    """

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part in slices(f):
                h, off = word_hashes(part["text"])
                for item, lo, hi in zip(part["item_id"], off[:-1], off[1:], strict=True):
                    n = hi - lo
                    if n < MIN_ITEM:
                        continue
                    for m, places, width in _patterns([n] if n < SPAN else []):
                        if n < SPAN and m < 100:
                            continue
                        if n < SPAN:
                            s, at = gram_hashes(h[lo:hi], [p - places[0] for p in places], salt=m)[places[0] : places[0] + 1], np.array([places[0]], dtype=np.int32)
                        else:
                            s = gram_hashes(np.append(h[lo:hi], np.zeros(width - places[-1] - 1, np.uint64)), places, salt=m)[: n - width + 1]
                            at = np.arange(len(s), dtype=np.int32)
                        yield pd.DataFrame({"item_id": item, "mask": m, "seed": s.astype(np.int64), "at": at})

    return items.mapInPandas(build, "item_id BIGINT, mask INT, seed BIGINT, at INT")


def _bitmap(seeds: DataFrame) -> bytes:
    """2^24 bits, set at each seed: 2 MB, whatever the benchmark's size."""
    slot = F.col("seed").bitwiseAND((1 << _BITS) - 1)
    cells = seeds.select(F.shiftright(slot, 6).alias("cell"), slot.bitwiseAND(63).cast("int").alias("bit")).groupBy("cell").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    out = np.zeros(1 << (_BITS - 6), dtype=np.int64)
    for row in cells.toLocalIterator():  # 262,144 cells at most
        out[row["cell"]] = row["bits"]
    return out.tobytes()


def _regions(docs: DataFrame, bitmap: bytes, short: list[int]) -> DataFrame:
    """Parts of documents with hits: doc_id, row (a hash of the row), start, words and the hits (at, mask, seed)."""
    masks = [(m, places, width) if m < 100 else (m, [p - places[0] for p in places], places[-1] - places[0] + 1) for m, places, width in _patterns(short)]

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.frombuffer(bitmap, np.uint64)
        for f in frames:
            for part in slices(f):
                rows = []
                h, off = word_hashes(part["text"])
                at_all, mask_all, seed_all = [], [], []
                for m, places, width in masks:
                    s = gram_hashes(h, places, salt=m)
                    slot = s & np.uint64((1 << _BITS) - 1)
                    at = np.flatnonzero((cells[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
                    at = at[at + width <= off[np.searchsorted(off, at, side="right")]]  # inside one text
                    at_all.append(at)
                    mask_all.append(np.full(len(at), m))
                    seed_all.append(s[at])
                at, mask, seed = np.concatenate(at_all), np.concatenate(mask_all), np.concatenate(seed_all)
                order = np.argsort(at, kind="stable")
                at, mask, seed = at[order], mask[order], seed[order].astype(np.int64)
                doc = np.searchsorted(off, at, side="right") - 1
                cuts = np.flatnonzero((np.diff(at) > MARGIN) | (np.diff(doc) > 0)) + 1
                for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(at)], strict=True):
                    if hi > lo:
                        d = doc[lo]
                        begin, end = max(off[d], at[lo] - MARGIN), min(off[d + 1], at[hi - 1] + SPAN + MARGIN)
                        rows.append((part["doc_id"].iloc[d], part["row"].iloc[d], int(begin - off[d]), h[begin:end].astype(np.int64), (at[lo:hi] - begin).astype(np.int32), mask[lo:hi].astype(np.int32), seed[lo:hi]))
                yield pd.DataFrame(rows, columns=["doc_id", "row", "start", "words", "ats", "masks", "seeds"])

    return ids_as_text(docs, "doc_id").mapInPandas(build, "doc_id STRING, row BIGINT, start INT, words ARRAY<BIGINT>, ats ARRAY<INT>, masks ARRAY<INT>, seeds ARRAY<BIGINT>")


def best_run(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Of a laid at ``shift`` over b (a[i] beside b[i - shift]): start in a, length and agreeing words of the best run."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    if hi <= lo:
        return None
    agree = a[lo:hi] == b[lo - shift : hi - shift]
    total = np.concatenate([[0], np.cumsum(np.where(agree, 1, -2))])
    gain = total - np.minimum.accumulate(total)
    end = int(gain.argmax())
    if gain[end] <= 0:
        return None
    begin = int(total[: end + 1].argmin())
    return lo + begin, end - begin, int(agree[begin:end].sum())


def whole(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """As ``best_run``, but from the first word that agrees to the last: a short item counts as a whole, wherever words of it differ."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    at = np.flatnonzero(a[lo:hi] == b[lo - shift : hi - shift]) if hi > lo else []
    return (lo + int(at[0]), int(at[-1] - at[0]) + 1, len(at)) if len(at) else None


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document row and item with a leak: where it is, its length in words and how many agree."""
    return _overlaps(docs, items).drop("row")


def _overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``overlaps`` with row, a hash of the document row."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    seeds = cut_lineage(_seeds(items))
    short = [r["n"] for r in seeds.where("mask >= 100").select(F.expr("mask div 100").cast("int").alias("n")).distinct().collect()]  # at most SPAN - MIN_ITEM lengths
    regions = cut_lineage(_regions(docs, _bitmap(seeds), sorted(short)))
    hits = regions.select("row", "start", F.explode(F.arrays_zip("ats", "masks", "seeds")).alias("h")).select("row", "start", F.col("h.ats").alias("pos"), F.col("h.masks").alias("mask"), F.col("h.seeds").alias("seed"))
    found = hits.join(seeds, ["mask", "seed"]).select("row", "start", "item_id", (F.col("pos") - F.col("at")).alias("shift"))
    found = found.distinct().groupBy("row", "start", "item_id").agg(F.collect_set("shift").alias("shifts"))

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            h, off = word_hashes(f["text"])
            yield pd.DataFrame({"item_id": f["item_id"], "item_words": [h[lo:hi].astype(np.int64) for lo, hi in zip(off[:-1], off[1:], strict=True)]})

    item_words = cut_lineage(items.mapInPandas(words, "item_id BIGINT, item_words ARRAY<BIGINT>"))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                best = None
                for shift in sorted(int(x) for x in r.shifts):
                    run = (best_run if len(r.item_words) >= SPAN else whole)(r.words, r.item_words, shift)
                    if run and run[2] >= IDENTITY * run[1] and (run[2] >= MIN_AGREE or run[2] >= max(MIN_ITEM, FULL * len(r.item_words))) and (best is None or run[2] > best[2]):
                        best = (*run, run[0] - shift)
                if best:
                    rows.append((r.doc_id, r.row, r.item_id, r.start + best[0], best[1], best[2], best[3], len(r.item_words)))
            yield pd.DataFrame(rows, columns=["doc_id", "row", "item_id", "doc_start", "length", "agree", "item_start", "item_length"])

    # repeated document rows have the same row hash; one region each stands for them, and their number comes back at the end
    once = regions.groupBy("row", "start").agg(F.first("doc_id").alias("doc_id"), F.first("words").alias("words"), F.count("*").alias("copies"))
    checked = once.join(found, ["row", "start"]).join(item_words, "item_id").select("doc_id", "row", "item_id", "start", "words", "item_words", "shifts", "copies")
    numbered = checked.withColumn("start", F.col("start").cast("int"))
    out = numbered.mapInPandas(verify, "doc_id STRING, row BIGINT, item_id BIGINT, doc_start INT, length INT, agree INT, item_start INT, item_length INT")
    best = out.groupBy("row", "item_id").agg(F.max_by(F.struct("doc_id", "doc_start", "length", "agree", "item_start", "item_length"), F.struct("agree", -F.col("doc_start"))).alias("m"))
    copies = once.groupBy("row").agg(F.max("copies").alias("copies"))
    return best.join(copies, "row").select("row", F.col("m.doc_id").cast("bigint").alias("doc_id"), "item_id", "m.doc_start", "m.length", "m.agree", "m.item_start", "m.item_length", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows without a leak, each by its own doc_id and text."""
    leaks = small(cut_lineage(_overlaps(docs, items).select("row", "doc_id").distinct()))
    row = F.xxhash64(docs["doc_id"].cast("bigint"), docs["text"].cast("string"))
    return docs.join(leaks, (row == leaks["row"]) & docs["doc_id"].cast("bigint").eqNullSafe(leaks["doc_id"]), "left_anti")
