"""Document toxicity by multiple-instance learning: sentences scored, combined by noisy-or, trained from document labels.

How it works
    A document is a bag of sentences (cut after . ! ? and at line ends; pieces of over MAX_BYTES bytes without such a
    mark are cut there). A sentence's features are its byte 4-grams and 6-grams, lower-cased,
    with one space for each run of white space. A feature's weight counts once a sentence. A sentence is offensive
    with p = sigmoid(bias + sum of weights); the document with 1 - prod(1 - p). Only the documents' labels are known;
    the gradient of the log loss through the noisy-or finds out which sentences carry them.

    Training uses at most TRAIN_ROWS labelled documents (picked by a hash of doc_id; only rows with
    crc32(doc_id) mod 4 other than 2). Spark counts in how many toxic and other training documents each hashed n-gram
    occurs; the FEATURES best by the signed log-likelihood ratio are the model's features. Steps of
    full-batch gradient descent (Adam) are computed per partition on the sparse sentences and added up; what comes
    back to the driver is one array of the model's size per partition.

Defined results: a null or empty text has no sentences and scores 0; without labels of both kinds every score is
0; repeated labels of a document count as toxic if any is; further columns are ignored; labels, lang, source and doc_id
are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.steps import ids_as_numbers, ids_as_text, small
from llm.wordhash import mix, slices
from postlake.session import cut_lineage

TRAIN_ROWS = 20_000
FEATURES = 8_192
BUCKET_BITS = 20
STEPS = 40
RATE = 0.15
DECAY = 1e-4
MIN_DOCS = 5
THRESHOLD = 0.3
MAX_BYTES = 4_096
TRAIN_PARTITIONS = 12
SLICE = 1 << 18  # characters at a time: some 100 bytes of working memory each
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[10, 33, 46, 63]] = True


def sentence_grams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, sentence of each bucket, first sentence of each text): distinct hashed n-grams of all sentences.

    Sentences are numbered over all texts; text i has those from first[i] to first[i + 1].
    """
    encoded = [t.encode("utf-8", "surrogatepass").lower() if isinstance(t, str) else b"" for t in texts]
    begins = np.cumsum([0] + [len(b) + 1 for b in encoded])
    data = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
    space = _SPACES[data]
    end = _ENDS[data]
    end[begins[1:] - 1] = True
    start = np.r_[True, end[:-1]]
    start |= (np.arange(len(data)) - np.maximum.accumulate(np.where(start, np.arange(len(data)), 0))) % MAX_BYTES == 0
    sentence = np.cumsum(start) - 1
    first = np.r_[sentence[begins[:-1]], sentence[-1] + 1] if len(encoded) else np.zeros(1, dtype=np.int64)
    # one space for a run of white space
    keep = ~(space & np.r_[False, space[:-1]])
    data, sentence = np.where(space, 32, data)[keep].astype(np.uint64), sentence[keep]
    found = []
    for n in (4, 6):
        m = len(data) - n + 1
        if m > 0:
            code = np.zeros(m, dtype=np.uint64)
            for i in range(n):
                code |= data[i : i + m] << np.uint64(8 * i)
            whole = sentence[:m] == sentence[n - 1 :]
            bucket = (mix(code[whole] + np.uint64(n << 56)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            found.append(sentence[:m][whole] << BUCKET_BITS | bucket)
            del code, whole, bucket
    pairs = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    return pairs & ((1 << BUCKET_BITS) - 1), pairs >> BUCKET_BITS, first


def noisy_or(z: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) over each text's sentences; 0 without sentences."""
    return -np.expm1(-np.add.reduceat(np.r_[np.logaddexp(0.0, z), 0.0], np.minimum(first[:-1], len(z))) * (first[1:] > first[:-1]))


def _train_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most about TRAIN_ROWS labelled rows outside the held-out fold, over a fixed number of partitions."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("double").alias("toxic"))
    marked = cut_lineage(marked.where(~held_out(F.col("doc_id"))))
    share = min(1.0, TRAIN_ROWS / max(marked.count(), 1))
    marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    return docs.join(F.broadcast(marked), "doc_id").select("text", "toxic").repartition(TRAIN_PARTITIONS, F.xxhash64("text"))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias), at most FEATURES of them."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut_lineage(_train_rows(docs, labels))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part in slices(f, limit=SLICE):
                buckets, sentence, first = sentence_grams(part["text"])
                text = np.searchsorted(first, sentence, side="right") - 1
                pairs = np.unique(text << BUCKET_BITS | buckets)
                toxic = part["toxic"].to_numpy() > 0
                for label in (False, True):
                    b, n = np.unique(pairs[toxic[pairs >> BUCKET_BITS] == label] & ((1 << BUCKET_BITS) - 1), return_counts=True)
                    yield pd.DataFrame({"bucket": b.astype(np.int32), "clean": n * (not label), "toxic": n * label})

    totals = {r["toxic"] > 0: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if not totals.get(True) or not totals.get(False):
        return np.empty(0, np.int64), np.empty(0), -np.inf
    counts = rows.mapInPandas(count, "bucket INT, clean BIGINT, toxic BIGINT").groupBy("bucket").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    # how far the share among toxic documents is from that among the others, in standard errors
    p1, p0, p = F.col("t") / totals[True], F.col("c") / totals[False], (F.col("t") + F.col("c")) / (totals[True] + totals[False])
    z = F.abs(p1 - p0) / F.sqrt(p * (1 - p) * (1 / totals[True] + 1 / totals[False]) + 1e-9)
    best = counts.where((F.col("t") + F.col("c") >= MIN_DOCS)).orderBy(z.desc(), "bucket").limit(FEATURES).select("bucket").collect()
    buckets = np.array(sorted(r["bucket"] for r in best), dtype=np.int64)

    def sparse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
        slot[buckets] = np.arange(len(buckets))
        for f in frames:
            for part in slices(f, limit=SLICE):
                b, sentence, first = sentence_grams(part["text"])
                pairs = np.unique((sentence << BUCKET_BITS | slot[b])[slot[b] >= 0])
                yield pd.DataFrame({"sentence": [(pairs >> BUCKET_BITS).astype(np.int32).tobytes()], "feature": [(pairs & ((1 << BUCKET_BITS) - 1)).astype(np.int32).tobytes()], "first": [first.astype(np.int32).tobytes()], "toxic": [part["toxic"].to_numpy(np.float64).tobytes()]})

    bags = cut_lineage(rows.mapInPandas(sparse, "sentence BINARY, feature BINARY, first BINARY, toxic BINARY"))
    theta = np.zeros(len(buckets) + 1)
    theta[-1] = -6.0
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):

        def gradient(frames: Iterator[pd.DataFrame], theta=theta) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(theta)
            for f in frames:
                for s, x, first, y in zip(*(f[c] for c in ("sentence", "feature", "first", "toxic")), strict=True):
                    s, x, first, y = np.frombuffer(s, np.int32), np.frombuffer(x, np.int32), np.frombuffer(first, np.int32), np.frombuffer(y, np.float64)
                    z = np.bincount(s, theta[x], minlength=first[-1]) + theta[-1]
                    p = np.clip(noisy_or(z, first), 1e-9, 1 - 1e-9)
                    # d loss / d z = sigmoid(z) * (1 - y / p)
                    pull = (1 - y / p)[np.repeat(np.arange(len(y)), np.diff(first))] / (1 + np.exp(-z))
                    total[:-1] += np.bincount(x, pull[s], minlength=len(theta) - 1)
                    total[-1] += pull.sum()
            yield pd.DataFrame({"g": [total.tobytes()]})

        parts = bags.mapInPandas(gradient, "g BINARY").collect()
        g = np.sum([np.frombuffer(r["g"]) for r in parts], axis=0) / sum(totals.values())
        g[:-1] += DECAY * theta[:-1]
        moment, square = 0.9 * moment + 0.1 * g, 0.98 * square + 0.02 * g * g
        theta = theta - RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.98**step)) + 1e-8)
    return buckets, theta[:-1], float(theta[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted, sentences, offending sentences and the number of the worst."""
    return _scored(docs, model, threshold).drop("th")


def _scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """``score`` with th, a hash of the text."""
    buckets, weights, bias = model

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = np.zeros(1 << BUCKET_BITS, dtype=np.float32)
        weight[buckets] = weights
        used = weight != 0
        for f in frames:
            for part in slices(f, limit=SLICE):
                b, sentence, first = sentence_grams(part["text"])
                hit = used[b]
                pairs = np.unique(sentence[hit] << BUCKET_BITS | b[hit])
                z = np.bincount(pairs >> BUCKET_BITS, weight[pairs & ((1 << BUCKET_BITS) - 1)], minlength=first[-1]) + bias
                p = noisy_or(z, first)
                empty = ~part["text"].fillna("").str.contains(r"\S", regex=True).to_numpy(dtype=bool)
                p[empty] = 0.0
                ranked = np.lexsort((-z, np.repeat(np.arange(len(part)), np.diff(first))))
                bad = np.add.reduceat(np.r_[(z > np.log(threshold / (1 - threshold))).astype(np.int64), 0], first[:-1])
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "th": part["th"], "score": np.clip(p, 0.0, 1.0), "sentences": np.diff(first), "offending": bad,
                    "worst_sentence": ranked[first[:-1]] - first[:-1],
                })

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    out = ids_as_text(rows, "doc_id").mapInPandas(build, "doc_id STRING, th BIGINT, score DOUBLE, sentences BIGINT, offending BIGINT, worst_sentence BIGINT")
    out = ids_as_numbers(out, "doc_id")
    return out.select("doc_id", "th", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences", "offending", "worst_sentence")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the model does not reject, each by its own doc_id and text."""
    model = train(docs, labels)
    rejected = small(cut_lineage(_scored(docs, model).where("predicted = 1").select("doc_id", "th").distinct()))
    same = docs["doc_id"].cast("bigint").eqNullSafe(rejected["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == rejected["th"])
    return docs.join(rejected, same, "left_anti")
