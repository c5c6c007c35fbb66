"""Hard negatives by slot-decomposed selection.

Scores are integer inner products with an anchor. The anchors are a stated query set (rows whose id is divisible by
``ANCHOR_EVERY``); they are scored against all rows in blocks: every pass sends at most about ``ANCHOR_BLOCK`` anchors to
the tasks (a bound that does not grow with the data), a task scores chunks of its rows against them.

1. Positives: every task keeps its first ``POSITIVES`` rows of the anchor's label, Spark merges them per anchor.
2. Slots: the upper limits of an anchor's positives (``HIGH`` % of their scores) cut the score axis into disjoint slots;
   slot s holds the scores up to the s-th highest limit and above the next one. Every task keeps its first k
   different-label rows of each slot, after every chunk, and passes over rows below the slot's k-th so far; Spark keeps
   the first k of each (anchor, slot).
3. Suffixes: an anchor's kept rows in descending order are its slots in order, so the first k below a positive's upper
   limit are the head of the suffix that begins at its slot. One list per anchor (at most k rows a slot) answers all of
   its overlapping windows; what lies under the lower limit (``LOW`` %) is cut from the end.

Results: rows with a null id, label, vector or component, or with a component that is not finite, take no part. Rows with
an anchor's id are the anchor itself (the least by label and vector where they differ), never its positive or negative;
other repeated rows count each. Shorter vectors count as padded with zeros. Numbers too large for exact 64-bit arithmetic
are computed exactly with Python integers; a score beyond 64 bits is then written as the nearest 64-bit number. An anchor
without positives, or a positive without a negative in its window, has no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.session import cut_lineage

ANCHOR_EVERY, SHIFT_EVERY, LABELS, SCALE = 100, 7, 10, 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
ANCHOR_BLOCK = 8192
CELLS = 1 << 21  # scores computed at a time in a task
_LONG = 2**63 - 1
_EXACT = 2.0**45  # sums below this, times 100, are exact in 64 bits

KEPT = "anchor_id bigint, slot int, score bigint, vec_id bigint"


def vectors(df: DataFrame, every: int = SHIFT_EVERY) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, with the shifted labels."""
    label = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.col("embedding").cast("array<double>")
    present = df.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~bad)
    return present.select(F.col("vec_id").cast("bigint"), label.cast("bigint").alias("label"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of a column of vectors, shorter ones padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False))
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(anchors, rows) exact integer inner products: 64-bit where they are certain to fit, else Python integers."""
    width = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :width], rows[:, :width]
    most = width * (np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0))
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).astype(object) @ whole(b.T).astype(object) if width else np.zeros((len(a), len(b)), np.int64)


def _first(anchor, slot, score, vec, k: int) -> np.ndarray:
    """Indices of the first k of every (anchor, slot): higher scores, then smaller ids."""
    order = np.lexsort((vec, -score, slot, anchor))
    a, s = anchor[order], slot[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])] if len(order) else np.empty(0, bool)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < k]


def _keep(rows: DataFrame, anchors, limits, floors, k: int) -> DataFrame:
    """Each task's first k rows per anchor and slot. ``limits`` (anchors x slots, descending; None: one slot of rows with
    the anchor's label) are the slots' upper limits, ``floors`` the least score that any window of the anchor takes."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, limits, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, labels, matrix), limits, floors = sent.value
        slots = 1 if limits is None else limits.shape[1]
        held = [np.empty(0, np.int64) for _ in range(4)]  # anchor, slot, score, vec
        least = None
        step = max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                vec, label = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                scores = _scores(matrix, _matrix(part.column(2)))
                same = labels[:, None] == label[None, :]
                if limits is None:
                    at = np.nonzero(same & (ids[:, None] != vec[None, :]) & (scores >= least if least is not None else True))
                    slot = np.zeros(len(at[0]), np.int64)
                else:
                    at = np.nonzero(~same & (ids[:, None] != vec[None, :]) & (scores >= floors[:, None]) & (scores <= limits[:, :1]))
                    slot = (scores[at][:, None] <= limits[at[0]]).sum(axis=1) - 1
                    if least is not None:
                        good = scores[at] >= least[at[0], slot]
                        at, slot = (at[0][good], at[1][good]), slot[good]
                held = [np.concatenate(p) for p in zip(held, (at[0], slot, scores[at], vec[at[1]]), strict=True)]
                best = _first(*held, k)
                held = [h[best] for h in held]
                place = held[0] * slots + held[1]
                full = np.bincount(place, minlength=len(ids) * slots) >= k
                none = -_LONG - 1 if held[2].dtype == np.int64 else -np.inf
                least = np.full(len(ids) * slots, none, dtype=held[2].dtype)
                last = np.r_[place[1:] != place[:-1], True] if len(place) else np.empty(0, bool)
                least[place[last]] = held[2][last]
                least[~full] = none
                least = least.reshape(len(ids), slots)
        if len(held[0]):
            score = np.clip(held[2], -_LONG - 1, _LONG).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[held[0]]), pa.array(held[1].astype(np.int32)), pa.array(score), pa.array(held[3])], names=["anchor_id", "slot", "score", "vec_id"])

    return rows.mapInArrow(run, KEPT)


def _merge(kept: DataFrame, k: int) -> DataFrame:
    """The first k of every (anchor, slot) over all tasks; Spark keeps k a group before it shuffles them."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _block(df: DataFrame, name: str, n: int, count: int) -> DataFrame:
    return df.where(F.pmod(F.xxhash64(name), F.lit(count)) == n).orderBy(name)


def _anchors(anchors: DataFrame, n: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (ascending), labels and vectors of one block of anchors."""
    table = _block(anchors, "vec_id", n, count).toArrow()
    return table["vec_id"].to_numpy(), table["label"].to_numpy(), _matrix(table["v"])


def _limits(positives: DataFrame, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a block's anchors, the descending distinct upper limits (then the least number) and the least lower limit."""
    table = positives.select("anchor_id", "score").toArrow()
    limits = np.full((len(ids), POSITIVES), -_LONG - 1, dtype=np.int64)
    floors = np.full(len(ids), _LONG, dtype=np.int64)
    found: dict[int, set[int]] = {}
    for at, score in zip(np.searchsorted(ids, table["anchor_id"].to_numpy()).tolist(), table["score"].to_pylist(), strict=True):
        found.setdefault(at, set()).add(HIGH * score // 100)
        floors[at] = min(floors[at], -(-LOW * score // 100))
    for at, values in found.items():
        limits[at, : len(values)] = sorted(values, reverse=True)
    return limits, floors


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def mine(df: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive."""
    rows = vectors(df)
    least = F.min(F.struct("label", "v")).alias("row")
    anchors = cut_lineage(rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).groupBy("vec_id").agg(least).select("vec_id", "row.*"))
    count = max(1, -(-anchors.count() * 4 // (ANCHOR_BLOCK * 3)))
    near = _all([_keep(rows, _anchors(anchors, n, count), None, None, POSITIVES) for n in range(count)])
    positives = cut_lineage(_merge(near, POSITIVES))
    far = []
    for n in range(count):
        block = _anchors(anchors, n, count)
        far.append(_keep(rows, block, *_limits(_block(positives, "anchor_id", n, count), block[0]), NEGATIVES))
    return _windows(positives, _merge(_all(far), NEGATIVES))


def _windows(positives: DataFrame, kept: DataFrame) -> DataFrame:
    """One descending list per anchor (its slots in order, at most NEGATIVES rows each); a positive's answer is the head of
    the suffix from its slot on, which is the number of distinct upper limits above its own."""
    down = F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "vec_id")))
    lists = kept.groupBy("anchor_id").agg(down.alias("negatives"))
    limit = F.expr(f"floor({HIGH} * CAST(score AS decimal(20,0)) / 100)")
    own = F.dense_rank().over(Window.partitionBy("anchor_id").orderBy(F.desc("limit"))) - 1
    placed = positives.withColumn("limit", limit).withColumn("own", own)
    head = F.slice(F.filter("negatives", lambda x: x["slot"] >= F.col("own")), 1, NEGATIVES)
    pairs = placed.join(lists, "anchor_id").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(head).alias("at", "n"))
    return pairs.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"),
        "positive_score", (-F.col("n.down")).alias("negative_score"),
    ).where(f"{LOW} * CAST(positive_score AS decimal(20,0)) <= 100 * CAST(negative_score AS decimal(20,0))")
