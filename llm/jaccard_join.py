"""Documents whose five-word shingle sets have a Jaccard similarity of 0.75 or more: a count-vector R-tree join.

How it works
    1. Every text becomes its set of distinct shingles, its 64-bit fingerprint and a point: the shingles
       hashed into a power of two of groups (as many groups as shingles or more, up to 2,048) and counted. Points
       move often, so they are kept as bit planes. Texts with the same set are one node.
    2. Each node is routed to the shingles that stand first in one global order. Two sets with a
       similarity of t share one of their first n - ceil(t n) + 1 shingles, so every link meets in a bucket.
       The order takes shingles last that a bounded sample found to be common, the commonest at the very end. It only
       steers cost: any order that is the same for all nodes gives the same result.
    3. A bucket is read by size: a node of n shingles meets those before it that are not too small for it. Up to
       LEAF such nodes are its leaf: their pairs go straight to the bound. Where there are more, the stretch is crowded:
       first only the pairs with its smallest node do (where it is long, with its HEADS smallest); what these
       links already connect needs no more work. The crowded nodes that have one of another component and of a fitting size in their bucket
       are then searched through an R-tree, in blocks of at most BLOCK nodes, so no task holds a whole bucket: once for the likeliest partner of
       a node in each other component, and, when these links are drawn, for every pair that is still of different components.
       Two nodes with the same common key before the bucket's meet there already and are left to that bucket.
    4. The overlap of two sets, or of a set and any in a tree node, is at most the sum of the coordinate
       minima (the tree node's box has the maximum of each coordinate). Pairs that fail it, or the
       length filter, are dropped; the others are verified on the whole shingle sets.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing;
repeated rows are kept, one result row each; null doc_ids stay null and never name a component unless all are
null; further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.steps import components, ids_as_numbers, ids_as_text, places, small
from llm.wordhash import mix, shingle_sets, slices, word_hashes
from postlake.session import cut_lineage

PERCENT = 75
WORDS = 5
LEAF = 24
BLOCK = 1024
HEADS = 8
TOLD = 1 << 18
TREE_GROUPS = 64
SAMPLE_DOCS = 20_000
SAMPLE_PART = 10
COMMON_IN_SAMPLE = 4
_COMMON_BITS = 22
_MOST_COMMON_BITS = 25


def fits(inter, a, b, percent: int = PERCENT):
    """100 * intersection >= percent * union."""
    return (100 + percent) * inter >= percent * (a + b)


def groups_for(n: int) -> int:
    """How many groups the counts of a set of n shingles have: a power of two from n to 2 n, at least 64 and at most 2,048."""
    return 1 << min(11, max(6, int(n).bit_length()))


def point(shingles: np.ndarray) -> bytes:
    """Counts of the shingles by group; empty if a count passes 255 (no bound then).

    The first byte is the number of bit planes that the counts need, a few as a rule; the planes follow, the highest bits first.
    """
    g = groups_for(len(shingles))
    counts = np.bincount((shingles >> np.uint64(40)).astype(np.int64) & (g - 1), minlength=g)
    most = int(counts.max(initial=0))
    planes = max(1, most.bit_length())
    bits = counts >> np.arange(planes - 1, -1, -1)[:, None] & 1
    return bytes([planes]) + np.packbits(bits.astype(np.uint8), axis=1).tobytes() if most < 256 else b""


def unpack(points: list[bytes]) -> np.ndarray:
    """The counts of points of one length and number of planes, a row each."""
    planes = points[0][0]
    bits = np.unpackbits(np.frombuffer(b"".join(points), np.uint8).reshape(len(points), -1)[:, 1:], axis=1).reshape(len(points), planes, -1)
    counts = bits[:, 0, :]
    for plane in range(1, planes):
        counts = counts << 1 | bits[:, plane, :]
    return counts


def _kind(p: bytes) -> tuple[int, int]:
    """Length and planes of a point; (0, 0) of one without counts."""
    return (len(p), p[0]) if p else (0, 0)


def fold(points: np.ndarray, g: int) -> np.ndarray:
    """The same sets' counts over g groups, g a divisor of the present number."""
    return points.reshape(len(points), -1, g).sum(axis=1, dtype=np.int32)


def overlap_bound(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Upper bounds of the overlaps of pairs of sets, from their points."""
    out = np.full(len(a), 1 << 30, dtype=np.int64)
    together = defaultdict(list)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x and y:
            together[_kind(x), _kind(y)].append(i)
    for ((la, pa), (lb, pb)), at in together.items():
        ga, gb = (la - 1) // pa * 8, (lb - 1) // pb * 8
        g = min(ga, gb)
        for part in np.array_split(at, len(at) * max(ga, gb) // (1 << 20) + 1):
            x, y = fold(unpack([a[i] for i in part]), g), fold(unpack([b[i] for i in part]), g)
            out[part] = np.minimum(x, y).sum(axis=1)
    return out


def _common(docs: DataFrame) -> bytes:
    """How common shingles are, four bits for each slot of their hashes: 0 where a sample of documents does not share
    the shingle, else 1 and one more for each doubling of the least number that counts as common.

    The sample is a tenth of the documents, so that what counts as common, and with it the size of buckets, does not grow with
    the input; its slots grow with it, 2 MB at first and 16 MB at most.
    """
    total = docs.count()
    size = max(SAMPLE_DOCS, total // SAMPLE_PART)
    slots = 1 << min(_MOST_COMMON_BITS, _COMMON_BITS + (-(-size // SAMPLE_DOCS) - 1).bit_length())
    sample = docs.where(F.pmod(F.xxhash64(F.lit(7), F.col("th")), F.lit(1_000_000)) < F.lit(int(min(1.0, size / max(total, 1)) * 1_000_000)))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            for part in slices(frame):
                part = part[[not (t in seen or seen.add(t)) for t in part["th"]]]
                sets = list(shingle_sets(*word_hashes(part["text"]), WORDS))
                if sets:
                    slot, n = np.unique(np.concatenate(sets) & np.uint64(slots - 1), return_counts=True)
                    yield pd.DataFrame({"slot": slot.astype(np.int32), "n": n.astype(np.int32)})

    mean = sample.mapInPandas(count, "slot INT, n INT").groupBy("slot").agg(F.sum("n").alias("n"))
    words = cut_lineage(mean)
    usual = words.agg((F.sum("n") / F.lit(slots)).alias("m")).first()["m"] or 0.0
    # slots hold several shingles each; a slot well above the mean holds a common one
    least = int(usual + 4 * usual**0.5) + COMMON_IN_SAMPLE
    level = F.least(F.lit(15), 1 + F.floor(F.log2(F.col("n") / least))).cast("bigint")
    cells = words.where(F.col("n") >= least).select(F.expr("slot div 16").alias("cell"), (4 * F.expr("pmod(slot, 16)")).alias("at"), level.alias("level"))
    out = np.zeros(slots // 16, dtype=np.int64)
    for row in cells.groupBy("cell").agg(F.expr("bit_or(shiftleft(level, at))").alias("bits")).toLocalIterator():
        out[row["cell"]] = row["bits"]
    return out.tobytes()


def nodes_of(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, th (hash of the text), sid (fingerprint of the set), n, point, routing keys and how many of these are not common.

    Within a task, later copies of a set carry no keys, so copies are combined before the shuffle.
    """
    packed = _common(docs)

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.frombuffer(packed, np.uint8)
        common = np.stack([pairs & 15, pairs >> 4], axis=1).ravel()
        seen: set[int] = set()
        for frame in frames:
            for part in slices(frame):
                rows = []
                for doc, th, s in zip(part["doc_id"], part["th"], shingle_sets(*word_hashes(part["text"]), WORDS), strict=True):
                    n = len(s)
                    if not n:
                        rows.append((doc, th, None, 0, None, None, 0))
                        continue
                    sid = int((mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64) ^ np.uint64(n)).astype(np.int64))
                    if sid in seen:
                        rows.append((doc, th, sid, n, None, None, 0))
                        continue
                    seen.add(sid)
                    late = common[(s & np.uint64(len(common) - 1)).astype(np.int64)]
                    first = n - -(-percent * n // 100) + 1
                    keys = s[np.argsort(late, kind="stable")][:first]
                    rows.append((doc, th, sid, n, point(s), keys.astype(np.int64), min(first, int((late == 0).sum()))))
                out = pd.DataFrame(rows, columns=["doc_id", "th", "sid", "n", "point", "keys", "rare"])
                out["sid"] = pd.array([r[2] for r in rows], dtype="Int64")
                yield out

    out = ids_as_text(docs, "doc_id").mapInPandas(build, "doc_id STRING, th BIGINT, sid BIGINT, n INT, point BINARY, keys ARRAY<BIGINT>, rare INT")
    return ids_as_numbers(out, "doc_id")


def _meet(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """From rows (key, sid, n, before) sorted by key, n and sid: pairs to bound, and the members of crowded stretches.

    Rows of kind 0 are pairs (a, b); of kind 1, a bucket a, its member b of n shingles and the common key before. Every pair of a bucket
    whose sizes fit is a pair here, or both are members, or both have the same common key before, whose bucket has the pair. Memory: a batch and a block.
    """
    # of the bucket being read: its latest LEAF nodes; of the crowded stretch: its first members, and all while they are few
    last_key, latest, window, heads, early = None, None, deque(), [], []

    def pair(x, y):
        if not (x[2] and x[2] == y[2]) and fits(min(x[1], y[1]), x[1], y[1], percent):
            yield 0, min(x[0], y[0]), max(x[0], y[0]), 0, 0

    def leave():
        """The oldest node of the window and its pairs with those after it, which are all that fit it and are not both members."""
        x = window.popleft()
        for y in window:
            if not (x[3] and y[3]):
                yield from pair(x, y)

    def member(x):
        nonlocal heads, early
        x[3] = True
        yield 1, last_key, x[0], x[2], x[1]
        if heads and not fits(heads[0][1], heads[0][1], x[1], percent):
            heads, early = [], []
        for h in heads[:1] if early is not None else heads:
            yield from pair(h, x)
        if len(heads) < HEADS:
            heads.append(x)
        if early is not None:
            early.append(x)
            if len(early) > BLOCK // 2:
                for k, h in enumerate(heads[1:], 1):
                    for y in early[k + 1 :]:
                        yield from pair(h, y)
                early = None

    def end():
        while window:
            yield from leave()

    for frame in frames:
        key, sid, n, before = (frame[c].to_numpy() for c in ("key", "sid", "n", "before"))
        if not len(key):
            continue
        new = np.r_[True, key[1:] != key[:-1]]
        begins = np.flatnonzero(new)
        ends = np.r_[begins[1:], len(key)]
        out = []
        # a key with one row, neither at an edge of the batch, meets nobody
        busy = np.flatnonzero((ends - begins > 1) | (begins == 0) | (ends == len(key)))
        for lo, hi in zip(begins[busy], ends[busy], strict=True):
            k = int(key[lo])
            if k != last_key:
                out.extend(end())
                last_key, latest, heads, early = k, None, [], []
            for x in zip(sid[lo:hi].tolist(), n[lo:hi].tolist(), before[lo:hi].tolist(), strict=True):
                if x[0] == latest:
                    continue
                latest = x[0]
                while window and not fits(window[0][1], window[0][1], x[1], percent):
                    out.extend(leave())
                x = [*x, False]
                if len(window) == LEAF:
                    for y in (*window, x):
                        if not y[3]:
                            out.extend(member(y))
                    window.popleft()
                window.append(x)
        if out:
            yield pd.DataFrame(out, columns=["kind", "a", "b", "before", "n"])
    rest = list(end())
    if rest:
        yield pd.DataFrame(rest, columns=["kind", "a", "b", "before", "n"])


def _bound(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose points allow the overlap."""
    a = nodes.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
    b = nodes.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"))

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.loc[fits(overlap_bound(list(f["pa"]), list(f["pb"])), f["na"].to_numpy(), f["nb"].to_numpy(), percent), ["a", "b"]]

    return pairs.join(a, "a").join(b, "b").mapInPandas(keep, "a BIGINT, b BIGINT")


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that are links, by the whole shingle sets of their texts."""
    ids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    needed = cut_lineage(ids.join(nodes.select("sid", "th"), "sid").select("th"))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            for part in slices(frame):
                part = part[[not (t in seen or seen.add(t)) for t in part["th"]]]
                rows = [
                    (int((mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64) ^ np.uint64(len(s))).astype(np.int64)), s.tobytes())
                    for s in shingle_sets(*word_hashes(part["text"]), WORDS)
                ]
                yield pd.DataFrame(rows, columns=["sid", "s"])

    sets = docs.join(small(needed), "th").select("th", "text").mapInPandas(build, "sid BIGINT, s BINARY")
    sets = cut_lineage(sets.groupBy("sid").agg(F.first("s").alias("s")))

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            good = []
            for x, y in zip(f["sa"], f["sb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="mergesort")
                good.append(fits(int((both[1:] == both[:-1]).sum()), len(x), len(y), percent))
            yield f.loc[good, ["a", "b"]]

    joined = pairs.join(sets.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("sid").alias("b"), F.col("s").alias("sb")), "b")
    return joined.mapInPandas(exact, "a BIGINT, b BIGINT")


def _stack(points: list[bytes]) -> np.ndarray:
    """The points of a block folded to TREE_GROUPS groups; one without counts allows everything."""
    out = np.full((len(points), TREE_GROUPS), 1 << 20, dtype=np.int32)
    alike = defaultdict(list)
    for i, p in enumerate(points):
        if p:
            alike[_kind(p)].append(i)
    for at in alike.values():
        out[at] = fold(unpack([points[i] for i in at]), TREE_GROUPS)
    return out


class Block:
    """A node of the tree above the leaves: at most BLOCK members of one bucket, sorted by component and size.

    Its leaves are runs of LEAF members. The box of a leaf, and of the block, has the largest count of each of
    TREE_GROUPS groups, the range of the sizes and the component if it is but one.
    """

    def __init__(self, sid, n, label, points, before=None):
        self.before = np.zeros(len(sid), dtype=np.int64) if before is None else np.asarray(before)
        self.sid, self.n, self.label, self.points = np.asarray(sid), np.asarray(n, dtype=np.int64), np.asarray(label), list(points)
        self.folded = _stack(self.points)
        self.starts = np.arange(0, len(self.sid), LEAF)
        self.boxes = np.maximum.reduceat(self.folded, self.starts)
        self.least, self.most = np.minimum.reduceat(self.n, self.starts), np.maximum.reduceat(self.n, self.starts)
        lo, hi = np.minimum.reduceat(self.label, self.starts), np.maximum.reduceat(self.label, self.starts)
        self.one, self.only = lo == hi, lo


def allowed(q, qn, box, least, most, percent: int = PERCENT):
    """Whether sets with points q and sizes qn may be linked with any set in a box: by its sizes and the summed minima."""
    fine = (100 * most >= percent * qn) & (100 * qn >= percent * least)
    return fine & fits(np.minimum(q, box).sum(axis=-1), qn, np.maximum(least, -(-percent * qn // 100)), percent)


def tree_join(left: Block, right: Block, percent: int = PERCENT, every: bool = True) -> tuple[np.ndarray, bool]:
    """Pairs of different components between two blocks, as rows (smaller sid, larger sid), found through the boxes.

    With ``every`` false, of the pairs of a node with one other component only that with the largest bound; the second
    value says whether that left pairs out.
    """
    out = []
    for k, lo in enumerate(right.starts):
        hi = min(lo + LEAF, len(right.sid))
        may = allowed(left.folded, left.n, right.boxes[k], right.least[k], right.most[k], percent)
        if right.one[k]:
            may &= left.label != right.only[k]
        at = np.flatnonzero(may)
        # two nodes with the same common key before this bucket's meet in that key's bucket
        open_ = (left.before[at][:, None] != right.before[None, lo:hi]) | (left.before[at][:, None] == 0)
        open_ &= left.label[at][:, None] != right.label[None, lo:hi]
        ln, rn = left.n[at][:, None], right.n[None, lo:hi]
        x, y = np.nonzero(open_ & fits(np.minimum(ln, rn), ln, rn, percent))
        x, y = at[x], y + lo
        if not len(x):
            continue
        bound = np.minimum(left.folded[x], right.folded[y]).sum(axis=1)
        fine = fits(np.minimum(bound, np.minimum(left.n[x], right.n[y])), left.n[x], right.n[y], percent)
        x, y = x[fine], y[fine]
        bound = overlap_bound([left.points[i] for i in x], [right.points[i] for i in y])
        fine = fits(bound, left.n[x], right.n[y], percent)
        x, y = x[fine], y[fine]
        out.append(np.stack([x, y, bound[fine] * 1000 // (left.n[x] + right.n[y])], axis=1))
    if not out:
        return np.empty((0, 2), dtype=np.int64), False
    x, y, share = np.concatenate(out).T
    found = len(x)
    if not every:
        rl = right.label[y]
        order = np.lexsort((right.sid[y], -share, rl, x))
        x, y, rl = x[order], y[order], rl[order]
        first = np.r_[True, (x[1:] != x[:-1]) | (rl[1:] != rl[:-1])][: len(x)]
        x, y = x[first], y[first]
    a, b = left.sid[x], right.sid[y]
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0), len(x) < found


_TREE = "kind INT, a BIGINT, b BIGINT, key BIGINT, least INT, most INT, label BIGINT, box BINARY"


def _pack(frames: Iterator[pd.DataFrame], percent: int, every: bool) -> Iterator[pd.DataFrame]:
    """Packs rows (key, label, n, sid, point), sorted so, into blocks and joins each block with itself.

    Rows of kind 0 are pairs (a, b) to verify; of kind 1, a bucket with pairs left out; and for buckets of
    more than one block (column ``many``; all, if there is none), of kind 2 a block a with its box, of kind 3 its members b.
    A block is named by its first member. Memory: a batch and one block.
    """
    held: list[tuple] = []  # the block being filled
    told: set[tuple] = set()  # pairs meet in many buckets; the task's latest are not told again

    def close() -> Iterator[tuple]:
        key, many = held[0][0], held[0][5]
        block = Block(*(list(c) for c in zip(*((s, n, lb, p, b) for _, lb, n, s, p, _, b in held), strict=True)))
        pairs, cut = tree_join(block, block, percent, every)
        for a, b in pairs.tolist():
            if (a, b) not in told:
                if len(told) == TOLD:
                    told.clear()
                told.add((a, b))
                yield 0, a, b, key, 0, 0, None, None
        if cut:
            yield 1, 0, 0, key, 0, 0, None, None
        if many:
            one = int(block.label[0]) if (block.label == block.label[0]).all() else None
            name = int(block.sid[0])
            yield 2, name, 0, key, int(block.n.min()), int(block.n.max()), one, block.folded.max(axis=0).astype(np.int32).tobytes()
            for s in block.sid.tolist():
                yield 3, name, s, key, 0, 0, None, None

    def table(rows):
        out = pd.DataFrame(rows, columns=["kind", "a", "b", "key", "least", "most", "label", "box"])
        out["label"] = pd.array([r[6] for r in rows], dtype="Int64")
        return out

    for frame in frames:
        out = []
        many = frame["many"].tolist() if "many" in frame else [True] * len(frame)
        before = frame["before"].tolist() if "before" in frame else [0] * len(frame)
        for row in zip(*(frame[c].tolist() for c in ("key", "label", "n", "sid", "point")), many, before, strict=True):
            if held and (row[0] != held[0][0] or len(held) == BLOCK):
                out.extend(close())
                held = []
            held.append(row)
        if out:
            yield table(out)
    if held:
        yield table(list(close()))


def _between(tree: DataFrame, labelled: DataFrame, nodes: DataFrame, percent: int, every: bool) -> DataFrame:
    """Rows of kind 0 and 1 as ``_pack`` has them, of the pairs of blocks of one bucket whose boxes allow a link."""
    boxes = tree.where("kind = 2")
    side = lambda s: boxes.select("key", F.col("a").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("least", "most", "label", "box")))
    both = side("i").join(side("j"), "key").where("i < j").where("NOT (i_label <=> j_label) OR i_label IS NULL")
    both = both.where(f"100 * i_most >= {percent} * j_least AND 100 * j_most >= {percent} * i_least")

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x, y = (np.frombuffer(b"".join(f[c]), np.int32).reshape(-1, TREE_GROUPS) for c in ("i_box", "j_box"))
            # linked sets with sizes of these ranges share at least what the smallest sizes need
            yield f.loc[fits(np.minimum(x, y).sum(axis=1), f["i_least"].to_numpy(), f["j_least"].to_numpy(), percent), ["key", "i", "j"]]

    near = both.select("key", "i", "j", "i_least", "j_least", "i_box", "j_box").mapInPandas(route, "key BIGINT, i BIGINT, j BIGINT")
    near = near.withColumn("own", F.explode(F.array("i", "j")))
    members = tree.where("kind = 3").select("key", F.col("a").alias("own"), F.col("b").alias("sid"))
    rows = near.join(members, ["key", "own"]).join(labelled.select("key", "sid", "label", "before"), ["key", "sid"]).join(nodes.select("sid", "n", "point"), "sid")

    def join(f: pd.DataFrame) -> pd.DataFrame:
        left, right = (Block(*(g[c].tolist() for c in ("sid", "n", "label", "point", "before"))) for g in (f[f["own"] == f[c]].sort_values(["label", "n", "sid"]) for c in ("i", "j")))
        pairs, cut = tree_join(left, right, percent, every)
        if not every:  # the likeliest partners of either side
            back, cut_back = tree_join(right, left, percent, every)
            pairs, cut = np.concatenate([pairs, back]), cut or cut_back
        out = pd.DataFrame(pairs, columns=["a", "b"]).assign(kind=0, key=f["key"].iloc[0])[["kind", "a", "b", "key"]]
        return pd.concat([out, pd.DataFrame({"kind": [1], "a": [0], "b": [0], "key": [f["key"].iloc[0]]})]) if cut else out

    return rows.groupBy("key", "i", "j").applyInPandas(join, "kind INT, a BIGINT, b BIGINT, key BIGINT")


def _size_class(n: Column, percent: int) -> Column:
    """A number that differs by 1 at most between linked sets of n shingles, whose sizes differ by a factor of 100 / percent at most."""
    return n if percent >= 100 else F.floor(F.log(n.cast("double")) / (1.000001 * math.log(100 / percent)))


def _across(members: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int, every: bool) -> tuple[DataFrame, DataFrame] | None:
    """Candidate pairs between components that meet in a large bucket, and the buckets with pairs left out; None if there are none."""
    labelled = members.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    labelled = cut_lineage(labelled.withColumn("class", _size_class(F.col("n"), percent)))
    # a partner is of the node's size class or the next on either side; only nodes that have one of another component there go on
    lo_hi = lambda c, lo, hi: (F.min(lo).alias(f"lo_{c}"), F.max(hi).alias(f"hi_{c}"))
    seen = labelled.groupBy("key", "class").agg(*lo_hi("label", "label", "label"), *lo_hi("before", "before", "before"))
    near = seen.withColumn("class", F.explode(F.array(*((F.col("class") + d).alias("class") for d in (-1, 0, 1)))))
    seen = near.groupBy("key", "class").agg(*lo_hi("label", "lo_label", "hi_label"), *lo_hi("before", "lo_before", "hi_before"))
    # where all have the same common key before this one, its bucket holds them all and finds their pairs
    seen = seen.where("lo_label <> hi_label").where("lo_before <> hi_before OR lo_before = 0")
    open_ = cut_lineage(seen.select("key", "class"))
    if open_.limit(1).count() == 0:
        return None
    labelled = cut_lineage(labelled.join(open_, ["key", "class"], "left_semi"))
    rows = _blocks(labelled).join(nodes.select("sid", "point"), "sid")
    # one block a group, whatever the number of tasks: blocks of a bucket that meet are as few as its size allows
    order = ["key", "block", "class", "label", "n", "sid"]
    # their rows are few bytes and much work, so Spark is not left to join small tasks
    spark = members.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    tree = rows.repartition(tasks, "key", "block").sortWithinPartitions(*order).select("key", "label", "n", "sid", "point", "many", "before")
    tree = cut_lineage(tree.mapInPandas(lambda f: _pack(f, percent, every), _TREE))
    found = tree.where("kind < 2").select("kind", "a", "b", "key").union(_between(tree, labelled, nodes, percent, every))
    found = cut_lineage(found.select("kind", "a", "b", F.when(F.col("kind") == 1, F.col("key")).alias("key")).distinct())
    return found.where("kind = 0").select("a", "b"), found.where("kind = 1").select("key")


def _blocks(labelled: DataFrame) -> DataFrame:
    """Adds ``block``, the number of a member's block in its bucket, and ``many``: the bucket has more than one.

    Members are numbered by size class and component, since sets of a class are linked with sets of this and the next classes
    alone: few blocks of a bucket meet. Every block but a bucket's last has BLOCK members.
    """
    large = cut_lineage(labelled.groupBy("key").count().where(F.col("count") > BLOCK).select("key"))
    none = {"block": F.lit(0).cast("bigint"), "many": F.lit(False)}
    if large.limit(1).count() == 0:
        return labelled.withColumns(none)
    order = ["key", "class", "label", "n", "sid"]
    # dealt by ranges of the whole order: a large bucket spreads over as many tasks as it needs
    placed = places(labelled.join(small(large), "key", "left_semi").repartitionByRange(*order).sortWithinPartitions(*order))
    runs = placed.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = cut_lineage(runs.select("key", "part", "first", (F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")).alias("ahead")))
    placed = placed.join(small(runs), ["key", "part"])
    placed = placed.withColumns({"block": F.floor((F.col("ahead") + F.col("at") - F.col("first")) / BLOCK), "many": F.lit(True)})
    rest = labelled.join(small(large), "key", "left_anti").withColumns(none)
    return rest.unionByName(placed.select(*rest.columns))


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return _components(docs, percent).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """``jaccard_components`` with th, a hash of the text, and group, which two groups never share even if their smallest ids are equal."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    rows = cut_lineage(nodes_of(docs, percent))
    nodes = cut_lineage(
        rows.where("sid IS NOT NULL AND keys IS NOT NULL").groupBy("sid").agg(F.first("n").alias("n"), F.first("point").alias("point"), F.min("th").alias("th"))
    )
    keys = rows.where("keys IS NOT NULL").select("sid", "n", "keys", "rare", F.posexplode("keys").alias("at", "key"))
    # the common key that stands before a common key in a node's order; 0 for others
    before = F.when(F.col("at") > F.col("rare"), F.get("keys", F.col("at") - 1)).otherwise(0)
    keys = keys.select("sid", "n", "key", before.alias("before"))
    met = keys.repartition("key").sortWithinPartitions("key", "n", "sid").mapInPandas(lambda f: _meet(f, percent), "kind INT, a BIGINT, b BIGINT, before BIGINT, n INT")
    met = cut_lineage(met.dropDuplicates(["kind", "a", "b"]))
    pairs = met.where("kind = 0").select("a", "b")
    links = cut_lineage(_verify(cut_lineage(_bound(pairs, nodes, percent)), docs, nodes, percent))
    labels = components(links)
    members = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("sid"), "before", "n")
    for every in (False, True):  # first the likeliest pair of a node with each component, then all that is left
        more = _across(members, labels, nodes, percent, every)
        if more is None:
            break
        pairs, left_out = more
        found = cut_lineage(_verify(pairs, docs, nodes, percent))
        members = members.join(left_out, "key", "left_semi")
        if found.limit(1).count():
            links = links.union(found)
            labels = components(links)
    per_set = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = cut_lineage(per_set.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid")))
    groups = named.groupBy("label").agg(F.min("least").alias("component_id"))
    final = cut_lineage(named.join(groups, "label").select("sid", "label", "component_id"))
    return rows.select("doc_id", "th", "sid", "n").join(final, "sid", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "th", F.coalesce("label", "th").alias("group")
    )


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of one document of each group: that with the smallest doc_id. Rows without doc_id stay.

    Of several rows of a group with that doc_id, one stays (the smallest by a hash of the row). Rows with one doc_id in
    different groups are judged each in its own.
    """
    found = cut_lineage(_components(docs, percent).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "th", "group", "component_id"))
    of = lambda t: (docs["doc_id"].cast("bigint") == t["id"]) & (F.xxhash64(docs["text"].cast("string")) == t["th"])
    drop = small(cut_lineage(found.where("component_id <> id").select("id", "th").distinct()))
    kept = found.where("component_id = id")
    many = kept.groupBy("id", "group").agg(F.count("*").alias("n")).where("n > 1").select("id", "group")
    twice = cut_lineage(kept.join(many, ["id", "group"]).select("id", "th", "group").distinct())
    left = docs.join(drop, of(drop), "left_anti")
    if twice.limit(1).count() == 0:
        return left
    twice = small(twice)
    same = docs.join(twice, of(twice)).select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), twice["id"], twice["group"])
    first = same.groupBy("id", "group").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return left.join(twice, of(twice), "left_anti").unionByName(first)
