"""Spelling variants: words that differ by one code point, found through a variable-length gram index.

1. Words and their counts come from DataFrame functions over the whole texts.
2. Gram dictionary. A word is written as ``^word$``. A gram of 2 to ``LONGEST`` letters is frequent if it stands more than T
   times in the words; T is at least ``FREQUENT`` and as high as keeps the frequent grams, which all tasks hold, to at most
   ``DICTIONARY`` whatever the input. From every place a word's gram is the shortest one that is not frequent (or has
   ``LONGEST`` letters, or ends the word), so it depends on its own letters only.
3. Bounds. One edit at letter i can only change the grams that cover i; the most grams that cover one letter are a word's
   affected grams A. Two near words therefore share all but A of each one's grams, those left of the edit at the same
   place from the start, those right of it at the same place from the end. In the order of rarity (count, then letters,
   then place) the rarest shared gram is among the first A + 1 of both: only those are indexed, once by each place, and
   the other (longest) lists are never merged.
4. Merging. Lists of at most ``LIST`` words are compared within, by length and a sum of letter values that one edit changes
   by one letter's value or the difference of two; what is left is compared letter by letter. Words of longer lists meet
   by hashes of the word without one letter instead (rows in proportion to their letters, groups of at most one word a
   letter of the alphabet), and are compared likewise. Nothing is left out.

Results: texts and tables that are null or empty give no words; a null key counts as an empty one in the hash that picks
the letter to delete. Repeated rows count again. Further columns are not read. Texts and words may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.wordhash import mix
from postlake.session import cut_lineage

SHORTEST_WORD, LEAST_COUNT, DELETE_EVERY, RATIO = 7, 2, 31, 10
LONGEST, FREQUENT, DICTIONARY = 5, 64, 250_000
LIST = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PART = 20_000
_COUNTED = 200_000  # grams that a task counts before it hands them on
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)  # one number a letter
_BASE = np.uint64(0x2545F4914F6CDD1D)
_TOP = np.uint64(44)
_BACK = np.uint64(pow(0x2545F4914F6CDD1D, -1, 2**64))


def words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of at least SHORTEST_WORD letters and LEAST_COUNT occurrences."""
    runs = df.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([A-Za-zÀ-ÿ]{{{SHORTEST_WORD},}})"), F.lit(1))).alias("run"))
    runs = runs.select("key", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "key", "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2, length(run))"))
    word = F.when(F.col("h") % DELETE_EVERY == 0, cut).otherwise(F.col("run")).alias("word")
    made = runs.withColumn("h", h).withColumn("at", at).select(word).where(F.length("word") >= SHORTEST_WORD)
    return made.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        yield from batch.column(0).to_pylist()


def _spread(df: DataFrame, rows: int, name: str = "word") -> DataFrame:
    """Rows dealt to a Python step in parts of about PART, however few files hold them."""
    return df.repartition(rows // PART + 1, name)


def frequent_grams(vocabulary: DataFrame) -> dict[str, int]:
    """The grams of 2 to LONGEST letters that stand more than T times in the words, at most DICTIONARY of them."""

    def count(batches):
        counts: dict[str, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())], names=["gram", "n"])

        for word in _strings(batches):
            padded = f"^{word}$"
            for p in range(len(word) + 1):
                for gram in {padded[p : p + size] for size in range(2, LONGEST + 1)}:
                    counts[gram] = counts.get(gram, 0) + 1
                if len(counts) >= _COUNTED:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    places, rows = vocabulary.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0)), F.count(F.lit(1))).first()
    least = max(FREQUENT, places * (LONGEST - 1) // DICTIONARY)
    counts = _spread(vocabulary.select("word"), rows).mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    table = counts.where(F.col("n") > least).toArrow()
    return dict(zip(table["gram"].to_pylist(), table["n"].to_pylist(), strict=True))


def grams(word: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """(place, gram) from every place of ``^word$`` that has two letters left."""
    padded, out = f"^{word}$", []
    end = len(padded)
    for p in range(end - 1):
        size = 2
        while size < LONGEST and p + size < end and padded[p : p + size] in frequent:
            size += 1
        out.append((p, padded[p : p + size]))
    return out


def affected(word: str, parts: list[tuple[int, str]]) -> int:
    """The most grams that cover one letter of the word: no single edit changes more."""
    change = [0] * (len(word) + 3)
    for p, gram in parts:
        change[p] += 1
        change[p + len(gram)] -= 1
    most, now = 0, change[0]
    for at in range(1, len(word) + 1):
        now += change[at]
        most = max(most, now)
    return most


def indexed(word: str, frequent: dict[str, int]) -> list[str]:
    """The keys of a word: its first affected + 1 grams in the order of rarity, by their places from either end."""
    parts = grams(word, frequent)
    first = nsmallest(affected(word, parts) + 1, ((frequent.get(g, 0), g, p) for p, g in parts))
    keys = []
    for _, gram, p in first:
        if not gram.endswith("$"):
            keys.append(f"{gram}<{p}")
        if not gram.startswith("^"):
            keys.append(f"{gram}>{len(word) - p}")
    return keys


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def _postings(vocabulary: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """(key, word, n, total): the index, and the sum of the word's letter values."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        known = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                keys, rows, totals = [], [], []
                for k, word in enumerate(part.column(0).to_pylist()):
                    found = indexed(word, known)
                    keys += found
                    rows += [k] * len(found)
                    totals.append(int(_VALUE[np.frombuffer(word.encode("latin-1"), np.uint8)].sum()))
                at = pa.array(rows, type=pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, type=pa.string()), part.column(0).take(at), part.column(1).take(at), pa.array(totals, type=pa.int64()).take(at)],
                    names=["name", "word", "n", "total"])

    made = _spread(vocabulary, vocabulary.count()).mapInArrow(run, "name string, word string, n bigint, total bigint")
    return made.select(F.xxhash64("name").alias("key"), "word", "n", "total")


PAIRS = "a string, n_a bigint, b string, n_b bigint"


def _one_letter() -> np.ndarray:
    """All differences of the letter sums of two words that are one edit apart, sorted."""
    return np.unique(np.r_[_VALUE, -_VALUE, (_VALUE[:, None] - _VALUE[None, :]).ravel()])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words within each list of an index that is sorted by key."""
    edits = _one_letter()
    likely = np.zeros(1 << 20, bool)  # by 20 bits of a difference, whether it may be one of the edits'
    likely[edits.view(np.uint64) >> _TOP] = True

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, total = table["key"].to_numpy(), table["total"].to_numpy()
        words, n = table["word"].to_pylist(), table["n"].to_numpy()
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.r_[np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(len(key))
        at, step, a, b = np.arange(len(key)), 0, [], []
        while True:
            step += 1
            at = at[left[at] > step]
            if not len(at):
                break
            diff = total[at] - total[at + step]
            some = likely[diff.view(np.uint64) >> _TOP]
            near, diff = at[some], diff[some]
            place = np.minimum(np.searchsorted(edits, diff), len(edits) - 1)
            for i in near[(np.abs(size[near] - size[near + step]) <= 1) & (edits[place] == diff)].tolist():
                x, y = words[i], words[i + step]
                if one_edit(x, y):
                    swap = x > y
                    a.append(i + step if swap else i)
                    b.append(i if swap else i + step)
        if a:
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in a], type=pa.string()), pa.array(n[a]), pa.array([words[i] for i in b], type=pa.string()), pa.array(n[b])],
                names=["a", "n_a", "b", "n_b"])

    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        table = part if held is None else pa.concat_tables([held, part])
        key = table["key"].to_numpy()
        whole = int(np.searchsorted(key == key[-1], True)) if len(key) else 0  # the last list may go on
        if whole:
            yield from compare(table.slice(0, whole))
        held = table.slice(whole)
    if held is not None and held.num_rows:
        yield from compare(held)


def _without_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, kind, id): hashes of every word without one letter, with (0) and without (1) the place, and of the word (2)."""
    for batch in batches:
        for word, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            value = _VALUE[np.frombuffer(word.encode("latin-1"), np.uint8)].astype(np.uint64)
            power = np.cumprod(np.r_[np.uint64(1), np.full(len(value) - 1, _BASE)], dtype=np.uint64)
            sums = np.r_[np.uint64(0), np.cumsum(value * power, dtype=np.uint64)]
            rest = sums[:-1] + (sums[-1] - sums[1:]) * _BACK
            place = np.arange(1, len(value) + 1, dtype=np.uint64)
            keys = np.concatenate([mix(mix(rest) + place), mix(rest), mix(sums[-1:])]).view(np.int64)
            kinds = np.repeat(np.array([0, 1, 2], np.int8), [len(value), len(value), 1])
            for lo in range(0, len(keys), 1 << 18):
                some = keys[lo : lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(kinds[lo : lo + len(some)]), pa.array(np.full(len(some), name))], names=["key", "kind", "id"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [one_edit(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield batch.filter(pa.array(near, type=pa.bool_()))


def _of_long_lists(crowded: DataFrame) -> DataFrame:
    """Near pairs among the words (word, n) of lists that are too long to be compared within."""
    words = cut_lineage(crowded.withColumn("id", F.xxhash64("word")))
    cut = cut_lineage(_spread(words.select("word", "id"), words.count()).mapInArrow(_without_one, "key bigint, kind byte, id bigint"))
    same, less, full = (cut.where(F.col("kind") == k).select("key", F.col("id").alias(n)) for k, n in ((0, "a"), (1, "a"), (2, "b")))
    met = same.join(same.withColumnRenamed("a", "b"), "key").where("a < b").union(less.join(full, "key").where("a <> b"))
    ids = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = words.select(F.col("id").alias("a"), F.col("word").alias("x"), F.col("n").alias("n_x"))
    second = words.select(F.col("id").alias("b"), F.col("word").alias("y"), F.col("n").alias("n_y"))
    both = ids.join(first, "a").join(second, "b")
    small = F.struct(F.col("x").alias("w"), F.col("n_x").alias("n"))
    large = F.struct(F.col("y").alias("w"), F.col("n_y").alias("n"))
    ordered = both.select(F.least(small, large).alias("s"), F.greatest(small, large).alias("l"))
    return ordered.select(F.col("s.w").alias("a"), F.col("s.n").alias("n_a"), F.col("l.w").alias("b"), F.col("l.n").alias("n_b")).mapInArrow(_verified, PAIRS)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of near words of a written table (word, n) once, a before b."""
    postings = cut_lineage(_postings(vocabulary, frequent_grams(vocabulary)))
    long_lists = cut_lineage(postings.groupBy("key").count().where(F.col("count") > LIST).select("key"))
    short = postings.join(long_lists, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    pairs = short.select("key", "word", "n", "total").mapInArrow(_merge, PAIRS)
    if not long_lists.isEmpty():
        crowded = postings.join(long_lists, "key", "left_semi").select("word", "n").distinct()
        pairs = pairs.union(_of_long_lists(crowded))
    return pairs.distinct()


def variants(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word, its near words and the forms that it is a variant of."""
    vocabulary = cut_lineage(words(df, key, text))
    pairs = cut_lineage(near_pairs(vocabulary))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_of")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_of")).alias("less"), "near")).alias("best"))
    joined = vocabulary.join(best, "word", "left")
    frequent_enough = -F.col("best.less") >= RATIO * F.col("n")
    formed = cut_lineage(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(frequent_enough, F.col("best.near")).alias("form"), F.when(frequent_enough, -F.col("best.less")).alias("form_n")))
    roots = _roots(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """The last word of every chain of links. Counts grow RATIO-fold a link, so chains are short and the rounds few."""
    links = cut_lineage(links)
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        longer = links.join(onward, "root", "left")
        if longer.where("onward IS NOT NULL").isEmpty():
            return links
        links = cut_lineage(longer.select("word", F.coalesce("onward", "root").alias("root")))
