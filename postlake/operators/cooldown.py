"""Acceptance with a time-to-live: an event is accepted when no accepted event of its key is younger than the TTL.

Denied events leave no trace, so the rule is a chain: the next accepted event is the first one at or
after ``accepted + ttl``. Instead of folding a key's events in one task, or following next-event pointers
round by round, a key's time is cut into chunks of ``CHUNK`` TTLs and each chunk is turned into a function:

1. *Exit maps.* Whatever came before a chunk, it is entered within the first TTL of it, or by its first
   event. For each of these entries the chunk computes the last event that its chain accepts in it.
   Neighbouring entries with one exit are one step of the map.
2. *Up.* Maps of ``FAN`` neighbouring chunks are composed as functions, and so on until one map spans a
   key; the rounds are the logarithm to the base ``FAN`` of the number of chunks, mostly none or one.
3. *Down.* From the top each span hands its chunks the accepted event that was in force before them.
4. Every chunk then marks its own events from that entry on.

No task holds more of a key than one chunk's events or the steps of ``FAN`` maps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions.dates import from_micros, micros
from postlake.session import cut_lineage

CHUNK, FAN = 16, 32


def with_accepted(df: DataFrame, key: str, ts: str, id_col: str, ttl_seconds: Column) -> DataFrame:
    """Adds ``accepted`` and ``last_accepted_at`` (the accepted event that was in force before the row).

    The TTL belongs to the key: all rows of a key have the same. Rows without a time are not accepted.
    """
    rows = df.withColumns({"_us": micros(F.col(ts)), "_ttl": ttl_seconds.cast("bigint") * 1_000_000})
    rows = rows.withColumn("_len", F.greatest("_ttl", F.lit(1)) * CHUNK)
    begin, end, least = rows.agg(F.min("_us"), F.max("_us"), F.min("_len")).first()
    begin = begin or 0
    rows = rows.withColumn("_chunk", F.expr(f"(_us - {begin}L) div _len"))
    levels, spanned = 0, ((end or 0) - begin) // (least or 1) + 1
    while FAN**levels < spanned:
        levels += 1
    entries = _entries(rows, key, begin, levels) if levels else None
    out = _marked(rows, entries, key, id_col)
    return out.withColumn("last_accepted_at", from_micros(F.col("_last"))).drop("_us", "_ttl", "_len", "_chunk", "_last")


def _entries(rows: DataFrame, key: str, begin: int, levels: int) -> DataFrame:
    """(key, _chunk, _at): the event in force before every chunk that has one."""
    events = rows.where("_us IS NOT NULL").select(key, "_chunk", "_us", "_ttl", "_len").repartition(key, "_chunk")
    schema = T.StructType([
        T.StructField(key, rows.schema[key].dataType),
        *[T.StructField(c, T.LongType()) for c in ("_chunk", "_entry", "_at", "_ttl", "_len")],
    ])
    maps = [cut_lineage(events.sortWithinPartitions(key, "_chunk", "_us").mapInArrow(lambda b: _exit_maps(b, begin), schema))]
    for _ in range(levels - 1):
        wider = maps[-1].withColumns({"_span": F.expr(f"_chunk div {FAN}"), "_len": F.col("_len") * FAN}).repartition(key, "_span")
        ordered = wider.select(key, "_span", "_chunk", "_entry", "_at", "_ttl", "_len").sortWithinPartitions(key, "_span", "_chunk", "_entry")
        maps.append(cut_lineage(ordered.mapInArrow(lambda b: _composed(b, begin), schema)))
    inside = T.StructType([schema[0], T.StructField("_chunk", T.LongType()), T.StructField("_at", T.LongType())])
    known = None
    for level in reversed(maps):
        spans = level.select(key, F.expr(f"_chunk div {FAN}").alias("_span"), "_chunk", "_entry", "_at", "_ttl")
        if known is not None:
            none = F.lit(None).cast("bigint")
            spans = spans.unionByName(known.select(key, F.col("_chunk").alias("_span"), none.alias("_chunk"), none.alias("_entry"), "_at", none.alias("_ttl")))
        ordered = spans.repartition(key, "_span").sortWithinPartitions(key, "_span", F.col("_chunk").asc_nulls_first(), "_entry")
        known = ordered.mapInArrow(_handed_down, inside)
    return known


def _marked(rows: DataFrame, entries: DataFrame | None, key: str, id_col: str) -> DataFrame:
    """The rows with ``accepted`` and ``_last``, each chunk from its entry on."""
    all_rows = rows.withColumns({"_at": F.lit(None).cast("bigint"), "_row": F.lit(1)})
    if entries is not None:
        all_rows = all_rows.unionByName(entries.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    ordered = all_rows.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", "_row", "_us", id_col)
    schema = T.StructType([*rows.schema, T.StructField("accepted", T.BooleanType()), T.StructField("_last", T.LongType())])
    return ordered.mapInArrow(lambda b: _accepted(b, key), schema)


def _groups(batches: Iterator[pa.RecordBatch], names: int | list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of the sorted rows with the offsets of their groups.

    ``names``: the columns of a group, or how many of the first ones. Held back is one group at most.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        offsets = _offsets(table, names)
        if len(offsets) > 2:
            yield table.slice(0, offsets[-2]), offsets[:-1]
        held = table.slice(offsets[-2])
    if held is not None:
        yield held, _offsets(held, names)


def _offsets(table: pa.Table, names: int | list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in table.column_names[:names] if isinstance(names, int) else names:
        code = table[name].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.r_[np.flatnonzero(new), table.num_rows]


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)


def _steps(entry: np.ndarray, at: np.ndarray, until: int) -> slice | np.ndarray:
    """Of a map's entries, those before ``until`` and the first after it; of neighbours with one exit, the last."""
    n = min(int(np.searchsorted(entry, until)) + 1, len(entry))
    return np.flatnonzero(np.r_[at[1:n] != at[: n - 1], True])


def _exit_maps(batches: Iterator[pa.RecordBatch], begin: int) -> Iterator[pa.RecordBatch]:
    for table, offsets in _groups(batches, 2):
        us, ttl, length, chunk = (_numbers(table, c) for c in ("_us", "_ttl", "_len", "_chunk"))
        rows, entries, exits = [], [], []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            t = np.unique(us[lo:hi])
            onward = np.maximum(np.searchsorted(t, t + ttl[lo]), np.arange(1, len(t) + 1)).tolist()
            at = t.tolist()
            for i in range(len(at) - 1, -1, -1):
                if onward[i] < len(at):
                    at[i] = at[onward[i]]
            at = np.array(at)
            kept = _steps(t, at, begin + chunk[lo] * length[lo] + ttl[lo])
            rows.append(np.full(len(kept), lo))
            entries.append(t[kept])
            exits.append(at[kept])
        yield _map_rows(table, rows, entries, exits, table["_chunk"])


def _map_rows(table: pa.Table, rows: list, entries: list, exits: list, chunk) -> pa.RecordBatch:
    of = pa.array(np.concatenate(rows))
    columns = [table.column(0).take(of), chunk.take(of), pa.array(np.concatenate(entries)), pa.array(np.concatenate(exits)), table["_ttl"].take(of), table["_len"].take(of)]
    out = pa.table(columns, names=[table.column_names[0], "_chunk", "_entry", "_at", "_ttl", "_len"])
    return out.combine_chunks().to_batches()[0]


def _children(chunk: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    cuts = [lo, *(np.flatnonzero(chunk[lo + 1 : hi] != chunk[lo : hi - 1]) + lo + 1).tolist(), hi]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def _composed(batches: Iterator[pa.RecordBatch], begin: int) -> Iterator[pa.RecordBatch]:
    """One map of every span: its chunks' maps applied one after the other."""
    for table, offsets in _groups(batches, 2):
        chunk, entry, at, ttl, length, span = (_numbers(table, c) for c in ("_chunk", "_entry", "_at", "_ttl", "_len", "_span"))
        rows, entries, exits = [], [], []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            until = begin + span[lo] * length[lo] + ttl[lo]
            e, x = np.empty(0, np.int64), np.empty(0, np.int64)
            for a, b in _children(chunk, lo, hi):
                place = np.searchsorted(entry[a:b], x + ttl[lo])
                on = place < b - a
                x[on] = at[a:b][place[on]]
                if not len(e) or e[-1] < until:
                    e, x = np.r_[e, entry[a:b]], np.r_[x, at[a:b]]
            kept = _steps(e, x, until)
            rows.append(np.full(len(kept), lo))
            entries.append(e[kept])
            exits.append(x[kept])
        yield _map_rows(table, rows, entries, exits, table["_span"])


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the event in force before a span (its first row, if any), that before each of its chunks."""
    for table, offsets in _groups(batches, 2):
        chunk, entry, at, ttl = (_numbers(table, c) for c in ("_chunk", "_entry", "_at", "_ttl"))
        given = table["_chunk"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        rows, force = [], []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            last = None
            if given[lo]:
                last, lo = int(at[lo]), lo + 1
            for a, b in _children(chunk, lo, hi) if lo < hi else ():
                place = 0
                if last is not None:
                    rows.append(a)
                    force.append(last)
                    place = int(np.searchsorted(entry[a:b], last + int(ttl[a])))
                if place < b - a:
                    last = int(at[a + place])
        of = pa.array(rows, type=pa.int64())
        out = pa.table([table.column(0).take(of), table["_chunk"].take(of), pa.array(force, type=pa.int64())], names=[table.column_names[0], "_chunk", "_at"])
        yield from out.combine_chunks().to_batches()


def _accepted(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    for table, offsets in _groups(batches, [key, "_chunk"]):
        us, ttl, at = (_numbers(table, c) for c in ("_us", "_ttl", "_at"))
        entry = _numbers(table, "_row") == 0
        timed = table["_us"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        yes, last = np.zeros(table.num_rows, bool), np.zeros(table.num_rows, np.int64)
        has = np.zeros(table.num_rows, bool)
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            now = None
            if entry[lo]:
                now, lo = int(at[lo]), lo + 1
            if lo == hi or not timed[lo]:
                continue
            t, wait = us[lo:hi], int(ttl[lo])
            i = 0 if now is None else int(np.searchsorted(t, now + wait))
            if now is not None:
                until = min(lo + i + 1, hi)
                last[lo:until], has[lo:until] = now, True
            while i < hi - lo:
                yes[lo + i], now = True, int(t[i])
                onward = max(i + 1, int(np.searchsorted(t, now + wait)))
                until = min(lo + onward + 1, hi)
                last[lo + i + 1 : until], has[lo + i + 1 : until] = now, True
                i = onward
        columns = [c for c in table.column_names if c not in ("_at", "_row")]
        out = table.select(columns).append_column("accepted", pa.array(yes)).append_column("_last", pa.array(last, mask=~has))
        yield from out.filter(pa.array(~entry)).combine_chunks().to_batches()
