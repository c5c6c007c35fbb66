"""Word hashes of batches of texts, as numpy arrays.

Words are runs of bytes other than tab, newline, vertical tab, form feed, return and space; A-Z is
lower-cased. A text of None has no words. Everything works on whole texts, in slices of about
a megabyte, so a task's memory follows the slice and its longest text, not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S32)) * _A
    x = (x ^ (x >> _S29)) * _B
    return x ^ (x >> _S32)


def slices(frame: pd.DataFrame, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pd.DataFrame]:
    """Consecutive parts of a frame with about ``limit`` characters each."""
    size = frame[text].str.len().fillna(0).to_numpy(dtype=np.int64) + 64
    part = np.cumsum(size) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(frame)], strict=True):
        if hi > lo:
            yield frame.iloc[lo:hi]


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the words of text i are ``hashes[offsets[i]:offsets[i + 1]]``."""
    encoded = [t.encode("utf-8", "surrogatepass").lower() if isinstance(t, str) else b"" for t in texts]
    begins = np.cumsum([0] + [len(b) + 1 for b in encoded])
    data = np.frombuffer(b" " + b" ".join(encoded) + b" " * 9, dtype=np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
    lanes = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), shape=(len(data) - 7,), strides=(1,))
    hashes = lengths.astype(np.uint64) * _B
    todo = np.arange(len(starts))
    lane = 0
    while len(todo):
        rest = lengths[todo] - 8 * lane
        piece = lanes[starts[todo] + 8 * lane] & _KEEP[np.minimum(rest, 8)]
        hashes[todo] = mix(hashes[todo] ^ (piece + np.uint64(lane)) * _A)
        todo = todo[rest > 8]
        lane += 1
    return hashes, np.searchsorted(starts, begins + 1)


_STEP = np.array([pow(0x2545F4914F6CDD1D, i + 1, 2**64) for i in range(64)], dtype=np.uint64)


def gram_hashes(hashes: np.ndarray, places: list[int] | range, salt: int = 0) -> np.ndarray:
    """For every start i, one hash of the words at i + p for the given places p (ascending).

    Starts run over all of ``hashes`` as if it were one text; the caller drops those that cross a text's end.
    """
    n = len(hashes) - places[-1]
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, np.uint64(salt * 0x632BE5AB), dtype=np.uint64)
    for k, p in enumerate(places):
        total += hashes[p : p + n] * _STEP[k]
    return mix(total)


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; with fewer words, the whole sequence as one."""
    grams = gram_hashes(hashes, range(k))
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        if hi - lo >= k:
            yield np.unique(grams[lo : hi - k + 1])
        elif hi > lo:
            yield gram_hashes(hashes[lo:hi], range(hi - lo), salt=hi - lo)
        else:
            yield np.empty(0, dtype=np.uint64)
