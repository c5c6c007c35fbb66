"""BPE encoding by backtracking, and decoding by an offset table.

A vocabulary is a public tokenizer file (JSON: merges, byte-level symbols, a suffix on a word's last symbol). Its path is
a parameter; the driver reads the file and sends its text (a few megabytes, whatever the input) to the tasks, so executors
need no copy of it.

Encoding. A word is a string over 512 symbols (a byte, or a byte that ends the word). An Aho-Corasick automaton of the
reversed tokens gives the longest token from every position in one pass. From the left, the longest token is taken if it is
compatible with the token before it, else its next shorter prefix that is a token; where none is left, the last token is
taken back and its end is marked as a dead end, so each position is given up once and the work is linear in the word. Two
tokens are compatible if no merge would cross their boundary before both were complete; a sequence with compatible
neighbours only is the one that the merges give. Tokens that the merges never produce are left out.

Text is normalised as the file says (NFC, white space, lower case), cut at white space, then into words by the file's
pattern; words are encoded once per task and kept (a bounded table). Texts are read in pieces cut at white space, so
memory follows the piece, the longest run without white space and the ids of one text.

Results: None and empty texts have no ids and decode to the empty text. Rows that repeat give their rows again. Only the
key and the text column are read, so further columns, whatever their names, do not matter. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 1 << 18  # characters that are read at once; pieces end at white space
OUT_CHARS = 1 << 21  # characters of text behind one batch of results
KEPT_WORDS = 400_000  # runs whose ids a task keeps: those of the latest so many, and of the so many before them
KEPT_PAIRS = 1_000_000  # token pairs whose compatibility a task keeps
BASE = 512  # symbols: a byte, or 256 + a byte that ends the word

# Scripts in which the installed Unicode tables and the tokenizers library agree (tested code point by code point);
# pieces with other characters are normalised and cut by the library's own normaliser and pattern.
_OTHER = regex.compile("[^\\x00-\\x1b\\x20-ԯḀ-῿ -⁯₠-₿℀-↋←-⏿　-〿ぁ-ゖァ-ヾ一-龥가-힣]")
_SPACE = re.compile(r"[\t\n\x0b\x0c\r ]")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """The tables of one tokenizer file. Tokens are numbered by rank: the 512 symbols, then the merges in order."""

    def __init__(self, text: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        spec = json.loads(text)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.library = Tokenizer.from_str(text)
        self.words_of = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.letters = _byte_letters()
        ids, symbols = model["vocab"], {}
        for letter, byte in self.letters.items():
            symbols[letter], symbols[letter + suffix] = chr(byte), chr(256 + byte)
        rank = {name: ord(s) for name, s in symbols.items()}
        strings = [""] * BASE
        self.id_of = [0] * BASE
        for name, r in rank.items():
            strings[r], self.id_of[r] = symbols[name], ids[name]
        self.left, self.right, self.pair = list(range(BASE)), list(range(BASE)), {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if a + b in rank:
                raise ValueError(f"two merges give {a + b!r}")
            rank[a + b] = r = len(strings)
            strings.append(strings[rank[a]] + strings[rank[b]])
            self.id_of.append(ids[a + b])
            self.left.append(rank[a])
            self.right.append(rank[b])
            self.pair[rank[a] << 32 | rank[b]] = r
        self.known: dict[int, bool] = {}
        made = [True] * BASE
        for r in range(BASE, len(strings)):
            a, b = self.left[r], self.right[r]
            made.append(made[a] and made[b] and self._uncrossed(a, b, r))
        numbers = {s: r for r, s in enumerate(strings) if made[r]}
        self.size = [len(s) for s in strings]
        self.shorter = [-1] * len(strings)
        longest, greedy = ahocorasick.Automaton(), ahocorasick.Automaton()
        for s, r in numbers.items():
            longest.add_word(s[::-1], r)
            greedy.add_word(s, r)
            for n in range(len(s) - 1, 0, -1):
                if s[:n] in numbers:
                    self.shorter[r] = numbers[s[:n]]
                    break
        longest.make_automaton()
        greedy.make_automaton()
        self.longest, self.greedy = longest, greedy
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.added = added
        self.added_re = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        names = {i: n for n, i in {**ids, **added}.items()}
        coded = [(names[i] + " ").encode() if i in names else b"" for i in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(coded), dtype=np.uint8)
        self.offsets = np.cumsum([0] + [len(c) for c in coded])
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _uncrossed(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of a rank below ``limit`` crosses the boundary of a and b while they are made.

        The merges are undone from the latest on. A crossing merge is done before the one that made the left token
        if its rank is lower, before the one that made the right token if it is lower or equal (it stands further left).
        """
        pair, left, right = self.pair, self.left, self.right
        while True:
            crossing = pair.get(a << 32 | b)
            if crossing is not None and crossing < limit:
                return False
            if a > b:
                if a < BASE:
                    return True
                limit, a = a, right[a]
            else:
                if b < BASE:
                    return True
                limit, b = b + 1, left[b]

    def compatible(self, a: int, b: int) -> bool:
        known, key = self.known, a << 32 | b
        answer = known.get(key)
        if answer is None:
            if len(known) >= KEPT_PAIRS:
                known.clear()
            answer = known[key] = self._uncrossed(a, b, len(self.left))
        return answer

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word, given as bytes: its longest tokens from the left if they are compatible, else by backtracking."""
        compatible, ids = self.compatible, self.id_of
        taken = [r for _, r in self.greedy.iter_long(word[:-1].decode("latin-1") + chr(256 + word[-1]))]
        for k in range(1, len(taken)):
            if not compatible(taken[k - 1], taken[k]):
                break
        else:
            return [ids[r] for r in taken]
        return [ids[r] for r in self._backtrack(word)]

    def _backtrack(self, word: bytes) -> array:
        n = len(word)
        symbols = chr(256 + word[-1]) + word[-2::-1].decode("latin-1")
        size, shorter, compatible = self.size, self.shorter, self.compatible
        reach = array("i", bytes(4 * n))
        for end, r in self.longest.iter(symbols):
            start = n - 1 - end
            if size[r] >= size[reach[start]]:
                reach[start] = r
        dead = bytearray(n + 1)
        taken = array("i")
        at, token = 0, reach[0]
        while True:
            end = at + size[token]
            if not dead[end] and (not taken or compatible(taken[-1], token)):
                taken.append(token)
                if end == n:
                    break
                at, token = end, reach[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = taken.pop()
                at -= size[token]
        return taken

    def _run(self, run: str, by_library: bool) -> bytes:
        """The ids of a run without white space, already normalised, as 32-bit numbers."""
        found = self.kept.get(run) or self.older.get(run)
        if found is None:
            if by_library:
                letters = self.letters
                words = [bytes(letters[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(run)]
            else:
                words = [w.encode() for w in self.words_of.findall(run)]
            found = array("i", [i for w in words for i in self.encode_word(w)]).tobytes()
        if len(run) <= 64:
            if len(self.kept) >= KEPT_WORDS:
                self.older, self.kept = self.kept, {}
            self.kept[run] = found
        return found

    def _part(self, part: str, out: bytearray) -> None:
        if _OTHER.search(part):
            normal = self.library.normalizer.normalize_str(part)
            for run in normal.split(" "):
                if run:
                    out += self._run(run, True)
            return
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        for run in part.lower().split():
            out += self.kept.get(run) or self._run(run, False)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, as 32-bit numbers."""
        out, at = bytearray(), 0
        while text and at < len(text):
            cut = _SPACE.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            piece, at = text[at:end], end
            if self.added_re is None or "<" not in piece:
                self._part(piece, out)
                continue
            for k, part in enumerate(self.added_re.split(piece)):
                if k % 2:
                    out += array("i", [self.added[part]]).tobytes()
                elif part:
                    self._part(part, out)
        return np.frombuffer(out, dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Token texts joined by a space; ids that the vocabulary lacks are passed over."""
        parts = []
        for lo in range(0, len(ids), PIECE):
            some = ids[lo : lo + PIECE].astype(np.int64)
            some = some[(some >= 0) & (some < len(self.offsets) - 1)]
            begin, length = self.offsets[some], self.offsets[some + 1] - self.offsets[some]
            ends = np.cumsum(length)
            parts.append(self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + length, length)].tobytes())
        return b"".join(parts)[:-1].decode()


_loaded: dict[str, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    """The tables of a tokenizer file, made once in a process."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def _batches(texts: list, limit: int = OUT_CHARS) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for hi, text in enumerate(texts, 1):
        held += len(text or "") + 64
        if held >= limit or hi == len(texts):
            yield lo, hi
            lo, held = hi, 0


def _map(df: DataFrame, path: str, key: str, text: str, with_ids: bool, with_decoded: bool) -> DataFrame:
    with open(path, encoding="utf-8") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())
    fields = [T.StructField("key", df.schema[key].dataType)]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * with_ids
    fields += [T.StructField("decoded", T.StringType())] * with_decoded

    def run(batches):
        tables = vocabulary(sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _batches(texts):
                coded = [tables.encode(t) for t in texts[lo:hi]]
                columns, names = [batch.column(0).slice(lo, hi - lo)], ["key"]
                if with_ids:
                    offsets = np.cumsum([0] + [len(c) for c in coded]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded))))
                    names.append("ids")
                if with_decoded:
                    columns.append(pa.array([tables.decode(c) for c in coded], type=pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, T.StructType(fields)).withColumnRenamed("key", key)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of every row's whole text, in order."""
    return _map(df, path, key, text, True, False)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): ids and the text that decoding them gives, in one pass."""
    return _map(df, path, key, text, True, True)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded): the text of every row's ids; null ids decode to the empty text."""
    with open(path, encoding="utf-8") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        tables = vocabulary(sent.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.column(1)[k].values
                coded = np.empty(0, np.int32) if row is None else row.drop_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([tables.decode(coded)], type=pa.string())], names=["key", "decoded"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("decoded", T.StringType())])
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, schema).withColumnRenamed("key", key)


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of a round trip's rows."""
    return coded.select(
        key, F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
