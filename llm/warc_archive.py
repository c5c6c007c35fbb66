"""WARC archives in Zstandard with a dictionary: written from pages, read back and validated.

How it works
    An archive is one file: first a skippable frame (magic 0x184D2A5D) with the dictionary, then one frame a record.
    The dictionary is trained on a bounded sample of pages. Spark writes the files with its text writer and so to
    any store that it knows, with its commit protocol: a row is a frame, and the line separator is itself an empty
    skippable frame, so the file stays a valid sequence of frames. Spark reads the files with its binary reader.
    A file holds what one task read, so its size is bounded by the input splits.
    Which record is the response of equal payloads is decided on digests: an aggregation by digest keeps
    those that occur more than once; no page is shuffled while that table is small enough to broadcast.
    The reader loads the dictionary from the leading frame, walks the frame boundaries, decodes one record a frame, and
    checks version, named fields, Content-Length, the digest of a response's payload and the record's end.

Defined results: null html is an empty payload; rows without page_id are kept, and never the response where others are; repeated rows with the same
page_id and payload get the same record type; further columns are ignored; an empty table writes no records.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.steps import small
from postlake.session import cut_lineage, shared_dir

MIN_REVISIT = 100
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SAMPLE_PAGES = 400
SAMPLE_CHARS = 8_192
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: An empty skippable frame, all of it ASCII: a line separator that readers of frames skip.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "1970-01-01T00:00:00Z"


def _record(page_id, url, payload: bytes, digest: str, refers) -> bytes:
    """A WARC/1.1 record of an HTTP response, or of a revisit to another record."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", WARC_DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers))]
    block = http + (payload if refers is None else b"")
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record that passes every check; ValueError otherwise."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != b"WARC/1.1":
        raise ValueError("no WARC/1.1 record")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.decode("utf-8", "surrogatepass").partition(": ")
        if not colon or key.lower() in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[key.lower()] = value
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest") if k not in fields]
    if missing or fields["warc-type"] not in ("response", "revisit"):
        raise ValueError(f"missing {missing} or unknown type")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the block")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not found or not http.startswith(b"HTTP/1.1 ") or len(sizes) != 1:
        raise ValueError("bad HTTP head")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response" and (len(payload) != sizes[0] or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload does not match its length or digest")
    if fields["warc-type"] == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("bad revisit")
    return fields | {"payload": payload, "payload_bytes": sizes[0], "payload_digest": digest}


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of each frame. Walks the block headers; a cut-off frame raises ValueError."""
    at = 0
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        elif magic == FRAME_MAGIC:
            end = at + zstandard.frame_header_size(data[at : at + 18])
            checksum = 4 if data[at + 4] & 4 else 0
            last = False
            while not last:
                block = int.from_bytes(data[end : end + 3], "little")
                last = bool(block & 1) or end + 3 > len(data)
                end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            end += checksum
        else:
            raise ValueError(f"no frame at byte {at}")
        if end > len(data):
            raise ValueError("cut-off frame")
        yield magic, at, end
        at = end


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive."""
    reader = None
    for magic, start, end in frames(data):
        if magic == DICTIONARY_MAGIC and start == 0:
            body = data[start + 8 : end]
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) if body else zstandard.ZstdDecompressor()
        elif magic == FRAME_MAGIC:
            if reader is None:
                raise ValueError("no dictionary before the first record")
            yield parse_record(reader.decompress(data[start:end]))


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary of DICTIONARY_BYTES from about SAMPLE_PAGES pages, SAMPLE_CHARS of each; empty if these are too few.

    The count gives the hash of page_id below which that many pages lie (all, if there are no more), so tasks send the driver
    cut texts of the sample only. Copies of one page_id have one hash: twice SAMPLE_PAGES rows are taken at most.
    """
    filled = pages.where("html IS NOT NULL")
    share = min(SAMPLE_PAGES / max(filled.count(), 1), 1.0)
    highest = min(int(share * 2**64) - 2**63, 2**63 - 1)
    chosen = filled.where(F.xxhash64("page_id") <= highest).select(F.substring("html", 1, SAMPLE_CHARS).alias("x"))
    sample = chosen.limit(2 * SAMPLE_PAGES).collect()
    parts = [r["x"].encode("utf-8", "surrogatepass") for r in sample if r["x"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(pages: DataFrame, folder: str) -> None:
    """Writes every row of (page_id, url, html) as a record into archives under ``folder``."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    dictionary = train_dictionary(rows)
    rows = rows.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("sha", F.sha2("html", 256))
    groups = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("sha").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    groups = cut_lineage(groups.where("n > 1 AND least IS NOT NULL").select("sha", "least"))
    refers = F.when(F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    rows = rows.join(small(groups), "sha", "left").withColumn("refers", refers)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        for f in batches:
            out = [] if head is None else [head]
            head = None
            for page, url, html, sha, to in zip(f["page_id"], f["url"], f["html"], f["sha"], f["refers"], strict=True):
                number = lambda i: None if pd.isna(i) else int(i)
                out.append(writer.compress(_record(number(page), url, html.encode("utf-8", "surrogatepass"), sha, number(to))))
            yield pd.DataFrame({"value": out})

    numbers = rows.select(F.col("page_id").cast("string"), "url", "html", "sha", F.col("refers").cast("string"))  # as text: no rounding of large or missing numbers
    numbers.mapInPandas(build, "value BINARY").select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives under ``folder``: page_id, url, payload and the columns of the query."""
    schema = "page_id BIGINT, url STRING, payload BINARY, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_to BIGINT"

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda name: None if name is None or name == "<urn:page:none>" else int(name.removeprefix("<urn:page:").removesuffix(">"))
        for f in batches:
            for content in f["content"]:
                rows = []
                for r in read_archive(content):
                    rows.append((number(r["warc-record-id"]), r.get("warc-target-uri"), r["payload"], r["payload_bytes"], r["payload_digest"], r["warc-type"], number(r.get("warc-refers-to"))))
                    if len(rows) == 256:
                        yield _frame(rows, schema)
                        rows = []
                yield _frame(rows, schema)

    return spark.read.format("binaryFile").load(folder).select("content").mapInPandas(build, schema)


def _frame(rows: list, schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
    for column, at in (("page_id", 0), ("refers_to", 6)):  # exact, also beside missing ones
        out[column] = pd.array([r[at] for r in rows], dtype="Int64")
    return out


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives into the shared folder and reads them back: one row per page."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
