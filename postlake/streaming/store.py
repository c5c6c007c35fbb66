"""The stored table of a continuous ingest: bucketed tables of which a batch reads and rewrites only what it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions.text import clean_for_match
from postlake.operators import dedup
from postlake.session import cut_lineage


class BucketTable:
    """Rows dealt to ``buckets`` folders by a hash of ``key``.

    Every version writes the buckets it changes and a list that names the version of each bucket (one row a
    bucket). Version n reads version n - 1 and writes n, so a replay is harmless and no file that is read is
    overwritten. With buckets of a fixed size (``buckets`` in proportion to the expected rows) the cost of a
    version follows the rows it touches, not the table.
    """

    def __init__(self, spark: SparkSession, base: str, name: str, schema: T.StructType, key: str, buckets: int) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, f"{base}/{name}", schema, key, buckets

    def bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def touched(self, values: DataFrame) -> list[int]:
        """The buckets of the values of a one-column table, at most ``buckets`` of them."""
        return sorted(r[0] for r in values.select(self.bucket(F.col(values.columns[0]))).distinct().collect())

    def _versions(self, version: int) -> dict[int, int]:
        if version < 0:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket INT, version INT").parquet(f"{self.path}/list/{version}").collect()}

    def read(self, version: int, buckets: list[int] | None = None) -> DataFrame:
        at = self._versions(version)
        paths = [f"{self.path}/rows/{v}/bucket={b}" for b, v in sorted(at.items()) if buckets is None or b in set(buckets)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def rewrite(self, version: int, rows: DataFrame, buckets: list[int]) -> None:
        """Write ``rows`` as the whole content of the given buckets; the others stay."""
        out = rows.select(*self.schema.names).withColumn("bucket", self.bucket(F.col(self.key)))
        out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/{version}")
        at = {b: v for b, v in self._versions(version - 1).items() if b not in set(buckets)}
        filled = self.spark.read.parquet(f"{self.path}/rows/{version}").select("bucket").distinct().collect() if buckets else []
        at |= {r["bucket"]: version for r in filled}
        self.spark.createDataFrame(list(at.items()), "bucket INT, version INT").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/list/{version}")

    def add(self, version: int, rows: DataFrame) -> None:
        """Append rows: the buckets they fall in are written anew with them."""
        buckets = self.touched(rows.select(self.key))
        self.rewrite(version, self.read(version - 1, buckets).unionByName(rows.select(*self.schema.names)), buckets)


_strings = lambda *names: [T.StructField(n, T.StringType()) for n in names]
SIGNATURES = T.StructType([T.StructField("ord", T.LongType()), *_strings("apply_url", "company", "title", "company_key", "sig")])
COMPANIES = T.StructType(_strings("item", "company_key"))
TEXT_ID = T.StructField("text_id", T.BinaryType())
TEXTS = T.StructType([TEXT_ID, T.StructField("description", T.StringType())])


def text_id(text: Column) -> Column:
    """16 bytes of a text's SHA-256; null for none."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


class JobStore:
    """Postings by link, their descriptions, and an index of their signatures that finds the stored postings a batch may match.

    ``rows`` holds a text_id for each description. A version writes its landed rows once (``land``) and all later steps
    move and rewrite rows without texts; ``described`` joins them where they are asked for.

    ``signatures`` holds the first posting of every distinct (company, title), by company; ``companies`` holds the
    items (``dedup.index_items``) by which similar company names find each other, by item. Similar companies share
    an item, so the rows that ``matching`` returns contain every stored signature that a batch can match.
    """

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, buckets: int = 64) -> None:
        self.spark, self.base = spark, base
        self.schema = schema
        narrow = T.StructType([TEXT_ID if f.name == "description" else f for f in schema])
        self.rows = BucketTable(spark, base, "jobs", narrow, "apply_url", buckets)
        self.signatures = BucketTable(spark, base, "signatures", SIGNATURES, "company_key", buckets)
        self.companies = BucketTable(spark, base, "companies", COMPANIES, "item", buckets)

    def land(self, version: int, rows: DataFrame) -> DataFrame:
        """Write landed rows, whose descriptions the store reads from here, and read them back with their text_id."""
        path = f"{self.base}/landed/version={version}"
        out = rows.withColumn("text_id", text_id(F.col("description")))
        out.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(out.schema).parquet(path)

    def described(self, rows: DataFrame, shown: Callable[[Column], Column] = lambda text: text) -> DataFrame:
        """Stored rows with their descriptions, or what ``shown`` makes of them: only that moves to the rows."""
        texts = self.spark.read.schema(TEXTS).parquet(f"{self.base}/landed").where("text_id IS NOT NULL")
        texts = texts.select("text_id", shown(F.col("description")).alias("description")).dropDuplicates(["text_id"])
        return rows.join(texts, "text_id", "left").select(*self.schema.names)

    def matching(self, version: int, batch: DataFrame) -> DataFrame:
        """Stored signatures whose company may match one of the batch's (company, title) rows."""
        names = batch.select(clean_for_match(F.col("company")).alias("company_key")).where("company_key <> ''").distinct()
        probes = dedup.index_items(names, "company_key", probe=True).select("item").distinct()
        known = self.companies.read(version, self.companies.touched(probes))
        found = known.join(probes, "item", "left_semi").select("company_key").distinct()
        return self.signatures.read(version, self.signatures.touched(found)).join(found, "company_key", "left_semi")

    def add_signatures(self, version: int, inserted: DataFrame, known: DataFrame) -> None:
        """Index the signatures of inserted postings (ord, apply_url, company, title) that ``known`` lacks."""
        rows = dedup.with_signature(inserted.select("ord", "apply_url", "company", "title")).where("sig IS NOT NULL")
        first = rows.groupBy("sig").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "sig"]), F.col("ord")).alias("r")).select("sig", "r.*")
        new = cut_lineage(first.join(known.select("sig"), "sig", "left_anti"))
        self.signatures.add(version, new)
        names = new.select("company_key").distinct().join(known.select("company_key"), "company_key", "left_anti")
        self.companies.add(version, cut_lineage(dedup.index_items(names, "company_key").distinct()))
