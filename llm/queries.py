"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm.bpe import digests
from llm.bpe import round_trip as encode_and_decode
from llm.decontaminate import overlaps
from llm.hard_negatives import mine
from llm.jaccard_join import jaccard_components
from llm.licenses import scan
from llm.mixing import mix
from llm.passage_chains import passages
from llm.personal_data import find
from llm.quality_rules import apply_policy, ledger
from llm.spelling import variants
from llm.toxicity import score, train
from llm.url_filter import judge
from llm.warc_archive import round_trip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@query("op7_ngram_jaccard_join")
def op7(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir))


@query("op4_benchmark_decontamination")
def op4(spark, sf_dir):
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op1_personal_data")
def op1(spark, sf_dir):
    return find(documents(spark, sf_dir))


@query("op6_source_mixing")
def op6(spark, sf_dir):
    return mix(documents(spark, sf_dir))


@query("op3_quality_rules")
def op3(spark, sf_dir):
    return apply_policy(ledger(documents(spark, sf_dir)))


@query("op9_license_scan")
def op9(spark, sf_dir):
    return scan(documents(spark, sf_dir))


@query("op10_url_filter")
def op10(spark, sf_dir):
    """Labelled pages are those with a row in labels; toxic or low-quality ones are to be blocked."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(pages(spark, sf_dir), labels.selectExpr("doc_id AS page_id", "toxic = 1 OR quality = 0 AS blocked"))


@query("op5_warc_archive")
def op5(spark, sf_dir):
    return round_trip(pages(spark, sf_dir))


ORACLES["op5_warc_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS sha FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS least FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha AS payload_digest,
  CASE WHEN n >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > least THEN least END AS refers_to
FROM g
"""


@query("op8_substring_dedup")
def op8(spark, sf_dir):
    return passages(documents(spark, sf_dir))


@query("op11_hard_negatives")
def op11(spark, sf_dir):
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES["op11_hard_negatives"] = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r AS a JOIN r AS b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""


@query("op12_spelling_variants")
def op12(spark, sf_dir):
    return variants(documents(spark, sf_dir))


ORACLES["op12_spelling_variants"] = """
WITH RECURSIVE
crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b))),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, strlen(k) + 1), lambda i: CAST('0x' || substr(hex(encode(k)), 2 * i - 1, 2) AS BIGINT))),
    lambda x, y: xor(x >> 8, t[CAST(xor(x & 255, y) AS BIGINT) + 1])), 4294967295) AS h
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM runs), crc_table),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut AS a JOIN cut AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut AS a JOIN words AS b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut AS a JOIN words AS b ON a.rest = b.word),
best AS (
  SELECT p.word, count(*) AS n_near, max(b.n) AS most, min_by(p.near, (-b.n, p.near)) AS near
  FROM pairs AS p JOIN words AS b ON b.word = p.near GROUP BY p.word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN near END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n
  FROM words AS w LEFT JOIN best USING (word)),
climb AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT c.word, f.form, steps + 1 FROM climb AS c JOIN formed AS f ON f.word = c.root WHERE f.form IS NOT NULL),
tops AS (SELECT word, max_by(root, steps) AS root FROM climb GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN tops USING (word)
"""


@query("op13_bpe_tokens")
def op13(spark, sf_dir):
    import public_tokenizers

    return digests(encode_and_decode(documents(spark, sf_dir), str(public_tokenizers.path("word_bpe_49k.json"))))
