"""URL verdicts by fixed domain rules and association rules of Spark's FP-growth, in DataFrame operations only.

How it works
    Fixed rules (host suffix and path prefix) come first; the longest that fits wins. For the rest, a URL is a
    basket of tokens: top domain, domain, all further host labels, all path parts, file ending, all query keys and values, scheme;
    numbers count as 0. One aggregation drops tokens on fewer than the least number of blocked pages and puts tokens that stand on
    the same labelled pages (by count and two 64-bit sums of page hashes) under one name; a token that is always right, or on all
    pages, is judged alone, since no longer combination with it can be a better rule. FP-growth mines the remaining baskets of all
    labelled pages with the class as one more item, without a limit on length: a set with the class gives the hits, the same set
    without it the total. Rules "combination -> block" stay with MIN_CONFIDENCE and MIN_SUPPORT, unless a part of the combination is
    at least as sure; the surest part is carried from shorter to longer sets, so each set only looks at those one token shorter.
    Rules match by an inverted index from their rarest token; the rest of a rule is verified on the baskets found, and
    distinct baskets are matched, not pages. A token stands for all tokens under its name.

    The driver sees no rows; FP-growth itself gathers the frequent tokens there, at most a basket's length / MIN_SUPPORT of them.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is allowed unless mined
rules say otherwise; without labels nothing is mined; repeated rows give one row each; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.session import cut_lineage

#: Verdict, host and path of the rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.6
MIN_PAGES = 20
#: The item that marks a blocked page; a token is never empty.
BLOCKED = ""


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without "://"."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule; null without one."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The basket of a URL: distinct, sorted tokens of all its parts; numbers as 0."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    even = lambda value: F.regexp_replace(value, "[0-9]+", "0")
    tag = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(name + "="), value))
    folders = F.split(path, "/")
    pairs = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    key = lambda pair: F.regexp_extract(pair, r"(?s)^([^=]*)", 1)
    items = [
        tag("top", F.get(labels, n - 1)), tag("domain", F.when(n >= 2, F.concat_ws(".", F.get(labels, n - 2), F.get(labels, n - 1)))), tag("label", F.get(labels, n - 3)),
        tag("dir", even(F.get(folders, F.lit(1)))), tag("ending", even(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), tag("scheme", F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z]+)://", 1)),
    ]
    further = [
        F.transform(F.slice(labels, 1, F.greatest(n - 3, F.lit(0))), lambda x: tag("sub", even(x))),
        F.transform(folders, lambda x: tag("part", even(x))),
        F.transform(pairs, lambda x: tag("key", even(key(x)))),
        F.transform(pairs, lambda x: F.when(x.contains("=") & (key(x) != ""), tag("value", even(x)))),
    ]
    return F.sort_array(F.array_distinct(F.filter(F.concat(F.array(*items), *further), lambda x: x.isNotNull())))


def matches(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, rule, confidence) for every rule all of whose items are in the basket. baskets: distinct ``tokens``; rules as of ``mine``."""
    index = cut_lineage(rules.select("rule", "confidence", "alike", F.explode(F.element_at("alike", 1)).alias("token")))
    found = baskets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    return found.where(F.forall("alike", lambda names: F.arrays_overlap(names, F.col("tokens")))).select("tokens", "rule", "confidence").distinct()


def known_tokens(rows: DataFrame, need: int) -> DataFrame:
    """(item, alike, total, hits): tokens on at least ``need`` blocked pages; those on the same pages are one item. rows: page, blocked, tokens."""
    one = rows.select("blocked", F.xxhash64("page").alias("_a"), F.xxhash64("page", F.lit("second")).alias("_b"), F.explode("tokens").alias("token"))
    counts = one.groupBy("token").agg(F.count("*").alias("total"), F.count_if("blocked").alias("hits"), F.bit_xor("_a").alias("_a"), F.bit_xor("_b").alias("_b"))
    same = counts.where(F.col("hits") >= need).groupBy("total", "hits", "_a", "_b").agg(F.sort_array(F.collect_set("token")).alias("alike"))
    return same.select(F.element_at("alike", 1).alias("item"), "alike", "total", "hits")


def frequent_sets(rows: DataFrame, items: DataFrame, pages: int, need: int) -> DataFrame:
    """(items, hits, total) of all combinations on at least ``need`` blocked pages, by FP-growth with the class as an item."""
    names = items.select("item", F.explode("alike").alias("token"))
    held = rows.select("page", "blocked", F.explode_outer("tokens").alias("token")).join(names, "token", "left")
    baskets = held.groupBy("page").agg(F.max("blocked").alias("blocked"), F.collect_set("item").alias("items"))
    marked = F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCKED))).otherwise(F.col("items"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # half a page below the limit, so that rounding never asks for one more
    growth = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / pages, numPartitions=tasks)
    sets = growth.fit(cut_lineage(baskets.select(marked.alias("items")))).freqItemsets
    sets = cut_lineage(sets.select(F.sort_array("items").alias("items"), "freq"))
    of_class = F.array_contains("items", BLOCKED)
    hits = sets.where(of_class & (F.size("items") > 1)).select(F.array_remove("items", BLOCKED).alias("items"), F.col("freq").alias("hits"))
    return hits.join(sets.where(~of_class).withColumnRenamed("freq", "total"), "items")


def better_than_parts(sets: DataFrame) -> DataFrame:
    """Sets (items, hits, total, confidence) that are surer than each of their parts. All parts of a set are sets too."""
    longest = sets.agg(F.max(F.size("items"))).first()[0] or 0
    out = level = sets.where(F.size("items") == 1).withColumn("best", F.lit(0.0))
    for length in range(2, longest + 1):
        shorter = level.select(F.col("items").alias("part"), F.greatest("confidence", "best").alias("sure"))
        drop_one = lambda i: F.filter("items", lambda _, k: k != i)
        parts_ = sets.where(F.size("items") == length).withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), drop_one)))
        level = parts_.join(shorter, "part").groupBy("items").agg(*(F.first(c).alias(c) for c in ("hits", "total", "confidence")), F.max("sure").alias("best"))
        level = cut_lineage(level)
        out = out.unionByName(level)
    return out.where("confidence > best").drop("best")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule, items, alike, confidence, support) from rows of (tokens, blocked).

    ``items`` is sorted; an item stands for all tokens on the same labelled pages and is named by the least of them. ``alike`` lists
    these tokens item by item, the rarest item first. Without enough blocked pages there are no rules.
    """
    pages, blocked = labelled.agg(F.count("*"), F.count_if("blocked")).first()
    need = max(math.ceil(min_support * pages - 1e-9), MIN_PAGES)  # a rule rests on MIN_PAGES pages at least
    if blocked < need:
        return labelled.sparkSession.createDataFrame([], "rule BIGINT, items ARRAY<STRING>, alike ARRAY<ARRAY<STRING>>, confidence DOUBLE, support DOUBLE")
    rows = labelled.select(F.monotonically_increasing_id().alias("page"), F.coalesce("blocked", F.lit(False)).alias("blocked"), F.array_remove("tokens", BLOCKED).alias("tokens"))
    rows = cut_lineage(rows)
    known = cut_lineage(known_tokens(rows, need))
    alone = (F.col("hits") == F.col("total")) | (F.col("total") == pages)
    sure = F.col("hits") / F.col("total")
    sets = cut_lineage(frequent_sets(rows, known.where(~alone), pages, need).withColumn("confidence", sure))
    single = known.where(alone).select(F.array("item").alias("items"), "hits", "total", sure.alias("confidence"))
    rules = single.unionByName(better_than_parts(sets)).where(F.col("confidence") >= min_confidence)
    rules = cut_lineage(rules.select(F.xxhash64("items").alias("rule"), "items", "confidence", (F.col("hits") / F.lit(pages)).alias("support")))
    named = rules.select("rule", F.explode("items").alias("item")).join(known, "item")
    named = named.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("total", "item", "alike"))).alias("alike"))
    return cut_lineage(rules.join(named.select("rule", F.col("alike.alike").alias("alike")), "rule").select("rule", "items", "alike", "confidence", "support"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Per page row: page_id, host, path, rule, verdict and the confidence of the surest mined rule that fires.

    labels: (page_id, blocked).
    """
    url = F.col("url")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = parts(url)
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = cut_lineage(rows.select("page_id", "host", "path", tokens(url, F.col("host"), F.col("path")).alias("tokens")))
    marked = labels.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    rules = mine(rows.join(marked, "page_id").select("tokens", "blocked"))  # without a label a page teaches nothing
    fired = matches(rows.select("tokens").distinct(), rules).groupBy("tokens").agg(F.max("confidence").alias("confidence"))
    fired = cut_lineage(fired)
    name, fixed = fixed_rule(F.col("host"), F.col("path"))
    out = rows.join(fired, "tokens", "left")
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(fixed, mined).alias("verdict"), "confidence")
