"""Character references and tag stripping against the standard library."""

import html
import random
import re
from html.entities import html5

from pyspark.sql import functions as F

from postlake.functions.entities import unescape
from postlake.functions.text import strip_html


def run(spark, texts, build):
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").select("i", build(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def check(spark, texts):
    assert run(spark, texts, unescape) == [html.unescape(t) for t in texts]


def test_every_name_of_the_standard_table(spark):
    names = sorted(html5)
    check(spark, [f"a &{n} b" for n in names] + [f"&{n}x;&{n.rstrip(';')}" for n in names])


def test_numeric_references(spark):
    codes = [*range(0, 400), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFE, 0x10FFFF, 0x110000, 10**7, 10**30]
    check(spark, [f"a&#{n};b&#{n}c&#x{n:x};d&#X{n:X} e&#000000000000{n};" for n in codes])


def test_stray_ampersands_and_long_names(spark):
    check(spark, ["", "&", "&&", "a & b", "&;", "&#;", "&#x;", "&#xg", "&notit;", "&amp;lt;", "&ampamp", "&lt&gt", "&" + "x" * 40 + ";", "&amp" + "y" * 40, "x&\namp;", "&é;", "&amp;" * 3000, "&\U0001f600;"])


def test_random_texts_are_stripped_as_by_the_standard_library(spark):
    rng = random.Random(5)
    parts = ["&", "&amp;", "&#", "39;", "&nbsp;", "&lt;b&gt;", "<", ">", "<p class='a'>", "</p>", " ", "  ", "\n", "\t ", " ", " ", "\x1c", "\x85", "​", "word", "é", "&hellip", ";", "&#x1F600;"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)]
    want = [" ".join(re.sub("<[^>]*>", "", html.unescape(t)).split()) for t in texts]
    assert run(spark, [*texts, None], strip_html) == [*want, ""]
