"""Stages of the pipeline on documents whose further columns carry the names that the operators use themselves."""

from __future__ import annotations

import pytest

from llm.decontaminate import clean
from llm.jaccard_join import keep_one
from llm.mixing import mixture
from llm.personal_data import redact
from llm.toxicity import keep_clean

EXTRA = ["rejected", "rejected_th", "leak", "leak_id", "__clean", "clean", "row", "th", "id", "group", "copies", "taken", "spans", "size", "score", "label"]
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion of jade and quartz"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, f"Prefix words come first. {PASSAGE}. And more follows here."), (2, "Write to jane.doe@example.com today."), (3, None), (3, ""), (None, "No key at all in this row."), (5, "A plain text of a few words.")]
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, " + ", ".join(f"`{c}` INT" for c in EXTRA)
    return spark.createDataFrame([(i, t, "en", "web", 7, *range(len(EXTRA))) for i, t in rows], schema)


def test_stages_keep_the_columns_and_the_rows_that_they_do_not_judge(spark, docs):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id BIGINT, text STRING")
    labels = spark.createDataFrame([(k, 1, int(k % 2 == 0)) for k in (1, 2, 5)], "doc_id BIGINT, quality INT, toxic INT")
    assert keep_clean(docs, labels).columns == docs.columns
    assert sorted(r.doc_id or 0 for r in clean(docs, items).collect()) == [0, 2, 3, 3, 5]
    assert keep_one(docs).count() == 6
    redacted = {r.text: r for r in redact(docs).collect()}
    assert "Write to [EMAIL] today." in redacted and len(redacted) == 6
    row = redacted["Write to [EMAIL] today."]
    assert row.n_chars == 23 and [row[c] for c in EXTRA] == list(range(len(EXTRA))) and redacted[None].n_chars == 7
    mixed = mixture(docs)
    assert sorted(mixed.columns) == sorted(docs.columns)
    assert all(r.copies >= 1 and r.taken >= 0 for r in mixed.collect())
    assert {r["rejected"] for r in mixed.collect()} == {0}


def test_stages_of_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    items = spark.createDataFrame([], "item_id BIGINT, text STRING")
    for out in (keep_clean(none, labels), keep_one(none), clean(none, items), redact(none), mixture(none)):
        assert out.collect() == []
    assert keep_clean(docs, labels).count() == clean(docs, items).count() == 6
