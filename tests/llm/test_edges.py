"""Nulls, empty and repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dewfall.llm import licenses, minhash, mixing, packing, pii, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score string, size string, plain string"
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33, "x", "y", "z"),
    (1, "one two three four five six seven", "en", "a", 33, "x", "y", "z"),
    (2, "", None, None, 0, None, None, None),
    (3, None, "en", "a", None, None, None, None),
    (None, "Released under the MIT License.", "en", "b", 31, None, None, None),
    (5, "write to ann@example.org or " + "long " * 30_000, "en", "b", 150_028, None, None, None),
]
LABELS = "doc_id long, quality int, toxic int"
OPERATORS = {
    "mix": mixing.mix,
    "pack": packing.pack,
    "find": pii.find,
    "classes": minhash.classes,
    "scan": licenses.scan,
    "score": lambda df: toxicity.score(df, df.sparkSession.createDataFrame([(1, 1, 0), (None, 1, 1), (3, 0, None)], LABELS)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len({r.doc_id for r in got}) == 5
    assert name == "pack" or len(got) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_stages_keep_columns(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail ann@example.org now")], "doc_id long, text string")
    assert pii.redact(docs).first().text == "mail <email> now"


def test_mixed_repeats_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    taken = {r.doc_id: r.n for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    got = {r.doc_id: r.n for r in mixing.mixed(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: n for k, n in taken.items() if n}
