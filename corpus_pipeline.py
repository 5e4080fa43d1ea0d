"""The corpus pipeline: filter, deduplicate, redact, mix and pack, each stage written before the next reads it.

A stage takes (spark, docs, sf_dir). All but the last return the columns of docs, whatever columns
docs has beside doc_id, text and source; the last returns the packed pieces. An empty table passes
through every stage as an empty table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dewfall.llm import minhash, mixing, packing, pii, toxicity
from dewfall.llm.common import drop_written, small_batches, table, written


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those predicted toxic. A null or empty text stays unless its base-rate score reaches the threshold."""
    small_batches(spark)
    names = docs.columns
    # Other columns go under neutral names, so that none clashes with those of the scores.
    plain = docs.toDF(*(c if c in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(names)))
    scored = toxicity.score(plain, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(plain.columns).toDF(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the smallest doc_id of each group of near copies. Rows that repeat a doc_id are one document and stay together."""
    small_batches(spark)
    return minhash.dedup(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data in text replaced by its kind; no row goes."""
    small_batches(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs repeated as the mix takes them: none, once or twice each."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row of docs, placed in sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", filter_toxic),
    ("minhash_dedup", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL for trained models and tokenizers; tests run the stages over planted documents.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_written(before)
        before = docs
    return docs
