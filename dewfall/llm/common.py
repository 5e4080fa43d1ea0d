"""Helpers that the operators share: table paths, shared folders, cutting lineage, hot keys, components."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: A key counts as hot beyond HOT_ROWS rows and beyond one HOT_KEYS-th of all rows, so at most HOT_KEYS keys ever do.
HOT_ROWS, HOT_KEYS = 2_000, 10_000
#: Ids that are broadcast at most: 16 to 48 bytes each in every executor.
ID_ROWS = 2_000_000

#: Bytes of rows that go to a Python worker at once in small_batches.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers in batches of BATCH_BYTES (or one row), not of 10,000 rows or 64 MB: each is held by the worker and, outside
    the heap, by the executor. Results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; an error where its files are missing."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can read and write.

    Where the setting is absent (a plain local session, as in tests) a temporary folder stands in."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    Empty tables, nulls and repeated rows come back as they were; columns must have different names."""
    spark = df.sparkSession
    path = shared_dir(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete the folders behind results of written(), through Hadoop, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hash_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """The `rows` rows of df whose hashes of `by` come first: the same ones on every run; all, if there are fewer.

    Rows that are equal in `by` are told apart by their other columns' hash; nulls are hashed like values."""
    n = df.count()
    # a threshold lets few rows into the sort; twice as many as wanted leave room for chance
    rank = F.pmod(F.xxhash64(*by), F.lit(1 << 40))
    low = df if n <= 2 * rows else df.where(rank < F.lit(int((1 << 40) * min(1.0, 2 * rows / n))))
    return low.orderBy(rank, F.xxhash64(*low.columns)).limit(rows)


def word_count(text: Column) -> Column:
    """Number of words in text, 0 for null: words begin where a non-separator follows a separator."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hot_bound(groups: DataFrame, count: str = "n") -> int:
    """Rows beyond which a key of groups(key, count) is hot."""
    total = groups.agg(F.sum(count)).first()[0] or 0
    return max(HOT_ROWS, math.ceil(total / HOT_KEYS))


def split_join(rows: DataFrame, groups: DataFrame, key: str, count: str = "n") -> DataFrame:
    """rows joined with groups, which has one row for each key and in `count` how many rows hold it.

    Hot keys, at most HOT_KEYS of them by their counts, are broadcast, so the rows of one key never meet in one task; the
    others are joined by shuffle. Rows with a null key, or one that groups lacks, go. rows and groups are each read twice."""
    bound = hot_bound(groups, count)
    hot = groups.where(F.col(count) > bound)
    if hot.isEmpty():
        return rows.join(groups, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(count) <= bound), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def by_ids(rows: DataFrame, ids: DataFrame, keys: Sequence[str], how: str = "left_semi") -> DataFrame:
    """rows with keys that the written table ids holds, or, by left_anti, that it lacks. Null keys are in no table.

    rows may be texts of any size. Up to ID_ROWS ids are broadcast, so that rows stay where they are; left to itself Spark would move all of them before it
    knew how few the ids are. Beyond that both sides are shuffled, at the same result."""
    small = ids.select(*keys)
    return rows.join(F.broadcast(small) if ids.count() <= ID_ROWS else small, list(keys), how)


def salted_join(rows: DataFrame, wide: DataFrame, key: str, by: str, most: int = 500) -> DataFrame:
    """rows joined with wide, which has one row for each key; rows of one key are dealt out by `by`, about `most` to a copy of its wide row.

    rows is a written table. Rows with a null key, or one that wide lacks, go."""
    groups = written(rows.groupBy(key).agg(F.count("*").alias("_n")), "keys")
    copies = F.ceil(F.col("_n") / most).cast("int")
    dealt = split_join(rows, groups, key, "_n").withColumn("_salt", F.pmod(F.xxhash64(by), copies).cast("int")).drop("_n")
    copied = wide.join(groups, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_n")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b): the smallest node it can reach. A written table.

    Alternates large-star and small-star steps; each halves path lengths or better, so rounds
    grow with the logarithm of the longest chain. The star that a hub would gather in one task
    is never built: both steps need only the minimum of a neighbourhood, a partial aggregate,
    and a join that deals out hubs. Self-links and repeated links are allowed; links with a null are dropped; no links give no rows.
    Every round is written to the shared folder and the one before deleted, so no lineage grows."""
    links = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null")
        .distinct(),
        "links",
    )
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    current = links.where("u <> v")
    small = links.count() <= HOT_ROWS  # then no node can be hot
    kept: list[DataFrame] = []

    def joined(rows: DataFrame, groups: DataFrame, spent: list[DataFrame]) -> DataFrame:
        if small:
            return rows.join(groups, "u")
        spent.append(written(groups, "stars"))
        return split_join(rows, spent[-1], "u")

    for _ in range(max_rounds):
        spent: list[DataFrame] = []
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # large-star: larger neighbours of u point to the least of its neighbourhood
        large = joined(both.where("v > u"), low, spent).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if not small:
            spent.append(large := written(large, "large"))
        # small-star: u and its smaller neighbours point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = joined(large, least, spent).select("v", "m", "u")
        ends = F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))
        stars = moved.select(F.explode(ends).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        current = written(stars, "star")
        drop_written(*spent, *kept)
        kept = [current]
        # settled once every node points to one node that points nowhere
        sides = current.select(F.col("u").alias("x"), F.lit(1).alias("out")).union(current.select("v", F.lit(0)))
        if sides.groupBy("x").agg(F.sum("out").alias("out"), F.min("out").alias("least")).where("out > 1 or (out = 1 and least = 0)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    root = current.groupBy("u").agg(F.min("v").alias("v"))
    out = written(nodes.join(root, nodes.node == root.u, "left").select("node", F.coalesce("v", "node").alias("component")), "components")
    drop_written(links, *kept)
    return out


def running_total(rows: DataFrame, key: str, order: Sequence[str], value: Column, parts: int = 64) -> DataFrame:
    """rows with `before`: the sum of value, a decimal so that no order of adding matters, over the rows of the same key that stand before it.

    Two levels, so that no key is ranked in one task: ranges of `order` are summed, their few sums added up, and rows only
    within their range. A null key is a key of its own. `order` should tell the rows of a key apart; equal rows are in no fixed order."""
    dealt = written(rows.withColumn("_value", value).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(key, "_part").agg(F.sum("_value").alias("_sum"))  # at most `parts` rows for each key
    above = F.sum("_sum").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), F.coalesce(above, F.lit(0)).alias("_base"))
    within = F.sum("_value").over(Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn("_within", F.coalesce(within, F.lit(0))).join(base, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    return out.withColumn("before", F.col("_base") + F.col("_within")).drop("_value", "_part", "_within", "_key", "_at", "_base")


def whole_groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by `names`, cut so that rows equal in these integer columns are in one batch; no batch is empty."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy() for n in names])
        new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if kept and not _same(kept[-1], batch, names):
            yield pa.concat_batches(kept)
            kept = []
        if not len(new):
            kept.append(batch)
            continue
        yield pa.concat_batches([*kept, batch.slice(0, int(new[-1]))])
        kept = [batch.slice(int(new[-1]))]
    if kept:
        yield pa.concat_batches(kept)


def _same(before: pa.RecordBatch, after: pa.RecordBatch, names: Sequence[str]) -> bool:
    """Whether the last row of a batch and the first of the next are equal in `names`."""
    return all(before.column(n)[-1].as_py() == after.column(n)[0].as_py() for n in names)
