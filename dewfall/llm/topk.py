"""Exact top-k search by MaxScore over sharded postings.

Dimensions are the terms: the posting list of a dimension holds every vector's integer component.
A shard's vectors are ordered by their largest component, so that a run of them has narrow bounds.
For a query each term's contribution lies between its bounds in the run. Terms stand in
descending order of bound; the last ones whose bounds together cannot lift a vector over the current
k-th score are non-essential, and where all are, the run is passed over. Essential lists are traversed for all vectors of a run, the others
probed only for vectors that are still competitive. Shards' lists merge by score, ties to smaller ids.

Each vector goes to one shard, once; queries visit every shard, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dewfall.llm.common import written

#: Vectors of a shard where that keeps all cores busy, and bytes of a larger table's shards: a task holds one shard, about three times over, and a batch of queries.
SHARD, SHARD_BYTES = 40_000, 1 << 26
#: Vectors that are scored at once.
RUN = 1_024
FOUND = "query_id long, vec_id long, score long"


def scaled(df: DataFrame, factor: float = 1024.0) -> DataFrame:
    """(vec_id, dim, vec) with floor(factor * component) as doubles in bytes; unfit vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy()
            x = np.floor(factor * lists.values.to_numpy(zero_copy_only=False).astype("<f8"))  # nulls turn into NaN
            bad = np.r_[0, np.cumsum(~np.isfinite(x))]
            fit = (bad[at[1:]] == bad[at[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            kept = np.flatnonzero(fit).tolist()
            out = pa.array([x[at[k] : at[k + 1]].tobytes() for k in kept], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).filter(pa.array(fit)), pa.array(np.diff(at)[fit].astype("i8")), out], names=["vec_id", "dim", "vec"])

    return df.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim long, vec binary")


class Shard:
    """Postings of one shard: a column for each dimension, with its bounds in each run."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        if values.shape[1]:
            top = np.abs(values).argmax(axis=1)
            order = np.lexsort((ids, np.take_along_axis(values, top[:, None], 1)[:, 0], top))
        else:
            order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], np.ascontiguousarray(values[order])
        edges = np.arange(0, len(ids), RUN)
        self.low, self.high = np.minimum.reduceat(self.values, edges, axis=0), np.maximum.reduceat(self.values, edges, axis=0)
        #: Products of a component and a query's, done and possible.
        self.done = self.possible = 0

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than the query's own, best first."""
        ends = np.stack([q * self.low, q * self.high])
        least, most = ends.min(axis=0), ends.max(axis=0)
        ceiling, floor = most.sum(axis=1), least.sum(axis=1)  # of the scores in each run
        ids, scores = np.empty(0, "i8"), np.empty(0, self.values.dtype)
        self.possible += self.values.size
        for run in np.argsort(-ceiling, kind="stable").tolist():
            full = len(ids) >= k
            if full and ceiling[run] < scores[k - 1]:
                break  # runs stand in descending order of their ceilings
            rows = self.values[run * RUN : (run + 1) * RUN]
            bound = most[run] - least[run]
            terms = np.argsort(-bound, kind="stable")
            after = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # after[m]: most that terms[m:] can add above their least
            # Essential: the terms before m; what the rest can add stays below the k-th score.
            m = min(int(np.searchsorted(-(floor[run] + after), -scores[k - 1], side="right")), len(terms)) if full else len(terms)
            essential, rest = terms[:m], terms[m:]
            partial = rows[:, essential] @ q[essential] + least[run][rest].sum() if m < len(terms) else rows @ q
            self.done += len(rows) * m
            live = np.arange(len(rows))
            if full:
                live = live[partial + after[m] >= scores[k - 1]]
            got = partial[live]
            for p in range(m, len(terms)):
                if not len(live):
                    break
                d = terms[p]
                got = got + rows[live, d] * q[d] - least[run][d]
                self.done += len(live)
                stay = got + after[p + 1] >= scores[k - 1]
                live, got = live[stay], got[stay]
            new = self.ids[run * RUN + live]
            other = new != query_id
            ids, scores = np.append(ids, new[other]), np.append(scores, got[other])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        return ids, scores


def shard_count(rows: int, components: int, cores: int) -> int:
    """Shards of SHARD_BYTES; where those are fewer than the cores, of SHARD vectors, up to one for each core.

    Every query visits every shard and brings k rows back, so few large shards move least, while a shard is what a task must hold."""
    return max(1, -(-8 * components // SHARD_BYTES), min(cores, -(-rows // SHARD)))


def matrix(vecs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(vecs.to_pylist()), "<f8").reshape(len(vecs), -1)


def exact(x: np.ndarray, largest: float) -> np.ndarray:
    """x, as Python's integers where doubles would round a product with components up to `largest`."""
    if x.shape[1] and float(np.abs(x).max()) * largest * x.shape[1] >= 2.0**52:
        return np.array([[int(v) for v in row] for row in x], object)
    return x


def search_shards(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each shard for each query. Rows (dim, shard, tag, vec_id, vec) come sorted: a shard's vectors, tag 0, then its queries, tag 1."""
    at, held, shard = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "tag")])
        edges = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows]
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if lo == hi:
                continue
            part, (dim, number, tag) = batch.slice(lo, hi - lo), keys[:, lo].tolist()
            if (dim, number) != at:
                at, held, shard = (dim, number), [], None
            if tag == 0:
                held.append(part)
                continue
            if not held:
                continue  # a shard without vectors
            q = matrix(part.column("vec"))
            if shard is None:
                whole = pa.concat_batches(held)
                ids, x = whole.column("vec_id").to_numpy(), matrix(whole.column("vec"))
                shard, largest = Shard(ids, x), float(np.abs(x).max()) if x.size else 0.0
            own = exact(q, largest)
            here = Shard(ids, x.astype(object)) if own.dtype == object and shard.values.dtype != object else shard
            if here.values.dtype == object:
                here.values = np.array([[int(v) for v in row] for row in here.values], object)
            found = [(i, *here.top(i, v, k)) for i, v in zip(part.column("vec_id").to_pylist(), own, strict=True)]
            n = [len(f[1]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([f[0] for f in found], n).astype("i8")),
                    pa.array(np.concatenate([f[1] for f in found]).astype("i8")),
                    pa.array(np.concatenate([f[2] for f in found]).astype("i8")),
                ],
                names=["query_id", "vec_id", "score"],
            )


def search(df: DataFrame, is_query: Column, k: int = 10, factor: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row of df that is_query names.

    Needs vec_id and embedding. Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part. Only
    vectors of the query's dimension are candidates. Rows with the query's vec_id are its own; a query that repeats
    with the same vector is asked once. Equal scores go to the smaller vec_id. Fewer than k candidates give
    all. A score beyond 64 bits raises an error. Vectors go to their shard (shard_count) once; queries are copied to every shard, where
    they are asked batch by batch."""
    rows = written(scaled(df, factor), "scaled")
    asked = rows.where(is_query).dropDuplicates(["vec_id", "vec"])
    shards = shard_count(*rows.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first(), df.sparkSession.sparkContext.defaultParallelism)
    left = rows.withColumns({"shard": F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"), "tag": F.lit(0)})
    right = asked.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "tag": F.lit(1)})
    keys = ["dim", "shard"]
    dealt = left.unionByName(right).select("dim", "shard", "tag", "vec_id", "vec").repartition(*keys).sortWithinPartitions(*keys, "tag")
    found = dealt.mapInArrow(lambda batches: search_shards(batches, k), FOUND)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
