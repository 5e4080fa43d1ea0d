"""Near-duplicate embeddings by random-hyperplane signs.

Each of several tables hashes a vector to the signs of its products with k random directions; equal
codes meet. A first pass deals out ids with a sketch, 128 more signs, and keeps the members of a bucket whose sketch
is near another's there; vectors follow for these alone, and the exact cosine decides. Small buckets are worked on together, pair by pair in arrays; large ones are cut into
blocks of bounded size and compared block against block, by matrices. What leaves a task are members, counts and a spanning forest of its links,
never the links themselves, so its output grows with its rows; a pair that meets in several tables
counts in the first alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from dewfall.llm.common import components, drop_written, split_join, whole_groups, written
from dewfall.llm.textcodes import mixed

#: Greatest chance that a pair at the threshold shares no table, and that its sketches differ too much.
MISS, SKETCH_MISS = 1e-3, 1e-7
SKETCH_BITS = 128
BLOCK = 1_000
#: Members up to which a bucket is worked on with others.
SMALL = 48
#: Pairs that are multiplied at once.
PAIRS = 200_000


def table_shape(rows: int, least: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): about four vectors for each code, and tables enough for the wanted recall."""
    bits = min(62, max(8, math.ceil(math.log2(max(rows, 2))) - 2))
    one = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-one))


def sketch_bound(least: float, miss: float = SKETCH_MISS) -> int:
    """Bits of SKETCH_BITS that the sketches of a pair at the threshold exceed in differing with a chance of `miss` at most."""
    p = min(1.0, max(0.0, math.acos(least) / math.pi))
    below, bits = 0.0, -1
    while bits < SKETCH_BITS and below < 1 - miss:
        bits += 1
        below += math.comb(SKETCH_BITS, bits) * p**bits * (1 - p) ** (SKETCH_BITS - bits)
    return bits


def planes(dim: int, directions: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([20240301, dim])).standard_normal((dim, directions))


def component_type(df: DataFrame) -> str:
    """How components travel: as they are given, so that nothing is rounded."""
    kind = df.schema["embedding"].dataType
    return "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, vec, same): the components in bytes, null if the vector can link with nothing; same: its identity."""
    kind = component_type(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy()
            x = lists.values.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # nulls turn into NaN, -0 into 0
            bad, some = (np.r_[0, np.cumsum(m)] for m in (~np.isfinite(x), x != 0))
            sound = (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
            out = [x[a:b].tobytes() if ok else None for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), sound.tolist(), strict=True)]
            same = [None if v is None else xxhash.xxh3_128_digest(v) for v in out]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.binary()), pa.array(same, pa.binary())], names=["vec_id", "vec", "same"])

    return df.select("vec_id", "embedding").mapInArrow(run, "vec_id long, vec binary, same binary")


def _by_length(vecs: list[bytes], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) for each length of vector."""
    sizes = np.array([len(v) for v in vecs])
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield rows, np.frombuffer(b"".join([vecs[k] for k in rows.tolist()]), kind).reshape(len(rows), -1).astype("f8")


def coded(reps: DataFrame, bits: int, tables: int, kind: str) -> DataFrame:
    """reps(vec_id, vec, copies) with codes: a number for each table, in bytes; keys, their hashes; and a sketch, as two numbers."""
    code = "<i4" if bits < 31 else "<i8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype="i8")
        salts = mixed(np.arange(1, tables + 1, dtype=np.uint64))
        for batch in batches:
            codes = np.zeros((batch.num_rows, tables), "i8")
            keys = np.zeros((batch.num_rows, tables), np.uint64)
            sketch = np.zeros((batch.num_rows, SKETCH_BITS // 64), "i8")
            for rows, x in _by_length(batch.column(1).to_pylist(), kind):
                dim = x.shape[1]
                if dim not in by_dim:
                    by_dim[dim] = planes(dim, tables * bits + SKETCH_BITS)
                signs = x @ by_dim[dim] > 0
                codes[rows] = signs[:, : tables * bits].reshape(len(x), tables, bits) @ weights
                sketch[rows] = np.packbits(signs[:, tables * bits :], axis=1).view("i8")
                with np.errstate(over="ignore"):
                    keys[rows] = mixed(codes[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salts + np.uint64(dim))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(keys.view(np.int64).ravel()))
            packed = pa.array([r.tobytes() for r in codes.astype(code)], pa.binary())
            signs_of = [pa.array(np.ascontiguousarray(c)) for c in sketch.T]
            yield pa.RecordBatch.from_arrays([*batch.columns, packed, lists, *signs_of], names=["vec_id", "vec", "copies", "codes", "keys", "s0", "s1"])

    return reps.select("vec_id", "vec", "copies").mapInArrow(run, "vec_id long, vec binary, copies long, codes binary, keys array<long>, s0 long, s1 long")


def near_pairs(
    group: np.ndarray, side: np.ndarray | None, pairs: Callable[[np.ndarray, np.ndarray], np.ndarray], block: Callable[[int, int], np.ndarray]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near rows (a < b) of one group; rows of a group stand together. side: only pairs of different sides.

    pairs(a, b) tells which of these rows are near, block(lo, hi) does so for all rows of a range as a matrix."""
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    size = np.diff(edges)
    small = np.repeat(size <= SMALL, size)
    after = np.where(small, np.repeat(edges[1:], size) - np.arange(len(group)) - 1, 0)
    total = np.cumsum(after)
    cuts = np.searchsorted(total, np.arange(PAIRS, (total[-1] if len(total) else 0) + PAIRS, PAIRS))
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts + 1, len(group)], strict=True):
        lo = min(lo if lo == 0 else lo + 1, len(group))
        hi = min(hi, len(group))
        n = after[lo:hi]
        a = np.repeat(np.arange(lo, hi), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        good = pairs(a, b)
        if side is not None:
            good &= side[a] != side[b]
        yield a[good], b[good]
    for g in np.flatnonzero(size > SMALL).tolist():
        lo, hi = edges[g], edges[g + 1]
        near = np.triu(block(lo, hi), 1)
        if side is not None:
            near &= side[lo:hi, None] != side[None, lo:hi]
        a, b = np.nonzero(near)
        yield a + lo, b + lo


def bucket_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the bucket, side, whether only different sides are compared) of rows sorted by bucket."""
    column = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
    bucket = np.stack([column(c) for c in ("t", "key", "i", "j")])
    return np.cumsum(np.r_[0, (bucket[:, 1:] != bucket[:, :-1]).any(axis=0)]), column("side"), column("i") != column("j")


def likely(batch: pa.RecordBatch, most: int) -> pa.RecordBatch:
    """The members of whole buckets, sorted by bucket, whose sketch differs from another's there in `most` bits at most."""
    group, side, apart = bucket_of(batch)
    halves = [batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in ("s0", "s1")]
    kept = np.zeros(batch.num_rows, bool)
    for own, sides in ((np.flatnonzero(~apart), None), (np.flatnonzero(apart), side[apart])):
        s = [h[own] for h in halves]
        pairs = lambda a, b, s=s: sum(np.bitwise_count(h[a] ^ h[b]) for h in s) <= most
        block = lambda lo, hi, s=s: sum(np.bitwise_count(h[lo:hi, None] ^ h[None, lo:hi]) for h in s) <= most
        for a, b in near_pairs(group[own], sides, pairs, block) if len(own) else ():
            kept[own[a]] = kept[own[b]] = True
    return batch.filter(pa.array(kept))


def links_of(batch: pa.RecordBatch, least: float, kind: str, code: str) -> list[np.ndarray]:
    """[vec_id, links, root] of the members of whole buckets, sorted by bucket and vec_id, that have a link not met in an earlier table."""
    column = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
    ids, copies, table = column("vec_id"), column("copies"), column("t")
    group, side, apart = bucket_of(batch)
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), code).reshape(len(ids), -1)
    earlier = np.arange(codes.shape[1])
    links, root, hit = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros(len(ids), bool)
    left, right = [], []
    for rows, x in _by_length(batch.column("vec").to_pylist(), kind):  # vectors of different dimensions never link
        x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares of extreme values finite
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        for both, sides in ((~apart[rows], None), (apart[rows], side[rows][apart[rows]])):
            own = rows[both]
            if not len(own):
                continue
            y = x[both]
            pairs = lambda a, b, y=y: np.einsum("ij,ij->i", y[a], y[b]) >= least
            block = lambda lo, hi, y=y: y[lo:hi] @ y[lo:hi].T >= least
            for a, b in near_pairs(group[own], sides, pairs, block):
                for at in range(0, len(a), PAIRS):
                    p, q = own[a[at : at + PAIRS]], own[b[at : at + PAIRS]]
                    met = ((codes[p] == codes[q]) & (earlier < table[p][:, None])).any(axis=1)
                    left.append(p[~met])
                    right.append(q[~met])
    a, b = np.concatenate([*left, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*right, np.empty(0, np.int64)]).astype(np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    hit[a] = hit[b] = True
    while len(a):  # the first member that each can reach; members are sorted, so it has the least id
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return [ids[hit], links[hit], ids[root[hit]]]


def linked(df: DataFrame, least: float = 0.95, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of df.

    Needs vec_id and embedding. A vector that is null, empty, zero, or holds null or non-finite components links
    with nothing: 0 links, a component of its own. Equal vectors link with each other (cosine 1) and
    stand as one in the search. Vectors of different dimensions never link. vec_id should be unique: rows that repeat it
    share its links; a row without vec_id takes part under no id: 0 links, component null, kept. An empty table gives an empty result."""
    kind = component_type(df)
    all_ = written(vectors(df), "vectors")
    real = all_.where("same is not null and vec_id is not null")
    sets = written(real.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "sets")
    first = real.join(sets.select("same", F.col("rep").alias("vec_id"), "copies"), ["same", "vec_id"]).dropDuplicates(["same"])
    bits, tables = table_shape(max(1, sets.count()), least, miss)
    codes = written(coded(first, bits, tables, kind), "codes")
    keys = codes.select("vec_id", "s0", "s1", F.posexplode("keys").alias("t", "key"))
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = split_join(keys, shared, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    side = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    dealt = met.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"i": F.least("side", "other"), "j": F.greatest("side", "other")}
    )
    bucket, most = ["t", "key", "i", "j"], sketch_bound(least)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, *bucket):
            yield likely(batch, most).select([*bucket, "side", "vec_id"])

    sketches = dealt.select(*bucket, "side", "vec_id", "s0", "s1").repartition(*bucket[1:]).sortWithinPartitions(*bucket)
    sifted = written(sketches.mapInArrow(sift, "t int, key long, i int, j int, side int, vec_id long"), "sifted")
    members = sifted.join(codes.select("vec_id", "vec", "copies", "codes"), "vec_id").select(*bucket, "side", "vec_id", "vec", "copies", "codes")
    code = "<i4" if bits < 31 else "<i8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, *bucket):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in links_of(batch, least, kind, code)], names=["vec_id", "links", "root"])

    sorted_ = members.repartition(*bucket[1:]).sortWithinPartitions(*bucket, "vec_id")
    found = written(sorted_.mapInArrow(run, "vec_id long, links long, root long"), "links")
    labels = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    own = sets.join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    told = written(own.select("same", "rep", "copies", "links", "component"), "told")
    drop_written(codes, shared, sifted, found)
    out = split_join(real.select("vec_id", "same"), told, "same", "copies")
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    whole = out.select("vec_id", links.cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = all_.where("same is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
