"""Near-duplicate documents by HyperMinHash.

A document is its set of distinct five-word shingles. One hash of each shingle serves all registers:
its prefix names the bucket, and of the least remainder in a bucket the register keeps the
leading-zero count and ten mantissa bits. Registers that a small set leaves empty are lent by another of
its registers, in an order of preference that all documents share, so agreement still estimates the Jaccard similarity.
Bands of five registers are the keys by which documents meet. The registers' agreement, corrected for chance
collisions, estimates the similarity; pairs that could reach the threshold are confirmed on
the full shingle sets.

A band key never yields all its pairs. Copies with equal sets are one node. In each round a document meets one
partner: of the leaders of its keys, outside its component, the one that leads most of them. Linked documents become one component, and a key
stays open only while it spans several. What is still open after the rounds meets inside blocks of
bounded size: sketches tell the likely pairs there, full sets confirm them, and a block returns no more than a spanning forest of its components. Members of keys
that fill very many blocks meet under shingles instead: each under so many of its rarest ones that sets which reach the threshold share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dewfall.llm.common import by_ids, components, drop_written, salted_join, split_join, whole_groups, written
from dewfall.llm.textcodes import chunks, mixed, utf8, word_hashes

WIDTH = 5
REGISTERS = 256
BANDS, ROWS = 51, 5
#: At similarity s a pair shares no band with probability (1 - s^5)^51: 1e-6 at 0.75, 1e-9 at 0.8.
MANTISSA = 10
SLACK = 4.5 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: Bytes of the sketch by which members of a block are compared: the low bits of all registers.
SKETCH = REGISTERS
SKETCH_SLACK = 4.5 * (0.75 * 0.25 / SKETCH) ** 0.5
#: Members of a key that one block holds, and blocks up to which a key's members meet under that key.
BLOCK, BLOCKS = 512, 16
#: Documents in which frequent shingles are counted, and how many of these are known; they decide the sizes of groups, never what meets.
COMMON_DOCS, COMMON = 2_000, 100_000
#: Rounds in which each document meets one partner.
MEETINGS = 3

_rng = np.random.Generator(np.random.PCG64(20240301))
_STEP = _rng.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For each register the order in which it asks the others.
_RANK = np.stack([_rng.permutation(REGISTERS) for _ in range(REGISTERS)]).astype(np.uint8)
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): the sorted distinct shingle hashes of text k are values[bounds[k] : bounds[k + 1]]."""
    h, n_words = word_hashes(*utf8(texts))
    ends = np.cumsum(n_words)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    found, owner = [], []
    with np.errstate(over="ignore"):
        if len(h) >= WIDTH:
            whole = np.flatnonzero(doc[: len(h) - WIDTH + 1] == doc[WIDTH - 1 :])
            total = np.zeros(len(h) - WIDTH + 1, np.uint64)
            for k in range(WIDTH):
                total += h[k : len(h) - WIDTH + 1 + k] * _STEP[k]
            found.append(mixed(total[whole] + np.uint64(WIDTH)))
            owner.append(doc[whole])
        for n in range(1, WIDTH):  # shorter texts are one shingle
            short = np.flatnonzero(n_words == n)
            at = ends[short] - n
            total = np.full(len(short), n, np.uint64)
            for k in range(n):
                total += h[at + k] * _STEP[k]
            found.append(mixed(total))
            owner.append(short)
    values, owners = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    if len(values):
        new = np.r_[True, (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])]
        values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(len(n_words) + 1))


def registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers of each set, 16 bits each: leading zeros above ten bits of mantissa. Rows of empty sets mean nothing."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    cell = owner * REGISTERS + (values >> np.uint64(56)).astype(np.int64)
    # sets are sorted, so the first value of a bucket is its least
    least = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
    rest = ((values[least] & np.uint64((1 << 56) - 1)) >> np.uint64(3)).astype(np.float64)  # 53 bits, exact
    bits = rest.view(np.uint64)
    zeros = np.uint64(1023 + 52) - np.clip(bits >> np.uint64(52), np.uint64(1022), np.uint64(1023 + 52))
    kept = (zeros << np.uint64(MANTISSA)) | ((bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1))
    out = np.zeros((len(bounds) - 1) * REGISTERS, "<u2")
    full = np.zeros(len(out), bool)
    out[cell[least]], full[cell[least]] = kept, True
    out, full = out.reshape(-1, REGISTERS), full.reshape(-1, REGISTERS)
    for d in np.flatnonzero(~full.all(axis=1) & full.any(axis=1)).tolist():
        have = np.flatnonzero(full[d])
        lack = np.flatnonzero(~full[d])
        out[d, lack] = out[d, have[_RANK[np.ix_(lack, have)].argmin(axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys of each row of registers."""
    with np.errstate(over="ignore"):
        rows = regs[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS)
        return mixed(mixed((rows + np.uint64(1)) * _BAND).sum(axis=2, dtype=np.uint64) ^ _SALT).view(np.int64)


def estimate(same: np.ndarray, n: np.ndarray, m: np.ndarray, kept: int = REGISTERS, bits: int = MANTISSA) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, of `kept`, of sets of sizes n and m.

    Different minima share a register with probability 0.1699 * 4nm/(n+m)^2 / 2^mantissa bits, the
    published approximation; that share of agreements is taken out."""
    chance = kept * 0.169919487159739 * 4.0 * n * m / np.maximum(n + m, 1.0) ** 2 / (1 << bits)
    return (same - chance) / (kept - chance)


SIGNED = "doc_id long, n_shingles long, set_id binary, regs binary, keys array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """One pass over the texts: set size, identity of the set, registers and band keys (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            values, bounds = shingle_sets(batch.column(1))
            sizes = np.diff(bounds)
            regs = registers(values, bounds)
            keys = band_keys(regs)
            none = sizes == 0
            sets = [None if e else xxhash.xxh3_128_digest(values[a:b].tobytes()) for e, a, b in zip(none, bounds[:-1], bounds[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(sets, pa.binary()),
                    pa.array([None if e else r.tobytes() for e, r in zip(none, regs, strict=True)], pa.binary()),
                    pa.compute.if_else(pa.array(none), pa.scalar(None, lists.type), lists),
                ],
                names=["doc_id", "n_shingles", "set_id", "regs", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def confirm(pairs: DataFrame, used: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. pairs is a written table, and so is used, its distinct ids.

    Only texts of documents in pairs are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 3):
            ids, first, place = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
            x, xb = shingle_sets(batch.column(2).take(pa.array(first)))  # a leader's text stands in many rows
            y, yb = shingle_sets(batch.column(3))
            good = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                s, t = x[xb[place[k]] : xb[place[k] + 1]], y[yb[k] : yb[k + 1]]
                both = len(np.intersect1d(s, t, assume_unique=True))
                good[k] = 100 * both >= percent * (len(s) + len(t) - both)
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    t = by_ids(texts.select("doc_id", "text"), used, ["doc_id"])
    joined = salted_join(pairs.select("a", "b"), t.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a", "b").join(
        t.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b"
    )
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def block_forest(batch: pa.RecordBatch, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join different components in one block or pair of blocks; each is confirmed on the full sets, and none is needed twice."""
    column = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
    doc, n, comp, side = (column(c) for c in ("doc_id", "n_shingles", "comp", "side"))
    apart = bool((column("i") != column("j"))[0])
    sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(doc), SKETCH)
    sets = [np.frombuffer(v, np.uint64) for v in batch.column("shingles").to_pylist()]
    least = percent / 100 - SKETCH_SLACK
    _, root = np.unique(comp, return_inverse=True)  # the component of each member as the block's links join them
    for x in range(len(doc) - 1):
        others = x + 1 + np.flatnonzero((root[x + 1 :] != root[x]) & (side[x + 1 :] != side[x] if apart else True))
        others = others[100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x])]
        if not len(others):
            continue
        j_hat = estimate((sketch[others] == sketch[x]).sum(axis=1), n[others], n[x], SKETCH, 8)
        good = np.flatnonzero(j_hat >= least)
        for y in others[good[np.argsort(-j_hat[good], kind="stable")]].tolist():
            if root[x] == root[y]:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                yield min(doc[x], doc[y]), max(doc[x], doc[y])
                root[root == root[y]] = root[x]


def block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links across components from members(key, i, j, side, doc_id, n_shingles, comp, sketch, shingles); rows of one (key, i, j) come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "i", "j")
        for batch in whole_groups(batches, *names):
            keys = np.stack([batch.column(c).to_numpy() for c in names])
            edges = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows].tolist()
            links = [link for lo, hi in zip(edges[:-1], edges[1:], strict=True) for link in block_forest(batch.slice(lo, hi - lo), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    sorted_ = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id")
    return sorted_.mapInArrow(run, "a long, b long").distinct()


def shingle_table(texts: DataFrame) -> DataFrame:
    """(doc_id, shingles): the sorted distinct hashes of each text, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            values, bounds = shingle_sets(batch.column(1))
            sets = pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), sets], names=["doc_id", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def dealt(members: DataFrame) -> DataFrame:
    """members(key, blocks) once for every pair of blocks that has them: (i, j), and side, the block of the member."""
    side = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    spread = members.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    return spread.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", "blocks")


def rare_first(values: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set under which it meets every set that it reaches `percent` with.

    values are the set's, sorted; common lists shingles from the rarest to the most frequent. All sets are put in one order, in which common shingles come last.
    Sets of size n and m that reach the threshold share at least percent of n, and of m, so the first shingle that they share stands
    among the first n - ceil(percent of n) + 1 of the one and as far up in the other. That holds for any order: common only keeps groups small."""
    by_value = np.argsort(common)
    at = np.minimum(np.searchsorted(common, values, sorter=by_value), max(len(common) - 1, 0))
    place = np.where(common[by_value[at]] == values, by_value[at], -1) if len(common) else np.full(len(values), -1)
    return values[np.argsort(place, kind="stable")[: len(values) - -(-percent * len(values) // 100) + 1]]


def meeting_shingles(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, doc_id): every one of n texts under each of its rare_first shingles. texts is read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            values, bounds = shingle_sets(batch.column(1))
            few = [rare_first(values[a:b], common, percent) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            owners = np.repeat(batch.column(0).to_numpy(), [len(x) for x in few])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(few).view(np.int64)), pa.array(owners)], names=["key", "doc_id"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(batch.column(1))[0].view(np.int64))], names=["key"])

    texts = texts.select(F.col("doc_id").cast("long"), "text")
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < COMMON_DOCS)
    counted = sample.mapInArrow(seen, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    frequent = counted.orderBy(F.desc("n"), "key").limit(COMMON).collect()
    common = np.array([r.key for r in reversed(frequent)], np.int64).view(np.uint64)
    return texts.mapInArrow(run, "key long, doc_id long")


class Search:
    """The links found so far between the representatives of distinct sets, and what has been tried."""

    def __init__(self, reps: DataFrame, texts: DataFrame, percent: int):
        self.spark: SparkSession = reps.sparkSession
        self.percent, self.texts = percent, texts
        self.narrow = reps.select("doc_id", "n_shingles", "regs")
        keys = reps.select("doc_id", F.explode("keys").alias("key"))
        shared = written(
            keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"), "shared"
        )
        self.buckets = written(split_join(keys, shared, "key").select("key", "doc_id"), "buckets")
        drop_written(shared)
        self.label: DataFrame | None = None
        self.tried: list[DataFrame] = []

    def named(self) -> DataFrame:
        """Members of keys with their component."""
        if self.label is None:
            return self.buckets.withColumn("comp", F.col("doc_id"))
        named = self.buckets.join(self.label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        return named.select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))

    def open_keys(self, named: DataFrame) -> DataFrame:
        """Keys that span several components, with their leader: the smallest member of the smallest component."""
        spans = named.groupBy("key").agg(F.min(F.struct("comp", "doc_id")).alias("lead"), F.max("comp").alias("most"), F.count("*").alias("n"))
        return spans.where("lead.comp <> most").select("key", "n", F.col("lead.doc_id").alias("a"), F.col("lead.comp").alias("lead_comp"))

    def untried(self, pairs: DataFrame) -> DataFrame:
        for old in self.tried:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        return pairs

    def meeting(self) -> bool:
        """One partner for each document; False where no document has an untried one."""
        named = written(self.named(), "named")
        spans = written(self.open_keys(named), "spans")
        offers = split_join(named, spans, "key").where("comp <> lead_comp").groupBy(F.col("doc_id").alias("b"), "a").agg(F.count("*").alias("n"))
        best = self.untried(offers).groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("s")).select((-F.col("s.a")).alias("a"), "b")
        some = self.test(best)
        drop_written(named, spans)
        return some

    def remainder(self) -> None:
        """Everything that is still open, block by block."""
        named = written(self.named(), "named")
        spans = written(self.open_keys(named).select("key", "n"), "spans")
        members = written(split_join(named, spans, "key"), "members")
        wide = BLOCK * BLOCKS
        small = members.where(F.col("n") <= wide).select("key", "doc_id", "comp", "n")
        spent = [named, spans, members]
        if not spans.where(F.col("n") > wide).isEmpty():
            # members of very large keys meet under their rare shingles instead, however many hold one
            large = written(members.where(F.col("n") > wide).select("doc_id", "comp").distinct(), "large")
            met = written(meeting_shingles(by_ids(self.texts, large, ["doc_id"]), large.count(), self.percent).distinct().join(large, "doc_id"), "met")
            spanning = met.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
            spanning = written(spanning.select("key", "n"), "spanning")
            spent += [large, met, spanning]
            small = small.unionByName(split_join(met, spanning, "key").select("key", "doc_id", "comp", "n"))
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        spread = dealt(small.withColumn("blocks", blocks).drop("n"))
        held = written(spread.select("doc_id").distinct().join(self.narrow, "doc_id").select("doc_id", "n_shingles", sketched(F.col("regs")).alias("sketch")), "held")
        sets = shingle_table(by_ids(self.texts, held, ["doc_id"]))
        own = written(held.join(sets, "doc_id"), "sets")
        links = written(block_links(spread.join(own, "doc_id"), self.percent), "links")
        self.merge(links)
        drop_written(*spent, held, own, links)

    def test(self, offered: DataFrame) -> bool:
        """Estimate, then confirm the pairs not tried before; new links merge components."""
        pairs = written(self.untried(offered), "offered")
        if pairs.isEmpty():
            drop_written(pairs)
            return False
        likely = written(self.plausible(pairs), "likely")
        used = written(likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct(), "used")
        links = written(confirm(likely, used, self.texts, self.percent), "links")
        self.tried.append(pairs)
        self.merge(links)
        drop_written(likely, used, links)
        return True

    def plausible(self, pairs: DataFrame) -> DataFrame:
        percent, least = self.percent, self.percent / 100 - SLACK

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x, y = (np.frombuffer(b"".join(pdf[c]), "<u2").reshape(len(pdf), REGISTERS) for c in ("ra", "rb"))
                j_hat = estimate((x == y).sum(axis=1), pdf["na"].to_numpy("f8"), pdf["nb"].to_numpy("f8"))
                yield pdf.loc[j_hat >= least, ["a", "b"]]

        side = lambda c: self.narrow.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("regs").alias(f"r{c}"))
        near = salted_join(pairs, side("a"), "a", "b").join(side("b"), "b").where(F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"))
        return near.select("a", "b", "na", "nb", "ra", "rb").mapInPandas(run, "a long, b long").distinct()

    def merge(self, links: DataFrame) -> None:
        """Components of the links over those found before."""
        if self.label is None:
            self.label = components(links)
            return
        if links.isEmpty():
            return
        lab = lambda c: self.label.select(F.col("node").alias(c), F.col("component").alias(f"l{c}"))
        at = lambda c: F.coalesce(F.col(f"l{c}"), F.col(c)).alias(c)
        between = components(links.join(lab("a"), "a", "left").join(lab("b"), "b", "left").select(at("a"), at("b")))
        moved = between.select(F.col("node").alias("component"), F.col("component").alias("to"))
        nodes = self.label.unionByName(between.select("node", F.col("node").alias("component")).join(self.label, "node", "left_anti"))
        label = written(nodes.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        drop_written(self.label, between)
        self.label = label

    def close(self) -> None:
        drop_written(self.buckets, *self.tried)


def sketched(regs: F.Column) -> F.Column:
    """The low bytes of the first SKETCH registers, of two bytes each, as one string of bytes."""
    return F.unhex(F.regexp_replace(F.hex(F.substring(regs, 1, 2 * SKETCH)), "(..)..", "$1"))


def classes(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Needs doc_id and text. A null text, or one without words, has the empty set: linked with nothing.
    Fewer than five words are one shingle. Rows that repeat a doc_id count as one document, each
    with its own n_shingles; its component holds what any of its texts is linked with. A row without doc_id is linked with nothing, component null, kept. An empty
    table gives an empty result."""
    signed = written(signatures(docs), "signatures")
    real = signed.where("set_id is not null and doc_id is not null")
    # Of equal sets the smallest id stands for all: copies go, which are few beside the wide rows that stay.
    sets = written(real.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "sets")
    ids = real.select("set_id", "doc_id")
    copies = written(split_join(ids, sets.where("n > 1"), "set_id").where("doc_id <> rep").select("set_id", "doc_id"), "copies")
    reps = written(by_ids(real, copies, ["set_id", "doc_id"], "left_anti").select("doc_id", "n_shingles", "regs", "keys"), "reps")
    search = Search(reps, docs, percent)
    for _ in range(MEETINGS):
        if not search.meeting():
            break
    search.remainder()
    search.close()

    narrow = signed.select("doc_id", "n_shingles", "set_id")
    rows = written(split_join(narrow.where("set_id is not null and doc_id is not null"), sets, "set_id").select("doc_id", "n_shingles", "rep"), "rows")
    # Texts under one id join what each is linked with.
    repeated = rows.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("doc_id")
    same = rows.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    same = written(same, "repeated")
    if search.label is None or not same.isEmpty():
        search.merge(same)
    of_set = sets.join(search.label, sets.rep == search.label.node, "left").select("rep", F.coalesce("component", "rep").alias("component"), "n")
    by_rep = written(of_set.groupBy("rep").agg(F.min("component").alias("component_id"), F.sum("n").alias("n")), "by_rep")
    linked = split_join(rows, by_rep, "rep").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("set_id is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    drop_written(reps, sets, copies, same)
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id."""
    gone = written(classes(docs, percent).where("not kept").select("doc_id"), "gone")
    return by_ids(docs, gone, ["doc_id"], "left_anti").select(docs.columns)
