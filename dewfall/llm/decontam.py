"""Benchmark decontamination by a broadcast hash set of the normalised n-grams of test items.

An item's windows are its WIDTH consecutive words, or all its words where it has fewer. A block of items, bounded in bytes, becomes one
sorted array of window hashes, which is broadcast; a task hashes its documents' word windows, asks a bitmap and then the array,
and verifies every hit byte by byte, so a chance equality of hashes counts for nothing. Documents are never shuffled: a passage that a
third of them share costs each of them its own hits. Items beyond one block take further passes over the written results of the one before,
so what is broadcast at once is bounded however large the benchmark is."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dewfall.llm.common import drop_written, running_total, written
from dewfall.llm.textcodes import LOWER, VALUES, chunks, runs, span_hashes, utf8

#: Words of a window.
WIDTH = 10
#: Bytes of items' texts that are broadcast at once (one item may be longer); their set takes about ten times as many.
BLOCK = 4 << 20
#: Hits that are verified at once.
AT_ONCE = 20_000
#: Bytes of words: digits, letters, anything beyond ASCII.
INNER = np.zeros(256, bool)
INNER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_N_HIT = "aggregate(transform(hit, (v, k) -> if(k % 2 = 1, v, -v)), cast(0 as bigint), (a, v) -> a + v)"


class Words:
    """The words of some texts, lower-cased: their bytes without what separates them (body, at), hashes, and where each text's begin (bounds)."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        low, inner = LOWER[data], INNER[data]
        self.starts, self.ends = runs(inner, offsets)
        self.body = low[inner]
        self.at = np.r_[0, np.cumsum(self.ends - self.starts)]
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = span_hashes(VALUES[low], self.starts, self.ends)

    def windows(self, width: int) -> np.ndarray:
        """First words of the windows of `width` words that lie within one text."""
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))
        return np.flatnonzero(np.arange(len(last)) + width <= last)


def same(a: Words, i: np.ndarray, b: Words, j: np.ndarray, width: int) -> np.ndarray:
    """Whether `width` words of a from each of i equal those of b from each of j, byte by byte."""
    out = np.zeros(len(i), bool)
    steps = np.arange(1, width + 1)
    for k in range(0, len(i), AT_ONCE):
        x, y = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
        p, q = a.at[x], b.at[y]
        rows = np.flatnonzero((a.at[x[:, None] + steps] - p[:, None] == b.at[y[:, None] + steps] - q[:, None]).all(axis=1))
        size = a.at[x[rows] + width] - p[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        differ = a.body[p[rows][owner] + within] != b.body[q[rows][owner] + within]
        out[k + rows[np.bincount(owner[differ], minlength=len(rows)) == 0]] = True
    return out


class WindowSet:
    """The windows of one length of a block of items: sorted hashes, one entry for each different window, and the items that hold it."""

    def __init__(self, words: Words, items: np.ndarray, width: int, firsts: np.ndarray, owners: np.ndarray):
        self.width, self.words, self.items = width, words, items
        hashes = span_hashes(words.hashes, firsts, firsts + width)
        order = np.lexsort((owners, hashes))
        hashes, firsts, owners = hashes[order], firsts[order], owners[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]]
        group = np.cumsum(new) - 1
        heads = firsts[new]
        odd = np.flatnonzero(~same(words, firsts, words, heads[group], width))
        # windows that share a hash with another one, which chance hardly ever brings about, become entries of their own
        extra: dict[bytes, int] = {}
        hash_of = hashes[new].tolist()
        heads = heads.tolist()
        for k in odd.tolist():
            key = hashes[k].tobytes() + b" ".join(words.body[words.at[w] : words.at[w + 1]].tobytes() for w in range(firsts[k], firsts[k] + width))
            if key not in extra:
                extra[key] = len(heads)
                heads.append(int(firsts[k]))
                hash_of.append(hashes[k])
            group[k] = extra[key]
        order = np.argsort(np.array(hash_of, np.uint64), kind="stable")
        self.hashes, self.heads = np.array(hash_of, np.uint64)[order], np.array(heads, np.int64)[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[group], owners]), axis=1)
        self.item_of = pairs[1]
        self.item_at = np.searchsorted(pairs[0], np.arange(len(order) + 1))
        bits = max(16, int(16 * len(order) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[self.hashes >> self.shift] = True

    def hits(self, docs: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first words in docs, entries) of all verified occurrences."""
        at = docs.windows(self.width)
        hashes = span_hashes(docs.hashes, at, at + self.width)
        maybe = self.bitmap[hashes >> self.shift]
        at, hashes = at[maybe], hashes[maybe]
        low, high = (np.searchsorted(self.hashes, hashes, side) for side in ("left", "right"))
        n = high - low
        at, entry = np.repeat(at, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ok = same(docs, at, self.words, self.heads[entry], self.width)
        return at[ok], entry[ok]


def window_sets(items: pa.Table, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, list[WindowSet]]:
    """(item ids, which of them are known, sets by window length) of a block of items (item_id, text)."""
    ids = items["item_id"].combine_chunks().cast(pa.int64())
    words = Words(items["text"].combine_chunks())
    n = np.diff(words.bounds)
    length = np.minimum(n, width)
    out = []
    for w in np.unique(length[n > 0]).tolist():
        rows = np.flatnonzero(length == w)
        count = n[rows] - w + 1
        owners = np.repeat(rows, count)
        firsts = np.repeat(words.bounds[rows], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out.append(WindowSet(words, ids, w, firsts, owners))
    return ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), out


def marked(docs: Words, ids: np.ndarray, known: np.ndarray, sets: Sequence[WindowSet]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, texts, items): +1 and -1 where hits begin and end over all words, and the distinct pairs of a text and an item found in it."""
    n = len(docs.starts)
    owner = np.repeat(np.arange(len(docs.bounds) - 1), np.diff(docs.bounds))
    edges = np.zeros(n + 1, np.int64)
    pairs = []
    for s in sets:
        at, entry = s.hits(docs)
        edges += np.bincount(at, minlength=n + 1) - np.bincount(at + s.width, minlength=n + 1)
        found = np.unique(np.stack([owner[at], entry]), axis=1) if len(at) else np.empty((2, 0), np.int64)
        count = s.item_at[found[1] + 1] - s.item_at[found[1]]
        places = np.repeat(s.item_at[found[1]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rows = s.item_of[places]
        pairs.append(np.stack([np.repeat(found[0], count)[known[rows]], ids[rows][known[rows]]]))
    told = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), np.int64)
    return edges, told[0], told[1]


def blocks(benchmark: DataFrame, most: int) -> Iterator[pa.Table]:
    """The items with a text, in tables of about `most` bytes or of one item."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = F.octet_length("text").cast("decimal(38,0)")
    if (items.agg(F.sum(size)).first()[0] or 0) <= most:
        yield items.toArrow()
        return
    placed = written(running_total(items.withColumn("all", F.lit(0)), "all", ["item_id", "text"], size).withColumn("block", F.floor(F.col("before") / most)), "blocks")
    for row in placed.select("block").distinct().orderBy("block").toLocalIterator():
        yield placed.where(F.col("block") == row.block).select("item_id", "text").toArrow()
    drop_written(placed)


def scanned(df: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """df's columns as column_0, column_1 and on, then n_words, hit (first and end word of each hit stretch in turn) and items (ids, ascending)."""
    plain = [f"column_{k}" for k in range(len(df.columns))]
    spot = df.columns.index("text")
    spark = df.sparkSession
    moved = df.toDF(*plain)
    out = moved.selectExpr("*", "cast(null as bigint) as n_words", "cast(array() as array<bigint>) as hit", "cast(array() as array<bigint>) as items")
    kept = None
    for k, items in enumerate(blocks(benchmark, block)):
        if k:
            out = written(out, "scanned")
            if kept is not None:
                drop_written(kept)
            kept = out
        out = out.mapInArrow(_scan(uuid.uuid4().hex, spark.sparkContext.broadcast(items), spot, len(plain), width), out.schema)
    return out


_sets: list = [None, None]


def _scan(name: str, shared, spot: int, n_plain: int, width: int):
    """A function for mapInArrow that adds one block's hits to those that rows bring along. A worker builds the block's set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _sets[0] != name:
            _sets[:] = [name, window_sets(shared.value, width)]
        ids, known, sets = _sets[1]
        for part in chunks(batches, spot):
            docs = Words(part.column(spot))
            edges, texts, found = marked(docs, ids, known, sets)
            size = np.diff(docs.bounds)
            old, old_at = part.column(n_plain + 1), part.column(n_plain + 1).offsets.to_numpy()
            if len(old.values):
                values = old.values.to_numpy()[old_at[0] : old_at[-1]] + np.repeat(docs.bounds[:-1], np.diff(old_at))
                edges += np.bincount(values[0::2], minlength=len(edges)) - np.bincount(values[1::2], minlength=len(edges))
            hit = np.cumsum(edges[:-1]) > 0
            a, b = runs(hit, docs.bounds)
            owner = np.searchsorted(docs.bounds, a, "right") - 1
            base = docs.bounds[owner]
            flat = np.stack([a - base, b - base], axis=1).ravel()
            at = 2 * np.r_[0, np.cumsum(np.bincount(owner, minlength=len(size)))]
            earlier = part.column(n_plain + 2)
            held = np.diff(earlier.offsets.to_numpy())
            if len(earlier.values):
                lo = earlier.offsets.to_numpy()
                pairs = np.unique(np.stack([np.r_[texts, np.repeat(np.arange(len(held)), held)], np.r_[found, earlier.values.to_numpy()[lo[0] : lo[-1]]]]), axis=1)
                texts, found = pairs
            item_at = np.r_[0, np.cumsum(np.bincount(texts, minlength=len(size)))]
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:n_plain],
                    pa.array(size.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int64))),
                    pa.ListArray.from_arrays(pa.array(item_at.astype(np.int32)), pa.array(found.astype(np.int64))),
                ],
                names=[f"column_{k}" for k in range(n_plain)] + ["n_words", "hit", "items"],
            )

    return run


def scan(df: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): one row for each row of df, which needs doc_id and text; other columns are left aside.

    spans are the hit stretches (first, upto) in words, items the ids of the items (item_id, text) that have a window in the text,
    ascending. A null text has no words; a null item text has no windows; windows of items with a null id are hit, but not listed; a repeated
    item_id is one item with the windows of all its texts. Repeated rows stay each; an empty table gives no rows, an empty
    benchmark no hits. A text, and an item, has to fit in a task's memory."""
    spot = df.columns.index("doc_id")
    spans = F.expr("transform(filter(hit, (v, k) -> k % 2 = 0), (v, k) -> struct(v as first, hit[2 * k + 1] as upto))")
    return scanned(df, benchmark, width, block).select(F.col(f"column_{spot}").alias("doc_id"), "n_words", F.expr(_N_HIT).alias("n_hit"), "items", spans.alias("spans"))


def remove_documents(df: DataFrame, benchmark: DataFrame, most: float = 0.0, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """The rows of df of whose words at most the share `most` are hit; columns as in df."""
    n_hit = F.expr(_N_HIT)
    kept = scanned(df, benchmark, width, block).where((n_hit <= F.col("n_words") * most) | (n_hit == 0))
    return kept.drop("n_words", "hit", "items").toDF(*df.columns)


def remove_spans(df: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """df with the hit stretches cut out of text, from the first byte of their first word to the last of their last; columns as in df, nulls stay."""
    spot = df.columns.index("text")
    out = scanned(df, benchmark, width, block)
    n_hit = out.columns.index("hit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, spot):
            data, offsets = utf8(part.column(spot))
            starts, ends = runs(INNER[data], offsets)
            bounds = np.searchsorted(starts, offsets)
            at = part.column(n_hit).offsets.to_numpy()
            values = part.column(n_hit).values.to_numpy()[at[0] : at[-1]] + np.repeat(bounds[:-1], np.diff(at))
            edges = np.bincount(starts[values[0::2]], minlength=len(data) + 1) - np.bincount(ends[values[1::2] - 1], minlength=len(data) + 1)
            keep = np.cumsum(edges[:-1]) == 0
            cut = pa.StringArray.from_buffers(part.num_rows, pa.py_buffer(np.r_[0, np.cumsum(keep)][offsets].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[keep])))
            columns = list(part.columns[:n_hit - 1])
            columns[spot] = pc.if_else(pc.is_valid(columns[spot]), cut, columns[spot])
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[: n_hit - 1])

    return out.mapInArrow(run, out.drop("n_words", "hit", "items").schema).toDF(*df.columns)
