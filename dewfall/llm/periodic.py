"""Periodic runs of words, by a sparse diagonal dynamic program over each text.

On the diagonal of lag p, word i lengthens the match that word i - 1 had there if word i - p equals it; where a match ends, its
length tells whether a run ended. Over all earlier occurrences of every word that is as many steps as there are equal
pairs, the square of a frequent word's count. Two facts keep the diagonals sparse without losing a run:

* A run of period q and length at least max(LEAST, 3 q) holds a match on lag q of at least LEAST - 8 words, and of 2 q. So the words that
  step through the program are blocks of consecutive words, FIRST long for lags below FIRST, and 2^k long for lags from 2^(k-1) up to 2^k.
  A block that occurs once in its text opens no diagonal, which is the fate of nearly all.
* Within a run of smallest period q, the nearest earlier occurrence of a block of at least q words is exactly q words back (two
  periods of a stretch as long as both together have their common divisor as a period). So of a block's earlier occurrences the
  nearest alone lengthens a diagonal of this length class, one diagonal is active at a time, and where its lag changes or its occurrences end,
  the run is told at once: no longer one keeps the period, and no smaller period fits.

Blocks are numbered exactly, by pairs of the numbers of their halves; hashes only sort out texts without any repeated block. A
text of n words takes at most about log2(n) rounds over its words, whatever it repeats. Batches of Arrow rows are cut by bytes of text; a longer text is worked on alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dewfall.llm.textcodes import BLANK, chunks, mixed, runs, span_hashes, utf8

#: Least length of a run in words, and least length in periods.
LEAST, TIMES = 24, 3
#: Length of the blocks that serve all lags below it: no run's match is shorter.
FIRST = 16
RUN = "array<struct<start:long,length:long,period:long>>"


def numbered(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal pairs alone."""
    if not len(high):
        return high
    return np.unique(high * (int(low.max()) + 1) + low, return_inverse=True)[1].astype(np.int64)


def repeating(ids: np.ndarray, owner: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The texts in which a block of FIRST words may occur twice, by hashes: none that has one is left out."""
    at = np.flatnonzero(np.arange(len(ids)) + FIRST <= last)
    with np.errstate(over="ignore"):
        words = mixed(ids.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        keys = mixed(span_hashes(words, at, at + FIRST) + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    twice = keys[order][1:] == keys[order][:-1]
    return np.unique(owner[at[order[1:][twice]]])


def found(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period. ids are the words of all texts in turn, bounds where each text's begin."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.repeat(bounds[:-1], sizes)
    last = first + np.repeat(sizes, sizes)
    none = np.empty(0, np.int64)
    out = [(none, none, none)]
    live = repeating(ids, owner, last)
    at = np.flatnonzero(np.isin(owner, live)) if len(live) else none
    rank = np.zeros(len(ids), np.int64)
    rank[at] = numbered(owner[at], ids[at].astype(np.int64))
    width = 1
    while len(at):
        at = at[at + 2 * width <= last[at]]
        rank[at] = numbered(rank[at], rank[at + width])  # the right side is read whole before any is replaced
        width *= 2
        if width < FIRST:
            continue
        order = at[np.argsort(rank[at], kind="stable")]
        again = rank[order[1:]] == rank[order[:-1]]
        here, lag = order[1:][again], (order[1:] - order[:-1])[again]
        # longer periods need texts that repeat a block of this length, and hold three of them
        live = np.unique(owner[here])
        at = at[np.isin(owner[at], live) & (last[at] - first[at] >= TIMES * width)]
        mine = (lag < width) & (lag >= (width // 2 if width > FIRST else 1))
        here, lag = here[mine], lag[mine]
        if not len(here):
            continue
        order = np.argsort(here)
        here, lag = here[order], lag[order]
        # a diagonal goes on while the next word is on the same lag
        new = np.flatnonzero(np.r_[True, (np.diff(here) != 1) | (np.diff(lag) != 0)])
        period = lag[new]
        length = np.diff(np.r_[new, len(here)]) + width - 1 + period
        ok = length >= np.maximum(LEAST, TIMES * period)
        out.append((here[new][ok] - period[ok], length[ok], period[ok]))
    start, length, period = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = owner[start] if len(start) else none
    return text, start - bounds[text], length, period


def after_first(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stand in a run beyond its first period."""
    edges = np.bincount(start + period, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def worked(column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(number of words, runs, collapsed text) of each text of a column."""
    data, offsets = utf8(column)
    starts, ends = runs(~BLANK[data], offsets)
    bounds = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(len(column)), np.diff(bounds))
    solid = ~BLANK[data]
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(ends - starts)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[solid]))]
    )
    ids = words.dictionary_encode().indices.to_numpy()
    text, start, length, period = found(ids, bounds)
    per_text = np.r_[0, np.cumsum(np.bincount(text, minlength=len(column)))].astype(np.int32)
    told = pa.ListArray.from_arrays(pa.array(per_text), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"]))

    kept = np.flatnonzero(~after_first(len(starts), start + bounds[text], length, period))
    keep = np.zeros(len(data), bool)
    keep[solid] = np.repeat(np.isin(np.arange(len(starts)), kept, assume_unique=True), ends - starts)
    # the separator behind a kept word stays if another kept word of its text follows
    keep[ends[kept[:-1][owner[kept[1:]] == owner[kept[:-1]]]]] = True
    body = np.where(solid, data, 0x20).astype(np.uint8)[keep]
    at = np.r_[0, np.cumsum(keep)][offsets].astype(np.int32)
    collapsed = pa.StringArray.from_buffers(len(column), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body)))
    return pa.array(np.diff(bounds).astype(np.int64)), told, collapsed


def find_runs(df: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): one row for each row of df, which needs doc_id and text; other columns are left aside.

    runs has (start, length, period) in words by start and period: every stretch of at least max(24, 3 periods) words that keeps its
    smallest period and that no neighbour extends. collapsed has the words, joined by one space, that no run contains
    after its first period. A null text is empty: no words, no runs, an empty collapsed text. A null
    doc_id stays, repeated rows stay each, an empty table gives no rows. Runs may overlap. A text has to fit in a task's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), *worked(part.column(1))], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUN}, collapsed string")


def collapse(df: DataFrame) -> DataFrame:
    """df, with the same columns, whose text keeps one period of every run. Texts without runs, and nulls, stay as they are, separators included."""
    names = df.columns
    plain = [f"column_{k}" for k in range(len(names))]
    spot = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, spot):
            _, told, collapsed = worked(part.column(spot))
            changed = pc.greater(pc.list_value_length(told), 0)
            columns = list(part.columns)
            columns[spot] = pc.if_else(changed, collapsed, columns[spot])
            yield pa.RecordBatch.from_arrays(columns, names=plain)

    moved = df.toDF(*plain)
    return moved.mapInArrow(run, moved.schema).toDF(*names)


def best_run() -> Column:
    """Of a column `runs`, the run with the greatest length / period, compared exactly; the earlier of equal ones; null without runs."""
    least = F.expr("struct(cast(0 as bigint) as start, cast(0 as bigint) as length, cast(1 as bigint) as period)")
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    return F.when(F.size("runs") > 0, F.aggregate("runs", least, better))
