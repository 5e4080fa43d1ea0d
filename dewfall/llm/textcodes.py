"""Array forms of texts: where their words lie, and hashes of spans by prefix sums, so that no word becomes a Python object."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A value for every byte or, above 255, for a code point's low and high part.
_rng = np.random.Generator(np.random.PCG64(20240229))
VALUES = _rng.integers(1, 2**63, 65_536, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the word: two rounds of multiply and shift."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64; they grow with the longest chunk seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (_BASE, _INVERSE))
        return self.up, self.down


_powers = Powers()


def prefix_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, up, down): (prefix[e] - prefix[s]) * down[s] is a value of span s to e, whatever stands before it.

    The value of a span with another after it is its own plus up[its length] times the other's."""
    up, down = _powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[: len(values)], out=total[1:])
    return total, up, down


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of values; equal spans have equal hashes wherever they lie."""
    total, _, down = prefix_values(values)
    with np.errstate(over="ignore"):
        return mixed((total[ends] - total[starts]) * down[starts])


def runs(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of True; `cuts` are places where a run ends and another may begin."""
    if not len(mask):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(mask))]
    first[cuts] |= mask[cuts]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[cuts - 1] |= mask[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return body, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: int, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(utf8(batch.column(column))[1])
        group = np.cumsum(sizes) // most
        edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield batch.slice(a, b - a)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words in turn, number of words of each text): A-Z lower-cased, words between 20 and 09-0D."""
    starts, ends = runs(~BLANK[data], offsets)
    hashes = span_hashes(VALUES[LOWER[data]], starts, ends)
    bounds = np.searchsorted(starts, offsets)
    return hashes, np.diff(bounds)
