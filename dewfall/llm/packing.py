"""Packing token sequences by best-fit decreasing.

Documents are tokenised, cut into full windows and a rest. Rests are dealt at random into groups of
bounded size; in each group a segment tree indexed by remaining capacity finds the tightest open
window for each rest, longest first. Only lengths and checksums move between tasks, never tokens.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dewfall.llm.common import written
from dewfall.llm.textcodes import VALUES, chunks, runs, span_hashes

END = 2
#: Rests that one task packs together; groups hold about this many at any input size.
GROUP_PIECES = 50_000
#: Pieces of words whose token ids a worker remembers; beyond that it starts anew.
CACHE_PIECES = 1_200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, uid long"


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Classes of characters as the tokenizer's pattern parts words: what it surely treats so. Words with any other are encoded whole.
BLANK, LETTER, NUMBER, OTHER, UNSURE = range(5)
_LIMIT = 0x2060
_CLASS = np.full(_LIMIT + 1, UNSURE, np.uint8)
for _c in [*range(0x21, 0x7F), *range(0xA1, 0x100), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
    if _c != 0xAD:
        _CLASS[_c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(_c))[0], OTHER)
_CLASS[[0x20, *range(0x09, 0x0E)]] = BLANK
_CLASS[ord("'")] = UNSURE  # starts pieces like 's
_LOWER = np.arange(_LIMIT + 1, dtype=np.uint32)
for _c in range(0x100):
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())
_WHOLE = np.uint64(0x5851F42D4C957F2D)


def parts_words(path: str) -> bool:
    """Whether a tokenizer file is of the kind whose words can be encoded apart: lower case, split by the known pattern, with word ends."""
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    split = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    # Fixed value: the pattern by which the tokenizer splits words.
    known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return kind["model"].get("end_of_word_suffix") == "</w>" and (split[0].get("pattern") or {}).get("Regex") == known and kind.get("post_processor") is None


class Known:
    """64-bit hashes, numbered as they come: a long sorted list and a short one for the latest, 12 bytes a hash where a dictionary takes over a hundred."""

    def __init__(self) -> None:
        self.long = self.short = (np.empty(0, np.uint64), np.empty(0, np.int32))

    def __len__(self) -> int:
        return len(self.long[0]) + len(self.short[0])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those not known."""
        out = np.full(len(hashes), -1, np.int64)
        for told, number in (self.long, self.short):
            if len(told):
                at = np.minimum(np.searchsorted(told, hashes), len(told) - 1)
                hit = told[at] == hashes
                out[hit] = number[at[hit]]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Sorted hashes, each once and none known yet."""
        new = (hashes, np.arange(len(self), len(self) + len(hashes), dtype=np.int32))
        self.short = self._merged(self.short, new)
        if 8 * len(self.short[0]) > len(self.long[0]):
            self.long, self.short = self._merged(self.long, self.short), (hashes[:0], new[1][:0])

    @staticmethod
    def _merged(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(x[0], y[0])
        return np.insert(x[0], at, y[0]), np.insert(x[1], at, y[1])


class Encoder:
    """Token ids of many texts at once.

    The tokenizer never merges over white space, nor between letters, digits and signs, so a text's ids are those of its pieces in
    turn. Pieces are found and told apart by their hashes, in arrays; each is encoded once and remembered. New pieces are
    encoded in one call; each ends with a token that ends a word. Words with characters outside the sure classes are encoded whole.
    A tokenizer file of another kind encodes each text as it is."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)  # the same model, not a copy; sure pieces hold no special token
        self.apart = parts_words(path)
        # pieces are in lower case and split already
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = Known()
        self.flat, self.used = np.empty(1 << 16, "<u4"), 0
        self.start, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(sizes) > len(self.size):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(sizes)] = sizes
        self.used += len(ids)
        self.known.add(hashes)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], np.int64)
        return np.array([i for x in ids for i in x], "<u4"), sizes

    def _learn(self, hashes: np.ndarray, pieces: str, n: int) -> None:
        ids = np.array(self.plain.encode_batch_fast([pieces], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != n:
            raise ValueError("a piece does not end with a word end")
        self._keep(hashes, ids, np.diff(np.r_[0, last]))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of text k are ids[bounds[k] : bounds[k + 1]]."""
        if not self.apart:
            ids, sizes = self._encoded(texts)
            return ids, np.r_[0, np.cumsum(sizes)]
        if len(self.known) > CACHE_PIECES:
            self.forget()
        whole = "\n".join(texts)
        cps = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        sure = np.minimum(cps, _LIMIT)
        kind = _CLASS[sure]
        starts, ends = runs(kind != BLANK, np.empty(0, np.int64))
        odd = kind == UNSURE
        odd[:-1] |= (cps[:-1] == ord("<")) & (cps[1:] == ord("|"))  # special tokens
        count = np.r_[0, np.cumsum(odd)]
        bad = count[ends] > count[starts]
        step = np.zeros(len(cps) + 1, np.int8)
        step[starts[bad]] += 1
        step[ends[bad]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
        first = kind != BLANK
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        first &= ~inside
        first[starts[bad]] = True
        at = np.flatnonzero(first)
        upto = np.minimum(np.r_[at[1:], len(cps)], ends[np.searchsorted(starts, at, "right") - 1]) if len(at) else at
        letters = np.where(inside, cps, _LOWER[sure])
        hashes = span_hashes(VALUES[letters & 0xFFFF] + (letters >> 16).astype(np.uint64), at, upto)
        hashes[inside[at]] ^= _WHOLE
        distinct, example, place = np.unique(hashes, return_index=True, return_inverse=True)
        rows = self.known.find(distinct)
        new = np.flatnonzero(rows < 0)
        if len(new):
            told, show = distinct[new], example[new]
            entire = inside[at[show]]
            for pick in (False, True):
                a, b = at[show[entire == pick]].tolist(), upto[show[entire == pick]].tolist()
                text, hashed = [whole[x:y] for x, y in zip(a, b, strict=True)], told[entire == pick]
                if pick and text:
                    self._keep(hashed, *self._encoded(text))
                elif text:
                    self._learn(hashed, " ".join(text).lower(), len(text))
            rows = self.known.find(distinct)
        own = rows[place]
        sizes = self.size[own]
        total = np.r_[0, np.cumsum(sizes)]
        ids = self.flat[np.repeat(self.start[own] - total[:-1], sizes) + np.arange(total[-1])]
        texts_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return ids, total[np.searchsorted(at, texts_at)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that the pieces it remembers outlive a task."""
    return Encoder(path)


def pieces(docs: DataFrame, window: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece: full windows from the start of the document, then the rest.

    A null text counts as empty: one piece that holds the end id alone. uid numbers rows of the input apart."""
    path = tokenizer or public_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(path)
        for batch in chunks(batches, 1):
            own, bounds = encode([t or "" for t in batch.column(1).to_pylist()])
            ids = np.insert(own, bounds[1:], END)
            bounds = bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            windows = -(-sizes // window)
            row = np.repeat(np.arange(len(sizes)), windows)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)) * window
            length = np.minimum(sizes[row] - start, window)
            at = bounds[row] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()).take(take), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(sizes[row]), batch.column(2).take(take)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "uid"],
            )

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("uid")).mapInArrow(run, PIECES)


class OpenWindows:
    """Segment tree over remaining capacities 0..window: how many open windows are left in each subtree."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.at[room].append(sequence)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest window with at least that much room."""
        node = least + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.at[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) for lengths in descending order, none above window."""
    tree, sequence, offset, n = OpenWindows(window), np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8"), 0
    for k, length in enumerate(lengths.tolist()):
        found = tree.take(length)
        if found is None:
            found, n = (window, n), n + 1
        room, seq = found
        sequence[k], offset[k] = seq, window - room
        if room > length:
            tree.put(room - length, seq)
    return sequence, offset


def pack(docs: DataFrame, window: int = 4096, tokenizer: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded) for every piece of every document.

    Needs doc_id and text; other columns are ignored. Each row of docs is packed, also those that
    repeat a doc_id or a text. Offsets in a sequence run gapless from 0; padded is the length that
    the sequence is padded to: `window`, or its own length where that is a power of two. An empty table
    gives no pieces."""
    cut = written(pieces(docs, window, tokenizer), "pieces")
    rests = cut.where(F.col("length") < window)
    groups = max(1, -(-rests.count() // group_pieces))
    stride = 1 << 32
    full = cut.where(F.col("length") == window).withColumns(
        # a window of its own: numbered by partition, above the groups
        {"sequence_id": F.monotonically_increasing_id() + F.lit(groups * stride), "offset": F.lit(0).cast("long"), "padded": F.lit(window).cast("long")}
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "uid"], ascending=[False, True, True], ignore_index=True)
        seq, off = best_fit(pdf["length"].to_numpy(), window)
        used = np.bincount(seq, pdf["length"].to_numpy()).astype("i8")
        padded = np.where(used & (used - 1), window, used)
        return pdf.assign(sequence_id=key[0] * stride + seq, offset=off, padded=padded[seq])

    packed = (
        rests.withColumn("g", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(groups)))
        .groupBy("g")
        .applyInPandas(lambda key, pdf: run(key, pdf.drop(columns="g")), f"{PIECES}, sequence_id long, offset long, padded long")
    )
    return packed.unionByName(full).drop("uid")


