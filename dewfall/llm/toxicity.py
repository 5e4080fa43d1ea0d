"""Toxicity scores of deobfuscated text.

Noisy channel: a token that mixes letters with digits or signs, repeats a letter, or is spelled out letter by letter becomes a lattice
of possible letters, with separators that are dropped or kept as word boundaries. Viterbi decoding under a character trigram
model of the whole corpus picks its most likely reading. The words of text and readings
and their character four-grams have log-odds between toxic and clean rows; a logistic model over a
document's highest ones gives the score. Both are fitted on a bounded sample of labelled rows.

Words, four-grams and their places are found in arrays, chunk by chunk; only tokens that may be disguised become Python objects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dewfall.llm.common import hash_sample
from dewfall.llm.textcodes import VALUES, chunks, mixed, prefix_values, runs, span_hashes

#: The model is fitted on about so many labelled rows of either class, picked by hash.
TOXIC_ROWS, CLEAN_ROWS = 3_000, 5_000
FEATURES = 1 << 20
THRESHOLD = 0.7
TOKENS_KEPT = 300_000

# Characters of the language model: Latin-1 letters in lower case; anything else is a boundary, 0.
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SIZE = 64
_INDEX = {c: k + 1 for k, c in enumerate(_LETTERS)}
_BYTES = np.zeros(256, np.int64)
for _c, _k in _INDEX.items():
    _BYTES[ord(_c)] = _k

#: Letters that a digit or sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Costs (negative logs) of the channel: a sign read as a letter, left out, or a repeat dropped (of two letters, of more).
AS_LETTER, LEFT_OUT, HALVED, DROPPED = 0.7, 6.0, 2.0, 0.3
#: Cost of a separator dropped; as a word boundary it costs what the language model asks.
JOINED = 1.5
#: Least log-odds of a word of toxic rows for which pieces of words are put together.
WORTH_JOINING = 1.0
_SIGNS = "@$!|+(<€£¡"
_ODD_PAIR = re.compile(r"[^\W\d_][\W\d_]|[\W\d_][^\W\d_]")
#: Ids that stay as they are: hexadecimal numbers, UUIDs, e-mail and web addresses.
_ID = re.compile(r"(?=.*\d)(?:0x)?[0-9a-f]{16,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}|(?:https?://|www\.).+")
_LATIN, _REPEAT = re.compile(rf"[{_LETTERS}]+"), re.compile(r"(.)\1+")
_PIECES = re.compile(r"[^\W\d_]+")

# Kinds of characters, by code point; those above the table count as its last entry.
BLANK, LETTER, DIGIT, SIGN, LINE, REST = range(6)
_KIND = np.full(0x10000, REST, np.uint8)
for _c in range(0x10000):
    _ch = chr(_c)
    if _ch.isalpha():
        _KIND[_c] = LETTER
    elif _ch.isalnum():
        _KIND[_c] = DIGIT
_KIND[[ord(_c) for _c in _SIGNS]] = SIGN
_KIND[ord("_")] = LINE
_KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
_NUMBERED = np.zeros(0x10000, np.uint8)
for _c, _k in _INDEX.items():
    _NUMBERED[ord(_c)] = _k


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all texts: SIZE^3 numbers at most, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in chunks(batches, 0):
            text = "\n\n".join(["", *(t or "" for t in batch.column(0).to_pylist()), ""])  # a boundary on both sides of each text
            x = _BYTES[np.frombuffer(text.lower().encode("latin-1", "replace"), np.uint8)]
            total += np.bincount(x[:-2] * SIZE * SIZE + x[1:-1] * SIZE + x[2:], minlength=SIZE**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE**3)
    out[rows["gram"].to_numpy("i8")] = rows["n"].to_numpy("f8")
    return out


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), each order smoothed by the one below it."""
    c3 = counts.reshape(SIZE, SIZE, SIZE)
    c2 = c3.sum(axis=0)
    c1 = c2.sum(axis=0)
    p1 = (c1 + 1.0) / (c1.sum() + SIZE)
    p2 = (c2 + 4.0 * p1) / (c2.sum(axis=1, keepdims=True) + 4.0)
    p3 = (c3 + 4.0 * p2) / (c3.sum(axis=2, keepdims=True) + 4.0)
    return -np.log(p3)


class Restorer:
    def __init__(self, costs: np.ndarray):
        self.costs = costs

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of one character its readings (letters or nothing) with channel costs; so long runs cost no more."""
        out, k = [], 0
        while k < len(token):
            c = token[k]
            run = 1
            while k + run < len(token) and token[k + run] == c:
                run += 1
            edge = k == 0 or k + run == len(token)
            k += run
            if not c.isalnum() and c not in LEET:  # a separator is dropped or a word boundary; more of them are one
                while k < len(token) and not token[k].isalnum() and token[k] not in LEET:
                    k += 1
                out.append([("", JOINED), (" ", 0.0)])
                continue
            if c.isalpha():
                if run > 1:  # a stretched letter stands once or twice
                    out.append([(c + c, 0.0), (c, HALVED if run == 2 else DROPPED)])
                else:
                    out.append([(c, 0.0)])
                continue
            twice = min(run, 2)
            own = [(x * twice, AS_LETTER * twice) for x in LEET.get(c, "")]
            if run > 2:
                own += [(x, AS_LETTER + DROPPED) for x in LEET.get(c, "")]
            out.append(own + [("", LEFT_OUT)] if edge or not own else own)
        return out

    def decode(self, token: str) -> str:
        """Viterbi: the cheapest reading under channel and language model; states are the last two letters."""
        states: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}
        for readings in self.lattice(token):
            after: dict[tuple[int, int], tuple] = {}
            for (a, b), (cost, path) in states.items():
                for letters, channel in readings:
                    x, y, total = a, b, cost + channel
                    for c in letters:
                        k = _INDEX.get(c, 0)
                        total += self.costs[x, y, k]
                        x, y = y, k
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, (path, letters) if letters else path)
            states = after
        path = min(((cost + self.costs[a, b, 0], path) for (a, b), (cost, path) in states.items()), key=lambda s: s[0])[1]
        out = []
        while path:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out))

    def __call__(self, word: str) -> list[str]:
        """The other words that a lower-case token, without edge signs, may be."""
        if _LATIN.fullmatch(word):
            return [w for w in (self.shortened(word),) if w != word]
        if _ID.fullmatch(word) or not _ODD_PAIR.search(word):
            return []
        return [w for w in dict.fromkeys(self.decode(word).split()) if w != word]

    def shortened(self, word: str) -> str:
        """decode() for letters alone: whether a repeat stays depends only on the letters beside it."""

        def pick(m: re.Match) -> str:
            b, c, d = (_INDEX.get(x, 0) for x in (word[m.start() - 1 : m.start()], m[1], word[m.end() : m.end() + 1]))
            off = HALVED if m.end() - m.start() == 2 else DROPPED
            return m[1] if off + self.costs[b, c, d] < self.costs[b, c, c] + self.costs[c, c, d] else m[1] * 2

        return _REPEAT.sub(pick, word)


class Chunk:
    """Code points of some lower-case texts in a row, one blank after each, with the kinds of the characters."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        self.text = "\n".join([*low, ""])
        self.offsets = np.cumsum([0, *(len(t) + 1 for t in low)])
        self.cps = np.frombuffer(self.text.encode("utf-32-le"), "<u4")
        self.kind = _KIND[np.minimum(self.cps, 0xFFFF)]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """The texts in which ascending places lie."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(np.searchsorted(at, self.offsets)))

    def cut(self, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        return [self.text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


_FIRST, _LAST = 0x2402, 0x2403  # stand at the edges of a word in its four-grams
_GRAM = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def word_features(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) for the words between starts and ends: the word itself, and its four-grams with its edges."""
    sizes = ends - starts
    wide = sizes + 2
    total = int(wide.sum())
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = np.repeat(np.arange(len(starts)), wide)
    head = np.cumsum(wide) - wide
    place = np.arange(total) - head[word]
    source = np.clip(starts[word] + place - 1, 0, len(cps) - 1)
    padded = np.where(place == 0, _FIRST, np.where(place == sizes[word] + 1, _LAST, cps[source]))
    values = VALUES[padded & 0xFFFF] + (padded >> 16).astype(np.uint64)
    with np.errstate(over="ignore"):
        tail = np.r_[values, np.zeros(3, np.uint64)]
        grams = tail[:total] * _GRAM[0] + tail[1 : total + 1] * _GRAM[1] + tail[2 : total + 2] * _GRAM[2]
        # two-letter words fill a window of four; the window at the last but one letter is four long as well
        grams = mixed(grams + tail[3 : total + 3] * _GRAM[3])
    inside = place < sizes[word] - 1
    whole = span_hashes(VALUES[cps & 0xFFFF] + (cps >> 16).astype(np.uint64), starts, ends)
    return np.r_[np.arange(len(starts)), word[inside]], (np.r_[whole, grams[inside]] & np.uint64(FEATURES - 1)).astype(np.int64)


def text_features(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, odds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for the words of texts; each different word is worked on once. odds: only features above 0."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = span_hashes(VALUES[cps & 0xFFFF] + (cps >> 16).astype(np.uint64), starts, ends)
    _, example, own = np.unique(hashes, return_index=True, return_inverse=True)
    word, feature = word_features(cps, starts[example], ends[example])
    if odds is not None:
        some = odds[feature] > 0
        word, feature = word[some], feature[some]
    order = np.argsort(word, kind="stable")
    feature = feature[order]
    at = np.searchsorted(word[order], np.arange(len(example) + 1))
    sizes = np.diff(at)[own]
    total = np.cumsum(sizes)
    picked = np.repeat(at[own] - total + sizes, sizes) + np.arange(total[-1])
    return np.repeat(doc, sizes), feature[picked]


def word_feature(word: str) -> int:
    """The feature of a word itself."""
    cps = np.frombuffer(word.encode("utf-32-le"), "<u4")
    return int(word_features(cps, np.array([0]), np.array([len(cps)]))[1][0])


class Featurizer:
    """Features of texts: of their words, of the readings of words that may be disguised, and of words spelled out.

    Runs of single characters are decoded with their separators. Beyond these, pieces that follow one another, whatever
    their lengths and separators, are also put together where they make a word of `lexicon`. Readings are remembered."""

    def __init__(self, costs: np.ndarray, lexicon: frozenset[str] = frozenset()):
        self.restore, self.known = Restorer(costs), {}
        self.lexicon = {self._raw(w): w for w in lexicon}
        self.starts = np.array(sorted({self._raw(w[:k]) for w in lexicon for k in range(1, len(w))}), np.uint64)
        self.whole = np.array(sorted(self.lexicon), np.uint64)
        self.read = np.union1d(self.starts, self.whole)

    @staticmethod
    def _raw(word: str) -> int:
        cps = np.frombuffer(word.encode("utf-32-le"), "<u4")
        return int(prefix_values(VALUES[cps & 0xFFFF] + (cps >> 16).astype(np.uint64))[0][-1])

    def readings(self, word: str) -> list[str]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= TOKENS_KEPT:
                self.known.clear()
            got = self.known[word] = self.restore(word)
        return got

    def spelled(self, c: Chunk) -> tuple[list[int], list[str]]:
        """(text, word) for words read from runs of three or more single characters, whatever stands between them."""
        a, b = runs((c.kind == LETTER) | (c.kind == DIGIT) | (c.kind == SIGN), np.empty(0, np.int64))
        doc = c.doc_of(a)
        single = b - a == 1
        linked = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
        s, e = runs(linked, np.empty(0, np.int64))  # links s..e-1 join units s..e
        letters = np.r_[0, np.cumsum(c.kind == LETTER)]
        good = (e - s >= 2) & (letters[b[np.minimum(e, len(b) - 1)]] > letters[a[s]]) if len(s) else np.zeros(0, bool)
        docs, words = [], []
        for d, text in zip(doc[s[good]].tolist(), c.cut(a[s[good]], b[e[good]]), strict=True):
            for w in dict.fromkeys(self.restore.decode(text).split()):
                docs.append(d)
                words.append(w)
        return docs, words

    def joined(self, c: Chunk) -> tuple[list[int], list[str]]:
        """(text, word) for words of the lexicon that two or more pieces in a row make."""
        docs, words = [], []
        if not len(self.whole):
            return docs, words
        a, b = runs(c.kind == LETTER, np.empty(0, np.int64))
        if not len(a):
            return docs, words
        raw, up, down = prefix_values(VALUES[c.cps & 0xFFFF] + (c.cps >> 16).astype(np.uint64))
        doc = c.doc_of(a)
        with np.errstate(over="ignore"):
            own = (raw[b] - raw[a]) * down[a]
            size = b - a
            alive = np.flatnonzero(among(own, self.starts))
            value, long, upto = own[alive], size[alive], alive
            while len(alive):
                more = (upto + 1 < len(a)) & (doc[np.minimum(upto + 1, len(a) - 1)] == doc[alive])
                alive, value, long, upto = alive[more], value[more], long[more], upto[more] + 1
                value = value + up[long] * own[upto]
                long = long + size[upto]
                more = among(value, self.read)
                alive, value, long, upto = alive[more], value[more], long[more], upto[more]
                for k in np.flatnonzero(among(value, self.whole)).tolist():
                    docs.append(int(doc[alive[k]]))
                    words.append(self.lexicon[int(value[k])])
                more = among(value, self.starts)
                alive, value, long, upto = alive[more], value[more], long[more], upto[more]
        return docs, words

    def stretched(self, c: Chunk, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which words of Latin letters read otherwise with a repeat shortened."""
        number = _NUMBERED[np.minimum(c.cps, 0xFFFF)].astype(np.int64)
        same = np.zeros(len(c.cps), bool)
        same[:-1] = (c.cps[1:] == c.cps[:-1]) & (number[1:] > 0)
        s, e = runs(same, np.empty(0, np.int64))  # characters s..e are equal
        foreign = np.r_[0, np.cumsum(number == 0)]
        latin = foreign[b] == foreign[a]
        word = np.searchsorted(a, s, "right") - 1
        fits = (word >= 0) & (e < b[word]) & latin[word] if len(a) else np.zeros(len(s), bool)
        s, e, word = s[fits], e[fits], word[fits]
        before = np.where(s > a[word], number[np.maximum(s - 1, 0)], 0)
        after = np.where(e + 1 < b[word], number[np.minimum(e + 1, len(number) - 1)], 0)
        x, costs = number[s], self.restore.costs
        once = np.where(e - s == 1, HALVED, DROPPED) + costs[before, x, after] < costs[before, x, x] + costs[x, x, after]
        out = np.zeros(len(a), bool)
        out[word[once | (e - s > 1)]] = True
        return out

    def read_all(self, texts: list[str | None]) -> tuple[Chunk, np.ndarray, np.ndarray, list[int], list[str]]:
        """The texts in arrays, the places of their plain words, and (text, word) for every other reading."""
        c = Chunk([t or "" for t in texts])
        starts, ends = runs(c.kind != BLANK, np.empty(0, np.int64))
        a, b = trimmed(starts, ends, (c.kind != BLANK) & (c.kind != REST))
        change = np.zeros(len(c.cps) + 1, np.int64)
        change[1 : len(c.cps)] = (c.kind[1:] == LETTER) != (c.kind[:-1] == LETTER)
        change = np.cumsum(change)  # change[k]: how many borders of letters lie before k
        odd = change[b - 1] > change[a]
        from_, upto = trimmed(a, b, (c.kind == LETTER) | (c.kind == DIGIT))
        stretched = self.stretched(c, from_, upto)
        docs, words = [], []
        for x, y in ((a[odd], b[odd]), (from_[stretched], upto[stretched])):
            for d, token in zip(c.doc_of(x).tolist(), c.cut(x, y), strict=True):
                for w in self.readings(token):
                    docs.append(d)
                    words.append(w)
        for more_docs, more in (self.spelled(c), self.joined(c)):
            docs += more_docs
            words += more
        return c, from_, upto, docs, words

    def words(self, texts: list[str | None]) -> list[set[str]]:
        """The plain words and the readings of each text."""
        c, a, b, docs, words = self.read_all(texts)
        out: list[set[str]] = [set() for _ in texts]
        for d, w in [*zip(c.doc_of(a).tolist(), c.cut(a, b), strict=True), *zip(docs, words, strict=True)]:
            out[d].add(w)
        return out

    def __call__(self, texts: list[str | None], odds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature) of all features found, with repeats, and the number of words of each text. odds: only features above 0."""
        c, a, b, docs, words = self.read_all(texts)
        doc = c.doc_of(a)
        found = [text_features(c.cps, a, b, doc, odds)]
        if words:
            read = np.frombuffer(" ".join(words).encode("utf-32-le"), "<u4")
            sizes = np.array([len(w) for w in words])
            at = np.cumsum(sizes + 1) - sizes - 1
            found.append(text_features(read, at, at + sizes, np.array(docs), odds))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.bincount(doc, minlength=len(texts))


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array known."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def trimmed(starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans cut back to their first and last place where `kept` holds; spans without one go."""
    places = np.flatnonzero(kept)
    count = np.zeros(len(kept) + 1, np.int32)
    np.cumsum(kept, out=count[1:])
    lo, hi = count[starts], count[ends]
    some = hi > lo
    return places[lo[some]], places[hi[some] - 1] + 1


#: Highest log-odds of a document that the second model sees, and pseudo-rows of a feature's prior.
TOP, PRIOR = 6, 6.0
STATS = TOP + 2


def standard(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """In deviations from the mean, four at most: a text unlike any in the sample, an empty one say, must not be judged by its length."""
    return np.clip((stats - mean) / spread, -4.0, 4.0)


class Model:
    """Log-odds of each feature between toxic and clean rows, and a logistic model over a document's highest ones."""

    #: Words worth putting together from pieces.
    lexicon: frozenset[str] = frozenset()

    def __init__(self, odds: np.ndarray, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray):
        self.odds, self.weights, self.mean, self.spread = odds, weights, mean, spread

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.c_[standard(stats, self.mean, self.spread), np.ones(len(stats))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def log_odds(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    toxic, clean = y.sum(), (1 - y).sum()

    def count(k: int) -> np.ndarray:
        out = np.zeros(FEATURES)
        for x, v in zip(found, y, strict=True):
            if v == k:
                out[x] += 1  # features of a row are distinct
        return out

    rate = toxic / (toxic + clean)
    return (np.log((count(1) + PRIOR * rate) / (toxic + PRIOR)) - np.log((count(0) + PRIOR * (1 - rate)) / (clean + PRIOR))).astype("f4")


def evidence(doc: np.ndarray, feature: np.ndarray, n_words: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """A row for each text: its TOP highest log-odds of different features, 0 for what lacks, and the logs of its number of words and of such features."""
    out = np.zeros((len(n_words), STATS))
    out[:, TOP] = np.log1p(n_words)
    v = odds[feature]
    some = v > 0
    doc, feature = doc[some], feature[some]
    key = np.unique(doc * FEATURES + feature)
    doc, v = key // FEATURES, odds[key % FEATURES]
    order = np.lexsort((-v, doc))
    doc, v = doc[order], v[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    kept = rank < TOP
    out[doc[kept], rank[kept]] = v[kept]
    out[:, TOP + 1] = np.log1p(np.bincount(doc, minlength=len(n_words)))
    return out


def fit(rows: list[tuple[int, bytes, int]], l2: float = 1e-3) -> Model:
    """Both models. The second learns from log-odds of the half that a row isn't in, so it isn't misled by chance features."""
    y = np.array([r[0] for r in rows], "f8")
    found = [np.frombuffer(r[1], np.int32) for r in rows]
    words = np.array([r[2] for r in rows], "f8")
    if min(y.sum(), (1 - y).sum()) < 2:
        rate = (y.sum() + 0.5) / (len(y) + 10.0)
        return Model(np.zeros(FEATURES, "f4"), np.append(np.zeros(STATS), np.log(rate / (1 - rate))), np.zeros(STATS), np.ones(STATS))
    half = np.zeros(len(y), int)
    for k in (0, 1):
        half[np.flatnonzero(y == k)[::2]] = 1
    stats = np.zeros((len(y), STATS))
    for k in (0, 1):
        others = np.flatnonzero(half != k)
        odds = log_odds([found[i] for i in others], y[others])
        own = np.flatnonzero(half == k)
        for part in np.array_split(own, max(1, len(own) // 250)):  # few rows at a time keep the driver small
            doc = np.repeat(np.arange(len(part)), [len(found[i]) for i in part])
            stats[part] = evidence(doc, np.concatenate([found[i] for i in part]).astype(np.int64), words[part], odds)
    mean, spread = stats.mean(axis=0), stats.std(axis=0)
    spread = np.where(spread < 1e-6, 1.0, spread)  # what never varies tells nothing
    x, w = np.c_[standard(stats, mean, spread), np.ones(len(y))], np.zeros(STATS + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(STATS + 1), x.T @ (p - y) / len(y) + l2 * w)
    return Model(log_odds(found, y), w, mean, spread)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1: rows that the model never learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


FEATURED = "doc_id {}, rank long, toxic int, features binary, n_words long, words string"


def lexicon(texts: list[str], odds: np.ndarray) -> frozenset[str]:
    """Words of three letters or more whose log-odds are WORTH_JOINING at least."""
    words = {w for t in texts for w in t.split(" ") if len(w) > 2}
    return frozenset(w for w in words if odds[word_feature(w)] >= WORTH_JOINING)


def train(docs: DataFrame, labels: DataFrame, costs: np.ndarray, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """The model from documents with a label that aren't held out; the driver sees feature numbers of the sample alone."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = hash_sample(known.where("toxic = 1"), toxic_rows, "doc_id").unionByName(hash_sample(known.where("toxic = 0"), clean_rows, "doc_id"))
    # an id that is labelled both ways is toxic
    picked = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.xxhash64("text").alias("rank"), "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(costs)
        for batch in chunks(batches, 3):
            toxic, texts = (c.to_pylist() for c in batch.columns[2:])
            doc, feature, n_words = features(texts)
            key = np.unique(doc * FEATURES + feature)
            at = np.searchsorted(key, np.arange(len(texts) + 1) * FEATURES)
            x = [(key[p:q] % FEATURES).astype(np.int32).tobytes() for p, q in zip(at[:-1], at[1:], strict=True)]
            words = [" ".join(sorted(set(_PIECES.findall((t or "").lower())))) if y else "" for y, t in zip(toxic, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], batch.column(2).cast(pa.int32()), pa.array(x, pa.binary()), pa.array(n_words, pa.int64()), pa.array(words, pa.string())],
                names=["doc_id", "rank", "toxic", "features", "n_words", "words"],
            )

    # of the texts of a repeated id the one whose hash comes first is learnt from, so rows are as many as ids that were picked
    found = texts.mapInArrow(run, FEATURED.format(docs.schema["doc_id"].dataType.simpleString()))
    first = found.groupBy("doc_id").agg(F.min(F.struct("rank", "toxic", "features", "n_words", "words")).alias("row"))
    rows = first.select("row.*").collect()
    model = fit(sorted((r.toxic, bytes(r.features), r.n_words) for r in rows))
    model.lexicon = lexicon([r.words for r in rows], model.odds)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score, predicted added.

    Needs doc_id and text in docs; doc_id and toxic in labels. The new names replace columns of the same name. A null or
    empty text has no features; it is scored all the same. Rows without doc_id aren't held out. Labels other
    than 0 and 1 are ignored; without labels of both classes every score is the base rate. Rows that repeat a text get equal
    scores. An empty table gives an empty result."""
    costs = trigram_costs(trigram_counts(docs))
    model = train(docs, labels, costs)
    base = docs.drop("held_out", "score", "predicted")
    schema = base.withColumn("score", F.lit(0.0)).schema
    at = base.columns.index("text")
    costs = costs.astype("f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(costs, model.lexicon)
        for batch in chunks(batches, at):
            p = model(evidence(*features(batch.column(at).to_pylist(), model.odds), model.odds))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "score"])

    out = base.mapInArrow(run, schema)
    return out.withColumns({"held_out": F.coalesce(held_out(F.col("doc_id")), F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})
