"""Personal data: patterns with checks, and a skip-chain conditional random field that adds to them.

Tokens with a digit or an at sign are the nodes of a document's field. Neighbouring tokens are joined
in a chain, and tokens that repeat or resemble an earlier one by a skip edge. Tokens inside a
pattern's match are observed; loopy message passing spreads their labels along both kinds of edges, so that a repeat in another
form gets its entity's label. The documents of a piece of a batch, cut by bytes of text, are passed as one graph in flat arrays. Weights come from
pseudo-likelihood on a bounded sample, with the patterns' matches as labels.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dewfall.llm.common import hash_sample
from dewfall.llm.textcodes import chunks

KINDS = ("email", "ip", "card", "phone")
#: The field is fitted on about so many documents, picked by hash.
SAMPLE_DOCS = 3_000
#: Bytes of their tokens that come to the driver at most, about forty to a token.
SAMPLE_BYTES = 32 << 20
BUCKETS = 1 << 12
FEATURES = 7
#: Least marginal probability of a span that the field adds, beside its link to an observed entity of the kind.
SURE = 0.5
PASSES = 8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of these begins where its run of digits begins, so the guards leave results as they are.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = frozenset(" \t\n\x0b\x0c\r")
_GAP = re.compile(r"[ \t-\r]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches that pass their checks, by start, then kind."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted((s, e, k) for s, e, k in out)


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def _numbers() -> array:
    return array("i")


@dataclass
class Graph:
    """Tokens of any number of documents, as flat arrays of numbers: places, observed labels (0 none, 1.. kinds), FEATURES features each, edges of three (a, b, 0 chain or 1 skip)."""

    starts: array = field(default_factory=_numbers)
    ends: array = field(default_factory=_numbers)
    label: array = field(default_factory=_numbers)
    features: array = field(default_factory=_numbers)
    edges: array = field(default_factory=_numbers)

    def feature_rows(self) -> np.ndarray:
        return np.array(self.features, "i4").reshape(-1, FEATURES)

    def edge_rows(self) -> np.ndarray:
        return np.array(self.edges, "i4").reshape(-1, 3)

    def add(self, text: str, spans: list[tuple[int, int, int]]) -> range:
        """The nodes of one more document."""
        first, at = len(self.starts), 0
        seen: dict[str, int] = {}
        k = 0
        order = sorted(spans)
        open_: list[tuple[int, int, int]] = []  # spans that reach the token; those of one kind never overlap, so there are four at most
        while m := _MARK.search(text, at):
            s = m.start()
            while s > at and text[s - 1] not in _SPACE:
                s -= 1
            g = _GAP.search(text, m.end())
            e = g.start() if g else len(text)
            open_ = [x for x in open_ if x[1] > s]
            while k < len(order) and order[k][0] < e:
                if order[k][1] > s:
                    open_.append(order[k])
                k += 1
            hit = open_[0] if open_ else None  # of several spans the one that starts first
            node = len(self.starts)
            self.starts.append(s)
            self.ends.append(e)
            self.label.append(1 + hit[2] if hit else 0)
            token = text[s:e]
            self.features.extend(self.describe(text, s, e, token))
            if node > first and s - self.ends[node - 1] == 1:
                self.edges.extend((node - 1, node, 0))
            keys = self.resemblance(token)
            if hit and e >= hit[1]:  # an entity of several tokens is met whole at its last one
                keys = list(dict.fromkeys([*keys, *self.resemblance(text[hit[0] : hit[1]])]))
            for key in keys:
                if key in seen and seen[key] != node:
                    self.edges.extend((seen[key], node, 1))
                seen[key] = node
            at = e
        return range(first, len(self.starts))

    @staticmethod
    def describe(text: str, s: int, e: int, token: str) -> list[int]:
        shape = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", token))
        digits = sum("0" <= c <= "9" for c in token)
        before = text[max(0, s - 24) : s].split()
        after = text[e : e + 24].split()
        words = (f"s{shape}", f"c{re.sub(r'(.)\1+', r'\1', shape)}", f"d{digits if digits < 24 else digits.bit_length() + 24}", f"l{len(token) if len(token) < 16 else len(token).bit_length() + 16}", f"p{before[-1].lower() if before else ''}", f"n{after[0].lower() if after else ''}", "bias")
        return [zlib.crc32(w.encode()) % BUCKETS for w in words]

    @staticmethod
    def resemblance(token: str) -> list[str]:
        """Keys under which a token meets earlier ones: its letters and digits, an address's local part, its last seven digits."""
        keys = [re.sub(r"[\W_]+", "", token.lower())]
        if "@" in token:
            keys.append(re.sub(r"[\W_]+", "", token.lower().partition("@")[0]))
        digits = re.sub(r"[^0-9]+", "", token)
        if len(digits) >= 7:
            keys.append(f"#{digits[-7:]}")
        return [k for k in dict.fromkeys(keys) if len(k) >= 4]


@dataclass
class Weights:
    """Scores: node features by label, and pairs of labels for chain and skip edges."""

    node: np.ndarray
    edge: np.ndarray

    @classmethod
    def none(cls) -> Weights:
        edge = np.zeros((2, len(KINDS) + 1, len(KINDS) + 1))
        node = np.zeros((BUCKETS, len(KINDS) + 1))
        node[:, 0] = 1.0
        return cls(node, edge)


def marginals(graph: Graph, w: Weights) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product; observed entity tokens are held to their label."""
    n, k = len(graph.starts), len(KINDS) + 1
    features = graph.feature_rows()
    score = sum(w.node[features[:, f]] for f in range(FEATURES))
    seen = np.array(graph.label)
    score[seen > 0] = -50.0
    score[seen > 0, seen[seen > 0]] = 0.0
    if graph.edges:
        e = graph.edge_rows()
        src, dst = np.r_[e[:, 0], e[:, 1]], np.r_[e[:, 1], e[:, 0]]
        back = np.r_[np.arange(len(e), 2 * len(e)), np.arange(len(e))]
        pair = np.concatenate([w.edge[e[:, 2]], w.edge[e[:, 2]].transpose(0, 2, 1)])
        message = np.zeros((2 * len(e), k))
        for _ in range(PASSES):
            total = score.copy()
            np.add.at(total, dst, message)
            out = (total[src] - message[back])[:, :, None] + pair
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            message = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))  # damped
        np.add.at(score, dst, message)
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def learn(graph: Graph, steps: int = 120, l2: float = 1e-4) -> Weights:
    """Pseudo-likelihood: each label given the token's features and its neighbours' labels.

    Features of a third of the labelled tokens are hidden, so that their labels are learnt from their neighbours; unlabelled
    tokens that repeat a labelled one are left out, as they are what the field is to find."""
    n, k = len(graph.starts), len(KINDS) + 1
    if not n:
        return Weights.none()
    f, y = graph.feature_rows(), np.array(graph.label)
    e = graph.edge_rows()
    beside = np.zeros((n, 2, k))  # how many neighbours over each kind of edge have each label
    np.add.at(beside, (e[:, 0], e[:, 2], y[e[:, 1]]), 1.0)
    np.add.at(beside, (e[:, 1], e[:, 2], y[e[:, 0]]), 1.0)
    repeats = beside[:, 1, 1:].sum(axis=1)
    counted = ((y > 0) | (repeats == 0)).astype(float)
    beside = beside.reshape(n, 2 * k)
    hidden = (y > 0) & (np.arange(n) % 3 == 0)
    shown = (~hidden).astype(float)[:, None]
    w, c = np.zeros((BUCKETS, k)), np.zeros((2 * k, k))
    w[:, 0] = 0.1
    mw, mc, vw, vc = np.zeros_like(w), np.zeros_like(c), np.zeros_like(w), np.zeros_like(c)
    want = np.eye(k)[y]
    for t in range(1, steps + 1):
        z = w[f].sum(axis=1) * shown + beside @ c
        p = np.exp(z - z.max(axis=1, keepdims=True))
        gap = (p / p.sum(axis=1, keepdims=True) - want) * counted[:, None] / n
        gw = np.stack([np.bincount(f.ravel(), np.repeat(gap[:, j] * shown[:, 0], FEATURES), BUCKETS) for j in range(k)], axis=1) + l2 * w
        gc = beside.T @ gap + l2 * c
        for g, x, m, v in ((gw, w, mw, vw), (gc, c, mc, vc)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    edge = c.reshape(2, k, k)
    return Weights(w, (edge + edge.transpose(0, 2, 1)) / 2)


def supported(graph: Graph) -> set[tuple[int, int]]:
    """(node, label) where a skip edge leads to a token observed with that label."""
    e, label = graph.edge_rows(), np.array(graph.label, int)
    skips = e[e[:, 2] == 1]
    ends = np.r_[skips[:, :2], skips[:, 1::-1]]
    ends = ends[label[ends[:, 1]] > 0] if len(ends) else ends
    return set(zip(ends[:, 0].tolist(), label[ends[:, 1]].tolist(), strict=True))


def added_spans(text: str, nodes: range, graph: Graph, p: np.ndarray, base: list[tuple[int, int, int]], backed: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Spans of sure tokens that no pattern has found; neighbours of one kind are one span. A token counts only where it repeats or resembles an observed
    one of its kind, itself or through a neighbour in its span: what merely looks like an entity failed its pattern's check."""
    out: list[tuple[int, int, int]] = []
    last = -2
    for x in nodes:
        kind = int(p[x].argmax())
        if kind and not graph.label[x] and p[x, kind] >= SURE and ((x, kind) in backed or (out and last == x - 1 and out[-1][2] == kind - 1)):
            s, e = graph.starts[x], graph.ends[x]
            while s < e and not (text[s].isalnum() or text[s] in "+("):
                s += 1
            while e > s and not text[e - 1].isalnum():
                e -= 1
            if s == e:
                continue
            if out and last == x - 1 and out[-1][2] == kind - 1 and graph.starts[x] - graph.ends[last] == 1:
                out[-1] = (out[-1][0], e, kind - 1)
            else:
                out.append((s, e, kind - 1))
            last = x
    kept, ends = [], []  # ends: the furthest end among base spans up to each, as they stand by start
    for _, e, _ in base:
        ends.append(max(e, ends[-1]) if ends else e)
    starts = [b[0] for b in base]
    for x in out:
        before = bisect_left(starts, x[1])  # base spans that start before x ends
        if not before or ends[before - 1] <= x[0]:
            kept.append(x)
    return kept


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Weights:
    """Weights from about `sample` documents; the driver sees only feature numbers, labels and edges of their tokens, SAMPLE_BYTES at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                g = Graph()
                g.add(text or "", base_spans(text or ""))
                if g.starts:
                    head = np.array([len(g.starts), len(g.edges) // 3], "<i4")
                    out.append(b"".join(np.array(x, "<i4").tobytes() for x in (head, g.label, g.features, g.edges)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["g"])

    made = hash_sample(docs.select("doc_id", "text"), sample, "doc_id").select("text").mapInArrow(run, "g binary")
    # texts of a tenth of the bound, or that would pass it together, are no part of the sample
    size = F.octet_length("g")
    upto = F.sum(size).over(Window.orderBy(F.xxhash64("g"), "g").rowsBetween(Window.unboundedPreceding, 0))  # `sample` rows at most
    rows = sorted(bytes(r.g) for r in made.where(size <= SAMPLE_BYTES // 10).withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).collect())
    whole = Graph()
    for raw in rows:
        x = np.frombuffer(raw, "<i4")
        n, m = int(x[0]), int(x[1])
        at = len(whole.label)
        whole.label.extend(x[2 : 2 + n].tolist())
        whole.features.extend(x[2 + n : 2 + n * (1 + FEATURES)].tolist())
        moved = x[2 + n * (1 + FEATURES) :].reshape(m, 3) + np.array([at, at, 0], "<i4")
        whole.edges.extend(moved.ravel().tolist())
    whole.starts.extend([0] * len(whole.label))
    return learn(whole)


def found_in(texts: list[str], w: Weights) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(pattern spans, added spans) of each text."""
    graph, base, nodes = Graph(), [], []
    for t in texts:
        base.append(base_spans(t))
        nodes.append(graph.add(t, base[-1]))
    p = marginals(graph, w) if graph.starts else np.empty((0, len(KINDS) + 1))
    backed = supported(graph)
    for t, b, r in zip(texts, base, nodes, strict=True):
        yield b, added_spans(t, r, graph, p, b, backed)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs.

    Needs doc_id and text; a null text counts as empty. The counts and the digest are of the patterns' matches, spans lists those
    and what the field adds. Rows that repeat are each searched. An empty table gives an empty result."""
    w = weights or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in chunks(batches, 1):
            for at in range(0, cut.num_rows, 1_000):
                part = cut.slice(at, 1_000)
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                rows = []
                for doc, (base, more) in zip(ids, found_in(texts, w), strict=True):
                    counts = [sum(x[2] == k for x in base) for k in range(len(KINDS))]
                    rows.append((doc, *counts, hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(base + more)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.string()] * 2, strict=True)],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or run of overlapping spans, gives way to the name of its first kind."""
    out, at, end, kind = [], 0, -1, 0
    for s, e, k in sorted(spans):
        if s < end:
            end = max(end, e)
            continue
        if end >= 0:
            out.append(f"<{KINDS[kind]}>")
            at = end
        out.append(text[at:s])
        end, kind = e, k
    if end >= 0:
        out.append(f"<{KINDS[kind]}>")
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """docs with spans in text replaced by <kind>; n_chars, where docs has it, follows the new text.

    Null texts stay null, empty ones empty; repeated rows are each redacted; an empty table gives an empty one. Columns keep their names and order."""
    w = weights or train(docs)
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in chunks(batches, at):
            for k in range(0, cut.num_rows, 1_000):
                part = cut.slice(k, 1_000)
                texts = part.column(at).to_pylist()
                clean = [None if t is None else redact_text(t, b + more) for t, (b, more) in zip(texts, found_in([t or "" for t in texts], w), strict=True)]
                cols = list(part.columns)
                cols[at] = pa.array(clean, pa.string())
                if chars is not None:
                    old = cols[chars].to_pylist()
                    kind = cols[chars].type
                    cols[chars] = pa.array([o if t is None or t == b else len(t) for o, t, b in zip(old, clean, texts, strict=True)], kind)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)
