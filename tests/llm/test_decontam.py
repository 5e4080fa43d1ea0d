"""Decontamination against brute force, with small blocks, planted passages, chance hashes and odd rows. The query itself is compared with its SQL."""

import random
import re

import numpy as np
import pytest

from dewfall.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, width=10):
    windows = [(i, (w := words(t))[k : k + width]) for i, t in items if words(t) for k in range(max(1, len(words(t)) - width + 1))]
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for i, win in windows:
            for k in range(len(own) - len(win) + 1):
                if own[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(i)
        spans = [(k, next(e for e in range(k, len(own) + 1) if e not in hit)) for k in sorted(hit) if k - 1 not in hit]
        out.append((doc_id, len(own), len(hit), sorted(i for i in found if i is not None), spans))
    return sorted(out, key=str)


def cases():
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(30)] + ["Ünï", "日本", "x1", "ǅ"]
    item = lambda n: ", ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, item(rng.choice((1, 3, 9, 10, 11, 25)))) for k in range(7, 22)]
    items = [(i, t if len(words(t)) > 1 else "rareword") for i, t in items]
    items += [(items[9][0], item(14)), (500, items[0][1]), (None, item(12)), (501, None), (502, "--- !"), (503, "")]
    docs = [(1, None), (2, ""), (3, "..."), (3, "..."), (None, items[1][1])]
    for k in range(60):
        parts = [item(rng.randrange(0, 30)) for _ in range(3)]
        for _ in range(rng.randrange(4)):
            w = words(rng.choice(items)[1] or "")
            a = rng.randrange(0, max(1, len(w) - 9))
            parts.insert(rng.randrange(len(parts) + 1), rng.choice((" ", "\n-", "…  ")).join(x.upper() if rng.random() < 0.3 else x for x in w[a : a + rng.choice((9, 10, 14))]))
        docs.append((10 + k, "; ".join(parts)))
    docs.append((99, "; ".join(t or "" for _, t in items) * 50))
    return docs, items


@pytest.mark.parametrize("block", [decontam.BLOCK, 150])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontam, "AT_ONCE", 7)
    docs, items = cases()
    df = spark.createDataFrame([(*d, "a", None) for d in docs], "doc_id long, text string, hit string, n_words int").repartition(3)
    got = decontam.scan(df, spark.createDataFrame(items, "item_id long, text string"), block=block).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), [tuple(s) for s in r.spans]) for r in got), key=str) == brute(docs, items)


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """Every hash alike: only the comparison of bytes decides."""
    monkeypatch.setattr(decontam, "span_hashes", lambda values, a, b: np.full(len(a), 77, np.uint64))
    docs, items = cases()
    column = decontam.pa.array([t for _, t in docs[:25]])
    table = decontam.pa.table({"item_id": decontam.pa.array([i for i, _ in items], decontam.pa.int64()), "text": decontam.pa.array([t for _, t in items])})
    own = decontam.Words(column)
    edges, texts, found = decontam.marked(own, *decontam.window_sets(table))
    hit = np.cumsum(edges[:-1]) > 0
    want = {k: brute([(k, t)], items)[0] for k, (_, t) in enumerate(docs[:25])}
    for k in want:
        assert hit[own.bounds[k] : own.bounds[k + 1]].sum() == want[k][2]
        assert sorted(found[texts == k].tolist()) == want[k][3]


def test_removal(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "odd")], "item_id long, text string")
    docs = [
        (1, "Start: ONE two, three four five six seven eight nine ten! end", "k"),
        (2, "one two three four five six seven eight nine", "k"),
        (3, None, None),
        (4, "how odd.", "k"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, items string")
    cut = decontam.remove_spans(df, items)
    assert cut.columns == df.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "Start: ! end", 2: docs[1][1], 3: None, 4: "how ."}
    kept = decontam.remove_documents(df, items)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {2, 3}
    assert {r.doc_id for r in decontam.remove_documents(df, items, most=0.5).collect()} == {2, 3, 4}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontam.scan(docs.limit(0), items).collect() == []
    r = decontam.scan(docs, items.limit(0)).first()
    assert (r.n_words, r.n_hit, list(r["items"]), list(r.spans)) == (2, 0, [], [])
