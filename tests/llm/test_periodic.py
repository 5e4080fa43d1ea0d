"""Periodic runs against brute force over all lags, planted texts, odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from dewfall.llm import periodic, queries
from tests.llm.test_queries import SF, WORD, rows


def brute(words):
    """All (start, length, period): every lag's maximal stretches, kept if no smaller lag has the same stretch."""
    n, best = len(words), {}
    for p in range(1, n // 3 + 1):
        k = p
        while k < n:
            if words[k] != words[k - p]:
                k += 1
                continue
            end = k
            while end < n and words[end] == words[end - p]:
                end += 1
            if end - k + p >= max(24, 3 * p):
                best.setdefault((k - p, end - k + p), p)
            k = end
    return sorted((s, l, p) for (s, l), p in best.items())


def kept(words, found):
    dropped = {i for s, l, p in found for i in range(s + p, s + l)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def texts():
    rng = random.Random(12)
    out = ["", " \t\n", "one", "a " * 23, "a " * 24, "a " * 500, "ab  cd\n" * 200, " ".join("ab"[i % 7 == 0] for i in range(100))]
    for _ in range(150):
        words = []
        while len(words) < rng.choice((30, 150, 400)):
            block = [rng.choice("abc") for _ in range(rng.choice((1, 2, 3, 5, 8, 15, 16, 17, 31, 32, 33, 40)))]
            words += block * rng.choice((1, 1, 2, 3, 4, 9))
            if rng.random() < 0.3:
                words = words[: -rng.randrange(1, 5)]
        out.append(rng.choice((" ", "  ", "\n")).join(words))
    for k in (3, 5, 9):  # runs of runs, where the inner ones hold the block that ends the outer period
        out.append(" ".join((["x"] * 40 + ["y"]) * k))
        out.append(" ".join((["x"] * 24 + ["y"] * 30 + ["z", "x"]) * k))
        out.append(" ".join(str(i % 77) for i in range(77 * k + 5)))
    fib = ["a", "b"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    return [*out, " ".join(fib[-1]), " ".join(format(i, "b") for i in range(300))]


def test_runs_equal_brute_force(spark):
    own = texts()
    got = {r.doc_id: r for r in periodic.find_runs(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")).collect()}
    total = 0
    for k, text in enumerate(own):
        words = WORD.findall(text)
        want = brute(words)
        total += len(want)
        assert [(r.start, r.length, r.period) for r in got[k].runs] == want, text
        assert got[k].n_words == len(words) and got[k].collapsed == kept(words, want)
    assert total > 200


def test_query_over_the_table(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    made = 0
    for d in rows("documents"):
        words = WORD.findall(d["text"] or "")
        n, h = len(words), zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        want = brute(words) if n < 3_000 or h % 10 == 0 else [(r.start, r.length, r.period) for r in []]
        r = got[d["doc_id"]]
        made += len(want)
        if n >= 3_000 and h % 10:
            continue
        assert r.n_runs == len(want)
        top = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == top
        assert r.exponent_milli == (1000 * top[1] // top[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{l},{p}\n" for s, l, p in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(words, want).encode()).hexdigest()
    assert made > 10


def test_odd_rows(spark):
    long = "spam eggs " * 400_000  # linear in the text, whatever it repeats
    own = [(1, None, 1), (1, None, 1), (None, "a " * 30, 2), (2, "x y　z " * 30, 3), (3, long, 4), (4, "\x1c \x85 " * 12, 5)]
    df = spark.createDataFrame(own, "doc_id long, text string, runs int")
    got = periodic.find_runs(df).collect()
    assert len(got) == 6
    assert sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs]) for r in got) == [
        (0, 30, [(0, 30, 1)]), (1, 0, []), (1, 0, []), (2, 30, [(0, 30, 1)]), (3, 800_000, [(0, 800_000, 2)]), (4, 24, [(0, 24, 2)]),
    ]
    assert all(r.collapsed is not None for r in got)
    assert periodic.find_runs(df.limit(0)).collect() == []


def test_collapse_keeps_columns_and_other_texts(spark):
    df = spark.createDataFrame([("z", 1, "a  b c"), ("y", 2, "go on " * 20 + "then stop"), (None, 3, None)], "runs string, doc_id long, text string")
    got = {r.doc_id: r for r in periodic.collapse(df).collect()}
    assert periodic.collapse(df).columns == df.columns
    assert got[1].text == "a  b c" and got[2].text == "go on then stop" and got[3].text is None and got[1].runs == "z"


def test_blocks_are_told_apart_across_texts():
    assert not re.search("x", "") and periodic.found(*map(__import__("numpy").array, ([0] * 48, [0, 12, 24, 36, 48])))[0].size == 0


@pytest.mark.parametrize("n,want", [(23, 0), (24, 1)])
def test_least_length(spark, n, want):
    df = spark.createDataFrame([(1, "w " * n)], "doc_id long, text string")
    assert len(periodic.find_runs(df).first().runs) == want
