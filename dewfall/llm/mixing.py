"""Mixing sources to target weights by entropy balancing.

Every document i of source s gets a rate w_i = min(cap, exp(lambda_s * size_i / mean size of s)), the
least relative-entropy change from 1 under which the source's words sum to its target. The dual is
convex and separates by source; Newton steps solve all sources at once, each step one distributed
sum over a table of (source, size, documents). Rates then become whole copies by systematic
rounding along ascending size, so a source's words stay within about one document of its target.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dewfall.llm.common import drop_written, running_total, word_count, written

#: The driver holds one number for each source; more sources than this raise an error.
MAX_SOURCES = 100_000
#: Documents that a task adds up at once.
RANGE_ROWS = 20_000
#: Starting points of the rounding that are tried.
STARTS = 64


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Words that each source is to give: `share` of all words by weight, none above cap times its size.

    Sources take the weights in turn in code-point order, null last. What a source at its cap leaves
    is shared again by weight among the rest, until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def _rate(lam: Column, x: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(lam * x, F.lit(700.0))))


def _per_source(df: DataFrame, values: dict[str | None, float], name: str) -> DataFrame:
    """df with a column from a small driver-held table (at most MAX_SOURCES rows), joined null-safely.

    The table goes over as an Arrow table: from Python rows Spark would make an RDD, for which each executor starts Python processes of its own."""
    small = df.sparkSession.createDataFrame(pa.table({"_s": pa.array(values.keys(), pa.string()), name: pa.array(map(float, values.values()), pa.float64())}))
    return df.join(F.broadcast(small), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def solve(cells: DataFrame, goal: dict[str | None, float], means: dict[str | None, float], cap: float, tol: float = 1e-7, max_steps: int = 200) -> dict[str | None, float]:
    """lambda by source, rounded to twelve digits. cells(source, size, n). Newton steps, kept inside a bracket by bisection.

    The bracket grows until it holds the solution; a source that does not settle within max_steps raises an error."""
    low, high = dict.fromkeys(goal, -math.inf), dict.fromkeys(goal, math.inf)
    lam = dict.fromkeys(goal, 0.0)
    open_ = {s for s in goal if means[s] > 0}
    for _ in range(max_steps):
        if not open_:
            break
        at = _per_source(_per_source(cells, {s: lam[s] for s in open_}, "lam"), {s: means[s] for s in open_}, "mean").where("lam is not null")
        x = F.col("size") / F.col("mean")
        w = _rate(F.col("lam"), x, cap)
        sums = at.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * w).alias("f"),
            F.sum(F.when(w < cap, F.col("n") * F.col("size") * x * w).otherwise(0.0)).alias("d"),
        )
        for r in sums.collect():  # a row for each open source, at most MAX_SOURCES
            s, gap = r.source, r.f - goal[r.source]
            if abs(gap) <= tol * max(goal[s], 1.0):
                open_.discard(s)
                continue
            low[s], high[s] = (lam[s], high[s]) if gap < 0 else (low[s], lam[s])
            step = lam[s] - gap / r.d if r.d > 0 else math.inf
            if low[s] < step < high[s] and abs(step - lam[s]) <= 8 + 2 * abs(lam[s]):
                lam[s] = step
            elif math.isinf(low[s]) or math.isinf(high[s]):
                lam[s] += (8 + abs(lam[s])) * (1 if gap < 0 else -1)
            else:
                lam[s] = (low[s] + high[s]) / 2
            if high[s] - low[s] < 1e-13 * (1 + abs(lam[s])):  # neighbouring numbers: as close as doubles come
                open_.discard(s)
    if open_:
        raise RuntimeError(f"no rates reach the targets of {sorted(map(str, open_))[:5]}")
    return {s: float(f"{v:.12g}") for s, v in lam.items()}


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), then `carry`, for every row of docs.

    Needs doc_id, text, source. A null or empty text has size 0: rate 1 at lambda 0, one copy, taken 0. A null
    source is a source of its own, last in order. Rows that repeat a doc_id are rounded each on
    their own. An empty table gives an empty result. Ties in size are ordered by doc_id, so reruns
    agree. No document is copied more than ceil(cap) times."""
    narrow = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry), "sizes")
    cells = written(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    rows = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r.source: int(r.words) for r in rows}
    means = {r.source: r.words / r.docs for r in rows}
    goal = targets(sizes, weights, share, cap)
    full = {s for s in goal if goal[s] >= cap * sizes[s] * (1 - 1e-12) and sizes[s]}
    lam = solve(cells, {s: goal[s] for s in goal if s not in full}, means, cap) | dict.fromkeys(full, math.inf)

    rated = narrow
    for name, values in (("source_size", sizes), ("target", goal), ("lam", lam), ("mean", means)):
        rated = _per_source(rated, values, name)
    x = F.when(F.col("mean") > 0, F.col("size") / F.col("mean")).otherwise(0.0)
    rate = F.when(F.col("lam") == math.inf, F.lit(float(cap))).otherwise(_rate(F.col("lam"), x, cap))
    rated = rated.withColumn("rate", rate).drop("lam", "mean").withColumn("source_size", F.col("source_size").cast("long"))
    exact = "decimal(38,12)"
    order = ["size", "doc_id", *carry]
    parts = max(8, -(-sum(r.docs for r in rows) // RANGE_ROWS))
    summed = running_total(rated, "source", order, F.col("rate").cast(exact), parts)
    # whole numbers before the document don't matter to its copies, so small doubles do from here on
    low = (F.col("before") - F.floor("before")).cast("double")
    placed = written(summed.withColumn("low", low).drop("before"), "placed")

    def copies(start: Column) -> Column:
        more = F.floor(F.col("low") + F.col("rate") + start) - F.floor(F.col("low") + start)
        return F.least(F.greatest(more, F.lit(0)), F.lit(math.ceil(cap))).cast("long")

    # Each source takes the starting point of the rounding that brings it closest to its target.
    starts = [(k + 0.5) / STARTS for k in range(STARTS)]
    tried = placed.groupBy("source").agg(*(F.sum(copies(F.lit(u)) * F.col("size")).alias(f"s{k}") for k, u in enumerate(starts))).collect()
    drop_written(narrow, cells)
    best = {r.source: min(starts, key=lambda u: (abs(r[f"s{starts.index(u)}"] - goal[r.source]), u)) for r in tried}
    return _per_source(placed, best, "start").withColumn("copies", copies(F.col("start"))).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as mix() takes it; rows with no copies go. A null or empty text is taken once, an empty table gives none.

    Rows that repeat a doc_id, or have none, are told apart by a number that is written down before it is used."""
    numbered = written(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered, carry=["_mix_row"]).select("_mix_row", F.col("copies").alias("_mix_copies")).where("_mix_copies > 0")
    rows = numbered.join(taken, "_mix_row").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))))
    return rows.select(docs.columns)
