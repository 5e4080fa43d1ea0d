"""Samples of the five days around a calendar slot, pooled over years, and what is fitted to each; results by tile, and their merge.

A day of a cell is gathered once into a block of its hours. Blocks go to the runs of CHUNK slots whose windows need them: most to one, those near
an edge to two, so an hour is shuffled about 1.1 times, where a join of observations with their windows would copy it five times. A task
holds one cell and run: CHUNK + 4 days of each year. The sample of a slot is the blocks within two days of each date that the
slot stands for, in every year; slot 60 stands for two dates in a leap year, and counts what is near both twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dewfall.functions import calendar
from dewfall.operators import fits

#: Slots of a run; days on each side of a date.
CHUNK, REACH = 30, 2
#: Values without which nothing is fitted; places of a row's parameters.
LEAST, PARAMS = 30, 5
FITTED = "cy int, cx int, slot int, n long, rh_name string, rh_params array<double>, q_name string, q_params array<double>, rho double, status string"


def compact_slot(slot: Column) -> Column:
    """The place of a slot among the 365 that can hold days, from 0: the reserved one is left out."""
    return F.when(slot < calendar.RESERVED, slot - 1).otherwise(slot - 2)


def day_blocks(hours: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(cy, cx, d, block): the hours of each cell and day that have all of columns, as an array of structs."""
    whole = [F.col(c).isNotNull() for c in columns]
    keep = whole[0]
    for c in whole[1:]:
        keep = keep & c
    return hours.where(keep).groupBy("cy", "cx", "d").agg(F.collect_list(F.struct(*columns)).alias("block"))  # hours of one day


def dealt(blocks: DataFrame, first_year: int, last_year: int, slots: Sequence[int] | None = None) -> DataFrame:
    """blocks with chunk, and slots: the slots of this run of which a date lies within REACH days, once for each date. Dates are those of the years given; slots, if given, are the only ones kept."""
    date = F.explode(F.sequence(F.date_sub("d", REACH), F.date_add("d", REACH))).alias("date")
    near = blocks.select("d").distinct().select("d", date).where(F.year("date").between(first_year, last_year))
    near = near.withColumn("slot", calendar.slot(F.col("date")).cast("int"))
    if slots is not None:
        near = near.where(F.col("slot").isin([int(s) for s in slots]))
    runs = near.groupBy("d", F.floor(compact_slot(F.col("slot")) / CHUNK).cast("int").alias("chunk")).agg(F.collect_list("slot").alias("slots"))  # five dates at most
    return blocks.join(F.broadcast(runs), "d")  # two rows at most for each day of the calendar years


def samples(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, rows of values) from the dealt blocks of one cell and run, slots ascending."""
    near: dict[int, list[int]] = {}
    for k, slots in enumerate(pdf["slots"]):
        for s in slots:
            near.setdefault(int(s), []).append(k)
    blocks = [np.array([tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in b], "f8") for b in pdf["block"]]
    for s in sorted(near):
        yield s, np.concatenate([blocks[k] for k in near[s]])


def padded(params: Sequence[float] | None) -> list[float | None]:
    """PARAMS places; those that a family does not use are null."""
    own = [float(p) for p in params or ()]
    return own + [None] * (PARAMS - len(own))


def best_marginal(x: np.ndarray, families: Sequence[str]) -> tuple[str, list[float]] | None:
    """(family, params) with the least aicc, then bic, then name; families that don't apply or fail are passed over."""
    best = None
    for name in families:
        run, k = fits.MARGINALS[name]
        if name == "Beta" and not (x.min() >= 0 and x.max() <= 1):
            continue
        try:
            params, ll = run(x)
        except (ValueError, ArithmeticError, np.linalg.LinAlgError):
            continue
        n = len(x)
        aic = 2 * k - 2 * ll
        score = (aic + 2 * k * (k + 1) / (n - k - 1) if n > k + 1 else float("inf"), k * np.log(n) - 2 * ll, name)
        if np.isfinite(ll) and (best is None or score < best[0]):
            best = (score, name, params)
    return best and (best[1], best[2])


def fit_sample(rh: np.ndarray, q: np.ndarray, families: Sequence[str]) -> tuple:
    """(n, rh family and params, q family and params, rho of normal scores, status) of a joint sample without missing values."""
    n = len(rh)
    none = (n, None, padded(None), None, padded(None), None)
    if n < LEAST:
        return (*none, "insufficient_data")
    try:
        rh_best, q_best = (best_marginal(x, families) if x.std() > 0 else None for x in (rh, q))
        rho = None
        if rh.std() > 0 and q.std() > 0:
            u, v = (np.clip((pd.Series(x).rank().to_numpy() - 0.5) / n, 1e-10, 1 - 1e-10) for x in (rh, q))
            rho = float(np.clip(np.corrcoef(fits.quantile(u), fits.quantile(v))[0, 1], -0.9999, 0.9999))
    except Exception as error:  # noqa: BLE001  one sample's failure is its status, not the job's
        return (*none, f"exception:{type(error).__name__}:{error}")
    status = "ok" if rh_best and q_best else "fit_failed"
    name = lambda b: (b[0], padded(b[1])) if b else (None, padded(None))
    return (n, *name(rh_best), *name(q_best), rho, status)


def fitted(dealt_blocks: DataFrame, families: Sequence[str]) -> DataFrame:
    """FITTED: a row for each cell and slot with a day in its windows, from dealt blocks of (rh, q), rh as a share of 1."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(key[0], key[1], slot, *fit_sample(x[:, 0], x[:, 1], families)) for slot, x in samples(pdf)]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FITTED.split(", ")])

    return dealt_blocks.groupBy("cy", "cx", "chunk").applyInPandas(run, FITTED)


def grouped_samples(dealt_blocks: DataFrame, work: Callable[[tuple[int, int, int], np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """The rows that work((cy, cx, slot), values) gives for every sample."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [r for slot, x in samples(pdf) for r in work((int(key[0]), int(key[1]), slot), x)]
        return pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in schema.split(",")])

    return dealt_blocks.groupBy("cy", "cx", "chunk").applyInPandas(run, schema)


# ---- results by tile ----


def write_tiles(results: DataFrame, folder: str, tile: int) -> None:
    """Results by (cy, cx, slot) into folder, partitioned by tile of `tile` by `tile` cells and run of slots. A tile and run that results hold is replaced, all others stay."""
    placed = results.withColumns(
        {
            "tile": F.concat_ws("-", F.floor(F.col("cy") / tile).cast("string"), F.floor(F.col("cx") / tile).cast("string")),
            "chunk": F.floor(compact_slot(F.col("slot")) / CHUNK).cast("int"),
        }
    )
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile", "chunk").parquet(folder)


def merge_tiles(spark: SparkSession, folder: str, tile: int) -> DataFrame:
    """All tiles as one table by cell and compact slot, parameters in arrays of PARAMS; a cell or slot in the wrong tile or twice, and arrays of another length, are errors."""
    rows = spark.read.option("basePath", folder).parquet(folder).withColumn("compact", compact_slot(F.col("slot")))
    due = F.concat_ws("-", F.floor(F.col("cy") / tile).cast("string"), F.floor(F.col("cx") / tile).cast("string"))
    bad = (F.col("tile") != due) | (F.col("chunk") != F.floor(F.col("compact") / CHUNK)) | (F.size("rh_params") != PARAMS) | (F.size("q_params") != PARAMS)
    once = rows.groupBy("cy", "cx", "compact").agg(F.count("*").alias("times"), F.bool_or(bad).alias("bad"), F.first(F.struct(*(c for c in rows.columns if c not in ("cy", "cx", "compact", "tile", "chunk")))).alias("row"))
    note = F.concat(F.lit("not one sound row at cell "), F.col("cy").cast("string"), F.lit(","), F.col("cx").cast("string"), F.lit(" slot "), F.col("row.slot").cast("string"))
    held = F.when((F.col("times") > 1) | F.col("bad"), F.raise_error(note).cast("int")).otherwise(F.col("compact")).alias("compact")
    return once.select("cy", "cx", held, "row.*")
