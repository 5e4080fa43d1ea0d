"""Whitening of embeddings by the leading eigenvectors of their covariance, found by spectrum slicing.

Entries become integers, floor(64 * entry), so sums and sums of centred products are exact whatever order tasks add them in:
one pass sums the components, a second multiplies entries less the whole number nearest their mean (what the mean
has beyond it is taken out exactly). Partial sums leave a task as one row for each pair of components.

The covariance, as large as the vectors' length squared and no larger for more rows, is then sliced: the number of positive pivots of LDLᵀ of
the covariance less a shift counts the eigenvalues above the shift, and halving brackets isolates each leading eigenvalue.
Inside its bracket Rayleigh quotient iteration converges cubically. Two more counts, just above and just below a
value, certify its number. Two last passes measure the covariance of the whitened rows and give them out.

Vectors of different lengths are fitted apart. A vector that is null, empty, or holds null or non-finite entries takes no part, nor does
one with an entry beyond 64 bits once scaled. Components without variance can't be scaled to 1 and are left out, so rows that are all alike give none."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are worked on at once.
ROWS = 4_096
#: Doubles add and multiply integers without rounding below this.
EXACT = 2.0**52
OUT = "n long, deviation long, whitened array<double>"


@dataclass
class Fit:
    """What whitens the vectors of one length: mean = near + rest / n, components as columns of axes."""

    n: int
    near: np.ndarray
    rest: np.ndarray
    trace: float
    values: np.ndarray
    axes: np.ndarray
    identity_error: float = math.nan

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (y - self.near).astype("f8") - self.rest.astype("f8") / self.n

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return self.centred(y) @ (self.axes / np.sqrt(self.values))

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Sum over components of (n * x - S)^2 for each row, exactly; null where it passes 64 bits."""
        z = y - self.near
        rough = ((z.astype("f8") * self.n - self.rest.astype("f8")) ** 2).sum(axis=1)
        most = self.n * float(np.abs(z).max(initial=0)) + float(np.abs(self.rest).max(initial=0))
        if y.shape[1] * most * most < 2.0**62:
            return ((z.astype("i8") * self.n - self.rest.astype("i8")) ** 2).sum(axis=1).tolist()
        out: list[int | None] = []
        for row, size in zip(z, rough.tolist(), strict=True):
            total = sum((int(v) * self.n - int(r)) ** 2 for v, r in zip(row, self.rest, strict=True)) if size < 2.0**64 else 1 << 64
            out.append(total if total < 1 << 63 else None)
        return out


def entries(lists: pa.Array, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(factor * entry)) of fit vectors, ROWS at most at once and of one length; every value is whole."""
    if not len(lists):
        return
    at = lists.offsets.to_numpy().astype("i8")
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(factor * lists.values.to_numpy(zero_copy_only=False).astype("f8"))  # nulls turn into NaN
        bad = np.r_[0, np.cumsum(~(np.abs(y) < 2.0**62))]
    size = np.diff(at)
    fit = (bad[at[1:]] == bad[at[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) & (size > 0)
    for dim in np.unique(size[fit]).tolist():
        rows = np.flatnonzero(fit & (size == dim))
        for k in range(0, len(rows), ROWS):
            part = rows[k : k + ROWS]
            yield part, y[at[part][:, None] + np.arange(dim)]


def whole(x: np.ndarray) -> np.ndarray:
    """x as Python's integers, which never round."""
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def added(y: np.ndarray) -> np.ndarray:
    """Sums of the columns of whole numbers, as Python's integers."""
    if float(np.abs(y).max()) * len(y) >= EXACT:
        return whole(y).sum(axis=0)
    return np.array([int(v) for v in y.sum(axis=0)], object)


def products(z: np.ndarray) -> np.ndarray:
    """Sums of the products of any two columns of whole numbers, as Python's integers."""
    most = float(np.abs(z).max()) ** 2
    if most * len(z) < EXACT:
        return whole(z.T @ z)
    if most >= EXACT or z.dtype == object:
        z = whole(z)
        return z.T @ z
    step = max(1, int(EXACT / most))
    return sum(whole(z[k : k + step].T @ z[k : k + step]) for k in range(0, len(z), step))


def summed(df: DataFrame, column: str, factor: float, work: Callable[[np.ndarray], np.ndarray]) -> dict[int, tuple[int, np.ndarray]]:
    """{vector length: (rows, sums over all rows of work's square or single array)}; each task sends its sums once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for rows, y in entries(batch.column(0), factor):
                held = total.setdefault(y.shape[1], [0, 0])
                held[0] += len(rows)
                held[1] = held[1] + work(y)
        for dim, (n, sums) in total.items():
            # of a square, one half tells all
            i = np.arange(dim) if sums.ndim == 1 else np.triu_indices(dim)
            flat = sums[i]
            place = i if sums.ndim == 1 else i[0] * dim + i[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), dim)), pa.array(place.astype("i8")), pa.array(np.full(len(flat), n)), pa.array([Decimal(v) for v in flat], pa.decimal128(38, 0))],
                names=["dim", "place", "n", "total"],
            )

    parts = df.select(column).mapInArrow(run, "dim long, place long, n long, total decimal(38,0)")
    told = parts.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
    out: dict[int, tuple[int, np.ndarray]] = {}
    dims = told["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        here = told.filter(pa.array(dims == dim))
        values = np.array([int(v) for v in here["total"].to_pylist()], object)
        place = here["place"].to_numpy()
        single = len(values) == dim and int(place.max()) == dim - 1
        sums = np.zeros(dim if single else (dim, dim), object)
        if single:
            sums[place] = values
        else:
            sums[place // dim, place % dim] = sums[place % dim, place // dim] = values
        out[dim] = int(here["n"][0].as_py()), sums
    return out


# ---- the spectrum ----


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed shift: the positive pivots of LDLᵀ of the shifted matrix.

    Pivots are of one row or of two (Bunch and Kaufman), so that small ones don't blow up what is left; a pair has one of each sign."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, positive = len(a), 0, 0
    least = (1 + math.sqrt(17)) / 8
    while k < n:
        below = np.abs(a[k + 1 :, k])
        largest = float(below.max(initial=0.0))
        if largest == 0:
            positive += a[k, k] > 0
            k += 1
            continue
        pair, r = False, k + 1 + int(below.argmax())
        if abs(a[k, k]) < least * largest:
            across = np.abs(a[k:, r])
            across[r - k] = 0
            other = float(across.max())
            if abs(a[k, k]) * other < least * largest * largest:
                pair = abs(a[r, r]) < least * other
                to = k + 1 if pair else k
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        if pair:
            side = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= side @ np.linalg.inv(a[k : k + 2, k : k + 2]) @ side.T
            positive += 1
            k += 2
        else:
            side = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(side / a[k, k], side)
            positive += a[k, k] > 0
            k += 1
    return int(positive)


def isolated(matrix: np.ndarray, k: int, tiny: float) -> list[tuple[float, float, int, int]]:
    """(low, high, before, count) in descending order: brackets of the k largest eigenvalues, `before` above each and `count` within.

    A bracket holds one eigenvalue, or several that lie closer than `tiny`."""
    bound = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-12) + tiny
    todo, out = [(-bound, bound, 0, len(matrix))], []
    while todo:
        low, high, before, upto = todo.pop()
        if before == upto or before >= k:
            continue
        if upto - before == 1 or high - low <= tiny:
            out.append((low, high, before, upto - before))
            continue
        middle = (low + high) / 2
        cut = min(max(above(matrix, middle), before), upto)
        todo += [(low, middle, cut, upto), (middle, high, before, cut)]
    return out


def iterated(matrix: np.ndarray, low: float, high: float, before: int, count: int, found: list[np.ndarray], tiny: float, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """An eigenvalue within (low, high) and its unit vector, orthogonal to those found, by Rayleigh quotient iteration.

    Where the quotient leaves the bracket, a count halves the bracket and the iteration starts again."""
    n = len(matrix)
    basis = np.array(found).reshape(-1, n)

    def unit(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - basis.T @ (basis @ v)
        return v / np.linalg.norm(v)

    def solved(shift: float, v: np.ndarray) -> np.ndarray:
        try:
            w = np.linalg.solve(matrix - shift * np.eye(n), v)
        except np.linalg.LinAlgError:
            w = np.linalg.solve(matrix - (shift + tiny) * np.eye(n), v)
        return unit(w / np.abs(w).max())

    while True:
        middle = (low + high) / 2
        v = unit(rng.standard_normal(n))
        for _ in range(3):
            v = solved(middle, v)
        best = (math.inf, 0.0, v)
        for _ in range(12):
            value = float(v @ (matrix @ v))
            left = float(np.linalg.norm(matrix @ v - value * v))
            if low - tiny <= value <= high + tiny and left < best[0]:
                best = (left, value, v)
            elif best[0] <= tiny or not low - tiny <= value <= high + tiny:
                break
            v = solved(value, v)
        if best[0] <= tiny:
            return best[1], best[2]
        if high - low <= tiny:
            raise RuntimeError("an eigenvector did not settle within its bracket")
        low, high = (middle, high) if above(matrix, middle) >= before + count else (low, middle)


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the k largest eigenvalues above rounding, descending, each certified by two counts.

    A vector's largest entry is positive."""
    n = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max())
    tiny = 16 * n * np.finfo("f8").eps * norm
    rng = np.random.default_rng(7)
    found: list[np.ndarray] = []
    values: list[float] = []
    if norm > 0:
        for low, high, before, count in isolated(matrix, k, tiny):
            for _ in range(min(count, k - before)):
                value, v = iterated(matrix, low, high, before, count, found, tiny, rng)
                values.append(value)
                found.append(v)
    order = [i for i in np.argsort(-np.array(values), kind="stable").tolist() if values[i] > tiny]
    for number, i in enumerate(order):
        if not above(matrix, values[i] + 2 * tiny) <= number < above(matrix, values[i] - 2 * tiny):
            raise RuntimeError(f"eigenvalue {number + 1} is not certified by its counts")
    axes = np.array([found[i] * np.sign(found[i][np.abs(found[i]).argmax()]) for i in order]).reshape(-1, n).T
    return np.array([values[i] for i in order]), axes


# ---- the fit and its use ----


def fit(df: DataFrame, k: int = 32, column: str = "embedding", factor: float = 64.0) -> dict[int, Fit]:
    """{vector length: Fit} with up to k components each, over all fit vectors of df. Reads df three times. An error if sums pass 38 digits.

    Half the square of the vectors' length comes to the driver, in numbers; an empty table has no fits."""
    out: dict[int, Fit] = {}
    means = {}
    for dim, (n, sums) in summed(df, column, factor, added).items():
        near = np.array([(2 * int(s) + n) // (2 * n) for s in sums], object)
        means[dim] = near.astype("f8") if all(abs(v) < EXACT for v in near) else near, sums - n * near, n
    centred = summed(df, column, factor, lambda y: products(y - means[y.shape[1]][0] if means[y.shape[1]][0].dtype != object else whole(y) - means[y.shape[1]][0]))
    for dim, (n, squares) in centred.items():
        near, rest, _ = means[dim]
        exact = n * squares - np.outer(rest, rest)  # n^2 times the covariance
        covariance = np.array([[int(v) / (n * n) for v in row] for row in exact]).reshape(dim, dim)
        trace = sum(int(exact[i, i]) for i in range(dim)) / (n * n)
        out[dim] = Fit(n, near, rest, trace, *leading(covariance, k))
    for dim, error in identity_errors(df, out, column, factor).items():
        out[dim].identity_error = error
    return out


def identity_errors(df: DataFrame, fits: dict[int, Fit], column: str, factor: float) -> dict[int, float]:
    """{vector length: largest absolute entry of the covariance of the whitened rows less the identity}, over all rows.

    A task centres its rows by their own mean before it multiplies; tasks' means and products then merge as sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, y in entries(batch.column(0), factor):
                w = fits[y.shape[1]].whitened(y)
                mean = w.mean(axis=0)
                i, j = np.triu_indices(w.shape[1])
                z = w - mean
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), x)) for x in (y.shape[1], len(rows))] + [pa.array(x) for x in (i, j, (z.T @ z)[i, j], mean[i], mean[j])],
                    names=["dim", "n", "i", "j", "c", "a", "b"],
                )

    if not fits:
        return {}
    parts = df.select(column).mapInArrow(run, "dim long, n long, i long, j long, c double, a double, b double")
    n = F.sum("n")
    entry = (F.sum("c") + F.sum(F.expr("n * a * b"))) / n - F.sum(F.expr("n * a")) * F.sum(F.expr("n * b")) / (n * n)
    told = parts.groupBy("dim", "i", "j").agg(entry.alias("v"))
    return {r.dim: r.e for r in told.groupBy("dim").agg(F.max(F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("e")).collect()}


def whiten(df: DataFrame, fits: dict[int, Fit], column: str = "embedding", id_column: str = "vec_id", factor: float = 64.0) -> DataFrame:
    """(id, dim, n, deviation, whitened): one row for each fit vector of df whose length has a fit, `whitened` being its components in order.

    A null id stays; repeated rows stay each; a deviation beyond 64 bits is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, y in entries(batch.column(1), factor):
                if y.shape[1] not in fits:
                    continue
                own = fits[y.shape[1]]
                w = own.whitened(y)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="i4") * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), y.shape[1])), pa.array(np.full(len(rows), own.n)), pa.array(own.deviation(y), pa.int64()), lists],
                    names=[id_column, "dim", "n", "deviation", "whitened"],
                )

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, column).mapInArrow(run, f"`{id_column}` {kind}, dim long, {OUT}")


def components(whitened: DataFrame, fits: dict[int, Fit], id_column: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component, numbered from 1."""
    spark = whitened.sparkSession
    told = [(dim, c + 1, float(v / f.trace), f.identity_error) for dim, f in fits.items() for c, v in enumerate(f.values)]
    shares = spark.createDataFrame(told, "dim long, component int, explained double, identity_error double")
    long = whitened.select(id_column, "dim", "n", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    long = long.withColumn("component", F.col("place") + 1)
    # at most k rows for each vector length
    return long.join(F.broadcast(shares), ["dim", "component"]).select(id_column, "component", "n", "deviation", "whitened", "explained", "identity_error")
