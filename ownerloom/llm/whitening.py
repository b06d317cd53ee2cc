"""Whitening of embeddings by the leading components of their covariance, found by contour integration (FEAST).

Entries become whole numbers, x = floor(64*c) + 1000000, so that all sums over rows are exact. Spark makes the sums of
each dimension and then, centred on the nearest whole number to each mean, the sums of products; the rest of the
centring is exact too, in whole numbers of any size. What reaches the driver is one row for each pair of dimensions.

Spectrum: the covariance is brought to tridiagonal form once; the inertia of that form shifted by s counts the
eigenvalues below s. Bisecting by such counts gives intervals with few eigenvalues each, from the top until they hold
as many as are asked for, with bounds away from any eigenvalue. Each interval is a row that Spark gives to a task: a
random block is multiplied with the spectral projector, a Gauss-Legendre quadrature over a circle through the bounds
whose every node is one solve with the complex shifted covariance; Rayleigh-Ritz in what is left gives the
pairs; this is repeated until the residuals are at rounding. Fewer pairs than the inertia counts in the interval are an
error, so that none is missed.

Cases: rows whose vector is null, empty, or holds nulls or non-finite entries (or ones beyond LARGEST, where x loses
digits) are left out, and so are vectors that have not the most frequent length (of equally frequent ones the
larger). Components with an eigenvalue below RANK_FLOOR times the largest do not exist: there may be fewer than
asked for, none for a single row or equal rows, and then there are no rows. deviation is null beyond 63 bits. Null and
repeated ids keep their rows; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Largest absolute entry of a vector.
LARGEST = float(1 << 40)
RANK_FLOOR = 1e-12
#: Eigenvalues in an interval, where bounds between them can be found; nodes of the quadrature; rounds before giving up.
INTERVAL, NODES, ROUNDS = 8, 16, 40
#: Dimensions up to which the covariance is given to every worker whole.
MOST_DIMENSIONS = 4096


# -- sums over rows ----------------------------------------------------------------------------


def whole_vectors(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, x (array of longs) of the rows that take part."""
    vector = F.transform(F.col(vector_column), lambda c: c.cast("double"))
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("v")).where(F.coalesce(usable, F.lit(False)) & (F.size("v") > 0))
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc()).first()
    rows = rows.where(F.size("v") == (common["size"] if common else 0))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _products(y: np.ndarray) -> np.ndarray:
    """y'y exactly, as Python numbers: by floating point where all sums stay below 2**53."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        return (y.T.astype(float) @ y.astype(float)).astype(np.int64).astype(object)
    return y.T.astype(object) @ y.astype(object)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray | None:
    """The sum of part(x) over batches of rows of x: one array in each task, added up by Spark entry by entry."""
    schema = pa.schema([("at", pa.int32()), ("entry", pa.string())])

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = part(_matrix(batch.column(0).slice(at, 4096)))
                total = piece if total is None else total + piece
        if total is not None:
            flat = total.ravel().tolist()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array([repr(v) for v in flat])], schema=schema)

    parts = rows.select("x").mapInArrow(tell, "at int, entry string")
    sums = {r["at"]: r["total"] for r in parts.groupBy("at").agg(F.sum(F.col("entry").cast(kind)).alias("total")).collect()}
    return np.array([sums[k] if kind == "double" else int(sums[k]) for k in range(len(sums))], dtype=float if kind == "double" else object) if sums else None


# -- the spectrum ------------------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, the one beside it) of an orthogonally similar tridiagonal matrix, by Householder reflections."""
    a = v.copy()
    for k in range(len(a) - 2):
        u = a[k + 1 :, k].copy()
        length = np.linalg.norm(u)
        if length == 0:
            continue
        u[0] += np.copysign(length, u[0])
        u /= np.linalg.norm(u)
        a[k + 1 :, :] -= 2 * np.outer(u, u @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_below(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues below the shift: negative pivots of the shifted tridiagonal form (Sylvester's law of inertia)."""
    diagonal, beside = form
    tiny = np.finfo(float).tiny ** 0.5 + np.finfo(float).eps ** 2 * np.abs(diagonal).max(initial=0)
    n, pivot = 0, 1.0
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shift - (beside[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        n += int(pivot < 0)
    return n


def intervals(v: np.ndarray, components: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues within), from the top, until they hold the components asked for or all there are."""
    form = tridiagonal(v)
    around = np.concatenate(([0.0], np.abs(form[1]))) + np.concatenate((np.abs(form[1]), [0.0]))
    high = float((form[0] + around).max()) * (1 + 1e-10)
    if not high > 0:
        return []
    floor = RANK_FLOOR * high
    out, held, waiting = [], 0, [(floor, high, len(v) - count_below(form, floor))]
    while waiting and held < components:
        low, high, n = waiting.pop()
        cut = None
        if n > INTERVAL:
            # A bound with the same count a little to either side keeps away from eigenvalues.
            for share in (0.5, 0.45, 0.55, 0.4, 0.6, 0.33, 0.67, 0.25, 0.75, 0.1, 0.9, 0.03, 0.97):
                mid, away = low + share * (high - low), (high - low) * 1e-3
                if count_below(form, mid - away) == count_below(form, mid + away):
                    cut = mid
                    break
        if cut is not None and high - low > 1e-9 * high:
            upper = len(v) - count_below(form, cut) - (len(v) - count_below(form, high))
            waiting += [(low, cut, n - upper), (cut, high, upper)]
        elif n:
            out.append((low, high, n))
            held += n
    return out


def feast(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The count eigenpairs with eigenvalues in (low, high): values, and unit vectors as columns."""
    d, norm = len(v), float(np.linalg.norm(v))
    center, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(1j * np.pi / 2 * (1 - points))
    block = np.random.default_rng(20240711).standard_normal((d, min(d, count + max(4, count // 2))))
    enough, last = 8 * d * np.finfo(float).eps * norm, np.inf
    for _ in range(ROUNDS):
        projected = np.zeros_like(block)
        for turn, weight in zip(turns, weights, strict=True):
            shifted = (center + radius * turn) * np.eye(d) - v
            projected += weight / 2 * (radius * turn * np.linalg.solve(shifted, block.astype(complex))).real
        left, sizes, _ = np.linalg.svd(projected, full_matrices=False)
        left = left[:, sizes > 1e-14 * sizes[0]]
        values, inner = np.linalg.eigh(left.T @ v @ left)  # Rayleigh-Ritz
        block = left @ inner
        within = np.flatnonzero((values >= low) & (values <= high))
        errors = np.linalg.norm(v @ block[:, within] - block[:, within] * values[within], axis=0)
        best = within[np.argsort(errors, kind="stable")[:count]]
        worst = np.sort(errors)[:count].max(initial=0) if len(within) >= count else np.inf
        # At rounding, and another round has not made it better.
        if worst <= enough and worst >= last / 2:
            best = np.sort(best)
            return values[best], block[:, best]
        last = worst
    raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}; {len(within)} were found, the worst residual is {worst}")


@dataclass
class Whitening:
    """A fitted model. center: whole numbers near the means. rest: sums of x - center, exact."""

    n: int
    center: list[int]
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of the covariance of x; None without rows. rows: of whole_vectors()."""
    sums = _summed(rows, lambda x: np.append(x.astype(object).sum(axis=0), len(x)), "decimal(38,0)")
    if sums is None:
        return None
    n, d = int(sums[-1]), len(sums) - 1
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {d} dimensions; at most {MOST_DIMENSIONS} are fitted")
    center = [(2 * int(s) + n) // (2 * n) for s in sums[:-1]]
    rest = [int(s) - n * c for s, c in zip(sums[:-1], center, strict=True)]
    products = _summed(rows, lambda x: _products(x - np.array(center)), "decimal(38,0)").reshape(d, d)
    covariance = np.array([[(n * int(products[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
    found = intervals(covariance, components)
    pairs: list[tuple[float, list[float]]] = []
    if found:
        spark = rows.sparkSession
        told = spark.sparkContext.broadcast(covariance)  # MOST_DIMENSIONS bounds it
        schema = pa.schema([("value", pa.float64()), ("vector", pa.list_(pa.float64()))])

        def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    values, vectors = feast(told.value, low, high, count)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(vectors.T.tolist(), schema.types[1])], schema=schema)

        asked = spark.createDataFrame(found, "low double, high double, count int").repartition(len(found))
        pairs = [(r["value"], r["vector"]) for r in asked.mapInArrow(solve, "value double, vector array<double>").collect()]  # a few over components
    pairs = sorted(pairs, key=lambda p: -p[0])[:components]
    vectors = np.array([p[1] for p in pairs]).reshape(-1, d)
    # The largest entry of each vector is positive.
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None] if len(vectors) else 1.0
    return Whitening(n, center, rest, np.array([p[0] for p in pairs]), vectors, float(np.trace(covariance)))


def _deviations(model: Whitening, x: np.ndarray) -> np.ndarray:
    """n*x - S, exactly."""
    y = x - np.array(model.center)
    if model.n * int(np.abs(y).max(initial=0)) + max(map(abs, model.rest)) < 1 << 62:
        return model.n * y - np.array(model.rest)
    return model.n * y.astype(object) - np.array(model.rest, dtype=object)


def _projected(model: Whitening, off: np.ndarray) -> np.ndarray:
    return (off.astype(float) / model.n) @ (model.vectors / np.sqrt(model.values)[:, None]).T


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity, from a pass over them."""
    k = len(model.values)

    def part(x: np.ndarray) -> np.ndarray:
        w = _projected(model, _deviations(model, x))
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    sums = _summed(rows, part, "double")
    means = sums[k * k :] / model.n
    return float(np.abs(sums[: k * k].reshape(k, k) / model.n - np.outer(means, means) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component (from 1), deviation, whitened, explained: one row for each row of rows and component."""
    k = len(model.values)
    explained = model.values / model.trace
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())])

    def squares(off: np.ndarray) -> pa.Array:
        most = int(np.abs(off).max(initial=0))
        if most * most * off.shape[1] < 1 << 63:
            return pa.array((off.astype(np.int64) ** 2).sum(axis=1))
        sums = (off.astype(object) ** 2).sum(axis=1)
        return pa.array([int(s) if s < 1 << 63 else None for s in sums], pa.int64())

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                off = _deviations(model, _matrix(part.column(1)))
                each = pa.array(np.repeat(np.arange(part.num_rows), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), squares(off).take(each), pa.array(_projected(model, off).ravel()), pa.array(np.tile(explained, part.num_rows))],
                    schema=schema,
                )

    return rows.select("vec_id", "x").mapInArrow(project, "vec_id long, component int, deviation long, whitened double, explained double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every embedding, whitened by up to 32 components."""
    rows = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    model = fit(rows)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(rows, model)
    out = whiten(rows, model)
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
