"""Embedding whitening with eigenvectors refined from float32.

The covariance of the integer-scaled vectors is summed in blocks by the tasks; only one matrix of dimension squared reaches the driver. Its
eigenvectors are taken in float32 and corrected by Ogita-Aishima iterations: matrix products alone give, from how far X'X is from the identity
and X'VX from a diagonal, the correction of every pair of eigenvectors. The products are formed in extended precision. Where eigenvalues lie
too close for a pair's correction, the vectors of the cluster span the right space but not the right axes: the matrix, shifted by the
cluster's mean, is projected on that space and solved there, where the differences are large beside the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.words import batches

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LIMIT = float(1 << 40)  # of floor(SCALE * c), far beyond any embedding, within which sums of products of whole numbers stay exact
ROUNDS = 12
WIDE = np.longdouble


# ---- eigenvectors of one matrix -----------------------------------------------------


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Index runs of at least two neighbours, in rising order of value, that lie within gap of each other."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def correction(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: corrected vectors, their eigenvalues, and the distance below which two eigenvalues cannot be told apart."""
    r = np.eye(len(a), dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding over a small distance would tilt two vectors towards each other
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    norm = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum()))
    gap = 2 * (norm(off) + float(np.abs(values).max()) * norm(r))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > gap
    e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
    return x + x @ e, values, gap


def within_cluster(a: np.ndarray, x: np.ndarray, run: np.ndarray, centre: np.longdouble) -> np.ndarray:
    """Axes inside the space of a cluster: the shifted matrix projected on it is small and has no common part left to hide differences."""
    v = x[:, run]
    shifted = a @ v - centre * v
    inner = v.T @ shifted
    gram = v.T @ v
    inner = inner - (inner @ (gram - np.eye(len(run))) + (gram - np.eye(len(run))) @ inner) / 2  # first order in the lack of orthogonality
    size = np.abs(inner).max()
    if not size:
        return v
    _, axes = np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(np.float64))
    return v @ axes.astype(x.dtype)


def refined_eigen(matrix: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix to double precision, from a float32 start."""
    a = ((matrix + matrix.T) / 2).astype(WIDE)
    size = np.abs(a).max() if len(a) else 0
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a /= size
    _, x = np.linalg.eigh(a.astype(np.float32))
    x = x.astype(WIDE)
    for _ in range(rounds):
        moved = x
        x, values, gap = correction(a, x)
        for run in clusters(values, gap):
            x[:, run] = within_cluster(a, x, run, values[run].mean())
        if np.abs(x - moved).max() < 1e-17:
            break
    x = x + x @ ((np.eye(len(a), dtype=WIDE) - x.T @ x) / 2)  # what rotations inside clusters left of a lack of orthogonality
    values = (x * (a @ x)).sum(axis=0) / (x * x).sum(axis=0)
    x = x / np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    return (values[order] * size).astype(np.float64), x[:, order].astype(np.float64)


# ---- distributed sums --------------------------------------------------------------


@dataclass
class Fit:
    """What every task needs to whiten a vector; its size depends on the dimension only."""

    n: int
    sums: np.ndarray  # exact, of x
    axes: np.ndarray  # dimension x components, eigenvectors over the root of their eigenvalue; 0 where that is 0
    explained: list[float]


def usable(vector: Column, length: int | None = None) -> Column:
    """Not null or empty, every entry there and finite with a scaled value in range, and of the given length."""
    scaled = lambda c: F.abs(c.cast("double") * SCALE) < LIMIT  # noqa: E731  false for infinities, null for nulls
    fine = F.size(vector) > 0
    if length is not None:
        fine = fine & (F.size(vector) == length)
    return F.coalesce(fine & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & scaled(c)), F.lit(False))


def scaled_rows(column: pa.Array, dimension: int) -> np.ndarray:
    """x of each vector as whole numbers."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: in 64-bit numbers where they hold it, else in Python's."""
    bound = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if bound < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def squared_lengths(v: np.ndarray) -> list[int]:
    top = int(np.abs(v).max(initial=0))
    if top * top * max(1, v.shape[1]) < 1 << 62:
        v = v.astype(np.int64)
        return (v * v).sum(axis=1).tolist()
    v = v.astype(object)
    return (v * v).sum(axis=1).tolist()


def summed(rows: DataFrame, dimension: int, values) -> dict[tuple[int, int], float]:
    """Sums over all tasks of a matrix that values(x) gives for a block of vectors, by place."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in batches(source, 4096):
            block = values(scaled_rows(part.column(0), dimension))
            total = block if total is None else total + block
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["i", "j", "v"]
            )

    made = rows.mapInArrow(work, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r.i, r.j): r.v for r in made.collect()}  # dimension squared values


def matrix_of(cells: dict[tuple[int, int], float], shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for (i, j), v in cells.items():
        out[i, j] = v
    return out


def fit_whitening(rows: DataFrame, dimension: int, components: int = COMPONENTS) -> tuple[Fit, float]:
    """The fit over all vectors of rows, and the largest entry by which the covariance of their whitened values differs from the identity."""
    terms = F.transform("embedding", lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))
    place = rows.select(F.posexplode(terms).alias("i", "x")).groupBy("i").agg(
        F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    found = sorted(place.collect())  # one row per dimension
    n, sums = found[0].n, np.array([int(r.s) for r in found], dtype=object)
    inverse = 1.0 / n

    def product(x: np.ndarray) -> np.ndarray:
        y = centred(x, n, sums).astype(np.float64) * inverse
        return y.T @ y

    shape = (dimension, dimension)
    covariance = matrix_of(summed(rows.select("embedding"), dimension, product), shape) / n
    values, axes = refined_eigen(covariance)
    values, axes = values[:components], axes[:, :components]
    trace = float(np.trace(covariance))
    live = values > trace * dimension * np.finfo(np.float64).eps
    roots = np.where(live, np.sqrt(np.where(live, values, 1)), np.inf)
    explained = [float(v / trace) if trace else 0.0 for v in np.maximum(values, 0)]
    fit = Fit(n, sums, axes / roots, explained)

    def spread(x: np.ndarray) -> np.ndarray:
        w = whitened(fit, x)
        return np.concatenate([w.T @ w, w.sum(axis=0)[None, :]])

    k = len(values)
    total = matrix_of(summed(rows.select("embedding"), dimension, spread), (k + 1, k)) / n
    got = total[:k] - np.outer(total[k], total[k])
    error = np.abs(got - np.eye(k))[np.ix_(live, live)]
    return fit, float(error.max(initial=0.0))


def whitened(fit: Fit, x: np.ndarray) -> np.ndarray:
    return (centred(x, fit.n, fit.sums).astype(np.float64) * (1.0 / fit.n)) @ fit.axes


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector that can be read: vec_id, n, deviation decimal(38,0), whitened array, explained array, identity_error.

    x = floor(64 * c) + 1000000 of each entry c; whitened projects x - S/n on the eigenvectors of the covariance of x over all vectors,
    over the roots of the eigenvalues, which fall from the first on. Vectors that are null or empty or hold nulls, entries that are not
    finite or beyond 2^34, are dropped; so are vectors whose length is not the most frequent one (of equally frequent ones the greater). A component without
    variance (one vector, constant entries, fewer vectors than components) has no scale: its whitened values are null, and the identity error is over the others.
    Repeated rows count as often as they stand; null ids stay null. Without any vector the result is empty; no other column is read."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[vec_id]
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    sizes = rows.where(usable(F.col("embedding"))).groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("d")).select("d").first()
    schema = f"vec_id {kind}, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if common is None:
        return spark.createDataFrame([], schema)
    dimension = common.d
    rows = rows.where(usable(F.col("embedding"), dimension))
    fit, error = fit_whitening(rows, dimension, components)
    held = spark.sparkContext.broadcast(fit)  # dimension x components numbers

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = held.value
        dead = ~fit.axes.any(axis=0)
        for part in batches(source, 4096):
            x = scaled_rows(part.column(1), dimension)
            w = whitened(fit, x)
            mask = np.broadcast_to(dead, w.shape).ravel()
            flat = pa.array(w.ravel(), pa.float64(), mask=mask)
            edges = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            deviation = pa.array([str(v) for v in squared_lengths(centred(x, fit.n, fit.sums))], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), deviation, pa.ListArray.from_arrays(edges, flat)], names=["vec_id", "deviation", "whitened"])

    made = rows.mapInArrow(work, f"vec_id {kind}, deviation string, whitened array<double>")
    return made.select(
        "vec_id", F.lit(fit.n).cast("long").alias("n"), F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "whitened",
        F.array(*[F.lit(v) for v in fit.explained]).alias("explained"), F.lit(error).alias("identity_error"),
    )


def whitened_components(made: DataFrame) -> DataFrame:
    """One row per vector and component of whiten()'s result, the deviation as a long (null where a long cannot hold it)."""
    long = made.select(
        "vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error", "explained",
        F.posexplode("whitened").alias("k", "whitened"),
    )
    return long.select(
        "vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("k")).alias("explained"), "identity_error"
    )
