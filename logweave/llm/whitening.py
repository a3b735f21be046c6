"""Whitening of embeddings without forming an eigenproblem of the covariance.

Spark sums the scatter of the centred vectors, a small matrix of exact integers. A Cholesky
factorisation with diagonal pivoting writes it as L L^T; one-sided Jacobi rotations then make the
columns of the triangular factor orthogonal. The norms of the rotated columns are the roots of the
scatter's eigenvalues, the normalised columns its eigenvectors, small ones as exact as large ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import Scratch, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
CHUNK = 4096  # rows that a task works on at once
EXACT = 1 << 53  # doubles are exact integers below


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L^T; L has as many columns as the rank that rounding leaves."""
    a, d = a.copy(), len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for j in range(d):
        p = j + int(a.diagonal()[j:].argmax())
        if a[p, p] <= least:
            return factor[:, :j], order
        a[[j, p]], factor[[j, p]], order[[j, p]] = a[[p, j]], factor[[p, j]], order[[p, j]]
        a[:, [j, p]] = a[:, [p, j]]
        factor[j, j] = np.sqrt(a[j, j])
        factor[j + 1 :, j] = a[j + 1 :, j] / factor[j, j]
        a[j + 1 :, j + 1 :] -= np.outer(factor[j + 1 :, j], factor[j + 1 :, j])
    return factor, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated until all are orthogonal to rounding. Each step turns disjoint pairs of columns at once, as in a tournament."""
    x = factor.copy()
    r = x.shape[1]
    if r < 2:
        return x
    players = [*range(r), *([-1] if r % 2 else [])]
    small = np.finfo(float).eps * np.sqrt(len(x))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(players) - 1):
            half = len(players) // 2
            pairs = [(p, q) for p, q in zip(players[:half], players[:half - 1:-1]) if min(p, q) >= 0]
            p, q = (np.array(i) for i in zip(*pairs))
            a, b = x[:, p], x[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(ab) > small * np.sqrt(aa * bb)
            if turn.any():
                turned = True
                zeta = (bb - aa) / (2 * np.where(turn, ab, 1.0))
                t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
                c = 1 / np.sqrt(1 + t * t)
                x[:, p], x[:, q] = c * a - c * t * b, c * t * a + c * b
            players = [players[0], players[-1], *players[1:-1]]
        if not turned:
            break
    return x


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling positive eigenvalues and their unit eigenvectors as columns."""
    factor, order = pivoted_cholesky(scatter)
    rotated = one_sided_jacobi(factor)
    norms = np.sqrt((rotated * rotated).sum(0))
    fall = np.argsort(-norms, kind="stable")
    vectors = np.empty_like(rotated)
    vectors[order] = rotated
    return norms[fall] ** 2, vectors[:, fall] / norms[fall]


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _scatter(y: np.ndarray) -> np.ndarray:
    """The exact sum of y^T y as Python integers."""
    out = np.zeros((y.shape[1],) * 2, object)
    most = int(np.abs(y).max(initial=1))
    step = max(1, min(len(y), EXACT // most**2 - 1))
    for at in range(0, len(y), step):
        part = y[at : at + step]
        out += (part.T.astype(float) @ part.astype(float)).astype(np.int64).astype(object) if most**2 * step < EXACT else part.T.astype(object) @ part.astype(object)
    return out


def upper(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def entries(matrix: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """(i, j, value) of a symmetric matrix."""
    i, j = upper(len(matrix))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(list(matrix[i, j]), kind)], ["i", "j", "value"])


def collected(parts: DataFrame, d: int) -> np.ndarray:
    """The symmetric d x d matrix of summed entries."""
    out = np.zeros((d, d), object)
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # d (d + 1) / 2 rows
        value = r["value"]
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = value if isinstance(value, float) else int(value)
    return out


class Whitener:
    """Means, components and eigenvalues of a set of integer vectors."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray, most: int = COMPONENTS):
        """scatter: the exact sum over (x - middle)(x - middle)^T, middle being the rounded mean."""
        self.n, self.sums, d = n, sums, len(sums)
        self.middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
        rest = [s - n * int(m) for s, m in zip(sums, self.middle)]  # what rounding leaves, times n
        exact = [[Fraction(n * int(scatter[i, j]) - rest[i] * rest[j], n * n) for j in range(d)] for i in range(d)]
        self.covariance = np.array([[float(x) for x in row] for row in exact])
        self.trace = float(sum((exact[i][i] for i in range(d)), Fraction(0)))
        self.offset = np.array([float(Fraction(r, n)) for r in rest])
        values, vectors = eigen(self.covariance)
        self.values, self.vectors = values[:most], vectors[:, :most]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) - self.offset) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over (n * x - sums)^2; None where a long can't hold it."""
        far = np.abs(x - self.middle).max(axis=1, initial=0).astype(float) + 1
        if (far.max(initial=0.0) * self.n) ** 2 * x.shape[1] < 2.0**62:
            return ((self.n * (x - self.middle) - np.array([s - self.n * int(m) for s, m in zip(self.sums, self.middle)])) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [e if e < 1 << 63 else None for e in exact]


def whitened(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Whitener | None]:
    """((key, deviation, w: array of whitened components) of every remaining vector, the fitted whitener).

    Left out are null and empty vectors, those with null or non-finite entries and those of another length
    than the most frequent one (of equally frequent ones the smallest). Entries become floor(64 * c) +
    1000000. Components whose eigenvalue vanishes can't be whitened and are left out, so equal vectors
    have an empty w, as has a single one. Repeated rows and null keys are vectors like others; a deviation
    beyond a long is null. Other columns are left out. No remaining vector: no rows and no whitener.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    v = F.col("v")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(v) > 0)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(sound)
    rows = scratch.save(rows.select("id", F.transform(v, lambda c: F.floor(c * float(SCALE)) + F.lit(SHIFT)).cast("array<long>").alias("x")), "rows")
    result = T.StructType([T.StructField(key, rows.schema["id"].dataType), T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], result), None
    d = length["d"]
    rows = rows.where(F.size("x") == d)
    # a task's sums are rows of (dimension, sum): decimals, so no order of adding matters
    exact = pa.decimal128(38, 0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(d, object)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                x = _rows(batch.column("x").slice(at, CHUNK))
                n, sums = n + len(x), sums + ((x - SHIFT).sum(0).astype(object) + SHIFT * len(x) if np.abs(x - SHIFT).max() < 1 << 50 else x.astype(object).sum(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([n, *sums], exact)], ["i", "value"])

    got = {r["i"]: int(r["value"]) for r in rows.select("x").mapInArrow(add, "i int, value decimal(38,0)").groupBy("i").agg(F.sum("value").alias("value")).collect()}
    n, sums = got[-1], [got[i] for i in range(d)]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((d, d), object)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                held += _scatter(_rows(batch.column("x").slice(at, CHUNK)) - middle)
        yield entries(held, exact)

    model = Whitener(n, sums, collected(rows.select("x").mapInArrow(scatter, "i int, j int, value decimal(38,0)"), d), components)
    shared = spark.sparkContext.broadcast(model)  # components x dimensions

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x = _rows(part.column("x"))
                w = shared.value.whiten(x)
                ends = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(shared.value.deviation(x), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))], result.names)

    return rows.mapInArrow(project, result), model


def identity_error(rows: DataFrame, k: int, w: str = "w") -> float:
    """The largest absolute entry of the covariance of w, centred by its own mean, less the identity."""
    if not k:
        return 0.0
    mean = rows.agg(F.count("*").alias("n"), *[F.avg(F.col(w)[i]).alias(f"m{i}") for i in range(k)]).first()
    means = np.array([mean[f"m{i}"] for i in range(k)])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                y = batch.column(w).slice(at, CHUNK).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - means
                held += y.T @ y
        yield entries(held, pa.float64())

    covariance = collected(rows.select(w).mapInArrow(scatter, "i int, j int, value double"), k).astype(float) / mean["n"]
    return float(np.abs(covariance - np.eye(k)).max())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every remaining embedding in up to 32 whitened components, a row each: vec_id, component, n, deviation, whitened, explained, identity_error. Odd rows as in whitened()."""
    rows, model = whitened(table(spark, sf_dir, "embeddings"))
    if model is None:
        return rows.select("vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), "deviation", *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    rows = Scratch(spark, "whitened").save(rows, "rows")
    k = len(model.values)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    out = rows.select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened"))
    return out.select(
        "vec_id", (F.col("c") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("c")).alias("explained"), F.lit(identity_error(rows, k)).alias("identity_error"),
    )
