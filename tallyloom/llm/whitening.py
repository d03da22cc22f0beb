"""Whitening of embeddings: covariance from one aggregation over the upper triangle, decomposed by LAPACK.

Entries become whole numbers x.  The fit list holds every distinct vector once.  One aggregation sums x and finds its
range for every dimension; a second one, of generated expressions, sums the centred product of every pair of dimensions
i <= j; the driver gets d * (d + 1) / 2 numbers, whatever the number of rows, and decomposes their matrix.  Rows are then
projected in Arrow batches, and the covariance of what came out is aggregated in the same way to see how far it is from
the identity.

Defined cases: vectors that are null, empty or hold null or non-finite entries take no part; of several lengths the most
frequent one counts (the smallest among equals) and others take no part; components whose eigenvalue is not above 1e-12
of the trace, as of dimensions that never vary or depend on others, are 0.0 in every row and don't count in
identity_error; repeated rows give repeated rows; rows without an id stay; other columns aren't read; without any vector
the result is empty.  Entries beyond 2 ** 52 in absolute value and deviations beyond 2 ** 63 are errors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, written

COMPONENTS = 16
#: Well beyond the largest entry that is no error.
FAR = float(1 << 60)
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): floor(64 * entry) + 1000000 of every vector that takes part."""
    good = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.select("vec_id", F.transform("embedding", lambda e: F.floor(F.least(F.greatest(F.lit(64.0) * e.cast("double"), F.lit(-FAR)), F.lit(FAR))).cast("long") + 1_000_000).alias("x"))


def upper_triangle(columns: list[str]) -> list[str]:
    """SQL that sums the product of every pair of the given, centred expressions."""
    return [f"sum({a} * {b}) AS p_{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate(columns[i:], i)]


def covariance(rows: DataFrame, columns: list[str], n: int) -> np.ndarray:
    """Of centred columns, divisor n, by one aggregation."""
    sums = rows.selectExpr(*upper_triangle(columns)).first()
    out = np.zeros((len(columns), len(columns)))
    for i in range(len(columns)):
        for j in range(i, len(columns)):
            out[i, j] = out[j, i] = sums[f"p_{i}_{j}"] / n
    return out


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # whole numbers, by dimension
    axes: np.ndarray  # dimensions by components: unit eigenvectors
    values: np.ndarray  # eigenvalues, falling
    trace: float
    identity_error: float = 0.0

    @property
    def scale(self) -> np.ndarray:
        real = self.values > 1e-12 * self.trace
        return np.where(real, 1 / np.sqrt(np.where(real, self.values, 1.0)), 0.0)

    def away(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        return self.n * x - self.sums

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.away(x) / self.n) @ self.axes * self.scale


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("x").flatten().to_numpy()
    return values.reshape(batch.num_rows, -1)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Eigenvectors of the covariance over distinct vectors; None without any."""
    distinct = written(vectors.select("x").distinct(), "whitening-fit")
    width = distinct.select(F.size("x").alias("d")).first()
    if width is None:
        return None
    d = width[0]
    ends = distinct.selectExpr("count(*) AS n", *(f"{f}(x[{i}]) AS {f}_{i}" for i in range(d) for f in ("sum", "min", "max"))).first()
    n, sums = ends["n"], np.array([ends[f"sum_{i}"] for i in range(d)], np.int64)
    far = max(max(abs(ends[f"{f}_{i}"]) for f in ("min", "max")) for i in range(d))
    wide = sum(max(abs(n * ends[f"{f}_{i}"] - ends[f"sum_{i}"]) for f in ("min", "max")) ** 2 for i in range(d))
    if far > 1 << 52 or wide >= 1 << 63:
        raise ValueError("entries or deviations don't fit whole numbers of 64 bits")
    centred = distinct.selectExpr(*(f"x[{i}] - {ends[f'sum_{i}'] / n!r}D AS c{i}" for i in range(d)))
    v = covariance(centred, [f"c{i}" for i in range(d)], n)
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    found = Whitening(n, sums, axes[:, order], values[order], float(np.trace(v)))
    k = len(order)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.project(matrix(batch)).T], [f"w{i}" for i in range(k)])

    out = covariance(distinct.mapInArrow(run, ", ".join(f"w{i} double" for i in range(k))), [f"w{i}" for i in range(k)], n)
    real = found.scale > 0
    found.identity_error = float(np.abs((out - np.eye(k))[np.ix_(real, real)]).max()) if real.any() else 0.0
    return found


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component, with what the fit says of the component."""
    vectors = whole_vectors(embeddings)
    common = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").first()
    found = None
    if common is not None:
        vectors = vectors.where(F.size("x") == common["d"])
        found = fit(vectors, components)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], OUT)
    k = len(found.values)
    explained = np.where(found.scale > 0, found.values, 0.0) / (found.trace or 1.0)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            x, m = matrix(batch), batch.num_rows
            away = found.away(x)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n, np.int64)), pa.array(np.repeat((away * away).sum(axis=1), k)),
                pa.array(found.project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, found.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in OUT.split(", ")])

    return vectors.mapInArrow(run, OUT)
