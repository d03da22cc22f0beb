"""Approximate nearest neighbours through a few stable projections and a kd-tree over them.

Vectors are projected on ``DIM`` random Gaussian directions.  Squared projected distance over squared distance is
chi-square with ``DIM`` degrees of freedom.  A search takes the kd-tree's leaves in order of projected distance and
verifies their vectors exactly, until a neighbour nearer than the k-th so far would have so large a projection with
probability below ``1 - SURE`` (the chi-square test).  Each block of vectors has its own tree.  Queries visit all blocks,
in shares of about ``SHARE``, so no task holds more than a block and a share, however many queries there are; the stated
query set meets all rows in blocks.

Equal vectors are one point that keeps its k + 1 smallest ids, which is all that any answer can hold.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length than most take
no part, as queries and as candidates; rows that share vec_id and vector count once; among equal distances the smaller
vec_id comes first, also where it decides who is among the k; fewer candidates than k give all; other columns are never
read, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import batches, written

DIM, LEAF, SURE, SEED = 8, 32, 0.97, 911
BLOCK_ROWS, SHARE = 8192, 1024


def chi2_quantile(p: float, dof: int = DIM) -> float:
    """By bisection on the closed form for an even number of degrees of freedom."""
    lo, hi = 0.0, 200.0
    for _ in range(80):
        x = (lo + hi) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))
        lo, hi = (x, hi) if below < p else (lo, x)
    return lo


class ProjectedTree:
    """A kd-tree over projections: leaves of about LEAF points, each with its bounding box.

    Vectors come in the order in which equal distances are to be broken.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], DIM))
        points = vectors @ self.directions
        todo, leaves = [np.arange(len(points))], []
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                leaves.append(part)
                continue
            p = points[part]
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            order, half = np.argpartition(p[:, axis], len(part) // 2), len(part) // 2
            todo += [part[order[:half]], part[order[half:]]]
        self.leaves = leaves
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])
        self.limit = chi2_quantile(SURE)

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, distances) of about the k nearest."""
        p = q @ self.directions
        away = np.maximum(0, np.maximum(self.low - p, p - self.high))
        away = (away**2).sum(axis=1)
        order = np.argsort(away, kind="stable")
        at, dist, step = np.zeros(0, "i8"), np.zeros(0), 4
        for i in range(0, len(order), step):
            if len(dist) >= k and away[order[i]] > dist[-1] * self.limit:
                break
            new = np.concatenate([self.leaves[j] for j in order[i : i + step]])
            d = ((self.vectors[new] - q) ** 2).sum(axis=1)
            at, dist = np.r_[at, new], np.r_[dist, d]
            first = np.lexsort((at, dist))[:k]
            at, dist = at[first], dist[first]
        return at, np.sqrt(dist)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(good, F.lit(False)))
    top = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("v") == (top["n"] if top else 0)).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def points_of(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): distinct vectors with their ``keep`` smallest ids; copies meet in their task first."""

    def local(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
            m = lists.flatten().to_numpy().reshape(len(ids), -1)
            held: dict[bytes, list[int]] = {}
            for i in np.argsort(ids, kind="stable").tolist():
                own = held.setdefault(m[i].tobytes(), [])
                if len(own) < keep and (not own or own[-1] != ids[i]):
                    own.append(int(ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["v", "ids"])

    met = rows.mapInArrow(local, "v binary, ids array<long>").groupBy("v").agg(F.collect_list("ids").alias("ids"))
    return met.select("v", F.slice(F.array_sort(F.array_distinct(F.flatten("ids"))), 1, keep).alias("ids"))


def packed(rows: DataFrame) -> DataFrame:
    """(v, query_id) with the vector as bytes."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            m = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in m], pa.binary()), batch.column("vec_id")], ["v", "query_id"])

    return rows.mapInArrow(run, "v binary, query_id long")


def search(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    rows = usable(vectors, id_col, vec_col)
    points = written(points_of(rows, k + 1), "points")
    blocks = max(1, -(-points.count() // BLOCK_ROWS))
    queries = written(packed(rows.where(F.col("vec_id") % every == 0)).distinct(), "queries")
    vectors = written(queries.select("v").distinct(), "asked")
    shares = max(1, -(-vectors.count() // SHARE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = vectors.withColumn("share", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(shares)).cast("int")).withColumn("block", every(blocks))
    dealt = points.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")).withColumn("share", every(shares))

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if p.num_rows and q.num_rows:
            found = sorted(zip(p.column("ids").to_pylist(), p.column("v").to_pylist()))
            ids = [i for i, _ in found]
            tree = ProjectedTree(np.stack([np.frombuffer(b) for _, b in found]))
            for b in q.column("v").to_pylist():
                at, dist = tree.nearest(np.frombuffer(b), k + 1)
                for i, d in zip(at.tolist(), dist.tolist()):
                    out[0].append(b), out[1].append(ids[i]), out[2].append(d)
        return pa.table({"v": pa.array(out[0], pa.binary()), "ids": pa.array(out[1], pa.list_(pa.int64())), "score": pa.array(out[2], pa.float64())})

    found = asked.groupBy("block", "share").cogroup(dealt.groupBy("block", "share")).applyInArrow(run, "v binary, ids array<long>, score double")
    near = Window.partitionBy("v").orderBy("score", F.element_at("ids", 1))
    found = written(found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).drop("r"), "found")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    pairs = queries.join(found, "v").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
