"""Customer segments: k-means over the mix of what customers spend."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import share
from ..sources.lines import uniform
from ..sources.shared import materialized


def spend(lines: DataFrame) -> DataFrame:
    """customer_id, item, amount: exact sums."""
    return lines.where(F.col("customer_id").isNotNull()).groupBy("customer_id", "item").agg(F.sum(F.col("amount").cast("decimal(18,4)")).cast("double").alias("amount"))


def spend_matrix(lines: DataFrame, items: list[str]) -> DataFrame:
    """One column for each of the given items, zeros filled in."""
    return spend(lines).groupBy("customer_id").pivot("item", items).agg(F.first("amount")).na.fill(0.0)


def totals(lines: DataFrame) -> DataFrame:
    return spend(lines).groupBy("customer_id").agg(F.sum(F.col("amount").cast("decimal(28,4)")).cast("double").alias("total"))


def shares(lines: DataFrame) -> DataFrame:
    """customer_id, item, share of the customer's spend; 0 where a customer spent nothing."""
    return spend(lines).join(totals(lines), "customer_id").select("customer_id", "item", F.round(share(F.col("amount"), F.col("total")), 9).alias("share"))


def mixes(lines: DataFrame, items: list[str]) -> DataFrame:
    """customer_id, total, x: what a customer spent and its shares in the order of ``items``; lines are read once."""
    held = spend(lines).groupBy("customer_id").agg(F.sum(F.col("amount").cast("decimal(28,4)")).cast("double").alias("total"), F.map_from_entries(F.collect_list(F.struct("item", "amount"))).alias("m"))
    return held.select("customer_id", "total", F.array(*(F.round(share(F.col("m")[i], F.col("total")), 9) for i in items)).alias("x"))


def features(lines: DataFrame, items: list[str]) -> DataFrame:
    """customer_id, x: shares in the order of ``items``."""
    return mixes(lines, items).select("customer_id", "x")


def away(x: Column, centre: list[float]) -> Column:
    """Squared distance; a centre has one number per item, so it stands in the plan."""
    return F.aggregate(F.zip_with(x, F.array(*map(F.lit, centre)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def assign(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Adds cluster and d2: the nearest centre, the first among equals."""
    best = F.array_min(F.array(*(F.struct(away(F.col("x"), c).alias("d2"), F.lit(i).alias("cluster")) for i, c in enumerate(centres))))
    return points.withColumn("best", best).select(*points.columns, F.col("best.cluster").alias("cluster"), F.col("best.d2").alias("d2"))


#: Coordinates and distances are added up in whole multiples of this part of 1.
UNITS = 10**12
SUMS = "start int, cluster int, at int, total decimal(38,0)"


def coordinates(x: pa.Array) -> np.ndarray:
    """Equally long lists as a column each, one row for each place in them."""
    return np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).T)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each start of ``centres``: every column's nearest centre, the first among equals, and the squared distance."""
    d2 = np.zeros((*centres.shape[:2], x.shape[1]))
    for j, column in enumerate(x):
        apart = column - centres[:, :, j, None]
        d2 += apart * apart
    cluster, least = np.zeros(d2[:, 0].shape, dtype=int), d2[:, 0].copy()
    for c in range(1, centres.shape[1]):
        cluster[d2[:, c] < least] = c
        np.minimum(least, d2[:, c], out=least)
    return cluster, least


def whole(x: np.ndarray) -> np.ndarray:
    """In units; Python's numbers where sums might not fit 64 bits."""
    scaled = np.rint(x * UNITS)
    fits = np.abs(scaled).max(initial=0) * x.shape[-1] < 2**62
    return scaled.astype(np.int64) if fits else np.array([[int(v) for v in row] for row in scaled], dtype=object)


def step(points: DataFrame, starts: dict[int, list[list[float]]]) -> dict[int, list[tuple[int, list[int], int]]]:
    """Of each start's clusters: their points, and in units the sums of their coordinates and of their squared distances.

    One pass over the points; tasks add up their own, and as many rows come to the driver as centres have numbers.
    """
    names, centres = list(starts), np.array(list(starts.values()), dtype=float)
    n, k, width = centres.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n, k, width + 2), dtype=object)
        for b in batches:
            if not b.num_rows:
                continue
            x = coordinates(b.column(0))
            cluster, d2 = nearest(x, centres)
            units, apart = whole(x), whole(d2)
            for c in range(k):
                for s in range(n):
                    mine = np.flatnonzero(cluster[s] == c)
                    sums[s, c] += [len(mine), *(int(u) for u in units[:, mine].sum(axis=1)), int(apart[s, mine].sum())]
        s, c, at = (i.ravel() for i in np.indices(sums.shape))
        kept = (sums[:, :, :1] > 0).repeat(width + 2, axis=2).ravel()
        columns = [pa.array(np.array(names)[s[kept]], pa.int32()), pa.array(c[kept], pa.int32()), pa.array(at[kept], pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([Decimal(v) for v in sums.ravel()[kept]], pa.decimal128(38, 0))], ["start", "cluster", "at", "total"])

    found = {r: [[0] * (width + 2) for _ in range(k)] for r in names}
    for r in points.select("x").mapInArrow(run, SUMS).groupBy("start", "cluster", "at").agg(F.sum("total").alias("total")).collect():
        found[r["start"]][r["cluster"]][r["at"]] = int(r["total"])
    return {r: [(c[0], c[1:-1], c[-1]) for c in of] for r, of in found.items()}


def farthest(points: DataFrame, starts: dict[int, list[list[float]]]) -> dict[int, list[float]]:
    """Of each start the point that is farthest from its nearest centre, the first customer's among equals."""
    names, centres = list(starts), np.array(list(starts.values()), dtype=float)
    schema = StructType([StructField("start", IntegerType()), StructField("d2", DoubleType()), points.schema["customer_id"], points.schema["x"]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, d2 = nearest(coordinates(b.column(1)), centres)
            for r, apart in zip(names, d2):
                tied = b.take(pa.array(np.flatnonzero(apart == apart.max())))
                first = tied.take(pc.sort_indices(tied.column(0))[:1])
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([apart.max()]), *first.columns], ["start", "d2", "customer_id", "x"])

    far = points.select("customer_id", "x").mapInArrow(run, schema).groupBy("start").agg(F.min_by("x", F.struct(-F.col("d2"), "customer_id")).alias("x"))
    return {r["start"]: list(r["x"]) for r in far.collect()}


def lloyd_all(points: DataFrame, starts: list[list[list[float]]], max_iter: int = 200, tol: float = 1e-10) -> list[tuple[list[list[float]], float]]:
    """Centres and inertia of every start after alternating assignment and means; an empty cluster restarts at the farthest point.

    Starts that still move share one job a step.  Centres go along with the tasks, so every step has the same plan.
    """
    done, going = {}, dict(enumerate(starts))
    for _ in range(max_iter):
        found = step(points, going)
        new = {r: [[u / UNITS / n for u in sums] if n else None for n, sums, _ in of] for r, of in found.items()}
        short = {r: going[r] for r, centres in new.items() if None in centres}
        far = farthest(points, short) if short else {}
        for r, centres in list(going.items()):
            going[r] = [far[r] if c is None else c for c in new[r]]
            if sum((a - b) ** 2 for c, d in zip(going[r], centres) for a, b in zip(c, d)) <= tol:
                done[r] = going.pop(r)
        if not going:
            break
    done |= going
    inertia = {r: sum(d2 for *_, d2 in of) / UNITS for r, of in step(points, done).items()}
    return [(done[r], inertia[r]) for r in range(len(starts))]


def lloyd(points: DataFrame, centres: list[list[float]], max_iter: int = 200, tol: float = 1e-10) -> tuple[list[list[float]], float]:
    return lloyd_all(points, [centres], max_iter, tol)[0]


def seeded_centres(points: DataFrame, k: int, seeds: list[int]) -> list[list[list[float]]]:
    """k-means++ starts, one for each seed: each further centre is drawn in proportion to its squared distance, by
    exponential waiting times.  All starts' draws of a centre are one job."""
    chosen = lambda picks: list(points.agg(*(F.min_by("x", p).alias(f"c{r}") for r, p in enumerate(picks))).first())
    starts = [[list(x)] for x in chosen([F.struct(uniform(F.lit(s), F.lit(0), F.col("customer_id")), F.col("customer_id")) for s in seeds])]
    for i in range(1, k):
        picks = []
        for s, centres in zip(seeds, starts):
            d2 = F.array_min(F.array(*(away(F.col("x"), c) for c in centres)))
            wait = -F.log(1 - uniform(F.lit(s), F.lit(i), F.col("customer_id")))
            picks.append(F.struct(F.when(d2 > 0, wait / d2).otherwise(F.lit(float("inf"))), wait, F.col("customer_id")))
        for centres, x in zip(starts, chosen(picks)):
            centres.append(list(x))
    return starts


def kmeans(points: DataFrame, k: int, seed: int = 0, n_init: int = 8, max_iter: int = 200, tol: float = 1e-10) -> tuple[list[list[float]], float]:
    """The best of several starts; the first wins ties."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if points.limit(k).count() < k:
        raise ValueError("fewer points than clusters")
    made = lloyd_all(points, seeded_centres(points, k, [seed * 1000 + r for r in range(n_init)]), max_iter, tol)
    return min(made, key=lambda m: m[1])


def segment_customers(lines: DataFrame, items: list[str], k: int = 3, seed: int = 0, top_n: int = 3, n_init: int = 8, max_iter: int = 200, centres: list[list[float]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments, profiles, centroids); segments are numbered by size.  ``centres``, if given, are taken as they are."""
    points = materialized(mixes(lines, items), "points")
    if centres is None:
        centres, _ = kmeans(points, k, seed, n_init, max_iter)
    rows = materialized(assign(points, centres).select("customer_id", "total", "cluster"), "assigned")
    order = Window.orderBy(F.desc("n"), "cluster")
    names = rows.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("segment", (F.row_number().over(order) - 1).cast("int"))
    numbered = rows.join(names.drop("n"), "cluster")
    assignments = numbered.select("customer_id", "segment")
    spark = lines.sparkSession
    flat = spark.createDataFrame([(i, item, float(v)) for i, c in enumerate(centres) for item, v in zip(items, c)], "cluster int, item string, share double")
    centroids = flat.join(names, "cluster").select("segment", "item", "share")
    top = centroids.withColumn("r", F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("share"), "item"))).where(F.col("r") <= top_n)
    top = top.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("r", "item", "share"))).alias("t")).select("segment", F.transform("t", lambda s: F.struct(s["item"].alias("item"), s["share"].alias("share"))).alias("top_items"))
    sized = numbered.groupBy("segment").agg(F.count("*").alias("n"), F.round(F.avg("total"), 6).alias("mean_total"))
    everyone = sized.agg(F.sum("n").alias("all"))
    profiles = sized.join(everyone).select("segment", "n", (F.col("n") / F.col("all")).alias("share"), "mean_total").join(top, "segment")
    return assignments, profiles, centroids
