"""Positions, windows, resamples, and how stable rules are over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import check_fraction, share
from ..sources.lines import draw
from ..sources.shared import materialized
from .mine import frequent_itemsets, itemsets_of_splits
from .rules import rules

#: The split that stands for all baskets where splits and the whole are mined together.
WHOLE = -1
#: Splits up to which a basket is read once for all of them.
TOGETHER = 64


def ranged(lines: DataFrame) -> DataFrame:
    """A table of (basket_id, part): ids of any type that has an order, dealt over parts that are ranges of them.

    Ranges are cut at sampled bounds, so the table is written before anything is counted.
    """
    ids = lines.where(F.col("basket_id").isNotNull() & F.col("item").isNotNull()).select("basket_id").distinct()
    return materialized(ids.repartitionByRange("basket_id").select("basket_id", F.spark_partition_id().alias("part")), "positions")


def numbered(ids: DataFrame) -> DataFrame:
    """basket_id, pos of a table of ranges; parts only exchange their counts."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ids.groupBy("part").agg(F.count("*").alias("c")).withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    within = F.row_number().over(Window.partitionBy("part").orderBy("basket_id")) - 1
    return ids.withColumn("at", within).join(F.broadcast(offsets), "part").select("basket_id", (F.col("at") + F.col("offset")).cast("long").alias("pos"))


def positions(lines: DataFrame) -> DataFrame:
    """basket_id, pos: arrival order from 0, by basket id, without bringing all ids to one task."""
    return numbered(ranged(lines))


def bound(i: int, k: int, n: Column) -> Column:
    """Where window i of k begins: halves go to the even number."""
    return F.bround(F.lit(float(i)) * n / F.lit(float(k)), 0).cast("long")


def time_windows(lines: DataFrame, k: int = 4) -> DataFrame:
    """basket_id, pos, split_id: k runs of arrivals of nearly equal length."""
    if k < 2:
        raise ValueError("at least two windows are needed")
    ids = ranged(lines)
    n = ids.count()
    if n < k:
        raise ValueError("fewer baskets than windows")
    split = sum((F.when(F.col("pos") >= bound(i, k, F.lit(n)), 1).otherwise(0) for i in range(1, k)), F.lit(0))
    return numbered(ids).select("basket_id", "pos", split.cast("long").alias("split_id"))


def bootstrap(lines: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """basket_id, split_id, weight: each fold draws as many baskets as there are, with replacement."""
    if folds < 2:
        raise ValueError("at least two folds are needed")
    placed = materialized(positions(lines), "placed")
    draws = bootstrap_draws(placed, folds, seed)
    return draws.groupBy("split_id", "pos").agg(F.count("*").alias("weight")).join(placed, "pos").select("basket_id", "split_id", "weight")


def bootstrap_draws(placed: DataFrame, folds: int, seed: int) -> DataFrame:
    n = placed.count()
    cells = placed.withColumn("split_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))))
    return cells.select("split_id", draw(F.lit(n), F.lit(seed), F.col("split_id"), F.col("pos")).alias("pos"))


def arrival_split(lines: DataFrame, fraction: float = 0.7) -> DataFrame:
    """basket_id, pos, is_train: the first ``fraction`` of arrivals learn."""
    check_fraction("fraction", fraction, closed=False)
    ids = ranged(lines)
    n = ids.count()
    cut = round(n * fraction)  # halves go to the even number
    if not 0 < cut < n:
        raise ValueError("one side of the split has no baskets")
    return numbered(ids).select("basket_id", "pos", (F.col("pos") < cut).alias("is_train"))


def split_ids(splits: DataFrame) -> list[int]:
    """The splits there are: as many numbers as there are splits."""
    return [r[0] for r in splits.select(F.col("split_id").cast("long").alias("s")).distinct().orderBy("s").collect()]


def rules_by_split(lines: DataFrame, splits: DataFrame, min_support: float, min_confidence: float, min_lift: float, max_len: int = 3, ids: list[int] | None = None, method: str = "auto") -> DataFrame:
    """Rules of every split, mined in one job: from one pass over baskets, or over a row for each split if there are many.

    With another ``method`` it is that of ``frequent_itemsets``, over a row for each split.
    """
    ids = split_ids(splits) if ids is None else ids
    if len(ids) <= TOGETHER and method == "auto":
        sets = itemsets_of_splits(lines, splits, ids, min_support, max_len)
    else:
        weight = ["weight"] if "weight" in splits.columns else []
        sets = frequent_itemsets(lines.select("basket_id", "item").join(splits.select("basket_id", "split_id", *weight), "basket_id"), min_support, max_len, method)
    return rules(materialized(sets, "itemsets"), min_confidence, min_lift, 0)


def stability(reference: DataFrame, by_split: DataFrame, n_splits: int, top_n: int = 20, threshold: float = 1.0) -> DataFrame:
    """For the top reference rules: how many splits have them, and their lifts there (population deviation)."""
    if n_splits < 2:
        raise ValueError("at least two splits are needed")
    top = reference.where(F.col("rank") <= top_n).select("rank", "antecedent", "consequent", F.col("lift").alias("reference_lift"), F.col("confidence").alias("reference_confidence"), F.col("support_count").alias("reference_count"))
    seen = top.join(by_split.select("antecedent", "consequent", F.col("lift").alias("seen")), ["antecedent", "consequent"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = seen.groupBy("rank", "antecedent", "consequent", "reference_lift", "reference_confidence", "reference_count").agg(
        F.count("seen").alias("n_present"), zero(F.avg("seen")).alias("lift_mean"), zero(F.stddev_pop("seen")).alias("lift_std"), zero(F.min("seen")).alias("lift_min"), zero(F.max("seen")).alias("lift_max")
    )
    out = out.withColumn("n_splits", F.lit(n_splits).cast("long")).withColumn("stability_score", F.col("n_present") / F.lit(float(n_splits)))
    return out.withColumn("lift_cv", share(F.col("lift_std"), F.col("lift_mean"))).withColumn("stable", F.col("stability_score") >= threshold)


def rule_stability(lines: DataFrame, reference: DataFrame | None, min_support: float, min_confidence: float, min_lift: float, method: str = "time_window", n_splits: int = 4, top_n: int = 20, threshold: float = 1.0, splits: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """``stability`` over time windows, bootstrap resamples, or given splits (basket_id, split_id), however many they are.

    Without ``reference`` the rules of all baskets are; they are then mined in the same pass as those of the splits.
    """
    ids = None
    if splits is not None:
        splits = materialized(splits, "splits")
        ids = split_ids(splits)
    elif method == "time_window":
        splits, ids = time_windows(lines, n_splits), list(range(n_splits))
    elif method == "bootstrap":
        splits, ids = bootstrap(lines, n_splits, seed), list(range(n_splits))
    else:
        raise ValueError(f"unknown method {method}")
    if len(ids) < 2:
        raise ValueError("at least two splits are needed")
    if reference is None:
        if WHOLE in ids:
            raise ValueError(f"split {WHOLE} stands for all baskets")
        weight = F.col("weight") if "weight" in splits.columns else F.lit(1)
        every = lines.where(F.col("item").isNotNull()).select("basket_id").distinct().select("basket_id", F.lit(WHOLE).cast("long").alias("split_id"), F.lit(1).cast("long").alias("weight"))
        both = splits.select("basket_id", F.col("split_id").cast("long").alias("split_id"), weight.cast("long").alias("weight")).unionByName(every)
        found = materialized(rules_by_split(lines, both, min_support, min_confidence, min_lift, ids=[*ids, WHOLE]), "rules")
        reference, by_split = found.where(F.col("split_id") == WHOLE), found.where(F.col("split_id") != WHOLE)
    else:
        by_split = rules_by_split(lines, splits, min_support, min_confidence, min_lift, ids=ids)
    return stability(reference, by_split, len(ids), top_n, threshold)
