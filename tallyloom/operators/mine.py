"""Frequent itemsets: (split_id, items, size, cnt, n, support) by miners that don't share their counting.

``split_id`` lets many samples of the same baskets be mined in one job; without splits it is 0.  ``weight`` tells how
often a basket counts.  Counts are whole numbers throughout; supports are count over baskets.

Lines and levels are tables: every level reads the one before from its own, so the plan of a level is the same at any
depth, and nothing upstream runs again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import check_fraction, combinations, min_count
from ..sources.shared import materialized
from . import growth, vertical


def with_split(lines: DataFrame) -> DataFrame:
    """split_id, basket_id, item, weight of each distinct line."""
    split = F.col("split_id") if "split_id" in lines.columns else F.lit(0)
    weight = F.col("weight") if "weight" in lines.columns else F.lit(1)
    kept = lines.where(F.col("basket_id").isNotNull() & F.col("item").isNotNull())
    return kept.select(split.cast("long").alias("split_id"), "basket_id", "item", weight.cast("long").alias("weight")).distinct()


def split_baskets(lines: DataFrame) -> DataFrame:
    """split_id, basket_id, weight, items: each split's baskets with their distinct items, sorted; one shuffle."""
    split = F.col("split_id") if "split_id" in lines.columns else F.lit(0)
    weight = F.col("weight") if "weight" in lines.columns else F.lit(1)
    kept = lines.where(F.col("basket_id").isNotNull() & F.col("item").isNotNull()).select(split.cast("long").alias("split_id"), "basket_id", weight.cast("long").alias("weight"), "item")
    return kept.groupBy("split_id", "basket_id").agg(F.first("weight").alias("weight"), F.array_sort(F.collect_set("item")).alias("items"))


def baskets(lines: DataFrame) -> DataFrame:
    """basket_id, items: each basket's distinct items, sorted."""
    return lines.where(F.col("basket_id").isNotNull() & F.col("item").isNotNull()).groupBy("basket_id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def basket_totals(rows: DataFrame) -> DataFrame:
    """split_id, n: baskets of each split; as many rows as splits."""
    return rows.groupBy("split_id", "basket_id").agg(F.first("weight").alias("weight")).groupBy("split_id").agg(F.sum("weight").cast("long").alias("n"))


def item_counts(lines: DataFrame) -> DataFrame:
    return with_split(lines).groupBy("split_id", "item").agg(F.sum("weight").cast("long").alias("cnt"))


#: Combinations of a basket's frequent items up to which all of them are made at once.
NARROW = 2500


def n_combinations(n: Column, max_len: int) -> Column:
    """How many sets of up to ``max_len`` of n items there are, as a double."""
    total, term = F.lit(0.0), F.lit(1.0)
    for k in range(1, max_len + 1):
        term = term * F.greatest(n - (k - 1), F.lit(0)) / k
        total = total + term
    return total


def has_wide(held: DataFrame, max_len: int) -> bool:
    """Whether a basket has more combinations than are made at once."""
    return bool(held.where(n_combinations(F.size("items"), max_len) > NARROW).limit(1).count())


def frequent_itemsets(lines: DataFrame, min_support: float = 0.02, max_len: int = 3, method: str = "auto") -> DataFrame:
    """Level-wise mining.

    ``explode`` makes all combinations of a basket's frequent items at once, with one shuffle; ``vertical`` intersects
    bitmaps of items within ranges of baskets, level by level, and never takes a basket apart; ``join`` grows sets item
    by item and drops infrequent candidates at every level; ``growth`` grows patterns from conditional bases, in which
    equal baskets are one row.  ``auto`` is the first unless a basket has more than ``NARROW`` combinations, and then
    the second.
    """
    check_fraction("min_support", min_support)
    if max_len < 1:
        raise ValueError("max_len must be at least 1")
    if method not in ("auto", "explode", "vertical", "join", "growth"):
        raise ValueError(f"unknown method {method}")
    every = materialized(split_baskets(lines), "baskets")
    totals = every.groupBy("split_id").agg(F.sum("weight").cast("long").alias("n"))
    singles = every.select("split_id", "weight", F.explode("items").alias("item")).groupBy("split_id", "item").agg(F.sum("weight").cast("long").alias("cnt"))
    frequent = materialized(keep_frequent(singles.select("split_id", F.array("item").alias("items"), "cnt"), totals, min_support), "level")
    if max_len == 1:
        return frequent
    if method == "growth":
        return by_growth(every, frequent, totals, min_support, max_len)
    held = only_frequent(every, frequent)
    if method == "join":
        rows = held.select("split_id", "basket_id", "weight", F.explode("items").alias("item"))
        return grow(materialized(rows, "frequent-lines"), totals, min_support, max_len)
    if method == "auto":
        method = "vertical" if has_wide(held, max_len) else "explode"
    if method == "explode":
        return keep_frequent(all_sets(held, max_len), totals, min_support)
    return by_bitmaps(held, frequent, totals, min_support, max_len)


#: Frequent items that go along with every basket to be looked up there; more are met by a join.
LOOKED_UP = 500


def only_frequent(every: DataFrame, frequent: DataFrame) -> DataFrame:
    """Baskets with only their frequent items, of those that have any."""
    known = frequent.select("split_id", F.element_at("items", 1).alias("item"))
    if known.limit(LOOKED_UP + 1).count() <= LOOKED_UP:
        lists = F.broadcast(known.groupBy("split_id").agg(F.collect_list("item").alias("known")))
        return every.join(lists, "split_id").select("split_id", "basket_id", "weight", F.array_intersect("items", "known").alias("items")).where(F.size("items") > 0)
    rows = every.select("split_id", "basket_id", "weight", F.explode("items").alias("item")).join(known, ["split_id", "item"], "left_semi")
    return materialized(rows.groupBy("split_id", "basket_id").agg(F.first("weight").alias("weight"), F.array_sort(F.collect_list("item")).alias("items")), "frequent-baskets")


def by_bitmaps(held: DataFrame, first: DataFrame, totals: DataFrame, min_support: float, max_len: int) -> DataFrame:
    """Levels counted within blocks of baskets; ``first`` holds the frequent items."""
    blocks = materialized(vertical.blocks(held), "blocks")
    levels = [first]
    for k in range(2, max_len + 1):
        if k == 2:
            counts = vertical.pair_counts(blocks)
        else:
            wanted = materialized(candidates(levels[-1], k), "candidates")
            n = wanted.count()
            if not n:
                break
            counts = vertical.set_counts(blocks, wanted, n)
        levels.append(materialized(keep_frequent(counts.groupBy("split_id", "items").agg(F.sum("cnt").cast("long").alias("cnt")), totals, min_support), "level"))
    return reduce(DataFrame.unionByName, levels)


def by_growth(every: DataFrame, first: DataFrame, totals: DataFrame, min_support: float, max_len: int) -> DataFrame:
    """Levels counted in conditional bases, of all splits together; ``first`` holds the frequent items."""
    bases, levels = growth.paths(every, first, LOOKED_UP), [first]
    for k in range(2, max_len + 1):
        bases = materialized(growth.longer(bases), "bases")
        level = materialized(keep_frequent(growth.counts(bases), totals, min_support), "level")
        levels.append(level)
        if k < max_len:
            if not level.limit(1).count():
                break
            bases = growth.only_known(bases, level)
    return reduce(DataFrame.unionByName, levels).withColumn("items", F.array_sort("items"))


def all_sets(held: DataFrame, max_len: int) -> DataFrame:
    """split_id, items, cnt of all combinations of up to ``max_len`` items of the given baskets."""
    sets = F.concat(*(combinations(F.col("items"), k) for k in range(1, max_len + 1)))
    return held.select("split_id", "weight", F.explode(sets).alias("items")).groupBy("split_id", "items").agg(F.sum("weight").cast("long").alias("cnt"))


def keep_frequent(counts: DataFrame, totals: DataFrame, min_support: float) -> DataFrame:
    found = counts.join(totals, "split_id").where(F.col("cnt") >= min_count(min_support, F.col("n")))
    return found.select("split_id", "items", F.size("items").alias("size"), "cnt", "n", (F.col("cnt").cast("double") / F.col("n")).alias("support"))


def candidates(frequent: DataFrame, k: int) -> DataFrame:
    """Sets of k items all of whose subsets of k - 1 are frequent: prefix join, then closure check."""
    level = frequent.where(F.col("size") == k - 1).select("split_id", F.slice("items", 1, k - 2).alias("prefix"), F.element_at("items", -1).alias("last"))
    other = level.select("split_id", "prefix", F.col("last").alias("next"))
    made = level.join(other, ["split_id", "prefix"]).where(F.col("last") < F.col("next")).select("split_id", F.concat("prefix", F.array("last", "next")).alias("items"))
    if k == 2:
        return made
    parts = made.withColumn("part", F.explode(combinations(F.col("items"), k - 1)))
    known = frequent.where(F.col("size") == k - 1).select("split_id", F.col("items").alias("part"))
    return parts.join(known, ["split_id", "part"], "left_semi").groupBy("split_id", "items").agg(F.count("*").alias("c")).where(F.col("c") == k).select("split_id", "items")


def grow(rows: DataFrame, totals: DataFrame, min_support: float, max_len: int) -> DataFrame:
    """Frequent sets of the baskets in the table ``rows``: each level's sets and the baskets that hold them are tables."""
    held, levels = rows.select("split_id", "basket_id", "weight", F.array("item").alias("items")), []
    for k in range(1, max_len + 1):
        if levels:
            held = held.join(levels[-1].select("split_id", "items"), ["split_id", "items"], "left_semi")
            longer = held.join(rows.select("split_id", "basket_id", "item"), ["split_id", "basket_id"]).where(F.col("item") > F.element_at("items", -1))
            longer = longer.select("split_id", "basket_id", "weight", F.concat("items", F.array("item")).alias("items"))
            held = materialized(longer.join(candidates(levels[-1], k), ["split_id", "items"], "left_semi"), "held")
        counts = held.groupBy("split_id", "items").agg(F.sum("weight").cast("long").alias("cnt"))
        levels.append(materialized(keep_frequent(counts, totals, min_support), "level"))
    return reduce(DataFrame.unionByName, levels)


def itemsets_of_splits(lines: DataFrame, splits: DataFrame, ids: list[int], min_support: float, max_len: int = 3) -> DataFrame:
    """``frequent_itemsets`` of many samples (basket_id, split_id[, weight]) of the same baskets from one pass.

    A basket is read and taken apart once, with a vector that tells how often each split of ``ids`` holds it; every
    itemset sums these vectors.  Items and sets are dropped where they are infrequent in all splits.  Wide baskets are
    mined by bitmaps, split by split.
    """
    check_fraction("min_support", min_support)
    drawn = splits.select("basket_id", F.col("split_id").cast("long").alias("split_id"), (F.col("weight") if "weight" in splits.columns else F.lit(1)).cast("long").alias("weight"))
    weights = F.array(*(F.sum(F.when(F.col("split_id") == i, F.col("weight")).otherwise(F.lit(0))).cast("long") for i in ids))
    vectors = drawn.groupBy("basket_id").agg(weights.alias("weights"))
    held = materialized(baskets(lines).join(vectors, "basket_id"), "dealt-baskets")
    each = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("split_id"), F.col(f"c{at}").alias("cnt")) for at, i in enumerate(ids)))).alias("x")
    sums = [F.sum(F.element_at("weights", at + 1)).cast("long").alias(f"c{at}") for at in range(len(ids))]
    totals = held.agg(*sums).select(each).select("x.split_id", F.col("x.cnt").alias("n")).where("n > 0")

    def counted(sets: DataFrame) -> DataFrame:
        return sets.groupBy("items").agg(*sums).select("items", each).select("x.split_id", "items", "x.cnt").where("cnt > 0")

    first = keep_frequent(counted(held.select("weights", F.explode("items").alias("item")).select("weights", F.array("item").alias("items"))), totals, min_support)
    first = materialized(first, "level")
    if max_len == 1:
        return first
    some = first.select(F.lit(0).cast("long").alias("split_id"), "items").distinct()
    kept = only_frequent(held.select(F.lit(0).cast("long").alias("split_id"), "basket_id", F.col("weights").alias("weight"), "items"), some).withColumnRenamed("weight", "weights").drop("split_id")
    if has_wide(kept, max_len):
        by_split = kept.select("basket_id", "items", F.posexplode("weights").alias("at", "weight")).where("weight > 0")
        named = by_split.withColumn("split_id", F.element_at(F.array(*(F.lit(i).cast("long") for i in ids)), F.col("at") + 1)).select("split_id", "basket_id", "weight", "items")
        return by_bitmaps(named, first, totals, min_support, max_len)
    sets = F.concat(*(combinations(F.col("items"), k) for k in range(2, max_len + 1)))
    return first.unionByName(keep_frequent(counted(kept.select("weights", F.explode(sets).alias("items"))), totals, min_support))


def frequent_itemsets_fpgrowth(lines: DataFrame, min_support: float = 0.02, max_len: int | None = 3) -> DataFrame:
    """The same result by the pattern-growth miner of Spark's ML library (one split); no ``max_len`` means no bound."""
    from pyspark.ml.fpm import FPGrowth

    check_fraction("min_support", min_support)
    held = baskets(lines)
    n = held.count()
    spark = lines.sparkSession
    if not n:
        return spark.createDataFrame([], "split_id long, items array<string>, size int, cnt long, n long, support double")
    import math

    least = max(1, math.ceil(min_support * n - 1e-9))
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(held).freqItemsets
    found = found.where(F.size("items") <= max_len) if max_len else found
    return found.select(F.lit(0).cast("long").alias("split_id"), F.array_sort("items").alias("items"), F.size("items").alias("size"), F.col("freq").alias("cnt"), F.lit(n).cast("long").alias("n"), (F.col("freq").cast("double") / n).alias("support"))


def popularity(lines: DataFrame) -> DataFrame:
    """item, cnt, rank: by baskets, and by name among equals.  As many rows as items."""
    from pyspark.sql import Window

    return item_counts(lines).select("item", "cnt", F.row_number().over(Window.orderBy(F.desc("cnt"), "item")).cast("long").alias("rank"))


def pair_lift_matrix(lines: DataFrame) -> DataFrame:
    """item_a, item_b, lift of every ordered pair of different items; 0 for pairs that no basket holds."""
    rows = with_split(lines)
    counts = rows.groupBy("item").agg(F.count("*").alias("c"))
    n = basket_totals(rows).select("n")
    both = rows.select("basket_id", F.col("item").alias("item_a")).join(rows.select("basket_id", F.col("item").alias("item_b")), "basket_id").where("item_a <> item_b").groupBy("item_a", "item_b").agg(F.count("*").alias("both"))
    grid = counts.select(F.col("item").alias("item_a"), F.col("c").alias("ca")).join(counts.select(F.col("item").alias("item_b"), F.col("c").alias("cb")), F.col("item_a") != F.col("item_b")).join(both, ["item_a", "item_b"], "left").join(n)
    support = lambda c: F.col(c).cast("double") / F.col("n")
    return grid.select("item_a", "item_b", (F.coalesce(support("both"), F.lit(0.0)) / (support("ca") * support("cb"))).alias("lift"))
