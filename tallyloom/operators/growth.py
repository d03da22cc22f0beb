"""Pattern growth over many splits at once: conditional bases are tables that all splits share.

A basket becomes the path of its frequent items, the most frequent first, and equal paths of a split are one row with the
sum of their weights.  The conditional base of a set (its ``suffix``) holds what stands before the set's first item on the
paths that have the whole set; it is made from the base of the set without that item, and equal prefixes are merged
again.  So a set is counted once, in the base of its items but the most frequent, and only frequent sets get a base.

Bases are rows keyed by (split, suffix, prefix), never a group that one task holds; sums are made before they are
shuffled.  A level's base has at most as many rows as there are pairs of a path and a frequent set of that size on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares that the rows of one suffix are dealt over where they look up what is frequent with it.
SHARES = 8


def paths(every: DataFrame, frequent: DataFrame, looked_up: int) -> DataFrame:
    """split_id, suffix (empty), prefix, cnt: baskets as paths, equal ones merged.

    Up to ``looked_up`` frequent items go along with every basket; more are met by a join.
    """
    order = frequent.select("split_id", F.struct((-F.col("cnt")).alias("low"), F.element_at("items", 1).alias("item")).alias("x"))
    names = lambda xs: F.transform(F.array_sort(xs), lambda x: x["item"])
    if order.limit(looked_up + 1).count() <= looked_up:
        lists = order.groupBy("split_id").agg(names(F.collect_list("x")).alias("known"))
        found = every.join(F.broadcast(lists), "split_id").select("split_id", "weight", F.array_intersect("known", "items").alias("prefix"))
    else:
        rows = every.select("split_id", "basket_id", "weight", F.explode("items").alias("item"))
        rows = rows.join(order.withColumn("item", F.col("x.item")), ["split_id", "item"])
        found = rows.groupBy("split_id", "basket_id").agg(F.first("weight").alias("weight"), names(F.collect_list("x")).alias("prefix"))
    merged = found.where(F.size("prefix") > 0).groupBy("split_id", "prefix").agg(F.sum("weight").cast("long").alias("cnt"))
    return merged.select("split_id", F.array().cast("array<string>").alias("suffix"), "prefix", "cnt")


def only_known(bases: DataFrame, level: DataFrame) -> DataFrame:
    """Prefixes without the items that are not frequent together with their suffix; ``level`` has the sets that are."""
    suffix = F.slice("items", F.lit(2), F.size("items") - 1).alias("suffix")
    known = level.groupBy("split_id", suffix).agg(F.collect_list(F.element_at("items", 1)).alias("known"))
    known = known.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    dealt = bases.withColumn("share", F.pmod(F.xxhash64("prefix"), F.lit(SHARES)).cast("int"))
    return dealt.join(known, ["split_id", "suffix", "share"]).select("split_id", "suffix", F.array_intersect("prefix", "known").alias("prefix"), "cnt")


def longer(bases: DataFrame) -> DataFrame:
    """The bases of all sets of a suffix and an item of its prefixes, equal prefixes merged; empty ones are left out."""
    rows = bases.select("split_id", "suffix", "prefix", "cnt", F.posexplode("prefix").alias("at", "item")).where("at > 0")
    rows = rows.select("split_id", F.concat(F.array("item"), "suffix").alias("suffix"), F.slice("prefix", F.lit(1), F.col("at")).alias("prefix"), "cnt")
    return rows.groupBy("split_id", "suffix", "prefix").agg(F.sum("cnt").cast("long").alias("cnt"))


def counts(bases: DataFrame) -> DataFrame:
    """split_id, items (in the order of paths), cnt of every suffix with every item before it."""
    rows = bases.select("split_id", "suffix", F.explode("prefix").alias("item"), "cnt")
    summed = rows.groupBy("split_id", "suffix", "item").agg(F.sum("cnt").cast("long").alias("cnt"))
    return summed.select("split_id", F.concat(F.array("item"), "suffix").alias("items"), "cnt")
