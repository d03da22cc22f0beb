"""Association rules from itemsets, and what of them is redundant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import label, proper_masks, subset


#: Buckets of lift for each factor of e.
LIFT_BUCKETS = 2000


def in_order() -> list:
    """Lift, confidence, then the labels: a total order of rules."""
    return [F.desc("lift"), F.desc("confidence"), label("antecedent"), label("consequent")]


def rules(itemsets: DataFrame, min_confidence: float = 0.30, min_lift: float = 1.10, thin_support_count: int = 30) -> DataFrame:
    """Every split of every set of two or more items that is confident and lifted enough, ranked within its split."""
    parts = itemsets.where(F.col("size") >= 2).select("split_id", "items", "cnt", "support", F.explode(proper_masks(F.col("items"))).alias("mask"))
    parts = parts.withColumn("antecedent", subset(F.col("items"), F.col("mask"))).withColumn("consequent", F.array_except("items", "antecedent"))
    known = itemsets.select("split_id", "items", "support")
    a = known.select("split_id", F.col("items").alias("antecedent"), F.col("support").alias("sa"))
    c = known.select("split_id", F.col("items").alias("consequent"), F.col("support").alias("sc"))
    joined = parts.drop("items", "mask").join(a, ["split_id", "antecedent"]).join(c, ["split_id", "consequent"])
    confidence = F.col("support") / F.col("sa")
    out = joined.withColumn("confidence", confidence).withColumn("lift", F.col("confidence") / F.col("sc")).withColumn("leverage", F.col("support") - F.col("sa") * F.col("sc"))
    conviction = F.when(F.col("confidence") >= 1, float("inf")).otherwise((1 - F.col("sc")) / (1 - F.col("confidence")))
    out = out.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)).withColumn("conviction", conviction)
    return ranked(out).select("split_id", "rank", "antecedent", "consequent", "support", F.col("cnt").alias("support_count"), "confidence", "lift", "leverage", "conviction", (F.col("cnt") < thin_support_count).alias("thin_support"))


def ranked(found: DataFrame) -> DataFrame:
    """Adds each rule's rank within its split; rules of about the same lift are a bucket."""
    return placed(found.withColumn("bucket", F.floor(F.log("lift") * LIFT_BUCKETS)), ["split_id"], in_order(), "rank")


def placed(rows: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """Numbers rows from 1 in ``order``, without bringing all of them to one task.

    Rows of a ``bucket``, which falls along the order, are ordered together; buckets only exchange their counts.
    """
    before = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*by, "bucket").agg(F.count("*").alias("c")).withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    within = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy(*order))
    return rows.withColumn("at", within).join(offsets, [*by, "bucket"]).withColumn(name, (F.col("at") + F.col("offset")).cast("long")).drop("at", "offset", "bucket")


def with_closure(itemsets: DataFrame) -> DataFrame:
    """Itemsets with closed and maximal flags.

    In a downward-closed collection a superset of equal count, or any superset, exists only if one with a single item
    more does, so the sets that a larger one covers come from its subsets with one item less.
    """
    covered = None
    sizes = F.explode(F.when(F.col("size") >= 2, F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.array_except(F.col("items"), F.array(F.element_at(F.col("items"), i))))).otherwise(F.array().cast("array<array<string>>")))
    covered = itemsets.select("split_id", "cnt", sizes.alias("items")).groupBy("split_id", "items").agg(F.max("cnt").alias("above"))
    out = itemsets.join(covered, ["split_id", "items"], "left")
    return out.withColumn("closed", F.coalesce(F.col("above") < F.col("cnt"), F.lit(True))).withColumn("maximal", F.col("above").isNull()).drop("above")


def improvements(itemsets: DataFrame, found: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rules with their improvement over the best simpler antecedent, the empty one included, and whether they are redundant.

    Ties go to the smaller and then to the first antecedent.
    """
    key = ["split_id", "antecedent", "consequent"]
    base = found.select(*key, F.array().cast("array<string>").alias("best_antecedent"), (F.col("confidence") / F.col("lift")).alias("best_confidence"))
    parts = found.select(*key, F.explode(proper_masks(F.col("antecedent"))).alias("mask")).withColumn("best_antecedent", subset(F.col("antecedent"), F.col("mask")))
    parts = parts.withColumn("whole", F.array_sort(F.array_union("best_antecedent", "consequent")))
    known = itemsets.select("split_id", "items", "support")
    parts = parts.join(known.select("split_id", F.col("items").alias("best_antecedent"), F.col("support").alias("sa")), ["split_id", "best_antecedent"]).join(known.select("split_id", F.col("items").alias("whole"), F.col("support").alias("sw")), ["split_id", "whole"])
    parts = parts.select(*key, "best_antecedent", (F.col("sw") / F.col("sa")).alias("best_confidence"))
    first = Window.partitionBy(*key).orderBy(F.desc("best_confidence"), F.size("best_antecedent"), "best_antecedent")
    best = base.unionByName(parts).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    out = found.join(best, key).withColumn("improvement", F.col("confidence") - F.col("best_confidence"))
    return out.withColumn("redundant", F.col("improvement") <= tolerance)


def kept_by_improvement(verdicts: DataFrame) -> DataFrame:
    """place and the columns of rules that aren't redundant: the largest improvement first, then by labels."""
    kept = verdicts.where(~F.col("redundant")).withColumn("bucket", F.floor(F.col("improvement") * LIFT_BUCKETS))
    return placed(kept, [], [F.desc("improvement"), label("antecedent"), label("consequent")], "place")


def redundancy_summary(itemsets: DataFrame, verdicts: DataFrame) -> DataFrame:
    flags = with_closure(itemsets).agg(F.count("*").alias("n_itemsets"), F.count_if("closed").alias("n_closed"), F.count_if("maximal").alias("n_maximal"))
    return flags.join(verdicts.agg(F.count("*").alias("n_rules"), F.count_if("redundant").alias("n_redundant"), F.count_if(~F.col("redundant")).alias("n_kept")))


#: An item that more than one in this many of the queries' items is meets its rules in as many parts as ``SALTS``.
HEAVY, SALTS = 256, 16


def rarest_items(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Rules with ``key``: of the antecedent's items the one that the fewest queries hold; rules with an item that none holds go."""
    parts = found.withColumn("key", F.explode("antecedent")).join(seen, "key")
    best = parts.groupBy(*found.columns).agg(F.min(F.struct("seen", "key")).alias("best"), F.count("*").alias("met"))
    return best.where(F.col("met") == F.size("antecedent")).select(*found.columns, F.col("best.key").alias("key"))


def applicable(queries: DataFrame, found: DataFrame, include_thin: bool = False) -> DataFrame:
    """(basket_id, query, rule columns): rules whose antecedent the query holds and whose consequent it doesn't touch.

    A rule of any size meets queries by the rarest item of its antecedent, so a frequent item is a rule's key only if
    all its items are frequent, and queries aren't taken apart into subsets.  Frequent items, of which there are at most
    ``HEAVY``, are salted: their queries are dealt over parts, and their rules go to each of them.
    """
    kept = found if include_thin else found.where(~F.col("thin_support"))
    asked = queries.select("basket_id", "query", F.explode(F.array_distinct("query")).alias("key"))
    seen = asked.groupBy("key").agg(F.count("*").alias("seen"))
    often = F.broadcast(seen.join(seen.agg(F.sum("seen").alias("all"))).where(F.col("seen") * HEAVY > F.col("all")).select("key", F.lit(SALTS).alias("salts")))
    dealt = asked.join(often, "key", "left").withColumn("salt", F.pmod(F.xxhash64("basket_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    keyed = rarest_items(kept, seen).join(often, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    holds = F.size(F.array_except("antecedent", "query")) == 0
    return dealt.join(keyed, ["key", "salt"]).where(holds & ~F.arrays_overlap("consequent", "query")).drop("key", "salt")


def ranked_items(matched: DataFrame, top_k: int = 5) -> DataFrame:
    """basket_id, item, rank: consequents' items in rule order, each once."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    # dealt by basket once, for the items and for their places
    items = matched.select("basket_id", "rank", F.posexplode(F.array_sort("consequent")).alias("pos", "item")).repartition("basket_id")
    first = items.groupBy("basket_id", "item").agg(F.min(F.struct("rank", "pos")).alias("first"))
    place = F.row_number().over(Window.partitionBy("basket_id").orderBy("first"))
    return first.withColumn("place", place).where(F.col("place") <= top_k).select("basket_id", "item", F.col("place").cast("long").alias("place"))


def values(found: DataFrame, prices: DataFrame) -> DataFrame:
    """Rules with the value their consequents are expected to add: gain in probability times mean line values."""
    worth = found.select("rank", F.explode("consequent").alias("item")).join(prices, "item", "left").groupBy("rank").agg(F.sum(F.coalesce(F.col("avg_value"), F.lit(0.0)).cast("decimal(28,10)")).cast("double").alias("worth"))
    gain = F.greatest(F.lit(0.0), F.col("confidence") - F.col("confidence") / F.col("lift"))
    return found.join(worth, "rank").withColumn("value", gain * F.col("worth")).drop("worth")


def recommendations(found: DataFrame, prices: DataFrame, top_n: int = 10, include_thin: bool = False) -> DataFrame:
    """The first rules in order, with their values; none if ``top_n`` is below 1."""
    kept = found if include_thin else found.where(~F.col("thin_support"))
    return values(kept.orderBy("rank").limit(max(0, top_n)), prices)


def next_best(matched: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """The first applicable rule of each basket, with its value if prices are given."""
    best = matched.withColumn("r", F.row_number().over(Window.partitionBy("basket_id").orderBy("rank"))).where("r = 1").drop("r")
    if prices is None:
        return best.withColumn("value", F.lit(0.0))
    priced = values(best.select("rank", "antecedent", "consequent", "confidence", "lift").distinct(), prices).select("rank", "value")
    return best.join(priced, "rank")


def mean_values(lines: DataFrame) -> DataFrame:
    """item, avg_value: mean amount of a line, rounded to six places."""
    return lines.groupBy("item").agg(F.round(F.sum(F.col("amount").cast("decimal(18,4)")).cast("double") / F.count("*"), 6).alias("avg_value"))
