"""A seeded generator of order lines with planted bundles; every draw is a hash of its place, so it runs in parallel.

Everything follows from the numbers in ``Shop``: goods and their prices, which goods are bundled, and which of them a
kind of customer favours are rules over numbers, not lists.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import uniform

#: Every bundle begins this many goods after the one before, so bundles of two and three goods never touch.
STEP = 4


@dataclass(frozen=True)
class Shop:
    goods: int = 30
    bundles: int = 6
    bundled: float = 0.4  # share of baskets that hold a bundle
    kinds: int = 5
    favour: float = 4.0  # how much likelier a kind takes the goods it favours
    most_extra: int = 4
    spread: float = 0.25

    def __post_init__(self) -> None:
        if self.goods < STEP * self.bundles or self.bundles < 1 or self.kinds < 1 or not 0 <= self.bundled <= 1:
            raise ValueError("a shop needs four goods for every bundle, a bundle, a kind, and a share between 0 and 1")

    def bundle(self, j: int) -> list[int]:
        """The goods of bundle j: two or three in a row."""
        return [STEP * j + k for k in range(2 + j % 2)]


def good(number: Column | int) -> Column:
    return F.format_string("good_%02d", F.lit(number) if isinstance(number, int) else number)


def planted_pairs(spark: SparkSession, shop: Shop = Shop()) -> DataFrame:
    """item_a < item_b: goods that a bundle brings together."""
    pairs = [p for j in range(shop.bundles) for p in combinations(shop.bundle(j), 2)]
    return spark.createDataFrame(pairs, "a int, b int").select(good(F.col("a")).alias("item_a"), good(F.col("b")).alias("item_b"))


def synthetic_lines(spark: SparkSession, n_baskets: int = 6000, n_customers: int = 420, seed: int = 42, shop: Shop = Shop()) -> DataFrame:
    """basket_id, customer_id, kind, item, amount: one row per basket and item."""
    if n_baskets < 1 or n_customers < 1:
        raise ValueError("at least one basket and one customer are needed")
    draw = lambda *parts: uniform(F.lit(seed), *parts)
    basket, number = F.col("basket_id"), F.col("number")
    baskets = spark.range(n_baskets).withColumnRenamed("id", "basket_id")
    baskets = baskets.withColumn("customer", F.floor(draw(F.lit("who"), basket) * n_customers).cast("int"))
    baskets = baskets.withColumn("kind", F.floor(draw(F.lit("kind"), F.col("customer")) * shop.kinds).cast("int"))
    # the draw's place within the share of baskets with a bundle names the bundle
    place = F.floor(draw(F.lit("bundle"), basket) / shop.bundled * shop.bundles) if shop.bundled else F.lit(shop.bundles)
    baskets = baskets.withColumn("bundle", place.cast("int")).withColumn("extra", (1 + F.floor(draw(F.lit("extra"), basket) * shop.most_extra)).cast("int"))
    within, start = number - STEP * F.col("bundle"), F.col("bundle") < shop.bundles
    in_bundle = start & (within >= 0) & (within < 2 + F.col("bundle") % 2)
    weight = F.when(number % shop.kinds == F.col("kind"), shop.favour).otherwise(1.0)
    wait = -F.log(1 - draw(F.lit("take"), basket, number)) / weight
    offered = baskets.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(shop.goods - 1)))).withColumn("planted", in_bundle).withColumn("wait", wait)
    # goods beside the bundle without replacement: the smallest of exponential waiting times
    taken = offered.groupBy("basket_id", "customer", "kind", "extra").agg(F.collect_list(F.when(F.col("planted"), number)).alias("planted"), F.array_sort(F.collect_list(F.struct("wait", "number"))).alias("order"))
    numbers = F.array_union("planted", F.transform(F.slice("order", 1, F.col("extra")), lambda x: x["number"]))
    lines = taken.select("basket_id", "customer", "kind", F.explode(numbers).alias("number"))
    price = 2.0 + (number * 37) % 50
    normal = F.sqrt(-2 * F.log(1 - draw(F.lit("radius"), basket, number))) * F.cos(2 * math.pi * draw(F.lit("angle"), basket, number))
    amount = F.greatest(F.round(price * F.exp(shop.spread * normal), 2), F.lit(0.01))
    return lines.select("basket_id", F.format_string("customer_%05d", "customer").alias("customer_id"), F.format_string("kind_%d", "kind").alias("kind"), good(number).alias("item"), amount.alias("amount"))
