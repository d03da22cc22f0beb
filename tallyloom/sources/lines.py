"""Order lines (basket_id, customer_id, item, amount), one row per basket and item."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normalise(lines: DataFrame) -> DataFrame:
    """One row per (basket, item) with amounts added up exactly; rows without basket or item are left out."""
    kept = lines.where(F.col("basket_id").isNotNull() & F.col("item").isNotNull())
    exact = F.sum(F.col("amount").cast("decimal(18,4)")).cast("double")
    return kept.groupBy("basket_id", "item").agg(F.min("customer_id").alias("customer_id"), exact.alias("amount")).select("basket_id", "customer_id", "item", "amount")


def from_tpch(spark: SparkSession, sf_dir: str, item: str = "p_brand") -> DataFrame:
    """Orders as baskets and a column of ``part`` as item; amounts are discounted prices, added up in decimals."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lineitem = read("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    joined = lineitem.join(read("part").select("p_partkey", F.col(item).alias("item")), F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_extendedprice").cast("decimal(15,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    lines = joined.where(F.col("item").isNotNull()).groupBy(F.col("l_orderkey").alias("basket_id"), "item").agg(F.sum(price).cast("double").alias("amount"))
    orders = read("orders").select(F.col("o_orderkey").alias("basket_id"), F.col("o_custkey").alias("customer_id"))
    return lines.join(orders, "basket_id").select("basket_id", "customer_id", "item", "amount")


def from_table(rows: DataFrame, basket: str, item: str, customer: str | None = None, amount: str | None = None) -> DataFrame:
    """Any table or file read by Spark, by the names of its columns."""
    pick = lambda c, kind: F.col(c) if c else F.lit(None).cast(kind)
    return normalise(rows.select(F.col(basket).alias("basket_id"), pick(customer, "string").alias("customer_id"), F.col(item).cast("string").alias("item"), F.coalesce(pick(amount, "double").cast("double"), F.lit(0.0)).alias("amount")))


def baskets_from_lists(spark: SparkSession, baskets: Iterable[Iterable[str]]) -> DataFrame:
    """Lines of baskets given as lists, numbered in order."""
    rows = [(i, None, x, 0.0) for i, b in enumerate(baskets) for x in sorted(set(b))]
    return spark.createDataFrame(rows, "basket_id long, customer_id string, item string, amount double")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of its parts: the same on every run and partitioning."""
    return draw(F.lit(1 << 32), *parts) / F.lit(float(1 << 32))


def draw(bound: Column, *parts: Column) -> Column:
    """A whole number below ``bound`` from the md5 of its parts."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), bound.cast("long"))
