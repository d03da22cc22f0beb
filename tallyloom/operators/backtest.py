"""Leave-one-out back-test of rule recommendations against the most popular items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import share
from ..sources.lines import draw
from ..sources.shared import materialized
from .mine import baskets, frequent_itemsets, popularity
from .rules import applicable, ranked_items, rules
from .splits import arrival_split


def holdout_trials(lines: DataFrame, seed: int = 42, min_size: int = 2) -> DataFrame:
    """basket_id, query, held_out: one item of each basket that is large enough, picked by a hash."""
    if min_size < 2:
        raise ValueError("a trial needs baskets of two items at least")
    sized = baskets(lines).where(F.size("items") >= min_size)
    pick = F.element_at("items", (draw(F.size("items"), F.lit(seed), F.col("basket_id")) + 1).cast("int"))
    return sized.withColumn("held_out", pick).select("basket_id", F.array_remove("items", F.col("held_out")).alias("query"), "held_out")


def popular_items(trials: DataFrame, ranking: DataFrame, top_k: int = 5) -> DataFrame:
    """basket_id, predictions: the most popular items that the query lacks.

    A query of m items leaves its answer among the first top_k + m, and the ranking has a row per item, so it goes along as an array.
    """
    order = ranking.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]).alias("order"))
    return trials.join(order).select("basket_id", F.slice(F.filter("order", lambda x: ~F.array_contains("query", x)), 1, max(0, top_k)).alias("predictions"))


def rule_items(trials: DataFrame, found: DataFrame, top_k: int = 5) -> DataFrame:
    """basket_id, predictions by rules; empty where none applies."""
    ranked = ranked_items(applicable(trials.select("basket_id", "query"), found), top_k)
    lists = ranked.groupBy("basket_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda s: s["item"]).alias("predictions"))
    return trials.select("basket_id").join(lists, "basket_id", "left").select("basket_id", F.coalesce("predictions", F.array().cast("array<string>")).alias("predictions"))


def score(trials: DataFrame, predictions: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """k, hit_rate, mrr, coverage, n_trials; an empty list is a miss, and ranks count up to the largest k."""
    ks = tuple(sorted(set(ks)))
    if not ks or ks[0] < 1:
        raise ValueError("every K must be at least 1")
    place = F.array_position(F.slice("predictions", 1, ks[-1]), F.col("held_out"))
    rows = trials.join(predictions, "basket_id").select(place.alias("place"), (F.size("predictions") > 0).alias("any"))
    total = rows.agg(*(F.count_if((F.col("place") > 0) & (F.col("place") <= k)).alias(f"h{k}") for k in ks), *(F.count_if(F.col("place") == r).alias(f"r{r}") for r in range(1, ks[-1] + 1)), F.count_if("any").alias("covered"), F.count("*").alias("n_trials"))
    reciprocal = sum((F.col(f"r{r}") / F.lit(float(r)) for r in range(1, ks[-1] + 1)), F.lit(0.0))
    long = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"h{k}").alias("hits")) for k in ks)))
    out = total.where("n_trials > 0").select(long.alias("x"), reciprocal.alias("rr"), "covered", "n_trials")
    return out.select("x.k", share(F.col("x.hits"), F.col("n_trials")).alias("hit_rate"), share(F.col("rr"), F.col("n_trials")).alias("mrr"), share(F.col("covered"), F.col("n_trials")).alias("coverage"), "n_trials")


def evaluate(lines: DataFrame, min_support: float, min_confidence: float, min_lift: float, fraction: float = 0.7, ks: tuple[int, ...] = (1, 3, 5), seed: int = 42, thin: int = 30, trials: DataFrame | None = None, train: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """recommender, k, hit_rate, mrr, coverage, n_trials of rules and of popularity.

    Trials and the lines to learn from may be given, but only together.  Without any trial the result is an error, or
    empty if not ``strict``.
    """
    if (trials is None) != (train is None):
        raise ValueError("train and trials must be given together")
    if trials is None:
        split = materialized(arrival_split(lines, fraction), "arrivals")
        train = lines.join(split.where("is_train"), "basket_id", "left_semi")
        trials = materialized(holdout_trials(lines.join(split.where("not is_train"), "basket_id", "left_semi"), seed), "trials")
    if strict and not trials.limit(1).count():
        raise ValueError("there are no trials")
    found = materialized(rules(materialized(frequent_itemsets(train, min_support), "itemsets"), min_confidence, min_lift, thin), "rules")
    top = max(ks)
    by_rules = score(trials, rule_items(trials, found, top), ks).withColumn("recommender", F.lit("rules"))
    by_count = score(trials, popular_items(trials, popularity(train), top), ks).withColumn("recommender", F.lit("popularity"))
    return by_rules.unionByName(by_count)


def ratios(metrics: DataFrame) -> DataFrame:
    """k, hit_ratio, mrr_ratio: rules over popularity, 0 where popularity has 0."""
    a = metrics.where("recommender = 'rules'").select("k", F.col("hit_rate").alias("ha"), F.col("mrr").alias("ma"))
    b = metrics.where("recommender = 'popularity'").select("k", F.col("hit_rate").alias("hb"), F.col("mrr").alias("mb"))
    return a.join(b, "k").select("k", F.when(F.col("hb") == 0, 0.0).otherwise(F.try_divide("ha", "hb")).alias("hit_ratio"), F.when(F.col("mb") == 0, 0.0).otherwise(F.try_divide("ma", "mb")).alias("mrr_ratio"))
