"""Queries by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import label
from ..operators import backtest, graph, mine, rules, segment, splits
from ..sources import from_tpch, planted_pairs, synthetic_lines
from ..sources.shared import materialized
from . import readouts
from .settings import CLUSTERS, FOLDS, SEED, T1, T2, T3, T4, TOP_K, TOP_N, TRAIN, WINDOWS, Setting

Query = Callable[[SparkSession, str], DataFrame]


def lines_of(spark: SparkSession, sf_dir: str, s: Setting = T1) -> DataFrame:
    return from_tpch(spark, sf_dir, s.item)


def held_lines(spark: SparkSession, sf_dir: str, s: Setting = T1, *columns: str) -> DataFrame:
    """The given columns of the lines as a table, for queries that read them more than once."""
    return materialized(lines_of(spark, sf_dir, s).select(*(columns or ("basket_id", "item"))), "lines")


def sets_of(spark: SparkSession, sf_dir: str, s: Setting = T1, lines: DataFrame | None = None) -> DataFrame:
    return mine.frequent_itemsets(lines_of(spark, sf_dir, s) if lines is None else lines, s.min_support)


def held_sets(spark: SparkSession, sf_dir: str, s: Setting = T1, lines: DataFrame | None = None) -> DataFrame:
    """The itemsets as a table, which everything in a query starts from."""
    return materialized(sets_of(spark, sf_dir, s, lines), "itemsets")


def rules_from(sets: DataFrame, s: Setting) -> DataFrame:
    return rules.rules(sets, s.min_confidence, s.min_lift, s.thin)


def rules_of(spark: SparkSession, sf_dir: str, s: Setting = T1, lines: DataFrame | None = None) -> DataFrame:
    return rules_from(held_sets(spark, sf_dir, s, lines), s)


def shown_sets(sets: DataFrame, *more: str) -> DataFrame:
    return sets.select(*more, label("items").alias("itemset"), F.col("size").cast("long").alias("size"), "cnt", "support")


def labelled(found: DataFrame, *columns) -> DataFrame:
    return found.select(*(label(c).alias(c) if isinstance(c, str) and c in ("antecedent", "consequent", "best_antecedent", "items", "query") else c for c in columns))


RULE = ("rank", "antecedent", "consequent", "support", "support_count", "confidence", "lift", "leverage", "conviction", "thin_support")


def shown_rules(found: DataFrame) -> DataFrame:
    return labelled(found, *RULE)


def sets_and_verdicts(spark: SparkSession, sf_dir: str, s: Setting) -> tuple[DataFrame, DataFrame]:
    sets = held_sets(spark, sf_dir, s)
    return sets, rules.improvements(sets, materialized(rules_from(sets, s), "rules"))


def verdicts_of(spark: SparkSession, sf_dir: str, s: Setting) -> DataFrame:
    return sets_and_verdicts(spark, sf_dir, s)[1]


def shown_verdicts(v: DataFrame) -> DataFrame:
    return labelled(v, "rank", "antecedent", "consequent", "best_antecedent", "best_confidence", "improvement", "redundant")


def matched(spark: SparkSession, sf_dir: str, s: Setting = T3) -> DataFrame:
    lines = held_lines(spark, sf_dir, s)
    queries = materialized(mine.baskets(lines).withColumnRenamed("items", "query"), "queries")
    return rules.applicable(queries, rules_of(spark, sf_dir, s, lines))


def prices_of(spark: SparkSession, sf_dir: str, s: Setting) -> DataFrame:
    return rules.mean_values(lines_of(spark, sf_dir, s))


def split_rules(spark: SparkSession, sf_dir: str, method: str = "auto") -> DataFrame:
    lines = held_lines(spark, sf_dir)
    found = splits.rules_by_split(lines, splits.time_windows(lines, WINDOWS), T1.min_support, T1.min_confidence, T1.min_lift, ids=list(range(WINDOWS)), method=method)
    return labelled(found, "split_id", "antecedent", "consequent", "support_count", "confidence", "lift")


def fold_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The itemsets of every resample, by pattern growth over all of them together."""
    lines = held_lines(spark, sf_dir)
    drawn = lines.join(splits.bootstrap(lines, FOLDS, SEED), "basket_id")
    return shown_sets(mine.frequent_itemsets(drawn, T1.min_support, method="growth"), "split_id")


def stability_of(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    """How steady the rules of all baskets are; splits and the whole are counted in one pass."""
    given = lambda lines: lines.select("basket_id", (F.col("basket_id") % 3 * 10).alias("split_id")).distinct()
    lines = held_lines(spark, sf_dir)
    return splits.rule_stability(lines, None, T1.min_support, T1.min_confidence, T1.min_lift, how, WINDOWS if how == "time_window" else FOLDS, TOP_N, splits=given(lines) if how == "given" else None, seed=SEED)


def shown_stability(found: DataFrame) -> DataFrame:
    six = lambda c: F.round(c, 6).alias(c)
    return found.select("rank", label("antecedent").alias("antecedent"), label("consequent").alias("consequent"), six("reference_lift"), "reference_count", "n_present", six("lift_mean"), six("lift_std"), six("lift_min"), six("lift_max"), "stability_score", "stable")


def trials_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = held_lines(spark, sf_dir)
    split = materialized(splits.arrival_split(lines, TRAIN), "arrivals")
    train = lines.join(split.where("is_train"), "basket_id", "left_semi")
    return backtest.holdout_trials(lines.join(split.where("not is_train"), "basket_id", "left_semi"), SEED), train


def metrics_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.evaluate(held_lines(spark, sf_dir), T1.min_support, T1.min_confidence, T1.min_lift, TRAIN, seed=SEED)


def popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials, train = trials_of(spark, sf_dir)
    return backtest.popular_items(trials, mine.popularity(train), TOP_K).select("basket_id", F.array_join("predictions", " > ").alias("predictions"))


def text_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of baskets whose ids are text, in the order of text."""
    return splits.positions(lines_of(spark, sf_dir).select(F.concat(F.lit("order "), F.col("basket_id").cast("string")).alias("basket_id"), "item"))


def item_names(spark: SparkSession, sf_dir: str, s: Setting) -> list[str]:
    """The items there are; a vector has an entry for each."""
    return [r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select(s.item).where(F.col(s.item).isNotNull()).distinct().orderBy(s.item).collect()]


def first_customers(points: DataFrame) -> list[list[float]]:
    return [list(r["x"]) for r in points.orderBy("customer_id").limit(CLUSTERS).collect()]


def assign_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = segment.features(lines_of(spark, sf_dir, T3), item_names(spark, sf_dir, T3))
    return segment.assign(points, first_customers(points)).select("customer_id", F.col("cluster").cast("long").alias("cluster"), F.round("d2", 6).alias("d2"))


def lloyd_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = item_names(spark, sf_dir, T3)
    points = segment.features(lines_of(spark, sf_dir, T3), names)
    centres, _ = segment.lloyd(points, first_customers(points), max_iter=3, tol=-1.0)
    rows = [(i, item, round(v, 6)) for i, c in enumerate(centres) for item, v in zip(names, c)]
    return spark.createDataFrame(rows, "cluster long, item string, share double")


def segments(spark: SparkSession, sf_dir: str, part: int, fixed: bool = False) -> DataFrame:
    lines, names, centres = lines_of(spark, sf_dir, T3), item_names(spark, sf_dir, T3), None
    if fixed:
        lines = materialized(lines.select("customer_id", "item", "amount"), "lines")
        points = segment.features(lines, names)
        centres, _ = segment.lloyd(points, first_customers(points), max_iter=3, tol=-1.0)
    return segment.segment_customers(lines, names, CLUSTERS, centres=centres)[part]


def fixed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.array_join(F.transform("top_items", lambda s: F.format_string("%s %.3f", s["item"], s["share"])), ", ")
    return segments(spark, sf_dir, 1, True).select(F.col("segment").cast("long").alias("segment"), "n", F.round("share", 9).alias("share"), F.round("mean_total", 4).alias("mean_total"), top.alias("top_items"))


def matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivoted matrix back in rows, without the zeros it was filled with."""
    names = item_names(spark, sf_dir, T3)
    wide = segment.spend_matrix(lines_of(spark, sf_dir, T3), names)
    return wide.unpivot("customer_id", names, "item", "amount").where("amount <> 0")


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(held_sets(spark, sf_dir), 1.0)


def network_of(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges and communities, both tables."""
    sets = held_sets(spark, sf_dir, lines=lines)
    links = materialized(graph.edges(sets, 1.0), "edges")
    return links, materialized(graph.communities(sets, links), "communities")


def shown_network(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(*network_of(spark, sf_dir))


def lift_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = held_lines(spark, sf_dir)
    return readouts.lift_table(lines, network_of(spark, sf_dir, lines)[1])


def fixed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = held_sets(spark, sf_dir)
    number = F.regexp_extract("item", "[0-9]+", 0).cast("long") % 3
    fixed = sets.where("size = 1").select(F.element_at("items", 1).alias("item")).select("item", number.alias("community_id"))
    return graph.partition_quality(graph.edges(sets, 1.0), fixed).select(F.round("q", 9).alias("q"))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["basket_lines"] = lambda s, d: lines_of(s, d)
    q["baskets_as_sets"] = lambda s, d: mine.baskets(lines_of(s, d)).select("basket_id", label("items").alias("items"), F.size("items").cast("long").alias("size"))
    q["basket_size_histogram"] = lambda s, d: mine.baskets(lines_of(s, d)).groupBy(F.size("items").cast("long").alias("size")).agg(F.count("*").alias("n"))
    q["item_support"] = lambda s, d: mine.frequent_itemsets(lines_of(s, d), T1.min_support, 1).select(F.element_at("items", 1).alias("item"), "cnt", "support")
    q["popularity_ranking"] = lambda s, d: mine.popularity(lines_of(s, d))
    for k in (1, 2, 3):
        q[f"frequent_itemsets_k{k}"] = lambda s, d, k=k: shown_sets(mine.frequent_itemsets(lines_of(s, d), T1.min_support, k).where(F.col("size") == k))
    q["frequent_itemsets_all"] = lambda s, d: shown_sets(sets_of(s, d))
    q["frequent_itemsets_join"] = lambda s, d: shown_sets(mine.frequent_itemsets(lines_of(s, d), T1.min_support, 3, "join"))
    q["frequent_itemsets_vertical"] = lambda s, d: shown_sets(mine.frequent_itemsets(lines_of(s, d), T1.min_support, 3, "vertical"))
    q["frequent_itemsets_growth"] = lambda s, d: shown_sets(mine.frequent_itemsets(lines_of(s, d), T1.min_support, 3, "growth"))
    q["frequent_itemsets_fpgrowth"] = lambda s, d: shown_sets(mine.frequent_itemsets_fpgrowth(lines_of(s, d), T1.min_support))
    q["candidate_triples_pruned"] = lambda s, d: mine.candidates(held_sets(s, d), 3).select(label("items").alias("itemset"))
    q["rules_all"] = lambda s, d: shown_rules(rules_of(s, d, T3))
    q["rules_filtered"] = lambda s, d: shown_rules(rules_of(s, d))
    q["rules_ranked_top20"] = lambda s, d: shown_rules(rules_of(s, d).where("rank <= 20"))
    q["rules_multi_consequent"] = lambda s, d: shown_rules(rules_of(s, d, T2).where(F.size("consequent") > 1))
    q["thin_rule_flags"] = lambda s, d: shown_rules(rules_of(s, d, T4))
    q["rule_counts_by_size"] = lambda s, d: rules_of(s, d).groupBy(F.size("antecedent").cast("long").alias("n_antecedent"), F.size("consequent").cast("long").alias("n_consequent")).agg(F.count("*").alias("n"))
    q["closed_itemsets"] = lambda s, d: rules.with_closure(held_sets(s, d, T4)).where("closed").select(label("items").alias("itemset"), "cnt")
    q["maximal_itemsets"] = lambda s, d: rules.with_closure(held_sets(s, d, T4)).where("maximal").select(label("items").alias("itemset"), "cnt")
    q["rule_improvement"] = lambda s, d: shown_verdicts(verdicts_of(s, d, T3))
    q["redundancy_verdicts"] = lambda s, d: shown_verdicts(verdicts_of(s, d, T4))
    q["redundancy_summary"] = lambda s, d: rules.redundancy_summary(*sets_and_verdicts(s, d, T4))
    q["rules_kept_by_improvement"] = lambda s, d: labelled(rules.kept_by_improvement(verdicts_of(s, d, T4)), "place", "antecedent", "consequent", "improvement")
    q["recommendations_top10"] = lambda s, d: labelled(rules.recommendations(rules_of(s, d), prices_of(s, d, T1), 10), "rank", "antecedent", "consequent", "lift", "confidence", F.round("value", 6).alias("value"))
    q["incremental_value"] = lambda s, d: labelled(rules.values(rules_of(s, d, T3), prices_of(s, d, T3)), "rank", "antecedent", "consequent", F.round("value", 6).alias("value"))
    q["applicable_rules_for_baskets"] = lambda s, d: labelled(matched(s, d), "basket_id", "rank", "antecedent", "consequent")
    q["ranked_cross_sell"] = lambda s, d: rules.ranked_items(matched(s, d), TOP_K)
    q["next_best_product"] = lambda s, d: labelled(rules.next_best(matched(s, d), prices_of(s, d, T3)), "basket_id", "antecedent", "consequent", "lift", F.round("value", 6).alias("value"))
    q["arrival_position"] = lambda s, d: splits.positions(lines_of(s, d))
    q["arrival_position_text"] = text_positions
    q["time_windows"] = lambda s, d: splits.time_windows(lines_of(s, d), WINDOWS)
    q["train_test_split"] = lambda s, d: splits.arrival_split(lines_of(s, d), TRAIN)
    q["split_rules_time_window"] = lambda s, d: split_rules(s, d)
    q["split_rules_growth"] = lambda s, d: split_rules(s, d, "growth")
    q["fold_itemsets_growth"] = fold_sets
    q["rule_stability_time_window"] = lambda s, d: shown_stability(stability_of(s, d, "time_window"))
    q["stability_summary"] = lambda s, d: stability_of(s, d, "time_window").agg(F.count("*").alias("n_rules"), F.count_if("stable").alias("n_stable"), F.min("n_present").alias("least_present"))
    q["bootstrap_draws"] = lambda s, d: splits.bootstrap_draws(splits.positions(lines_of(s, d)), FOLDS, SEED).groupBy("split_id", "pos").agg(F.count("*").alias("weight"))
    q["rule_stability_given_splits"] = lambda s, d: shown_stability(stability_of(s, d, "given"))
    q["rule_stability_bootstrap"] = lambda s, d: shown_stability(stability_of(s, d, "bootstrap"))
    q["holdout_trials"] = lambda s, d: labelled(trials_of(s, d)[0], "basket_id", "query", "held_out")
    q["popularity_predictions"] = popular
    q["backtest_hit_rates"] = lambda s, d: metrics_of(s, d).select("recommender", "k", F.round("hit_rate", 9).alias("hit_rate"), "n_trials")
    q["backtest_mrr_coverage"] = lambda s, d: metrics_of(s, d).select("recommender", F.round("mrr", 9).alias("mrr"), F.round("coverage", 9).alias("coverage"), "n_trials").distinct()
    q["backtest_ratio"] = lambda s, d: backtest.ratios(metrics_of(s, d)).select("k", F.round("hit_ratio", 6).alias("hit_ratio"), F.round("mrr_ratio", 6).alias("mrr_ratio"))
    q["spend_matrix"] = matrix_long
    q["spend_shares"] = lambda s, d: segment.shares(lines_of(s, d))
    q["customer_totals"] = lambda s, d: segment.totals(lines_of(s, d))
    q["kmeans_assign_step"] = assign_step
    q["kmeans_lloyd_fixed"] = lloyd_fixed
    q["kmeans_segments"] = lambda s, d: segments(s, d, 0)
    q["segment_profiles"] = lambda s, d: segments(s, d, 1)
    q["segments_from_fixed_starts"] = lambda s, d: segments(s, d, 0, True).select("customer_id", F.col("segment").cast("long").alias("segment"))
    q["segment_profiles_from_fixed_starts"] = fixed_profiles
    q["affinity_edges"] = edges_of
    q["node_strength"] = lambda s, d: graph.strengths(edges_of(s, d))
    q["modularity_fixed_partition"] = fixed_quality
    q["affinity_communities"] = shown_network(lambda links, members: members)
    q["community_grouping"] = shown_network(lambda links, members: graph.grouping(members))
    q["isolated_items"] = shown_network(lambda links, members: graph.isolated(members))
    q["network_backbone"] = lambda s, d: graph.backbone(materialized(edges_of(s, d), "edges"), TOP_N, TOP_K).select("item_a", "item_b", "lift", "weight")
    q["community_stats"] = shown_network(graph.community_stats)
    q["bridges"] = shown_network(lambda links, members: graph.classified(links, members).where("kind = 'bridge'"))
    q["pair_lift_matrix"] = lambda s, d: mine.pair_lift_matrix(lines_of(s, d))
    q["readout_itemsets"] = lambda s, d: readouts.itemset_table(sets_of(s, d, T4))
    q["readout_stability"] = lambda s, d: readouts.stability_table(stability_of(s, d, "time_window"))
    q["readout_redundancy"] = lambda s, d: readouts.redundancy_table(*sets_and_verdicts(s, d, T4))
    q["readout_evaluation"] = lambda s, d: readouts.evaluation_table(metrics_of(s, d), (1, 3, 5))
    q["readout_redundancy_narrative"] = lambda s, d: readouts.redundancy_narrative(*sets_and_verdicts(s, d, T4))
    q["readout_stability_narrative"] = lambda s, d: readouts.stability_narrative(stability_of(s, d, "time_window"), WINDOWS)
    q["readout_evaluation_narrative"] = lambda s, d: readouts.evaluation_narrative(metrics_of(s, d), (1, 3, 5))
    q["readout_network_narrative"] = shown_network(readouts.network_narrative)
    q["readout_edges"] = shown_network(readouts.edge_table)
    q["readout_lift"] = lift_readout
    q["planted_pairs"] = lambda s, d: planted_pairs(s)
    q["synthetic_transactions"] = lambda s, d: synthetic_lines(s)
    return q
