"""Read-outs of a whole analysis: every table by name, narratives, small charts, and how they are written.

Tables stay DataFrames up to Spark's writers, so their rows never pass through the driver.  Charts draw the head of a
table, of at most ``Plan.top_n`` rows, or the heaviest ``LINKS`` edges of each of the ``Plan.top_n`` strongest items.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import label, share
from ..operators import backtest, graph, mine, rules, segment, splits


#: Edges of an item that the network chart draws: its heaviest ones.
LINKS = 5


@dataclass(frozen=True)
class Plan:
    """What an analysis is run with."""

    min_support: float = 0.02
    min_confidence: float = 0.30
    min_lift: float = 1.10
    thin: int = 30
    windows: int = 4
    train: float = 0.7
    ks: tuple[int, ...] = (1, 3, 5)
    top_n: int = 20
    clusters: int = 3
    restarts: int = 8
    max_iter: int = 200
    seed: int = 42


def four(*names: str) -> list[Column]:
    return [F.round(n, 4).alias(n) for n in names]


def sides() -> list[Column]:
    return [label("antecedent").alias("antecedent"), label("consequent").alias("consequent")]


def rule_table(found: DataFrame) -> DataFrame:
    return found.select("rank", *sides(), *four("support"), "support_count", *four("confidence", "lift", "leverage", "conviction"), "thin_support")


def itemset_table(sets: DataFrame) -> DataFrame:
    return sets.select(label("items").alias("itemset"), F.col("size").cast("long").alias("size"), F.col("cnt").alias("support_count"), *four("support"))


def redundancy_table(sets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts with the best simpler antecedent by name, and whether the rule's whole itemset is closed or maximal."""
    flags = rules.with_closure(sets).select("split_id", F.col("items").alias("whole"), "closed", "maximal")
    best = F.when(F.size("best_antecedent") == 0, "baseline").otherwise(label("best_antecedent"))
    whole = verdicts.withColumn("whole", F.array_sort(F.concat("antecedent", "consequent"))).join(flags, ["split_id", "whole"])
    verdict = F.when(F.col("redundant"), "redundant").otherwise("kept")
    return whole.select("rank", *sides(), best.alias("best_simpler"), *four("confidence", "best_confidence", "improvement", "lift"), "support_count", verdict.alias("verdict"), "closed", "maximal")


def stability_table(found: DataFrame) -> DataFrame:
    return found.select("rank", *sides(), *four("reference_lift", "reference_confidence"), "reference_count", "n_splits", "n_present", *four("stability_score", "lift_mean", "lift_std", "lift_cv", "lift_min", "lift_max"), "stable")


def evaluation_table(metrics: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row for rules, one for popularity and one for their ratio, with a column of hits for each K."""
    hits = [F.max(F.when(F.col("k") == k, F.col("hit_rate"))).alias(f"hit_at_{k}") for k in sorted(set(ks))]
    wide = metrics.groupBy("recommender").agg(*hits, F.max("mrr").alias("mrr"), F.max("coverage").alias("coverage"), F.max("n_trials").alias("n_trials"))
    names = [c for c in wide.columns if c not in ("recommender", "n_trials")]
    of = lambda who, c: F.max(F.when(F.col("recommender") == who, F.col(c)))
    ratio = wide.agg(*(share(of("rules", c), of("popularity", c)).alias(c) for c in names), F.max("n_trials").alias("n_trials"))
    return wide.unionByName(ratio.withColumn("recommender", F.lit("ratio"))).select("recommender", *four(*names), "n_trials")


def edge_table(links: DataFrame, membership: DataFrame) -> DataFrame:
    return graph.classified(links, membership).select("item_a", "item_b", *four("support"), "support_count", *four("lift", "leverage", "weight"), "community_a", "community_b", "kind")


def community_table(links: DataFrame, membership: DataFrame) -> DataFrame:
    found = graph.community_stats(links, membership)
    return found.select("community_id", label("members").alias("members"), "n", "n_edges", *four("mean_lift", "max_lift"), "top_pair")


def lift_table(lines: DataFrame, membership: DataFrame) -> DataFrame:
    """The lift matrix with the places of its axes: by community, then by name.  Infrequent items have no community and no place."""
    places = graph.numbered(membership).select("item", "place")
    lifted = mine.pair_lift_matrix(lines)
    return lifted.join(places.toDF("item_a", "place_a"), "item_a", "left").join(places.toDF("item_b", "place_b"), "item_b", "left").select("place_a", "place_b", "item_a", "item_b", *four("lift"))


def redundancy_narrative(sets: DataFrame, verdicts: DataFrame) -> DataFrame:
    text = F.format_string("%d of %d rules add nothing to a simpler one and %d stay. Of %d frequent itemsets %d are closed and %d maximal.", "n_redundant", "n_rules", "n_kept", "n_itemsets", "n_closed", "n_maximal")
    return rules.redundancy_summary(sets, verdicts).select(F.lit("redundancy").alias("topic"), text.alias("text"))


def stability_narrative(found: DataFrame, n_splits: int) -> DataFrame:
    text = F.format_string(f"%d of %d leading rules hold up across {n_splits} splits; the least steady one shows in %d.", F.count_if("stable"), F.count("*"), F.coalesce(F.min("n_present"), F.lit(0).cast("long")))
    return found.agg(text.alias("text")).select(F.lit("stability").alias("topic"), "text")


def evaluation_narrative(metrics: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    top = max(ks)
    rate = lambda who: F.coalesce(F.max(F.when((F.col("recommender") == who) & (F.col("k") == top), 100 * F.col("hit_rate"))), F.lit(0.0))
    text = F.format_string(f"Of %d held-out items rules name %.1f%% among {top} suggestions, and the most popular items %.1f%%.", F.coalesce(F.max("n_trials"), F.lit(0).cast("long")), rate("rules"), rate("popularity"))
    return metrics.agg(text.alias("text")).select(F.lit("evaluation").alias("topic"), "text")


def network_narrative(links: DataFrame, membership: DataFrame) -> DataFrame:
    kinds = graph.classified(links, membership).agg(F.count("*").alias("e"), F.count_if(F.col("kind") == "bridge").alias("b"))
    text = F.format_string("%d pairs of items attract each other. They make %d communities with %d bridges between; %d items stand alone.", "e", "n_communities", "b", "n_isolated")
    return kinds.join(graph.grouping(membership)).select(F.lit("network").alias("topic"), text.alias("text"))


def tables(lines: DataFrame, plan: Plan = Plan(), held: list[DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every read-out by name.  What many of them start from is kept between jobs and added to ``held``, to be let go of later."""

    def keep(df: DataFrame) -> DataFrame:
        if held is not None:
            held.append(df)
        return df.persist()

    lines = keep(lines)
    items = [r["item"] for r in lines.select("item").where(F.col("item").isNotNull()).distinct().orderBy("item").collect()]
    sets = keep(mine.frequent_itemsets(lines, plan.min_support))
    found = keep(rules.rules(sets, plan.min_confidence, plan.min_lift, plan.thin))
    verdicts = keep(rules.improvements(sets, found))
    steady = keep(splits.rule_stability(lines, found, plan.min_support, plan.min_confidence, plan.min_lift, n_splits=plan.windows, top_n=plan.top_n))
    metrics = keep(backtest.evaluate(lines, plan.min_support, plan.min_confidence, plan.min_lift, plan.train, plan.ks, plan.seed, plan.thin, strict=False))
    links = keep(graph.edges(sets, plan.min_lift))
    membership = keep(graph.communities(sets, links))
    out = {
        "rules": rule_table(found), "itemsets": itemset_table(sets), "redundancy": redundancy_table(sets, verdicts),
        "recommendations": rules.recommendations(found, rules.mean_values(lines), plan.top_n).select("rank", *sides(), *four("confidence", "lift", "value")),
        "stability": stability_table(steady), "evaluation": evaluation_table(metrics, plan.ks),
        "communities": community_table(links, membership), "edges": edge_table(links, membership), "lift": lift_table(lines, membership),
    }
    if lines.where(F.col("customer_id").isNotNull()).select("customer_id").distinct().limit(plan.clusters).count() == plan.clusters:
        assigned, profiles, _ = segment.segment_customers(lines, items, plan.clusters, plan.seed, n_init=plan.restarts, max_iter=plan.max_iter)
        top = F.array_join(F.transform("top_items", lambda s: F.format_string("%s %.1f%%", s["item"], 100 * s["share"])), ", ")
        out["segments"] = profiles.select("segment", "n", *four("share", "mean_total"), top.alias("top_items"))
        out["customers"] = assigned.join(segment.totals(lines), "customer_id").select("customer_id", "segment", *four("total"))
    told = [redundancy_narrative(sets, verdicts), stability_narrative(steady, plan.windows), evaluation_narrative(metrics, plan.ks), network_narrative(links, membership)]
    out["narrative"] = told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])
    return out


#: The order of rows of each table in its file.
ORDER = {
    "rules": ["rank"], "itemsets": [F.desc, "support_count", "itemset"], "redundancy": ["rank"], "recommendations": ["rank"], "stability": ["rank"], "evaluation": ["recommender"],
    "communities": ["community_id"], "edges": [F.desc, "lift", "item_a", "item_b"], "lift": ["place_a", "place_b"], "segments": ["segment"], "customers": ["customer_id"], "narrative": ["topic"],
}


def in_order(name: str, table: DataFrame) -> DataFrame:
    first, *rest = ORDER[name]
    return table.orderBy(*([F.desc(rest[0]), *rest[1:]] if callable(first) else [first, *rest]))


def as_text(table: DataFrame) -> DataFrame:
    """Flags as yes and no and an endless conviction as inf; all else as Spark writes it."""
    kinds = dict(table.dtypes)
    said = {"boolean": lambda c: F.when(F.col(c), "yes").otherwise("no"), "double": lambda c: F.when(F.col(c) == float("inf"), "inf").otherwise(F.col(c).cast("string"))}
    return table.select(*(said[kinds[c]](c).alias(c) if kinds[c] in said else c for c in table.columns))


def bar_chart(title: str, bars: list[tuple[str, float, bool]]) -> str:
    """Horizontal bars (name, value, strong) as SVG; weak ones are pale."""
    top = max([v for _, v, _ in bars if math.isfinite(v)] + [1e-9])
    parts = [f'<text x="8" y="20" font-size="14">{escape(title)}</text>']
    for i, (name, value, strong) in enumerate(bars):
        y, wide = 34 + 20 * i, 300 * min(1.0, max(0.0, value / top))
        parts.append(f'<text x="8" y="{y + 12}">{escape(name[:46])}</text><rect x="330" y="{y}" width="{wide:.1f}" height="15" fill="{"#2b6f77" if strong else "#c9d6d5"}"/><text x="{336 + wide:.1f}" y="{y + 12}">{value:.3f}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="700" height="{44 + 20 * len(bars)}" font-family="sans-serif" font-size="11">{"".join(parts)}</svg>'


def network_chart(title: str, nodes: list[tuple[str, int]], links: list[tuple[str, str, float, bool]]) -> str:
    """Items on a circle, by community, with their edges (a, b, weight, bridge) as SVG."""
    angle = {item: 2 * math.pi * i / max(1, len(nodes)) for i, (item, _) in enumerate(sorted(nodes, key=lambda n: (n[1], n[0])))}
    at = {item: (320 + 220 * math.cos(a), 320 + 220 * math.sin(a)) for item, a in angle.items()}
    top = max([w for *_, w, _ in links] + [1e-9])
    parts = [f'<text x="8" y="20" font-size="14">{escape(title)}</text>']
    for a, b, w, bridge in links:
        parts.append(f'<line x1="{at[a][0]:.1f}" y1="{at[a][1]:.1f}" x2="{at[b][0]:.1f}" y2="{at[b][1]:.1f}" stroke="#58707a" stroke-width="{0.5 + 4 * w / top:.1f}"{" stroke-dasharray='4 3'" if bridge else ""}/>')
    for item, community in nodes:
        x, y = at[item]
        parts.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="8" fill="hsl({community * 137 % 360} 45% 45%)"/><text x="{x + 10:.1f}" y="{y + 4:.1f}">{escape(item)} ({community})</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="700" height="640" font-family="sans-serif" font-size="11">{"".join(parts)}</svg>'


def charts(found: dict[str, DataFrame], plan: Plan = Plan()) -> dict[str, str]:
    """Small drawings of the heads of tables."""
    head = lambda name, n=plan.top_n: in_order(name, found[name]).limit(n).collect()
    rule = lambda r: f"{r['antecedent']} -> {r['consequent']}"
    drawn = graph.backbone(found["edges"], plan.top_n, LINKS).orderBy("item_a", "item_b").collect()
    ends = {(r[f"item_{s}"], r[f"community_{s}"]) for r in drawn for s in "ab"}
    links = [(r["item_a"], r["item_b"], r["weight"], r["kind"] == "bridge") for r in drawn]
    return {
        "redundancy": bar_chart("Gain in confidence over the best simpler rule", [(rule(r), r["improvement"], r["verdict"] == "kept") for r in head("redundancy")]),
        "stability": bar_chart("Share of splits that show the rule", [(rule(r), r["stability_score"], r["stable"]) for r in head("stability")]),
        "evaluation": bar_chart("Hit rates, rules and popularity", [(f"{r['recommender']} at {k}", r[f"hit_at_{k}"], r["recommender"] == "rules") for k in sorted(set(plan.ks)) for r in head("evaluation") if r["recommender"] != "ratio" and r[f"hit_at_{k}"] is not None]),
        "network": network_chart("Items that attract each other", sorted(ends), links),
    }


def write(lines: DataFrame, out: str, plan: Plan = Plan(), mode: str = "error") -> dict[str, int]:
    """Writes tables as CSV and charts as text under ``out``, any path Spark can write, and returns rows by table.

    Raises RuntimeError if rules or itemsets came out empty, for then the thresholds leave nothing to report.
    """
    spark, rows, held = lines.sparkSession, {}, []
    try:
        found = tables(lines, plan, held)
        for name, table in found.items():
            as_text(in_order(name, table)).write.mode(mode).csv(f"{out}/{name}", header=True)
            rows[name] = spark.read.csv(f"{out}/{name}", header=True).count()
            if not rows[name] and name in ("itemsets", "rules"):
                raise RuntimeError(f"nothing to report: {name}")
        for name, drawing in charts(found, plan).items():
            spark.createDataFrame([(drawing,)], "value string").coalesce(1).write.mode(mode).text(f"{out}/{name}.svg")
    finally:
        for df in held:
            df.unpersist()
    return rows
