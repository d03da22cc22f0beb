"""The affinity graph of items and its communities."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import share
from ..sources.shared import materialized


def edges(itemsets: DataFrame, min_lift: float = 1.1) -> DataFrame:
    """item_a < item_b with support, count, lift, leverage and weight = lift - 1 of frequent pairs lifted enough."""
    if min_lift < 1:
        raise ValueError("min_lift must be at least 1")
    pairs = itemsets.where("size = 2").select(F.element_at("items", 1).alias("item_a"), F.element_at("items", 2).alias("item_b"), "support", F.col("cnt").alias("support_count"))
    one = itemsets.where("size = 1").select(F.element_at("items", 1).alias("item"), F.col("support").alias("s"))
    joined = pairs.join(one.toDF("item_a", "sa"), "item_a").join(one.toDF("item_b", "sb"), "item_b")
    out = joined.withColumn("lift", F.col("support") / (F.col("sa") * F.col("sb"))).where(F.col("lift") >= min_lift)
    return out.select("item_a", "item_b", "support", "support_count", "lift", (F.col("support") - F.col("sa") * F.col("sb")).alias("leverage"), (F.col("lift") - 1).alias("weight"))


def ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("item_a").alias("item"), "weight").union(links.select("item_b", "weight"))


def strengths(links: DataFrame) -> DataFrame:
    return ends(links).groupBy("item").agg(F.sum(F.col("weight").cast("decimal(28,15)")).cast("double").alias("strength"))


def modularity(links: DataFrame, membership: DataFrame) -> DataFrame:
    """q of a partition (item, community_id); 0 without weight.  Raises if an item has two communities or an end none."""
    if membership.groupBy("item").count().where("count > 1").limit(1).count():
        raise ValueError("communities overlap")
    if ends(links).join(membership, "item", "left_anti").limit(1).count():
        raise ValueError("an edge leaves the communities")
    return partition_quality(links, membership).select(F.when(F.col("m") > 0, F.col("q")).otherwise(0.0).alias("q"))


def partition_quality(links: DataFrame, membership: DataFrame) -> DataFrame:
    """q of a partition and m, the weight of all edges: as in SQL, null without edges and NaN if they weigh nothing."""
    a = membership.toDF("item_a", "ca")
    b = membership.toDF("item_b", "cb")
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,15)")).cast("double")
    inside = links.join(a, "item_a").join(b, "item_b").where("ca = cb").groupBy(F.col("ca").alias("community_id")).agg(exact("weight").alias("w"))
    degree = ends(links).join(membership, "item").groupBy("community_id").agg(exact("weight").alias("d"))
    total = links.agg(F.coalesce(exact("weight"), F.lit(0.0)).alias("m"))
    parts = degree.join(inside, "community_id", "left").join(total)
    gain = share(F.coalesce("w", F.lit(0.0)), F.col("m")) - F.pow(share(F.col("d"), 2 * F.col("m")), 2)
    return parts.agg(F.sum(F.when(F.col("m") == 0, float("nan")).otherwise(gain)).alias("q"), F.max("m").alias("m"))


def greedy_communities(nodes: Iterable[str], links: Iterable[tuple[str, str, float]], tol: float = 1e-12, total: float | None = None, start: dict[str, tuple[list[str], float]] | None = None) -> list[tuple[str, ...]]:
    """Merges, from single items on, the linked pair of communities that raises modularity most, while any does.

    Gains within ``tol`` of the largest are equal; of these the first in the order of members is taken, which for
    communities without common members is the order of their first ones.  ``total`` is the weight of the whole graph, if
    the links are those of a part; ``start`` has the members and strength of nodes that are communities already, which
    go by the name of their first member.
    """
    links = list(links)
    m = sum(w for *_, w in links) if total is None else total
    first = sorted({*nodes, *(x for a, b, _ in links for x in (a, b))})
    number = {c: i for i, c in enumerate(first)}
    strength, between = [0.0] * len(first), [{} for _ in first]
    held = [[c] for c in first]
    for a, b, w in links:
        i, j = number[a], number[b]
        strength[i] += w
        strength[j] += w
        between[i][j] = between[j][i] = between[i].get(j, 0.0) + w
    for c, (members, weight) in (start or {}).items():
        held[number[c]], strength[number[c]] = list(members), weight
    alive = [True] * len(first)
    # pairs wait in a heap for each gain, in order of their first members; the gains wait in another
    waiting: dict[float, list[tuple[str, str, int, int]]] = {}
    gains: list[float] = []

    def offer(i: int, j: int) -> None:
        g = between[i][j] / m - strength[i] * strength[j] / (2 * m * m)
        if g <= tol:
            return
        if g not in waiting:
            waiting[g] = []
            heapq.heappush(gains, -g)
        heapq.heappush(waiting[g], (*sorted((first[i], first[j])), i, j))

    if m > 0:
        for i, near in enumerate(between):
            for j in near:
                if i < j:
                    offer(i, j)
    while gains:
        near, best = [], None
        while gains and (best is None or -gains[0] >= best - tol):
            g = -heapq.heappop(gains)
            pairs = waiting[g]
            while pairs and not (alive[pairs[0][2]] and alive[pairs[0][3]]):
                heapq.heappop(pairs)
            if not pairs:
                del waiting[g]
                continue
            best = g if best is None else best
            near.append(g)
        for g in near:
            heapq.heappush(gains, -g)
        if best is None:
            break
        *_, i, j = min(waiting[g][0] for g in near)
        if len(between[i]) < len(between[j]):
            i, j = j, i
        new = len(first)
        first.append(min(first[i], first[j]))
        held[i].extend(held[j]) if len(held[i]) >= len(held[j]) else held[j].extend(held[i])
        held.append(max(held[i], held[j], key=len))
        strength.append(strength[i] + strength[j])
        alive[i] = alive[j] = False
        alive.append(True)
        around = between[i]
        for other, w in between[j].items():
            around[other] = around.get(other, 0.0) + w
        around.pop(i, None)
        around.pop(j, None)
        between.append(around)
        for other, w in around.items():
            theirs = between[other]
            theirs.pop(i, None)
            theirs.pop(j, None)
            theirs[new] = w
            offer(other, new)
    return sorted((tuple(sorted(held[i])) for i in range(len(first)) if alive[i]), key=lambda c: (-len(c), c))


def parts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """item, part: the smallest item that can be reached by links; as many rows as items."""
    both = materialized(links.select("item_a", "item_b").union(links.select("item_b", "item_a")).toDF("item", "to").distinct(), "links")
    found = materialized(nodes.select("item", F.col("item").alias("part")), "parts")
    while True:
        near = both.join(found.toDF("to", "near"), "to").groupBy("item").agg(F.min("near").alias("near"))
        low = found.join(near, "item", "left").select("item", "part", F.least("part", F.coalesce("near", "part")).alias("low"))
        # a shortcut: what the label's own label is
        step = low.join(found.toDF("low", "above"), "low", "left").select("item", "part", F.least("low", F.coalesce("above", "low")).alias("next"))
        step = materialized(step, "parts")
        if not step.where("part <> next").limit(1).count():
            return step.select("item", "part")
        found = step.select("item", F.col("next").alias("part"))


#: Edges of a graph that one task merges.
ONE_TASK = 100_000
#: How far apart gains must be to be told apart whatever order their weights were added in.
CLEAR = 1e-11


def contracted(nodes: DataFrame, links: DataFrame, total: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item, head), (head, strength) and (a, b, weight) between heads after all merges that the order can't change.

    Two communities that gain g by merging, and whose positive gains with all others add up to less than g, merge at
    once with every other such pair, as a join and an aggregation, until there is none.  The greedy order does the same:
    a gain with a union is the sum of the gains with its parts, so whatever others merge, nothing with one of the two
    ever reaches g, and they are the first that either merges with; and nothing that their union merges with reaches g
    either, so having merged early it waits until the order has come down to g.  Such pairs have no common member, and
    a merge of one leaves the sums of the others no larger.
    """
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,15)")).cast("double")
    members = materialized(nodes.select("item", F.col("item").alias("head")), "members")
    strength = materialized(nodes.select(F.col("item").alias("head")).join(strengths(links).withColumnRenamed("item", "head"), "head", "left").na.fill(0.0), "strengths")
    pairs = materialized(links.groupBy(F.least("item_a", "item_b").alias("a"), F.greatest("item_a", "item_b").alias("b")).agg(exact("weight").alias("weight")), "pairs")
    while True:
        sized = pairs.join(strength.toDF("a", "sa"), "a").join(strength.toDF("b", "sb"), "b")
        gain = F.col("weight") / total - F.col("sa") * F.col("sb") / (2 * total * total)
        good = sized.withColumn("g", gain).where("g > 0").select("a", "b", "g")
        sides = good.unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b"), "g"))
        best = sides.groupBy("a").agg(F.sum("g").alias("all"), F.max(F.struct("g", "b")).alias("best")).select("a", F.col("best.b").alias("b"), F.col("best.g").alias("g"), "all")
        met = best.where("a < b").join(best.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("all").alias("others")), ["a", "b"])
        safe = materialized(met.where((F.col("all") + F.col("others") - 2 * F.col("g") < F.col("g") - CLEAR) & (F.col("g") > CLEAR)).select(F.col("b").alias("head"), F.col("a").alias("into")), "merges")
        if not safe.limit(1).count():
            return members, strength, pairs
        to = lambda df, c: df.join(safe.toDF(c, "into"), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")
        members = materialized(to(members, "head").select("item", "head"), "members")
        strength = materialized(to(strength, "head").groupBy("head").agg(exact("strength").alias("strength")), "strengths")
        moved = to(to(pairs, "a"), "b").where("a <> b")
        pairs = materialized(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(exact("weight").alias("weight")), "pairs")


def communities(itemsets: DataFrame, links: DataFrame) -> DataFrame:
    """item, community_id from 0 by falling size and then by members.

    A graph of many edges is first contracted by merges that don't depend on the order.  Of what remains, only linked
    communities merge, and a gain depends on its own two and the weight of the whole graph, so every connected part is
    a group of its own, merged in order with a heap.  A part is bounded whatever the number of baskets: there are at
    most 1 / min_support times as many frequent items as a mean basket has items, and frequent pairs as it has pairs.
    """
    links = materialized(links, "edges")
    nodes = materialized(itemsets.where("size = 1").select(F.element_at("items", 1).alias("item")).union(ends(links).select("item")).distinct(), "nodes")
    counted = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("weight").cast("decimal(28,15)")).cast("double"), F.lit(0.0)).alias("total")).first()
    total = counted["total"]
    if counted["n"] > ONE_TASK and total > 0:
        members, strength, pairs = contracted(nodes, links, total)
        heads = strength.withColumnRenamed("head", "item")
        where = parts(heads, pairs.select(F.col("a").alias("item_a"), F.col("b").alias("item_b")))
        start = heads.join(members.groupBy(F.col("head").alias("item")).agg(F.collect_list("item").alias("members")), "item").join(where, "item").select("part", F.col("item").alias("item_a"), F.lit(None).cast("string").alias("item_b"), F.col("strength").alias("weight"), "members")
        linked = pairs.join(where.withColumnRenamed("item", "a"), "a").select("part", F.col("a").alias("item_a"), F.col("b").alias("item_b"), "weight", F.lit(None).cast("array<string>").alias("members"))
    else:
        start = nodes.select(F.lit("").alias("part"), F.col("item").alias("item_a"), F.lit(None).cast("string").alias("item_b"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("array<string>").alias("members"))
        linked = links.select(F.lit("").alias("part"), "item_a", "item_b", "weight", F.lit(None).cast("array<string>").alias("members"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        alone, inner = pdf[pdf.item_b.isna()], pdf[pdf.item_b.notna()].sort_values(["item_a", "item_b"])
        known = {r.item_a: (list(r.members), r.weight) for r in alone.itertuples() if r.members is not None}
        found = greedy_communities(alone.item_a, list(zip(inner.item_a, inner.item_b, inner.weight)), total=total, start=known)
        return pd.DataFrame({"members": [list(c) for c in found]})

    found = start.unionByName(linked).groupBy("part").applyInPandas(run, "members array<string>")
    number = F.row_number().over(Window.orderBy(F.desc(F.size("members")), "members")) - 1
    return found.select("members", number.cast("int").alias("community_id")).select(F.explode("members").alias("item"), "community_id")


def grouping(membership: DataFrame) -> DataFrame:
    """n_communities of two items or more, n_grouped items in them, and n_isolated items without company."""
    sizes = membership.groupBy("community_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count_if(F.col("n") > 1).alias("n_communities"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_grouped"), F.count_if(F.col("n") == 1).alias("n_isolated"))


def isolated(membership: DataFrame) -> DataFrame:
    """item: those alone in their community."""
    return membership.groupBy("community_id").agg(F.count("*").alias("n"), F.first("item").alias("item")).where("n = 1").select("item")


def backbone(links: DataFrame, n: int, k: int) -> DataFrame:
    """The edges of the ``n`` strongest items that are among the ``k`` heaviest of an end: at most n * k rows."""
    top = strengths(links).orderBy(F.desc("strength"), "item").limit(max(0, n)).select("item")
    inner = links.join(F.broadcast(top.withColumnRenamed("item", "item_a")), "item_a", "left_semi").join(F.broadcast(top.withColumnRenamed("item", "item_b")), "item_b", "left_semi")
    each = inner.select(F.explode(F.array("item_a", "item_b")).alias("end"), F.struct(*links.columns).alias("edge"))
    place = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("edge.weight"), "edge.item_a", "edge.item_b"))
    return each.withColumn("place", place).where(F.col("place") <= k).select("edge").distinct().select("edge.*")


def classified(links: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges with the communities of their ends: internal ones and bridges."""
    m = membership
    joined = links.join(m.toDF("item_a", "community_a"), "item_a").join(m.toDF("item_b", "community_b"), "item_b")
    return joined.withColumn("kind", F.when(F.col("community_a") == F.col("community_b"), "internal").otherwise("bridge"))


def community_stats(links: DataFrame, membership: DataFrame) -> DataFrame:
    """community_id, members, n, internal edges, their mean and largest lift, the strongest pair."""
    inner = classified(links, membership).where("kind = 'internal'").groupBy(F.col("community_a").alias("community_id")).agg(
        F.count("*").alias("n_edges"), F.round(F.avg("lift"), 6).alias("mean_lift"), F.max("lift").alias("max_lift"), F.max_by(F.concat_ws(" + ", "item_a", "item_b"), F.struct("lift")).alias("top_pair")
    )
    sized = membership.groupBy("community_id").agg(F.array_sort(F.collect_list("item")).alias("members"), F.count("*").alias("n"))
    zero = {"n_edges": 0, "mean_lift": 0.0, "max_lift": 0.0}
    return sized.join(inner, "community_id", "left").na.fill(zero).orderBy("community_id")


def numbered(membership: DataFrame) -> DataFrame:
    return membership.withColumn("place", F.row_number().over(Window.orderBy("community_id", "item")))
