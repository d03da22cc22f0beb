"""Values derived by hand on small baskets."""

import itertools
import math
import random

import pytest

from tallyloom.operators import backtest, graph, mine, rules, splits, vertical
from tallyloom.sources import baskets_from_lists, planted_pairs, synthetic_lines

EIGHT = ["pq", "pq", "pqr", "p", "q", "pq", "r", "pr"]


def found(spark, baskets, **kw):
    return mine.frequent_itemsets(baskets_from_lists(spark, baskets), **kw)


def test_counts_and_miners_agree(spark):
    lines = baskets_from_lists(spark, EIGHT)
    want = {("p",): 6, ("q",): 5, ("r",): 3, ("p", "q"): 4, ("p", "r"): 2, ("q", "r"): 1, ("p", "q", "r"): 1}
    for made in (mine.frequent_itemsets(lines, 0.01), mine.frequent_itemsets(lines, 0.01, 3, "join"), mine.frequent_itemsets_fpgrowth(lines, 0.01)):
        assert {tuple(r["items"]): r["cnt"] for r in made.collect()} == want


def test_rule_metrics_closure_and_improvement(spark):
    sets = found(spark, EIGHT, min_support=0.01)
    made = rules.rules(sets, 0.01, 0.01, 2)
    r = made.where("antecedent = array('p') and consequent = array('q')").first()
    assert (r["support"], r["confidence"]) == (0.5, 0.5 / 0.75) and math.isclose(r["lift"], 16 / 15) and math.isclose(r["leverage"], 0.03125) and math.isclose(r["conviction"], 1.125)
    flags = {"".join(x["items"]): (x["closed"], x["maximal"]) for x in rules.with_closure(sets).collect()}
    assert [k for k, v in flags.items() if not v[0]] == ["qr"] and [k for k, v in flags.items() if v[1]] == ["pqr"]
    v = rules.improvements(sets, made).where("antecedent = array('q', 'r')").first()
    assert v["conviction"] == math.inf and math.isclose(v["improvement"], 0.2) and v["best_antecedent"] == ["q"]


def test_ranked_suggestions(spark):
    schema = "rank long, antecedent array<string>, consequent array<string>, lift double, confidence double, thin_support boolean"
    made = spark.createDataFrame([(1, ["e"], ["f"], 9.0, 0.9, True), (2, ["a"], ["b"], 2.0, 0.6, False), (3, ["a"], ["c", "d"], 1.8, 0.5, False), (4, ["a", "b"], ["c"], 1.5, 0.9, False)], schema)
    asked = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["e"]), (4, ["a", "c"])], "basket_id long, query array<string>")
    got = {}
    for r in rules.ranked_items(rules.applicable(asked, made)).orderBy("basket_id", "place").collect():
        got.setdefault(r["basket_id"], []).append(r["item"])
    assert got == {1: ["b", "c", "d"], 2: ["c", "d"], 4: ["b"]}


def test_scores(spark):
    trials = spark.createDataFrame([(1, "x"), (2, "z"), (3, "x"), (4, "x")], "basket_id long, held_out string")
    lists = spark.createDataFrame([(1, ["x", "y"]), (2, ["y"]), (3, []), (4, ["z", "x"])], "basket_id long, predictions array<string>")
    got = {r["k"]: r for r in backtest.score(trials, lists, (1, 2)).collect()}
    assert got[1]["hit_rate"] == 0.25 and got[2]["hit_rate"] == 0.5 and got[2]["mrr"] == 0.375 and got[2]["coverage"] == 0.75


def test_windows(spark):
    lines = baskets_from_lists(spark, ["a"] * 10)
    counts = splits.time_windows(lines, 4).groupBy("split_id").count().orderBy("split_id").collect()
    assert [r["count"] for r in counts] == [2, 3, 3, 2]
    assert splits.arrival_split(baskets_from_lists(spark, ["a"] * 5), 0.5).where("is_train").count() == 2


def test_communities(spark):
    assert graph.greedy_communities(["z"], [("u", "v", 1.0), ("v", "w", 1.0)]) == [("u", "v", "w"), ("z",)]
    links = spark.createDataFrame([("u", "v", 1.0), ("v", "w", 1.0)], "item_a string, item_b string, weight double")
    parts = lambda *c: spark.createDataFrame([(x, i) for i, m in enumerate(c) for x in m], "item string, community_id int")
    for cut, q in ((("u", "v", "w"), -0.375), (("uv", "w"), -0.125), (("uvw",), 0.0)):
        assert math.isclose(graph.modularity(links, parts(*cut)).first()[0], q, abs_tol=1e-12)
    with pytest.raises(ValueError):
        graph.modularity(links, parts("uv"))


def test_communities_of_apart_groups_and_against_a_full_scan(spark):
    def scanned(nodes, links):
        """The same merges, with every gain recomputed for every pair at every step."""
        m = sum(w for *_, w in links)
        found = [(n,) for n in sorted(nodes)]
        while True:
            between = lambda c, d: sum(w for a, b, w in links if (a in c and b in d) or (a in d and b in c))
            degree = lambda c: sum(w * ((a in c) + (b in c)) for a, b, w in links)
            gains = [(between(c, d) / m - degree(c) * degree(d) / (2 * m * m), c, d) for c in found for d in found if c < d and between(c, d)]
            top = max((g for g, *_ in gains), default=0)
            if top <= 1e-12:
                return sorted(found, key=lambda c: (-len(c), c))
            _, c, d = min((x for x in gains if x[0] >= top - 1e-12), key=lambda x: x[1:])
            found = sorted([x for x in found if x not in (c, d)] + [tuple(sorted(c + d))])


    rng = random.Random(3)
    names = [f"i{k:02}" for k in range(18)]
    links = [(a, b, rng.choice([0.5, 1.0, 1.5, 2.0])) for i, a in enumerate(names) for b in names[i + 1 :] if int(a[1:]) % 3 == int(b[1:]) % 3 and rng.random() < 0.5]
    want = scanned([*names, "lone"], links)
    assert graph.greedy_communities([*names, "lone"], links) == want
    sets = spark.createDataFrame([([n], 1) for n in [*names, "lone"]], "items array<string>, size int")
    got = {r["item"]: r["community_id"] for r in graph.communities(sets, spark.createDataFrame(links, "item_a string, item_b string, weight double")).collect()}
    assert got == {x: i for i, c in enumerate(want) for x in c}


def test_wide_baskets_and_large_antecedents(spark):
    wide = ["".join(chr(97 + i) for i in range(26))] * 3 + ["abc", "ab", "xyz", "a"]
    lines = baskets_from_lists(spark, wide + [[f"n{i}" for i in range(300)]])
    key = lambda found: {tuple(r["items"]): r["cnt"] for r in found.collect()}
    want = key(mine.frequent_itemsets(lines, 0.3, 3, "explode"))
    assert key(mine.frequent_itemsets(lines, 0.3)) == key(mine.frequent_itemsets(lines, 0.3, 3, "vertical")) == key(mine.frequent_itemsets(lines, 0.3, 3, "join")) == want
    schema = "rank long, antecedent array<string>, consequent array<string>, lift double, confidence double, thin_support boolean"
    made = spark.createDataFrame([(1, ["a", "b", "c", "d"], ["e"], 9.0, 0.9, False), (2, ["b", "c"], ["d"], 2.0, 0.6, False)], schema)
    asked = spark.createDataFrame([(1, list("abcd")), (2, list("abc")), (3, list("abcde"))], "basket_id long, query array<string>")
    assert {(r["basket_id"], r["rank"]) for r in rules.applicable(asked, made).collect()} == {(1, 1), (2, 2)}


def test_ranks_over_many_lifts(spark):
    rows = [(s, [f"a{i}"], [f"b{i}"], 0.5 + (i * 7 % 40) / 10, 0.1 * (i % 3)) for s in (0, 1) for i in range(80)]
    found = spark.createDataFrame(rows, "split_id long, antecedent array<string>, consequent array<string>, lift double, confidence double")
    got = [(r["split_id"], r["antecedent"]) for r in rules.ranked(found).orderBy("split_id", "rank").collect()]
    assert got == [(s, a) for s, a, _, _, _ in sorted(rows, key=lambda r: (r[0], -r[3], -r[4], r[1], r[2]))]
    assert {r["rank"] for r in rules.ranked(found).where("split_id = 1").collect()} == set(range(1, 81))


def test_empty_windows_sides_and_trials_are_errors(spark):
    three = baskets_from_lists(spark, ["a", "b", "c"])
    for call in (lambda: splits.time_windows(three, 4), lambda: splits.arrival_split(three, 0.1), lambda: splits.arrival_split(three, 0.9), lambda: backtest.evaluate(three, 0.1, 0.1, 1.0)):
        with pytest.raises(ValueError):
            call()


def test_empty_baskets_and_arguments(spark):
    none = baskets_from_lists(spark, [])
    assert mine.frequent_itemsets(none).count() == 0 and mine.frequent_itemsets_fpgrowth(none).count() == 0
    for call in (lambda: mine.frequent_itemsets(none, 0), lambda: splits.time_windows(none, 1), lambda: splits.bootstrap(none, 1), lambda: splits.arrival_split(none, 1.0), lambda: backtest.holdout_trials(none, 1, 1), lambda: graph.edges(none, 0.9), lambda: synthetic_lines(none.sparkSession, 0), lambda: rules.ranked_items(none, 0)):
        with pytest.raises(ValueError):
            call()


def test_planted_bundles_are_found(spark):
    sets = mine.frequent_itemsets(synthetic_lines(spark, 2000, 200, 7), 0.02, 2)
    lifted = {(r["item_a"], r["item_b"]) for r in graph.edges(sets, 1.4).collect()}
    assert {(r["item_a"], r["item_b"]) for r in planted_pairs(spark).collect()} <= lifted
    assert synthetic_lines(spark, 50, 10, 3).exceptAll(synthetic_lines(spark, 50, 10, 3)).count() == 0


def test_baskets_of_three_hundred_items_at_five_levels(spark, monkeypatch):

    rng = random.Random(5)
    often, rare = [f"k{i}" for i in range(7)], [f"r{i:04}" for i in range(3000)]
    baskets = [sorted({*(k for k in often if rng.random() < 0.9), *rng.sample(rare, 294)}) for _ in range(24)] + [["k0", "k1"], ["k2"]]
    lines = baskets_from_lists(spark, baskets)
    want = {}
    for k in range(1, 6):
        for c in itertools.combinations(often, k):
            n = sum(set(c) <= set(b) for b in baskets)
            want |= {c: n} if n >= 12 else {}
    counts = lambda found: {tuple(r["items"]): r["cnt"] for r in found.collect()}
    found = mine.frequent_itemsets(lines, 12 / 26, 5)
    assert counts(found) == want and max(map(len, want)) == 5
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    assert scans(found) <= 5 and scans(mine.frequent_itemsets(lines, 12 / 26, 5, "join")) <= 5
    monkeypatch.setattr(vertical, "BLOCK_LINES", 900)
    monkeypatch.setattr(vertical, "STEP", 500)
    monkeypatch.setattr(vertical, "SENT", 3)
    monkeypatch.setattr(vertical, "CHUNK", 4)
    assert counts(mine.frequent_itemsets(lines, 12 / 26, 5, "vertical")) == want


def test_blocks_count_weights_whether_packed_or_listed():

    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    for n, share in ((40, 0.5), (400, 0.02), (300, 0.2)):
        baskets = {b: (rng.randrange(1, 6), [i for i in range(30) if rng.random() < share * (1 + i / 15)]) for b in range(n)}
        rows = [(0, 0, b, f"i{i:02}", w) for b, (w, items) in baskets.items() for i in items]
        rng.shuffle(rows)
        table = pa.table(dict(zip(["split_id", "block", "basket_id", "item", "weight"], map(list, zip(*rows)))))
        block = vertical.Block(next(vertical.rows_of([vertical.pack(table)])))
        held = {b: {f"i{i:02}" for i in items} for b, (_, items) in baskets.items()}
        sets = np.array(list(itertools.combinations(range(len(block.names)), 3)))
        weight = lambda names: sum(baskets[b][0] for b, h in held.items() if names <= h)
        assert block.counts(sets).tolist() == [weight(set(block.names[s])) for s in sets]
        pairs = [(tuple(block.names[s]), int(c)) for some, counts in block.pairs() for s, c in zip(some, counts) if c]
        assert sorted(pairs) == sorted((p, c) for p in itertools.combinations(block.names, 2) if (c := weight(set(p))))


def test_early_merges_change_nothing(spark, monkeypatch):

    for seed in range(1):
        rng = random.Random(seed)
        names = [f"i{k:02}" for k in range(40)]
        links = [(names[2 * i], names[2 * i + 1], 3.0 + rng.random()) for i in range(12)]
        links += [(a, b, rng.choice([0.05, 0.1, 0.3, 1.0])) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.06 and (a, b) not in {x[:2] for x in links}]
        want = graph.greedy_communities([*names, "lone"], links)
        frame = spark.createDataFrame(links, "item_a string, item_b string, weight double")
        sets = spark.createDataFrame([([n], 1) for n in [*names, "lone"]], "items array<string>, size int")
        nodes = sets.selectExpr("items[0] AS item")
        members, _, pairs = graph.contracted(nodes, frame, sum(w for *_, w in links))
        heads = {r["item"]: r["head"] for r in members.collect()}
        assert sum(k != v for k, v in heads.items()) >= 3 and pairs.count() < len(links)
        monkeypatch.setattr(graph, "ONE_TASK", 0)
        got = {r["item"]: r["community_id"] for r in graph.communities(sets, frame).collect()}
        assert got == {x: i for i, c in enumerate(want) for x in c}


def test_isolated_items_and_the_backbone(spark):
    members = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 2), ("e", 0)], "item string, community_id int")
    assert tuple(graph.grouping(members).first()) == (1, 3, 2) and {r[0] for r in graph.isolated(members).collect()} == {"c", "d"}
    star = spark.createDataFrame([("a", f"b{i}", 1.0 + i) for i in range(9)] + [("b7", "b8", 0.5)], "item_a string, item_b string, weight double")
    assert {(r["item_a"], r["item_b"]) for r in graph.backbone(star, 4, 1).collect()} == {("a", "b8"), ("a", "b7"), ("a", "b6")}
    assert graph.backbone(star, 10, 2).count() <= 20 and graph.backbone(star, 0, 2).count() == 0


def test_positions_of_text_ids_and_of_sparse_numbers(spark):
    for ids, kind in (([f"x{i}" for i in range(300)], "string"), ([(i * 7919 - 3) * 10**12 for i in range(300)], "long")):
        rows = spark.createDataFrame([(b, "a") for b in ids] + [(None, "a")], f"basket_id {kind}, item string")
        got = [r["basket_id"] for r in splits.positions(rows).orderBy("pos").collect()]
        assert got == sorted(ids) and {r["pos"] for r in splits.positions(rows).collect()} == set(range(300))


def test_splits_are_counted_together_as_one_by_one(spark):
    lines = synthetic_lines(spark, 400, 40, 3).select("basket_id", "item")
    dealt = splits.bootstrap(lines, 3, 1)
    key = lambda found: {(r["split_id"], tuple(r["items"])): (r["cnt"], r["n"]) for r in found.collect()}
    apart = mine.frequent_itemsets(lines.join(dealt, "basket_id"), 0.03)
    assert key(mine.itemsets_of_splits(lines, dealt, [0, 1, 2], 0.03)) == key(apart)
    saved, mine.NARROW = mine.NARROW, 3
    try:
        assert key(mine.itemsets_of_splits(lines, dealt, [0, 1, 2], 0.03)) == key(apart)
    finally:
        mine.NARROW = saved
    given = lines.selectExpr("basket_id", "basket_id % 2 * 5 AS split_id").distinct()
    reference = rules.rules(mine.frequent_itemsets(lines, 0.03), 0.1, 1.0)
    rows = lambda found: sorted(map(str, found.collect()))
    args = (0.03, 0.1, 1.0)
    assert rows(splits.rule_stability(lines, None, *args, splits=given)) == rows(splits.rule_stability(lines, reference, *args, splits=given))
    with pytest.raises(ValueError):
        splits.rule_stability(lines, None, *args, splits=given.where("split_id = 0"))


def test_rules_meet_queries_by_their_rarest_item_and_frequent_ones_in_parts(spark, monkeypatch):

    rng = random.Random(2)
    asked = [(i, sorted({"hot", *rng.sample("abcdef", rng.randrange(4))})) for i in range(60)] + [(99, [])]
    made = [(r, sorted(a), [c], 2.0, 0.5, False) for r, (a, c) in enumerate([("a", "b"), (("hot", "a"), "c"), (("hot",), "d"), (("hot", "e", "f"), "a"), (("absent", "hot"), "a")])]
    frame = spark.createDataFrame(made, "rank long, antecedent array<string>, consequent array<string>, lift double, confidence double, thin_support boolean")
    queries = spark.createDataFrame(asked, "basket_id long, query array<string>")
    want = {(b, r) for b, q in asked for r, a, c, *_ in made if set(a) <= set(q) and not set(c) & set(q)}
    for heavy in (256, 1):
        monkeypatch.setattr(rules, "HEAVY", heavy)
        assert sorted((r["basket_id"], r["rank"]) for r in rules.applicable(queries, frame).collect()) == sorted(want)
    seen = queries.selectExpr("explode(query) AS key").groupBy("key").count().withColumnRenamed("count", "seen")
    assert {r["rank"]: r["key"] for r in rules.rarest_items(frame, seen).collect()}[1] == "a" and rules.rarest_items(frame, seen).where("rank = 4").count() == 0


def test_rules_kept_by_improvement(spark):
    rows = [(["a"], ["b"], 0.2, False), (["c"], ["b"], 0.5, False), (["b"], ["a"], 0.2, False), (["d"], ["a"], 0.0, True)]
    got = rules.kept_by_improvement(spark.createDataFrame(rows, "antecedent array<string>, consequent array<string>, improvement double, redundant boolean"))
    assert [r["antecedent"][0] for r in got.orderBy("place").collect()] == ["c", "a", "b"]


def test_pattern_growth_counts_every_split_as_level_wise_mining_does(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for b in range(300):
        items = {"hot"} | {f"i{int(12 * rng.random() ** 2)}" for _ in range(rng.randint(0, 7))} if b % 3 else {"hot", "i0", "i1", "i2"}
        for split in (0, 1, 7):
            if rng.random() < 0.7:
                rows += [(b, i, split, 1 + b % 2) for i in sorted(items)] * (1 + b % 2)
    rows += [(None, "i1", 0, 1), (5, None, 0, 1)]
    lines = spark.createDataFrame(rows, "basket_id long, item string, split_id long, weight long")
    shown = lambda made: sorted((r["split_id"], tuple(r["items"]), r["size"], r["cnt"], r["n"], r["support"]) for r in made.collect())
    want = shown(mine.frequent_itemsets(lines, 0.03, 5, "explode"))
    assert len({r[0] for r in want}) == 3 and max(r[2] for r in want) == 5
    assert shown(mine.frequent_itemsets(lines, 0.03, 5, "growth")) == want
    monkeypatch.setattr(mine, "LOOKED_UP", 2)
    assert shown(mine.frequent_itemsets(lines, 0.03, 5, "growth")) == want
    assert shown(mine.frequent_itemsets(lines, 0.03, 1, "growth")) == [r for r in want if r[2] == 1]


def test_pattern_growth_ends_where_no_set_is_left(spark):
    lines = baskets_from_lists(spark, EIGHT)
    want = {("p",): 6, ("q",): 5, ("r",): 3, ("p", "q"): 4, ("p", "r"): 2, ("q", "r"): 1, ("p", "q", "r"): 1}
    assert {tuple(r["items"]): r["cnt"] for r in mine.frequent_itemsets(lines, 0.01, 9, "growth").collect()} == want
    assert mine.frequent_itemsets(lines, 1.0, 3, "growth").count() == 0
    assert mine.frequent_itemsets(lines.limit(0), 0.01, 3, "growth").count() == 0


def test_pattern_growth_of_one_path_repeated(spark):
    """Twenty thousand equal baskets are one row of the first base."""
    from pyspark.sql import functions as F

    from tallyloom.operators import growth

    lines = spark.range(20_000).select(F.col("id").alias("basket_id"), F.explode(F.array(*(F.lit(x) for x in "abcd"))).alias("item"))
    every = mine.split_baskets(lines)
    first = mine.frequent_itemsets(lines, 0.5, 1)
    assert [(r["prefix"], r["cnt"]) for r in growth.paths(every, first, 10).collect()] == [(["a", "b", "c", "d"], 20_000)]
    assert {r["cnt"] for r in mine.frequent_itemsets(lines, 0.5, 4, "growth").collect()} == {20_000}
