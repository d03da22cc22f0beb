"""The same queries as SQL text, from the definitions of the operators."""

from __future__ import annotations

from .settings import CLUSTERS, FOLDS, SEED, T1, T2, T3, T4, TOP_K, TOP_N, TRAIN, WINDOWS, Setting


def lines(s: Setting) -> str:
    return f"""lines AS (SELECT l_orderkey AS basket_id, o_custkey AS customer_id, {s.item} AS item,
      CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS amount
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
    pos AS (SELECT basket_id, ROW_NUMBER() OVER (ORDER BY basket_id) - 1 AS pos, COUNT(*) OVER () AS nb FROM (SELECT DISTINCT basket_id FROM lines))"""


ALL = "b AS (SELECT DISTINCT 0::BIGINT AS split_id, basket_id, item, 1::BIGINT AS w FROM lines)"
WINDOW = f"win AS (SELECT basket_id, pos, ({' + '.join(f'CASE WHEN pos >= round_even({i}::DOUBLE * nb / {WINDOWS}, 0) THEN 1 ELSE 0 END' for i in range(1, WINDOWS))})::BIGINT AS split_id FROM pos)"
BY_WINDOW = "b AS (SELECT DISTINCT split_id, basket_id, item, 1::BIGINT AS w FROM lines JOIN win USING (basket_id))"
HASH = "('0x' || substr(md5({key}), 1, 8))::BIGINT % {mod}"
DRAWS = f"draws AS (SELECT f AS split_id, {HASH.format(key=f'concat_ws(chr(124), {SEED}, f, pos)', mod='nb')} AS pos FROM pos, range({FOLDS}) t(f))"
BY_FOLD = "b AS (SELECT d.split_id, p.basket_id, l.item, d.w FROM (SELECT split_id, pos, COUNT(*)::BIGINT AS w FROM draws GROUP BY ALL) d JOIN pos p USING (pos) JOIN (SELECT DISTINCT basket_id, item FROM lines) l USING (basket_id))"
CUT = f"cut AS (SELECT basket_id, pos, pos < round_even(nb * {TRAIN}::DOUBLE, 0) AS is_train FROM pos)"
TRAINED = "b AS (SELECT DISTINCT 0::BIGINT AS split_id, basket_id, item, 1::BIGINT AS w FROM lines JOIN cut USING (basket_id) WHERE is_train)"


def mined(s: Setting) -> str:
    on = "x.split_id = y.split_id AND x.basket_id = y.basket_id AND x.item < y.item"
    return f"""n AS (SELECT split_id, SUM(w)::BIGINT AS n FROM (SELECT DISTINCT split_id, basket_id, w FROM b) GROUP BY 1),
    c AS (SELECT split_id, [item] AS items, 1 AS size, SUM(w)::BIGINT AS cnt FROM b GROUP BY split_id, item
      UNION ALL SELECT x.split_id, [x.item, y.item], 2, SUM(x.w)::BIGINT FROM b x JOIN b y ON {on} GROUP BY x.split_id, x.item, y.item
      UNION ALL SELECT x.split_id, [x.item, y.item, z.item], 3, SUM(x.w)::BIGINT FROM b x JOIN b y ON {on} JOIN b z ON y.split_id = z.split_id AND y.basket_id = z.basket_id AND y.item < z.item GROUP BY x.split_id, x.item, y.item, z.item),
    fi AS (SELECT c.*, n, cnt::DOUBLE / n AS support, array_to_string(items, ' + ') AS label FROM c JOIN n USING (split_id) WHERE cnt >= greatest(1, ceil({s.min_support}::DOUBLE * n - 1e-9::DOUBLE)))"""


def ruled(s: Setting, thin: int | None = None) -> str:
    return f"""sp AS (SELECT split_id, cnt, support, list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS a, list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 0) AS c
      FROM fi, LATERAL (SELECT unnest(range(1, (1 << size) - 1)) AS m) WHERE size >= 2),
    r0 AS (SELECT sp.split_id, sp.a, sp.c, sp.support, sp.cnt, sp.support / fa.support AS confidence, (sp.support / fa.support) / fc.support AS lift, sp.support - fa.support * fc.support AS leverage, fc.support AS sc
      FROM sp JOIN fi fa ON fa.split_id = sp.split_id AND fa.items = sp.a JOIN fi fc ON fc.split_id = sp.split_id AND fc.items = sp.c),
    r AS (SELECT *, CASE WHEN confidence >= 1 THEN 'inf'::DOUBLE ELSE (1 - sc) / (1 - confidence) END AS conviction, cnt < {s.thin if thin is None else thin} AS thin, array_to_string(a, ' + ') AS antecedent, array_to_string(c, ' + ') AS consequent,
      ROW_NUMBER() OVER (PARTITION BY split_id ORDER BY lift DESC, confidence DESC, array_to_string(a, ' + '), array_to_string(c, ' + ')) AS rank FROM r0 WHERE confidence >= {s.min_confidence}::DOUBLE AND lift >= {s.min_lift}::DOUBLE)"""


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def items(s: Setting, select: str) -> str:
    return sql(lines(s), ALL, mined(s), select=select)


def rule(s: Setting, select: str, *more: str) -> str:
    return sql(lines(s), ALL, mined(s), ruled(s), *more, select=select)


SETS = "SELECT label AS itemset, size::BIGINT AS size, cnt, support FROM fi"
RULES = "SELECT rank::BIGINT AS rank, antecedent, consequent, support, cnt AS support_count, confidence, lift, leverage, conviction, thin AS thin_support FROM r"
COVERED = """cov AS (SELECT f.label, f.size, f.cnt, f.support, MAX(g.cnt) AS above FROM fi f LEFT JOIN fi g ON g.size > f.size AND list_has_all(g.items, f.items) GROUP BY ALL)"""
IMPROVED = """cand AS (SELECT a, c, antecedent, consequent, confidence, rank, confidence / lift AS bc, 0 AS bs, [] :: VARCHAR[] AS ba FROM r
      UNION ALL SELECT r.a, r.c, antecedent, consequent, confidence, rank, fw.support / fs.support, fs.size, fs.items FROM r JOIN fi fs ON len(list_intersect(fs.items, r.a)) = fs.size AND fs.size < len(r.a) JOIN fi fw ON fw.items = list_sort(list_concat(fs.items, r.c))),
    best AS (SELECT * FROM cand QUALIFY ROW_NUMBER() OVER (PARTITION BY antecedent, consequent ORDER BY bc DESC, bs, ba) = 1)"""
PRICES = "prices AS (SELECT item, round(CAST(SUM(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*), 6) AS avg_value FROM lines GROUP BY item)"
VALUED = """worth AS (SELECT rank, CAST(SUM(CAST(coalesce(avg_value, 0) AS DECIMAL(28,10))) AS DOUBLE) AS worth FROM (SELECT rank, unnest(c) AS item FROM r) LEFT JOIN prices USING (item) GROUP BY rank),
    val AS (SELECT r.*, greatest(0, confidence - confidence / lift) * worth AS value FROM r JOIN worth USING (rank))"""
BASKETS = "q AS (SELECT basket_id, list_sort(list(item)) AS query FROM (SELECT DISTINCT basket_id, item FROM lines) GROUP BY 1)"
APPLIED = "ap AS (SELECT basket_id, query, r.* FROM q JOIN r ON list_has_all(query, a) AND NOT list_has_any(query, c) WHERE NOT thin)"
RANKED = f"""it AS (SELECT basket_id, item, MIN((rank, p)) AS first FROM (SELECT basket_id, rank, unnest(list_sort(c)) AS item, generate_subscripts(c, 1) AS p FROM ap) GROUP BY ALL),
    ranked AS (SELECT basket_id, item, ROW_NUMBER() OVER (PARTITION BY basket_id ORDER BY first) AS place FROM it QUALIFY place <= {TOP_K})"""
STABLE = f"""top AS (SELECT rank, antecedent, consequent, lift, confidence, cnt FROM ref WHERE rank <= {TOP_N}),
    seen AS (SELECT top.*, r.lift AS seen FROM top LEFT JOIN r USING (antecedent, consequent)),
    st AS (SELECT rank::BIGINT AS rank, antecedent, consequent, round(lift, 6) AS reference_lift, cnt AS reference_count, COUNT(seen) AS n_present, round(coalesce(AVG(seen), 0), 6) AS lift_mean, round(coalesce(stddev_pop(seen), 0), 6) AS lift_std, round(coalesce(MIN(seen), 0), 6) AS lift_min, round(coalesce(MAX(seen), 0), 6) AS lift_max,
      COUNT(seen)::DOUBLE / {{k}} AS stability_score, COUNT(seen) >= {{k}} AS stable FROM seen GROUP BY ALL)"""


def stable(splits: list[str], k: int, select: str) -> str:
    """The reference rules over all baskets and the rules of every split side by side."""
    return f"WITH ref AS MATERIALIZED ({rule(T1, 'SELECT * FROM r')}),\n" + ",\n".join([lines(T1), *splits, mined(T1), ruled(T1, 0), STABLE.format(k=k)]) + f"\n{select}"


TRIALS = f"""tb AS (SELECT basket_id, list_sort(list(item)) AS items FROM (SELECT DISTINCT basket_id, item FROM lines JOIN cut USING (basket_id) WHERE NOT is_train) GROUP BY 1),
    tr AS (SELECT basket_id, items[1 + {HASH.format(key=f'concat_ws(chr(124), {SEED}, basket_id)', mod='len(items)')}] AS held_out, items FROM tb WHERE len(items) >= 2),
    q AS (SELECT basket_id, held_out, list_filter(items, lambda x: x <> held_out) AS query FROM tr)"""
POPULAR = f"""pop AS (SELECT item, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, item) AS rank FROM (SELECT DISTINCT basket_id, item FROM b) GROUP BY item),
    pp AS (SELECT basket_id, held_out, item, ROW_NUMBER() OVER (PARTITION BY basket_id ORDER BY rank) AS place FROM q, pop WHERE NOT list_contains(query, item) QUALIFY place <= {TOP_K})"""
METRICS = """hits AS (SELECT 'rules' AS recommender, q.basket_id, MIN(CASE WHEN item = held_out THEN place END) AS place, COUNT(item) > 0 AS anything FROM q LEFT JOIN ranked USING (basket_id) GROUP BY ALL
      UNION ALL SELECT 'popularity', q.basket_id, MIN(CASE WHEN item = q.held_out THEN place END), COUNT(item) > 0 FROM q LEFT JOIN pp USING (basket_id) GROUP BY ALL),
    met AS (SELECT recommender, k::BIGINT AS k, AVG(CASE WHEN place <= k THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate, AVG(coalesce(1.0::DOUBLE / place, 0)) AS mrr, AVG(CASE WHEN anything THEN 1.0::DOUBLE ELSE 0 END) AS coverage, COUNT(*) AS n_trials FROM hits, (VALUES (1), (3), (5)) t(k) GROUP BY ALL)"""
BACKTEST = [lines(T1), CUT, TRAINED, mined(T1), ruled(T1), TRIALS, APPLIED, RANKED, POPULAR, METRICS]
SPEND = """spend AS (SELECT customer_id, item, CAST(SUM(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS amount FROM lines GROUP BY ALL),
    tot AS (SELECT customer_id, CAST(SUM(CAST(amount AS DECIMAL(28,4))) AS DOUBLE) AS total FROM spend GROUP BY 1),
    sh AS (SELECT customer_id, item, round(CASE WHEN total = 0 THEN 0 ELSE amount / total END, 9) AS share FROM spend JOIN tot USING (customer_id))"""
GRID = f"""grid AS (SELECT cu.customer_id, it.item, coalesce(sh.share, 0) AS share FROM (SELECT DISTINCT customer_id FROM sh) cu CROSS JOIN (SELECT DISTINCT item FROM sh) it LEFT JOIN sh ON sh.customer_id = cu.customer_id AND sh.item = it.item),
    cen0 AS (SELECT dense_rank() OVER (ORDER BY customer_id) - 1 AS cluster, item, share FROM grid WHERE customer_id IN (SELECT DISTINCT customer_id FROM sh ORDER BY 1 LIMIT {CLUSTERS}))"""


def lloyd(step: int) -> str:
    return f"""dist{step} AS (SELECT customer_id, cluster, round(SUM((g.share - c.share) * (g.share - c.share)), 12) AS d FROM grid g JOIN cen{step} c USING (item) GROUP BY ALL),
    asg{step} AS (SELECT customer_id, cluster, d FROM dist{step} QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY d, cluster) = 1),
    cen{step + 1} AS (SELECT cluster, item, CAST(SUM(CAST(share AS DECIMAL(28,12))) AS DOUBLE) / COUNT(*) AS share FROM grid JOIN asg{step} USING (customer_id) GROUP BY ALL)"""


EDGES = """e AS (SELECT x.items[1] AS item_a, x.items[2] AS item_b, x.support, x.cnt AS support_count, x.support / (a.support * b.support) AS lift, x.support - a.support * b.support AS leverage FROM fi x JOIN fi a ON a.size = 1 AND a.items[1] = x.items[1] JOIN fi b ON b.size = 1 AND b.items[1] = x.items[2] WHERE x.size = 2),
    ed AS (SELECT *, lift - 1 AS weight FROM e WHERE lift >= 1),
    en AS (SELECT item_a AS item, weight FROM ed UNION ALL SELECT item_b, weight FROM ed)"""
#: The greedy merges one by one, from single items on; the last step's communities by falling size and then by members.
MERGED = """grow AS (SELECT 0 AS step, (SELECT list([items[1]] ORDER BY items[1]) FROM fi WHERE size = 1) AS cs
    UNION ALL SELECT step + 1, list_append(list_filter(cs, lambda c: c <> a AND c <> b), list_sort(list_concat(a, b))) FROM (
      WITH mb AS (SELECT c, unnest(c) AS item FROM (SELECT unnest(cs) AS c FROM grow)),
      k AS (SELECT c, SUM(weight) AS s FROM mb JOIN en USING (item) GROUP BY c),
      w AS (SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, SUM(weight) AS w FROM ed JOIN mb x ON x.item = item_a JOIN mb y ON y.item = item_b WHERE x.c <> y.c GROUP BY ALL),
      g AS (SELECT a, b, w / m - ka.s * kb.s / (2 * m * m) AS gain FROM w JOIN k ka ON ka.c = a JOIN k kb ON kb.c = b, (SELECT SUM(weight) AS m FROM ed))
      SELECT step, cs, a, b FROM grow, g WHERE gain > 1e-12 AND gain >= (SELECT MAX(gain) FROM g) - 1e-12 ORDER BY a, b LIMIT 1)),
    com AS (SELECT c, (ROW_NUMBER() OVER (ORDER BY len(c) DESC, c) - 1)::INTEGER AS id FROM (SELECT unnest(cs) AS c FROM (SELECT cs FROM grow ORDER BY step DESC LIMIT 1))),
    cm AS (SELECT unnest(c) AS item, id FROM com),
    kind AS (SELECT ed.*, a.id AS community_a, b.id AS community_b, CASE WHEN a.id = b.id THEN 'internal' ELSE 'bridge' END AS kind FROM ed JOIN cm a ON a.item = item_a JOIN cm b ON b.item = item_b),
    stat AS (SELECT com.id AS community_id, c AS members, len(c)::BIGINT AS n, COUNT(k.lift) AS n_edges, coalesce(AVG(k.lift), 0) AS mean_lift, coalesce(MAX(k.lift), 0) AS max_lift, arg_max(k.item_a || ' + ' || k.item_b, k.lift) AS top_pair
      FROM com LEFT JOIN kind k ON k.kind = 'internal' AND k.community_a = com.id GROUP BY ALL),
    grp AS (SELECT COUNT(*) FILTER (len(c) > 1) AS n_communities, coalesce(SUM(len(c)) FILTER (len(c) > 1), 0)::BIGINT AS n_grouped, COUNT(*) FILTER (len(c) = 1) AS n_isolated FROM com)"""
PARITY = "mem AS (SELECT items[1] AS item, (CAST(regexp_extract(items[1], '[0-9]+') AS BIGINT) % 3) AS community_id FROM fi WHERE size = 1)"


def network(select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([lines(T1), ALL, mined(T1), EDGES, MERGED]) + "\n" + select


BY_GIVEN = "b AS (SELECT DISTINCT basket_id % 3 * 10 AS split_id, basket_id, item, 1::BIGINT AS w FROM lines)"
SEGMENTS = f"""seg AS (SELECT cluster, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, cluster) - 1 AS segment FROM asg3 GROUP BY cluster),
    prof AS (SELECT segment, n, n::DOUBLE / SUM(n) OVER () AS share, mean_total, top_items FROM seg JOIN (SELECT cluster, AVG(total) AS mean_total FROM asg3 JOIN tot USING (customer_id) GROUP BY 1) USING (cluster)
      JOIN (SELECT cluster, string_agg(printf('%s %.3f', item, share), ', ' ORDER BY r) AS top_items FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY share DESC, item) AS r FROM cen3) WHERE r <= 3 GROUP BY 1) USING (cluster))"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["basket_lines"] = sql(lines(T1), select="SELECT basket_id, customer_id, item, amount FROM lines")
    q["baskets_as_sets"] = sql(lines(T1), BASKETS, select="SELECT basket_id, array_to_string(query, ' + ') AS items, len(query)::BIGINT AS size FROM q")
    q["basket_size_histogram"] = sql(lines(T1), BASKETS, select="SELECT len(query)::BIGINT AS size, COUNT(*) AS n FROM q GROUP BY 1")
    q["item_support"] = items(T1, "SELECT items[1] AS item, cnt, support FROM fi WHERE size = 1")
    q["popularity_ranking"] = items(T1, "SELECT items[1] AS item, cnt, ROW_NUMBER() OVER (ORDER BY cnt DESC, items[1])::BIGINT AS rank FROM c WHERE size = 1")
    for k in (1, 2, 3):
        q[f"frequent_itemsets_k{k}"] = items(T1, f"{SETS} WHERE size = {k}")
    q["frequent_itemsets_all"] = q["frequent_itemsets_vertical"] = q["frequent_itemsets_growth"] = q["frequent_itemsets_fpgrowth"] = q["frequent_itemsets_join"] = items(T1, SETS)
    q["candidate_triples_pruned"] = items(T1, "SELECT x.items[1] || ' + ' || x.items[2] || ' + ' || y.items[2] AS itemset FROM fi x JOIN fi y ON x.size = 2 AND y.size = 2 AND x.items[1] = y.items[1] AND x.items[2] < y.items[2] JOIN fi z ON z.size = 2 AND z.items[1] = x.items[2] AND z.items[2] = y.items[2]")
    q["rules_all"] = rule(T3, RULES)
    q["rules_filtered"] = rule(T1, RULES)
    q["rules_ranked_top20"] = rule(T1, f"{RULES} WHERE rank <= 20")
    q["rules_multi_consequent"] = rule(T2, f"{RULES} WHERE len(c) > 1")
    q["thin_rule_flags"] = rule(T4, RULES)
    q["rule_counts_by_size"] = rule(T1, "SELECT len(a)::BIGINT AS n_antecedent, len(c)::BIGINT AS n_consequent, COUNT(*) AS n FROM r GROUP BY ALL")
    q["closed_itemsets"] = sql(lines(T4), ALL, mined(T4), COVERED, select="SELECT label AS itemset, cnt FROM cov WHERE above IS NULL OR above < cnt")
    q["maximal_itemsets"] = sql(lines(T4), ALL, mined(T4), COVERED, select="SELECT label AS itemset, cnt FROM cov WHERE above IS NULL")
    verdict = "SELECT rank::BIGINT AS rank, antecedent, consequent, array_to_string(ba, ' + ') AS best_antecedent, bc AS best_confidence, confidence - bc AS improvement, confidence - bc <= 1e-9::DOUBLE AS redundant FROM best"
    q["rule_improvement"] = rule(T3, verdict, IMPROVED)
    q["redundancy_verdicts"] = rule(T4, verdict, IMPROVED)
    q["redundancy_summary"] = rule(T4, "SELECT (SELECT COUNT(*) FROM cov) AS n_itemsets, (SELECT COUNT(*) FROM cov WHERE above IS NULL OR above < cnt) AS n_closed, (SELECT COUNT(*) FROM cov WHERE above IS NULL) AS n_maximal, COUNT(*) AS n_rules, COUNT(*) FILTER (confidence - bc <= 1e-9::DOUBLE) AS n_redundant, COUNT(*) FILTER (NOT confidence - bc <= 1e-9::DOUBLE) AS n_kept FROM best", IMPROVED, COVERED)
    q["rules_kept_by_improvement"] = rule(T4, "SELECT ROW_NUMBER() OVER (ORDER BY confidence - bc DESC, antecedent, consequent)::BIGINT AS place, antecedent, consequent, confidence - bc AS improvement FROM best WHERE NOT confidence - bc <= 1e-9::DOUBLE", IMPROVED)
    q["recommendations_top10"] = rule(T1, "SELECT rank::BIGINT AS rank, antecedent, consequent, lift, confidence, round(value, 6) AS value FROM val WHERE NOT thin ORDER BY rank LIMIT 10", PRICES, VALUED)
    q["incremental_value"] = rule(T3, "SELECT rank::BIGINT AS rank, antecedent, consequent, round(value, 6) AS value FROM val", PRICES, VALUED)
    q["applicable_rules_for_baskets"] = rule(T3, "SELECT basket_id, rank::BIGINT AS rank, antecedent, consequent FROM ap", BASKETS, APPLIED)
    q["ranked_cross_sell"] = rule(T3, "SELECT basket_id, item, place::BIGINT AS place FROM ranked", BASKETS, APPLIED, RANKED)
    q["next_best_product"] = rule(T3, "SELECT basket_id, antecedent, consequent, lift, round(value, 6) AS value FROM (SELECT basket_id, query, val.* FROM q JOIN val ON list_has_all(query, a) AND NOT list_has_any(query, c) WHERE NOT thin) QUALIFY ROW_NUMBER() OVER (PARTITION BY basket_id ORDER BY rank) = 1", PRICES, VALUED, BASKETS)
    q["arrival_position"] = sql(lines(T1), select="SELECT basket_id, pos::BIGINT AS pos FROM pos")
    q["arrival_position_text"] = sql(lines(T1), select="SELECT id AS basket_id, ROW_NUMBER() OVER (ORDER BY id) - 1 AS pos FROM (SELECT DISTINCT 'order ' || basket_id AS id FROM lines)")
    q["time_windows"] = sql(lines(T1), WINDOW, select="SELECT basket_id, pos::BIGINT AS pos, split_id FROM win")
    q["train_test_split"] = sql(lines(T1), CUT, select="SELECT basket_id, pos::BIGINT AS pos, is_train FROM cut")
    q["fold_itemsets_growth"] = sql(lines(T1), DRAWS, BY_FOLD, mined(T1), select=SETS.replace("SELECT", "SELECT split_id,", 1))
    q["split_rules_time_window"] = q["split_rules_growth"] = sql(lines(T1), WINDOW, BY_WINDOW, mined(T1), ruled(T1, 0), select="SELECT split_id, antecedent, consequent, cnt AS support_count, confidence, lift FROM r")
    q["rule_stability_time_window"] = stable([WINDOW, BY_WINDOW], WINDOWS, "SELECT * FROM st")
    q["stability_summary"] = stable([WINDOW, BY_WINDOW], WINDOWS, "SELECT COUNT(*) AS n_rules, COUNT(*) FILTER (stable) AS n_stable, MIN(n_present) AS least_present FROM st")
    q["bootstrap_draws"] = sql(lines(T1), DRAWS, select="SELECT split_id, pos, COUNT(*)::BIGINT AS weight FROM draws GROUP BY ALL")
    q["rule_stability_bootstrap"] = stable([DRAWS, BY_FOLD], FOLDS, "SELECT * FROM st")
    q["rule_stability_given_splits"] = stable([BY_GIVEN], 3, "SELECT * FROM st")
    q["holdout_trials"] = sql(lines(T1), CUT, TRIALS, select="SELECT basket_id, array_to_string(query, ' + ') AS query, held_out FROM q")
    q["popularity_predictions"] = sql(lines(T1), CUT, TRAINED, TRIALS, POPULAR, select="SELECT basket_id, string_agg(item, ' > ' ORDER BY place) AS predictions FROM pp GROUP BY 1")
    q["backtest_hit_rates"] = sql(*BACKTEST, select="SELECT recommender, k, round(hit_rate, 9) AS hit_rate, n_trials FROM met")
    q["backtest_mrr_coverage"] = sql(*BACKTEST, select="SELECT DISTINCT recommender, round(mrr, 9) AS mrr, round(coverage, 9) AS coverage, n_trials FROM met")
    q["backtest_ratio"] = sql(*BACKTEST, select="SELECT a.k, round(CASE WHEN b.hit_rate = 0 THEN 0 ELSE a.hit_rate / b.hit_rate END, 6) AS hit_ratio, round(CASE WHEN b.mrr = 0 THEN 0 ELSE a.mrr / b.mrr END, 6) AS mrr_ratio FROM met a JOIN met b ON a.k = b.k AND a.recommender = 'rules' AND b.recommender = 'popularity'")
    q["spend_matrix"] = sql(lines(T3), SPEND, select="SELECT customer_id, item, amount FROM spend")
    q["spend_shares"] = sql(lines(T1), SPEND, select="SELECT customer_id, item, share FROM sh")
    q["customer_totals"] = sql(lines(T1), SPEND, select="SELECT customer_id, total FROM tot")
    q["kmeans_assign_step"] = sql(lines(T3), SPEND, GRID, lloyd(0), select="SELECT customer_id, cluster::BIGINT AS cluster, round(d, 6) AS d2 FROM asg0")
    q["kmeans_lloyd_fixed"] = sql(lines(T3), SPEND, GRID, lloyd(0), lloyd(1), lloyd(2), select="SELECT cluster::BIGINT AS cluster, item, round(share, 6) AS share FROM cen3")
    q["segments_from_fixed_starts"] = sql(lines(T3), SPEND, GRID, *map(lloyd, range(4)), SEGMENTS, select="SELECT customer_id, segment::BIGINT AS segment FROM asg3 JOIN seg USING (cluster)")
    q["segment_profiles_from_fixed_starts"] = sql(lines(T3), SPEND, GRID, *map(lloyd, range(4)), SEGMENTS, select="SELECT segment::BIGINT AS segment, n, round(share, 9) AS share, round(mean_total, 4) AS mean_total, top_items FROM prof")
    q["affinity_communities"] = network("SELECT item, id AS community_id FROM cm")
    q["community_stats"] = network("SELECT community_id, members, n, n_edges, round(mean_lift, 6) AS mean_lift, max_lift, top_pair FROM stat")
    q["bridges"] = network("SELECT item_a, item_b, support, support_count, lift, leverage, weight, community_a, community_b, kind FROM kind WHERE kind = 'bridge'")
    q["community_grouping"] = network("SELECT * FROM grp")
    q["isolated_items"] = network("SELECT c[1] AS item FROM com WHERE len(c) = 1")
    q["network_backbone"] = sql(lines(T1), ALL, mined(T1), EDGES, select=f"""SELECT DISTINCT item_a, item_b, lift, weight FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY e ORDER BY weight DESC, item_a, item_b) AS r FROM
      (SELECT ed.*, unnest([item_a, item_b]) AS e FROM ed WHERE item_a IN (FROM top) AND item_b IN (FROM top))) WHERE r <= {TOP_K}""".replace("(FROM top)", f"(SELECT item FROM en GROUP BY item ORDER BY SUM(CAST(weight AS DECIMAL(28,15))) DESC, item LIMIT {TOP_N})"))
    q["affinity_edges"] = sql(lines(T1), ALL, mined(T1), EDGES, select="SELECT item_a, item_b, support, support_count, lift, leverage, weight FROM ed")
    q["node_strength"] = sql(lines(T1), ALL, mined(T1), EDGES, select="SELECT item, CAST(SUM(CAST(weight AS DECIMAL(28,15))) AS DOUBLE) AS strength FROM en GROUP BY 1")
    q["modularity_fixed_partition"] = sql(lines(T1), ALL, mined(T1), EDGES, PARITY, select="""SELECT round(SUM(coalesce(w, 0) / m - (d / (2 * m)) * (d / (2 * m))), 9) AS q FROM
      (SELECT community_id, SUM(weight) AS d FROM en JOIN mem USING (item) GROUP BY 1) deg LEFT JOIN
      (SELECT a.community_id, SUM(weight) AS w FROM ed JOIN mem a ON a.item = item_a JOIN mem b ON b.item = item_b WHERE a.community_id = b.community_id GROUP BY 1) ins USING (community_id), (SELECT SUM(weight) AS m FROM ed)""")
    q["pair_lift_matrix"] = sql(lines(T1), ALL, mined(T1), select="""SELECT x.items[1] AS item_a, y.items[1] AS item_b, coalesce(p.cnt::DOUBLE / n.n, 0) / ((x.cnt::DOUBLE / n.n) * (y.cnt::DOUBLE / n.n)) AS lift FROM c x JOIN c y ON x.size = 1 AND y.size = 1 AND x.items <> y.items
      LEFT JOIN c p ON p.size = 2 AND p.items = list_sort([x.items[1], y.items[1]]), n""")
    four = lambda *names: ", ".join(f"round({n}, 4) AS {n}" for n in names)
    q["readout_itemsets"] = items(T4, f"SELECT label AS itemset, size::BIGINT AS size, cnt AS support_count, {four('support')} FROM fi")
    q["readout_redundancy"] = rule(T4, """SELECT best.rank::BIGINT AS rank, best.antecedent, best.consequent, CASE WHEN bs = 0 THEN 'baseline' ELSE array_to_string(ba, ' + ') END AS best_simpler, round(best.confidence, 4) AS confidence, round(bc, 4) AS best_confidence,
      round(best.confidence - bc, 4) + 0 AS improvement, round(r.lift, 4) AS lift, r.cnt AS support_count, CASE WHEN best.confidence - bc <= 1e-9::DOUBLE THEN 'redundant' ELSE 'kept' END AS verdict, above IS NULL OR above < cov.cnt AS closed, above IS NULL AS maximal
      FROM best JOIN r ON r.rank = best.rank JOIN cov ON cov.label = array_to_string(list_sort(list_concat(best.a, best.c)), ' + ')""", IMPROVED, COVERED)
    wide = """wide AS (SELECT recommender, MAX(hit_rate) FILTER (k = 1) AS hit_at_1, MAX(hit_rate) FILTER (k = 3) AS hit_at_3, MAX(hit_rate) FILTER (k = 5) AS hit_at_5, MAX(mrr) AS mrr, MAX(coverage) AS coverage, MAX(n_trials) AS n_trials FROM met GROUP BY 1)"""
    names = ("hit_at_1", "hit_at_3", "hit_at_5", "mrr", "coverage")
    q["readout_evaluation"] = sql(*BACKTEST, wide, select=f"SELECT recommender, {four(*names)}, n_trials FROM wide UNION ALL SELECT 'ratio', {', '.join(f'round(CASE WHEN b.{n} = 0 THEN 0 ELSE a.{n} / b.{n} END, 4)' for n in names)}, a.n_trials FROM wide a JOIN wide b ON a.recommender = 'rules' AND b.recommender = 'popularity'")
    q["planted_pairs"] = """WITH b AS (SELECT j, unnest(range(2 + j % 2)) AS k FROM range(6) t(j))
      SELECT printf('good_%02d', 4 * x.j + x.k) AS item_a, printf('good_%02d', 4 * y.j + y.k) AS item_b FROM b x JOIN b y ON x.j = y.j AND x.k < y.k"""
    q["readout_stability"] = stable([WINDOW, BY_WINDOW], WINDOWS, f"""SELECT rank, antecedent, consequent, round(reference_lift, 4) AS reference_lift, round(reference_confidence, 4) AS reference_confidence, reference_count, {WINDOWS}::BIGINT AS n_splits, n_present, round(stability_score, 4) AS stability_score,
      {four('lift_mean', 'lift_std')}, round(CASE WHEN lift_mean = 0 THEN 0 ELSE lift_std / lift_mean END, 4) AS lift_cv, {four('lift_min', 'lift_max')}, stable FROM exact""").replace(STABLE.format(k=WINDOWS), STABLE.format(k=WINDOWS) + f""",
    exact AS (SELECT rank::BIGINT AS rank, antecedent, consequent, lift AS reference_lift, confidence AS reference_confidence, cnt AS reference_count, COUNT(seen) AS n_present, coalesce(AVG(seen), 0) AS lift_mean, coalesce(stddev_pop(seen), 0) AS lift_std, coalesce(MIN(seen), 0) AS lift_min, coalesce(MAX(seen), 0) AS lift_max,
      COUNT(seen)::DOUBLE / {WINDOWS} AS stability_score, COUNT(seen) >= {WINDOWS} AS stable FROM seen GROUP BY ALL)""")
    q["readout_edges"] = network(f"SELECT item_a, item_b, {four('support')}, support_count, {four('lift', 'leverage', 'weight')}, community_a, community_b, kind FROM kind")
    q["readout_lift"] = network(f"""SELECT a.place AS place_a, b.place AS place_b, x.items[1] AS item_a, y.items[1] AS item_b, round(coalesce(p.cnt::DOUBLE / n.n, 0) / ((x.cnt::DOUBLE / n.n) * (y.cnt::DOUBLE / n.n)), 4) AS lift FROM c x JOIN c y ON x.size = 1 AND y.size = 1 AND x.items <> y.items
      LEFT JOIN c p ON p.size = 2 AND p.items = list_sort([x.items[1], y.items[1]]) LEFT JOIN pl a ON a.item = x.items[1] LEFT JOIN pl b ON b.item = y.items[1], n""").replace("grp AS (", "pl AS (SELECT item, (ROW_NUMBER() OVER (ORDER BY id, item))::INTEGER AS place FROM cm),\n    grp AS (")
    q["readout_evaluation_narrative"] = sql(*BACKTEST, select="""SELECT 'evaluation' AS topic, printf('Of %d held-out items rules name %.1f%% among 5 suggestions, and the most popular items %.1f%%.', MAX(n_trials), MAX(100 * hit_rate) FILTER (recommender = 'rules' AND k = 5), MAX(100 * hit_rate) FILTER (recommender = 'popularity' AND k = 5)) AS text FROM met""")
    q["readout_network_narrative"] = network("""SELECT 'network' AS topic, printf('%d pairs of items attract each other. They make %d communities with %d bridges between; %d items stand alone.', (SELECT COUNT(*) FROM kind), n_communities, (SELECT COUNT(*) FROM kind WHERE kind = 'bridge'), n_isolated) AS text FROM grp""")
    told = q["redundancy_summary"]
    q["readout_redundancy_narrative"] = f"SELECT 'redundancy' AS topic, printf('%d of %d rules add nothing to a simpler one and %d stay. Of %d frequent itemsets %d are closed and %d maximal.', n_redundant, n_rules, n_kept, n_itemsets, n_closed, n_maximal) AS text FROM ({told})"
    q["readout_stability_narrative"] = f"SELECT 'stability' AS topic, printf('%d of %d leading rules hold up across {WINDOWS} splits; the least steady one shows in %d.', n_stable, n_rules, least_present) AS text FROM ({q['stability_summary']})"
    return q
