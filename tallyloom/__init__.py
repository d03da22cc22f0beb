"""Co-purchase analytics on Spark: baskets, itemsets, rules, stability, recommendations, affinity graphs, segments."""
