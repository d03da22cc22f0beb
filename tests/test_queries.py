"""Queries against their SQL on small order tables, where what they measure may be missing."""

import duckdb
import pandas as pd

import __spark_entry__ as entry


def tables(folder, parts, baskets):
    """Order tables of the given baskets, written to ``folder``; ``parts`` are rows of ``part`` by key."""
    folder.mkdir()
    lines = [(b, p, 10.0 + p, 0.0) for b, held in enumerate(baskets) for p in held]
    made = {
        "part": pd.DataFrame([(k, *names) for k, names in parts.items()], columns=["p_partkey", "p_brand", "p_type", "p_name"]),
        "orders": pd.DataFrame([(b, b % 7) for b in range(len(baskets))], columns=["o_orderkey", "o_custkey"]),
        "lineitem": pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_extendedprice", "l_discount"]),
    }
    for name, rows in made.items():
        rows.to_parquet(folder / f"{name}.parquet")
    return str(folder)


def by_sql(folder, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(entry.oracle_sql()[name]).fetchall()


def test_quality_of_a_partition_without_edges_or_weight(spark, tmp_path):
    parts = {k: (f"Brand#{k}", "T", f"p{k}") for k in range(1, 6)}
    for name, baskets in {"apart": [[1], [2], [3]], "certain": [[1, 2]] * 3, "usual": [[1, 2, 4], [1, 4], [2, 5], [3], [2, 3, 5], [1, 4, 5]]}.items():
        folder = tables(tmp_path / name, parts, baskets)
        got = entry.queries()["modularity_fixed_partition"](spark, folder).collect()
        assert str([tuple(r) for r in got]) == str(by_sql(folder, "modularity_fixed_partition"))
