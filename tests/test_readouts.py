"""Read-outs: every table is written, the same on every run, and charts and command line work."""

import csv
import glob
import math
import os
import subprocess
import sys
import xml.etree.ElementTree as ET

import pytest

from tallyloom import __main__
from tallyloom.plans import readouts
from tallyloom.sources import baskets_from_lists, synthetic_lines

SMALL = readouts.Plan(0.04, restarts=1, max_iter=2, windows=2, top_n=8)


def test_written_tables(spark, tmp_path):
    lines = synthetic_lines(spark, 600, 60, 42).coalesce(2)
    rows = readouts.write(lines, f"file://{tmp_path}/out", SMALL)
    assert set(rows) == set(readouts.ORDER) and min(rows.values()) > 0
    assert rows["redundancy"] == rows["rules"] and rows["segments"] == 3 and rows["evaluation"] == 3 and rows["narrative"] == 4 and rows["stability"] == 8
    found = spark.read.csv(f"{tmp_path}/out/rules", header=True)
    assert {r["thin_support"] for r in found.select("thin_support").collect()} <= {"yes", "no"}
    for name in ("redundancy", "stability", "evaluation", "network"):
        text = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/out/{name}.svg").collect())
        assert ET.fromstring(text).tag.endswith("svg")
    rows_of = lambda name: [r for part in sorted(glob.glob(f"{tmp_path}/out/{name}/part-*")) for r in csv.DictReader(open(part))]
    for name in ("rules", "redundancy", "recommendations", "stability"):
        ranks = [int(r["rank"]) for r in rows_of(name)]
        assert ranks == sorted(ranks) and len(set(ranks)) == len(ranks)
    keys = [(-int(r["support_count"]), r["itemset"]) for r in rows_of("itemsets")]
    assert keys == sorted(keys)
    keys = [(-float(r["lift"]), r["item_a"], r["item_b"]) for r in rows_of("edges")]
    assert keys == sorted(keys)
    for name, column, kind in (("communities", "community_id", int), ("segments", "segment", int), ("customers", "customer_id", str)):
        keys = [kind(r[column]) for r in rows_of(name)]
        assert keys == sorted(keys)
    places = [(int(r["place_a"]), int(r["place_b"])) for r in rows_of("lift")]
    assert places == sorted(places)
    assert spark.read.csv(f"{tmp_path}/out/customers", header=True).count() == lines.select("customer_id").distinct().count()


def test_nothing_to_report(spark, tmp_path):
    lines = baskets_from_lists(spark, ["a", "b", "a", "b"])
    with pytest.raises(RuntimeError, match="rules"):
        readouts.write(lines, f"file://{tmp_path}/none", SMALL)


def test_tables_without_customers(spark):
    found = readouts.tables(baskets_from_lists(spark, ["pq", "pq", "pqr", "p", "q", "pq", "r", "pr"]), readouts.Plan(0.01, 0.01, 0.01 + 1, thin=1, restarts=1, windows=2))
    assert "segments" not in found
    best = {(r["antecedent"], r["consequent"]): r for r in found["redundancy"].collect()}
    assert best["q + r", "p"]["best_simpler"] == "q" and math.isclose(best["q + r", "p"]["improvement"], 0.2)
    assert best["p", "q"]["best_simpler"] == "baseline" and best["q + r", "p"]["closed"] is True


def test_charts_escape_and_bound():
    drawn = ET.fromstring(readouts.bar_chart("a < b", [("x & y", float("inf"), True), ("z", -1.0, False), ("w", 2.0, True)]))
    widths = [float(r.get("width")) for r in drawn.iter("{http://www.w3.org/2000/svg}rect")]
    assert widths == [300.0, 0.0, 300.0]
    assert ET.fromstring(readouts.bar_chart("none", [])).get("height") == "44" and len(ET.fromstring(readouts.network_chart("none", [], []))) == 1


def test_options_are_the_fields_of_a_plan():
    assert __main__.plan_of(__main__.options().parse_args([])) == readouts.Plan()
    some = __main__.options().parse_args("--min-support 0.1 --ks 2 4 --top-n 7 --windows 3 --restarts 2".split())
    assert __main__.plan_of(some) == readouts.Plan(0.1, ks=(2, 4), top_n=7, windows=3, restarts=2)


def test_command_line():
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "tallyloom", "--master", "local[2]", "--baskets", "300", "--customers", "40", "--top", "2", "--help"], cwd=home, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0 and "--readouts" in done.stdout
