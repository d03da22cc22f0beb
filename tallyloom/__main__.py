"""python -m tallyloom: an analysis of generated or given order lines, shown on the console or written as read-outs."""

from __future__ import annotations

import argparse
from dataclasses import fields

from .plans import readouts
from .session import session
from .sources import from_table, from_tpch, synthetic_lines

SHOWN = {"rules": 10, "redundancy": 3, "segments": 10, "recommendations": 3, "communities": 10, "edges": 3, "stability": 3, "evaluation": 3, "narrative": 4}


def options() -> argparse.ArgumentParser:
    """Where lines come from and what is shown, and an option for each field of ``Plan`` with its default."""
    p = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    p.add_argument("--orders", help="folder of the order tables; else lines are generated")
    p.add_argument("--lines", help="parquet table with basket_id, item, customer_id and amount")
    p.add_argument("--item", default="p_brand", help="column of part that is the item of --orders")
    p.add_argument("--readouts", help="folder to write to; else the heads of tables are shown")
    p.add_argument("--baskets", type=int, default=6000)
    p.add_argument("--customers", type=int, default=420)
    p.add_argument("--top", type=int, default=10, help="rules to show")
    p.add_argument("--master")
    for f in fields(readouts.Plan):
        many = isinstance(f.default, tuple)
        p.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default[0] if many else f.default), nargs="+" if many else None, default=f.default)
    return p


def plan_of(a: argparse.Namespace) -> readouts.Plan:
    found = {f.name: getattr(a, f.name) for f in fields(readouts.Plan)}
    return readouts.Plan(**{name: tuple(x) if isinstance(x, list) else x for name, x in found.items()})


def main(argv: list[str] | None = None) -> None:
    a = options().parse_args(argv)
    local = {"spark__sql__shuffle__partitions": "8", "spark__driver__memory": "4g"} if (a.master or "").startswith("local") else {}
    spark = session(master=a.master, **local)
    if a.orders:
        lines = from_tpch(spark, a.orders, a.item)
    elif a.lines:
        lines = from_table(spark.read.parquet(a.lines), "basket_id", "item", "customer_id", "amount")
    else:
        lines = synthetic_lines(spark, a.baskets, a.customers, a.seed)
    plan = plan_of(a)
    if a.readouts:
        for name, n in readouts.write(lines, a.readouts, plan).items():
            print(f"{name}: {n} rows")
        return
    found = readouts.tables(lines, plan)
    for name, n in SHOWN.items():
        if name in found:
            print(name)
            readouts.in_order(name, found[name]).show(a.top if name == "rules" else n, truncate=False)


if __name__ == "__main__":
    main()
