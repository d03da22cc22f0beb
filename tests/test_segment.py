"""Customer segments: k-means against plain Python, and what it costs a step."""

import random
from decimal import ROUND_HALF_EVEN, Decimal

from tallyloom.operators import segment

POINTS = "customer_id string, x array<double>"


def plain(points, centres, max_iter, tol):
    """The same steps over rows in Python, with sums in decimals."""
    rounded = lambda v: Decimal(repr(v)).quantize(Decimal("1e-12"), ROUND_HALF_EVEN)

    def away(x, c):
        total = 0.0
        for a, b in zip(x, c):
            total += (a - b) * (a - b)
        return total

    dealt = lambda: [min((away(x, c), i) for i, c in enumerate(centres)) for _, x in points]
    for _ in range(max_iter):
        met, new = dealt(), []
        for i in range(len(centres)):
            mine = [x for (_, x), (_, at) in zip(points, met) if at == i]
            far = min(((-d, name, x) for (name, x), (d, _) in zip(points, met)))[2]
            new.append([float(sum(map(rounded, column))) / len(mine) for column in zip(*mine)] if mine else list(far))
        moved = sum((a - b) ** 2 for c, d in zip(new, centres) for a, b in zip(c, d))
        centres = new
        if moved <= tol:
            break
    return centres, float(sum(rounded(d) for d, _ in dealt()))


def test_every_start_ends_where_plain_steps_do(spark):
    rng = random.Random(4)
    shares = lambda: [round(rng.random() ** 2, 9) for _ in range(3)]
    points = [(f"c{i:03}", shares()) for i in range(90)] + [(f"t{i}", [2.0, 2.0, float(i % 2)]) for i in range(4)] + [("far", [4.5e6, -7.25, 0.0])]
    starts = [[shares() for _ in range(4)], [points[0][1]] * 4, [points[0][1], points[0][1], [2.0, 2.0, 0.5], points[5][1]], [[9e6, 9e6, 9e6], *(shares() for _ in range(3))]]
    rng.shuffle(points)
    frame = spark.createDataFrame(points, POINTS).repartition(3)
    for max_iter, tol in ((1, -1.0), (3, -1.0), (200, 1e-10)):
        assert segment.lloyd_all(frame, starts, max_iter, tol) == [plain(points, s, max_iter, tol) for s in starts]


def test_plans_of_steps_do_not_grow_with_starts_and_empty_clusters_share_a_job(spark, monkeypatch):
    """Centres stood in the plan number by number, and each start with an empty cluster had a job of its own."""
    rng = random.Random(9)
    frame = spark.createDataFrame([(f"c{i}", [rng.random(), rng.random()]) for i in range(60)], POINTS).coalesce(2)
    told, lit = [], segment.F.lit
    monkeypatch.setattr(segment.F, "lit", lambda v: told.append(v) or lit(v))
    segment.lloyd_all(frame, [[[rng.random(), rng.random()] for _ in range(3)] for _ in range(5)], 6, -1.0)
    assert len(told) < 6 * 5
    spark.sparkContext.setJobGroup("empty", "empty clusters")
    segment.lloyd_all(frame, [[[0.5, 0.5], [9.0, 9.0 + i], [-9.0, 0.0]] for i in range(12)], 1, -1.0)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("empty"))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs < 12


def test_segments_read_their_lines_once(spark):
    """The lines were read for the spend, again for its totals, and again for the profiles."""
    rows = [(c, i, float(1 + (c * 7 + i) % 11)) for c in range(40) for i in range(4) if (c + i) % 3]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = "customer_id long, item string, amount double"
    lines = spark.createDataFrame([(c, f"i{i}", a) for c, i, a in rows], schema).mapInArrow(counted, schema)
    assigned, profiles, _ = segment.segment_customers(lines, [f"i{i}" for i in range(4)], 2, n_init=2, max_iter=3)
    held = {r["customer_id"]: r["segment"] for r in assigned.collect()}
    spent = {c: sum(a for d, _, a in rows if d == c) for c in held}
    for r in profiles.collect():
        mine = [spent[c] for c, at in held.items() if at == r["segment"]]
        assert (r["n"], r["share"], r["mean_total"]) == (len(mine), len(mine) / len(held), round(sum(mine) / len(mine), 6))
    assert read.value == len(rows)
