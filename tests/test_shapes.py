"""Loops ranked and thinned, and hulls on a chart, against plain versions."""

import math
import random

from pyspark.sql import functions as F

from signalspark.functions import colour
from signalspark.operators.aggregates import chart_triangle, gamut_coverage
from signalspark.operators.joins import loop_scan, periods, ranked_loops


def picked(loops, least, most):
    kept = []
    for delta, source, repeat, n in sorted(loops, key=lambda x: (-x[3], x[0], x[2])):
        if len(kept) < most and not any(abs(repeat - k[2]) < least and abs(delta - k[0]) < least for k in kept):
            kept.append((delta, source, repeat, n))
    return [(*k, i) for i, k in enumerate(kept, 1)]


def test_ranked_loops_equal_the_plain_greedy(spark):
    rng = random.Random(3)
    rows = {m: sorted({(d, r - d, r, rng.randint(5, 12)) for d, r in ((rng.randint(20, 60), rng.randint(80, 160)) for _ in range(120))}) for m in range(4)}
    table = spark.createDataFrame([(m, *x, False) for m, xs in rows.items() for x in xs] + [(9, 10, 0, 10, 5, True)], "media long, delta long, source long, repeat long, n long, periodic boolean").repartition(7)
    for least, most in ((5, 20), (1, 1000), (12, 1000), (200, 20)):
        got = {m: [] for m in rows}
        for r in ranked_loops(table, ["media"], least, most).collect():
            got[r.media].append((r.delta, r.source, r.repeat, r.n, r.rank))
        assert {m: sorted(g, key=lambda x: x[4]) for m, g in got.items()} == {m: picked(xs, least, most) for m, xs in rows.items()}
    assert ranked_loops(table.limit(0), ["media"], 5).count() == 0


def test_overlapping_loops_give_one_and_a_cycle_a_period(spark):
    rng = random.Random(5)
    clip = [rng.getrandbits(62) for _ in range(40)]
    other = lambda n: [rng.getrandbits(62) for _ in range(n)]
    once = other(30) + clip + other(50) + clip + other(20)
    cycle = [rng.getrandbits(62) for _ in range(30)] * 6
    frames = spark.createDataFrame([(1, i, h) for i, h in enumerate(once)] + [(2, i, h) for i, h in enumerate(cycle)], "media long, frame long, h long")
    found = loop_scan(frames, ["media"], ["h"], least=10, tolerance=3)
    ranked = ranked_loops(found, ["media"], 10).filter("media = 1").collect()
    assert [(r.delta, r.source, r.repeat, r.n, r.rank) for r in ranked] == [(90, 30, 120, 40, 1)]
    assert periods(found, frames, ["media"], 10).filter("media = 1").count() == 0


def test_one_row_a_period(spark):
    loops = [(1, 30, 0, 30, 30, True), (1, 31, 40, 71, 20, True), (1, 60, 0, 60, 50, True), (1, 95, 0, 95, 5, False)]
    frames = spark.createDataFrame([(1, 179)], "media long, frame long")
    table = spark.createDataFrame(loops, "media long, delta long, source long, repeat long, n long, periodic boolean")
    got = [tuple(r) for r in periods(table, frames, ["media"], 10).orderBy("period").collect()]
    assert got == [(1, 30, 2, 33.3, 6.0), (1, 60, 1, 41.7, 3.0)]
    assert [r.period for r in periods(table, frames, ["media"], 10, most=1).collect()] == [60]


def hull_area(points):
    points = sorted(set(points))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for run in (points, points[::-1]):
        chain = []
        for p in run:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(chains, chains[1:] + chains[:1], strict=True))) / 2


def test_hull_area_equals_the_monotone_chain(spark):
    rng = random.Random(4)
    clouds = {1: [(rng.gauss(0.3, 0.05), rng.gauss(0.3, 0.1)) for _ in range(400)], 2: [(0.2, 0.2)], 3: [(0.1, 0.1), (0.5, 0.5)], 4: [(0.3, rng.random()) for _ in range(50)], 5: [(0.1 * i, 0.1 * i) for i in range(8)], 6: [(0.9, 2.0), (-1.0, 0.1), (0.4, 0.0)]}
    rows = [(m, x, y) for m, cloud in clouds.items() for x, y in cloud] + [(1, None, 0.3), (7, None, None)]
    table = spark.createDataFrame(rows, "media long, x double, y double").repartition(9)
    place = lambda v, top, flip: math.floor((255 - min(max(v / top, 0), 1) * 255) if flip else min(max(v / top, 0), 1) * 255)
    got = {r.media: r for r in gamut_coverage(table, ["media"], "x", "y", size=256).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and got[1].n == 400
    for m, cloud in clouds.items():
        want = hull_area([(place(x, 0.8, False), place(y, 0.9, True)) for x, y in cloud])
        assert abs(got[m].area - want) < 1e-6 and abs(got[m].coverage_pct - min(100, 100 * want / chart_triangle("2020", 256))) < 1e-6


def test_parts_merge_to_the_same_hull_and_the_triangle_is_whole(spark):
    corners = [(1, x, y) for x, y in colour.TRIANGLE["2020"]]
    rng = random.Random(6)
    inner = [(1, sum(w * c[1] for w, c in zip(ws, corners, strict=True)) / sum(ws), sum(w * c[2] for w, c in zip(ws, corners, strict=True)) / sum(ws)) for ws in ([rng.random() for _ in range(3)] for _ in range(300))]
    for parts in (1, 8):
        table = spark.createDataFrame(corners + inner, "media long, x double, y double").repartition(parts)
        assert gamut_coverage(table, ["media"], "x", "y").collect()[0].coverage_pct > 99.5
    only_709 = gamut_coverage(spark.createDataFrame([(1, x, y) for x, y in colour.TRIANGLE["709"]], "media long, x double, y double"), ["media"], "x", "y")
    assert 50 < only_709.select(F.round("coverage_pct", 3)).collect()[0][0] < 56
