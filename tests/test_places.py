"""People who share places, boxes that repeat."""

import math
from collections import Counter

from throngline.operators import crowd, heat


def test_many_people_on_few_places(spark):
    """4,000 people a place: 12,000 people give 72 million pairs, but nine pairs of places."""
    spots = ((0.5, 0.5), (1.25, 0.5), (2.0, 0.5))
    rows = [(0, i, *spots[i % 3]) for i in range(12_000)] + [(1, 7, 0.5, 0.5), (1, 8, None, 0.5)]
    found = crowd.local_density(spark.createDataFrame(rows, "frame long, id long, x double, y double"))
    assert "people" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["frame"], r["id"]): round(r["density"] * math.pi) for r in found.collect()}
    assert Counter((got[0, i], i % 3) for i in range(12_000)) == {(8000, 0): 4000, (12_000, 1): 4000, (8000, 2): 4000}
    assert got[1, 7] == got[1, 8] == 1 and len(got) == 12_002


def test_equal_boxes_are_drawn_once(spark):
    """Patches across tiles and borders against plain loops; pixels meet without a shuffle of their own."""
    rows = [(0, i, 127.5, 130.2, 20.0, 30.0) for i in range(300)] + [(0, 300, 3.0, 3.0, 9.0, 9.0), (1, 301, 255.9, 0.0, 40.0, 41.0), (1, 302, 300.0, 5.0, 9.0, 9.0)]
    found = heat.splat(spark.createDataFrame(rows, "frame long, box long, cx double, cy double, w double, h double"), 256, 160)
    want = Counter()
    for frame, _, cx, cy, w, h in rows:
        sigma, ix, iy = max(2.0, min(w, h) / 4), int(cx), int(cy)
        r = int(3 * sigma)
        g = {(x, y): math.exp(-((x - ix) ** 2 + (y - iy) ** 2) / (2 * sigma * sigma)) for x in range(max(ix - r, 0), min(ix + r, 255) + 1) for y in range(max(iy - r, 0), min(iy + r, 159) + 1)} if ix < 256 else {}
        for (x, y), v in g.items():
            want[frame, x, y] += v / sum(g.values())
    got = {(r["frame"], r["x"], r["y"]): r["mass"] for r in found.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_pairs_of_people_on_few_places(spark):
    """All pairs, of parts of one place too; a distance is worked out once for a pair of places."""
    spots = ((0.5, 0.5), (1.25, 0.5), (2.0, 0.5), (0.75, 1.25), (-0.25, 0.75))
    rows = [(0, i, *spots[0 if i < 1100 else i % 5]) for i in range(1200)] + [(1, 1, 0.5, 0.5), (1, 2, None, 0.5)]
    found = crowd.neighbours(spark.createDataFrame(rows, "frame long, id long, x double, y double"), 1.0)
    want = {(0, p[1], q[1]) for n, p in enumerate(rows[:1200]) for q in rows[n + 1 : 1200] if math.hypot(p[2] - q[2], p[3] - q[3]) <= 1}
    got = [(r["frame"], r["a"], r["b"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()


def test_distances_are_rounded_before_pairs_are_made(spark):
    """A distance of two places is rounded below the explodes, and lists of people are never sent, however short they seem."""
    rows = [(0, i, i % 7 / 4, i % 5 / 4) for i in range(700)]
    found = crowd.neighbours(spark.createDataFrame(rows, "frame long, id long, x double, y double"), 1.0, digits=6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("round(") > plan.index("explode(aids") > plan.index("explode(bids")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(p[1], q[1], round(math.hypot(p[2] - q[2], p[3] - q[3]), 6)) for n, p in enumerate(rows) for q in rows[n + 1 :] if math.hypot(p[2] - q[2], p[3] - q[3]) <= 1}
    assert sorted((r["a"], r["b"], r["gap"]) for r in found.collect()) == sorted(want)
