"""Work along one order in blocks, against plain loops: numbers, medians, windows, epochs, alert segments, components, publication."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from throngline.config import DEFAULT_SCENE, Region, Scene, Thresholds, box
from throngline.operators import alerts, epochs, flow, heat, prefix, risk, select
from throngline.plans import queries
from throngline.sources import bridge
from throngline.sources.stored import Steps

TH = Thresholds()
SMALL = "/root/testdata/sf0.001"
LEVEL = "zone_id string, t double, risk string, headline string, ttc double, detail string"
OBS = "zone_id string, ordinal int, frame long, t double, density double, count double, speed double, heading double, variance double"


def test_prefix_against_loops(spark):
    """Keys of uneven length (one null), blocks without rows, one block alone."""
    rnd = random.Random(4)
    rows = [(k, float(t), rnd.randrange(5)) for k, n in (("a", 60), ("b", 1), (None, 25)) for t in rnd.sample(range(300), n)]
    d = spark.createDataFrame(rows, "k string, t double, v long")
    for size in (7.0, 1000.0):
        block = F.floor(F.col("t") / size)
        out = prefix.running(d, block, ("t",), {"s": F.col("v")}, ("k",))
        out = prefix.numbered(out, block, ("t",), "n", ("k",))
        out = prefix.lagged(out, block, ("t",), F.col("v"), "was", ("k",))
        got = {(r["k"], r["t"]): (r["s"], r["n"], r["was"]) for r in out.collect()}
        for k in ("a", "b", None):
            total, was = 0, None
            for n, (_, t, v) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1])):
                total += v
                assert got[k, t] == (total, n, was)
                was = v
        assert len(got) == len(rows)
    assert prefix.numbered(d.limit(0), F.lit(0), ("t",), "n").count() == 0


def test_medians_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(select, "BINS", 4)  # so that several levels are needed
    rng = np.random.default_rng(0)
    groups = {0: rng.normal(size=501), 1: rng.normal(size=500), 2: np.r_[np.zeros(40), 1e300, -1e300], 3: np.array([2.5]), 4: np.array([1.0, 2.0]), 5: np.r_[rng.normal(size=300) * 1e-9, rng.normal(size=301) * 1e9], 6: rng.integers(0, 3, 200).astype(float)}
    rows = [(k, float(x), float(-x) if i % 3 else None) for k, v in groups.items() for i, x in enumerate(v)] + [(7, None, None), (7, math.nan, None), (3, math.nan, None)]
    got = {r["k"]: r for r in select.medians(spark.createDataFrame(rows, "k long, x double, y double"), "k", ("x", "y"), Steps(spark)).collect()}
    for k, v in groups.items():
        y = [-x for i, x in enumerate(v) if i % 3]
        assert got[k]["x"] == np.median(v) and got[k]["y"] == (np.median(y) if y else None)
    assert got[7]["x"] is None and got[7]["n"] == 2


def naive(rows, th=TH, ring=600):
    """rate and baseline of one zone's samples (t, density, speed) by their definition."""
    out = []
    for i, (t, _, _) in enumerate(rows):
        w = [r for r in rows[: i + 1] if r[0] >= t - th.trend_window_s][-ring:]
        base = float(np.percentile([r[2] for r in w], 75))
        if len(w) < 4 or w[-1][0] - w[0][0] < 5:
            out.append((0.0, base))
            continue
        d = [np.mean([x[1] for x in w[j - 2 : j + 1]]) for j in range(2, len(w))]
        x = np.array([r[0] for r in w[2:]]) - w[0][0]
        out.append((60 * float(np.polyfit(x, d, 1)[0]) if len(x) > 1 and np.ptp(x) > 0 else 0.0, base))
    return out


@pytest.mark.parametrize("ring", [600, 20])
def test_windows_over_blocks(spark, ring):
    """Irregular times over many blocks, pauses of several blocks; the ring bounds the window."""
    rnd, t, rows = random.Random(9), 1_000_000.0, []
    for i in range(700):
        t += 2500.0 if i in (200, 450) else rnd.choice((0.4, 1.0, 3.0, 11.0))
        rows.append((t, 2 + math.sin(i / 30), rnd.random()))
    d = spark.createDataFrame([("z", 0, i, t, d, 0.0, s, None, 0.0) for i, (t, d, s) in enumerate(rows)], OBS)
    got = sorted((r["t"], r["rate"], r["baseline"]) for r in risk.windowed(d, TH, ring).collect())
    for (t, *_), (rate, base), (at, grate, gbase) in zip(rows, naive(rows, ring=ring), got, strict=True):
        assert at == t and grate == pytest.approx(rate, abs=1e-7) and gbase == pytest.approx(base)


def test_smoothing_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(flow, "SMOOTH_BLOCK", 7)
    rnd = random.Random(2)
    v = [rnd.random() for _ in range(60)]
    d = spark.createDataFrame([(3 * i, "z", 0, x, x, None, x) for i, x in enumerate(v)], "frame long, zone_id string, ordinal int, speed double, variance double, heading double, coherence double")
    got = [r["speed"] for r in flow.smoothed(d).orderBy("frame").collect()]
    assert got == [float(np.median(v[max(0, i - 4) : i + 1])) for i in range(60)]


def test_one_zone_is_work_for_many_tasks(spark):
    """Windows and alerts of a single zone's long history are dealt over several partitions."""
    rows = [("z", 0, i, 1000.0 + i, 1.0, 0.0, 1.0, None, 0.0) for i in range(0, 20_000, 5)]
    d = risk.windowed(spark.createDataFrame(rows, OBS), TH)
    assert d.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and d.count() == len(rows)
    loud = [("z", 1000.0 + i, "amber" if i % 600 < 60 else "green", "density", None, "d") for i in range(0, 20_000, 5)]
    own = alerts.segments(spark.createDataFrame(loud, LEVEL), TH)
    assert own.select("segment").distinct().count() == 34 and own.count() == len(loud)


def folded_whole(rows, th):
    """The machine over each zone's whole history."""
    out = []
    for z in sorted({r[0] for r in rows}):
        m = alerts.Machine()
        for _, t, r, *_ in sorted((x for x in rows if x[0] == z), key=lambda x: x[1]):
            kind = alerts.advance(m, t, alerts.RANK[r], th)
            if kind:
                out.append((z, t, kind, m.first_seen, m.escalations, m.episode))
    return sorted(out)


@pytest.mark.parametrize("block", [200.0, 1e9])
def test_alert_segments_equal_the_whole_fold(spark, block):
    """Random levels in bursts and pauses around every timer; zones that never rest; pauses longer than a block sees."""
    th, rnd, rows = replace(TH, dwell_s=5.0, resolve_s=8.0, reassert_gap_s=20.0), random.Random(8), []
    for z in range(4):
        t = 1000.0
        while t < 26_000:
            quiet = rnd.choice((1, 6, 8, 9, 10, 27, 28, 29, 30, 60, 300)) if z else 3
            for n, levels in ((rnd.choice((2, 5, 6, 7, 30)), ("amber", "amber", "red")), (quiet, ("green",))):
                for _ in range(n):
                    rows.append((f"z{z}", t, rnd.choice(levels), "density", None, "d"))
                    t += rnd.choice((0.5, 1.0, 1.0, 2.0))
            t += rnd.choice((0, 0, 0, 40, 900))
    d = spark.createDataFrame(rows, LEVEL)
    log = alerts.events(d, th, block)
    got = sorted(tuple(r[c] for c in ("zone_id", "t", "kind", "first_seen", "escalations", "episode")) for r in log.collect())
    assert len(got) > 100 and got == folded_whole(rows, th)
    if block < 1e9:
        parts = {r["zone_id"]: r["count"] for r in alerts.segments(d, th, block).select("zone_id", "segment").distinct().groupBy("zone_id").count().collect()}
        assert parts["z1"] > 10


def test_alerts_of_one_time_follow_the_scene(spark):
    rows = [(z, 1000.0 + i, "amber", "density", None, "d") for z in ("a", "b", "c", "x") for i in range(40)]
    log = alerts.numbered(alerts.events(spark.createDataFrame(rows, LEVEL), TH), ("c", "a", "b"), start_seq=3)
    assert {r["zone_id"]: r["alert_id"] for r in log.collect()} == {"c": "a4", "a": "a5", "b": "a6", "x": "a7"}


FLOW = "frame long, x double, y double, dx double, dy double, weight double, mass double"


def test_epochs_do_not_mix(spark):
    """Each epoch alone gives the same figures; scenes of other regions and thresholds by epoch; changes before, between and after all frames."""
    rnd = random.Random(6)
    rows = [(f, rnd.uniform(0, 40), rnd.uniform(0, 40), rnd.uniform(-3, 3), rnd.uniform(-3, 3), 1.0, 30.0) for f in range(90) for _ in range(12)]
    samples = spark.createDataFrame(rows, FLOW)
    one = Scene("one", (40, 40), (Region("a", "A", box(0, 0, 20, 40), ("b",)), Region("b", "B", box(20, 0, 40, 40), ("a",))))
    two = Scene("two", (40, 40), (Region("a", "A", box(0, 0, 40, 20)),), thresholds=replace(TH, band_crowded=0.1, band_very_crowded=0.2))
    frames = spark.createDataFrame([(f, 1000.0 + f, f) for f in range(90)], "frame long, t double, n long")
    log = spark.createDataFrame([(900.0, "s"), (1030.0, "r"), (1030.5, "r"), (1030.7, "s"), (1060.0, "s"), (2000.0, "s"), (None, "s")], "t double, cause string")
    marked = epochs.numbered(frames, log, 20.0)
    at = {r["frame"]: (r["epoch"], r["opens"]) for r in marked.collect()}
    assert [at[f] for f in (0, 29, 30, 31, 59, 60, 89)] == [(1, True), (1, False), (2, True), (4, True), (4, False), (5, True), (5, False)]
    assert {r["epoch"]: r["cause"] for r in epochs.used(marked, log).select("epoch", "cause").distinct().collect()} == {1: "s", 2: "r", 4: "s", 5: "s"}
    marked = marked.withColumn("scene", F.when(F.col("epoch") == 4, "two").otherwise("one"))
    show = lambda df: sorted((r["frame"], r["zone_id"], r["risk"], round(r["density"], 9), round(r["rate"], 7), round(r["speed"], 9), round(r["baseline"], 9), r["heading"] and round(r["heading"], 7)) for r in df.collect())
    got = show(epochs.assessed(samples, marked, {"one": one, "two": two}))
    want = []
    for first, last, scene in ((0, 29, one), (30, 30, one), (31, 59, two), (60, 89, one)):
        part = samples.where(F.col("frame").between(first, last))
        part = part.withColumn("dx", F.when(F.col("frame") == first, 0.0).otherwise(F.col("dx"))).withColumn("dy", F.when(F.col("frame") == first, 0.0).otherwise(F.col("dy")))
        own = frames.where(F.col("frame").between(first, last))
        want += show(risk.assess(flow.observations(flow.zone_state(part, scene, scene.zones, own)), scene))
    assert got == sorted(want)
    assert epochs.numbered(frames, log.limit(0)).where("epoch <> 0").count() == 0


def test_flow_deals_no_samples(spark):
    """From the samples to the sums of zones and frames nothing but partial sums is exchanged."""
    samples = flow.remove_jitter(bridge.flow_samples(bridge.detections(bridge.events(spark, SMALL))))
    plan = samples._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert queries.QUERIES["zone_flow"](spark, SMALL).count() > 0


def test_both_forms_of_the_median_agree(spark, monkeypatch):
    samples = bridge.flow_samples(bridge.detections(bridge.events(spark, SMALL)))
    show = lambda: sorted((r["event_id"], r["static"], round(r["dx"], 9), round(r["dy"], 9)) for r in flow.remove_jitter(samples).collect())
    direct = show()
    monkeypatch.setattr(flow, "DIRECT", 0)
    assert show() == direct


def by_loops(cells):
    left, out = set(cells), {}
    while left:
        seen, todo = set(), [min(left)]
        while todo:
            x, y = todo.pop()
            if (x, y) in left and (x, y) not in seen:
                seen.add((x, y))
                todo += [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        out |= {c: min(seen) for c in seen}
        left -= seen
    return out


def test_components_of_random_cells(spark, monkeypatch):
    """Dense and thin grids, negative places, tiles of 4 cells, repeated cells, two frames."""
    monkeypatch.setattr(heat, "TILE", 4)
    rnd = random.Random(1)
    frames = {f: [(x, y) for x in range(-9, 21) for y in range(-7, 25) if rnd.random() < share] for f, share in ((0, 0.35), (1, 0.5))}
    rows = [(f, x, y, 1.0) for f, cells in frames.items() for x, y in cells]
    got = {(r["frame"], r["cx"], r["cy"]): (r["label_x"], r["label_y"]) for r in heat.labelled(spark.createDataFrame(rows + rows[:3], "frame long, cx long, cy long, pixels double"))[0].collect()}
    assert got == {(f, *c): label for f, cells in frames.items() for c, label in by_loops(cells).items()}


def test_a_long_path_takes_few_rounds(spark):
    cells = spark.createDataFrame([(0, i, i % 2, 1.0) for i in range(10_000)], "frame long, cx long, cy long, pixels double")
    own, rounds = heat.labelled(cells)
    assert own.select("label_x", "label_y").distinct().collect() == [(0, 0)] and own.count() == 10_000 and rounds < 20
    assert [r["cells"] for r in heat.blobs(cells).collect()] == [10_000]
    assert heat.blobs(cells.limit(0)).count() == 0


def test_mass_of_blobs(spark):
    """Two blobs of 2 x 2 and 3 x 4 dark cells: one person at least, else their area, spread evenly."""
    dark = {(x, y) for x in (2, 3) for y in (2, 3)} | {(x, y) for x in (8, 9, 10) for y in range(4, 8)}
    rows = [(0, x, y, 10.0 if (x, y) in dark else 100.0) for x in range(14) for y in range(12)]
    got = {(r["cx"], r["cy"]): r["mass"] for r in heat.blob_density(spark.createDataFrame(rows, "frame long, cx long, cy long, gray double"), 40.0, 6.0).collect()}
    # an opening by an even square moves what it leaves by one cell
    assert set(got) == {(x + 1, y + 1) for x, y in dark}
    assert {round(got[c], 9) for c in got if c[0] < 6} == {0.25} and {round(got[c], 9) for c in got if c[0] > 6} == {round(2 / 12, 9)}


@pytest.mark.parametrize("block", [13.0, 40.0, 1e9])
def test_publication_is_greedy(spark, block):
    """Irregular gaps, pauses over several blocks, gaps of exactly the interval."""
    rnd, t, times = random.Random(5), 500.0, []
    for _ in range(400):
        t += rnd.choice((0.25, 0.5, 1.0, 2.0, 5.0, 4.75, 90.0 if rnd.random() < 0.05 else 1.5))
        times.append(t)
    want, last = [], None
    for x in times:
        if last is None or x - last >= 5.0:
            want.append(x)
            last = x
    d = spark.createDataFrame([(x, i) for i, x in enumerate(times)] + [(times[3], 99), (None, 98)], "t double, i long")
    assert sorted(r["t"] for r in heat.throttled(d, 5.0, block).collect()) == want
    assert heat.throttled(d.limit(0), 5.0).count() == 0


def test_quantiles_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(select, "BINS", 8)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=333), "b": rng.exponential(size=50) ** 9, "c": np.array([4.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v]
    shares = {"lo": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.95, "hi": 1.0}
    got = {r["k"]: r for r in select.quantiles(spark.createDataFrame(rows, "k string, x double"), "k", {n: ("x", s) for n, s in shares.items()}, Steps(spark)).collect()}
    for k, v in groups.items():
        assert got[k]["n"] == len(v) and [got[k][n] for n in shares] == pytest.approx([float(np.quantile(v, s)) for s in shares.values()])


def test_carried_is_an_asof_join(spark):
    rnd = random.Random(3)
    rows = [(k, float(t), rnd.randrange(100) if rnd.random() < 0.2 else None) for k in "ab" for t in rnd.sample(range(2000), 120)]
    d = spark.createDataFrame(rows, "k string, t double, v long")
    got = {(r["k"], r["t"]): r["c"] for r in prefix.carried(d, F.floor(F.col("t") / 50), ("t",), F.col("v"), "c", ("k",)).collect()}
    for k in "ab":
        last = None
        for _, t, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            last = v if v is not None else last
            assert got[k, t] == last


@pytest.mark.parametrize("alpha", [0.2, 0.9])
def test_smoothed_rate_over_blocks(spark, monkeypatch, alpha):
    """One key with many blocks against the loop; gaps too short to count first, equal times, a key of one frame, a null key."""
    from throngline.operators import state

    monkeypatch.setattr(state, "EWMA_BLOCK", 16)
    rnd, t, times = random.Random(2), 50.0, [50.0, 50.001, 50.002]
    for _ in range(700):
        t += rnd.choice((0.005, 0.1, 0.5, 3.0, 700.0 if rnd.random() < 0.02 else 1.0))
        times.append(t + 0.01)
    times.append(times[300])
    fps, want = 0.0, []
    for i, x in enumerate(sorted(times)):
        gap = x - sorted(times)[i - 1] if i else 0.0
        now = 1 / gap if gap > 0.01 else 0.0
        fps = now if fps == 0 else fps + alpha * (now - fps)
        want.append(fps)
    d = spark.createDataFrame([("k", x) for x in times] + [("one", 1.0), (None, 1.0), (None, 3.0), ("k", None)], "key string, t double")
    out = state.rate_ewma(d, alpha, 128.0).collect()
    got = sorted((r["t"], i) for i, r in enumerate(out) if r["key"] == "k")
    assert sorted(out[i]["fps"] for _, i in got) == pytest.approx(sorted(want))
    assert [r["fps"] for r in out if r["key"] == "one"] == [0.0] and sorted(r["fps"] for r in out if r["key"] is None) == pytest.approx([0.0, 0.5])


def test_evidence_rules(spark):
    """Bad names, before the first capture, in time, replaced by a later capture, expired; served ones are audited."""
    from throngline.operators import evidence

    log = spark.createDataFrame([("a1", 5.0, "fired"), ("a1", 5000.0, "escalated"), ("a1", 6000.0, "resolved"), ("a2", 9000.0, "fired")], "alert_id string, t double, kind string")
    frames = spark.createDataFrame([(7, 10.0), (8, 4000.0), (9, 5000.0), (10, 9001.0)], "frame long, t double")
    shots = evidence.captured(log, frames)
    assert {(r["alert_id"], r["t"]): (r["frame"], r["thumb"]) for r in shots.collect()} == {("a1", 5.0): (None, None), ("a1", 5000.0): (9, "/frames/a1.jpg"), ("a2", 9000.0): (9, "/frames/a2.jpg")}
    asked = [(1, "a1", 100.0, 404), (2, "a1", 5000.0, 200), (3, "a1", 5000.0 + 86_400, 200), (4, "a1", 5001.0 + 86_400, 404), (5, "a9", 9000.0, 404), (6, "../a1", 6000.0, 400), (7, None, 1.0, 400), (8, "a", 1.0, 400), (9, "a2", 9500.0, 200)]
    answers = evidence.answered(spark.createDataFrame([r[:3] for r in asked], "id long, alert_id string, t double"), shots)
    assert {r["id"]: r["status"] for r in answers.collect()} == {r[0]: r[3] for r in asked}
    assert {r["frame"] for r in answers.where("status = 200").collect()} == {9}
    assert sorted((r["detail"], r["action"]) for r in evidence.audited(answers).collect()) == [("a1", "evidence.view")] * 2 + [("a2", "evidence.view")]
    seen = {r["status"] for r in queries.QUERIES["evidence_requests"](spark, SMALL).select("status").distinct().collect()}
    assert seen == {200, 400, 404}


def test_banner_and_stale_feeds(spark):
    from throngline.operators import status

    d = spark.createDataFrame([(c, n, z) for c in (True, False) for n in (True, False) for z in (0, 2)], "c boolean, n boolean, z int")
    got = {(r["c"], r["n"], r["z"]): r["b"] for r in d.withColumn("b", status.banner(F.col("c"), F.col("n"), F.col("z"))).collect()}
    assert got[True, True, 2] == "" and got[True, True, 0] == "no zones" and {got[True, False, z] for z in (0, 2)} == {"disconnected"} and {v for k, v in got.items() if not k[0]} == {"uncalibrated"}
    times = spark.createDataFrame([(float(t),) for t in range(0, 20, 2)], "t double")
    seen = spark.createDataFrame([("cam1", 1.0), ("cam1", 9.0), ("cam2", 30.0), (None, 1.0)], "source string, t double")
    ages = {(r["source"], r["t"]): (r["age"], r["stale"]) for r in status.feeds(times, seen).collect()}
    assert ages["cam1", 0.0] == (None, True) and ages["cam1", 4.0] == (3.0, False) and ages["cam1", 6.0] == (5.0, True) and ages["cam1", 10.0] == (1.0, False) and ages["cam2", 18.0] == (None, True)
