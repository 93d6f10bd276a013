"""Streams against batch jobs: neighbours of one frame in different batches, restarts, versions that go."""

import math

from pyspark.sql import functions as F

from throngline.config import DEFAULT_SCENE
from throngline.operators import risk
from throngline.streaming import assess, neighbours

ZONES = tuple(z.id for z in DEFAULT_SCENE.zones)


def rows_of(seconds):
    return [(z, k, i, 1000.0 + i, 2.5 + math.sin(i / 9 + k), 10.0, 0.9 + 0.5 * math.cos(i / 7), None if (i + k) % 11 == 0 else float((k * 160 + i * (1 + k)) % 360), 0.1) for k, z in enumerate(ZONES) for i in range(seconds)]


def written(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, assess.OBSERVATION).coalesce(1).write.mode("append").parquet(folder)


def started(spark, src, out, check, late_s):
    read = spark.readStream.schema(assess.OBSERVATION).option("maxFilesPerTrigger", 1).parquet(src)
    q = neighbours.met(read, DEFAULT_SCENE, late_s).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300) and q.exception() is None


def shown(df):
    return sorted((r["zone_id"], r["frame"], round(r["convergence"] or 0.0, 9), r["against"]) for r in df.collect())


def test_zones_of_one_frame_in_different_batches(spark, tmp_path):
    """Every zone comes in batches of its own, ahead of and behind the others, and the query is started anew in between; the batch job's result."""
    rows = rows_of(40)
    src, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    cut = {z: (7 + 3 * k, 22 + 2 * k) for k, z in enumerate(ZONES)}
    first = [[r for r in rows if r[0] == z and r[2] < cut[z][0]] for z in ZONES]
    later = [[r for r in rows if r[0] == z and a <= r[2] < b] for z in reversed(ZONES) for a, b in [cut[z]]] + [[r for r in rows if r[2] >= cut[r[0]][1]]]
    written(spark, src, first)
    started(spark, src, out, check, 60)
    written(spark, src, later)
    started(spark, src, out, check, 60)
    batch = spark.createDataFrame(rows, assess.OBSERVATION)
    want = shown(batch.join(risk.converging(batch, risk.edges(spark, DEFAULT_SCENE), DEFAULT_SCENE.thresholds), ["zone_id", "frame"], "left"))
    assert shown(spark.read.parquet(out)) == want and sum(w[2] > 0 for w in want) > 40


def test_missing_neighbours_are_waited_for_no_longer_than_the_watermark(spark, tmp_path):
    """A neighbour's frames 5 to 9 never come: its latest one counts once the watermark has passed; late rows are left out."""
    rows = [r for r in rows_of(60) if not (r[0] == "ghat_east" and 5 <= r[2] < 10)]
    src, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    written(spark, src, [[r for r in rows if a <= r[2] < a + 10] for a in range(0, 60, 10)] + [[r for r in rows_of(60) if r[0] == "ghat_east" and 5 <= r[2] < 10]])
    started(spark, src, out, check, 10)
    got = {(r["zone_id"], r["frame"]): (r["convergence"], r["against"]) for r in spark.read.parquet(out).collect()}
    by = {(r[0], r[2]): r for r in rows}
    east = {z for z in DEFAULT_SCENE.zones if "ghat_east" in z.neighbors}
    assert east and {f for z, f in got if z == "ghat_east"}.isdisjoint(range(5, 10))
    for z in east:
        for f in range(5, 10):
            own = by[z.id, f]
            others = [(n, by[n, f if (n, f) in by else 4]) for n in z.neighbors if (n, 0) in by]
            want = neighbours.opposed((own[4], own[6], own[7]), [(n, (r[4], r[6], r[7])) for n, r in others], DEFAULT_SCENE.thresholds.band_crowded)
            assert got[z.id, f] == want


def test_versions_stay_few(spark, tmp_path):
    """After many batches a bounded number of versions is left; batches without rows keep their seq; a batch that is run again writes the same."""
    folder, rows = f"{tmp_path}/latest", "zone_id string, t double, risk string"
    one = lambda n: {r["zone_id"]: tuple(r) for r in spark.read.parquet(f"{folder}/{n}").collect()}
    for n in range(12):
        new = [] if n in (4, 5) else [("a", 1000.0 + n, "green")] + ([("b", 1000.0 + n, "red")] if n < 3 else [])
        assess.publish_latest(spark.createDataFrame(new, rows), n, folder)
        assert len(assess.versions(spark, folder)) <= assess.KEPT
        if n == 5:
            assert one(5) == {"a": ("a", 1003.0, "green", 4, True), "b": ("b", 1002.0, "red", 3, True)}
    assert one(11) == {"a": ("a", 1011.0, "green", 10, False), "b": ("b", 1002.0, "red", 3, True)}
    assess.publish_latest(spark.createDataFrame([("a", 1011.0, "green")], rows), 11, folder)
    assert one(11)["a"] == ("a", 1011.0, "green", 10, False)
    spark.createDataFrame([("a", 1.0, "red")], rows).write.parquet(f"{folder}/12")
    (tmp_path / "latest/12/_SUCCESS").unlink()
    assert assess.versions(spark, folder)[-1] == 11  # not whole
    for n in range(5):
        assess.step(spark.createDataFrame([r for r in rows_of(5) if r[2] == n], assess.OBSERVATION), n, DEFAULT_SCENE, f"{tmp_path}/s")
    assert len(assess.versions(spark, f"{tmp_path}/s/state")) == assess.KEPT and spark.read.parquet(f"{tmp_path}/s/out/4").agg(F.count("*")).first()[0] == len(ZONES)


def test_newest_wins_under_a_slow_sink(spark, tmp_path):
    """One batch a file and one batch for many files, as a slow sink would leave them: the newest of each bucket goes on, drops are counted, stale frames don't come back."""
    from throngline.streaming import newest

    schema, src, out = "source string, seq long, t double, body string", f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [(s, i, 100.0 + i / 10, f"{s}{i}") for s in ("a", "b") for i in range(60)]
    put = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)

    def run(files):
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(src)
        q = newest.newest(read, out, 2.0).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        assert q.awaitTermination(300) and q.exception() is None

    put([r for r in rows if r[1] < 20])
    run(1)
    for k in range(2, 6):
        put([r for r in rows if 10 * k <= r[1] < 10 * (k + 1)])
    put([("a", 7, 100.7, "stale"), (None, 1, 100.0, "x"), ("b", 1, None, "x")])
    run(100)
    got = [r for n in assess.versions(spark, f"{out}/frames") for r in spark.read.parquet(f"{out}/frames/{n}").collect()]
    want = sorted((s, i) for s in ("a", "b") for i in range(4, 60, 5))
    assert sorted((r["source"], r["seq"]) for r in got) == want and all(r["seen"] == 5 for r in got)
    last = assess.versions(spark, f"{out}/sources")[-1]
    assert {tuple(r) for r in spark.read.parquet(f"{out}/sources/{last}").collect()} == {("a", 105.9, 12, 48, 1), ("b", 105.9, 12, 48, 0)}
    newest.step(spark.createDataFrame([(s, i, t, b) for s, i, t, b in rows if i >= 55], schema), last, out, 2.0)
    assert spark.read.parquet(f"{out}/sources/{last}").where("source = 'a'").first()["last"] == 105.9
