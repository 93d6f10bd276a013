"""Named queries against their SQL on the small tables, plans, stores and the streaming machine."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from throngline.config import DEFAULT_SCENE, Thresholds
from throngline.operators import alerts, zones
from throngline.plans import oracles, queries
from throngline.sources import bridge, store
from throngline.streaming import alerts as streamed

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql(f"create view events as from '{SMALL}/events.parquet'")
    return c


def shown(v):
    return "" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*cols).collect())
    want = sorted(tuple(map(shown, r)) for r in duck.sql(f"select {', '.join(f'"{c}"' for c in cols)} from ({oracles.ORACLES[name]})").fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())


def test_membership_has_no_join(spark):
    p = bridge.detections(bridge.events(spark, SMALL))
    plan = zones.membership(p, DEFAULT_SCENE.zones)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_store(spark, tmp_path):
    store.save_scene(spark, DEFAULT_SCENE, f"{tmp_path}/scene")
    assert store.load_scene(spark, f"{tmp_path}/scene") == DEFAULT_SCENE
    assert store.load_scene(spark, f"{tmp_path}/none") == DEFAULT_SCENE
    for k, broken in enumerate(("{oops", '{"name": "x"}', "[1]", "")):
        (tmp_path / f"broken{k}").write_text(broken)
        assert store.load_scene(spark, f"{tmp_path}/broken{k}") == DEFAULT_SCENE
    (tmp_path / "presets").mkdir()
    (tmp_path / "presets/b.json").write_text(DEFAULT_SCENE.to_json())
    (tmp_path / "presets/a.json").write_text("{broken")
    assert [tuple(r) for r in store.presets(spark, f"{tmp_path}/presets").collect()] == [("b", "riverside", 5)]
    rows = "alert_id string, seq long, zone_id string, first_seen double, severity string, ts double"
    old = spark.createDataFrame([("a1", 1, "z", 1.0, "amber", 2.0)], rows)
    new = spark.createDataFrame([("a1", 9, "y", 5.0, "red", 3.0), ("a2", 2, "z", 4.0, "amber", 4.0)], rows)
    assert {tuple(r) for r in store.upsert_alerts(spark, old, new).collect()} == {("a1", 1, "z", 1.0, "red", 3.0), ("a2", 2, "z", 4.0, "amber", 4.0)}


def test_stream_equals_batch(spark, tmp_path):
    th = Thresholds(dwell_s=5.0, resolve_s=4.0, reassert_gap_s=12.0)
    rows = [(z, 1000.0 + i, "green" if (i // 7 + k) % 3 == 0 else "amber" if (i // 5) % 2 else "red", "density", 10.0, "d") for k, z in enumerate(("z1", "z2")) for i in range(120)]
    schema = "zone_id string, t double, risk string, headline string, ttc double, detail string"
    src = f"{tmp_path}/in"
    for k in range(3):  # one file after the other
        part = [r for r in rows if 40 * k <= r[1] - 1000 < 40 * (k + 1)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streamed.events(stream, th).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    pick = lambda df: sorted(map(tuple, df.select("zone_id", "t", "kind", "severity", "first_seen", "escalations").collect()))
    want = pick(alerts.events(spark.createDataFrame(rows, schema), th))
    assert len(want) > 6 and pick(spark.read.parquet(f"{tmp_path}/out")) == want


def test_stream_of_assessments_equals_batch(spark, tmp_path):
    """Micro-batches of uneven length, one of them with late rows and one run twice, against one batch job."""
    import math

    from throngline.operators import risk
    from throngline.streaming import assess as stream

    rows = [(z, k, i, 1000.0 + i, 2 + math.sin(i / 9 + k), 10.0, 0.9 + 0.5 * math.cos(i / 7), float((k * 160 + i) % 360), 0.1) for k, z in enumerate(("ghat_west", "ghat_east", "exit_apron")) for i in range(150)]
    ends, src, out = (20, 27, 28, 90, 150), f"{tmp_path}/in", f"{tmp_path}/out"
    for a, b in zip((0, *ends), ends):
        part = [r for r in rows if a <= r[2] < b] + ([(*rows[3][:4], 99.0, *rows[3][5:])] if a == 28 else [])
        spark.createDataFrame(part, stream.OBSERVATION).coalesce(1).write.mode("append").parquet(src)
    read = spark.readStream.schema(stream.OBSERVATION).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.assessed(read, DEFAULT_SCENE, out).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert q.awaitTermination(300) and q.exception() is None
    show = lambda df: sorted((r["zone_id"], r["frame"], r["risk"], r["headline"], r["trend"], round(r["rate"], 9), round(r["baseline"], 9), round(r["convergence"], 9)) for r in df.collect())
    want = show(risk.assess(spark.createDataFrame(rows, stream.OBSERVATION), DEFAULT_SCENE))
    parts = [spark.read.parquet(f"{out}/out/{n}") for n in range(5)]
    assert sorted(x for p in parts for x in show(p)) == want
    last = show(parts[4])
    stream.step(spark.createDataFrame([r for r in rows if r[2] >= 90], stream.OBSERVATION), 4, DEFAULT_SCENE, out)
    assert show(spark.read.parquet(f"{out}/out/4")) == last
    for n, p in enumerate(parts[:2]):
        stream.publish_latest(p.select("zone_id", "t", "risk"), n, f"{tmp_path}/latest")
    assert {(r["zone_id"], r["t"]) for r in spark.read.parquet(f"{tmp_path}/latest/1").collect()} == {(z, 1026.0) for z in ("ghat_west", "ghat_east", "exit_apron")}


def test_bad_records(spark):
    from throngline.streaming import assess as stream

    raw = spark.createDataFrame([('{"zone_id": "a", "t": 1.5, "density": 2}',), ("{oops",), ('{"zone_id": "a"}',), (None,)], "value string")
    good, bad = stream.readable(raw)
    assert [(r["zone_id"], r["t"], r["density"]) for r in good.collect()] == [("a", 1.5, 2.0)] and bad.count() == 3
