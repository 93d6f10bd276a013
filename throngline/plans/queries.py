"""Named queries over the test tables. Every one runs over its whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DEFAULT_SCENE
from ..functions import geometry as G
from ..operators import alerts, crowd, epochs, evidence, flow, heat, risk, select, state, status, zones
from ..sources import bridge, store
from ..sources.stored import Steps

#: The scene of the queries: the default one seen at a slant, with a concave zone and a neighbour that isn't declared.
CHANGED = {"exit_apron": {"polygon": ((0, 320), (960, 320), (960, 544), (480, 544), (480, 432), (0, 432))}, "ghat_west": {"neighbors": ("north_bank", "ghat_east", "west_approach")}}
SCENE = replace(
    DEFAULT_SCENE, world_points=((0.0, 0.0), (30.0, 0.0), (20.0, 34 / 3), (0.0, 34 / 3)),
    regions=tuple(replace(r, **CHANGED.get(r.id, {})) for r in DEFAULT_SCENE.regions),
)
TH, M_PER_PX = SCENE.thresholds, 1 / bridge.PIXELS_PER_M


def _r(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Rounded doubles: sums of floats differ in the last digits from engine to engine."""
    return df.withColumns({n: F.round(n, places) for n in names})


def _off_ties(df: DataFrame, *names: str) -> DataFrame:
    """Moved by 1e-9: values made of few decimals often stand exactly between two rounded ones."""
    return df.withColumns({n: F.col(n) + 1e-9 for n in names})


def _points(spark, d):
    return bridge.detections(bridge.events(spark, d))


def _samples(spark, d):
    return flow.remove_jitter(bridge.flow_samples(_points(spark, d)))


def _state(spark, d, wanted):
    return flow.zone_state(_samples(spark, d), SCENE, wanted, zones.frames(_points(spark, d)))


def _observations(spark, d):
    return flow.observations(_state(spark, d, SCENE.zones))


def _assessed(spark, d):
    return risk.assess(_observations(spark, d), SCENE)


ZONE_IDS = tuple(z.id for z in SCENE.zones)


def _alerts(spark, d):
    return alerts.current(alerts.numbered(alerts.events(_assessed(spark, d), TH), ZONE_IDS))


def detections(spark, d):
    return _r(_points(spark, d).select("event_id", "frame", "t", "x", "y", "mass"), "mass")


def flow_samples(spark, d):
    return _r(bridge.flow_samples(_points(spark, d)).select("event_id", "frame", "x", "y", "weight", "dx", "dy"), "weight", "dx", "dy")


def sampled_latest_per_bucket(spark, d):
    return bridge.latest_per_bucket(bridge.events(spark, d), 3600).select("event_id", "event_type", "value", "seen")


def region_geometry(spark, d):
    g = zones.regions(spark, SCENE).withColumn("m2_per_person", F.when(F.col("area_m2") > 1e-6, 1 / F.col("area_m2")))
    return _r(g.select("id", "kind", "ordinal", "area_m2", "m2_per_person", "cx", "cy"), "area_m2", "m2_per_person", "cx", "cy")


def pixel_area_profile(spark, d):
    h = G.ground(SCENE)
    g = spark.range(544).select(F.col("id").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(959))))
    return _r(g.groupBy("y").agg(F.sum(G.pixel_area(h, F.col("x"), F.col("y"))).alias("area_m2"), F.count("*").alias("pixels")), "area_m2")


def unknown_neighbours(spark, d):
    return zones.unknown_neighbors(spark, SCENE)


def zone_membership(spark, d):
    return zones.membership(_points(spark, d), SCENE.regions).groupBy("zone_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def zone_density(spark, d):
    return _r(zones.zone_mass(_points(spark, d), SCENE, SCENE.zones, zones.frames(_points(spark, d))).select("frame", "zone_id", "samples", "count", "density"), "count", "density")


def density_regrid(spark, d):
    return _r(heat.regrid(_points(spark, d), 32), "mass")


def heat_cells(spark, d):
    return _r(heat.heat(_points(spark, d), 32, M_PER_PX).select("frame", "cx", "cy", "density", "idx", "b", "g", "r", "a"), "density")


def heat_lut(spark, d):
    return _r(heat.colour_table(spark), "density")


def band_legend(spark, d):
    return heat.legend(spark, TH)


def detection_splat(spark, d):
    e = _points(spark, d).select("frame", F.col("x").alias("cx"), F.col("y").alias("cy"), (8 + F.col("event_id") % 24).cast("double").alias("w"), (8 + F.col("event_id") % 17).cast("double").alias("h"))
    return _r(heat.splat(e, 960, 544).groupBy("frame").agg(F.sum("mass").alias("mass"), F.count("*").alias("pixels"), F.sum(F.col("mass") * F.col("x")).alias("moment_x")), "mass", "moment_x")


def blob_components(spark, d):
    cells = _points(spark, d).groupBy("frame", F.floor(F.col("x") / 48).alias("cx"), F.floor(F.col("y") / 48).alias("cy")).agg(F.count("*").cast("double").alias("pixels"))
    return heat.blobs(cells, 2.0)


def _gray(spark, d):
    """Gray grids: cells of 48 pixels, darker the more events stand in them."""
    cells = _points(spark, d).groupBy("frame", F.floor(F.col("x") / 48).alias("cx"), F.floor(F.col("y") / 48).alias("cy")).agg(F.count("*").alias("n"))
    full = cells.select("frame").distinct().withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return full.join(cells, ["frame", "cx", "cy"], "left").withColumn("gray", 120.0 - (F.col("cx") * 37 + F.col("cy") * 53 + F.col("frame") * 29) % 60 - F.coalesce("n", F.lit(0)) * 15)


def dark_mask(spark, d):
    """Opened mask of gray grids."""
    return heat.mask(_gray(spark, d), 12.0)


def blob_density(spark, d):
    """Gray grid, mask, components, and each component's people spread back over its cells."""
    return _r(heat.blob_density(_gray(spark, d), 12.0, 3.0), "mass")


def density_field(spark, d):
    return _r(heat.density_field(_points(spark, d), SCENE, 32), "density")


def heat_published(spark, d):
    return _r(heat.shown(heat.density_field(_points(spark, d), SCENE, 32), 5), "heat_max")


def alert_counts(spark, d):
    """Active alerts by severity, a row for each of the three."""
    n = _alerts(spark, d).agg(*[F.count_if((F.col("state") == "active") & (F.col("severity") == s)).alias(s) for s in risk.LEVELS])
    return n.select(F.inline(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("active")) for s in risk.LEVELS])))


def announced_once(spark, d):
    """Events to announce: an alert's first event and each later one of another severity, nothing twice."""
    log = alerts.numbered(alerts.events(_assessed(spark, d), replace(TH, dwell_s=5.0, resolve_s=4.0, reassert_gap_s=12.0)), ZONE_IDS)
    return alerts.announced(log).select("alert_id", "zone_id", "severity", "t")


def flow_jitter_removed(spark, d):
    g = _samples(spark, d).groupBy("frame").agg(F.count("*").alias("n"), F.count_if("static").alias("n_static"), F.max("jitter_x").alias("jitter_x"), F.max("jitter_y").alias("jitter_y"), F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
    return _r(g, "jitter_x", "jitter_y", "dx", "dy")


def zone_flow(spark, d):
    f = flow.zone_flow(_samples(spark, d), SCENE.zones, zones.frames(_points(spark, d)), G.ground(SCENE))
    return _r(_off_ties(f, "speed").select("frame", "zone_id", "speed", "variance", "heading", "coherence"), "speed", "variance", "heading", "coherence")


def observations(spark, d):
    return _r(_off_ties(_observations(spark, d), "speed").select("zone_id", "frame", "t", "density", "count", "speed", "heading", "variance"), "density", "count", "speed", "heading", "variance")


def density_slope(spark, d):
    w = risk.windowed(_observations(spark, d), TH)
    w = w.withColumn("ttc", risk.time_to_critical(F.col("density"), F.col("rate"), TH)).withColumn("band", risk.band(F.col("density"), TH))
    return _r(_off_ties(w, "baseline").select("zone_id", "frame", "rate", "baseline", "ttc", "band"), "rate", "baseline", "ttc", places=5).withColumn("rate", F.col("rate") + 0.0)  # no negative zero


def scene_epochs(spark, d):
    """Windows and smoothing cut at changes of the scene: the figures of every zone and frame, with its epoch."""
    points = _points(spark, d)
    log = bridge.scene_changes(bridge.events(spark, d))
    frames = Steps(spark).keep("frames", epochs.used(epochs.numbered(zones.frames(points), log), log))
    w = risk.windowed(epochs.observations(_samples(spark, d), frames, SCENE), TH)
    w = w.withColumn("ttc", risk.time_to_critical(F.col("density"), F.col("rate"), TH)).withColumn("band", risk.band(F.col("density"), TH))
    w = w.join(frames.select("frame", "opens", "cause"), "frame")
    w = _off_ties(w, "baseline", "speed").select("zone_id", "frame", "epoch", "opens", "cause", "speed", "rate", "baseline", "ttc", "band")
    return _r(w, "speed", "rate", "baseline", "ttc", places=5).withColumn("rate", F.col("rate") + 0.0)


def risk_signals(spark, d):
    s = risk.signals(_observations(spark, d), SCENE)
    return _r(s.select("zone_id", "frame", "drop", "pressure", "convergence", "against", *[f"l_{k}" for k in risk.SIGNALS]), "drop", "pressure", "convergence", places=5)


def assess_scene(spark, d):
    return _r(_assessed(spark, d).select("zone_id", "frame", "density", "risk", "headline", "band", "trend", "action"), "density")


def signals_long(spark, d):
    """The published signals, a row each."""
    s = _assessed(spark, d).select("zone_id", "frame", F.posexplode("signals").alias("ord", "s"))
    return _r(s.select("zone_id", "frame", "ord", "s.name", "s.level", (F.col("s.value") + 0.0).alias("value"), "s.detail"), "value", places=3)


def zone_states(spark, d):
    """Zone states as published, rounded."""
    a = _off_ties(_assessed(spark, d), "count", "density", "speed", "heading", "variance", "pressure", "ttc")
    return risk.published(a, SCENE).select("zone_id", "name", "frame", "count", "area_m2", "density", "band", "risk", "trend", "ttc", "speed", "heading", "variance", "pressure", "headline")


def risk_changes(spark, d):
    return risk.changes(_assessed(spark, d)).select("zone_id", "frame", "risk", "headline")


def latest_per_zone(spark, d):
    return _r(risk.latest(_assessed(spark, d)).select("zone_id", "frame", "density", "risk", "headline"), "density")


def zones_worst_first(spark, d):
    a = risk.latest(_assessed(spark, d))
    return _r(a.orderBy(F.col("level").desc(), F.col("density").desc()).select("zone_id", "risk", "density"), "density")


def corridor_status(spark, d):
    s = flow.smoothed(_state(spark, d, SCENE.corridors), "count", "density")
    return _r(state.corridor_status(s, TH).select("frame", "corridor_id", "count", "density", "speed", "status"), "count", "density", "speed")


def totals(spark, d):
    return _r(state.totals(_assessed(spark, d), {z.id: G.region_area(SCENE, z) for z in SCENE.zones}), "count", "area_m2", "density", places=4)


def count_error(spark, d):
    return _r(state.count_error(_points(spark, d), 960, 544), "estimate", "error_pct")


def fps_ewma(spark, d):
    t = bridge.events(spark, d).select(F.col("event_type").alias("key"), F.col("event_id").cast("double").alias("t"))
    return _r(state.rate_ewma(t), "fps")


def alert_events(spark, d):
    return alerts.events(_assessed(spark, d), TH).select("zone_id", "t", "kind", "severity", "headline", "first_seen", "escalations")


def alert_events_quick(spark, d):
    """The machine with short timers, so that every transition occurs on the test tables."""
    quick = replace(TH, dwell_s=5.0, resolve_s=4.0, reassert_gap_s=12.0)
    return alerts.events(_assessed(spark, d), quick).select("zone_id", "t", "kind", "severity", "headline", "first_seen", "escalations")


def alerts_current(spark, d):
    return _alerts(spark, d).select("alert_id", "seq", "zone_id", "severity", "metric", "message", "state", "ts", "first_seen", "escalations", "resolved_at")


def alerts_live(spark, d):
    return alerts.live(_alerts(spark, d)).select("alert_id", "zone_id", "severity", "ts")


def alerts_recent(spark, d):
    return alerts.recent(_alerts(spark, d), 10).select("alert_id", "zone_id", "severity", "ts", "state")


def alert_feed(spark, d):
    return alerts.feed(_alerts(spark, d)).select("alert_id", "zone_id", "state", "ts")


def max_alert_seq(spark, d):
    return _alerts(spark, d).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("max_seq"))


def retention_purge(spark, d):
    return store.purge(_alerts(spark, d), "ts", 1400.0)[1]


def audit_tail(spark, d):
    log = bridge.events(spark, d).where("event_type in ('error', 'purchase')").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.col("event_type").alias("action"))
    return store.audit_tail(log, 50)


def _agents(spark, d):
    """The people of a day on one ground, 32 pixels a metre."""
    return _points(spark, d).select(F.floor(F.col("frame") / 24).alias("frame"), F.col("event_id").alias("id"), (F.col("x") / 32).alias("x"), (F.col("y") / 32).alias("y"))


def radius_neighbours(spark, d):
    return crowd.neighbours(_agents(spark, d), 1.0, digits=6)


def local_density(spark, d):
    return _r(crowd.local_density(_agents(spark, d)), "density", "speed")


def speed_profile(spark, d):
    """A day's people: local densities and the speeds they allow, exact quantiles, and how many can't move."""
    a = Steps(spark).keep("agents", crowd.local_density(_agents(spark, d)))
    q = select.quantiles(a, "frame", {"speed_p50": ("speed", 0.5), "speed_p90": ("speed", 0.9), "speed_max": ("speed", 1.0), "density_p50": ("density", 0.5), "density_p95": ("density", 0.95), "density_max": ("density", 1.0)}, Steps(spark))
    m = a.groupBy("frame").agg(F.avg("speed").alias("speed_mean"), F.avg("density").alias("density_mean"), F.count_if(F.col("density") >= crowd.JAM_DENSITY).alias("jammed"))
    both = q.join(m, "frame").withColumnRenamed("frame", "day")
    return _r(both, *[c for c in both.columns if c.startswith(("speed", "density"))])


def density_histogram(spark, d):
    """People by local density, 16 bins from 0 to 8 a square metre; below and beyond have bins of their own."""
    a = crowd.local_density(_agents(spark, d)).withColumn("bin", F.width_bucket("density", F.lit(0.0), F.lit(8.0), F.lit(16)))
    return a.groupBy(F.col("frame").alias("day"), "bin").agg(F.count("*").alias("people"))


def _kept_frames(spark, d):
    """The newest frame of every six hours, as they would be kept for evidence."""
    newest = bridge.latest_per_bucket(bridge.events(spark, d), 6 * 3600).select("event_id")
    return bridge.detections(bridge.events(spark, d)).join(newest, "event_id", "left_semi").select("frame", "t")


QUICK = replace(TH, dwell_s=5.0, resolve_s=4.0, reassert_gap_s=12.0)


def _captures(spark, d):
    return evidence.captured(alerts.numbered(alerts.events(_assessed(spark, d), QUICK), ZONE_IDS), _kept_frames(spark, d))


def evidence_captured(spark, d):
    """Every firing and escalation with the last kept frame at or before it."""
    return _captures(spark, d)


def evidence_requests(spark, d):
    """View events as requests for evidence, some by bad names; evidence is kept for 240 s of the table's clock (a second an hour)."""
    name = F.when(F.col("value") < 5, F.concat(F.lit("x"), F.col("event_id"))).otherwise(F.concat(F.lit("a"), F.col("event_id") % 60))
    asked = _points(spark, d).where("event_type = 'view'").select(F.col("event_id").alias("id"), name.alias("alert_id"), "t")
    return evidence.answered(asked, Steps(spark).keep("captures", _captures(spark, d)), 240.0)


def feed_status(spark, d):
    """Each kind of event as a feed: its age at every sampled frame, stale or not, and the banner that would be shown."""
    p = _points(spark, d)
    f = status.feeds(zones.frames(p), p.select("t", F.col("event_type").alias("source")))
    return f.withColumn("banner", status.banner(F.lit(bool(SCENE.image_points)), ~F.col("stale"), F.lit(len(SCENE.zones))))


def scene_summary(spark, d):
    s = flow.smoothed(_state(spark, d, SCENE.corridors), "count", "density")
    return status.summary(_assessed(spark, d), state.corridor_status(s, TH))


def flow_on_grid(spark, d):
    """Zone flow of the samples on the flow grid of eight pixels alone."""
    f = flow.zone_flow(flow.on_grid(_samples(spark, d)), SCENE.zones, zones.frames(_points(spark, d)), G.ground(SCENE))
    return _r(_off_ties(f, "speed").select("frame", "zone_id", "speed", "variance"), "speed", "variance")


def scenario_phase(spark, d):
    e = bridge.events(spark, d).select("event_id", (F.col("event_id") % 400).cast("double").alias("t"))
    return e.select("event_id", crowd.phase(F.col("t")).alias("p")).select("event_id", "p.label", "p.inflow", "p.west_share")


def spawn_schedule(spark, d):
    t = spark.range(1, 401).select((F.col("id") * 1.0).alias("t"))
    return t.select("t", F.floor(crowd.arrived(F.col("t")) + 1e-9).cast("long").alias("arrived"), (F.floor(crowd.arrived(F.col("t")) + 1e-9) - F.floor(crowd.arrived(F.col("t") - 1) + 1e-9)).cast("long").alias("spawned"))


def truth_points(spark, d):
    p = _points(spark, d).where("x >= 0 and x < 960 and y >= 0 and y < 544")
    h = G.ground(SCENE)
    gx, gy = G.project(h, F.col("x"), F.col("y"))
    return _r(p.select("event_id", gx.alias("gx"), gy.alias("gy")), "gx", "gy")


QUERIES = {f.__name__: f for f in (
    detections, flow_samples, sampled_latest_per_bucket, region_geometry, pixel_area_profile, unknown_neighbours, zone_membership, zone_density,
    density_regrid, heat_cells, heat_lut, band_legend, detection_splat, blob_components, dark_mask, blob_density, density_field, heat_published, alert_counts, announced_once, flow_jitter_removed, zone_flow, observations,
    density_slope, scene_epochs, risk_signals, signals_long, zone_states, assess_scene, risk_changes, latest_per_zone, zones_worst_first, corridor_status, totals, count_error, fps_ewma,
    alert_events, alert_events_quick, alerts_current, alerts_live, alerts_recent, alert_feed, max_alert_seq, retention_purge, audit_tail, radius_neighbours, local_density,
    speed_profile, density_histogram, evidence_captured, evidence_requests, feed_status, scene_summary, flow_on_grid,
    scenario_phase, spawn_schedule, truth_points,
)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess_scene(spark, sf_dir)
