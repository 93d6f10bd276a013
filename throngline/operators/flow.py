"""Movement: jitter removal, per-zone flow and its smoothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Region, Scene
from ..functions.geometry import bearing, ground, project
from ..sources.bridge import START
from ..sources.stored import Steps
from . import prefix, select
from .zones import grid, membership, with_density

STATIC_SHARE, STATIC_LEAST, SMOOTH = 0.02, 0.15, 5
#: Frames of a block of the smoothing.
SMOOTH_BLOCK = 512
#: Samples of a frame whose medians are aggregated at once.
DIRECT = 1 << 16


def remove_jitter(samples: DataFrame) -> DataFrame:
    """Subtract the component-wise median movement of a frame's static samples (weight under 2 % of the frame's largest).

    A frame with less than 15 % static samples stays as it is. Adds static, jitter_x, jitter_y. The samples are read
    anew for each of the small tables that come from them (a row or two a frame), and meet them by joins on the frame: while Spark
    finds a table small enough to send, no sample is shuffled. Medians of frames of up to DIRECT samples are aggregated, combined before the shuffle; where a
    frame has more, they are selected by histograms, so that its samples never meet in one task. Both are exact.
    """
    steps = Steps(samples.sparkSession)
    top = steps.keep("top", samples.groupBy("frame").agg(F.max("weight").alias("_top"), F.count("*").alias("_all")))
    static = F.when(F.col("_top") <= 0, F.col("weight") < 1e-6).otherwise(F.col("weight") < STATIC_SHARE * F.col("_top"))
    s = samples.join(top.select("frame", "_top"), "frame").withColumn("static", F.coalesce(static, F.lit(False)))
    still = s.where("static").select("frame", "dx", "dy")
    most = top.agg(F.max("_all")).first()[0] or 0
    if most <= DIRECT:  # a frame's values fit in one aggregation buffer
        half = lambda c: F.percentile(F.when(~F.isnan(c), F.col(c)), F.lit(0.5)).alias(c)
        middle = still.groupBy("frame").agg(F.count("*").alias("n"), half("dx"), half("dy"))
    else:
        middle = steps.keep("middle", select.medians(still, "frame", ("dx", "dy"), steps))
    frame = top.join(middle, "frame", "left")
    on = F.coalesce(F.col("n") / F.col("_all") >= STATIC_LEAST, F.lit(False))
    frame = steps.keep("jitter", frame.select("frame", *[F.when(on, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(n) for c, n in (("dx", "jitter_x"), ("dy", "jitter_y"))]))
    return s.drop("_top").join(frame, "frame").withColumn("dx", F.col("dx") - F.col("jitter_x")).withColumn("dy", F.col("dy") - F.col("jitter_y"))


def on_grid(samples: DataFrame, step: int = 8) -> DataFrame:
    """Samples whose integer pixel is on the flow grid."""
    return samples.where((F.floor("x") % step == 0) & (F.floor("y") % step == 0))


def moved(samples: DataFrame, h: np.ndarray, dt: float) -> DataFrame:
    """Adds vx, vy: ground metres a second between both projected ends of the movement; 0 where no time passed."""
    at, to = project(h, F.col("x"), F.col("y")), project(h, F.col("x") + F.col("dx"), F.col("y") + F.col("dy"))
    return samples.withColumns({n: (b - a) / dt if dt > 0 else F.lit(0.0) for n, a, b in zip(("vx", "vy"), at, to, strict=True)})


def flow_sums(w: Column) -> list[Column]:
    """Sums of weight, speed, velocity, squared speed and pixel movement, combined before the shuffle."""
    vx, vy = F.col("vx"), F.col("vy")
    s2 = vx * vx + vy * vy
    return [F.sum(v).alias(n) for n, v in (("w", w), ("ws", w * F.sqrt(s2)), ("wx", w * vx), ("wy", w * vy), ("w2", w * s2), ("px", w * F.col("dx")), ("py", w * F.col("dy")))]


def flow_figures(sums: DataFrame, *keep: str) -> DataFrame:
    """Weighted mean speed, velocity variance, heading and coherence from the sums; all zero without weight."""
    there = F.col("w") > 1e-9
    mean = lambda c: F.when(there, F.col(c) / F.col("w")).otherwise(0.0)
    d = sums.select("frame", "zone_id", "ordinal", *keep, mean("ws").alias("speed"), mean("wx").alias("vx"), mean("wy").alias("vy"), mean("w2").alias("v2"), mean("px").alias("px"), mean("py").alias("py"))
    drift = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    return d.select(
        "frame", "zone_id", "ordinal", *keep, "speed",
        F.greatest(F.col("v2") - drift * drift, F.lit(0.0)).alias("variance"),
        F.when((F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py")) > 0.25) & (F.col("speed") > 0.05), bearing(F.col("px"), F.col("py"))).alias("heading"),
        F.when(F.col("speed") > 1e-6, F.least(F.lit(1.0), drift / F.col("speed"))).otherwise(0.0).alias("coherence"),
    )


def zone_flow(samples: DataFrame, wanted: tuple[Region, ...], frames: DataFrame, h: np.ndarray, dt: float = 1.0) -> DataFrame:
    """The flow figures of every region at every frame, in one pass over the samples."""
    sums = membership(moved(samples, h, dt), wanted).groupBy("frame", "zone_id").agg(*flow_sums(F.col("weight")))
    return flow_figures(grid(frames, wanted).join(sums, ["frame", "zone_id"], "left"))


def zone_state(samples: DataFrame, scene: Scene, wanted: tuple[Region, ...], frames: DataFrame, dt: float = 1.0) -> DataFrame:
    """Mass, density and flow of every region at every frame: one membership and one aggregation for both."""
    inside = membership(moved(samples, ground(scene), dt), wanted).groupBy("frame", "zone_id").agg(F.count("*").alias("samples"), F.sum("mass").alias("count"), *flow_sums(F.col("weight")))
    full = grid(frames, wanted).join(inside, ["frame", "zone_id"], "left")
    return flow_figures(with_density(full, scene, wanted), "samples", "count", "density", *[c for c in ("n", "epoch", "opens") if c in frames.columns])


def smoothed(flow: DataFrame, *keep: str) -> DataFrame:
    """Medians over the last five results (zero ones included); headings by the medians of sine and cosine, nulls left out.

    Headings whose medians cancel each other have none. Results of another epoch, where there is such a column, don't
    count. Zones are cut into blocks of frames; a block's last four frames stand in the next one too.
    """
    d = flow
    if "n" not in d.columns:
        d = prefix.numbered(d, F.floor(F.col("frame") / SMOOTH_BLOCK), ("frame",), "n", ("zone_id",))
    epoch = [c for c in ("epoch",) if c in d.columns]
    d = prefix.spread(d, F.floor(F.col("n") / SMOOTH_BLOCK), F.floor((F.col("n") + SMOOTH - 1) / SMOOTH_BLOCK))
    last = Window.partitionBy("zone_id", "block", *epoch).orderBy("n").rowsBetween(1 - SMOOTH, 0)
    mid = lambda c: F.percentile(c, F.lit(0.5)).over(last)
    d = d.select("frame", "zone_id", "ordinal", *epoch, *keep, "halo", mid(F.col("speed")).alias("speed"), mid(F.col("variance")).alias("variance"), mid(F.sin(F.radians("heading"))).alias("_s"), mid(F.cos(F.radians("heading"))).alias("_c"), mid(F.col("coherence")).alias("coherence"))
    d = d.where("not halo").drop("halo")
    return d.withColumn("heading", F.when(F.sqrt(F.col("_s") * F.col("_s") + F.col("_c") * F.col("_c")) > 1e-9, F.pmod(F.degrees(F.atan2("_s", "_c")), F.lit(360.0)))).drop("_s", "_c")


def observations(state: DataFrame) -> DataFrame:
    """zone_id, ordinal, frame, t, density, count, speed, heading, variance of smoothed zone states (and their epoch, where they have one)."""
    epoch = [c for c in ("epoch",) if c in state.columns]
    return smoothed(state, "density", "count").select("zone_id", "ordinal", "frame", (F.lit(START) + F.col("frame")).alias("t"), "density", "count", "speed", "heading", "variance", *epoch)
