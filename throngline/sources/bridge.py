"""Pipeline inputs from the ``events`` table: people mass and movement samples.

One sample a frame; a frame is an hour of the table, its clock runs at one second a frame. People never keep an
identity: user ids are dropped here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Seconds of the first frame; people per sample are set for so many frames of a full site; pixels a metre of the plan view.
START, SITE_FRAMES, PIXELS_PER_M = 1000.0, 720, 32.0
_DAY0 = "2024-01-01"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def detections(events: DataFrame) -> DataFrame:
    """event_id, frame, t, x, y, mass: people mass at pixel centres."""
    n = max(1, events.count())  # footers only
    e = events.select("event_id", "event_type", "value", (F.datediff("ts", F.lit(_DAY0).cast("date")) * 24 + F.hour("ts")).cast("long").alias("frame"))
    m = F.abs(F.col("frame") % 120 - 60) / 60.0
    return e.select(
        "event_id", "event_type", "value", "frame", (F.lit(START) + F.col("frame")).alias("t"),
        ((F.col("event_id") * 37) % 960 + 0.5).alias("x"), ((F.col("event_id") * 91) % 544 + 0.5).alias("y"),
        m.alias("demand"), ((0.4 + 1.6 * m) * (2.2 * 510 * SITE_FRAMES / n)).alias("mass"),
    )


def flow_samples(points: DataFrame) -> DataFrame:
    """Detections with their movement (dx, dy) in pixels since the frame before, one second earlier, and a weight by value."""
    turn = F.create_map(*[F.lit(x) for kv in {"click": -2, "error": -1, "purchase": 0, "signup": 1, "view": 2}.items() for x in kv])
    theta = F.radians(F.when(F.col("y") < 256, 180.0).otherwise(0.0) + 24.0 * turn[F.col("event_type")])
    v = PIXELS_PER_M * (0.75 + F.least("value", F.lit(200.0)) / 800.0) * (1.2 - F.col("demand"))
    return points.select("event_id", "frame", "t", "x", "y", "value", "mass", (F.least("value", F.lit(200.0)) * F.least("value", F.lit(200.0))).alias("weight"), (v * F.sin(theta)).alias("dx"), (-v * F.cos(theta)).alias("dy"))


def scene_changes(events: DataFrame) -> DataFrame:
    """t, cause: the scene is changed at each day's error of the highest value (the last of equal ones); on the first day of a month it is a reset."""
    day = events.where("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.max_by("ts", F.struct("value", "event_id")).alias("ts"))
    frame = F.datediff("ts", F.lit(_DAY0).cast("date")) * 24 + F.hour("ts")
    return day.select((F.lit(START) + frame).alias("t"), F.when(F.dayofmonth("day") == 1, "reset").otherwise("scene").alias("cause"))


def latest_per_bucket(events: DataFrame, seconds: int) -> DataFrame:
    """Newest wins: the last event of every bucket of so many seconds (a batch keeps all others for other uses)."""
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return events.groupBy(bucket.alias("bucket")).agg(last.alias("e"), F.count("*").alias("seen")).select("bucket", "e.event_id", "e.event_type", "e.value", "seen")
