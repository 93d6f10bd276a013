"""Evidence of alerts: which kept frame shows it, and what a request for it is answered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import prefix

# The form of an evidence name, the path it is served at, the audited action, hours for which evidence is kept.
NAME, PATH, ACTION, KEPT_H = r"^a\d+$", "/frames/", "evidence.view", 24.0
BLOCK_S = 3600.0


def captured(log: DataFrame, frames: DataFrame) -> DataFrame:
    """alert_id, t, frame, thumb: every firing and escalation with the last kept frame (frame, t) at or before it.

    An as-of join in blocks of time. Without such a frame there is no evidence: frame and thumb are null. A later capture of an alert takes the place of its earlier one.
    """
    shots = log.where("kind <> 'resolved'").select("alert_id", "t")
    both = shots.withColumn("frame", F.lit(None).cast(frames.schema["frame"].dataType)).unionByName(frames.select(F.lit(None).cast("string").alias("alert_id"), "t", "frame").where("t is not null"))
    shown = F.when(F.col("alert_id").isNull(), F.col("frame"))
    d = prefix.carried(both, F.floor(F.col("t") / BLOCK_S), ("t", F.col("alert_id").isNotNull()), shown, "_f").where("alert_id is not null")
    thumb = F.when(F.col("_f").isNotNull(), F.concat(F.lit(PATH), "alert_id", F.lit(".jpg")))
    return d.select("alert_id", "t", F.col("_f").alias("frame"), thumb.alias("thumb"))


def answered(requests: DataFrame, captures: DataFrame, kept_s: float = KEPT_H * 3600) -> DataFrame:
    """Requests (id, alert_id, t) with status, frame and thumb: 400 for a name that isn't one, 404 where nothing was captured yet or it has expired, else 200.

    What a request meets is its alert's last capture with a frame at or before it. Null names are bad names.
    """
    shots = captures.where("frame is not null").select("alert_id", "t", F.struct(F.col("t").alias("at"), "frame", "thumb").alias("shot"))
    both = requests.select("id", "alert_id", "t", F.lit(None).cast(shots.schema["shot"].dataType).alias("shot")).unionByName(shots.withColumn("id", F.lit(None).cast(requests.schema["id"].dataType)))
    d = prefix.carried(both, F.floor(F.col("t") / BLOCK_S), ("t", F.col("shot").isNull()), F.col("shot"), "_s", ("alert_id",)).where("shot is null").drop("shot")
    there = F.col("_s").isNotNull() & (F.col("t") - F.col("_s.at") <= kept_s)
    status = F.when(~F.coalesce(F.col("alert_id").rlike(NAME), F.lit(False)), 400).when(~F.coalesce(there, F.lit(False)), 404).otherwise(200)
    d = d.withColumn("status", status)
    ok = F.col("status") == 200
    return d.select("id", "alert_id", "t", "status", F.when(ok, F.col("_s.frame")).alias("frame"), F.when(ok, F.col("_s.thumb")).alias("thumb"))


def audited(answers: DataFrame) -> DataFrame:
    """An audit row for each stored picture that was served: t, action, detail."""
    return answers.where("status = 200").select("t", F.lit(ACTION).alias("action"), F.col("alert_id").alias("detail"))
