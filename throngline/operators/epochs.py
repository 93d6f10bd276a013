"""Epochs: stretches between changes of the scene, over which no history reaches.

A log of changes (t, cause) says when another scene was put to use or the history was reset. A change holds for frames
from its time on. Measurements before and after it don't mix: windows, rings and the smoothing of the flow begin anew,
and an epoch's first frame has no movement, since it has no frame to compare with. The alert machines go on.

Frames meet the log by an as-of join: both are laid along time in blocks, and a frame's epoch is the number of changes up to
it (see `prefix`). The log may be long; no task sees the whole time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Region, Scene
from . import flow, prefix, risk

BLOCK_S = 600.0


def numbered(frames: DataFrame, log: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """Adds epoch (the number of changes at or before t) and opens (the first frame of its epoch) to frames (frame, t, ...).

    Changes with a null time are left out; several between two frames count one epoch each, of which the last is used.
    """
    marks = frames.withColumn("_c", F.lit(0)).unionByName(log.where("t is not null").select(F.col("t").cast("double").alias("t"), F.lit(1).alias("_c")), allowMissingColumns=True)
    block = F.floor(F.col("t") / block_s)
    d = prefix.running(marks, block, ("t", F.col("_c").desc()), {"epoch": F.col("_c")}).where("_c = 0").drop("_c")
    d = prefix.lagged(d, block, ("t",), F.col("epoch"), "_was")
    return d.withColumn("opens", ~F.col("_was").eqNullSafe(F.col("epoch"))).drop("_was")


def used(frames: DataFrame, log: DataFrame) -> DataFrame:
    """epoch, t, cause of the changes by number; of changes at one time the order is by cause."""
    own = prefix.numbered(log.where("t is not null"), F.floor(F.col("t") / BLOCK_S), ("t", "cause"), "_n")
    named = own.select((F.col("_n") + 1).alias("epoch"), "cause", F.col("t").alias("changed_at"))
    return frames.join(named, "epoch", "left")


def without_first(state: DataFrame) -> DataFrame:
    """Zone states whose opening frames hold no movement."""
    zero = {c: F.when(F.col("opens"), 0.0).otherwise(F.col(c)) for c in ("speed", "variance", "coherence")}
    return state.withColumns(zero | {"heading": F.when(~F.col("opens"), F.col("heading"))})


def observations(samples: DataFrame, frames: DataFrame, scene: Scene, wanted: tuple[Region, ...] | None = None, dt: float = 1.0) -> DataFrame:
    """Observations that never mix two epochs; frames come from `numbered`."""
    state = flow.zone_state(samples, scene, wanted or scene.zones, frames, dt)
    return flow.observations(without_first(state))


def assessed(samples: DataFrame, frames: DataFrame, scenes: dict[str, Scene], dt: float = 1.0) -> DataFrame:
    """Assessments under changing scenes: the frames have a column `scene`, a name of the few in `scenes`.

    Each scene's frames are measured and assessed under its regions and thresholds. An epoch belongs to one scene.
    """
    parts = []
    for name, scene in scenes.items():
        own = frames.where(F.col("scene") == name)
        parts.append(risk.assess(observations(samples.join(own.select("frame"), "frame", "left_semi"), own, scene, dt=dt), scene).withColumn("scene", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
