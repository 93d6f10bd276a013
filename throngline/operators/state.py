"""State products: corridors, totals, count errors, sampling rate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..config import Thresholds
from ..sources.stored import Steps
from . import prefix

#: Frames of a block of the smoothed rate, fewer where powers of its weight would leave a double.
EWMA_BLOCK = 256


def corridor_status(d: DataFrame, th: Thresholds) -> DataFrame:
    """Status of smoothed corridor states (count, density, speed)."""
    slow = (F.col("speed") > 0) & (F.col("speed") < th.slow_speed_ms)
    status = F.when((F.col("density") >= th.corridor_restricted) | ((F.col("density") >= th.corridor_clear) & slow), "blocked").when(F.col("density") >= th.corridor_clear, "restricted").otherwise("clear")
    return d.select("frame", F.col("zone_id").alias("corridor_id"), "count", "density", "speed", status.alias("status"))


def totals(assessed: DataFrame, areas: dict[str, float]) -> DataFrame:
    """Per frame: sums of the published (rounded) zone values; overlapping zones count twice."""
    area = F.create_map(*[F.lit(v) for kv in areas.items() for v in kv])[F.col("zone_id")]
    d = assessed.groupBy("frame").agg(F.sum(F.round("count", 1)).alias("count"), F.sum(F.round(area, 1)).alias("area_m2"), F.count_if(F.col("risk") == "amber").alias("n_amber"), F.count_if(F.col("risk") == "red").alias("n_red"))
    return d.withColumn("density", F.when(F.col("area_m2") <= 1e-6, 0.0).otherwise(F.col("count") / F.col("area_m2")))


def count_error(points: DataFrame, width: int, height: int) -> DataFrame:
    """Per frame: true count inside the frame, estimated count, signed error in per cent (null without truth)."""
    there = (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)
    d = points.groupBy("frame").agg(F.count_if(there).alias("truth"), F.sum("mass").alias("estimate"))
    return d.withColumn("error_pct", F.when(F.col("truth") > 0, 100.0 * (F.col("estimate") - F.col("truth")) / F.col("truth")))


def rate_ewma(frames: DataFrame, alpha: float = 0.2, span: float = 4096.0) -> DataFrame:
    """Sampling rate by exponential smoothing of the inverse gaps, from a key's first frame on; the first rate above 0 starts it.

    `frames` has key, t; rows with a null time are left out. Each frame maps a rate x to a x + b, and such maps compose to one of their kind. So a key's frames are numbered and cut
    into blocks; a block's map is a sum of its gaps weighted by powers of a, its rows' rates follow from the map up to them,
    and only the blocks' maps, one a block, are followed in order for a key. No key's frames meet in one task.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    a = 1.0 - alpha
    size = max(1, min(EWMA_BLOCK, int(250 / -math.log10(a))))
    steps = Steps(frames.sparkSession)
    own = frames.select("key", F.col("t").cast("double").alias("t")).where("t is not null")
    at = F.floor(F.col("t") / span)
    d = prefix.lagged(own, at, ("t",), F.col("t"), "_was", ("key",))
    gap = F.col("t") - F.col("_was")
    d = d.withColumn("_now", F.coalesce(F.when(gap > 0.01, 1.0 / gap), F.lit(0.0)))
    d = prefix.numbered(prefix.running(d, at, ("t", F.col("_now").desc()), {"_up": (F.col("_now") > 0).cast("long")}, ("key",)), at, ("t", F.col("_now").desc()), "_n", ("key",))
    d = d.withColumn("_b", F.floor(F.col("_n") / size)).withColumn("_j", F.col("_n") % size + 1)
    # the first rate above 0 counts whole, those before it are 0
    weight = F.when((F.col("_up") == 1) & (F.col("_now") > 0), 1.0).otherwise(alpha)
    d = steps.keep("rates", d.select("key", "t", "_b", "_j", (weight * F.col("_now")).alias("_v")))
    order = Window.partitionBy("key", "_b").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    power = lambda c: F.pow(F.lit(a), c)
    d = d.withColumn("_s", power(F.col("_j")) * F.sum(F.col("_v") * power(-F.col("_j"))).over(order))
    ends = d.groupBy("key", "_b").agg(F.max("_j").alias("_j"), F.max_by("_s", "_j").alias("_s"))

    def followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rate at which each block begins. Batches are sorted by key and block."""
        own, x = object(), 0.0
        for batch in batches:
            begins = []
            for key, n, s in zip(batch["key"].tolist(), batch["_j"].tolist(), batch["_s"].tolist(), strict=True):
                if key != own:
                    own, x = key, 0.0
                begins.append(x)
                x = a**n * x + s
            yield batch[["key", "_b"]].assign(_x=begins)

    kind = own.schema["key"].dataType
    starts = ends.repartition("key").sortWithinPartitions("key", "_b").mapInPandas(followed, T.StructType().add("key", kind).add("_b", T.LongType()).add("_x", T.DoubleType()))
    starts = steps.keep("starts", starts).withColumnsRenamed({"key": "_key", "_b": "_block"})
    d = d.join(starts, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_block")))
    return d.select("key", "t", (power(F.col("_j")) * F.col("_x") + F.col("_s")).alias("fps"))
