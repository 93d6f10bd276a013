"""Newest wins: of the frames that wait when a batch begins, each source's newest of every bucket of time goes on, the others are dropped and counted.

A slow sink makes batches long and their buckets full, so it sees fewer and newer frames instead of a growing delay. A frame
that is not newer than its source's last one is stale and never published again. Counts and last times are a versioned table with a row a source
(see `assess.versions`); a batch that is run again writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from .assess import _before, _vacuum

# Fixed value: frames a second that are worked on.
SAMPLE_HZ = 3.0


def thinned(frames: DataFrame, hz: float = SAMPLE_HZ) -> DataFrame:
    """The newest frame of every source and bucket of 1 / hz seconds, with seen: how many stood in the bucket. `frames` has source, seq, t and more; equal times go by seq."""
    rest = [c for c in frames.columns if c != "source"]
    bucket = F.floor(F.col("t") * hz)
    d = frames.where("source is not null and t is not null").groupBy("source", bucket.alias("_b"))
    return d.agg(F.max_by(F.struct(*rest), F.struct("t", "seq")).alias("_r"), F.count("*").alias("seen")).select("source", "_r.*", "seen")


def step(batch: DataFrame, number: int, folder: str, hz: float = SAMPLE_HZ) -> None:
    """Thin one micro-batch; writes <folder>/frames/<number> and the sources' counts so far, <folder>/sources/<number>."""
    spark = batch.sparkSession
    old = _before(spark, f"{folder}/sources", number)
    named = batch.where("source is not null and t is not null")
    if old is None:
        old = spark.createDataFrame([], f"source {batch.schema['source'].dataType.simpleString()}, last double, taken long, dropped long, stale long")
    met = named.join(old.select("source", "last"), "source", "left").withColumn("_stale", F.coalesce(F.col("t") <= F.col("last"), F.lit(False))).drop("last")
    met.where("not _stale").drop("_stale").transform(lambda d: thinned(d, hz)).write.mode("overwrite").parquet(f"{folder}/frames/{number}")
    kept = spark.read.parquet(f"{folder}/frames/{number}")
    now = kept.groupBy("source").agg(F.max("t").alias("_last"), F.count("*").alias("_taken"), (F.sum("seen") - F.count("*")).alias("_dropped"))
    late = met.where("_stale").groupBy("source").agg(F.count("*").alias("_late"))
    both = old.join(now, "source", "full").join(late, "source", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = both.select("source", F.greatest("last", "_last").alias("last"), *[(zero(a) + zero(b)).alias(a) for a, b in (("taken", "_taken"), ("dropped", "_dropped"), ("stale", "_late"))])
    out.write.mode("overwrite").parquet(f"{folder}/sources/{number}")
    _vacuum(spark, f"{folder}/sources", number)


def newest(frames: DataFrame, folder: str, hz: float = SAMPLE_HZ) -> DataStreamWriter:
    """A writer of the thinned stream; start it with a checkpoint location."""
    return frames.writeStream.foreachBatch(lambda batch, number: step(batch, number, folder, hz))
