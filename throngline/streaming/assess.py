"""Streaming assessment: each micro-batch is assessed with the trailing history it needs, by the same code as a batch job.

A step reads the state of the batch before it (old versions are deleted), adds the new observations and assesses both; rows newer than all
seen before are its output. State and output of a batch have a folder of their own named by its number, so that a batch that is run again
after a failure writes the same once more. Observations not newer than a zone's last one are late and left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..config import Scene
from ..operators import risk

#: Versions of a table that stay.
KEPT = 3
OBSERVATION = "zone_id string, ordinal int, frame long, t double, density double, count double, speed double, heading double, variance double"


def readable(raw: DataFrame, schema: str = OBSERVATION) -> tuple[DataFrame, DataFrame]:
    """(observations, bad records) of JSON lines in the column `value`: what can't be read, or has no zone or time, goes to the second."""
    d = raw.withColumn("o", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    good = F.col("o.zone_id").isNotNull() & F.col("o.t").isNotNull()
    return d.where(good).select("o.*"), d.where(~F.coalesce(good, F.lit(False))).select("value")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions of a table of which each is a folder of its own. A version without the mark of its writer isn't whole and doesn't count."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in (fs.listStatus(path(folder)) if fs.exists(path(folder)) else ())]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(path(f"{folder}/{n}/_SUCCESS")))


def _before(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    """The last version before `batch`."""
    last = max((n for n in versions(spark, folder) if n < batch), default=None)
    return None if last is None else spark.read.parquet(f"{folder}/{last}")


def _vacuum(spark: SparkSession, folder: str, number: int) -> None:
    """Delete the versions that neither this batch, run again, nor a reader of the one before needs."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n in [n for n in versions(spark, folder) if n <= number][:-KEPT]:
        fs.delete(path(f"{folder}/{n}"), True)


def step(batch: DataFrame, number: int, scene: Scene, folder: str) -> None:
    """Assess one micro-batch; writes <folder>/state/<number> and <folder>/out/<number>."""
    spark = batch.sparkSession
    old = _before(spark, f"{folder}/state", number)
    rest = [c for c in batch.columns if c not in ("zone_id", "t")]
    new = batch.groupBy("zone_id", "t").agg(F.min(F.struct(*rest)).alias("_r")).select("zone_id", "t", "_r.*")  # of rows of one time the least
    if old is not None:
        seen = old.groupBy("zone_id").agg(F.max("t").alias("seen"))
        new = new.join(seen, "zone_id", "left").where("seen is null or t > seen").drop("seen")
    both = new.withColumn("fresh", F.lit(True))
    if old is not None:
        both = both.unionByName(old.withColumn("fresh", F.lit(False)))
    order = Window.partitionBy("zone_id").orderBy(F.col("t").desc())
    recent = both.withColumn("back", F.row_number().over(order)).withColumn("last", F.max("t").over(Window.partitionBy("zone_id")))
    # a window's first means reach two samples behind it
    inside = F.count_if(F.col("t") >= F.col("last") - scene.thresholds.trend_window_s).over(Window.partitionBy("zone_id"))
    kept = recent.withColumn("inside", inside).where(F.col("back") <= F.col("inside") + 2).drop("back", "last", "inside", "fresh")
    kept.write.mode("overwrite").parquet(f"{folder}/state/{number}")
    out = risk.assess(both, scene).where("fresh").drop("fresh")
    out.write.mode("overwrite").parquet(f"{folder}/out/{number}")
    _vacuum(spark, f"{folder}/state", number)


def assessed(observations: DataFrame, scene: Scene, folder: str) -> DataStreamWriter:
    """A writer of the assessments of a stream of observations (see `step`); start it with a checkpoint location."""
    return observations.writeStream.foreachBatch(lambda batch, number: step(batch, number, scene, folder))


def publish_latest(rows: DataFrame, number: int, folder: str) -> None:
    """The newest row of each zone with seq, as a version for each batch; a batch run again writes the same, and old versions go.

    seq counts the batches that brought a zone something new: without new rows (no frame came) the version is published once more under the seqs
    it had, with idle true.
    """
    spark = rows.sparkSession
    old = _before(spark, folder, number)
    new = risk.latest(rows).select(*rows.columns)
    kept = None if old is None else old.select(*rows.columns, "seq")
    both = new.withColumn("seq", F.lit(0).cast("long")) if kept is None else new.withColumn("seq", F.lit(None).cast("long")).unionByName(kept)
    top = both.groupBy("zone_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "zone_id"], "seq"), F.struct("t", F.col("seq").isNotNull())).alias("_r"), F.max("seq").alias("_seq"))
    fresh = F.col("_r.seq").isNull() | (F.lit(kept is None))
    out = top.select("zone_id", "_r.*", "_seq", fresh.alias("_new")).withColumn("seq", F.when(F.col("_new"), F.coalesce("_seq", F.lit(0)) + 1).otherwise(F.col("_seq"))).withColumn("idle", ~F.col("_new"))
    out.select(*rows.columns, "seq", "idle").write.mode("overwrite").parquet(f"{folder}/{number}")
    _vacuum(spark, folder, number)
