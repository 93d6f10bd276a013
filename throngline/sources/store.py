"""Files of the engine: scene documents, presets, alert and audit tables, retention."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DEFAULT_SCENE, Scene

SCENE_SCHEMA = "name string, frame_size array<int>, regions array<struct<id:string,name:string,kind:string,polygon:array<array<double>>,neighbors:array<string>>>"
AUDIT_SCHEMA = "id long, ts string, actor string, action string, detail string"


def presets(spark: SparkSession, folder: str) -> DataFrame:
    """id, name, zones of the scene files in a folder, by file name; unreadable files are left out."""
    d = spark.read.schema(SCENE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return d.where("name is not null").select(name.alias("id"), "name", F.size(F.filter("regions", lambda r: r["kind"] == "zone")).alias("zones")).orderBy("id")


def save_scene(spark: SparkSession, scene: Scene, path: str) -> None:
    """One document, replaced as a whole."""
    spark.createDataFrame([(scene.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_scene(spark: SparkSession, path: str, default: Scene = DEFAULT_SCENE) -> Scene:
    """The stored scene; a missing or broken document counts as not stored. Any other failure, such as a refused permission, is raised."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return default
    try:
        return default if row is None else Scene.from_json(row[0])
    except (ValueError, KeyError, TypeError, AttributeError):  # no scene in it
        return default


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert_alerts(spark: SparkSession, stored: DataFrame | None, log: DataFrame) -> DataFrame:
    """Stored alerts merged with newer rows of the same shape: later values win, but for those of the first sight."""
    frozen = ("seq", "zone_id", "first_seen")
    both = log.withColumn("_new", F.lit(1)) if stored is None else stored.withColumn("_new", F.lit(0)).unionByName(log.withColumn("_new", F.lit(1)))
    order = F.struct("_new", "ts")
    rest = [c for c in log.columns if c != "alert_id"]
    return both.groupBy("alert_id").agg(*[(F.min_by(c, order) if c in frozen else F.max_by(c, order)).alias(c) for c in rest])


def audit_tail(audit: DataFrame, n: int) -> DataFrame:
    return audit.orderBy(F.col("id").desc()).limit(max(1, min(1000, n)))


def purge(table: DataFrame, ts: str, cutoff) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, counts of kept and purged rows); rows older than the cutoff go, active or not."""
    old = F.col(ts) < F.lit(cutoff)
    return table.where(~old), table.agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("purged"))
