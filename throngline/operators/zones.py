"""Regions, spatial membership, zone mass and density."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..config import Region, Scene
from ..functions import geometry as G
from ..sources.bridge import START
from ..sources.stored import Steps
from . import prefix

#: Up to so many regions their tests are folded into the plan; more are met through grid cells.
FOLDED_REGIONS, CELL_PX = 64, 64
#: Frames of a block when they are numbered.
FRAME_BLOCK = 4096
_REGION = "id string, name string, kind string, ordinal int, polygon array<struct<x:double,y:double>>, neighbors array<string>"


def regions(spark: SparkSession, scene: Scene) -> DataFrame:
    """One row per region with its ground area and centroid."""
    h = G.ground(scene)
    rows = [(r.id, r.name, r.kind, i, [{"x": float(x), "y": float(y)} for x, y in r.polygon], list(r.neighbors)) for i, r in enumerate(scene.regions)]
    d = spark.createDataFrame(rows, _REGION)
    mean = lambda k: F.aggregate("polygon", F.lit(0.0), lambda a, p: a + p[k]) / F.size("polygon")
    return d.withColumn("area_m2", G.shoelace(G.projected(h, F.col("polygon")))).withColumn("cx", mean("x")).withColumn("cy", mean("y"))


def edges(spark: SparkSession, scene: Scene) -> DataFrame:
    """Declared neighbours: zone_id, neighbor_id, ord."""
    rows = [(z.id, n, i) for z in scene.zones for i, n in enumerate(z.neighbors)]
    return spark.createDataFrame(rows, "zone_id string, neighbor_id string, ord int")


def unknown_neighbors(spark: SparkSession, scene: Scene) -> DataFrame:
    zones = spark.createDataFrame([(z.id,) for z in scene.zones], "neighbor_id string")
    return edges(spark, scene).join(zones, "neighbor_id", "left_anti").select("zone_id", "neighbor_id")


def membership(points: DataFrame, wanted: tuple[Region, ...]) -> DataFrame:
    """A row for every point and every region it is in (regions may overlap), with the column zone_id.

    Few regions become literals of one expression: no join, no shuffle. Many are listed by the grid cells of their
    bounding boxes and meet the points by an equi-join on the cell; that table is as large as the scene document, and
    Spark broadcasts it only while it is small.
    """
    x, y = F.col("x"), F.col("y")
    if len(wanted) <= FOLDED_REGIONS:
        own = F.array_compact(F.array(*[F.when(G.inside(r, x, y), F.lit(r.id)) for r in wanted]))
        return points.withColumn("zone_id", F.explode(own))
    spark = points.sparkSession
    cells = [(r.id, cx, cy, [{"x": float(a), "y": float(b)} for a, b in r.polygon]) for r in wanted for cx in range(int(min(p[0] for p in r.polygon)) // CELL_PX, int(max(p[0] for p in r.polygon)) // CELL_PX + 1) for cy in range(int(min(p[1] for p in r.polygon)) // CELL_PX, int(max(p[1] for p in r.polygon)) // CELL_PX + 1)]
    table = spark.createDataFrame(cells, "zone_id string, cx long, cy long, polygon array<struct<x:double,y:double>>")
    met = points.withColumn("cx", F.floor(x / CELL_PX)).withColumn("cy", F.floor(y / CELL_PX)).join(table, ["cx", "cy"])
    crossing = """size(filter(transform(polygon, (p, i) -> struct(p as a, polygon[(i + 1) % size(polygon)] as b)),
        e -> (e.a.y > y) <> (e.b.y > y) and x < (e.b.x - e.a.x) * (y - e.a.y) / (e.b.y - e.a.y) + e.a.x)) % 2 = 1"""
    return met.where(F.expr(crossing)).drop("cx", "cy", "polygon")


def grid(frames: DataFrame, wanted: tuple[Region, ...]) -> DataFrame:
    """Every region at every frame of the table `frames`, so that empty ones count as zero."""
    ids = F.array(*[F.struct(F.lit(r.id).alias("zone_id"), F.lit(i).alias("ordinal")) for i, r in enumerate(wanted)])
    return frames.select("*", F.inline(ids))


def frames(points: DataFrame) -> DataFrame:
    """The frames that were sampled, with their number n from 0 and their time t."""
    seen = points.select("frame").where("frame is not null").distinct()
    seen = Steps(points.sparkSession).keep("frames", seen)
    return prefix.numbered(seen, F.floor(F.col("frame") / FRAME_BLOCK), ("frame",), "n").withColumn("t", F.lit(START) + F.col("frame"))


def with_density(full: DataFrame, scene: Scene, wanted: tuple[Region, ...]) -> DataFrame:
    """Adds density to samples and count, which are zero where nobody stands."""
    areas = {r.id: max(G.region_area(scene, r), 1e-6) for r in wanted}
    area = F.create_map(*[F.lit(v) for kv in areas.items() for v in kv])[F.col("zone_id")]
    return full.withColumn("samples", F.coalesce("samples", F.lit(0)).cast("long")).withColumn("count", F.coalesce("count", F.lit(0.0))).withColumn("density", F.col("count") / area)


def zone_mass(points: DataFrame, scene: Scene, wanted: tuple[Region, ...], frames: DataFrame) -> DataFrame:
    """count and density of every region at every sampled frame, zero where nobody stands."""
    mass = membership(points, wanted).groupBy("frame", "zone_id").agg(F.count("*").alias("samples"), F.sum("mass").alias("count"))
    return with_density(grid(frames, wanted).join(mass, ["frame", "zone_id"], "left"), scene, wanted)
