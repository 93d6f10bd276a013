"""What an operator sees of the engine itself: summary counts, the banner, stale feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import prefix

# Fixed value: seconds after which a feed that is silent is stale.
STALE_S = 3.0
BLOCK_S = 3600.0


def banner(calibrated: Column, connected: Column, zones: Column) -> Column:
    """The one notice that is shown: a scene without calibration before a feed without frames before a scene without zones; '' without any."""
    return F.when(~calibrated, "uncalibrated").when(~connected, "disconnected").when(zones == 0, "no zones").otherwise("")


def feeds(times: DataFrame, seen: DataFrame) -> DataFrame:
    """source, t, age, stale of every source at every time of `times` (t): seconds since its last frame in `seen` (source, t).

    A source that has sent nothing so far has no age and is stale. Times and frames meet in blocks, by the last frame carried along.
    """
    asked = times.select("t").distinct().withColumn("source", F.explode(F.array(*map(F.lit, sources(seen))).cast("array<string>")))
    both = asked.withColumn("_seen", F.lit(False)).unionByName(seen.where("source is not null and t is not null").select("t", "source").withColumn("_seen", F.lit(True)))
    d = prefix.carried(both, F.floor(F.col("t") / BLOCK_S), ("t", (~F.col("_seen")).cast("int")), F.when(F.col("_seen"), F.col("t")), "_last", ("source",)).where("not _seen")
    age = F.col("t") - F.col("_last")
    return d.select("source", "t", age.alias("age"), F.coalesce(age > STALE_S, F.lit(True)).alias("stale"))


def sources(seen: DataFrame, most: int = 1000) -> list[str]:
    """The names of the sources, a site's cameras; an error beyond so many."""
    names = seen.select("source").where("source is not null").distinct().limit(most + 1).collect()
    if len(names) > most:
        raise ValueError(f"more than {most} sources")
    return sorted(r["source"] for r in names)


def summary(assessed: DataFrame, corridors: DataFrame) -> DataFrame:
    """frame, zones, not_green, corridors, not_clear: the counts of the scene's header."""
    z = assessed.groupBy("frame").agg(F.count("*").alias("zones"), F.count_if(F.col("risk") != "green").alias("not_green"))
    c = corridors.groupBy("frame").agg(F.count("*").alias("corridors"), F.count_if(F.col("status") != "clear").alias("not_clear"))
    return z.join(c, "frame", "full").select("frame", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("zones", "not_green", "corridors", "not_clear")])
