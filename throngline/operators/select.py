"""Exact quantiles of large groups without bringing a group's values together: selection by histograms.

The first pass counts the values of each group in BINS even bins between its least and its largest value. The bins
that hold the middle places are read again and counted in bins between their own least and largest value. What is left, about one in
BINS**2 of the values, is counted by value, and the places are found along the running counts. Bins are
combined before the shuffle, so a task returns at most BINS rows a group; a value's bin follows from subtraction, division and rounding down alone, each of
which keeps the order, so the selection is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.stored import Steps

BINS, LEVELS = 2048, 2


def medians(values: DataFrame, key: str, columns: tuple[str, ...], steps: Steps) -> DataFrame:
    """key, n (rows), and the median of each column (null without values; the mean of both middle ones where their number is even)."""
    return quantiles(values, key, {c: (c, 0.5) for c in columns}, steps)


def quantiles(values: DataFrame, key: str, wanted: dict[str, tuple[str, float]], steps: Steps) -> DataFrame:
    """key, n (rows), and a quantile for each name in `wanted` (column, share), linear between the two values around its place.

    Null and NaN values don't count; a group without values has null.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    long = values.select(key, F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(columns)]))).where("_x is not null and not isnan(_x)")
    spans = steps.keep("spans", long.groupBy(key, "_c").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_n")))
    # places, from 0, of the two values around each quantile, inside the range that is still searched
    shares = F.array(*[F.struct(F.lit(n).alias("_q"), F.lit(columns.index(c)).alias("_of"), F.lit(float(s)).alias("_s")) for n, (c, s) in enumerate(wanted.values())])
    places = spans.select(key, "_c", "_n", "_lo", "_hi", F.inline(shares)).where("_of = _c").withColumn("_p", F.col("_s") * (F.col("_n") - 1))
    places = steps.keep("places", places.select(key, "_c", "_q", "_p", F.explode(F.array_distinct(F.array(F.floor("_p"), F.ceil("_p")))).alias("_place"), "_lo", "_hi"))
    spans = places.select(key, "_c", F.col("_place").alias("_at"), "_place", "_lo", "_hi").distinct()
    on = [key, "_c", "_lo", "_hi"]

    def narrowed(spans: DataFrame, cell: Column, low: Column, high: Column) -> DataFrame:
        """The spans shrunk to the cells that hold their places."""
        ranges = spans.select(*on).distinct()
        cells = long.join(ranges, [key, "_c"]).where("_x between _lo and _hi").groupBy(*on, cell.alias("_b")).agg(F.count("*").alias("_n"), low.alias("_low"), high.alias("_high"))
        before = F.sum("_n").over(Window.partitionBy(*on).orderBy("_b")) - F.col("_n")
        found = cells.withColumn("_before", before).join(spans, on).where("_at >= _before and _at < _before + _n")
        return found.select(key, "_c", (F.col("_at") - F.col("_before")).alias("_at"), "_place", F.col("_low").alias("_lo"), F.col("_high").alias("_hi"))

    share = F.when(F.col("_hi") > F.col("_lo"), (F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)).otherwise(0.0)  # halves: no overflow
    for level in range(LEVELS):
        spans = steps.keep(f"spans{level}", narrowed(spans, F.floor(share * BINS), F.min("_x"), F.max("_x")))
    at = narrowed(spans, F.col("_x"), F.min("_x"), F.min("_x")).select(key, "_c", "_place", F.col("_lo").alias("_v"))
    met = places.join(at, [key, "_c", "_place"]).groupBy(key, "_q").agg(F.min("_p").alias("_p"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_p") - F.floor("_p"))
    value = F.when(F.col("_p") - F.floor("_p") == 0.5, F.col("_low") / 2 + F.col("_high") / 2).otherwise(value)
    out = met.groupBy(key).agg(*[F.max(F.when(F.col("_q") == i, value)).alias(n) for i, n in enumerate(wanted)])
    return values.groupBy(key).agg(F.count("*").alias("n")).join(out, key, "left")
