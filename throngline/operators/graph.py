"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.stored import Steps


def components(links: DataFrame, steps: Steps, name: str = "graph") -> tuple[DataFrame, int]:
    """((node, root), rounds): the smallest node that each node with a link is connected with.

    Nodes are of any type that has an order. A round hangs every node's larger neighbours on the smallest node around
    it, then every node and its smaller neighbours on the smallest of these; paths shrink by a factor each time, so rounds grow
    with the logarithm of the longest one. The rounds end when a round changes no link. Each is a keyed minimum, combined before its shuffle, and a join with it.
    """
    now = steps.keep(f"{name}0", links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("lo < hi").distinct())
    print_ = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    seen, turn = print_(now), 0
    while seen[0]:
        around = now.select(F.col("hi").alias("v"), F.col("lo").alias("w")).unionByName(now.select(F.col("lo").alias("v"), F.col("hi").alias("w")))
        top = around.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
        hung = around.where("w > v").join(top, "v").select(F.col("w").alias("hi"), F.col("m").alias("lo")).where("lo < hi")
        low = hung.groupBy("hi").agg(F.min("lo").alias("m"))
        both = hung.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(low.select("hi", F.col("m").alias("lo")))
        turn += 1
        now = steps.keep(f"{name}{turn}", both.where("lo < hi").distinct())
        steps.drop(f"{name}{turn - 1}")
        was, seen = seen, print_(now)
        if seen == was:
            break
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")).unionByName(roots), turn
