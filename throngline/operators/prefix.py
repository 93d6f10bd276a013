"""Numbers, sums and predecessors along one order, in blocks of it.

Rows are dealt by (key, block), where the block never falls along the order; inside a block a window does the work, and what
lies before a block comes from a table with one row a block. So one long history is work for many tasks, and only the
blocks' own rows, thousands of times fewer, are scanned in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _within(key: tuple[str, ...], order: tuple):
    return Window.partitionBy(*key, "_block").orderBy(*order)


def _joined(df: DataFrame, blocks: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Null keys meet too."""
    names = {k: f"_of_{k}" for k in (*key, "_block")}
    b = blocks.withColumnsRenamed(names)
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return df.join(b, on, "left").drop(*names.values())


def running(df: DataFrame, block: Column, order: tuple, sums: dict[str, Column], key: tuple[str, ...] = ()) -> DataFrame:
    """Adds running sums of the columns in `sums` (the row included) along the order of each key."""
    d = df.withColumn("_block", block).withColumns({f"_v_{n}": c for n, c in sums.items()})
    own = _within(key, order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = d.groupBy(*key, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums])
    blocks = blocks.select(*key, "_block", *[F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in sums])
    d = d.withColumns({n: F.sum(f"_v_{n}").over(own) for n in sums})
    return _joined(d, blocks, key).withColumns({n: F.col(n) + F.col(f"_p_{n}") for n in sums}).drop("_block", *[f"_{k}_{n}" for k in "vp" for n in sums])


def numbered(df: DataFrame, block: Column, order: tuple, name: str, key: tuple[str, ...] = ()) -> DataFrame:
    """Adds the place of each row along the order of its key, from 0. Rows that stand equal in the order get places as they come."""
    d = df.withColumn("_block", block)
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = d.groupBy(*key, "_block").agg(F.count("*").alias("_n")).select(*key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_p"))
    d = d.withColumn(name, F.row_number().over(_within(key, order)) - 1)
    return _joined(d, blocks, key).withColumn(name, (F.col(name) + F.col("_p")).cast("long")).drop("_block", "_p")


def lagged(df: DataFrame, block: Column, order: tuple[str, ...], value: Column, name: str, key: tuple[str, ...] = ()) -> DataFrame:
    """Adds `value` of the row before along the order of its key; null at a key's first row."""
    d = df.withColumn("_block", block).withColumn("_v", F.struct(value.alias("v")))
    w = _within(key, order)
    last = d.groupBy(*key, "_block").agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    last = last.select(*key, "_block", F.lag("_last").over(Window.partitionBy(*key).orderBy("_block")).alias("_before"))
    d = _joined(d.withColumn("_own", F.lag("_v").over(w)), last, key)
    return d.withColumn(name, F.coalesce("_own", "_before")["v"]).drop("_block", "_v", "_own", "_before")


def spread(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows dealt to the blocks that need them: their own one (`halo` false) up to the last one that looks back on them (`halo` true)."""
    return df.withColumn("_own", first).withColumn("block", F.explode(F.sequence(F.col("_own"), F.greatest("_own", last)))).withColumn("halo", F.col("block") > F.col("_own")).drop("_own")


def carried(df: DataFrame, block: Column, order: tuple, value: Column, name: str, key: tuple[str, ...] = ()) -> DataFrame:
    """Adds the last value that isn't null along the order of each key, the row's own included: an as-of join once both sides are rows of one table."""
    d = df.withColumn("_block", block).withColumn("_v", F.when(value.isNotNull(), F.struct(value.alias("v"))))
    own = F.last("_v", ignorenulls=True).over(_within(key, order).rowsBetween(Window.unboundedPreceding, 0))
    end = d.groupBy(*key, "_block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    end = end.select(*key, "_block", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    return _joined(d.withColumn("_own", own), end, key).withColumn(name, F.coalesce("_own", "_before")["v"]).drop("_block", "_v", "_own", "_before")
