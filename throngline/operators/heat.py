"""Density fields: regridding, splats, blobs, colours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import Scene, Thresholds
from ..functions.geometry import ground
from ..sources.stored import Steps
from . import graph

# Fixed values of the colour ramp: density, blue, green, red.
ANCHORS = ((0.0, 150, 200, 120), (2.0, 120, 220, 235), (3.0, 60, 170, 250), (4.0, 55, 75, 240), (5.0, 90, 40, 170), (7.0, 120, 30, 120))
TOP_DENSITY, COLOURS = 7.0, 256
#: Cells of a tile's side when components are joined.
TILE = 64
#: Pixels along a side of the tiles that splats are summed in.
SPLAT_TILE = 128
#: Seconds of a block of publications.
PUBLISH_BLOCK_S = 3600.0
# Fixed values of the opacity: two slopes (density they start at, length, height) and the highest value.
OPACITY, MOST_OPAQUE = ((0.0, 1.8, 165), (1.8, 2.5, 70)), 235


def regrid(points: DataFrame, cell: int) -> DataFrame:
    """Mass by frame and cell; the total stays the same."""
    return points.groupBy("frame", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.sum("mass").alias("mass"))


def colour_table(spark: SparkSession) -> DataFrame:
    """idx, density, b, g, r, a of the 256 colours, by linear interpolation between the anchors."""
    d = np.linspace(0, TOP_DENSITY, COLOURS)
    stops = [a[0] for a in ANCHORS]
    bgr = [np.interp(d, stops, [a[k] for a in ANCHORS]).astype(np.uint8) for k in (1, 2, 3)]
    alpha = np.clip(sum(np.clip((d - start) / length, 0, 1) * height for start, length, height in OPACITY), 0, MOST_OPAQUE).astype(np.uint8)
    alpha[0] = 0
    rows = [(i, float(d[i]), *(int(c[i]) for c in bgr), int(alpha[i])) for i in range(COLOURS)]
    return spark.createDataFrame(rows, "idx int, density double, b int, g int, r int, a int")


def colour_index(density: Column) -> Column:
    return F.least(F.greatest(F.floor(density / TOP_DENSITY * (COLOURS - 1)), F.lit(0)), F.lit(COLOURS - 1)).cast("int")


def heat(points: DataFrame, cell: int, m_per_px: float) -> DataFrame:
    """Density and colour of every occupied cell; the colour table has 256 rows."""
    d = regrid(points, cell).withColumn("density", F.col("mass") / (cell * m_per_px) ** 2).withColumn("idx", colour_index(F.col("density")))
    return d.join(F.broadcast(colour_table(points.sparkSession).drop("density")), "idx").select("frame", "cx", "cy", "density", "idx", "b", "g", "r", "a")


def legend(spark: SparkSession, th: Thresholds) -> DataFrame:
    edges = [0.0, th.band_busy, th.band_crowded, th.band_very_crowded, th.band_critical]
    names = ["free", "busy", "crowded", "very_crowded", "critical"]
    rows = [(i, n, lo, hi) for i, (n, lo, hi) in enumerate(zip(names, edges, [*edges[1:], None], strict=True))]
    return spark.createDataFrame(rows, "ord int, band string, low double, high double")


def splat(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Detections (frame, box, cx, cy, w, h) as Gaussian patches of mass 1 each, clipped to the frame, summed by pixel.

    Equal boxes of a frame are drawn once. Boxes, not their pixels, are shuffled: to the tiles of a frame that their patches touch.
    """
    b = boxes.withColumn("sigma", F.greatest(F.lit(2.0), F.least("w", "h") / 4.0)).withColumn("r", F.floor(3 * F.col("sigma")).cast("long"))
    b = b.withColumn("ix", F.floor("cx").cast("long")).withColumn("iy", F.floor("cy").cast("long"))
    b = b.where((F.col("ix").between(0, width - 1)) & (F.col("iy").between(0, height - 1))).groupBy("frame", "ix", "iy", "sigma", "r").agg(F.count("*").alias("n"))
    ends = lambda c, size: (F.greatest(F.col(c) - F.col("r"), F.lit(0)), F.least(F.col(c) + F.col("r"), F.lit(size - 1)))
    (x0, x1), (y0, y1) = ends("ix", width), ends("iy", height)
    weight = lambda k, c: F.exp(-F.pow(k - c, 2) / (2 * F.col("sigma") * F.col("sigma")))
    # the Gaussian is a product, so its total over the patch is the product of two sums: no window over the pixels
    total = lambda a, c: F.aggregate(a, F.lit(0.0), lambda s, k: s + weight(k, F.col(c)))
    b = b.withColumn("unit", F.col("n") / (total(F.sequence(x0, x1), "ix") * total(F.sequence(y0, y1), "iy")))
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(lo / SPLAT_TILE), F.floor(hi / SPLAT_TILE)))
    b = b.withColumn("tx", tiles(x0, x1)).withColumn("ty", tiles(y0, y1))
    b = b.repartition(int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame", "tx", "ty")
    inside = lambda lo, hi, t: F.sequence(F.greatest(lo, F.col(t) * SPLAT_TILE), F.least(hi, F.col(t) * SPLAT_TILE + SPLAT_TILE - 1))
    b = b.withColumn("x", F.explode(inside(x0, x1, "tx"))).withColumn("wx", F.col("unit") * weight(F.col("x"), F.col("ix"))).withColumn("y", F.explode(inside(y0, y1, "ty")))
    return b.groupBy("frame", "tx", "ty", "x", "y").agg(F.sum(F.col("wx") * weight(F.col("y"), F.col("iy"))).alias("mass")).drop("tx", "ty")


def _joined_in_tile(cells: pd.DataFrame) -> pd.DataFrame:
    """Adds the first cell (rx, ry) of each cell's component inside its tile; union-find over at most TILE x TILE cells."""
    places = list(zip(cells["cx"].tolist(), cells["cy"].tolist()))
    root = {p: p for p in places}

    def top(p: tuple[int, int]) -> tuple[int, int]:
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    for x, y in places:
        for other in ((x - 1, y - 1), (x - 1, y), (x - 1, y + 1), (x, y - 1)):
            if other in root:
                a, b = top((x, y)), top(other)
                root[max(a, b)] = min(a, b)
    tops = [top(p) for p in places]
    return cells.assign(rx=[t[0] for t in tops], ry=[t[1] for t in tops])


def labelled(cells: DataFrame) -> tuple[DataFrame, int]:
    """(frame, cx, cy, label_x, label_y, rounds): the first cell, by x and y, of each cell's 8-connected component.

    Cells are joined inside tiles of TILE x TILE first. Then components that touch across the tiles' borders are
    links of a graph, contracted in rounds that grow with the logarithm of the number of tiles in a row. Repeated cells count once.
    """
    steps = Steps(cells.sparkSession)
    at = lambda c: F.floor(F.col(c) / TILE)
    own = cells.select("frame", F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy")).where("frame is not null and cx is not null and cy is not null").distinct()
    own = own.withColumn("tx", at("cx")).withColumn("ty", at("cy"))
    kind = own.schema["frame"].dataType.simpleString()
    local = own.groupBy("frame", "tx", "ty").applyInPandas(_joined_in_tile, f"frame {kind}, cx long, cy long, tx long, ty long, rx long, ry long")
    local = steps.keep("local", local.withColumn("node", F.struct("frame", "rx", "ry")))
    edge = F.pmod("cx", F.lit(TILE)).isin(0, TILE - 1) | F.pmod("cy", F.lit(TILE)).isin(0, TILE - 1)
    rim = local.where(edge).select("frame", "cx", "cy", "tx", "ty", "node")
    ahead = F.inline(F.array(*[F.struct(F.lit(i).alias("ox"), F.lit(j).alias("oy")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    sent = rim.select("frame", "cx", "cy", "tx", "ty", F.col("node").alias("a"), ahead).select("frame", (F.col("cx") + F.col("ox")).alias("cx"), (F.col("cy") + F.col("oy")).alias("cy"), F.col("tx").alias("sx"), F.col("ty").alias("sy"), "a")
    links = sent.join(rim, ["frame", "cx", "cy"]).where("sx <> tx or sy <> ty").select("a", F.col("node").alias("b"))
    roots, rounds = graph.components(links, steps)
    out = local.join(roots, "node", "left").withColumn("_r", F.coalesce("root", "node"))
    return out.select("frame", "cx", "cy", F.col("_r.rx").alias("label_x"), F.col("_r.ry").alias("label_y")), rounds


def blobs(cells: DataFrame, cell_pixels: float = 78.0) -> DataFrame:
    """The 8-connected components of the occupied cells (frame, cx, cy, pixels) of every frame; each counts for max(1, pixels / cell_pixels) people."""
    own = labelled(cells)[0].join(cells.groupBy("frame", "cx", "cy").agg(F.sum("pixels").alias("pixels")), ["frame", "cx", "cy"])
    return own.groupBy("frame", "label_x", "label_y").agg(F.count("*").alias("cells"), F.sum("pixels").alias("pixels")).withColumn("people", F.greatest(F.lit(1.0), F.col("pixels") / cell_pixels))


def blob_density(gray: DataFrame, offset: float = 40.0, cell_pixels: float = 78.0, scale: float = 1.0) -> DataFrame:
    """Gray grids to people mass: the dark mask's components, each with max(1, cells / cell_pixels) people spread evenly over its cells.

    frame, cx, cy, label_x, label_y, mass; cells outside the mask hold none and have no row.
    """
    own, _ = labelled(mask(gray, offset))
    size = own.groupBy("frame", "label_x", "label_y").agg(F.count("*").alias("cells"))
    people = F.greatest(F.lit(1.0), F.col("cells") / cell_pixels)
    return own.join(size, ["frame", "label_x", "label_y"]).select("frame", "cx", "cy", "label_x", "label_y", (scale * people / F.col("cells")).alias("mass"))


def mask(gray: DataFrame, offset: float = 40.0) -> DataFrame:
    """Dark pixels (frame, cx, cy) of gray grids (frame, cx, cy, gray): below the frame's median less `offset`, opened by 2 x 2.

    Opening leaves a pixel if one of the four up and left of it (itself included) has all four up and left of it in the
    mask; pixels beyond the edge don't count. Both steps are a four-fold explode and a keyed sum.
    """
    middle = gray.groupBy("frame").agg(F.percentile("gray", F.lit(0.5)).alias("middle"), F.min("cx").alias("x0"), F.min("cy").alias("y0"))
    dark = gray.join(middle, "frame").where(F.col("gray") < F.col("middle") - offset).select("frame", "cx", "cy", "x0", "y0")
    four = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    spread = lambda d: d.select("frame", "x0", "y0", "cx", "cy", F.inline(four)).withColumns({"cx": F.col("cx") + F.col("i"), "cy": F.col("cy") + F.col("j")})
    own = spread(dark).groupBy("frame", "x0", "y0", "cx", "cy").agg(F.count("*").alias("n"))
    within = (1 + (F.col("cx") > F.col("x0")).cast("int")) * (1 + (F.col("cy") > F.col("y0")).cast("int"))
    eroded = own.where(F.col("n") == within)
    size = gray.groupBy("frame").agg(F.max("cx").alias("x1"), F.max("cy").alias("y1"))
    grown = spread(eroded).select("frame", "cx", "cy").distinct().join(size, "frame")
    return grown.where("cx <= x1 and cy <= y1").select("frame", "cx", "cy")


def kernel(sigma: float) -> list[float]:
    """Gaussian weights of an odd width of about three sigma, with sum 1."""
    half = (int(sigma * 3) | 1) // 2
    w = [float(np.exp(-(i * i) / (2 * sigma * sigma))) for i in range(-half, half + 1)]
    return [v / sum(w) for v in w]


def blurred(cells: DataFrame, axis: str, size: int, weights: list[float]) -> DataFrame:
    """Mass (frame, cx, cy, mass) spread along an axis of `size` cells; what would leave comes back mirrored at the edge cells."""
    half, at, end = len(weights) // 2, F.col(axis), size - 1
    mirrored = F.array_compact(F.array(at, F.when(at > 0, -at), F.when(at < end, 2 * end - at)))
    d = cells.withColumn("_from", F.explode(mirrored)).where(F.col("_from").between(-half, end + half))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("_to", F.col("_from") + F.col("_o")).where(F.col("_to").between(0, end))
    d = d.withColumn("mass", F.col("mass") * F.get(F.array(*map(F.lit, weights)), F.col("_o") + half)).withColumn(axis, F.col("_to"))
    return d.groupBy("frame", "cx", "cy").agg(F.sum("mass").alias("mass"))


def density_field(points: DataFrame, scene: Scene, cell: int, smooth_m: float = 0.75) -> DataFrame:
    """People per square metre of every cell, smoothed by about a metre: cell masses blurred along both axes, divided by the cell's ground area.

    Cell areas are sums over the cell's pixels; the width of the blur follows from their median, between 3 and 60 cells.
    """
    (width, height), h = scene.frame_size, ground(scene)
    nx, ny = width // cell, height // cell
    area = np.abs(np.linalg.det(h)) / np.maximum(np.abs(h[2, 0] * (np.arange(nx * cell) + 0.5)[None, :] + h[2, 1] * (np.arange(ny * cell) + 0.5)[:, None] + h[2, 2]), 1e-9) ** 3
    area = area.reshape(ny, cell, nx, cell).sum(axis=(1, 3))
    weights = kernel(float(np.clip(smooth_m / np.sqrt(np.median(area)), 3.0, 60.0)))
    inside = regrid(points, cell).where(F.col("cx").between(0, nx - 1) & F.col("cy").between(0, ny - 1))
    smooth = blurred(blurred(inside, "cx", nx, weights), "cy", ny, weights)
    areas = points.sparkSession.createDataFrame([(x, y, float(area[y, x])) for x in range(nx) for y in range(ny)], "cx long, cy long, area_m2 double")
    return smooth.join(areas, ["cx", "cy"]).select("frame", "cx", "cy", (F.col("mass") / F.greatest("area_m2", F.lit(1e-9))).alias("density"))


def peaks(field: DataFrame) -> DataFrame:
    """The highest density of each field: frame, heat_max."""
    return field.groupBy("frame").agg(F.max("density").alias("heat_max"))


def throttled(times: DataFrame, every_s: float, block_s: float | None = None) -> DataFrame:
    """The rows (t, ...) that are published: the first one, then always the next one at least `every_s` after the last published.

    Which rows follow depends on where the chain stands, so inside a block of time every row that may be the block's
    first published one (those within `every_s` of its first row and the one after) begins a chain of its own, and all chains of a block are walked at
    once; together they have about as many steps as the block has rows. A block then is a map from its entry to the entry of the next block, the maps of all blocks are followed in
    order once (a row or a few each), and each block keeps the chain of its entry. Null times are left out; rows of equal time
    count as one, of which one is kept.
    """
    size = max(block_s or PUBLISH_BLOCK_S, 2 * every_s)
    steps = Steps(times.sparkSession)
    rows = steps.keep("times", times.where("t is not null").dropDuplicates(["t"]).withColumn("block", F.floor(F.col("t") / size)))

    def chains(block: pd.DataFrame) -> pd.DataFrame:
        """start, t of every chain of a block, a row each, the last of them the first time behind the block's reach (null t: the chain's end)."""
        t = np.sort(block["t"].to_numpy())
        follow = np.searchsorted(t, t + every_s)
        while len(t) and (wrong := (follow < len(t)) & (t[np.minimum(follow, len(t) - 1)] - t < every_s)).any():
            follow = follow + wrong  # t + every_s was rounded down
        starts = np.arange(min(len(t), int(np.searchsorted(t, t[0] + every_s)) + 1) if len(t) else 0)
        out_start, out_at, at = [], [], starts
        own = starts
        while len(at):
            out_start.append(own)
            out_at.append(at)
            nxt = follow[at]
            own, at = own[nxt < len(t)], nxt[nxt < len(t)]
        a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (out_start, out_at))
        return pd.DataFrame({"block": block["block"].iloc[0] if len(block) else 0, "start": t[a], "t": t[b]})

    walked = steps.keep("chains", rows.groupBy("block").applyInPandas(chains, "block long, start double, t double"))
    ends = steps.keep("ends", walked.groupBy("block", "start").agg(F.max("t").alias("end")))

    def followed(batches):
        """(block, start) of the chain that is published in each block; batches are sorted by block and start."""
        last, held, block = None, [], None

        def enter(last, held):
            for start, end in held:
                if last is None or start - last >= every_s:
                    return start, end
            return None

        for batch in batches:
            out = []
            for b, start, end in zip(batch["block"].tolist(), batch["start"].tolist(), batch["end"].tolist()):
                if b != block and held:
                    found = enter(last, held)
                    if found:
                        out.append((block, found[0]))
                        last = found[1]
                    held = []
                block = b
                held.append((start, end))
            yield pd.DataFrame(out, columns=["block", "start"])
        found = enter(last, held)
        yield pd.DataFrame([(block, found[0])] if found else [], columns=["block", "start"])

    used = steps.keep("used", ends.repartition(1).sortWithinPartitions("block", "start").mapInPandas(followed, "block long, start double"))
    kept = walked.join(used, ["block", "start"]).select("t")
    return rows.drop("block").join(kept, "t", "left_semi")


def shown(field: DataFrame, every_s: float, start: float = 0.0) -> DataFrame:
    """frame, heat_max and colour index of the published fields: the first one, then each at least `every_s` after the last published (see `throttled`)."""
    d = peaks(field).withColumn("t", F.lit(start) + F.col("frame"))
    return throttled(d, every_s).drop("t").withColumn("idx", colour_index(F.col("heat_max")))
