"""Operator 12: near-duplicate embeddings by sorted projection passes.

A pass gives every vector a key of concatenated random hashes and orders all vectors by it; each is compared, in double
precision, with those at most `WINDOW` places before it (up to twice as many). A hash projects the vector on ARMS random
directions and takes the direction of the largest absolute value with its sign, 128 outcomes; at a cosine of 0.9 two
vectors agree on one with probability AGREE, so in an order of n rows they stand within a window with probability about
AGREE**(log(n / WINDOW) / log(2 * ARMS)). The number of passes follows from n, so that a pair at the threshold is missed by
all of them with probability MISS at most (by this estimate; closer pairs far less often).

Equal vectors are one class from the start. Groups of close copies aren't expanded into pairs either: before the link
passes, a few home passes give a vector with an earlier one in its window within half the threshold's angle that one as its home.
Any two vectors of one home are then linked for certain (angles add up), whatever their number. The homes and the
vectors without one go on, a home with the radius of its members. Two homes whose angle is at most the threshold's less both
radii are linked with all their members; where it is at most the threshold's and both radii, members are compared in tiles.

A window holds a bounded number of rows. Where at least half of what it could hold is linked with a row, that row is
crowded: all crowded rows of a component are compared with each other in tiles, outside the windows, so the bound loses nothing there.
Tiles return counts of links by row, not pairs.

Orders are range-partitioned by (key, number), so equal keys spread over tasks; a window doesn't reach over the border of
two partitions, other passes have other borders. Links are united by the alternating stars of `components`.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components are linked with nothing, and so
are rows with a null vec_id (their component is null) and vectors of different lengths. Repeated rows are each other's links, a repeated
vec_id with another vector is classed by its own vector. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .neardup import components
from .text import Tables, table

LEAST = 0.9
WINDOW, ARMS, HASHES, AGREE, MISS = 512, 64, 5, 0.46, 0.02
#: Home passes; members of a home per tile row, crowded rows a tile.
HOME_PASSES, TILE = 3, 1024
#: Slack of angles and cosines in the sufficient conditions, far above the rounding of sums.
_EPS = 1e-9


def passes(n: int) -> int:
    """Link passes over n rows."""
    p = AGREE ** max(0.0, math.log(max(n, 1) / WINDOW, 2 * ARMS))
    return max(3, math.ceil(math.log(MISS) / math.log(1 - min(p, 1 - 1e-9))))


def unit(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column of one length, as rows of norm 1."""
    x = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # exact; squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@lru_cache(maxsize=1024)
def directions(turn: int, hash_: int, dims: int) -> np.ndarray:
    return np.random.default_rng((turn, hash_, dims)).standard_normal((dims, ARMS))


def keys(x: np.ndarray, first: int, count: int) -> np.ndarray:
    """The sort keys of the passes first, first + 1, ..."""
    out = np.zeros((len(x), count), dtype=np.int64)
    for p in range(count):
        for h in range(HASHES):
            far = x @ directions(first + p, h, x.shape[1])
            arm = np.abs(far).argmax(axis=1)
            out[:, p] = out[:, p] * (2 * ARMS) + 2 * arm + (far[np.arange(len(x)), arm] > 0)
    return out


def runs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the rows that agree in the named columns."""
    if batch.num_rows:
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in names:
            v = batch[c].to_numpy()
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        yield from zip(cuts, cuts[1:])


def keyed(first: int, count: int):
    """Adds `keys` of so many passes to rows (node, dims, v, ...)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            dims = batch["dims"].to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                for part in np.array_split(at, max(1, len(at) // 2048)):
                    for i, k in zip(part.tolist(), keys(unit(batch["v"].take(pa.array(part)), d), first, count), strict=True):
                        out[i] = k
            yield batch.append_column("keys", pa.array(out, pa.list_(pa.int64())))

    return add


def windows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[int, dict, np.ndarray]]:
    """(old, columns, unit vectors) of stretches of a sorted partition: the WINDOW rows before (the first `old`), then up to WINDOW new ones, all of one length."""
    held: tuple | None = None
    for batch in batches:
        for s, e in runs(batch, "dims"):
            dims = batch["dims"][s].as_py()
            for a in range(s, e, WINDOW):
                part = batch.slice(a, min(WINDOW, e - a))
                cols, x = {c: part[c].to_numpy(zero_copy_only=False) for c in names}, unit(part["v"], dims)
                old = 0
                if held is not None and held[0] == dims:
                    old = len(held[2])
                    cols, x = {c: np.concatenate([held[1][c], v]) for c, v in cols.items()}, np.concatenate([held[2], x])
                yield old, cols, x
                held = dims, {c: v[-WINDOW:] for c, v in cols.items()}, x[-WINDOW:]


def homes(close: float):
    """(node, home): rows with a leader among the rows before them at a cosine of `close` or more; the closest one. Rows without one lead."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads: dict[int, bool] = {}  # of the rows a window still holds
        for old, cols, x in windows(batches, "node"):
            node, near = cols["node"], x[old:] @ x.T
            lead = np.array([leads.get(n, True) for n in node[:old].tolist()] + [True] * (len(node) - old), dtype=bool)
            who, home = [], []
            before = np.tril(near >= close, old - 1)
            for j in np.flatnonzero(before.any(axis=1)).tolist():
                may = before[j] & lead
                if may.any():
                    lead[old + j] = False
                    who.append(node[old + j])
                    home.append(node[int(np.where(may, near[j], -2).argmax())])
            leads = dict(zip(node.tolist(), lead.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(home, pa.int64())], names=["node", "home"])

    return found


def judged(cos: np.ndarray, ra: np.ndarray, rb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(all members linked, some perhaps) for rows with radii; two rows of radius 0 are judged by their cosine alone."""
    angle, most, r = np.arccos(np.clip(cos, -1, 1)), math.acos(least), ra + rb
    points = r == 0
    return np.where(points, cos >= least, angle + r <= most - _EPS), ~points & (angle + r > most - _EPS) & (angle - r <= most + _EPS)


def forest(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a boolean matrix of links: the smallest row that each row and each column is connected with; len(w) for columns without a link."""
    rows, none = np.arange(len(w)), len(w)
    while True:
        cols = np.where(w, rows[:, None], none).min(axis=0, initial=none)
        now = np.minimum(rows, np.where(w, cols[None, :], none).min(axis=1, initial=none))
        if (now == rows).all():
            return rows, cols
        rows = now


def linked(least: float):
    """(a, b, whole): rows of one window whose members are all linked, or perhaps; and (a, a, false) for crowded rows.

    Crowded rows meet again in tiles, so for links of two of them a few pairs that connect the same rows are enough.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for old, cols, x in windows(batches, "node", "radius"):
            node, r = cols["node"], cols["radius"]
            near = x[old:] @ x.T
            j, i = np.nonzero(np.tril(near >= math.cos(min(math.pi, math.acos(least) + 2 * float(r.max()) + _EPS)), old - 1))
            whole, part = judged(near[j, i], r[old + j], r[i], least)
            tally = np.bincount(np.r_[i[whole | part], old + j[whole | part]], minlength=len(node)) + np.array([seen.get(n, 0) for n in node[:old].tolist()] + [0] * (len(node) - old))
            full = tally >= WINDOW // 2
            dense = whole & full[i] & full[old + j]
            ends = [np.zeros(0, dtype=np.int64)] * 2
            if dense.any():
                own, other = np.unique(j[dense]), np.unique(i[dense])
                w = np.zeros((len(own), len(other)), dtype=bool)
                w[np.searchsorted(own, j[dense]), np.searchsorted(other, i[dense])] = True
                rows, cols = forest(w)
                ends = [np.r_[old + own, other], old + own[np.r_[rows, cols]]]
            use = (whole | part) & ~dense
            low, high = node[np.r_[i[use], ends[0]]], node[np.r_[old + j[use], ends[1]]]
            apart = low != high
            low, high, sure = low[apart], high[apart], np.r_[whole[use], np.ones(len(ends[0]), dtype=bool)][apart]
            seen = {n: t for n, t in zip(node.tolist(), tally.tolist(), strict=True) if t}
            crowd = node[full]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.minimum(low, high), crowd], pa.int64()), pa.array(np.r_[np.maximum(low, high), crowd], pa.int64()), pa.array(np.r_[sure, np.zeros(len(crowd), dtype=bool)])], names=["a", "b", "whole"])

    return found


def compared(least: float):
    """Links inside tiles: (node, n) with the rows linked with a node, (node, -1, other) for pairs that connect what is linked, (node, 0, other) for two homes whose members need a look.

    Batches are sorted by (ga, gb, ta, tb, side). Side 0 is held; side 1, or side 0 itself in a tile without one (solo), meets it.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for s, e in runs(batch, "ga", "gb", "ta", "tb", "side"):
                part = batch.slice(s, e - s)
                key, side, solo = tuple(part[c][0].as_py() for c in ("ga", "gb", "ta", "tb")), part["side"][0].as_py(), part["solo"][0].as_py()
                if key != at:
                    at, held = key, []
                own = tuple(part[c].to_numpy() for c in ("node", "size", "radius")) + (unit(part["v"], part["dims"][0].as_py()),)
                if side == 0:
                    for h in held if solo else ():
                        out.extend(_met(h, own, least, False))
                    if solo:
                        out.extend(_met(own, own, least, True))
                    held.append(own)
                else:
                    for h in held:
                        out.extend(_met(h, own, least, False))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "n", "other"])

    return found


def _met(a: tuple, b: tuple, least: float, same: bool) -> list[tuple]:
    cos = a[3] @ b[3].T
    whole, part = judged(cos, a[2][:, None], b[2][None, :], least)
    if same:
        np.fill_diagonal(whole, False)
        part = np.triu(part, 1)
    out = [(n, c, None) for nodes, counts in [(a[0], whole @ b[1])] + ([] if same else [(b[0], a[1] @ whole)]) for n, c in zip(nodes.tolist(), counts.tolist(), strict=True) if c]
    for nodes, label in zip((a[0], b[0]), forest(whole), strict=True):
        out.extend((n, -1, a[0][k].item()) for n, k in zip(nodes.tolist(), label.tolist(), strict=True) if k < len(whole) and n != a[0][k])
    i, j = np.nonzero(part)
    return out + [(min(x, y), 0, max(x, y)) for x, y in zip(a[0][i].tolist(), b[0][j].tolist(), strict=True)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a hash of the vector to rows (vec_id, v); null for vectors that are linked with nothing."""
    for batch in batches:
        v, found = batch["v"], []
        size, flat = pa.compute.list_value_length(v).fill_null(0).to_numpy(), pa.compute.list_flatten(v).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) + 0.0  # no negative zero
        end = np.cumsum(size)
        for a, b in zip((end - size).tolist(), end.tolist()):
            x = flat[a:b]
            found.append(xxhash.xxh3_128_digest(x.tobytes()) if b > a and np.isfinite(x).all() and x.any() else None)
        yield batch.append_column("key", pa.array(found, pa.binary()))


def _sorted(rows: DataFrame, turn: int) -> DataFrame:
    key = F.get("keys", F.lit(turn))
    own = rows.withColumn("_k", key).drop("keys")
    return own.repartitionByRange("dims", "_k", "node").sortWithinPartitions("dims", "_k", "node")


def _gathered(rows: DataFrame, tables: Tables, close: float, least: float) -> DataFrame:
    """(node, home, radius, size, ...) of every class: its home, itself where it leads or stands alone."""
    vectors = rows.select("node", "dims", "v", "copies")
    known = rows.drop("copies").mapInArrow(keyed(0, HOME_PASSES), T.StructType([*rows.drop("copies").schema.fields]).add("keys", T.ArrayType(T.LongType())))
    live = tables.keep("live", known)
    steps = []
    for t in range(HOME_PASSES):
        steps.append(tables.keep(f"homes{t}", _sorted(live, t).mapInArrow(homes(close), "node long, home long")))
        live = live.join(steps[-1].select("node"), "node", "left_anti")
    # a home of one pass may have a home in a later one
    chased = steps[0]
    for later in steps[1:]:
        moved = chased.join(later.select(F.col("node").alias("home"), F.col("home").alias("next")), "home", "left").select("node", F.coalesce("next", "home").alias("home"))
        chased = moved.unionByName(later)
    chased = tables.keep("chased", chased)
    # the angle to the home that is left; homes stand by in as many copies as their members have tiles
    parts = tables.keep("parts", chased.groupBy("home").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")))
    held = parts.join(vectors.select(F.col("node").alias("home"), F.col("v").alias("hv")), "home").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    own = chased.join(parts, "home").withColumn("part", F.pmod(F.hash("node"), "parts")).join(vectors, "node")
    cos = tables.keep("angles", own.select("node", "home", "part", "v", "dims").join(held.select("home", "part", "hv"), ["home", "part"]).select("node", "home", _cosine("v", "hv").alias("cos")).where(F.col("cos") >= close))
    radius = cos.groupBy("home").agg(F.acos(F.least(F.min("cos"), F.lit(1.0))).alias("radius"))
    member = cos.select("node", "home")
    known = vectors.select("node", "dims", "copies").join(member, "node", "left").withColumn("home", F.coalesce("home", "node"))
    sizes = known.groupBy("home").agg(F.sum("copies").alias("size"), F.count("*").alias("members"))
    out = tables.keep("sizes", sizes.join(radius, "home", "left").withColumn("radius", F.coalesce("radius", F.lit(0.0)) + F.when(F.col("members") > 1, _EPS).otherwise(0.0)))
    members = tables.keep("members", known.select("node", "home", "copies", "dims"))
    tables.drop("live", *(f"homes{t}" for t in range(HOME_PASSES)), "chased", "parts", "angles")
    return members.join(out, "home")


@F.arrow_udf(T.DoubleType())
def _cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    size = pa.compute.list_value_length(left).to_numpy()
    out = np.zeros(len(left))
    for d in np.unique(size).tolist():
        at = pa.array(np.flatnonzero(size == d))
        out[size == d] = (unit(left.take(at), d) * unit(right.take(at), d)).sum(axis=1)
    return pa.array(out)


_TILE_ROW = ("ga", "gb", "ta", "tb", "side", "solo", "node", "size", "radius", "dims", "v")


def _tiles(rows: DataFrame, least: float) -> DataFrame:
    laid = rows.select(*_TILE_ROW).repartition("ga", "gb", "ta", "tb").sortWithinPartitions("ga", "gb", "ta", "tb", "side")
    return laid.mapInArrow(compared(least), "node long, n long, other long")


def _crowds(crowded: DataFrame, comps: DataFrame, heads: DataFrame, tables: Tables, least: float) -> DataFrame:
    """Counts and doubtful pairs among the crowded rows of each component, in tiles of TILE x TILE."""
    own = tables.keep("crowd", crowded.join(comps, "node"))
    size = own.groupBy("comp").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    rows = own.join(size, "comp").withColumn("t", F.pmod(F.hash("node"), "parts")).withColumn("o", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.select(F.col("comp").alias("ga"), F.col("comp").alias("gb"), F.least("t", "o").alias("ta"), F.greatest("t", "o").alias("tb"), (F.col("t") > F.col("o")).cast("int").alias("side"), (F.col("t") == F.col("o")).alias("solo"), "node")
    return tables.keep("crowd_links", _tiles(rows.join(heads, "node"), least))


def _members(pairs: DataFrame, members: DataFrame, vectors: DataFrame, tables: Tables, least: float) -> DataFrame:
    """Links between the members of two homes each (a, b), in tiles: node, n, other."""
    wanted = tables.keep("wanted", pairs.select(F.explode(F.array("a", "b")).alias("home")).distinct())
    placed = tables.keep("placed", members.join(wanted, "home").withColumn("t", F.pmod(F.hash("node"), F.ceil(F.col("members") / TILE).cast("int"))).select("home", "t", "node", "copies"))
    tiles = placed.select("home", "t").distinct()
    side = lambda k: tiles.select(F.col("home").alias(k), F.col("t").alias(f"t{k}"))
    met = tables.keep("met", pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b"))
    both = met.select("*", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("home"), F.col("ta").alias("t")), F.struct(F.lit(1).alias("side"), F.col("b").alias("home"), F.col("tb").alias("t")))))
    rows = both.join(placed, ["home", "t"]).join(vectors, "node")
    rows = rows.select(F.col("a").alias("ga"), F.col("b").alias("gb"), "ta", "tb", "side", F.lit(False).alias("solo"), "node", F.col("copies").alias("size"), F.lit(0.0).alias("radius"), "dims", "v")
    return tables.keep("member_links", _tiles(rows, least))


def classify(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", least: float = LEAST) -> DataFrame:
    """One row for each row of `vectors`: vec_id, n_links, component_id, kept."""
    tables = Tables(vectors.sparkSession)
    close = math.cos(math.acos(least) / 2 - _EPS)
    kind = vectors.schema[vec_id].dataType
    held = vectors.schema[embedding].dataType
    v = F.col(embedding) if isinstance(held, T.ArrayType) and isinstance(held.elementType, T.FloatType) else F.col(embedding).cast("array<double>")
    own = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v"))
    rows = tables.keep("rows", own.mapInArrow(_read, T.StructType([*own.schema.fields]).add("key", T.BinaryType())))
    named = rows.where("key is not null and vec_id is not null")
    classes = named.groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = tables.keep("classes", classes.select(F.monotonically_increasing_id().alias("node"), "key", "first", "copies", F.size("v").alias("dims"), "v"))
    data = classes.select("node", "dims", "v")
    members = tables.keep("gathered", _gathered(classes.select("node", "dims", "v", "copies"), tables, close, least))
    heads = tables.keep("heads", members.where("node = home").select("node", "dims", "size", "radius").join(data.drop("dims"), "node"))
    count = passes(heads.count())
    known = tables.keep("keyed", heads.drop("size").mapInArrow(keyed(HOME_PASSES, count), T.StructType([*heads.drop("size").schema.fields]).add("keys", T.ArrayType(T.LongType()))))
    found = [tables.keep(f"pass{t}", _sorted(known, t).mapInArrow(linked(least), "a long, b long, whole boolean")) for t in range(count)]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    pairs = tables.keep("pairs", every.groupBy("a", "b").agg(F.max("whole").alias("whole")))
    crowded = tables.keep("crowded", pairs.where("a = b").select(F.col("a").alias("node")))
    tables.drop("keyed", *(f"pass{t}" for t in range(count)))
    pairs = pairs.where("a <> b")
    near = components(pairs, tables, "near")
    counts = _crowds(crowded, near, heads, tables, least)
    inside = lambda k: near.join(crowded, "node").select(F.col("node").alias(k), F.col("comp").alias(f"c{k}"))
    # two crowded rows of one component have met in the tiles: what the windows found between them is counted there
    seen = pairs.join(inside("a"), "a", "left").join(inside("b"), "b", "left").where("ca is null or cb is null or ca <> cb").select("a", "b", "whole")
    doubtful = seen.where("not whole").select("a", "b").unionByName(counts.where("n = 0").select(F.col("node").alias("a"), F.col("other").alias("b"))).distinct()
    looked = _members(tables.keep("doubtful", doubtful), members, data, tables, least)
    whole = tables.keep("whole", seen.where("whole").select("a", "b"))
    both = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    by_home = both.join(heads.select(F.col("node").alias("b"), "size"), "b").select(F.col("a").alias("home"), F.col("size").alias("n")).unionByName(counts.where("n > 0").select(F.col("node").alias("home"), "n"))
    by_home = tables.keep("by_home", by_home.groupBy("home").agg(F.sum("n").alias("h")))
    by_node = looked.where("n > 0").groupBy("node").agg(F.sum("n").alias("m"))
    links = members.join(by_home, "home", "left").join(by_node, "node", "left")
    links = links.select("node", "home", (F.col("size") - 1 + F.coalesce("h", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n_links"))
    of = members.select("node", "home")
    inner = looked.where("n = -1").join(of, "node").select(F.col("home").alias("a"), F.col("other").alias("node")).join(of, "node").select("a", F.col("home").alias("b")).distinct()
    ends = pairs.where("whole").select("a", "b").unionByName(counts.where("n = -1").select(F.col("node").alias("a"), F.col("other").alias("b"))).unionByName(inner)
    comps = components(ends, tables, "comps")
    named = links.join(comps.withColumnRenamed("node", "home"), "home", "left").withColumn("comp", F.coalesce("comp", "home")).join(classes.select("node", "key", "first"), "node")
    named = tables.keep("named", named.select("key", "n_links", "comp", "first"))
    least_id = tables.keep("least", named.groupBy("comp").agg(F.min("first").alias("component_id")))
    of_key = tables.keep("of_key", named.join(least_id, "comp").select("key", "n_links", "component_id"))
    one = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(of_key, "key", "left")
    out = tables.keep("out", one.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")))
    tables.drop("rows", "classes", "members", "sizes", "gathered", "heads", "pairs", "crowded", "near", "crowd", "crowd_links", "doubtful", "wanted", "placed", "met", "member_links", "whole", "by_home", "comps", "named", "least", "of_key")
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "embeddings"))


OP12_SQL = f"""
with recursive v as materialized (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: isfinite(x::double))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {LEAST}),
reach as (select vec_id a, vec_id b from v union select reach.a, l.b from reach join l on reach.b = l.a),
c as (select a vec_id, min(b) m from reach group by a), n as (select a vec_id, count(*) n from l group by a)
select vec_id, coalesce(n, 0)::bigint n_links, coalesce(m, vec_id) component_id, coalesce(m, vec_id) = vec_id kept from embeddings left join c using (vec_id) left join n using (vec_id)"""
