"""Operator 9: near-duplicate documents by fast similarity sketching.

A document's set is its distinct 5-word shingles (lower-cased A-Z, words between spaces and \\t..\\r), held as
64-bit hashes; a text of 1 to 4 words has its whole word sequence as the one shingle. Fast similarity
sketching fills BINS coordinates: in round i < BINS every shingle falls into a hashed bin with the value
(i, hash), in round BINS + j every shingle falls into bin j; the smallest value of a bin counts, and the rounds
stop once all bins are full (the last BINS rounds make sure of that). Documents that agree on one of BANDS bands
meet in a bucket, which at a similarity of 0.85 misses a pair with probability (1 - 0.85**5)**25 < 1e-6. Pairs of a
bucket whose sketches agree on fewer than AGREE coordinates (another 1e-6 at 0.85) are no candidates. A link needs
100 * intersection >= 85 * union on the full sets.

Equal sets become one class first, named by its smallest doc_id, so a group of copies costs one row. A bucket is
dealt into blocks of about BLOCK members, its first member standing in each. No pair list of a group is made:

1. in its block, a document is compared in full with the most similar candidate before it and after it only,
   which nearly always joins a group of near copies at once;
2. where a bucket still holds several components, a document outside its largest component (a straggler) with a
   candidate of another component in it is compared in full with all of the largest component and with its other
   stragglers. These are laid out in tiles (TILE): a tile's sets are held, up to so many shingles, the stragglers stream by.

So no link between components is lost, and no rows are made for pairs. A straggler is repeated once for each tile of its family: where a
family of documents just under the threshold is larger than a tile, rows grow with its square divided by a tile's number of documents (thousands), and the
comparisons inside the tiles with its square, which exact verification can't avoid. Sets travel as packed hashes, made once a class.

Defined cases: a null or wordless text has an empty set, is linked with nothing and is kept; repeated rows with
the same text fall in one class; rows that repeat a doc_id with another text are classed by their own text; a
null doc_id is never a class's name unless all ids of the class are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .text import Tables, chunks, free, space_words, table, utf8

SHINGLE, BINS, BANDS = 5, 125, 25
PERCENT = 85
#: Coordinates of BINS (by 4 bits each) that a candidate's sketch shares at least, 4.75 standard deviations below the mean at 0.85.
AGREE = 88
#: Members of a block; shingles held and stragglers of a tile. Buckets up to SMALL members are settled by step 1: all their candidates are compared.
BLOCK, TILE, SMALL = 512, (1_000_000, 4096), 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = space_words(text or b"")
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(words))
    h = np.full(len(ids) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        h = (h ^ ids[j : j + len(h)]) * _A
        h ^= h >> np.uint64(32)
    return np.unique(h)


def sketch(items: np.ndarray) -> np.ndarray:
    """BINS coordinates of a non-empty set."""
    best = np.full(BINS, _FULL, dtype=np.uint64)
    done, n = 0, len(items)
    while done < BINS and (best == _FULL).any():
        count = min(BINS - done, 16, max(1, 1200 // n))  # further rounds change no full bin: values carry their round
        rounds = np.arange(done, done + count, dtype=np.uint64)[:, None]
        h = _mixed(items[None, :] * _B + (rounds + np.uint64(1)) * _A)
        np.minimum.at(best, (h % np.uint64(BINS)).astype(np.int64).ravel(), (rounds << np.uint64(56) | h >> np.uint64(8)).ravel())
        done += count
    for j in np.flatnonzero(best == _FULL).tolist():
        h = _mixed(items * _B + np.uint64((BINS + j + 1) * int(_A) % 2**64))
        best[j] = np.uint64(BINS + j) << np.uint64(56) | h.min() >> np.uint64(8)
    return best


def bands(coordinates: np.ndarray) -> np.ndarray:
    s = coordinates.reshape(BANDS, BINS // BANDS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _B
    for j in range(s.shape[1]):
        h = _mixed((h ^ s[:, j]) * _A)
    return h.view(np.int64)


def nibbles(coordinates: np.ndarray) -> bytes:
    """The low four bits of every coordinate, two a byte."""
    low = np.append(coordinates & np.uint64(15), np.zeros(len(coordinates) % 2, dtype=np.uint64)).astype(np.uint8)
    return (low[0::2] | low[1::2] << 4).tobytes()


_SKETCH = pa.struct([("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("mini", pa.binary())])


@F.arrow_udf(T.StructType().add("n", T.LongType()).add("key", T.BinaryType()).add("bands", T.ArrayType(T.LongType())).add("mini", T.BinaryType()))
def sketched(column: pa.Array) -> pa.Array:
    """Set size, hash of the set, bands and nibbles; the last three null for an empty set."""
    texts, n, key, found, mini = utf8(column), [], [], [], []
    for a, b in chunks(texts):
        for t in texts[a:b]:
            items = shingles(t)
            s = sketch(items) if len(items) else None
            n.append(len(items))
            key.append(None if s is None else xxhash.xxh3_128_digest(items.tobytes()))
            found.append(None if s is None else bands(s))
            mini.append(None if s is None else nibbles(s))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(mini, pa.binary())], fields=list(_SKETCH))


def agreement(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sketches (a row per document, a byte per coordinate) and set sizes of a batch."""
    packed = np.frombuffer(b"".join(batch["mini"].to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
    return np.stack([packed & 15, packed >> 4], axis=2).reshape(batch.num_rows, -1)[:, :BINS], batch["n"].to_numpy()


def candidate(one: np.ndarray, many: np.ndarray, n: int | np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shared coordinates where sizes and sketches allow a link, else -1."""
    same = (many == one).sum(axis=-1, dtype=np.int16)
    return np.where((same >= AGREE) & (100 * np.minimum(n, sizes) >= PERCENT * np.maximum(n, sizes)), same, -1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks from batches sorted by (bucket, block); only the last block read is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, block = batch["bucket"].to_numpy(), batch["block"].to_numpy()
        cut = int(np.flatnonzero((bucket != bucket[-1]) | (block != block[-1]))[-1]) + 1 if (bucket[0], block[0]) != (bucket[-1], block[-1]) else 0
        if cut or (held and (held[-1]["bucket"][0].as_py(), held[-1]["block"][0].as_py()) != (bucket[-1], block[-1])):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of each member with its most similar candidate before it and after it in its block; ties go to the nearer id."""
    for whole in blocks(batches):
        marks, sizes = agreement(whole)
        bucket, block = whole["bucket"].to_numpy(), whole["block"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])])
        counts = np.diff(np.r_[starts, len(bucket)])
        group = np.repeat(np.arange(len(starts)), counts)
        rows = np.arange(len(bucket))
        before, after = np.full((2, len(bucket)), -1), np.full((2, len(bucket)), -1)  # score, place

        def met(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
            better = score > before[0, j]
            before[:, j[better]] = score[better], i[better]
            better = score > after[0, i]
            after[:, i[better]] = score[better], j[better]

        small = counts <= 8
        extra: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(1, 8):  # many small blocks at once
            i = rows[:-d][(group[:-d] == group[d:]) & small[group[:-d]]]
            if len(i):
                score = candidate(marks[i], marks[i + d], sizes[i], sizes[i + d])
                met(i, i + d, score)
                whole_group = i[(score >= 0) & (counts[group[i]] <= SMALL)]
                extra.append((whole_group, whole_group + d))
        for s, c in zip(starts[~small].tolist(), counts[~small].tolist(), strict=True):
            for j in range(s + 1, s + c):
                i = rows[s:j][::-1]
                score = candidate(marks[j], marks[i], sizes[j], sizes[i])
                best = int(np.argmax(score))
                if score[best] > before[0, j]:
                    before[:, j] = score[best], i[best]
                better = score > after[0, i]
                after[0, i[better]], after[1, i[better]] = score[better], j
        a = np.concatenate([before[1][before[1] >= 0], rows[after[1] >= 0], *(x for x, _ in extra)])
        b = np.concatenate([rows[before[1] >= 0], after[1][after[1] >= 0], *(x for _, x in extra)])
        node = whole["node"].combine_chunks()
        yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], names=["a", "b"])


def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(main, node, comp) of stragglers with a candidate of another component. Batches are sorted by (bucket, block, role): a block's members are held, its stragglers stream by."""
    at = held = None
    for batch in batches:
        bucket, block, role = (batch[c].to_numpy() for c in ("bucket", "block", "role"))
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])]).tolist() if batch.num_rows else []
        found: list[int] = []
        for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if at != (bucket[s], block[s]):
                at, members, held = (bucket[s], block[s]), [], None
            split = s + int(np.searchsorted(role[s:e], 1))
            if split > s:
                members.append(batch.slice(s, split - s))
            if split == e or not members:
                continue
            if held is None:
                table = pa.Table.from_batches(members)
                held = *agreement(table), table["comp"]
            own = batch.slice(split, e - split)
            own_marks, own_sizes = agreement(own)
            for k in range(e - split):
                near = candidate(own_marks[k], held[0], int(own_sizes[k]), held[1]) >= 0
                if near.any() and pa.compute.any(pa.compute.not_equal(held[2].filter(pa.array(near)), own["comp"][k])).as_py():
                    found.append(split + k)
        yield batch.select(["main", "node", "comp"]).take(pa.array(found, pa.int64()))


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of tiles, one of each straggler with each component. Batches are sorted by (main, ta, tb, side): the sets of side 0 are held, side 1 streams by."""
    at, held = None, None
    for batch in batches:
        a, b = [], []
        for packed, *key, side, node, comp in zip(batch["items"].to_pylist(), *(batch[c].to_pylist() for c in ("main", "ta", "tb", "side", "node", "comp")), strict=True):
            if at != key:
                at, names, comps, sets, held = key, [], [], [], None
            if side == 0:
                names.append(node)
                comps.append(comp)
                sets.append(np.frombuffer(packed, np.uint64))
                continue
            if not sets:
                continue
            if held is None:
                sizes = np.array([len(x) for x in sets])
                items = np.concatenate(sets)
                order = np.argsort(items, kind="stable")
                held = items[order], np.repeat(np.arange(len(sets)), sizes)[order]
            own = np.frombuffer(packed, np.uint64)
            low, high = np.searchsorted(held[0], own), np.searchsorted(held[0], own, side="right")
            runs = high - low
            both = np.bincount(held[1][np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs - low, runs)], minlength=len(sets))
            met = {comps[k]: names[k] for k in np.flatnonzero(100 * both >= PERCENT * (sizes + len(own) - both)).tolist() if comps[k] != comp}
            a.extend(met.values())
            b.extend([node] * len(met))
        kind = batch.schema.field("node").type
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])


@F.arrow_udf(T.BinaryType())
def packed(column: pa.Array) -> pa.Array:
    """The sorted shingle hashes of a text."""
    return pa.array([shingles(t).tobytes() for t in utf8(column)], pa.binary())


@F.arrow_udf(T.BooleanType())
def linked(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether 100 * intersection >= 85 * union of two packed sets."""
    out = []
    for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
        own, other = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = len(np.intersect1d(own, other, assume_unique=True))
        out.append(100 * both >= PERCENT * (len(own) + len(other) - both))
    return pa.array(out, pa.bool_())


def components(links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, comp): the smallest node reachable over links (a, b), for every node that has a link.

    Alternating large-star and small-star steps; each is a keyed minimum (combined before its shuffle) and a
    join with it. The loop ends once a step changes nothing.
    """
    edges = tables.keep(f"{name}0", links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct())
    size = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was, turn = size(edges), 0
    while was[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).where("u < v")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.greatest("u", "m").alias("v"), F.col("m").alias("u"))
        edges = tables.keep(f"{name}{turn + 1}", small.unionByName(least.select("v", F.col("m").alias("u"))).where("u < v").distinct())
        now = size(edges)
        tables.drop(f"{name}{turn}")
        turn += 1
        if now == was:
            break
        was = now
    both = edges.groupBy("v").agg(F.min("u").alias("comp")).select(F.col("v").alias("node"), "comp").unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct())
    both = tables.keep(name, both)
    tables.drop(f"{name}{turn}")
    return both


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that is sorted and merged, never sent whole.

    Spark takes the compressed files of a table for its size, and those of the rows before an `explode` for the size after it: it would send
    millions of rows, collected on the driver, for less than spark.sql.autoBroadcastJoinThreshold.
    """
    return side.hint("merge")


def _sets(nodes: DataFrame, heads: DataFrame, texts: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, items) of the nodes. A class's set is made from the text of its first row, found by its id and the hash of its text.

    The texts are cut down first by a short mark of that hash, a table of four bytes a node whose size is known: Spark sends a small one to the texts
    (up to spark.sql.autoBroadcastJoinThreshold), a larger one is joined by a shuffle. What is left is of the nodes' own size.
    """
    wanted = tables.keep(f"{name}_wanted", heads.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h")).join(merged(nodes.distinct()), "node", "left_semi"))
    marks = tables.keep(f"{name}_marks", wanted.select(F.hash("h").alias("mark")).distinct())
    few = texts.withColumn("mark", F.hash("h")).join(marks, "mark", "left_semi")
    found = few.join(merged(wanted), ["doc_id", "h"]).groupBy("node").agg(F.min("text").alias("text"))
    return tables.keep(name, found.select("node", packed("text").alias("items")))


def _verified(pairs: DataFrame, heads: DataFrame, texts: DataFrame, tables: Tables, name: str) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    few = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), heads, texts, tables, f"{name}_nodes")
    left, right = (few.select(F.col("node").alias(k), F.col("items").alias(f"items_{k}")) for k in "ab")
    return tables.keep(name, pairs.join(merged(right), "b").join(merged(left), "a").where(linked("items_a", "items_b")).select("a", "b"))


def _crossed(attached: DataFrame, comps: DataFrame, heads: DataFrame, texts: DataFrame, tables: Tables, name: str) -> DataFrame:
    """Links of the stragglers (main, node, comp) with the component `main` and with each other, compared in tiles."""
    n = merged(heads.select("node", "n"))
    size = comps.join(n, "node").groupBy(F.col("comp").alias("main")).agg(F.sum("n").alias("c"))
    own = heads.select(F.col("node").alias("main"), F.col("n").alias("alone"))  # a component of one document has no row in comps
    families = attached.join(n, "node").groupBy("main").agg(F.count("*").alias("k"), F.sum("n").alias("kn")).join(size, "main", "left").join(own, "main")
    families = families.select("main", F.ceil(F.col("k") / TILE[1]).cast("int").alias("na"), F.ceil((F.col("kn") + F.coalesce("c", "alone")) / TILE[0]).cast("int").alias("nb"))
    families = tables.keep(f"{name}_families", families)
    given = attached.join(merged(families), "main")
    inside = comps.withColumn("main", F.col("comp")).join(merged(families), "main").select("main", "node", "comp", "na", "nb")
    alone = families.select("main", F.col("main").alias("node"), F.col("main").alias("comp"), "na", "nb")
    members = inside.unionByName(alone).unionByName(given.select("main", "node", "comp", "na", "nb")).distinct()
    members = members.select("main", "node", "comp", F.lit(0).alias("side"), F.explode(F.expr("sequence(0, na - 1)")).alias("ta"), F.pmod(F.hash("node"), "nb").alias("tb"))
    streams = given.select("main", "node", "comp", F.lit(1).alias("side"), F.pmod(F.hash("node"), "na").alias("ta"), F.explode(F.expr("sequence(0, nb - 1)")).alias("tb"))
    laid = tables.keep(f"{name}_tiles", members.unionByName(streams))
    rows = laid.join(merged(_sets(laid.select("node"), heads, texts, tables, f"{name}_nodes")), "node").repartition("main", "ta", "tb").sortWithinPartitions("main", "ta", "tb", "side")
    kind = attached.schema["node"].dataType
    return tables.keep(name, rows.mapInArrow(tiles, T.StructType().add("a", kind).add("b", kind)))


def classify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id, kept."""
    return _classified(docs, text, doc_id).drop("h")


def _classified(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows of `classify` with h, a hash of the row's text."""
    tables = Tables(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    rows = tables.keep("rows", own.select("doc_id", "h", sketched("text").alias("s")).select("doc_id", "h", "s.*"))
    named = rows.where("key is not null and doc_id is not null")
    # a class has a number of its own: an id may stand for several texts
    heads = named.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("first"), *(F.first(c).alias(c) for c in ("n", "bands", "mini")))
    heads = tables.keep("heads", heads.withColumn("node", F.monotonically_increasing_id()))
    kind = T.LongType()
    pair = T.StructType().add("a", kind).add("b", kind)
    # buckets of two members or more, and the block of each member; the first member of a bucket stands in all its blocks
    spread = heads.select(F.explode("bands").alias("bucket"), "node")
    held = spread.groupBy("bucket").agg(F.count("*").alias("c"), F.min("node").alias("first")).where("c > 1").select("bucket", "first", "c", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts"))
    place = lambda node: F.pmod(F.hash("bucket", node), F.col("parts"))
    entries = tables.keep("entries", spread.join(merged(held), "bucket").select("bucket", "node", "c", "parts", place("node").alias("block"), "first"))
    firsts = entries.where("parts > 1 and node = first").select("bucket", "node", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"), "block").where("other <> block").select("bucket", "node", F.col("other").alias("block"))
    marks = heads.select("node", "n", "mini")
    wide = entries.select("bucket", "node", "block").unionByName(firsts).join(merged(marks), "node").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "node")
    pairs = tables.keep("pairs", wide.mapInArrow(nearest, pair).distinct())
    texts = own.where("doc_id is not null")
    links = _verified(pairs, heads, texts, tables, "links")
    comps = components(links, tables, "comps")
    # what is left: stragglers of larger buckets with several components
    state = marks.join(merged(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    live = tables.keep("live", entries.where(F.col("c") > SMALL).select("bucket", "node", "parts", "block").join(merged(state), "node"))
    tally = live.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("most"), F.count("*").alias("k")).where("k > 1").select("bucket", F.col("most.comp").alias("main"))
    live = live.join(tally, "bucket")
    both = live.withColumn("role", F.lit(0)).unionByName(live.where("comp <> main").withColumn("block", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("role", F.lit(1)))
    both = both.select("bucket", "block", "role", "node", "n", "mini", "comp", "main").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "role")
    left = tables.keep("left", both.mapInArrow(crossing, T.StructType().add("main", kind).add("node", kind).add("comp", kind)).distinct())
    if not left.isEmpty():
        more = _crossed(left, comps, heads, texts, tables, "more")
        ends = (comps.select(F.col("node").alias(k), F.col("comp").alias(f"comp_{k}")) for k in "ab")
        for k, end in zip("ab", ends, strict=True):
            more = more.join(merged(end), k, "left").withColumn(k, F.coalesce(f"comp_{k}", k)).drop(f"comp_{k}")
        roots = components(more, tables, "roots").select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        # a root's component may be a single document without a link of step 1
        single = roots.join(merged(comps.select("comp").distinct()), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("root").alias("comp"))
        comps = comps.join(merged(roots), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")).unionByName(single)
    of = tables.keep("of", heads.join(merged(comps), "node", "left").select("key", F.coalesce("comp", "node").alias("comp"), "first.doc_id"))
    least = tables.keep("least", of.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    classes = tables.keep("classes", of.join(merged(least), "comp").select("key", "component_id"))
    tables.drop("heads", "entries", "pairs", "links_nodes_wanted", "links_nodes_marks", "links_nodes", "links", "comps", "live", "left", "more_families", "more_tiles", "more_nodes_wanted", "more_nodes_marks", "more_nodes", "more", "roots", "of", "least")
    out = rows.select("doc_id", "h", F.col("n").alias("n_shingles"), "key").join(merged(classes), "key", "left")
    return out.select("doc_id", "h", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with one document of each group, the one with the smallest id; rows that repeat an id count once.

    Of several rows with a kept id the one with the least text stays, of those whose own text is kept. Rows with a null id can't
    be named by a group and stay as they are.
    """
    h, row = free(docs, "h"), free(docs, "row")
    kept = _classified(docs, text, doc_id).where("kept and doc_id is not null").select(F.col("doc_id").alias(doc_id), F.col("h").alias(h)).distinct()
    cols = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.withColumn(h, F.xxhash64(text)).join(kept, [doc_id, h], "left_semi")
    one = own.groupBy(doc_id).agg(F.min_by(F.struct(*cols), F.struct(F.col(text), F.xxhash64(*cols))).alias(row))
    return one.select(f"{row}.*").unionByName(docs.where(F.col(doc_id).isNull()))


def op9(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda w: w <> '') w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s from words),
flat as (select doc_id, len(s) n, unnest(s) x from sets),
pairs as (select a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) c from flat a join flat b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs where 100 * c >= 85 * (na + nb - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id r from sets union select reach.doc_id, both_ways.b from reach join both_ways on reach.r = both_ways.a)
select sets.doc_id, cast(len(s) as bigint) n_shingles, c component_id, sets.doc_id = c kept
from sets join (select doc_id, min(r) c from reach group by doc_id) m on sets.doc_id = m.doc_id"""
