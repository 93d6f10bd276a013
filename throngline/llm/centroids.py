"""Operator 11: centroid clustering with float32 screening and exact integer decisions.

A component x becomes the integer floor(scale * x). Distances to all centroids are first estimated by a float32 matrix
product. Its rounding error has a proven bound, whatever the order of the sums: with u = 2**-24 and d components,
|float32(x . c) - x . c| <= g * |x| * |c| with g = (d + 2) u / (1 - (d + 2) u), the conversion of both factors included.
So each squared distance lies in an interval (widened by the rounding of the float64 figures around it). A centroid
whose interval begins beyond the smallest interval end can't be the nearest; where more than one is left, their
distances are computed anew in 64-bit integers and the smallest, then the lowest number, wins. The distance that is
returned is always the exact one.

One round is one pass: a task adds up its vectors by centroid and returns at most k rows, Spark adds these up by
centroid and component, and the driver sees k x d sums. The vectors are read again each round, as whole columns of a
pruned scan; nothing but the final assignment is written. The first centroids are the k smallest hashes of the ids.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out.
Integers saturate at +-2**27, so that every squared distance fits in a long; an inertia that doesn't fit is null. Null
ids come last among the hashes; rows with equal hashes go by their integers. Fewer vectors than k give as many centroids. Repeated rows
count each. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F, types as T

from .text import Tables, table

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Integers saturate here: (2 * 2**27)**2 * 64 is below 2**63.
BOUND = 1 << 27
_U = 2.0**-24


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, integers) of the vectors of a list column that are kept."""
    right = np.flatnonzero(pa.compute.equal(pa.compute.list_value_length(column), dims).fill_null(False).to_numpy(zero_copy_only=False))
    x = pa.compute.list_flatten(column.take(pa.array(right))).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(right), dims)
    fine = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        return right[fine], np.clip(np.floor(scale * x[fine]), -BOUND, BOUND).astype(np.int64)


def shortlist(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Whether centroid j may be the nearest of vector i, by intervals around the float32 estimates."""
    d = x.shape[1]
    g = (d + 2) * _U / (1 - (d + 2) * _U)
    dot = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    norms, cc = (np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)) for v in (x, centroids)), (centroids * centroids).sum(axis=1)
    nx, nc = norms
    value = cc - 2 * dot  # the squared distance without |x|**2
    error = 2 * g * (1 + 1e-9) * nx[:, None] * nc + 2.0**-48 * (cc + 2 * np.abs(dot) + 1)
    return value - error <= (value + error).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, exact squared distance) of the nearest centroid of each vector; ties go to the smaller number."""
    i, j = np.nonzero(shortlist(x, centroids))
    exact = ((x[i] - centroids[j]) ** 2).sum(axis=1)
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    best = np.minimum.reduceat(exact, first)
    hit = np.flatnonzero(exact == best[i])  # i counts the vectors, each has a shortlist
    hit = hit[np.r_[True, i[hit][1:] != i[hit][:-1]]]
    return j[hit], exact[hit]


def _sums(rows: DataFrame, centroids: np.ndarray, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number and component sums of the vectors nearest to each centroid."""
    dims = centroids.shape[1]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), dtype=np.int64), np.zeros_like(centroids)
        for batch in batches:
            _, x = integers(batch["v"], dims, scale)
            if len(x):
                own, _ = nearest(x, centroids)
                n += np.bincount(own, minlength=len(centroids))
                np.add.at(total, own, x)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held]), pa.array(list(total[held]), pa.list_(pa.int64()))], names=["k", "n", "s"])

    parts = rows.select("v").mapInArrow(added, "k int, n long, s array<long>")
    wide = parts.select("k", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("s").alias("j", "x"))
    found = wide.groupBy("k", "j").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # k x d rows
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found:
        out.setdefault(r["k"], (int(r["n"]), [0] * dims))[1][r["j"]] = int(r["x"])
    return out


def first_centroids(rows: DataFrame, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """Integers of the k kept vectors with the smallest hashes. Each task keeps its own k smallest."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = integers(batch["v"], dims, scale)
            yield pa.RecordBatch.from_arrays([batch["h"].take(pa.array(at)), pa.array(list(x), pa.list_(pa.int64()))], names=["h", "x"])

    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(h.alias("h"), "v").mapInArrow(kept, "h string, x array<long>").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in found], dtype=np.int64).reshape(len(found), dims)


def cluster(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    kind = vectors.schema[vec_id].dataType
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(F.size("v") == dims)
    centroids = first_centroids(rows, k, dims, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = _sums(rows, centroids, scale)
        centroids = np.array([[s // moved[j][0] for s in moved[j][1]] if j in moved else c for j, c in enumerate(centroids.tolist())], dtype=np.int64)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = integers(batch["v"], dims, scale)
            own, far = nearest(x, centroids) if len(x) else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(at)), pa.array(own, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    tables = Tables(vectors.sparkSession)
    out = tables.keep("assigned", rows.mapInArrow(assigned, T.StructType().add("vec_id", kind).add("cluster", T.IntegerType()).add("distance", T.LongType())))
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    fits = lambda n: F.lit(int(n) if n < 2**63 else None).cast("long")
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    every = range(len(centroids))
    return out.select(
        "vec_id", "cluster", "distance",
        (of([fits(sums.get(j, 0)) for j in every]) if every else F.lit(None).cast("long")).alias("cluster_inertia"),
        fits(sum(sums.values())).alias("inertia"),
        (of([F.lit(digest(c)) for c in centroids.tolist()]) if every else F.lit(None).cast("string")).alias("centroid_sha256"),
    )


def op11(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    far = f"list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::bigint"
    parts = [
        f"v as materialized (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) e from embeddings where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: isfinite(x::double))) = {DIMS})",
        f"c0 as materialized (select (row_number() over (order by h) - 1)::int k, e from (select sha256('{SEED}:' || vec_id) h, e from v order by h limit {K}))",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} as materialized (select vec_id, any_value(v.e) e, arg_min(k, [d, k]) k, min(d) d from (select vec_id, v.e, k, {far} d from v cross join c{r} c) v group by vec_id)")
        if r < ROUNDS:
            parts.append(f"m{r} as (select k, list(f order by j) e from (select k, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) f from (select k, unnest(e) x, unnest(range({DIMS})) j from a{r}) group by k, j) group by k)")
            parts.append(f"c{r + 1} as materialized (select c.k, coalesce(m.e, c.e) e from c{r} c left join m{r} m using (k))")
    return f"""with {', '.join(parts)}
select vec_id, k::int as cluster, d as distance, (sum(d) over (partition by k))::bigint cluster_inertia, (sum(d) over ())::bigint inertia, sha256(array_to_string(c.e, ',')) centroid_sha256 from a{ROUNDS} join c{ROUNDS} c using (k)"""


OP11_SQL = _sql()
