"""Operator 3: quality rules, with DataFrame functions only.

Base figures of every whole text (words are runs of anything but space and \\t..\\r): ``n_words``,
``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed``.

The method: a text's tokens (lower-cased runs of letters and digits, and every other visible character by
itself) and their pairs fall into BUCKETS hashed buckets each. Two multinomials are counted over the buckets,
one on trusted documents, one on all documents. A document's score is the mean log-likelihood ratio of its
buckets, trusted over raw; it is kept if the base rules pass and the score reaches ``threshold``. Weights are
fixed-point integers, so that a score never depends on the order of a sum.

The counts cover all documents. Trusted ids are broadcast while there are at most ``broadcast_ids`` of them
and joined by a shuffle beyond that. The weights are 2 * BUCKETS numbers, whatever the corpus.

Defined cases: a null text counts as empty (no words, base_failed); with no trusted document at all every weight
is 0 and every score 0, so the base rules alone decide; repeated rows count as often as they stand; two windows
are the same if their 64-bit hashes are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .text import table

BUCKETS = 1 << 13
#: Nats a token below which a document is rejected.
THRESHOLD = -0.35
#: Trusted ids that are broadcast (about 90 MB); more are joined by a shuffle.
BROADCAST_IDS = 500_000
_SCALE = 10_000
_GAPS, _SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` and the base figures in the struct column `base`."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_words", F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: _without(x, _GAPS) != ""))
    d = d.withColumn("_h", F.expr("transform(_words, w -> xxhash64(w))"))
    d = d.withColumn("_win", F.expr("case when size(_h) >= 5 then transform(sequence(0, size(_h) - 5), i -> xxhash64(_h[i], _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4])) else cast(array() as array<bigint>) end"))
    # only texts in which a window repeats sort their windows, to find the places of all repeats
    d = d.withColumn("_ord", F.expr("case when size(array_distinct(_win)) < size(_win) then array_sort(transform(_win, (h, i) -> named_struct('h', h, 'i', i))) end"))
    d = d.withColumn("_at", F.expr("""case when _ord is not null then array_sort(transform(
        filter(_ord, (x, k) -> coalesce(x.h = get(_ord, k - 1).h, false) or coalesce(x.h = get(_ord, k + 1).h, false)), x -> x.i)) end"""))
    covered = "coalesce(aggregate(_at, named_struct('n', 0, 'end', 0), (a, i) -> named_struct('n', a.n + i + 5 - greatest(i, a.end), 'end', i + 5), a -> a.n), 0)"
    d = d.withColumn("_rep", F.expr(covered))
    figures = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(_without(t, _GAPS)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, _SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_rep").cast("long").alias("n_repeat_words"),
        F.expr("size(_words) < 10 or 100 * _rep > 20 * size(_words)").alias("base_failed"),
    )
    return d.withColumn("base", figures).drop("_words", "_lines", "_h", "_win", "_ord", "_at", "_rep")


def _hashes(text: str) -> Column:
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), 0)
    return F.transform(tokens, lambda w: F.xxhash64(w))


_SINGLE = f"pmod({{0}}, {BUCKETS})"
_PAIR = f"{BUCKETS} + pmod(xxhash64({{0}}, {{1}}), {BUCKETS})"


def weights(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_ids: int = BROADCAST_IDS) -> list[int]:
    """Fixed-point log-likelihood ratios of all buckets; `trusted` has the column doc_id."""
    ids = trusted.select(F.col(doc_id).alias("_id")).where("_id is not null").distinct().withColumn("_good", F.lit(1))
    few = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    own = docs.select(F.col(doc_id).alias("_id"), _hashes(text).alias("h")).join(F.broadcast(ids) if few else ids, "_id", "left")
    single, pair = _SINGLE.format("x"), _PAIR.format("h[i]", "h[i + 1]")
    cells = own.select(F.coalesce("_good", F.lit(0)).alias("good"), F.explode(F.expr(f"concat(transform(h, x -> cast({single} as int)), case when size(h) > 1 then transform(sequence(0, size(h) - 2), i -> cast({pair} as int)) else cast(array() as array<int>) end)")).alias("b"))
    counts = cells.groupBy("b").agg(F.count("*").alias("raw"), F.sum("good").alias("good")).collect()  # 2 * BUCKETS rows at most
    out = [0] * (2 * BUCKETS)
    for first in (0, BUCKETS):
        rows = [r for r in counts if first <= r["b"] < first + BUCKETS]
        good, raw = sum(r["good"] for r in rows) + BUCKETS, sum(r["raw"] for r in rows) + BUCKETS
        if good > BUCKETS:
            out[first : first + BUCKETS] = [round(_SCALE * (math.log(1 / good) - math.log(1 / raw)))] * BUCKETS
            for r in rows:
                out[r["b"]] = round(_SCALE * (math.log((r["good"] + 1) / good) - math.log((r["raw"] + 1) / raw)))
    return out


def scored(docs: DataFrame, ratios: list[int], text: str = "text") -> DataFrame:
    """`docs` and the column `llr`: mean log-likelihood ratio of a text's buckets, 0.0 if it has none."""
    d = docs.withColumn("_h", _hashes(text)).withColumn("_w", F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>"))
    single, pair = _SINGLE.format("x"), _PAIR.format("a.p", "x")
    total = f"""aggregate(_h, named_struct('s', 0L, 'p', cast(null as bigint)),
        (a, x) -> named_struct('s', a.s + _w[cast({single} as int)] + case when a.p is null then 0 else _w[cast({pair} as int)] end, 'p', x), a -> a.s)"""
    return d.withColumn("llr", F.expr(f"coalesce({total} / (greatest(2 * size(_h) - 1, 1) * {_SCALE}D), 0D)")).drop("_h", "_w")


def judge(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, out: str = "quality") -> DataFrame:
    """`docs` with the struct column `out`: the base figures, `llr` and `kept`."""
    own = docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns})
    ratios = weights(own, trusted.select(F.col(doc_id).alias(f"_in_{doc_id}")), f"_in_{text}", f"_in_{doc_id}")
    d = base(scored(own, ratios, f"_in_{text}"), f"_in_{text}")
    d = d.withColumn("_out", F.struct("base.*", "llr", (~F.col("base.base_failed") & (F.col("llr") >= threshold)).alias("kept")))
    # a generator of one row each: a later filter on the result isn't moved below it, which would compute all figures twice
    return d.select(*[F.col(f"`_in_{c}`").alias(c) for c in docs.columns if c != out], F.explode(F.array("_out")).alias(out))


def op3(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    q = judge(docs, labels.where("quality = 1"))
    return q.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")])
