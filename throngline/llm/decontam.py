"""Operator 1: benchmark decontamination.

A window is 13 consecutive words of a benchmark item (an item of 1 to 12 words is one window). The windows'
hashes make a broadcast set; every document is scanned with a rolling hash over word ids, each hash hit is
verified word by word, and the words inside verified windows are marked. Result, in one struct column:

``n_words``, ``n_hit`` (long), ``items`` (sorted array of item ids as strings), ``spans`` (array of
``start``/``end`` word offsets, end exclusive, maximal), ``contaminated`` (n_hit > 0 and 20 * n_hit >= n_words).

Defined cases: null and empty texts have no words and are never contaminated; repeated benchmark rows count
once; the windows of an item with a null id mark words but name no item; an empty benchmark marks nothing.

The set is broadcast only if the benchmark's text is at most ``broadcast_bytes``: it holds arrays of about 80 bytes a
word of text and a dictionary of the distinct words (about 150 bytes each), at most some 300 MB for 8 MB of text. Beyond
that the windows are joined by a shuffle on their hash (`scan_by_join`), with the same result.
A column called ``out`` is replaced; all other columns pass through, whatever their names.
"""

from __future__ import annotations

import functools
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import ALNUM_WORD, Tables, alnum_words, chunks, free, sql_lower, table, utf8

WINDOW = 13
BROADCAST_BYTES = 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, contaminated boolean"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN)), ("contaminated", pa.bool_())])


class WindowSet:
    """Verified lookup of benchmark windows as arrays; built once, then read by every task.

    For each length: a gate of hash prefixes, the sorted hashes, the word ids of each window, and the items of each (two arrays).
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        runs: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, text) in enumerate(items):
            words = alnum_words((text or "").encode())
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), dtype=np.uint32, count=len(words))
            if len(ids):
                runs.setdefault(min(window, len(ids)), []).append((ids, k))
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for length in sorted(runs):
            views = [np.lib.stride_tricks.sliding_window_view(ids, length) for ids, _ in runs[length]]
            owner = np.repeat(np.array([k for _, k in runs[length]], dtype=np.int32), [len(v) for v in views])
            windows, number = np.unique(np.concatenate(views), axis=0, return_inverse=True)
            held = np.unique(np.stack([number.ravel().astype(np.int32), owner], axis=1), axis=0)
            hashes = rolling(windows.astype(np.uint64).ravel(), length)[::length]
            order = np.argsort(hashes, kind="stable")
            gate = np.zeros(1 << 20, dtype=bool)
            gate[(hashes >> np.uint64(44)).astype(np.int64)] = True
            first = np.searchsorted(held[:, 0], np.arange(len(windows) + 1))
            self.by_length[length] = gate, hashes[order], order, windows, first, held[:, 1]

    def marks(self, ids: np.ndarray) -> list[tuple[int, int, set[str | None]]]:
        """(start, length, items) of every window that occurs in ids."""
        out = []
        for length, (gate, hashes, order, windows, first, owner) in self.by_length.items():
            if len(ids) < length:
                continue
            own = rolling(ids, length)
            at = np.flatnonzero(gate[(own >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(hashes, own[at]), np.searchsorted(hashes, own[at], side="right")
            for i, a, b in zip(*(x[low < high].tolist() for x in (at, low, high)), strict=True):
                for k in order[a:b].tolist():
                    if (windows[k] == ids[i : i + length]).all():
                        out.append((i, length, {self.names[j] for j in owner[first[k] : first[k + 1]].tolist()}))
        return out


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all windows of `length` ids."""
    n = len(ids) - length + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(length):
        h *= _MIX
        h += ids[j : j + n]
    return h ^ (h >> np.uint64(29)) * _MIX


def _scan(texts: list[bytes | None], windows: WindowSet) -> list[dict]:
    out: list[dict] = []
    known = windows.vocabulary.get
    for a, b in chunks(texts):
        words = [alnum_words(t or b"") for t in texts[a:b]]
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        ids = np.zeros(starts[-1], dtype=np.uint64)  # id 0, which no window has, stands between documents
        for s, w in zip(starts.tolist(), words, strict=False):
            ids[s : s + len(w)] = np.fromiter(map(known, w, repeat(0)), dtype=np.uint64, count=len(w))
        found: dict[int, list[tuple[int, int, set]]] = {}
        for i, length, items in windows.marks(ids):
            k = int(np.searchsorted(starts, i, side="right")) - 1
            found.setdefault(k, []).append((i - int(starts[k]), length, items))
        for k, w in enumerate(words):
            spans: list[dict] = []
            for s, length, _ in sorted(found.get(k, []), key=lambda x: x[:2]):
                if spans and s <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], s + length)
                else:
                    spans.append({"start": s, "end": s + length})
            hit = sum(x["end"] - x["start"] for x in spans)
            items = sorted({x for _, _, own in found.get(k, []) for x in own if x is not None})
            out.append({"n_words": len(w), "n_hit": hit, "items": items, "spans": spans, "contaminated": hit > 0 and 20 * hit >= len(w)})
    return out


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "decon", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`docs` with the struct column `out`; by a broadcast set if the benchmark's size allows, else by a join."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("words")).where("words is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return scan_by_join(docs, items, text, out, window)
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in items.collect()], window))

    @F.arrow_udf(RESULT)
    def mark(column: pa.Array) -> pa.Array:
        return pa.array(_scan(utf8(column), shared.value), type=_ARROW)

    return docs.withColumn(out, mark(F.col(text)))


def _words(text: str) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower()), F.lit(ALNUM_WORD), 0)


def scan_by_join(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "decon", window: int = WINDOW) -> DataFrame:
    """The same by a shuffle join on the windows' hashes; `items` has columns item, words.

    Documents are numbered in a table of their own, so that a recomputed partition keeps its numbers. Only (number, place,
    hash) of their windows are shuffled to the benchmark's distinct windows (one row each; AQE splits a window that very many
    documents share), only hits travel back, and are verified there word by word.
    """
    row, ws, found = (free(docs, n) for n in ("row", "ws", "found"))
    cut = lambda words, size: f"transform(sequence(1, greatest(size(`{words}`) - {size} + 1, 1)), i -> array_join(slice(`{words}`, i, {size}), ' '))"
    own = items.withColumn("ws", _words("words")).where("size(ws) > 0").withColumn("n", F.least(F.size("ws"), F.lit(window)))
    own = own.select("item", "n", F.explode(F.expr(cut("ws", "n"))).alias("w")).groupBy("n", "w").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("h", F.xxhash64("w"))
    lengths = [r[0] for r in own.select("n").distinct().collect()]  # at most `window` numbers
    keyed = Tables(docs.sparkSession).keep("docs", docs.withColumn(row, F.monotonically_increasing_id()))
    each = keyed.select(F.col(row).alias("row"), _words(text).alias("ws"))
    hashed = [each.where(F.size("ws") >= n).select("row", F.lit(n).alias("n"), F.posexplode(F.expr(f"transform({cut('ws', n)}, w -> xxhash64(w))")).alias("at", "h")) for n in lengths]
    pieces = functools.reduce(DataFrame.unionByName, hashed) if hashed else each.select("row", F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("h")).limit(0)
    hits = pieces.join(own, ["n", "h"]).groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("at", "n", "w", "items"))).alias(found))
    true = f"filter(coalesce(`{found}`, array()), x -> array_join(slice(`{ws}`, x.at + 1, x.n), ' ') = x.w)"
    merged = f"""aggregate(`{found}`, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) ->
        case when size(acc) > 0 and x.at <= element_at(acc, -1).end
             then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).end, bigint(x.at + x.n)) as end)))
             else concat(acc, array(struct(bigint(x.at) as start, bigint(x.at + x.n) as end))) end)"""
    res = keyed.join(hits, row, "left").withColumn(ws, _words(text)).withColumn(found, F.expr(true))
    made = F.struct(
        F.size(ws).cast("long").alias("n_words"), F.expr(f"aggregate({merged}, 0L, (a, x) -> a + x.end - x.start)").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda x: x["items"])))).alias("items"), F.expr(merged).alias("spans"),
    )
    res = res.withColumn(found, made)
    judged = F.struct(f"{found}.*", F.expr(f"{found}.n_hit > 0 and 20 * {found}.n_hit >= {found}.n_words").alias("contaminated"))
    return res.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], judged.alias(out))


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the contaminated ones. Null and empty texts stay; repeated rows are judged alike."""
    name = free(docs, "decon")
    return scan(docs, benchmark, text, out=name).where(~F.col(f"{name}.contaminated")).drop(name)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """`docs` whose text has lost the words of every span (and the separators inside it); other text stays as it was."""
    name = free(docs, "decon")

    @F.arrow_udf("string")
    def cut(column: pa.Array, spans: pa.Array) -> pa.Array:
        import re

        out = []
        for t, own in zip(column.to_pylist(), spans.to_pylist(), strict=True):
            if own:
                places = [m.span() for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", t)]
                for s in reversed(own):
                    t = t[: places[s["start"]][0]] + t[places[s["end"] - 1][1] :]
            out.append(t)
        return pa.array(out, pa.string())

    return scan(docs, benchmark, text, out=name).withColumn(text, cut(F.col(text), F.col(f"{name}.spans"))).drop(name)


def op1(spark, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "decon.n_words", "decon.n_hit", F.size("decon.items").cast("long").alias("n_items"), F.sha2(F.array_join("decon.items", ","), 256).alias("items_sha256"), "decon.contaminated")


_LIST = rf"regexp_extract_all({sql_lower('coalesce(text, chr(0))')}, '{ALNUM_WORD}')"
OP1_SQL = f"""
with items as (select distinct cast(item_id as varchar) item, {_LIST} ws from benchmark),
wins as (select item, least(len(ws), {WINDOW}) n, unnest(list_transform(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1), lambda i: array_to_string(ws[i:i + {WINDOW - 1}], ' '))) w from items where len(ws) > 0),
dist as (select n, w, list(distinct item) its from wins group by n, w),
d as (select doc_id, {_LIST} ws from documents),
occ as (select doc_id, l.n, ws, unnest(range(1, len(ws) - l.n + 2)) i from d, (select distinct n from dist) l where len(ws) >= l.n),
hit as (select doc_id, occ.i, occ.n, its from occ join dist on occ.n = dist.n and array_to_string(occ.ws[occ.i:occ.i + occ.n - 1], ' ') = dist.w),
nhit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by doc_id),
nit as (select doc_id, count(distinct it) n_items, string_agg(distinct it, ',' order by it) its from (select doc_id, unnest(its) it from hit) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(its, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from d left join nhit on d.doc_id = nhit.doc_id left join nit on d.doc_id = nit.doc_id"""
