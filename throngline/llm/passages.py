"""Operator 6: passages repeated across documents, by collinear chaining of shared k-mer seeds.

Texts are sequences of lower-cased words. Seeds are the K-word shingles whose hash is in the lowest 1 / THIN; where a window
of ``min_words`` words has none with another one SPAN words or more after it, its least shingle is one too, and marked. Seeds that
two documents hold are found from packed hashes. As a passage has seeds far apart, keys are made of a seed and the first or the last
one that stands SPAN words or more after it, but within ``min_words``; marked seeds are keys alone. So exact passages
always share a key, and phrases of under SPAN words share none.

Each key's first holder is its home. Documents meet the homes of their keys in the first round; then a
key goes on without its home and without the places aligned with it. In the second round the up to FEW holders that are left all meet, and each holder that is left
meets every holder of its key, in tiles, by the words around the key: pairs are aligned if a window of ``min_words`` words there can have enough equal ones.
Holders that are alike along the diagonal are aligned with the first one they are like. So no holder is left out, and a short text
that many documents share, with nothing else in common, costs comparisons of contexts alone. Pairs of documents are aligned once. All their equal shingles are
matches, chained: a Fenwick tree over the other's positions gives each match the best chain before it under a gap cost of GAP a word,
chains are read off from the best end backwards. Each chain of two or more matches, cut at gaps of over CUT words, is aligned: words between them are compared
(along the diagonal, or by longest common subsequence where the two gaps differ), both ends are extended while the words agree.
Alignments of at least ``min_words`` words with at least ``min_similarity`` equal ones are passages, and so are equal runs of
that length that no alignment covers. So all holders of an exact window are connected by rows that cover it.

Equal word sequences form one class first; only its smallest id is searched, the others are linked to it as whole
copies. One row per passage: ``doc_id``, ``other_id`` (smaller), ``start``, ``end``, ``other_start``, ``other_end`` (words, end exclusive),
``n_match``, ``similarity``, ``copy`` (true: the same words throughout). Documents aligned with the same home need no row of their own.

Defined cases: null and empty texts and texts under ``min_words`` words hold no passage; texts without words are nobody's copy; rows
with a null id are left out; repeated rows with the same text count once; of rows that repeat an id with another text the
least text is aligned.
"""

from __future__ import annotations

import array
import contextlib
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .text import Tables, alnum_folded, table

K = 5
#: Characters of text a bucket of seeds; share of shingles that are seeds; words between the two seeds of a key; holders that meet as whole texts; holders of a key, and rows of several keys, in one task.
BUCKET, THIN, SPAN, FEW, TILE, TILES = 2_000_000, 2, 18, 12, 1000, 10_000
#: Longest period of a stretch that repeats itself.
PERIOD = 11
#: Pairs of texts sent to a Python worker at once.
PAIRS = 256
#: Text whose seeds are in memory at once.
PACK = 4 << 20
#: Beyond so many matches of a pair only the ends of their runs are looked up; numbers of a list beyond which it is packed.
MATCHES, LISTS = 1 << 20, 1 << 18
MIN_WORDS, MIN_SIMILARITY = 50, 0.8
GAP, DROP = 0.08, 8
#: Words between two matches of a chain at which its alignment is cut in two; words of a run whose every K-th match counts; words of a gap at which an alignment too unlike is cut.
CUT, STEADY, SPLIT = 50, 30, 5
#: Words that stand for what is folded out of a stretch: too many for a chain to go on beyond them.
FOLD = CUT + 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: A code for each byte of a word, the same for A-Z and a-z; bytes that words are made of.
_FOLDED = np.frombuffer(alnum_folded(), np.uint8)
_CODE, _INSIDE = np.random.default_rng(6).integers(1, 2**63, 256, dtype=np.uint64)[_FOLDED], _FOLDED != 32
#: Bytes of text hashed at once.
STRETCH = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2**64."""
    one = 0xD6E8FEB86659FD93
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, v, np.uint64)]) for v in (one, pow(one, -1, 2**64)))


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the lower-cased words of all texts of a string column, and where each text's begin (with the end of the last)."""
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[0] == ends[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _INSIDE[data]
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    before[ends[:-1][ends[:-1] < len(data)]] = False
    after[ends[1:][ends[1:] > 0] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    ids, i = np.empty(len(first), np.uint64), 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(first, first[i] + STRETCH)))
        start, stop = first[i], last[j - 1]
        power, inverse = _powers(1 << int(max(2 * STRETCH, stop - start)).bit_length())
        sums = np.zeros(stop - start + 1, np.uint64)
        np.cumsum(_CODE[data[start:stop]] * power[: stop - start], out=sums[1:])
        a, b = first[i:j] - start, last[i:j] - start
        ids[i:j] = mixed((sums[b] - sums[a]) * inverse[a])
        i = j
    return ids, np.searchsorted(first, ends)


def parts(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes of text, one row at least."""
    size = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).cumsum(dtype=np.int64)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + (most or PACK), side="right")))
        yield a, b
        a = b


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the bytes of `values` between `ends`."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def shingles(ids: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(ids) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = (h ^ ids[j : j + n]) * _A
        h ^= h >> np.uint64(31)
    h *= _B
    h ^= h >> np.uint64(29)
    return h


def _repeats(ids: np.ndarray, begin: np.ndarray, p: int) -> np.ndarray:
    """Whether each word, of all but the last p, stands again p words on in its text."""
    same = ids[p:] == ids[:-p]
    for d in range(1, p + 1):
        at = begin[1:-1] - d
        same[at[(at >= 0) & (at < len(same))]] = False
    return same


def _lasting(same: np.ndarray, n: int) -> np.ndarray:
    """Where n of them follow one another."""
    have = 1
    while have < n and len(same):
        step = min(have, n - have)
        same, have = same[:-step] & same[step:], have + step
    return same


def quiet(ids: np.ndarray, begin: np.ndarray, size: int = SPAN + K, most: int = PERIOD) -> np.ndarray:
    """Whether the `size` words from each on repeat with a period of at most `most`."""
    out = np.zeros(len(ids), dtype=bool)
    for p in range(1, min(most, len(ids) - 1) + 1):
        at = _lasting(_repeats(ids, begin, p), size - p)
        out[: len(at)] |= at
    return out


def stretches(ids: np.ndarray, begin: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the longest stretches of min_words words and more that repeat with a period of at most PERIOD, the least one."""
    out: list[tuple[int, int, int]] = []
    for p in range(1, min(PERIOD, min_words // 2, len(ids) - 1) + 1):
        same = _repeats(ids, begin, p)
        if _lasting(same, min_words - p).any():
            steps = np.diff(np.r_[0, same.astype(np.int8), 0])
            starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1) + p
            wide = np.flatnonzero(ends - starts >= min_words)
            known = list(out)
            out += [(i, j, p) for i, j in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True) if not any(a <= i and j <= b for a, b, _ in known)]
    return sorted(out)


def folded(ids: np.ndarray, begin: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Texts without the windows of min_words words that lie inside a stretch that repeats itself: (words, begins, words that stand for what is left out, cuts).

    Of a stretch its first and its last min_words - 1 words stay, FOLD words that no other text has between them. So every other window
    stays whole. A text's cuts: (where such words begin, place in the whole text of the word after them).
    """
    keep, out, cuts, pos, grown = min_words - 1, [], [np.zeros((0, 2), np.int64)] * (len(begin) - 1), 0, 0
    found = stretches(ids, begin, min_words)
    if not found:
        return ids, begin, np.zeros(len(ids), dtype=bool), cuts
    added, own = np.zeros(len(begin), np.int64), {}
    for s, e, _ in found:
        k = int(np.searchsorted(begin, s, side="right")) - 1
        if k not in own:
            words = ids[begin[k] : begin[k + 1]]
            own[k] = (mixed(words + np.arange(len(words), dtype=np.uint64) * _A).sum(dtype=np.uint64), grown, [])
        print_, before, of = own[k]
        at = s + keep + grown  # in all folded texts
        out += [ids[pos : s + keep], mixed((print_ ^ _B) + (np.uint64(len(of) * FOLD) + np.arange(FOLD, dtype=np.uint64)) * _A)]
        of.append((at - begin[k] - before, e - keep - begin[k], at))
        pos = e - keep
        step = keep + FOLD + keep - (e - s)
        grown += step
        added[k + 1 :] += step
    out.append(ids[pos:])
    words = np.concatenate(out)
    gap = np.zeros(len(words), dtype=bool)
    for k, (_, _, of) in own.items():
        cuts[k] = np.array([c[:2] for c in of], np.int64)
        for _, _, at in of:
            gap[at : at + FOLD] = True
    return words, begin + added, gap, cuts


def inner(cuts: np.ndarray, size: int, min_words: int) -> np.ndarray:
    """Which shingles of a folded text lie inside a stretch that repeats itself."""
    out = np.zeros(max(size, 0), dtype=bool)
    for at in cuts[:, 0].tolist():
        out[max(0, at - min_words + 1) : at - K + 1] = True
        out[at + FOLD : at + FOLD + min_words - K] = True
    return out


def whole(start: int, end: int, cuts: np.ndarray) -> tuple[int, int]:
    """Where a passage of a folded text lies in the whole text."""
    if not len(cuts):
        return start, end
    shift = np.append(0, cuts[:, 1] - cuts[:, 0] - FOLD)
    return start + int(shift[np.searchsorted(cuts[:, 0], start, side="right")]), end + int(shift[np.searchsorted(cuts[:, 0], end, side="left")])


def unfolded(row: tuple[int, int, int, int, int], a: np.ndarray, b: np.ndarray, cuts: np.ndarray, other: np.ndarray, min_words: int, min_similarity: float) -> tuple[int, int, int, int, int] | None:
    """The passage without the words at its ends that stand for folded ones, as many more at its other end where it is too short then; None if it isn't one so."""
    if not len(cuts) and not len(other):
        return row
    s, e, o, p, n = row
    ahead = lambda v, c: max([0, *(at + FOLD - v for at in c[:, 0].tolist() if at <= v < at + FOLD)])
    behind = lambda v, c: max([0, *(v - at for at in c[:, 0].tolist() if at < v <= at + FOLD)])
    left, right = max(ahead(s, cuts), ahead(o, other)), max(behind(e, cuts), behind(p, other))
    if not left and not right:
        return row
    s, o, e, p = s + left, o + left, e - right, p - right
    need = min_words - min(e - s, p - o)
    if need > 0 and not right:
        n, e, p = n + int((a[e : e + need] == b[p : p + need]).sum()) if max(e + need - len(a), p + need - len(b)) <= 0 else -1, e + need, p + need
    elif need > 0 and not left:
        n, s, o = n + int((a[s - need : s] == b[o - need : o]).sum()) if min(s, o) >= need else -1, s - need, o - need
    if behind(e, cuts) or behind(p, other) or ahead(s, cuts) or ahead(o, other):
        return None
    return (s, e, o, p, n) if min(e - s, p - o) >= min_words and n >= min_similarity * max(e - s, p - o) else None


_STRETCH = [("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("period", pa.int64()), ("phase", pa.int64())]


def _named(ids: np.ndarray, begin: np.ndarray, min_words: int) -> list[list[dict]]:
    """The stretches of each text: the hash of what repeats from its least rotation on, which begins `phase` words after the stretch."""
    out: list[list[dict]] = [[] for _ in begin[1:]]
    for s, e, p in stretches(ids, begin, min_words):
        k, root = int(np.searchsorted(begin, s, side="right")) - 1, ids[s : s + p].tolist()
        phase = min(range(p), key=lambda r: root[r:] + root[:r])
        key = int(shingles(np.array(root[phase:] + root[:phase], np.uint64), p).view(np.int64)[0])
        out[k].append(dict(zip((n for n, _ in _STRETCH), (key, s - int(begin[k]), e - int(begin[k]), p, phase), strict=True)))
    return out


def periodic(held: DataFrame, min_words: int, min_similarity: float) -> DataFrame:
    """Passages that repeat themselves, of stretches of min_similarity * min_words words and more of texts of n words: (node, other, start, end, other_start, other_end, n_match), a row for each of the stretches `held` of a node with another one's first.

    Stretches of the same words (key) that are long enough for every rotation, wherever they are cut, are linked to the first such one, and so are shorter ones; without any,
    shorter ones to the first with the same window. The whole stretches where they are similar enough, else as many words of both from the same rotation on.
    """
    size, least = F.expr("end - start"), F.lit(int(np.ceil(min_similarity * min_words)))
    first = F.min(F.struct("node", "start", "end", "phase", "n")).alias("h")
    ample = held.where(size >= min_words + 2 * F.col("period") - 2)
    heads = ample.groupBy("key").agg(first)
    near = held.join(heads, "key").select("*", F.lit(0).cast("long").alias("a"), F.expr("pmod(h.phase - phase, period)").alias("b"))
    # a short stretch meets a place of the ample one with as many words before it as it needs before itself
    short = F.greatest(F.lit(0), min_words - size)
    lead = short - F.least(short, F.expr("n - end"))
    near = near.withColumn("b", F.col("b") + F.col("period") * F.ceil(F.greatest(F.lit(0), lead - F.col("h.start") - F.col("b")) / F.col("period")))
    # without an ample one: those with the same window of min_words words, and again (of the others, too) of `least` words
    some = held.join(heads, "key", "left_anti")
    far = []
    for n in (F.lit(min_words), least):
        by = some.where(size >= n).select("*", n.alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("period") - 1, size - n))).alias("r")).withColumn("r", F.expr("pmod(phase - r, period)"))
        by = by.join(by.groupBy("key", "r").agg(first), ["key", "r"]).withColumns({"a": F.expr("pmod(phase - r, period)"), "b": F.expr("pmod(h.phase - r, period)")}).withColumn("r", F.least("a", "b"))
        far.append(by.withColumns({"a": F.col("a") - F.col("r"), "b": F.col("b") - F.col("r")}).drop("r", "w"))
    met = near.unionByName(far[0]).unionByName(far[1]).distinct().where("node <> h.node").withColumn("m", F.expr("least(end - start - a, h.end - h.start - b)"))
    met = met.withColumn("all", (F.expr("least(end - start, h.end - h.start)") >= min_words) & (F.col("m") >= min_similarity * F.expr("greatest(end - start, h.end - h.start)")))
    # of fewer than min_words words: with those around them
    met = met.withColumn("need", F.greatest(F.lit(0), min_words - F.col("m")))
    met = met.withColumn("right", F.expr("if(all, 0, least(need, n - (start + a + m), h.n - (h.start + b + m)))")).withColumn("left", F.expr("if(all, 0, need - right)"))
    met = met.where("left <= least(start + a, h.start + b)").withColumns({"a": F.expr("a - left"), "b": F.expr("b - left"), "size": F.expr("m + left + right")})
    own = F.struct(F.col("node"), F.expr("if(all, start, start + a)").alias("start"), F.expr("if(all, end, start + a + size)").alias("end"))
    head = F.struct(F.col("h.node").alias("node"), F.expr("if(all, h.start, h.start + b)").alias("start"), F.expr("if(all, h.end, h.start + b + size)").alias("end"))
    met = met.select(F.greatest(own, head).alias("x"), F.least(own, head).alias("y"), F.col("m").alias("n_match"))
    return met.select("x.node", F.col("y.node").alias("other"), "x.start", "x.end", F.col("y.start").alias("other_start"), F.col("y.end").alias("other_end"), "n_match")


def fingerprint(stretch_words: int):
    stretch = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n, _ in _STRETCH]))

    @F.arrow_udf(T.StructType().add("key", T.BinaryType()).add("n", T.LongType()).add("s", stretch))
    def of(column: pa.Array) -> pa.Array:
        """Hash of the word sequence, its length and its stretches of stretch_words words and more."""
        key, n, held = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)], []
        for a, b in parts(column):
            ids, begin = word_ids(column.slice(a, b - a))
            size = np.diff(begin)
            place = (np.arange(len(ids)) - np.repeat(begin[:-1], size)).astype(np.uint64)
            own, full = np.zeros((b - a, 2), np.uint64), np.flatnonzero(size)
            if len(full):
                for k, step in enumerate((_A, _B)):
                    own[full, k] = np.add.reduceat(mixed((ids ^ (step >> np.uint64(1))) + place * step), begin[full])
            key.append(own)
            n.append(size)
            held += _named(ids, begin, stretch_words)
        key, n = np.concatenate(key), np.concatenate(n)
        return pa.StructArray.from_arrays([packed(key, 2 * np.arange(len(n) + 1)), pa.array(n), pa.array(held, pa.list_(pa.struct(_STRETCH)))], names=["key", "n", "s"])

    return of


def hashed(min_words: int):
    @F.arrow_udf(T.StructType().add("w", T.BinaryType()).add("cuts", T.BinaryType()))
    def of(column: pa.Array) -> pa.Array:
        """The hashes of the words of the folded text and its cuts, packed."""
        words, cuts = [pa.array([], pa.binary())], [pa.array([], pa.binary())]
        for a, b in parts(column):
            ids, begin, _, own = folded(*word_ids(column.slice(a, b - a)), min_words)
            words.append(packed(ids, begin))
            cuts.append(pa.array([c.tobytes() for c in own], pa.binary()))
        return pa.StructArray.from_arrays([pa.concat_arrays(words), pa.concat_arrays(cuts)], names=["w", "cuts"])

    return of


def seeds(ids: np.ndarray, begin: np.ndarray, min_words: int, gap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place in it, 1 if marked and 2 if its SPAN + K words repeat themselves, so that it begins no key) of the seeds of texts that follow one another; none with words of `gap`."""
    h, size = shingles(ids), min_words - K + 1
    still = quiet(ids, begin)
    gaps = np.append(0, np.cumsum(np.zeros(len(ids), dtype=bool) if gap is None else gap))
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    room = begin[1:][text] - np.arange(len(ids))  # words from here to the text's end
    taken = (h < np.uint64(2**64 // THIN)) & (room[: len(h)] >= K) & (np.diff(begin)[text[: len(h)]] >= min_words) & (gaps[K:] == gaps[:-K])[: len(h)]
    at = np.flatnonzero(taken)
    # windows of `size` shingles with a seed and the first one SPAN words after it
    a, b = at, np.append(at, len(ids) + size)[np.searchsorted(at, at + SPAN)]
    good = (b - a < np.minimum(size, room[a])) & ~still[a]
    good[good] = h[a[good]] != h[b[good]]
    a, b = a[good], b[good]
    windows = max(0, len(ids) - min_words + 1)
    steps = np.bincount(np.maximum(b - size + 1, begin[text[a]]), minlength=len(h) + 2) - np.bincount(a + 1, minlength=len(h) + 2)
    poor = np.flatnonzero((np.cumsum(steps)[:windows] <= 0) & (room[:windows] >= min_words) & (gaps[min_words:] == gaps[:windows]))
    marked = np.zeros(len(h), dtype=bool)
    # shingles of words that repeat themselves inside the window come last: many texts hold them that share nothing else
    since = np.append(np.zeros(min(SPAN, len(ids)), dtype=bool), still[:-SPAN])
    flat = quiet(ids, begin, K, K - 1)
    place = np.arange(max(size, 0))
    view = np.lib.stride_tricks.sliding_window_view
    for i in range(0, len(poor), 20_000):
        some = poor[i : i + 20_000]
        last = view(still[: len(h)], size)[some] & (place <= min_words - SPAN - K) | view(since[: len(h)], size)[some] & (place >= SPAN) | view(flat[: len(h)], size)[some]
        marked[some + (view(h, size)[some] >> np.uint64(1) | last.astype(np.uint64) << np.uint64(63)).argmin(axis=1)] = True
    at = np.flatnonzero(taken | marked)
    return h[at], text[at], at - begin[text[at]], marked[at] + 2 * still[at]


def bundles(to: np.ndarray, h: np.ndarray, owner: np.ndarray, at: np.ndarray, nodes: pa.Array, homes: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket of `to`: its nodes with the bucket of each (`homes`), hashes, for each the number of its node, places. Owners ascend."""
    order = np.argsort(to.astype(np.uint16) if len(to) and to.max() < 1 << 16 else to, kind="stable")
    to, h, owner, at = to[order], h[order], owner[order].astype(np.int64), at[order]
    new = np.r_[True, to[1:] != to[:-1]][: len(to)]
    ends = np.append(np.flatnonzero(new), len(to))
    held = np.r_[True, new[1:] | (owner[1:] != owner[:-1])][: len(to)]
    number = np.cumsum(held) - 1
    rows = np.append(number[ends[:-1]], held.sum())
    nth = (number - np.repeat(rows[:-1], np.diff(ends))).astype(np.int32)
    of, offsets = owner[held], pa.array(rows, pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(to[ends[:-1]], pa.int32()), pa.ListArray.from_arrays(offsets, nodes.take(pa.array(of))), pa.ListArray.from_arrays(offsets, pa.array(homes[of], pa.int32())), packed(h, ends), packed(nth, ends), packed(at.astype(np.int32), ends)],
        names=["bucket", "nodes", "homes", "hashes", "owners", "ats"],
    )


def unbundled(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(hash, number of the node, place) by hash or in any order, the distinct nodes in their order and their buckets."""
    join = lambda name, kind: np.concatenate([np.frombuffer(v, kind) for v in group[name].to_pylist()])
    nodes = pa.concat_arrays([c.flatten() for c in group["nodes"].chunks])
    homes = np.concatenate([c.flatten().to_numpy() for c in group["homes"].chunks])
    sizes = pa.compute.list_value_length(group["nodes"]).to_numpy()
    counts = pa.compute.binary_length(group["owners"]).to_numpy() // 4
    coded = nodes.dictionary_encode()
    code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    order = pa.compute.array_sort_indices(distinct).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    own = np.empty(len(order), np.int32)
    own[rank[code]] = homes
    owner = rank[code][join("owners", np.int32).astype(np.int64) + np.repeat(np.cumsum(sizes) - sizes, counts)]
    return join("hashes", np.uint64), owner, join("ats", np.int32), distinct.take(pa.array(order)), own


def met(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts equal hashes together, of those that two nodes hold, and the first node of each."""
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.append(starts, len(h)))
    least = np.minimum.reduceat(owner, starts)
    keep = np.repeat(least < np.maximum.reduceat(owner, starts), size)
    return order[keep], np.repeat(least, size)[keep]


def linked_seeds(docs: DataFrame, min_words: int, buckets: int, tables: Tables) -> DataFrame:
    """(key, node, at, home): keys that two nodes hold, and the first node of each.

    Seeds that two nodes hold are found first. A key is each of them with the first and with the last one between SPAN and min_words - K words after it in
    its node; marked ones alone as well. Hashes travel packed, a row per batch and bucket: by seed, by node, by key.
    """
    node_type = docs.schema["node"].dataType
    bundle = T.StructType().add("bucket", T.IntegerType()).add("nodes", T.ArrayType(node_type)).add("homes", T.ArrayType(T.IntegerType())).add("hashes", T.BinaryType()).add("owners", T.BinaryType()).add("ats", T.BinaryType())
    row = T.StructType().add("key", T.LongType()).add("node", node_type).add("at", T.IntegerType()).add("home", node_type)
    bucket = lambda h: (h % np.uint64(buckets)).astype(np.int64)

    def pack(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in parts(texts):
                ids, begin, gap, _ = folded(*word_ids(texts.slice(a, b - a)), min_words)
                h, owner, place, kind = seeds(ids, begin, min_words, gap)
                if len(h):
                    yield bundles(bucket(h), h, owner, 4 * place + kind, batch.column("node").slice(a, b - a), batch.column("home").slice(a, b - a).to_numpy())

    def by_node(group: pa.Table) -> pa.Table:
        h, owner, at, nodes, homes = unbundled(group)
        some = np.sort(met(h, owner)[0])
        some = some[np.argsort(owner[some], kind="stable")]
        return pa.Table.from_batches([bundles(homes[owner[some]], h[some], owner[some], at[some], nodes, homes)])

    def by_key(group: pa.Table) -> pa.Table:
        h, owner, at, nodes, homes = unbundled(group)
        order = np.lexsort((at, owner))
        h, owner, at = h[order], owner[order], at[order]
        place, still, marked = (at >> 2).astype(np.int64), at & 2, at & 1
        line = owner * (int(place.max(initial=0)) + 2 * min_words) + place
        first, last = np.searchsorted(line, line + SPAN), np.searchsorted(line, line + min_words - K, side="right") - 1
        some = np.flatnonzero((first <= last) & (still == 0))
        near, far = h[first[some]], h[last[some]]
        key = lambda other: mixed((h[some] ^ mixed(other)) * _A + _B)
        one, two, alone = some[near != h[some]], (far != h[some]) & (far != near), np.flatnonzero(marked)
        keys = np.concatenate([key(near)[near != h[some]], key(far)[two], h[alone]])
        of = np.concatenate([one, some[two], alone])
        order = np.argsort(of, kind="stable")
        of = of[order]
        return pa.Table.from_batches([bundles(bucket(keys[order]), keys[order], owner[of], place[of], nodes, homes)])

    def meet(group: pa.Table) -> pa.Table:
        h, owner, at, nodes, _ = unbundled(group)
        order, home = met(h, owner)
        return pa.table({"key": h[order].view(np.int64), "node": nodes.take(pa.array(owner[order])), "at": at[order], "home": nodes.take(pa.array(home))})

    texts = docs.select("node", "text", F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int").alias("home"))
    found = texts.mapInArrow(pack, bundle).groupBy("bucket").applyInArrow(by_node, bundle)
    return tables.keep("live0", found.groupBy("bucket").applyInArrow(by_key, bundle).groupBy("bucket").applyInArrow(meet, row))


def chosen(runs: list[tuple[int, int]], size: int) -> list[tuple[int, tuple[int, int]]]:
    """Of runs of windows (first, number) the few that cover all of them: long ones first, at first those that bring half their windows anew, then any that bring one."""
    if len(runs) < 2:
        return list(enumerate(runs))
    seen, out = np.zeros(size, dtype=bool), []
    order = sorted(range(len(runs)), key=lambda i: -runs[i][1])
    for least in (0.5, 0.0):
        left = []
        for i in order:
            s, n = runs[i]
            new = n - int(seen[s : s + n].sum())
            if new > least * n:
                seen[s : s + n] = True
                out.append((i, runs[i]))
            elif new:
                left.append(i)
        order = left
    return out


def _breaks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where matches in order of their diagonals don't follow the one before."""
    out = np.ones(len(x), dtype=bool)
    np.logical_or(x[1:] - x[:-1] != 1, y[1:] - y[:-1] != 1, out=out[1:])
    return out


def _still(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which shingles stand again up to K - 1 words before or after; which of them not before, which not after."""
    again = np.zeros(len(h), dtype=bool)
    before = again.copy()
    for p in range(1, min(K, len(h))):
        same = h[p:] == h[:-p]
        again[:-p] |= same
        before[p:] |= same
    return again | before, ~before, ~again


def _ranged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all ranges [low, high) the number of the range and the places in it."""
    size = high - low
    of = np.repeat(np.arange(len(low), dtype=np.int32), size)
    kind = np.int32 if len(of) < 2**30 else np.int64
    place = np.arange(len(of), dtype=kind)
    place += (low - np.cumsum(size) + size).astype(kind)[of]
    return of, place


def runs_of(ha: np.ndarray, hb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, length) of the runs of equal shingles in order of their diagonals: only where runs begin and end is looked up, so that time and memory grow with the runs, not with the matches in them."""
    code = np.unique(np.concatenate([ha, hb]), return_inverse=True)[1].astype(np.int64)
    ca, cb, n = code[: len(ha)], code[len(ha) :], int(code.max(initial=0)) + 3
    width = len(ha) + 1

    def edges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The places (x, y) of equal codes whose neighbours a and b differ, as diagonal * width + x."""
        order = np.argsort(cb * n + b, kind="stable")
        held, found = (cb * n + b)[order], []
        shift = (len(hb) - order) * width
        for low, high in ((ca * n, ca * n + a), (ca * n + a + 1, ca * n + n)):  # codes of neighbours before and after the own one
            x, at = _ranged(np.searchsorted(held, low), np.searchsorted(held, high))
            found.append(shift[at])
            found[-1] += (np.arange(len(ca)) * (width + 1))[x]
            del x, at
        found = np.concatenate(found)
        found.sort()
        return found

    first = edges(np.r_[n - 2, ca[:-1]], np.r_[n - 1, cb[:-1]])
    last = edges(np.r_[ca[1:], n - 2], np.r_[cb[1:], n - 1])
    last -= first
    last += 1
    x = (first % width).astype(np.int32)
    first //= width
    return x, (x - first + len(hb)).astype(np.int32), last.astype(np.int32)


def _listed(v: np.ndarray) -> list[int] | array.array:
    """A list, or beyond LISTS numbers a packed array."""
    return v.tolist() if len(v) <= LISTS else array.array("i", v.astype(np.int32).tobytes())


def matches(a: np.ndarray, b: np.ndarray, min_words: int = MIN_WORDS, folded_: np.ndarray | None = None) -> tuple[list[int] | array.array, list[int] | array.array, list[tuple[int, int]], int]:
    """Positions (x, y) of equal K-word shingles, without those inside a long equal run of another diagonal, of a diagonal run every K-th (after STEADY words every sixth of these) and the last; starts of the runs of min_words words and more; the number of all diagonal runs.

    Of words that repeat themselves in both texts two diagonals, as they begin and as they end there; of `folded_` shingles of a none but those of such runs.
    """
    ha, hb = shingles(a), shingles(b)
    if not len(ha) or not len(hb):
        return [], [], [], 0
    order = np.argsort(hb, kind="stable")
    low, high = np.searchsorted(hb[order], ha), np.searchsorted(hb[order], ha, side="right")
    if (high - low).sum() > MATCHES:
        x, y, length = runs_of(ha, hb)
    else:
        x, y = _ranged(low, high)
        y = order[y]
        order = np.lexsort((x, x - y))
        x, y = x[order], y[order]
        starts = np.flatnonzero(_breaks(x, y)[: len(x)])
        x, y, length = x[starts], y[starts], np.diff(starts, append=len(x))
    count = len(x)
    if not count:
        return [], [], [], 0
    # words inside a long equal run need no matches on other diagonals: a passage there would lie inside the run's
    own = np.zeros(count, dtype=bool)
    covered = np.zeros(len(ha), dtype=bool)
    wide = np.flatnonzero(length > min_words - K)
    for i, (s, n) in chosen([(int(x[r]), int(length[r]) + K - min_words) for r in wide.tolist()], len(ha)):
        own[wide[i]], covered[s : s + n + min_words - K] = True, True
    (still, opens, closes), (_, other_opens, other_closes) = _still(ha), _still(hb)
    if len(wide) or still.any():
        stirs = np.append(0, np.cumsum(~still))
        idle = stirs[x + length] == stirs[x]
        idle &= ~(opens[x] & other_opens[y] | closes[x + length - 1] & other_closes[y + length - 1]) | (False if folded_ is None else folded_[x])
        some = np.flatnonzero(~own & ~idle)
        if not len(wide):
            x, y, length = x[some], y[some], length[some]
    if len(wide):
        # of the other runs the parts that no long one covers
        steps = np.diff(np.r_[1, covered.astype(np.int8), 1])
        free, ends = np.flatnonzero(steps == -1), np.flatnonzero(steps == 1)
        of, part = _ranged(np.searchsorted(ends, x[some], side="right"), np.searchsorted(free, x[some] + length[some]))
        of = some[of]
        begin = np.maximum(x[of], free[part])
        stop = np.minimum(x[of] + length[of], ends[part])
        of, begin, stop = np.append(np.flatnonzero(own), of), np.append(x[own], begin), np.append((x + length)[own], stop)
        order = np.argsort(of, kind="stable")
        of, begin, stop = of[order], begin[order], stop[order]
        x, y, length = begin, y[of] + begin - x[of], stop - begin
    if not len(x):
        return [], [], [], count
    wide = length > min_words - K
    # places of a run: 0, K, 2 K ... up to STEADY, from there every 6 K-th, the last
    last = length - 1
    near = STEADY // K
    number = np.where(last < STEADY, -(-last // K), near + -(-(last - STEADY) // (6 * K))) + 1
    of, place = _ranged(np.zeros(len(x), np.int64), number)
    place = np.minimum(np.where(place <= near, K * place, STEADY + 6 * K * (place - near)), last[of])
    return _listed(x[of] + place), _listed(y[of] + place), list(zip(x[wide].tolist(), y[wide].tolist(), strict=True)), count


def exact(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int]], k: int, known: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The equal runs through the equal k-word windows at (x, y) that hold a window that no known passage covers, as few as cover all of these."""
    found: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
    ends: dict[int, int] = {}  # of the last run on a diagonal
    for x, y in sorted(runs):
        if ends.get(x - y, -1) >= x + k or not (a[x : x + k] == b[y : y + k]).all():
            continue
        back, n = min(x, y), min(len(a) - x, len(b) - y)
        differ = np.flatnonzero(a[x - back : x][::-1] != b[y - back : y][::-1])
        left = int(differ[0]) if len(differ) else back
        differ = np.flatnonzero(a[x : x + n] != b[y : y + n])
        right = int(differ[0]) if len(differ) else n
        ends[x - y] = x + right
        found[x - left, y - left] = (x - left, x + right, y - left, y + right, left + right)
    covered = np.zeros(len(a) + 1, dtype=bool)
    for q in known:
        covered[q[0] : max(q[0], q[1] - k + 1)] = True
    open_ = [(q, (q[0], q[1] - q[0] - k + 1)) for q in found.values()]
    open_ = [(q, (s, n)) for q, (s, n) in open_ if not covered[s : s + n].all()]
    return sorted(open_[i][0] for i, _ in chosen([r for _, r in open_], len(a) + 1))


def chain(x: list[int] | array.array, y: list[int] | array.array) -> list[list[int] | array.array]:
    """Best local chains of the matches (x[i], y[i]), as lists of match numbers from left to right."""
    if len(x) > 64:
        (rows, columns), n = sorted((len(set(v)), k) for k, v in enumerate((x, y))), len(x)
        if 5 * n > rows[0] * (25 + columns[0] / 200):
            return _chains(x, y, *_scores(np.array((np.asarray(x, np.int32), np.asarray(y, np.int32))), rows[1]))
    order = np.lexsort((y, x)).tolist()
    ranks = (np.unique(y, return_inverse=True)[1] + 1).tolist()
    size = max(ranks, default=0)
    tree, owner = [-1e18] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    waiting: list[int] = []  # matches of the same x enter the tree together, once x grows
    last = None
    for i in order:
        at = x[i]
        if at != last:
            for j in waiting:
                entry, r = score[j] + GAP * (x[j] + y[j]), ranks[j]
                while r <= size:
                    if entry > tree[r]:
                        tree[r], owner[r] = entry, j
                    r += r & -r
            waiting, last = [], at
        best, who, r = -1e18, -1, ranks[i] - 1
        while r:
            if tree[r] > best:
                best, who = tree[r], owner[r]
            r &= r - 1
        gain = best - GAP * (at + y[i])
        if gain > 0:
            score[i], before[i] = K + gain, who
        else:
            score[i] = K
        waiting.append(i)
    return _chains(x, y, np.array(score), before)


def _scores(at: np.ndarray, axis: int) -> tuple[np.ndarray, list[int] | array.array]:
    """Scores and predecessors of `chain`, for matches of which many share a place on this axis: those of a place look up the best before them at once."""
    main, side = at[axis], at[1 - axis]
    held = np.zeros(int(side.max()) + 1, dtype=bool)
    held[side] = True
    rank = (np.cumsum(held, dtype=np.int32) - 1)[side]
    order = np.lexsort((rank, main))
    cuts = np.append(np.flatnonzero(np.r_[True, main[order[1:]] > main[order[:-1]]]), len(main)).tolist()
    entry, owner, place = np.full(int(held.sum()), -1e18), np.full(int(held.sum()), -1), np.arange(held.sum())
    score, before = np.zeros(len(main)), np.full(len(main), -1, np.int32)
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = order[a:b]
        r = rank[own]
        cost = GAP * at[:, own].sum(axis=0)
        top = np.maximum.accumulate(entry)
        gain = np.where(r > 0, top[r - 1], -1e18) - cost
        good = gain > 0
        score[own] = K + np.where(good, gain, 0)
        if good.any():
            which = np.maximum.accumulate(np.where(entry == top, place, 0))
            before[own[good]] = owner[which[r[good] - 1]]
        new = score[own] + cost
        more = new > entry[r]
        entry[r[more]], owner[r[more]] = new[more], own[more]
    return score, _listed(before)


def _chains(x: list[int] | array.array, y: list[int] | array.array, score: np.ndarray, before: list[int] | array.array) -> list[list[int] | array.array]:
    used, out = bytearray(len(x)), []
    order = np.lexsort((y, x, -score))
    for k in range(0, len(order), LISTS):
        for i in order[k : k + LISTS].tolist():
            own: list[int] | array.array = [] if len(x) <= LISTS else array.array("i")
            while i >= 0 and not used[i]:
                used[i] = 1
                own.append(i)
                i = before[i]
            if len(own) > 1:
                out.append(own[::-1])
    return out


def pieces(chains: list[list[int]], x: list[int], y: list[int]) -> list[list[int]]:
    """The chains, cut at gaps of over CUT words."""
    out = []
    for own in chains:
        start = 0
        for k in range(1, len(own)):
            if max(x[own[k]] - x[own[k - 1]], y[own[k]] - y[own[k - 1]]) > CUT + K:
                out.append(own[start:k])
                start = k
        out.append(own[start:])
    return [own for own in out if len(own) > 1]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words of two gaps: along the diagonal if they are of one length, else their longest common subsequence (a bit of a number for each word of b)."""
    if len(a) == len(b):
        return int((a == b).sum())
    if not len(a) or not len(b):
        return 0
    places: dict[int, int] = {}
    for j, v in enumerate(b.tolist()):
        places[v] = places.get(v, 0) | 1 << j
    full = free = (1 << len(b)) - 1
    for v in a.tolist():
        if own := places.get(v):
            met = free & own
            free = (free + met | free - met) & full
    return len(b) - free.bit_count()


def _reach(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(length, equal words) of the best extension along the diagonal; it ends DROP below the best."""
    n = min(len(a), len(b))
    done, total, best, out = 0, 0, 0, (0, 0)
    equal = 0
    while done < n:
        same = a[done : min(n, done + 64)] == b[done : min(n, done + 64)]
        s = total + np.cumsum(np.where(same, 1, -3))
        low = np.flatnonzero(s < np.maximum.accumulate(np.maximum(s, best)) - DROP)
        end = int(low[0]) if len(low) else len(s)
        if end:
            k = int(np.argmax(s[:end]))
            if s[k] > best:
                best, out = int(s[k]), (done + k + 1, equal + int(same[: k + 1].sum()))
        if len(low):
            break
        total, equal, done = int(s[-1]), equal + int(same.sum()), done + len(s)
    return out


def hopeful(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int], owns: list[list[int]], min_words: int, need: int) -> list[list[int]]:
    """The chains that can have `need` equal words: all between their ends, and those within min_words beyond them on their diagonals."""
    if len(owns) < 4:
        return owns
    s, o, e, p = (np.array(v) for v in zip(*((x[own[0]], y[own[0]], x[own[-1]] + K, y[own[-1]] + K) for own in owns)))
    equal = np.minimum(e - s, p - o)
    some, step = np.flatnonzero(equal < need), np.arange(min_words)
    for i in range(0, len(some), 4096):
        t = some[i : i + 4096]
        for u, v, room in ((s[t, None] - 1 - step, o[t, None] - 1 - step, np.minimum(s[t], o[t])), (e[t, None] + step, p[t, None] + step, np.minimum(len(a) - e[t], len(b) - p[t]))):
            equal[t] += ((a[np.clip(u, 0, len(a) - 1)] == b[np.clip(v, 0, len(b) - 1)]) & (step < room[:, None])).sum(axis=1)
    return [own for own, n in zip(owns, equal.tolist(), strict=True) if n >= need]


def passages(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int], min_words: int = MIN_WORDS, min_similarity: float = MIN_SIMILARITY) -> list[tuple[int, int, int, int, int]]:
    """(start, end, other start, other end, equal words) of the aligned chains of seed matches between two texts."""
    out: list[tuple[int, int, int, int, int]] = []
    need_equal = np.ceil(min_similarity * min_words)
    waiting = hopeful(a, b, x, y, pieces(chain(x, y), x, y), min_words, int(need_equal))[::-1]
    while waiting:
        own = waiting.pop()
        s, o = x[own[0]], y[own[0]]
        e, p = x[own[-1]] + K, y[own[-1]] + K
        if any(s - min_words >= q[0] and e + min_words <= q[1] for q in out):  # lies deep in a passage of a better chain
            continue
        # equal words at most: all between the ends, and those within min_words beyond them on their diagonals
        short = int(need_equal - min(e - s, p - o))
        if short > 0:
            left, right = min(s, o, min_words), min(len(a) - e, len(b) - p, min_words)
            if (a[s - left : s] == b[o - left : o]).sum() + (a[e : e + right] == b[p : p + right]).sum() < short:
                continue
        if all(x[i] - y[i] == s - o for i in own):  # on one diagonal
            equal = int((a[s:e] == b[o:p]).sum())
        else:
            e, p, equal = s + K, o + K, K
            for i in own[1:]:
                if x[i] < e or y[i] < p:  # overlapping seeds: the part beyond both ends
                    step = max(e - x[i], p - y[i])
                    if x[i] - y[i] != e - p or step > K:
                        continue
                    equal += K - step
                else:
                    equal += K + _common(a[e : x[i]], b[p : y[i]])
                e, p = x[i] + K, y[i] + K
        left, own_left = _reach(a[:s][::-1], b[:o][::-1])
        right, own_right = _reach(a[e:], b[p:])
        s, o, e, p, equal = s - left, o - left, e + right, p + right, equal + own_left + own_right
        need = min_words - min(e - s, p - o)
        if need > 0:  # the window of min_words words around it with the most equal ones
            before = np.r_[0, np.cumsum(a[max(0, s - need) : s][::-1][: min(s, o)] == b[max(0, o - need) : o][::-1][: min(s, o)])]
            after = np.r_[0, np.cumsum(a[e : e + need][: len(b) - p] == b[p : p + need][: len(a) - e])]
            ways = [(int(before[i] + after[need - i]), i) for i in range(len(before)) if 0 <= need - i < len(after)]
            if ways:
                more, i = max(ways)
                s, o, e, p, equal = s - i, o - i, e + need - i, p + need - i, equal + more
        if equal < min_similarity * max(e - s, p - o):  # perhaps a passage and what happens to follow it: apart at the widest gap
            gaps = [max(x[j] - x[i], y[j] - y[i]) for i, j in zip(own, own[1:])]
            at = max(range(len(gaps)), key=gaps.__getitem__) + 1
            if gaps[at - 1] > K + SPLIT:
                waiting.extend(part for part in (own[at:], own[:at]) if len(part) > 1)
        elif min(e - s, p - o) >= min_words and not any(s >= q[0] and e <= q[1] for q in out):
            out.append((s, e, o, p, equal))
    return sorted(out)


#: Where a passage lies in the folded texts, its equal words, where it lies in the whole ones.
_FIELDS = ("start", "end", "other_start", "other_end", "n_match", "w_start", "w_end", "w_other_start", "w_other_end")
_PASSAGE = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in _FIELDS]))
_PASSAGE_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in _FIELDS]))


def contexts(held: DataFrame, texts: DataFrame, before: int, after: int, min_words: int) -> DataFrame:
    """(key, node, live, c): the `before` words before and the `after` words from each holder's place on in the folded text, as packed 16-bit hashes; 0 beyond the text and where it is folded."""
    width = before + after
    row = T.StructType([held.schema["key"], held.schema["node"], held.schema["live"]]).add("c", T.BinaryType())
    own = held.groupBy("node").agg(F.collect_list(F.struct("key", "at", "live")).alias("h")).join(texts, "node")

    def spread(batches):
        for batch in batches:
            h, words, rows, most = batch.column("h"), [], [], 20_000
            ends, values = h.offsets.to_numpy(), h.values
            at, size = values.field("at").to_numpy(), 0
            for i in range(batch.num_rows):
                ids, _, gap, _ = folded(*word_ids(batch.column("text").slice(i, 1)), min_words)
                own = np.where(gap, 0, np.maximum((ids >> np.uint64(48)).astype(np.uint16), 1)).astype(np.uint16)
                padded = np.concatenate([np.zeros(before, np.uint16), own, np.zeros(after, np.uint16)])
                for a in range(ends[i], ends[i + 1], most):
                    b = min(ends[i + 1], a + most)
                    words.append(np.lib.stride_tricks.sliding_window_view(padded, width)[at[a:b]])
                    rows.append((i, a, b))
                    size += b - a
                    if size >= most:
                        yield joined(batch, values, words, rows, size)
                        words, rows, size = [], [], 0
            if size:
                yield joined(batch, values, words, rows, size)

    def joined(batch, values, words, rows, size):
        data, ends = np.concatenate(words).tobytes(), (np.arange(size + 1) * 2 * width).astype(np.int32)
        of = np.repeat([i for i, _, _ in rows], [b - a for _, a, b in rows])
        part = values.slice(rows[0][1], size)  # rows follow one another
        c = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([part.field("key"), batch.column("node").take(pa.array(of)), part.field("live"), c], names=["key", "node", "live", "c"])

    return own.select("node", "h", "text").mapInArrow(spread, row)


def alike(node: np.ndarray, live: np.ndarray, words: np.ndarray, before: int, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a key's holders, one of them live, that may hold a passage through the key: `size` words around it of which `least` stand around it in the other, too.

    Holders with `least` equal words on the diagonal of such a window hold a passage with the first one they are like; they meet this one alone
    among its like.
    """
    n, code = len(node), np.unique(words, return_inverse=True)[1].reshape(words.shape)
    code = np.where(words == 0, 0, code + 1)
    held = np.zeros(int(code.max()) + 1, dtype=bool)
    lo, hi = before - (size - K), before + size

    near_code = np.ascontiguousarray(code[:, lo:hi])

    def best(hits: np.ndarray) -> np.ndarray:
        run = np.cumsum(np.pad(hits, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
        return (run[:, size:] - run[:, :-size]).max(axis=1) >= least

    first, near = np.full(n, -1), []
    for i in range(n):
        if not live[i] and first[i] >= 0:
            near.append(None)
            continue
        held[code[i]], held[0] = True, False
        hits = held.take(near_code)
        some = np.flatnonzero(np.bitwise_count(np.packbits(hits, axis=1)).sum(axis=1, dtype=np.uint16) >= least)
        some = some[best(hits[some])]
        held[code[i]] = False
        if first[i] < 0:
            open_ = some[first[some] < 0]
            first[open_[best((near_code[open_] == near_code[i]) & (near_code[open_] > 0))]] = i
            first[i] = i
        near.append(some)
    left, right = [], []
    for i, some in enumerate(near):
        if some is not None:
            some = some[(live[i] | live[some]) & (node[some] != node[i])]
            some = some[(first[some] != first[i]) | (some == first[i]) | (first[i] == i)]
            left.append(np.full(len(some), i))
            right.append(some)
    return np.concatenate(left), np.concatenate(right)


def crowded(live: DataFrame, every: DataFrame, texts: DataFrame, tables: Tables, min_words: int, min_similarity: float) -> DataFrame:
    """(node, other): among all holders of the keys that a live one holds, the pairs that may hold a passage through the key (see `alike`).

    Every live holder meets every holder, in tiles of at most TILE by TILE, by the words around the key alone: a text that many documents share
    and nothing else gives no pair, however many they are.
    """
    node_type = every.schema["node"].dataType
    waiting = live.groupBy("key").agg(F.lit(True).alias("w")).select("key")
    flags = live.select("key", "node", "at", F.lit(True).alias("live")).distinct()
    held = every.select("key", "node", "at").distinct().join(waiting, "key", "left_semi").join(flags, ["key", "node", "at"], "left").withColumn("live", F.coalesce("live", F.lit(False)))
    held = tables.keep("held", held)
    after = int(np.ceil(min_words / min_similarity))  # as far as a passage may reach whose part here has min_words words
    before = after - K
    around = tables.keep("around", contexts(held, texts, before, after, min_words))
    # holders with the same words around the key: live ones meet their first, which stands for them
    own = tables.keep("heads", around.groupBy("key", "live", "c").agg(F.min("node").alias("node")))
    copies = around.where("live").join(own.where("live").withColumnRenamed("node", "other"), ["key", "live", "c"]).where("node <> other").select("node", "other")
    size = own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", "n", F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    buckets = max(1, own.count() // TILES)
    part = F.pmod(F.hash("node"), "parts")
    one = F.pmod(F.xxhash64("key"), F.lit(buckets))
    tiles = F.when(F.col("parts") == 1, F.array(one)).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.xxhash64("key", F.least(part, q), F.greatest(part, q))))
    own = own.join(size, "key").select("key", "node", "live", "c", F.explode(tiles).alias("tile"))

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("node", "ascending")])
        key = group["key"].to_numpy()
        live, coded = group["live"].to_numpy(), group["node"].combine_chunks().dictionary_encode()
        node_code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        words = np.frombuffer(b"".join(group["c"].to_pylist()), np.uint16).reshape(len(key), before + after)
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        pairs, least, waiting = [np.zeros(0, np.int64)], int(np.ceil(min_similarity * min_words)), 0
        for a, b in zip(cuts[:-1], cuts[1:]):
            x, y = alike(node_code[a:b], live[a:b], words[a:b], before, min_words, least)
            pairs.append(np.unique(node_code[a:b][x].astype(np.int64) << 32 | node_code[a:b][y]))  # nodes once, by whatever places
            waiting += len(pairs[-1])
            if waiting > 1 << 20:
                pairs, waiting = [np.unique(np.concatenate(pairs))], 0
        pairs = np.unique(np.concatenate(pairs))
        take = lambda at: distinct.take(pa.array(at))
        return pa.table({"node": take(pairs >> 32), "other": take(pairs & 0xFFFFFFFF)})

    return own.groupBy("tile").applyInArrow(meet, T.StructType().add("node", node_type).add("other", node_type)).unionByName(copies.distinct())


@contextlib.contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most PAIRS rows meanwhile: two whole texts a row, of crowds with long texts 10,000 rows would be many hundred MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(PAIRS, int(before)) if int(before) > 0 else PAIRS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The passages of `docs`, a row each."""
    tables = Tables(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("node"), F.col(text).alias("text")).where("node is not null and text is not null")
    prints = fingerprint(int(np.ceil(min_similarity * min_words)))
    printed = tables.keep("keyed", own.select("node", prints("text").alias("f")).select("node", "f.*"))
    keyed = printed.where("n > 0").drop("s")
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last"))
    copies = tables.keep("copies", keyed.join(heads.where("head < last").select("key", "head"), "key").where("node <> head").select("node", "head", "n").distinct())
    # only the head of a class is searched; ids of other members are taken out by an anti join
    single = own.join(copies.select("node"), "node", "left_anti")
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0

    @F.arrow_udf(_PASSAGE)
    def aligned(left: pa.Array, right: pa.Array, left_cuts: pa.Array, right_cuts: pa.Array) -> pa.Array:
        out = []
        for a, b, ca, cb in zip(left, right, left_cuts, right_cuts, strict=True):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)  # no copies
            ca, cb = np.frombuffer(ca.as_buffer(), np.int64).reshape(-1, 2), np.frombuffer(cb.as_buffer(), np.int64).reshape(-1, 2)
            x, y, runs, _ = matches(a, b, min_words, inner(ca, len(a) - K + 1, min_words) if len(ca) else None)
            got = [u for g in passages(a, b, x, y, min_words, min_similarity) if (u := unfolded(g, a, b, ca, cb, min_words, min_similarity))]
            got = sorted({*got, *exact(a, b, runs, min_words, got)})
            out.append([dict(zip(_FIELDS, (*g, *whole(g[0], g[1], ca), *whole(g[2], g[3], cb)), strict=True)) for g in got])
        return pa.array(out, _PASSAGE_ARROW)

    def align(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        texts = own.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
        words = tables.keep(f"words{turn}", texts.select("node", hashed(min_words)("text").alias("h")).select("node", "h.w", "h.cuts"))
        both = pairs.join(words, "node").join(words.select(F.col("node").alias("other"), F.col("w").alias("other_w"), F.col("cuts").alias("other_cuts")), "other")
        return both.select("node", "other", F.inline(aligned("w", "other_w", "cuts", "other_cuts")))

    # of ids with several texts the least one's stretches
    several = tables.keep("several", printed.groupBy("node").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("node"))
    least = own.join(several, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")).select("node", prints("text").alias("f")).select("node", "f.n", "f.s")
    held = printed.join(several, "node", "left_anti").select("node", "n", "s").unionByName(least).where(F.size("s") > 0).where(F.col("n") >= min_words).join(copies.select("node"), "node", "left_anti").select("node", "n", F.explode("s").alias("s")).select("node", "n", "s.*").distinct()
    again = tables.keep("again", periodic(tables.keep("stretches", held), min_words, min_similarity))
    live = linked_seeds(single, min_words, max(16, size // BUCKET), tables)
    tables.drop("keyed")
    rounds: list[DataFrame] = []
    every, tried, turn = live, None, 0
    for turn in range(2):
        if live.isEmpty():
            break
        if turn == 0:
            meet = live.select("node", F.col("home").alias("other"))
        else:
            count = live.groupBy("key").agg(F.countDistinct("node").alias("n"))
            # few holders that no home took: all of them meet; else those of all holders that are alike around the key
            few = live.join(count.where(F.col("n") <= FEW).select("key"), "key", "left_semi").select("key", "node").distinct()
            meet = few.join(few.withColumnRenamed("node", "other"), "key").select("node", "other").unionByName(crowded(live, every, own.groupBy("node").agg(F.min("text").alias("text")), tables, min_words, min_similarity))
        pairs = meet.where("node <> other").select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct()
        pairs = tables.keep(f"pairs{turn}", pairs if tried is None else pairs.join(tried, ["node", "other"], "left_anti"))
        nodes = tables.keep(f"nodes{turn}", pairs.select(F.explode(F.array("node", "other")).alias("node")).distinct())
        with few_rows(docs.sparkSession):
            found = tables.keep(f"found{turn}", align(pairs, nodes))
        rounds.append(found)
        if turn == 0:
            # keys go on without their homes and without the places aligned with one of them
            ends = found.select("node", F.col("other").alias("home"), "start", "end").unionByName(found.select(F.col("other").alias("node"), F.col("node").alias("home"), F.col("other_start").alias("start"), F.col("other_end").alias("end")))
            ends = ends.groupBy("node", "home").agg(F.collect_list(F.struct("start", "end")).alias("ends"))
            seen = live.where("node <> home").join(ends, ["node", "home"], "left").where("not coalesce(exists(ends, e -> at >= e.start and at < e.end), false)")
            live, tried = tables.keep("live1", seen.select("key", "node", "at").distinct()), pairs
        tables.drop(f"nodes{turn}", f"words{turn}")
    tables.drop("live0", "live1", "held", "around", "heads", "pairs0", "pairs1", "stretches")
    same = copies.where(F.col("n") >= min_words).select(F.col("node").alias("doc_id"), F.col("head").alias("other_id"), F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.lit(0).cast("long").alias("other_start"), F.col("n").alias("other_end"), F.col("n").alias("n_match"), F.lit(1.0).alias("similarity"), F.lit(True).alias("copy"))
    found = functools.reduce(DataFrame.unionByName, [again, *(r.select("node", "other", "n_match", *(F.col(f"w_{n}").alias(n) for n in _FIELDS[:4])) for r in rounds)]).withColumnsRenamed({"node": "doc_id", "other": "other_id"})
    found = found.withColumn("similarity", F.round(F.col("n_match") / F.greatest(F.expr("end - start"), F.expr("other_end - other_start")), 4)).withColumn("copy", F.lit(False))
    return found.unionByName(same)


def op6(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
