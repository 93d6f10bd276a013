"""Operator 8: toxicity by cumulative-link ordinal regression.

Severity grades 0..K-1 are predicted from sparse text features x with one weight vector w shared by all thresholds:
P(grade > k) = sigmoid(w.x - t_k), t_0 < t_1 < ... The expected severity is the sum of these probabilities. A feature
is a whole word or a word's beginning of 4 to 8 letters (inflected and compound words share it), present at one of LEVELS:
so many times, and so many times in so many words. The features taken are those that at least ``MIN_ROWS`` sampled
rows of positive grade have, with a share above that of the other rows by ``SURE`` standard errors; all of them, and whole texts, are
used. Weights below 0 are not allowed (a word can't excuse another): features that get one leave the fit. The fit takes
Newton steps on a bounded sample of ``sample_rows`` graded rows (those of the smallest hashes), of which near copies count once; scoring
covers whole texts of all rows with fixed-point weights, so that no sum depends on an order.

`graded` turns 0/1 labels into grades where the table has no finer ones: a positive row's grade is 1, 2 or 3 by how
many of its words per hundred are typical of positive rows (thirds of the positive rows that
have one at all). A word is typical if it, or a
beginning of it, is in at least ``MIN_ROWS`` positive rows and its share of them is ``LIFT`` times that of the others.

Result, struct ``out``: ``grade`` (the most probable), ``severity`` (expected grade), ``toxic`` (P(grade > 0) >= threshold;
unless given, the one with the best F1 on the sample).
Defined cases: a null text, or one without words, has grade 0, severity 0.0 and is not toxic; with no graded row, or
rows of one grade only, every other text has that grade (0 if none); repeated rows count once in the fit; labels
without a document, or with a null, are left out.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .text import alnum_words, chunks, table, utf8

SAMPLE_ROWS = 8_000
#: Least count, and most words of text to one occurrence (0: any).
LEVELS = ((1, 0), (2, 500), (3, 250))
BEGINNINGS = range(4, 9)
KEPT_STEMS = 200_000
STEPS, RIDGE, SCALE = 40, 0.3, 10_000
MIN_ROWS, SURE, LIFT = 8, 5.0, 8.0


def stems(word: bytes) -> list[bytes]:
    """A word (marked with $) and its beginnings."""
    letters = word.decode()
    return [word + b"$", *(letters[:k].encode() for k in BEGINNINGS if k < len(letters))]


def levels(tally: dict[bytes, int], n: int) -> list[tuple[bytes, int]]:
    return [(s, k) for s, c in tally.items() for k, (least, most) in enumerate(LEVELS) if c >= least and (not most or c * most >= n)]


class Stems:
    """The stems of words, as far as they are in `wanted`."""

    def __init__(self, wanted: set[bytes]):
        self.wanted, self.known = wanted, {}

    def tally(self, words: list[tuple[bytes, int]]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        known = self.known
        for w, c in words:
            own = known.get(w)
            if own is None:
                if len(known) >= KEPT_STEMS:
                    known.clear()
                own = known[w] = tuple(s for s in stems(w) if s in self.wanted)
            for s in own:
                out[s] = out.get(s, 0) + c
        return out


class Scale:
    """One weight per feature and the ordered thresholds."""

    def __init__(self, weights: dict[tuple[bytes, int], float], thresholds: list[float], cut: float, constant: int | None = None):
        self.cut = cut
        self.weights = {f: round(x * SCALE) for f, x in weights.items()}
        self.stems = Stems({s for s, _ in weights})
        self.thresholds, self.constant = [round(t, 4) for t in thresholds], constant

    def total(self, words: list[bytes]) -> int:
        return sum(self.weights.get(f, 0) for f in levels(self.stems.tally(Counter(words).items()), len(words)))

    def grade(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(most probable grade, P(grade > k)) of summed fixed-point weights."""
        over = 1 / (1 + np.exp(-(totals[:, None] / SCALE - np.array(self.thresholds)[None, :])))
        edge = np.concatenate([np.ones((len(totals), 1)), over, np.zeros((len(totals), 1))], axis=1)
        return np.argmax(edge[:, :-1] - edge[:, 1:], axis=1), over


def features(rows: list[list[tuple[bytes, int]]], positive: list[bool]) -> list[tuple[bytes, int]]:
    """The features that are surely more frequent in positive rows, the surest first."""
    n, m = sum(positive), len(positive) - sum(positive)
    held, rest = Counter(), Counter()
    for own, good in zip(rows, positive, strict=True):
        (held if good else rest).update(own)

    def sure(f: tuple[bytes, int]) -> float:
        p = (held[f] + rest[f]) / (n + m)
        return (held[f] / n - rest[f] / m) / math.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)

    found = [(-s, f) for f in held if held[f] >= MIN_ROWS and (s := sure(f)) >= SURE]
    return [f for _, f in sorted(found)]


def newton(x: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that minimise the sum of the K-1 logistic losses (convex)."""
    d, top = x.shape[1], over.shape[1]
    t = np.array([math.log((1 - p + 1e-3) / (p + 1e-3)) for p in over.mean(axis=0)])
    w = np.zeros(d)
    for _ in range(STEPS):
        q = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - t[None, :], -30, 30)))
        v = q * (1 - q) + 1e-6
        h = np.diag(np.concatenate([np.full(d, RIDGE), np.full(top, 1e-3)]))
        h[:d, :d] += x.T @ (x * v.sum(axis=1)[:, None].astype(np.float32))
        h[:d, d:] = -(x.T @ v)
        h[d:, :d] = h[:d, d:].T
        h[d:, d:] += np.diag(v.sum(axis=0))
        step = np.linalg.solve(h, np.concatenate([x.T @ (q - over).sum(axis=1) + RIDGE * w, -(q - over).sum(axis=0)]))
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        w, t = w - step[:d], np.maximum.accumulate(t - step[d:])
        if np.abs(step).max() < 1e-5:
            break
    return w, t


def best_cut(p: np.ndarray, positive: np.ndarray) -> float:
    """The probability from which on texts count as positive, with the best F1; midway between two neighbours."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(positive[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + positive.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # equal ones stay together
    k = int(np.argmax(f1))
    return float((p[order[k]] + p[order[k + 1]]) / 2 if k + 1 < len(p) else p[order[k]])


def train(rows: list[list[tuple[bytes, int]]], grades: list[int]) -> Scale:
    """Cumulative-link fit on rows of features. No weight is negative: the lower half of the features below 0 leaves, the rest is fitted anew."""
    y = np.array(grades, dtype=np.int64)
    if len(set(grades)) < 2:
        return Scale({}, [0.0], 0.5, grades[0] if grades else 0)
    words = features(rows, [g > 0 for g in grades]) if min(grades) == 0 else []
    number = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(rows), len(words)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, [number[f] for f in r if f in number]] = 1
    over = (y[:, None] > np.arange(int(y.max()))[None, :]).astype(float)
    left = np.arange(len(words))
    while True:
        w, t = newton(x[:, left], over)
        if not (w < 0).any():
            break
        left = left[w >= np.median(w[w < 0]) + 1e-12] if (w < 0).sum() > 1 else left[w >= 0]
    p = 1 / (1 + np.exp(t[0] - x[:, left] @ w))
    return Scale({words[i]: v for i, v in zip(left.tolist(), w.tolist(), strict=True)}, t.tolist(), best_cut(p, y > 0))


class Words:
    """Distinct words and their counts, as pairs; two plain lists take a quarter of a list of pairs."""

    __slots__ = ("words", "counts")

    def __init__(self, words: list[bytes], counts: list[int]):
        self.words, self.counts = words, counts

    def __iter__(self):
        return zip(self.words, self.counts, strict=True)


def sampled(docs: DataFrame, labels: DataFrame, grade: str, text: str, doc_id: str, sample_rows: int) -> list[tuple[int, int, Words]]:
    """(grade, number of words, distinct words and their counts) of at most `sample_rows` graded rows, near copies once.

    Rows are taken for near copies if their three rare words (in at most a twentieth of the rows) of the smallest hashes
    agree; the copy with the smallest id stays.
    """
    own = labels.select(F.col(doc_id).alias("_id"), F.col(grade).cast("int").alias("_grade")).where("_id is not null and _grade is not null")
    few = own.withColumn("_h", F.xxhash64("_id", F.lit(8))).orderBy("_h", "_id", "_grade").limit(sample_rows).select("_id", "_grade")

    @F.arrow_udf(T.StructType().add("n", T.LongType()).add("words", T.ArrayType(T.BinaryType())).add("counts", T.ArrayType(T.IntegerType())))
    def split(column: pa.Array) -> pa.Array:
        out = []
        for t in utf8(column):
            words = alnum_words(t or b"")
            tally = Counter(words)
            some = sorted(tally, key=xxhash.xxh3_64_intdigest)
            out.append({"n": len(words), "words": some, "counts": [tally[w] for w in some]})
        return pa.array(out, pa.struct([("n", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32()))]))

    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(few), "_id").select("_id", "_grade", split("_text").alias("s")).where("s.n > 0")
    got = found.select("_id", "_grade", "s.n", "s.words", "s.counts").toArrow()
    shared: dict[bytes, bytes] = {}  # one object a word, however many rows hold it
    rows = []
    for i, g, n, words, counts in zip(*(got.column(k) for k in range(5)), strict=True):
        rows.append((i.as_py(), g.as_py(), n.as_py(), Words([shared.setdefault(w, w) for w in words.as_py()], counts.as_py())))
    rows = [r[1:] for r in sorted(rows, key=lambda r: r[:3])]
    often = Counter(w for *_, words in rows for w, _ in words)
    once: dict = {}
    for i, (_, _, words) in enumerate(rows):
        rare = [w for w, _ in words if 20 * often[w] <= len(rows)][:3]
        once.setdefault(tuple(rare) if len(rare) == 3 else i, i)
    return [rows[i] for i in sorted(once.values())]


def graded(rows: list[tuple[int, int, Words]], found: Stems) -> list[int]:
    """Grades 0..3 of rows labelled 0 or 1."""
    held, rest = Counter(), Counter()
    for label, _, words in rows:
        (held if label else rest).update(found.tally(words).keys())
    n = sum(1 for label, *_ in rows if label)
    m = len(rows) - n
    typical = Stems({s for s, c in held.items() if c >= MIN_ROWS and c / n >= LIFT * (rest[s] + 0.5) / (m + 1)})
    density = [100 * sum(c for w, c in words if typical.tally([(w, 1)])) / size if label else 0.0 for label, size, words in rows]
    own = sorted(d for d in density if d > 0)
    cuts = [own[len(own) * k // 3] for k in (1, 2)] if own else []
    return [1 + sum(d > c for c in cuts) if label else 0 for d, (label, *_) in zip(density, rows, strict=True)]


_RESULT = T.StructType().add("grade", T.LongType()).add("severity", T.DoubleType()).add("toxic", T.BooleanType())
_ARROW = pa.struct([("grade", pa.int64()), ("severity", pa.float64()), ("toxic", pa.bool_())])


def assess(docs: DataFrame, scale: Scale, text: str = "text", threshold: float | None = None, out: str = "toxicity") -> DataFrame:
    """`docs` with the struct column `out` (grade, severity, toxic)."""
    shared = docs.sparkSession.sparkContext.broadcast(scale)  # a number for each surely positive feature of the sample

    @F.arrow_udf(_RESULT)
    def scored(column: pa.Array) -> pa.Array:
        model, texts = shared.value, utf8(column)
        grade, severity, toxic = (np.zeros(len(texts), dtype=d) for d in (np.int64, np.float64, bool))
        for a, b in chunks(texts):
            words = [alnum_words(t or b"") for t in texts[a:b]]
            totals = np.array([model.total(w) for w in words], dtype=np.int64)
            there = np.array([bool(w) for w in words])
            if model.constant is not None:
                grade[a:b], severity[a:b], toxic[a:b] = there * model.constant, there * float(model.constant), there & (model.constant > 0)
                continue
            best, over = model.grade(totals)
            grade[a:b], severity[a:b], toxic[a:b] = best * there, np.round(over.sum(axis=1), 6) * there, (over[:, 0] >= (model.cut if threshold is None else threshold)) & there
        return pa.StructArray.from_arrays([pa.array(grade), pa.array(severity), pa.array(toxic)], fields=list(_ARROW))

    return docs.withColumn(out, scored(F.col(text)))


def fit(docs: DataFrame, labels: DataFrame, grade: str = "grade", text: str = "text", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS, binary: bool = False) -> Scale:
    """Learn from `labels` (doc_id, grade); `binary`: the grades are 0/1 labels, made finer by `graded`."""
    rows = sampled(docs, labels, grade, text, doc_id, sample_rows)
    often = Counter(s for g, _, words in rows if g > 0 for s in {s for w, _ in words for s in stems(w)})
    found = Stems({s for s, c in often.items() if c >= MIN_ROWS})
    return train([levels(found.tally(words), n) for _, n, words in rows], graded(rows, found) if binary else [g for g, *_ in rows])


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = assess(docs, fit(docs, table(spark, sf_dir, "labels"), "toxic", binary=True))
    return got.select("doc_id", "toxicity.grade", "toxicity.severity", "toxicity.toxic")
