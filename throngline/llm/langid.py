"""Operator 4: language identification by error-correcting output codes.

Every language has a binary codeword. For each bit a linear classifier over hashed byte n-grams says on which
side a text stands: the log-ratio of the n-gram's share in the languages whose bit is 1 to its share in the
others. The shares come from counts over all labelled texts (one keyed sum of per-partition counts), each language
weighing the same. Decoding is loss-weighted: a codeword's loss is the sum over bits of weight * log(1 + exp(-margin))
where margin is the bit's mean log-ratio, signed by the codeword; the nearest codeword wins, ties by name. A
bit's weight is the share of a bounded sample (every labelled row if there are at most
``sample_rows``, else about so many, by hash) on whose right side it stands, above chance. All log-ratios are fixed-point integers, so no sum depends on an order.

With at most ``EXHAUSTIVE`` languages the code has all 2**(k-1) - 1 different splits, beyond that the columns
of a fixed pseudo-random code of ``BITS`` bits whose rows all differ.

Result, struct ``out``: ``lang``, ``score`` (softmax of the losses, 0 to 1), ``ambiguous`` (the runner-up's loss is
within ``MARGIN`` of the winner's). Defined cases: a null text, or one without a letter, is ``und`` with score 0.0 and
ambiguous; no labelled text at all makes every text ``und``; one language alone is always predicted, score 1.0;
a language with no text long enough for an n-gram still takes part, with even shares; repeated rows count as often as
they stand; more than ``MOST_LANGS`` languages are refused (the counts per bucket must stay small).
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import chunks, table, utf8

BUCKETS = 1 << 13  # a length of n-gram; three lengths
LENGTHS = (2, 3, 4)
EXHAUSTIVE, BITS, MOST_LANGS = 5, 31, 256
SAMPLE_ROWS = 4_000
MARGIN, SLOPE, SCALE = 0.5, 6.0, 1_000
_CELLS = BUCKETS * len(LENGTHS)
#: ASCII letters in lower case and bytes beyond ASCII stay, anything else becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_COUNTS = "lang string, cells array<int>, n array<long>"


def codewords(n_langs: int) -> np.ndarray:
    """A (language, bit) matrix of -1 and 1 whose rows all differ."""
    if n_langs <= EXHAUSTIVE:
        splits = range(1, 2 ** (n_langs - 1)) if n_langs > 1 else [1]
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(n_langs)])
    rng = np.random.default_rng(4)
    best = None
    for _ in range(64):  # the draw whose two nearest rows are farthest apart
        code = rng.integers(0, 2, (n_langs, BITS)) * 2 - 1
        code[0, (code == code[0]).all(axis=0)] *= -1  # no bit is the same for all
        near = (code @ code.T - 2 * BITS * np.eye(n_langs)).max()
        if best is None or near < best[0]:
            best = near, code
    if best[0] >= BITS:
        raise ValueError("the code is too short for so many languages")
    return best[1]


def _cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the texts, and where each text's own begin (one more entry at the end).

    Texts stand one after another in a buffer; an n-gram belongs to the text its first byte is in. Each begins with as many spaces as
    an n-gram can reach beyond its text, and so does what follows the last one: no text counts in another's n-grams.
    """
    pad = b" " * (max(LENGTHS) - 1)
    folded = [pad + b" ".join([*t.translate(_FOLD).split(), pad]) for t in texts]
    starts = np.cumsum([0] + [len(t) for t in folded])
    raw = np.frombuffer(b"".join([*folded, pad]), dtype=np.uint8).astype(np.uint64)
    size = len(raw) - len(pad)
    out = np.empty((len(LENGTHS), size), dtype=np.int64)
    for k, n in enumerate(LENGTHS):
        h = np.zeros(len(raw), dtype=np.uint64)
        for j in range(n):
            h *= np.uint64(0x100000001B3)
            h[: len(raw) - j] += raw[j:] + np.uint64(1)
        h *= np.uint64(0x9E3779B97F4A7C15)
        out[k] = (h[:size] >> np.uint64(64 - 13)).astype(np.int64) + k * BUCKETS
    return out, starts


def _counted(batches):
    """Per language, the counts of all buckets over one partition: at most languages * buckets numbers."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
        for a, b in chunks(texts, 1 << 20):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(langs[a:b], texts[a:b], strict=True):
                by_lang.setdefault(lang, []).append(text.decode().lower().encode())
            for lang, own in by_lang.items():
                total = found.setdefault(lang, np.zeros(_CELLS + 1, dtype=np.int64))  # the last one counts texts
                total += np.bincount(_cells(own)[0].ravel(), minlength=_CELLS + 1)
                total[_CELLS] += len(own)
    for lang, total in found.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype(np.int32)]), pa.array([total[at]])], names=["lang", "cells", "n"])


class Code:
    """Languages, codewords, bit classifiers and bit weights."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.words = codewords(len(langs))
        shares = counts + 0.5
        for first in range(0, _CELLS, BUCKETS):
            part = shares[:, first : first + BUCKETS]
            part /= part.sum(axis=1, keepdims=True)
        bits = []
        for word in self.words.T:
            sides = [shares[word == side].mean(axis=0) if (word == side).any() else np.full(_CELLS, 1 / BUCKETS) for side in (1, -1)]
            bits.append(np.rint(SCALE * np.log(sides[0] / sides[1])))
        self.ratios = [b.astype(np.int32) for b in bits]
        self.weights = np.ones(len(bits))

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """(text, bit): the mean log-ratio of a text's n-grams."""
        cells, starts = _cells(texts)
        total = np.array([sum(np.add.reduceat(ratio[own], starts[:-1], dtype=np.int64) for own in cells) for ratio in self.ratios])
        return total.T / (SCALE * len(LENGTHS) * np.diff(starts)[:, None])

    def right(self, langs: list[str], texts: list[bytes]) -> np.ndarray:
        """(text, bit): whether the bit's classifier stands on the codeword's side."""
        return self.margins(texts) * self.words[[self.langs.index(x) for x in langs]] > 0

    def decode(self, texts: list[bytes]) -> list[tuple[str, float, bool]]:
        m = self.margins(texts)
        loss = np.stack([np.logaddexp(0, -SLOPE * m * word) @ self.weights for word in self.words], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        out = []
        for row, rank in zip(loss, order, strict=True):
            p = np.exp(row[rank[0]] - row)
            close = len(row) > 1 and row[rank[1]] - row[rank[0]] < MARGIN
            out.append((self.langs[rank[0]], round(float(1 / p.sum()), 6), bool(close)))
        return out


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Code | None:
    """Learn from the columns `lang` and `text`; rows with a null in one of them are left out."""
    own = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    summed = own.mapInArrow(_counted, _COUNTS).select("lang", F.explode(F.arrays_zip("cells", "n")).alias("x")).groupBy("lang", F.col("x.cells").alias("cell")).agg(F.sum("x.n").alias("n"))
    per_lang = summed.groupBy("lang").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("n")).limit(MOST_LANGS + 1).toArrow()  # at most _CELLS + 1 pairs a language
    if per_lang.num_rows > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not per_lang.num_rows:
        return None
    langs = sorted(per_lang["lang"].to_pylist())
    counts = np.zeros((len(langs), _CELLS + 1))
    for name, cells, n in zip(*(per_lang[c] for c in ("lang", "cells", "n")), strict=True):
        counts[langs.index(name.as_py()), cells.values.to_numpy()] = n.values.to_numpy()
    rare = max(1, -(-int(counts[:, _CELLS].sum()) // sample_rows))
    code = Code(langs, counts[:, :_CELLS])
    shared = own.sparkSession.sparkContext.broadcast(code)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def right(lang_column: pa.Array, text_column: pa.Array) -> pa.Array:
        names, texts, out = lang_column.to_pylist(), utf8(text_column), []
        for a, b in chunks(texts, 1 << 18):
            out.extend(shared.value.right(names[a:b], [t.decode().lower().encode() for t in texts[a:b]]).astype(np.int32).tolist())
        return pa.array(out, pa.list_(pa.int32()))

    sample = own.where(F.pmod(F.xxhash64("text"), F.lit(rare)) == 0).select(F.posexplode(right("lang", "text")).alias("bit", "ok"))
    hits = {r["bit"]: (r["ok"], r["n"]) for r in sample.groupBy("bit").agg(F.sum("ok").alias("ok"), F.count("*").alias("n")).collect()}
    code.weights = np.array([round(min(1.0, max(0.05, 2 * (ok + 1) / (n + 2) - 1)), 4) for ok, n in (hits.get(i, (0, 0)) for i in range(len(code.weights)))])
    return code


_RESULT = T.StructType().add("lang", T.StringType()).add("score", T.DoubleType()).add("ambiguous", T.BooleanType())
_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def identify(docs: DataFrame, code: Code | None, text: str = "text", out: str = "language") -> DataFrame:
    """`docs` with the struct column `out` (lang, score, ambiguous)."""
    shared = docs.sparkSession.sparkContext.broadcast(code)  # CELLS * bits numbers, whatever the corpus

    @F.arrow_udf(_RESULT)
    def named(column: pa.Array) -> pa.Array:
        code, texts = shared.value, utf8(column)
        out: list = [("und", 0.0, True)] * len(texts)
        for a, b in chunks(texts, 1 << 18):
            own = {i: t for i in range(a, b) if texts[i] and any(map(str.isalpha, t := texts[i].decode()))}
            if own and code:
                for i, got in zip(own, code.decode([t.lower().encode() for t in own.values()]), strict=True):
                    out[i] = got
        return pa.array([dict(zip(("lang", "score", "ambiguous"), x, strict=True)) for x in out], type=_ARROW)

    return docs.withColumn(out, named(F.col(text)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows of the fold that nothing is learned from (a null id counts as held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    got = identify(docs.select("doc_id", "text", "held_out"), fit(docs.where("not held_out")))
    return got.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score", "language.ambiguous")
