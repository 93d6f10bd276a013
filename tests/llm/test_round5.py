"""Findings of round 3, op6: words, seeds and keys of whole batches, matches that share places."""

import random

import numpy as np
import pyarrow as pa

from throngline.llm import passages
from throngline.llm.text import alnum_words


def test_words_of_a_batch():
    """Texts of a batch don't run into one another, equal words have equal hashes and others have not, slices and nulls are no matter."""
    texts = ["x", "ab", "", None, "É b-C", " q", "c", "AB cd\x00ab", "", "long" * 40_000 + " b", None]
    for skip in (0, 1, 3):
        ids, begin = passages.word_ids(pa.array(texts).slice(skip))
        words = [alnum_words((t or "").encode()) for t in texts[skip:]]
        assert np.diff(begin).tolist() == [len(w) for w in words]
        of = {}
        assert all(of.setdefault(w, i) == i for w, i in zip([w for ws in words for w in ws], ids.tolist(), strict=True))
        assert len(set(of.values())) == len(of)


def test_seeds_of_a_batch():
    """A text has the same seeds alone and among others."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=n)) for n in (0, 49, 50, 51, 400, 3, 120)] + ["la " * 200]
    h, text, at, marked = passages.seeds(*passages.word_ids(pa.array(texts)), 50)
    for k, t in enumerate(texts):
        alone = passages.seeds(*passages.word_ids(pa.array([t])), 50)
        assert [x[text == k].tolist() for x in (h, at, marked)] == [alone[i].tolist() for i in (0, 2, 3)]
    assert {1, 0} & set(text.tolist()) == set() and {2, 7} <= set(text.tolist())


def test_chains_of_matches_that_share_places():
    """Matches of which many share a place get the scores that a comparison of all of them gives."""
    rng = random.Random(4)
    at = np.array(sorted({(rng.randrange(0, 4000, 7), rng.randrange(0, 90, 3)) for _ in range(1500)})).T
    want, order = np.zeros(at.shape[1]), np.lexsort((at[1], at[0]))
    for k, i in enumerate(order):
        before = order[:k][(at[0, order[:k]] < at[0, i]) & (at[1, order[:k]] < at[1, i])]
        gains = want[before] - passages.GAP * (at[:, i].sum() - at[:, before].sum(axis=0))
        want[i] = passages.K + max(0, gains.max(initial=0))
    for axis in (0, 1):
        score, before = passages._scores(at, axis)
        assert np.allclose(score, want)
        assert all(b < 0 or (at[:, b] < at[:, i]).all() for i, b in enumerate(before))


def test_pairs_of_a_crowd_at_many_places(spark):
    """Texts made of the same lines in other orders meet through many keys at many places; passages of two lines are found."""
    rng, lines = random.Random(8), [" ".join(f"l{n}w{i}" for i in range(30)) for n in range(12)]
    rows = [(k, " ".join(rng.choices(lines, k=40))) for k in range(30)]
    got = {(r["doc_id"], r["other_id"]) for r in passages.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of = list(range(30))
    for a, b in got:
        of = [of[b] if c == of[a] else c for c in of]
    assert len(set(of)) == 1


def test_batches_of_pairs_are_small(spark, monkeypatch):
    """Pairs of whole texts are aligned in small batches; the session's setting is as before afterwards."""
    name, keep, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", passages.Tables.keep, {}

    def noted(self, step, df):
        seen[step] = int(spark.conf.get(name))
        return keep(self, step, df)

    monkeypatch.setattr(passages.Tables, "keep", noted)
    before, shared = spark.conf.get(name), " ".join(f"w{i}" for i in range(60))
    assert passages.find(spark.createDataFrame([(k, f"{shared} d{k}") for k in range(3)], "doc_id long, text string")).count() == 2
    assert seen["found0"] == passages.PAIRS and spark.conf.get(name) == before == str(seen["live0"])
