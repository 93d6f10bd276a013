"""Findings of round 4: what is sent whole, the bound on matches."""

import random

import numpy as np

from throngline.llm import neardup, passages


def test_exploded_bands_are_not_sent(spark, monkeypatch):
    """Spark takes the size before the explode of the bands for the size after it: joins with them are merged, however small they seem."""
    plans, keep = {}, neardup.Tables.keep

    def noted(self, name, df):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, name, df)

    monkeypatch.setattr(neardup.Tables, "keep", noted)
    words = lambda n, k: " ".join(f"w{(n * 41 + i) if i != k else -k}" for i in range(60))
    rows = [(10 * n + k, words(n, 7 * k)) for n in range(6) for k in range(8)]
    got = neardup.classify(spark.createDataFrame(rows, "doc_id long, text string"))
    for name in ("entries", "pairs", "links", "live", "of", "classes"):
        assert "BroadcastHashJoin" not in plans[name] and "SortMergeJoin" in plans[name], name
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 48


def refrains(n, seed):
    """A refrain of 12 words said n times, with two words of its own after each."""
    return np.array([v for i in range(n) for v in (*range(12), 10**6 * seed + 2 * i, 10**6 * seed + 2 * i + 1)], np.uint64)


def test_passages_of_texts_with_many_matches():
    """Over a million matches of shingles that stand 400 times: the texts are alike in 12 of 14 words all along and share no window of 50."""
    a, b = refrains(400, 1), refrains(400, 2)
    x, y, runs, count = passages.matches(a, b)
    assert not runs and count == 400 * 400 and 8 * count > passages.MATCHES
    got = passages.passages(a, b, x, y)
    assert max(e - s for s, e, *_ in got) > 0.99 * len(a) and all(n >= 0.8 * max(e - s, p - o) for s, e, o, p, n in got)


def test_runs_are_looked_up_by_their_ends(monkeypatch):
    """Ends of runs give the matches that all matches give, and packed numbers the passages that lists give."""
    rng = random.Random(2)
    for _ in range(60):
        a, b = (np.concatenate([np.array(rng.choice([[7], [1, 2, 3], list(range(20, 34)), list(range(100, 170)), rng.choices(range(4), k=50)]) * rng.randrange(1, 9), np.uint64)[: rng.randrange(20, 200)] for _ in range(6)]) for _ in "ab")
        folded = np.array([rng.random() < 0.2 for _ in range(len(a) - passages.K + 1)])
        want = passages.matches(a, b, 50, folded)
        rows = passages.passages(a, b, *want[:2])
        with monkeypatch.context() as m:
            m.setattr(passages, "MATCHES", -1)
            m.setattr(passages, "LISTS", 1)
            x, y, runs, count = passages.matches(a, b, 50, folded)
            assert (list(x), list(y), runs, count) == (list(want[0]), list(want[1]), *want[2:]) and passages.passages(a, b, x, y) == rows
