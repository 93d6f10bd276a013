"""Findings of round 3, op6: texts that repeat themselves."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from throngline.llm import passages
from throngline.llm.text import alnum_words


def found(spark, rows):
    return passages.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def roots(rows):
    of = {}
    top = lambda i: i if of.setdefault(i, i) == i else top(of[i])
    for a, b in rows:
        of[top(a)] = top(b)
    return {i: top(i) for i in of}


def test_folded_texts_keep_all_other_windows():
    """Folding leaves out the windows that lie inside a stretch that repeats itself and no other, and places lead back to the whole text."""
    rng = random.Random(1)
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            if rng.random() < 0.5:
                words += [f"x{rng.randrange(30)}" for _ in range(rng.randrange(1, 80))]
            else:
                root, n = [f"r{rng.randrange(4)}" for _ in range(rng.choice([1, 1, 2, 3, 5, 11, 12]))], rng.randrange(20, 200)
                words += (root * n)[:n]
        ids, begin = passages.word_ids(pa.array([" ".join(words), "a b c", " ".join(words[::-1])]))
        runs = passages.stretches(ids, begin, 50)
        folded, ends, gap, cuts = passages.folded(ids, begin, 50)
        for k in range(3):
            a, f, g = ids[begin[k] : begin[k + 1]], folded[ends[k] : ends[k + 1]], gap[ends[k] : ends[k + 1]]
            want = {tuple(a[j : j + 50]) for j in range(len(a) - 49) if not any(s <= j + begin[k] and j + begin[k] + 50 <= e for s, e, _ in runs)}
            left = [j for j in range(len(f) - 49) if not g[j : j + 50].any()]
            assert {tuple(f[j : j + 50]) for j in left} == want
            for j in left:
                s, e = passages.whole(j, j + 50, cuts[k])
                assert e - s == 50 and (a[s:e] == f[j : j + 50]).all()


def test_rows_of_repeated_words_grow_with_the_texts(spark):
    """Texts made of words said 52 to 400 times: their rows are a few for each stretch however many texts there are, all holders of a 50-word window are connected by rows that cover it."""
    count = {}
    for n in (12, 36):
        rng, rows = random.Random(n), []
        for k in range(n):
            said = [" ".join([rng.choice(["la", "go on", "of", "so it is", "the"])] * rng.randrange(52, 400)) for _ in range(4)]
            rows.append((k, " ".join(f"{t} {' '.join(f'd{k}x{j}y{i}' for i in range(30))}" for j, t in enumerate(said))))
        docs, got = {k: alnum_words(t.encode()) for k, t in rows}, found(spark, rows)
        holders, cover = defaultdict(set), defaultdict(set)
        for i, words in docs.items():
            for j in range(len(words) - 49):
                holders[tuple(words[j : j + 50])].add(i)
        for r in got:
            for j in range(r["start"], r["end"] - 49):
                cover[tuple(docs[r["doc_id"]][j : j + 50])].add((r["doc_id"], r["other_id"]))
            assert r["similarity"] >= 0.8 and r["other_id"] < r["doc_id"] and 0 <= r["other_start"] and r["other_end"] <= len(docs[r["other_id"]])
        for window, ids in holders.items():
            if len(ids) > 1:
                of = roots(cover[window])
                assert len({of.get(i) for i in ids}) == 1 and set(of) >= ids
        count[n] = len(got)
    assert count[12] <= 4 * 12 and count[36] <= 4 * 36


def test_short_stretches_are_linked(spark):
    """Stretches of 40 to 49 equal words with other words around them are fuzzy passages, at a text's begin and end, too; of fewer words not."""
    own = lambda k, n: " ".join(f"d{k}x{i}" for i in range(n))
    rows = [(0, f"{'la ' * 60}{own(0, 30)}"), (1, f"{own(1, 30)} {'la ' * 43}"), (2, f"{'la ' * 41}{own(2, 30)}"), (3, f"{own(3, 30)} {'la ' * 37}{own(4, 30)}"), (4, f"{own(5, 30)} {'go on ' * 22}{own(6, 30)}"), (5, f"{own(7, 30)} {'on go ' * 21}{own(8, 30)}")]
    got = found(spark, rows)
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(1, 0), (2, 0), (5, 4)}
    for r in got:
        assert r["end"] - r["start"] >= 50 and r["other_end"] - r["other_start"] >= 50 and r["n_match"] >= 40


def test_words_that_repeat_match_on_few_diagonals():
    """Of a word said 40 times in both texts two diagonals at most are matches; windows of 50 words across its end stay."""
    a, b = (np.array([7] * n + list(range(m, m + 60)), np.uint64) for n, m in ((40, 100), (34, 200)))
    x, y, _, _ = passages.matches(a, b)
    assert len({i - j for i, j in zip(x, y, strict=True)}) <= 2
    c = np.array([5] * 30 + [7] * 34 + list(range(300, 330)), np.uint64)
    x, y, runs, _ = passages.matches(np.array([6] * 3 + [5] * 30 + [7] * 40, np.uint64), c)
    assert runs and {i - j for i, j in zip(x, y, strict=True)} >= {3}
