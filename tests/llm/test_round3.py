"""Operators 11 to 13: SQL and brute force on built cases, odd inputs."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from throngline.llm import centroids, divergence, vectordup

NAN, INF = float("nan"), float("inf")
EMBEDDING = "vec_id long, embedding array<float>, label int, v string, key string, cluster string, node long"


def frame(spark, rows, schema=EMBEDDING):
    return spark.createDataFrame([(i, e, 0, "v", "k", "c", 1) for i, e in rows], schema)


# operator 11


def lloyd(rows, k, rounds, dims, scale, seed=1):
    """The contract in plain integers."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    key = lambda r: ("~" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    cents = [e for _, e in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        own = [min((far(e, c), j) for j, c in enumerate(cents)) for _, e in kept]
        for j in range(len(cents)) if r < rounds else ():
            group = [e for (_, e), (_, o) in zip(kept, own) if o == j]
            if group:
                cents[j] = [sum(c) // len(group) for c in zip(*group)]
    return sorted((str(i), j, d, sum(x for x, o in own if o == j), sum(x for x, _ in own), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own))


def shown(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_clusters_equal_plain_integers(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice((-1, 0, 1)) / 4 + rnd.random() / 8 for _ in range(8)]) for i in range(400)]
    rows += [(i + 1000, list(e)) for i, e in rows[:50]] + [(rows[7][0], rows[7][1])]  # copies and a repeated row
    assert shown(centroids.cluster(frame(spark, rows), k=12, rounds=4, dims=8)) == lloyd(rows, 12, 4, 8, 64)


def test_clusters_of_lattice_points_tie(spark):
    """Many vectors lie exactly between centroids: the smaller number wins."""
    rows = [(16 * a + b, [a / 64, b / 64]) for a in range(16) for b in range(16)]
    assert shown(centroids.cluster(frame(spark, rows), k=9, rounds=3, dims=2)) == lloyd(rows, 9, 3, 2, 64)


def test_clusters_of_large_numbers(spark):
    """Integers beyond 2**24 lose bits in float32; the intervals know it."""
    rnd = random.Random(1)
    rows = [(i, [1e6 + rnd.choice((0.0, 0.0625, 0.125, 1.0)) for _ in range(4)]) for i in range(120)]
    assert shown(centroids.cluster(frame(spark, rows), k=5, rounds=2, dims=4)) == lloyd(rows, 5, 2, 4, 64)


def test_shortlist_holds_the_nearest():
    rng = np.random.default_rng(3)
    for big in (3, 40, 1 << 20, centroids.BOUND):
        x, c = rng.integers(-big, big + 1, (500, 64)), rng.integers(-big, big + 1, (16, 64))
        c[5], x[:20] = c[2] + (np.arange(64) == 0), c[rng.integers(0, 16, 20)]
        exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        own, far = centroids.nearest(x, c)
        assert (far == exact.min(axis=1)).all() and (own == exact.argmin(axis=1)).all()
        assert centroids.shortlist(x, c).sum() < 2 * len(x)


def test_clusters_of_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0, None]), (5, [NAN, 1.0]), (6, [1.0, -INF]), (7, [-0.01, 0.5]), (7, [-0.01, 0.5]), (None, [0.25, 0.25])]
    got = shown(centroids.cluster(frame(spark, rows), k=3, rounds=2, dims=2))
    assert [r[0] for r in got] == ["7", "7", "None"] and got == lloyd(rows, 3, 2, 2, 64)
    assert shown(centroids.cluster(frame(spark, rows[:6]), k=3, dims=2)) == [] and shown(centroids.cluster(frame(spark, []), dims=2)) == []
    assert shown(centroids.cluster(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0])]), k=1, rounds=1, dims=2))[0][2] == centroids.BOUND**2  # saturated: around a mean of 0


# operator 12


def all_pairs(rows, least=0.9):
    """vec_id, n_links and component of each row by comparing all rows."""
    ok = [i is not None and e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) for i, e in rows]
    unit = [np.array(e, dtype=np.float32).astype(float) / np.linalg.norm(np.array(e, dtype=np.float32).astype(float)) if o else None for (_, e), o in zip(rows, ok)]
    n, comp, links = len(rows), list(range(len(rows))), [0] * len(rows)
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a], links[b] = links[a] + 1, links[b] + 1
                ca, cb = comp[a], comp[b]
                comp = [cb if c == ca else c for c in comp] if ca != cb else comp
    name = {c: min((rows[k][0] for k in range(n) if comp[k] == c and rows[k][0] is not None), default=None) for c in set(comp)}
    return sorted(str((i, links[k], name[comp[k]] if ok[k] else i, (name[comp[k]] if ok[k] else i) == i)) for k, (i, _) in enumerate(rows))


def compared(spark, rows):
    return sorted(str((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in vectordup.classify(frame(spark, rows)).collect())


def near(rng, center, cos):
    """A vector at this cosine from a unit vector."""
    z = rng.standard_normal(len(center))
    z -= (z @ center) * center
    return cos * center + np.sqrt(1 - cos**2) * z / np.linalg.norm(z)


def direction(rng, dims=64):
    x = rng.standard_normal(dims)
    return x / np.linalg.norm(x)


def test_vectors_against_all_pairs(spark):
    """Copies, tight groups, pairs on both sides of the threshold, a chain, homes whose members link in part."""
    rng, rows = np.random.default_rng(7), []
    add = lambda x, scale=1.0: rows.append((len(rows), [float(v) for v in np.asarray(x) * scale]))
    for _ in range(60):
        add(direction(rng))
    for cos in (0.85, 0.89, 0.895, 0.905, 0.91, 0.95, 0.99):
        for _ in range(6):
            c = direction(rng)
            add(c), add(near(rng, c, cos), 3.0)
    c = direction(rng)
    for _ in range(60):
        add(near(rng, c, 0.99))
    for _ in range(10):
        add(near(rng, c, 0.93))  # near the group, each linked with a part of it
    for _ in range(20):
        add(c)
    x = direction(rng)
    for _ in range(12):
        add(x)
        x = near(rng, x, 0.93)
    assert compared(spark, rows) == all_pairs(rows)


def test_crowds_beyond_the_window(spark, monkeypatch):
    """A loose group of more rows than a window, mutually linked without being close to one home, and two tight groups that link in part."""
    monkeypatch.setattr(vectordup, "WINDOW", 16)
    monkeypatch.setattr(vectordup, "TILE", 24)
    rng, rows = np.random.default_rng(11), []
    c = direction(rng)
    for _ in range(90):
        rows.append((len(rows), list(map(float, near(rng, c, 0.955)))))
    a = direction(rng)
    b = near(rng, a, 0.9)
    for x in (a, b):
        for _ in range(40):
            rows.append((len(rows), list(map(float, near(rng, x, 0.99)))))
    tables = vectordup.classify(frame(spark, rows))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in tables.collect()}
    x = np.array([e for _, e in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert [got[i][0] for i in range(len(rows))] == want.tolist()
    assert [got[i][1] for i in range(len(rows))] == [0] * 90 + [90] * 80


def test_groups_are_not_listed_in_pairs(spark):
    """Rows made for a tight group grow with its members: its homes alone go through the link passes."""
    made = []
    keep = vectordup.Tables.keep

    def counted(self, name, df):
        out = keep(self, name, df)
        if name == "pairs":
            made.append(out.count())
        return out

    rng = np.random.default_rng(2)
    c = direction(rng)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(vectordup.Tables, "keep", counted)
        got = vectordup.classify(frame(spark, [(i, list(map(float, near(rng, c, 0.995)))) for i in range(600)]))
        assert {(r["n_links"], r["component_id"]) for r in got.collect()} == {(599, 0)}
    assert made[0] < 600


def test_passes_grow_slowly():
    assert [vectordup.passes(n) for n in (0, 100, 50_000, 10**9, 10**12)] == sorted(vectordup.passes(n) for n in (0, 100, 50_000, 10**9, 10**12)) and vectordup.passes(10**9) < 120


def test_vectors_of_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [NAN, 1.0]), (6, [INF, 1.0]), (7, [1.0, 0.1]), (8, [2.0, 0.2]), (8, [2.0, 0.2]), (9, [1.0, 0.1, 0.0]), (10, [-0.0, 5.0]), (11, [0.0, 5.0]), (12, [1e30, 1e29]), (12, [0.0, 1e-30]), (None, [1.0, 0.1])]
    assert compared(spark, rows) == all_pairs(rows)
    assert compared(spark, []) == [] and compared(spark, rows[:3]) == all_pairs(rows[:3])


# operator 13


def audited(rows, min_docs=3, top=200):
    """The contract in plain Python."""
    from collections import Counter, defaultdict
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(divergence.TERM, (text or "").translate(lower))) for text, lang, source in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        n[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang in sorted({d[0] for d in docs}):
        kept = [t for t, k in df[lang].items() if k >= min_docs]
        every = Counter()
        for (own, _), c in n.items():
            if own == lang:
                every.update(c)

        def share(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + int(Fraction(10**9 * (c[t] + 1), total) // 1) for t in kept}

        f = lambda p, q: (p - q) ** 2 // q
        whole, parts = share(every), {s: share(c) for (own, s), c in n.items() if own == lang}
        for s, p in parts.items():
            pairs = sorted(((-sum(f(p[t], q[t]) for t in kept), o.encode()) for o, q in parts.items() if o != s))
            terms = sorted(((-f(p[t], whole[t]), t.encode()) for t in kept if n[lang, s][t] > 0 and p[t] > whole[t]))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def listed(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_divergence_against_plain_python(spark):
    rnd, words = random.Random(3), ["The", "the", "eau", "Été", "été", "ÉTÉ", "a1b", "naïve", "x_y", "ZZ", "日本", "\U0001d4b3q", "rare"]
    rows = [(" ".join(rnd.choices(words, k=rnd.randrange(12))) if rnd.random() > 0.1 else None, rnd.choice(("en", "fr", None, "")), rnd.choice(("s1", "s2", "s3", None))) for _ in range(80)]
    rows += [(None, "xx", "only"), ("", "xx", "other"), ("solo word", "yy", "s1"), ("tie tie", "zz", "b"), ("tie tie", "zz", "a"), ("tie tie", "zz", "c")] + [rows[0]] * 3
    df = spark.createDataFrame([(t, la, s, "n", 1) for t, la, s in rows], "text string, lang string, source string, n string, gid long")
    for top in (200, 2):
        assert listed(divergence.audit(df, top=top)) == audited(rows, top=top)
    assert listed(divergence.audit(df.limit(0))) == []


def test_shares_of_huge_counts(spark):
    """Counts whose product with 10**9 leaves a long."""
    n, total, v = 5 * 10**15, 7 * 10**16, 10**6
    df = spark.createDataFrame([(n, total, v), (3, 9, 2)], "n long, total long, v long")
    assert [r["p"] for r in df.select(divergence.share("n", "total", "v").alias("p")).collect()] == [1 + 10**9 * (n + 1) // (total + v), 1 + 10**9 * 4 // 11]


def test_top_terms_are_cut_before_the_shuffle(spark):
    """A hot group's terms don't meet in one task: each task keeps the first ranks only."""
    df = spark.createDataFrame([(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} common", "en", f"s{i % 2}") for i in range(2000)], "text string, lang string, source string")
    plan = divergence.audit(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert df.agg(F.count("*")).first()[0] == 2000
