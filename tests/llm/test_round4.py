"""Findings of round 3: partners inside crowds, repeated places and boxes."""

from throngline.llm import passages


def test_fuzzy_pair_in_a_crowd(spark):
    """Of 60 documents that share 30 words two hold a fuzzy passage through them; no seed outside the phrase tells these two from the others."""
    phrase = [f"s{i}" for i in range(30)]
    side = lambda c, k: [f"{c}{i}" if i % 5 != 4 else f"{c}{k}y{i}" for i in range(15)]
    rows = []
    for k in range(60):
        left, right = (side("l", k)[::-1], side("r", k)) if k in (31, 47) else ([f"l{k}x{i}" for i in range(15)], [f"r{k}x{i}" for i in range(15)])
        rows.append((k, " ".join([f"a{k}x{i}" for i in range(40)] + left + phrase + right + [f"b{k}x{i}" for i in range(40)])))
    got = passages.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["other_id"]) for r in got] == [(47, 31)]
