"""Operator 10: personal data, with DataFrame functions only.

Base spans are found by fixed patterns with checks (address parts, Luhn, digit counts). Beside them high-recall
generators propose overlapping candidates: number-like runs, long tokens, written-out addresses. Each candidate
becomes a few small integers of format and context; boosted trees, rendered as SQL CASE expressions, score them,
and those whose calibrated probability reaches ``threshold`` become spans as well.

The trees learn from all candidates of the corpus: rows are counted by feature cell, so what reaches the driver
is at most CELLS rows whatever the input. A candidate is a positive example if its format alone proves it (a
pattern with checksum or digit rules, a known key format); the proving marks themselves (plus sign, checksum,
exact length) are not features. Three of four texts, by hash, grow the trees, the rest calibrates them.

Result, struct ``out``: ``base`` and ``spans``, arrays of (rank, s, e, kind) sorted by kind as listed, then start;
code points, end exclusive. Added kinds follow the base kinds: ``address``, ``number``, ``secret``.

Defined cases: a null or empty text has no spans; a corpus without candidates grows no trees and adds no spans;
repeated rows count as often as they stand; an added span that overlaps a base span is dropped, base ones never.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .text import free, table

# Fixed by the contract: patterns of the four base kinds. Java forms of the same languages: possessive where no
# other way to match exists, so that very long runs need no deep stack; runs are entered at their first character
# (or where the last match ended), so that a failing run is not tried again from each of its characters.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CHECKS = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), x -> length(ltrim('0', x)) <= 3 and cast(right(x, 3) as int) <= 255)",
    "card": "length(translate(m, ' -', '')) between 16 and 19 and luhn_check(translate(m, ' -', ''))",
    "phone": "length(translate(m, '+ ().-', '')) between 8 and 15",
}
GENERATORS = {
    "address": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9])[+(]?[0-9][0-9().\x20-]{5,}[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}",
}
KINDS = [*PATTERNS, *GENERATORS]
_KNOWN_KEY = "^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})$"
_SPAN = "array<struct<s:int,e:int,m:string,c:string>>"

#: Feature name, SQL over a candidate x (gen, m: the match, c: up to 24 characters before it), values 0..n-1.
FEATURES = {
    "gen": ("x.gen", 3),
    "digits": ("least(length(regexp_replace(x.m, '[^0-9]', '')), 20)", 21),
    "letters": ("least(ceil(length(regexp_replace(x.m, '[^A-Za-z]', '')) / 6), 4)", 5),
    "marks": ("least(length(regexp_replace(x.m, '[A-Za-z0-9]', '')), 4)", 5),
    "length": ("least(length(x.m) div 8, 5)", 6),
    "word": ("case when lower(x.c) rlike 'token|key|secret|passw|pwd|auth' then 1 when lower(x.c) rlike 'mail|phone|tel|call|fax|card|iban|account' then 2 else 0 end", 3),
    "set": ("case when x.c rlike '[=:]\\\\s?[\"\\']?$' then 1 else 0 end", 2),
    "hex": ("case when x.m rlike '[G-Zg-z]' then 0 else 1 end", 2),
}
#: Most rows that the driver gets: all value combinations, twice (growing, calibrating).
CELLS = 2 * math.prod(n for _, n in FEATURES.values())
TREES, DEPTH, RATE, THRESHOLD = 24, 3, 0.4, 0.5


def _matches(text: str, pattern: str) -> str:
    """SQL: matches of a pattern with offsets and the text before them.

    The pieces between matches and the matches add up to offsets. Blocks of 256 keep the cost of appending low.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    got = f"zip_with(regexp_extract_all({text}, '{p}', 0), split({text}, '{p}', -1), (m, g) -> named_struct('g', g, 'm', m))"
    inner = f"aggregate(b, named_struct('at', a.run.at, 'l', cast(array() as {_SPAN})), (r, x) -> named_struct('at', r.at + length(x.g) + length(x.m), 'l', concat(r.l, array(named_struct('s', r.at + length(x.g), 'e', r.at + length(x.g) + length(x.m), 'm', x.m, 'c', right(x.g, 24))))))"
    return f"""aggregate(transform(array(filter({got}, x -> x.m is not null)), z -> transform(sequence(0, size(z) div 256), k -> slice(z, k * 256 + 1, 256)))[0],
        named_struct('run', named_struct('at', 0, 'l', cast(array() as {_SPAN})), 'all', cast(array() as array<{_SPAN}>)),
        (a, b) -> named_struct('run', {inner}, 'all', concat(a.all, array(a.run.l))),
        a -> flatten(concat(a.all, array(a.run.l))))"""


def _found(docs: DataFrame, text: str) -> DataFrame:
    """`docs` and the columns _base and _cand, arrays of spans."""
    t = "_text"
    d = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("_any", F.col(t).rlike(r"[0-9@]|[A-Za-z0-9_/+-]{20}|[(\[]at[)\]]"))
    empty = f"cast(array() as {_SPAN})"
    for kind, pattern in (PATTERNS | GENERATORS).items():
        gate = {"email": "_text like '%@%'", "phone": "_text like '%+%'", "address": "_text rlike '@|[(\\\\[]at[)\\\\]]'"}.get(kind, "true")
        d = d.withColumn(f"_{kind}", F.expr(f"case when _any and {gate} then {_matches(t, pattern)} else {empty} end"))
    lists = [f"transform(filter(_{k}, m -> {CHECKS[k].replace('m,', 'm.m,').replace('(m)', '(m.m)')}), x -> named_struct('rank', {i}, 's', x.s, 'e', x.e, 'kind', '{k}'))" for i, k in enumerate(PATTERNS)]
    cands = [f"transform(_{k}, x -> named_struct('gen', {i}, 's', x.s, 'e', x.e, 'm', x.m, 'c', x.c))" for i, k in enumerate(GENERATORS)]
    d = d.withColumn("_base", F.expr(f"concat({', '.join(lists)})")).withColumn("_cand", F.expr(f"concat({', '.join(cands)})"))
    return d.drop("_any", *[f"_{k}" for k in KINDS])


def _cells(found: DataFrame) -> list:
    """(features, fold, n, positives) for each feature cell of all candidates."""
    digits = "translate(x.m, '+ ().-', '')"
    proof = f"""case when x.gen = 0 then true
        when x.gen = 2 then x.m rlike '{_KNOWN_KEY}'
        else (left(x.m, 1) = '+' and length({digits}) between 8 and 15)
          or (x.m rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' and {CHECKS["ip"].replace("(m,", "(x.m,")})
          or (length({digits}) between 16 and 19 and luhn_check({digits})) end"""
    x = found.where("size(_cand) > 0").select((F.abs(F.xxhash64("_text")) % 4).alias("fold"), F.explode("_cand").alias("x"))
    x = x.select((F.col("fold") == 0).alias("held"), *[F.expr(f"cast({e} as int)").alias(f) for f, (e, _) in FEATURES.items()], F.expr(f"cast({proof} as int)").alias("good"))
    return x.groupBy("held", *FEATURES).agg(F.count("*").alias("n"), F.sum("good").alias("p")).collect()


class Trees:
    """Boosted trees over integer features with logistic loss, and a Platt calibration of their sum."""

    def __init__(self, cells: list):
        names = list(FEATURES)
        order = sorted(cells, key=lambda r: tuple(r))
        x = np.array([[r[f] for f in names] for r in order], dtype=np.int64).reshape(-1, len(names))
        n, p = (np.array([float(r[k] or 0) for r in order]) for k in "np")
        held = np.array([r["held"] for r in order], dtype=bool)
        grow = ~held if (~held).any() else held | True
        self.trees, self.scale = [], (1.0, 0.0)
        if not len(order):
            self.start = -10.0
            return
        self.start = math.log((p[grow].sum() + 0.5) / (n[grow].sum() - p[grow].sum() + 0.5))
        score = np.full(len(order), self.start)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-score))
            tree = self._split(x, np.where(grow, p - n * q, 0), np.where(grow, n * q * (1 - q), 0), np.arange(len(order)), DEPTH)
            self.trees.append(tree)
            score += np.array([self._leaf(tree, row) for row in x.tolist()])
        test = held if held.any() else grow
        self.scale = self._platt(score[test], n[test], p[test])

    @staticmethod
    def _split(x, g, h, rows, depth):
        value = lambda own: round(RATE * float(g[own].sum() / (h[own].sum() + 1.0)), 4)
        best = (1e-6, None, None)
        if depth:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for f, (_, values) in enumerate(FEATURES.values()):
                gs, hs = (np.bincount(x[rows, f], weights=w[rows], minlength=values).cumsum() for w in (g, h))
                for cut in range(values - 1):
                    if 0 < hs[cut] < hs[-1]:
                        gain = gs[cut] ** 2 / (hs[cut] + 1) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1) - whole
                        if gain > best[0] + 1e-9:
                            best = gain, f, cut
        if best[1] is None:
            return value(rows)
        left = x[rows, best[1]] <= best[2]
        return best[1], best[2], Trees._split(x, g, h, rows[left], depth - 1), Trees._split(x, g, h, rows[~left], depth - 1)

    @staticmethod
    def _leaf(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    @staticmethod
    def _platt(s, n, p) -> tuple[float, float]:
        """Slope and offset of the calibration, by Newton steps that are halved until the loss falls."""
        at = np.array([1.0, 0.0])

        def loss(v: np.ndarray) -> float:
            z = v[0] * s + v[1]
            return float((n * np.logaddexp(0, z) - p * z).sum() + ((v - [1.0, 0.0]) ** 2).sum() / 2)

        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(at[0] * s + at[1], -500, 500)))
            g, w = p - n * q, n * q * (1 - q)
            m = np.array([[(w * s * s).sum() + 1.0, (w * s).sum()], [(w * s).sum(), w.sum() + 1.0]])
            step = np.linalg.solve(m, [(g * s).sum() + (1.0 - at[0]), g.sum() - at[1]])
            while np.abs(step).max() > 1e-9 and loss(at + step) > loss(at):
                step /= 2
            at = at + step
            if np.abs(step).max() < 1e-9:
                break
        a, b = at
        return round(float(a), 4), round(float(b), 4)

    def sql(self, var: str = "x") -> str:
        """SQL: the calibrated probability of a candidate whose features are fields of `var`."""
        names = list(FEATURES)

        def show(tree) -> str:
            return f"{tree}D" if not isinstance(tree, tuple) else f"case when {var}.{names[tree[0]]} <= {tree[1]} then {show(tree[2])} else {show(tree[3])} end"

        total = " + ".join([f"{round(self.start, 4)}D", *[f"({show(t)})" for t in self.trees]])
        a, b = self.scale
        return f"1D / (1D + exp(-({a}D * ({total}) + {b}D)))"


def find(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, out: str = "pii") -> DataFrame:
    """`docs` with the struct column `out` (base, spans)."""
    own = docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns})
    found = _found(own, f"_in_{text}")
    trees = Trees(_cells(found.select("_text", "_cand")))
    fields = ", ".join(f"'{f}', cast({e} as int)" for f, (e, _) in FEATURES.items())
    d = found.withColumn("_feat", F.expr(f"transform(_cand, x -> named_struct('s', x.s, 'e', x.e, {fields}))"))
    d = d.withColumn("_more", F.expr(f"filter(_feat, x -> {trees.sql()} >= {threshold}D and not exists(_base, b -> b.s < x.e and b.e > x.s))"))
    more = " ".join(f"when {i} then '{k}'" for i, k in enumerate(GENERATORS))
    d = d.withColumn("_spans", F.expr(f"concat(_base, transform(_more, x -> named_struct('rank', {len(PATTERNS)} + x.gen, 's', x.s, 'e', x.e, 'kind', case x.gen {more} end)))"))
    d = d.withColumn("_out", F.struct(F.col("_base").alias("base"), F.array_sort("_spans").alias("spans")))
    # a generator of one row each: later expressions on the result aren't merged with the search, which would repeat it
    return d.select(*[F.col(f"`_in_{c}`").alias(c) for c in docs.columns if c != out], F.explode(F.array("_out")).alias(out))


def redact(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` whose text has [KIND] in place of each span; overlapping spans become one, named by the first. Null and empty texts stay."""
    pii, t, cut = (free(docs, n) for n in ("pii", "t", "cut"))
    d = find(docs, text, threshold, pii).withColumn(t, F.col(text))
    merged = f"""aggregate(array_sort(transform({pii}.spans, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind))), cast(array() as array<struct<s:int,e:int,kind:string>>), (a, x) ->
        case when size(a) > 0 and x.s < element_at(a, -1).e
             then concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e), 'kind', element_at(a, -1).kind)))
             else concat(a, array(x)) end)"""
    d = d.withColumn(cut, F.expr(f"case when size({pii}.spans) > 0 then {merged} end"))
    parts = f"concat(transform({cut}, (x, i) -> concat(substring({t}, coalesce(get({cut}, i - 1).e, 0) + 1, x.s - coalesce(get({cut}, i - 1).e, 0)), '[', upper(x.kind), ']')), array(substring({t}, element_at({cut}, -1).e + 1)))"
    d = d.withColumn(text, F.expr(f"case when {cut} is null then {t} else array_join({parts}, '') end"))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def op10(spark, sf_dir: str) -> DataFrame:
    d = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(pii.base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in PATTERNS]
    return d.select("doc_id", *counts, F.sha2(_joined("pii.base"), 256).alias("base_sha256"), _joined("pii.spans").alias("spans"))
