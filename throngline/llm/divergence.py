"""Operator 13: an audit of how the sources of each language differ in their vocabulary.

Terms are the matches of TERM in a text whose A-Z are lower-cased. A language keeps the terms that at least
`min_docs` of its documents hold (V of them). Every (lang, source) group gives each kept term its count there, zero
included, and from it p = 1 + floor(10**9 * (count + 1) / (N + V)), N being the sum of its counts over kept terms;
the language itself does the same. f = floor((p - q)**2 / q) compares two of them. Part `pair` sums f over all kept
terms for each other source of the language; part `term` has f of a group's terms against the language's, where the
group holds the term and p > q, to rank `top`. All arithmetic is on integers.

Plain relational: matches are exploded and counted (before the shuffle first), groups are crossed with the kept
vocabulary of their language to bring in the zeros, the dense cells are joined with themselves on the term, summed
and ranked. Terms and groups carry numbers of their own from the first join on, so that the wide joins move integers.
The crossing is an equi-join on language and a salt of the term's number: no language meets in one task; Spark
broadcasts the groups only while their table is below its own size limit. Before the ranks of part `term` are dealt
by group, every task keeps the first `top` of a group only (Spark's group limit), so a hot group is no hot task.
Pairs of sources are the result: their number is the square of the sources of a language.

Defined cases: null text, lang and source count as ''. Every row is a document, repeated ones too. Groups without
terms, and languages without kept terms, have pairs with the value 0 and no rows of part `term`. An empty table gives
no rows. Equal values are ranked by the UTF-8 order of the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import _LOWER, _UPPER, Tables, sql_lower, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, MIN_DOCS, TOP, SALTS = 1_000_000_000, 3, 200, 64


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else: lower() does just that to a text of ASCII alone, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)); counts whose product leaves a long take decimals."""
    wide = f"cast(cast({SCALE} as decimal(10, 0)) * cast({count} + 1 as decimal(19, 0)) div ({total} + {kept}) as bigint)"
    return F.expr(f"1 + if({count} < 9000000000, ({SCALE}L * ({count} + 1)) div ({total} + {kept}), {wide})")


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), d (documents with it)."""
    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"), (text, "text"))))
    words = own.select("lang", "source", F.regexp_extract_all(lowered(F.col("text")), F.lit(TERM), F.lit(0)).alias("w"))
    both = F.array(F.struct(F.col("w").alias("terms"), F.lit(1).alias("n"), F.lit(0).alias("d")), F.struct(F.array_distinct("w").alias("terms"), F.lit(0).alias("n"), F.lit(1).alias("d")))
    rows = words.select("lang", "source", F.inline(both)).select("lang", "source", F.explode("terms").alias("term"), "n", "d")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    tables = Tables(docs.sparkSession)
    counts = tables.keep("counts", term_counts(docs, text, lang, source))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("d").alias("d")).where(F.col("d") >= min_docs)
    kept = tables.keep("kept", kept.select("lang", "term", "all_n", F.monotonically_increasing_id().alias("tid")))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    named = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    names = tables.keep("names", named.select("lang", "source", F.monotonically_increasing_id().alias("gid")))
    cells = tables.keep("cells", counts.join(kept, ["lang", "term"]).join(names, ["lang", "source"]).select("tid", "gid", "n", "all_n", "term"))
    totals = cells.groupBy("gid").agg(F.sum("n").alias("total"))
    groups = names.join(totals, "gid", "left").join(vocabulary, "lang", "left")
    groups = tables.keep("groups", groups.select("gid", "lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "all_total"))))
    # every group with every kept term of its language
    salted = groups.select("gid", "lang", "total", "v", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    crossed = kept.select("lang", "tid", F.pmod(F.hash("tid"), F.lit(SALTS)).alias("salt")).join(salted, ["lang", "salt"])
    dense = crossed.join(cells.select("tid", "gid", "n"), ["tid", "gid"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    dense = tables.keep("dense", dense.select("tid", "gid", share("n", "total", "v").alias("p")))
    met = dense.join(dense.select("tid", F.col("gid").alias("other"), F.col("p").alias("q")), "tid").where("gid <> other")
    sums = met.groupBy("gid", "other").agg(F.sum(F.expr("((p - q) * (p - q)) div q")).alias("value"))
    others = groups.select("lang", F.col("gid").alias("other"), F.col("source").alias("item"))
    pairs = groups.select("gid", "lang", "source").join(others, "lang").where("gid <> other").join(sums, ["gid", "other"], "left")
    pairs = pairs.select("gid", "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.col("value").desc(), "item"))
    pairs = pairs.withColumn("rank", rank).drop("gid")
    own = cells.join(groups.select("gid", "total", "v", "all_total"), "gid").select("gid", F.col("term").alias("item"), share("n", "total", "v").alias("p"), share("all_n", "all_total", "v").alias("q")).where("p > q")
    terms = own.select("gid", "item", F.expr("((p - q) * (p - q)) div q").alias("value")).withColumn("rank", rank).where(F.col("rank") <= top)
    terms = terms.join(groups.select("gid", "lang", "source"), "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    tables.drop("counts", "names")
    return pairs.unionByName(terms)


def op13(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
with d as (select coalesce(lang, '') lang, coalesce(source, '') source, list_filter(regexp_extract_all({sql_lower("coalesce(text, '')")}, '{TERM}'), lambda x: x <> '') w from documents),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) n from (select lang, source, unnest(w) term from d) group by all),
kept as (select lang, term from (select lang, unnest(list_distinct(w)) term from d) group by all having count(*) >= {MIN_DOCS}),
vs as (select lang, count(*) v from kept group by lang),
cell as (select g.lang, g.source, term, coalesce(n, 0) n, v from g join kept using (lang) join vs using (lang) left join c using (lang, source, term)),
ps as (select *, 1 + ({SCALE}::hugeint * (n + 1)) // (sum(n) over (partition by lang, source) + v) p from cell),
ls as (select lang, term, sum(n) n, any_value(v) v from cell group by all),
qs as (select *, 1 + ({SCALE}::hugeint * (n + 1)) // (sum(n) over (partition by lang) + v) q from ls),
pr as (select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) f from ps a join ps b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pr on pr.lang = a.lang and pr.source = a.source and pr.item = b.source),
terms as (select lang, source, 'term' part, term item, (((p - q) * (p - q)) // q)::bigint as value from ps join qs using (lang, term) where ps.n > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (from pairs union all from terms) qualify part = 'pair' or rank <= {TOP}"""
