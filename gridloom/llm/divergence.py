"""How far sources of a language use words differently: a baseline of zero counts and corrections to it.

A group is a (lang, source), and a language as a whole. Of a term with ``count`` occurrences in a group,
p = 1 + floor(SCALE * (count + 1) / (N + V)), N the group's occurrences of kept terms, V the
language's kept terms. Two groups differ by the sum over V terms of f(p, q) = floor((p - q)^2 / q).

Most terms occur in neither of two groups, where f is the same for all of them. So each pair starts at V
times f of zero counts. The inverted index (a posting list of sources per term) then corrects it:

* a term in one group alone changes f by an amount that depends on its p and on the pair only, so
  terms of the same p in a group are counted first, and the counts meet the language's other groups;
* a term in both groups changes f by what the two corrections before don't say; terms give one row for every pair of
  sources in their posting list where that is not zero. Pairs of sources are the result's own rows, so
  a list (at most a struct per source) never makes more rows than the result has for its language.

All numbers are integers: products of counts are decimals of 38 digits, quotients are rounded down.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.work import rows_of, table, work_table

#: Of UTF-8 bytes, where every byte of a character beyond ASCII is 0x80 or more; bytes.lower() lowers A-Z alone.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE, DOCUMENTS, TOP = 1_000_000_000, 3, 200
#: Terms that a task holds before it hands them on, and rows of a batch that it hands on.
HELD, ROWS = 300_000, 1 << 16
#: Parts into which a language's groups are dealt where they meet one another.
SALTS = 16
COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """COUNTS rows of (lang, source, text), several for a term: a task adds up what it holds before it hands it on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, inside) in held.items():
                found = iter(times.items())
                while some := list(islice(found, ROWS)):
                    terms, n = zip(*some, strict=True)
                    docs = pa.array(map(inside.__getitem__, terms), pa.int64(), size=len(terms))
                    yield pa.record_batch([pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), docs], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                terms = TERM.findall(text.lower())
                times, inside = held[lang, source]
                size -= len(times)
                times.update(terms)
                inside.update(set(terms))
                size += len(times)
                if size > HELD:
                    yield from given()
                    size = 0
        yield from given()

    return docs.mapInArrow(count, COUNTS)


def _p(n: str, total: str, v: str = "v") -> Column:
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(19, 0))) div CAST({total} + {v} AS DECIMAL(20, 0))").cast("long")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` beside every other group of their language (columns ``other``, ``other_p0``), language by language
    in SALTS parts of the groups."""
    parts = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"), F.pmod(F.xxhash64("source"), F.lit(SALTS)).alias("salt"))
    salted = rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(parts, ["lang", "salt"]).where("other <> source").drop("salt")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", documents: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each other source of the language is away (part ``pair``) and
    the ``top`` terms that the source uses more than its language (part ``term``).

    A null lang, source or text is empty; an empty source is a source. Repeated rows are documents of their own; other
    columns are ignored; an empty table gives no rows. Texts of any length are counted whole. A language that keeps no
    term (in at least ``documents`` of its documents) has pairs of value 0 and no terms; one of a single source no pairs.
    Equal values rank by the item's UTF-8 bytes."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = rows_of(docs, lang=lang_col, source=source_col, text=text_col).select(empty("lang"), empty("source"), empty("text"))
    # Dealt by term as they come: few rows of a task share one, so adding up before the shuffle would save nothing.
    counts = term_counts(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    postings = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))  # at most a struct per source
    postings = work_table(postings.where(F.col("docs") >= documents).drop("docs"), "postings")

    langs = postings.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = postings.select("lang", F.inline("held")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), "lang_total")
    groups = work_table(groups.withColumn("p0", F.when(F.col("v") > 0, _p("0", "total")).otherwise(1)), "groups")

    facts = groups.select("lang", "source", "total", "v", "lang_total", "p0")
    held = postings.select("lang", "term", "lang_n", F.inline("held")).join(facts, ["lang", "source"])
    held = held.select("lang", "source", "term", "p0", _p("n", "total").alias("p"), _p("lang_n", "lang_total").alias("q"))
    held = work_table(held, "held")

    by_value = lambda item: W.partitionBy("lang", "source").orderBy(F.desc("value"), item)
    best = held.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    best = best.withColumn("rank", F.row_number().over(by_value("item"))).where(F.col("rank") <= top)

    start = _pairs(groups.select("lang", "source", "p0", "v"), groups).select("lang", "source", "other", (F.col("v") * _f("p0", "other_p0")).alias("value"))
    alike = held.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    alone = _pairs(alike, groups).select(
        "lang",
        F.explode(
            F.array(
                F.struct("source", "other", (F.col("m") * (_f("p", "other_p0") - _f("p0", "other_p0"))).alias("value")),
                F.struct(F.col("other").alias("source"), F.col("source").alias("other"), (F.col("m") * (_f("other_p0", "p") - _f("other_p0", "p0"))).alias("value")),
            )
        ).alias("x"),
    ).select("lang", "x.*")
    lists = held.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("held"))  # at most a struct per source
    both = lists.select("lang", F.explode("held").alias("a"), "held").select("lang", "a", F.explode("held").alias("b")).where("a.source <> b.source")
    both = both.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("other"), F.col("a.p").alias("ap"), F.col("a.p0").alias("a0"), F.col("b.p").alias("bp"), F.col("b.p0").alias("b0"))
    both = both.select("lang", "source", "other", (_f("ap", "bp") - _f("ap", "b0") - _f("a0", "bp") + _f("a0", "b0")).alias("value")).where("value <> 0")
    pairs = start.unionByName(alone).unionByName(both).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value("item")))
    return pairs.unionByName(best)


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    """Every source of ``documents`` against its language's other sources, and its 200 most own terms."""
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {DOCUMENTS}),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
own AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(o.total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL) o USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(o.n, 0) + 1) // (g.total + l.v) AS p,
  1 + {SCALE}::HUGEINT * (k.n + 1) // (l.total + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
found AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
