"""Source divergence audit: how far the word use of each source is from the other sources of its language.

A language keeps the terms of at least `least_docs` of its documents.  A group (language, source) gives a term of count n
the smoothed parts per SCALE p = 1 + floor(SCALE * (n + 1) / (N + V)), and the language does so over all its sources;
the divergence of p from q is floor((p - q) ** 2 / q).  All of it is whole numbers.

Terms that a group lacks all have one p, its base.  So the sum over all V terms for sources A and B is V times the
divergence of the bases, corrected where a term occurs: for the terms of A by themselves and for those of B by themselves
(both from a histogram of p a group, for p follows from the count), and for the terms of both by what the first two
corrections get wrong.  Only that last part meets terms of two sources, and only terms that occur in both.

Terms of a group that its language uses less are ranked by radix selection (radix.py).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm.frames import BROADCAST_ROWS, joined, map_arrow, partitions, saved
from ridgeline.llm.radix import ranked

SCALE = 1_000_000_000
LEAST_DOCS, RANKS = 3, 200
#: Letters and all that isn't ASCII, in UTF-8 whose ASCII letters are in lower case.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Terms that a task holds before it hands on their counts.
HELD = 250_000


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) with partial counts of tasks, and a row without a term for each group; nulls are ''."""

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        lang, source, term, n, docs = [], [], [], [], []
        for (own_lang, own_source), (counts, seen) in held.items():
            lang += [own_lang] * (len(counts) + 1)
            source += [own_source] * (len(counts) + 1)
            term += [None, *counts]
            n += [0, *counts.values()]
            docs += [0, *(seen[t] for t in counts)]
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts, seen = held.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(_TERM.findall(text.encode().lower()))  # of bytes, lower() means ASCII only
                size -= len(counts)
                for term, n in own.items():
                    counts[term] += n
                    seen[term] += 1
                size += len(counts)
                if size > HELD:
                    yield rows(held)
                    held, size = {}, 0
        if held:
            yield rows(held)

    empty = F.lit("")
    columns = [F.coalesce(F.col(c).cast("string"), empty).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return map_arrow(docs.select(*columns), run, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 1) / total) in whole numbers of any size; 1 without a total."""
    return F.expr(f"1 + CASE WHEN {total} = 0 THEN 0 WHEN {n} < 9000000000 THEN {SCALE} * ({n} + 1) div {total} ELSE CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(20,0)) div CAST({total} AS DECIMAL(20,0)) END").cast("long")


def diverges(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def kept_terms(counts: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Of term_counts(): (lang, source, term, n, of_lang) of kept terms, of_lang being the language's count, and (lang, source, total, lang_total, terms, base) of every group."""
    # dealt by the term, so that counts of groups, of the language and of documents all come from one shuffle
    summed = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    summed = summed.select("*", F.sum("docs").over(term).alias("all_docs"), F.sum("n").over(term).alias("of_lang"), F.row_number().over(term.orderBy("source")).alias("place"))
    summed = saved(summed.where(F.col("term").isNull() | (F.col("all_docs") >= least_docs)).select("lang", "source", "term", "n", "of_lang", "place"))
    first = F.col("term").isNotNull() & (F.col("place") == 1)
    groups = summed.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(first.cast("long")).alias("firsts"))
    lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "total", F.sum("total").over(lang).alias("lang_total"), F.sum("firsts").over(lang).alias("terms"))
    groups = saved(groups.withColumn("size", F.col("total") + F.col("terms")).withColumn("n", F.lit(0).cast("long")).withColumn("base", share("n", "size")).drop("size", "n"))
    return summed.where(F.col("term").isNotNull()).drop("place"), groups


def _with_others(left: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """Rows of (lang, a, ...) once for each other source b of their language, with its base.  Broadcast, or dealt over salts by a hash of the row."""
    other = groups.select("lang", F.col("source").alias("b"), F.col("base").alias("b_base"))
    if few:
        met = left.join(F.broadcast(other), "lang")
    else:
        salts = partitions(left.sparkSession)
        dealt = left.withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
        met = dealt.join(other.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["lang", "salt"]).drop("salt")
    return met.where("a != b")


def source_pairs(present: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): the divergence of each source a from each other source b of its language, summed over all kept terms.

    `present` has (lang, source, term, p, base) of the terms that occur.  The pairs are as many as the result has rows."""
    few = groups.count() <= BROADCAST_ROWS
    own = groups.select("lang", F.col("source").alias("a"), F.col("base").alias("a_base"), "terms")
    none = diverges("a_base", "b_base")
    parts = [_with_others(own, groups, few).select("lang", "a", "b", F.expr(f"terms * {none}").alias("value"))]
    # the terms of one source, by how many have a given p
    hist = saved(present.groupBy("lang", "source", "p", "base").agg(F.count("*").alias("m")).select("lang", F.col("source").alias("a"), "p", F.col("base").alias("a_base"), "m"))
    met = _with_others(hist, groups, few)
    both_ways = F.expr(f"array(struct(a, b, m * ({diverges('p', 'b_base')} - {none}) AS value), struct(b AS a, a AS b, m * ({diverges('b_base', 'p')} - {diverges('b_base', 'a_base')}) AS value))")
    parts.append(met.select("lang", F.explode(both_ways).alias("x")).select("lang", "x.*"))
    # the terms of both
    side = lambda s: present.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"{s}_p"), F.col("base").alias(f"{s}_base"))
    both = side("a").join(side("b"), ["lang", "term"]).where("a < b")

    def corrected(a: str, b: str) -> str:
        return f"{diverges(f'{a}_p', f'{b}_p')} - {diverges(f'{a}_p', f'{b}_base')} - {diverges(f'{a}_base', f'{b}_p')} + {diverges(f'{a}_base', f'{b}_base')}"

    both = both.groupBy("lang", "a", "b").agg(F.sum(F.expr(corrected("a", "b"))).alias("ab"), F.sum(F.expr(corrected("b", "a"))).alias("ba"))
    parts.append(both.select("lang", F.explode(F.expr("array(struct(a, b, ab AS value), struct(b AS a, a AS b, ba AS value))")).alias("x")).select("lang", "x.*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, ranks: int = RANKS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language, part `term` the terms that the source uses more than its language, of the first `ranks` ranks.

    Null texts, languages and sources are ''.  A repeated row counts as a document of its own.  A group without kept terms
    has its pairs; in a language without kept terms they are 0.  Ties go by the item's bytes.  An empty table gives no
    rows.  Other columns are left out."""
    kept, groups = kept_terms(term_counts(docs, text_col, lang_col, source_col), least_docs)
    key = F.struct("lang", "source").alias("g")
    stats = saved(groups.select(key, "base", (F.col("total") + F.col("terms")).alias("size"), (F.col("lang_total") + F.col("terms")).alias("lang_size")))
    present = joined(kept.select("*", key), stats, "g")
    present = saved(present.select("lang", "source", "term", "base", share("n", "size").alias("p"), share("of_lang", "lang_size").alias("q")))
    pairs = source_pairs(present, groups)
    order = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value", F.row_number().over(order).alias("rank"))
    more = present.where("p > q").select("lang", "source", "term", F.expr(diverges("p", "q")).alias("value"))
    terms = ranked(more, ["lang", "source"], "value", "term", ranks)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op11_source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank over all documents: all pairs of a language's sources, and 200 terms a group."""
    return audit(docs)


OP11_SQL = r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents
), w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (SELECT lang, term, count(*) AS of_lang FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), v AS (SELECT lang, count(*) AS terms, CAST(sum(of_lang) AS HUGEINT) AS lang_total FROM k GROUP BY lang
), c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term
), g AS (SELECT DISTINCT lang, source FROM d
), s AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (s.total + v.terms) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (k.of_lang + 1)) // (v.lang_total + v.terms) AS q
  FROM s JOIN v ON s.lang = v.lang JOIN k ON s.lang = k.lang LEFT JOIN c ON s.lang = c.lang AND s.source = c.source AND k.term = c.term
), x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
