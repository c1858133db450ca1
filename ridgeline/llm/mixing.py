"""Mixing sources to target weights by Pareto order sampling.

Sizes are words.  Each source has a target number of words; targets over `cap` times the source's size stop there and
the excess goes to the others by weight, which is a water level over the sources ordered by cap * size / weight.
A document's expected copies go by its weight, `cap` at most: a water level over the weights of a source gives the factor
at which all expected words make the target.  Unless weights are given, a document weighs the bit length of its size, so
that longer ones are likelier.  Whole copies are certain; the fraction is the inclusion probability p of one more.  With
u uniform from a hash of the id and the text, documents are ranked by their random odds u / (1 - u) divided by their inclusion odds p / (1 - p), and taken in that order until
the source's words are full, so the sample has a fixed size.  The running sum that finds the end is taken over bins of
the rank first and within the one bin where it falls second, so no source is gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.frames import map_arrow, saved
from ridgeline.llm.wordhash import _SPACE, utf8_parts

WEIGHTS = (5, 2, 1)
#: The largest weight of a document; with steps of a tenth, a source has a bounded number of weights.
MOST_WEIGHT = 1000.0
#: Sources whose table is broadcast; with more, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8_parts(batch.column(batch.num_columns - 1))
        n = np.empty(batch.num_rows, dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = min(batch.num_rows, max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 20), side="right")) - 1))
            own = offsets[a : b + 1] - offsets[a]
            word = ~_SPACE[data[offsets[a] : offsets[b]]]
            first = word.copy()
            first[1:] &= ~word[:-1]
            inner = own[:-1][own[:-1] < len(word)]
            first[inner] = word[inner]
            sums = np.concatenate(([0], np.cumsum(first)))
            n[a:b] = sums[own[1:]] - sums[own[:-1]]
            a = b
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=[*batch.schema.names[:-1], "size"])


def uniform(doc_id: Column, text: Column, seed: str = "") -> Column:
    """A number in (0, 1) from 52 bits of the md5 of the id and the text's md5; a null id or text counts as empty text."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), own).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, share: float, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size, target): one row per source of (source, size)."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    sums = sums.select("source", "source_size", w.alias("w")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every, before = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("*", F.sum("source_size").over(every).alias("total"), F.sum("w").over(every).alias("all_w"), F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("most_before"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"))
    sums = sums.withColumn("level", (F.col("total") * F.lit(float(share)) - F.col("most_before")) / (F.col("all_w") - F.col("w_before")))
    sums = sums.withColumn("full", F.col("level") * F.col("w") >= F.col("most"))
    rest = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return sums.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(rest * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, cap: float = 2.0, weight_col: str | None = None, seed: str = "") -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies (times the mix takes it) and taken (copies * size).

    A null text has size 0; a null source is a source of its own, ordered last.  Rows equal in id and text draw the same
    number and are interchangeable.  With `weight_col`, expected copies within a source follow that weight, rounded to
    tenths and at most MOST_WEIGHT (null or below 0: 0, never taken).  An empty table gives no rows.  Extra columns are
    left out."""
    spark = docs.sparkSession
    given = F.round(F.least(F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(MOST_WEIGHT)), 1) if weight_col else F.lit(None).cast("double")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), given.alias("weight"), uniform(F.col(id_col), text, seed).alias("u"), text.alias("text"))
    sizes = map_arrow(rows, _word_counts, "doc_id long, source string, weight double, u double, size long")
    sizes = saved(sizes if weight_col else sizes.withColumn("weight", F.length(F.bin(F.greatest("size", F.lit(1)))).cast("double")))
    targets = saved(source_targets(sizes, share, weights, cap))
    n_sources = targets.count()

    def with_source(left: DataFrame, right: DataFrame, *on: Column) -> DataFrame:
        return left.join(F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right, [left["source"].eqNullSafe(right["s"]), *on], "left").drop("s")

    # the water level over the weights of each source: the heaviest stop at cap copies first
    words = sizes.where((F.col("weight") > 0) & (F.col("size") > 0)).groupBy("source", "weight").agg(F.sum("size").alias("words"))
    heavier = Window.partitionBy("source").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    levels = with_source(words, targets.select(F.col("source").alias("s"), "target"))
    levels = levels.withColumn("above", F.coalesce(F.sum("words").over(heavier), F.lit(0))).withColumn("weighed", F.sum(F.col("words") * F.col("weight")).over(Window.partitionBy("source")) - F.coalesce(F.sum(F.col("words") * F.col("weight")).over(heavier), F.lit(0.0)))
    levels = levels.withColumn("level", (F.col("target") - F.col("above") * F.lit(float(cap))) / F.col("weighed"))
    levels = saved(levels.groupBy("source").agg(F.max(F.when(F.col("level") * F.col("weight") < F.lit(float(cap)), F.col("level"))).alias("level")))
    sized = with_source(with_source(sizes, targets.withColumnRenamed("source", "s")), levels.withColumnRenamed("source", "s"))
    # without a level below the cap, every document stops at the cap
    expected = F.when(F.col("weight") > 0, F.least(F.lit(float(cap)), F.coalesce(F.col("level") * F.col("weight"), F.lit(float(cap))))).otherwise(F.lit(0.0))
    sized = sized.withColumn("expected", F.greatest(expected, F.lit(0.0))).withColumn("whole", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.col("whole"))
    sized = sized.withColumn("q", (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    sized = sized.withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), F.col("q")))
    # bins of q / (1 + q): as many as the square root of the documents needs, so that neither sum is long
    count = max(1, sizes.count())
    bins = max(256, 4 * math.isqrt(count))
    sized = sized.withColumn("bin", F.least(F.floor(F.col("q") / (1 + F.col("q")) * bins), F.lit(bins - 1)).cast("int"))
    per_source = sized.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    per_bin = sized.where(F.col("q").isNotNull()).groupBy("source", "bin").agg(F.sum("size").alias("words"))
    per_bin = per_bin.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    room = with_source(per_source, targets.select(F.col("source").alias("s"), "target")).select(F.col("source"), (F.col("target") - F.col("certain")).alias("room"))
    per_bin = with_source(per_bin, room.withColumnRenamed("source", "s"))
    edge = saved(per_bin.where((F.col("before") < F.col("room")) & (F.col("before") + F.col("words") >= F.col("room"))).groupBy("source", "room").agg(F.min(F.struct("bin", "before")).alias("m")).select("source", "room", F.col("m.bin").alias("edge_bin"), F.col("m.before").alias("before")))
    sized = with_source(sized, with_source(room, edge.select(F.col("source").alias("s"), "edge_bin", "before")).withColumnRenamed("source", "s"))
    # without an edge, the room holds all that may be taken, or there is none
    on_edge = F.col("bin").isNotNull() & F.col("edge_bin").isNotNull() & (F.col("bin") == F.col("edge_bin"))
    below = F.col("bin").isNotNull() & (F.col("room") > 0) & (F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin")))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("q", "u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    at_edge = sized.where(on_edge).withColumn("one", (F.col("before") + F.coalesce(running, F.lit(0)) + F.col("size") / 2 < F.col("room")).cast("int"))
    rest = sized.where(~on_edge | on_edge.isNull()).withColumn("one", F.coalesce(below, F.lit(False)).cast("int"))
    every = at_edge.unionByName(rest).withColumn("copies", F.col("whole") + F.col("one"))
    return every.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op10_source_mixing(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken; 150% of all words, weights 5, 2, 1, at most 2 times a document; longer documents are likelier."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows; the running sum over a whole source at once.
MIX_CTES = r"""
s AS (
  SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}
), a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source
), b AS (
  SELECT source, source_size, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)) AS w, source_size * 2.0::DOUBLE AS most FROM a
), c AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(most) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM b WINDOW o AS (ORDER BY most / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN level * w >= most THEN most ELSE max(CASE WHEN level * w < most THEN level END) OVER () * w END AS target FROM c
), w AS (
  SELECT s.source, length(bin(greatest(size, 1)))::DOUBLE AS weight, max(target) AS target, CAST(sum(size) AS BIGINT) AS words
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source WHERE size > 0 GROUP BY ALL
), v AS (
  SELECT source, weight, (target - coalesce(sum(words) OVER h, 0)::DOUBLE * 2.0::DOUBLE) / (sum(words::DOUBLE * weight) OVER (PARTITION BY source) - coalesce(sum(words::DOUBLE * weight) OVER h, 0.0::DOUBLE)) AS level
  FROM w WINDOW h AS (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT source, max(CASE WHEN level * weight < 2.0::DOUBLE THEN level END) AS level FROM v GROUP BY source
), e AS (
  SELECT s.*, t.source_size, t.target, greatest(0.0::DOUBLE, least(2.0::DOUBLE, coalesce(l.level * length(bin(greatest(size, 1)))::DOUBLE, 2.0::DOUBLE))) AS expected,
         (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN l ON s.source IS NOT DISTINCT FROM l.source
), f AS (SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS p FROM e
), g AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q, target - CAST(sum(whole * size) OVER (PARTITION BY source) AS BIGINT) AS room FROM f
), mixed AS (
  SELECT *, whole + CASE WHEN q IS NOT NULL AND room > 0 AND coalesce(sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q ASC NULLS LAST, u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 < room THEN 1 ELSE 0 END AS copies FROM g
)
"""
OP10_SQL = "WITH " + MIX_CTES.format(docs="documents") + "SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM mixed"
