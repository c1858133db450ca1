"""Radix-select ranking: the first k rows of each group by a whole number, ties by text, without sorting a group.

The value's bits are looked at from the top, BITS at a time: tasks count the rows of each group that have a given digit
after the digits found so far, a running sum from the top finds the digit where the group's kth value lies, and all that
is below goes.  After the last digit the kth value is known.  Of the rows that tie with it, as many as there is room for
are found by the bytes of their text in the same way, behind what all ties of the group begin with.  What is left, k rows
and FEW ties a group at most, is numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.frames import joined, saved

#: Bits a digit; values have VALUE_BITS.
BITS, VALUE_BITS = 16, 63
#: Bytes of the text a digit, and the ties of a group that are numbered with the rest once no more are left.
BYTES, FEW = 2, 4096


def _edge(rows: DataFrame, digit: Column, *, falling: bool) -> DataFrame:
    """(g, edge, room) of rows (g, room, ...): the digit at which the rows of a group, in the order of their digits, use up its room, and the room left for rows with that digit.  A group with room for all has no row."""
    counts = rows.groupBy("g", digit.alias("digit")).agg(F.count("*").alias("n"), F.max("room").alias("room"))
    order = F.desc("digit") if falling else F.asc("digit")
    upto = F.sum("n").over(Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto)
    return counts.where((F.col("upto") >= F.col("room")) & (F.col("upto") - F.col("n") < F.col("room"))).select("g", F.col("digit").alias("edge"), (F.col("room") - F.col("upto") + F.col("n")).alias("room"))


def thresholds(values: DataFrame, k: int) -> DataFrame:
    """(g, least, room) of saved rows (g, value): the kth largest value of each group, and how many of the rows with that value are among the first k.  A group of fewer than k rows has no row.  Values are 0 or more."""
    mask = (1 << BITS) - 1
    rows, state = values.withColumn("room", F.lit(k).cast("long")), None
    for shift in range((VALUE_BITS - 1) // BITS * BITS, -1, -BITS):
        edge = _edge(rows, F.shiftright("value", shift).bitwiseAND(F.lit(mask)), falling=True).select("g", F.shiftleft("edge", shift).alias("bits"), "room")
        if state is not None:
            edge = edge.join(state.select("g", "least"), "g").select("g", (F.col("least") + F.col("bits")).alias("bits"), "room")
        state = saved(edge.withColumnRenamed("bits", "least"))
        if shift:
            rows = joined(values, state, "g").where(F.shiftright("value", shift) == F.shiftright("least", shift)).select("g", "value", "room")
    return state


def _shared_bytes(a: str, b: str) -> Column:
    """Bytes that two binary columns have in common at the start."""
    least = f"least(octet_length({a}), octet_length({b}))"
    differ = f"array_position(transform(sequence(1, {least}), i -> substring({a}, i, 1) = substring({b}, i, 1)), false)"
    return F.expr(f"CAST(CASE WHEN {least} = 0 THEN 0 WHEN {differ} = 0 THEN {least} ELSE {differ} - 1 END AS INT)")


def first_ties(ties: DataFrame, few: int = FEW) -> DataFrame:
    """Of saved rows (g, item binary, room), those that can be among the first `room` items of their group: `room` + `few` at most, if the items of a group differ."""
    out = None
    while True:
        sizes = saved(ties.groupBy("g").agg(F.count("*").alias("n"), F.max("room").alias("room"), F.min("item").alias("low"), F.max("item").alias("high")))
        over = (F.col("n") > few) & (F.col("n") > F.col("room")) & (F.col("low") != F.col("high"))
        more = sizes.where(over).select("g", _shared_bytes("low", "high").alias("at"))
        if not more.limit(1).count():
            return ties if out is None else out.unionByName(ties)
        marked = saved(joined(ties, saved(more), "g", "left").withColumn("digit", F.expr(f"substring(item, at + 1, {BYTES})")))
        split = marked.where(F.col("at").isNotNull())
        met = joined(split, saved(_edge(split, F.col("digit"), falling=False)).withColumnRenamed("room", "left"), "g")
        met = saved(met.where(F.col("digit") <= F.col("edge")).select("g", "item", F.when(F.col("digit") < F.col("edge"), F.col("room")).otherwise(F.col("left")).alias("room"), (F.col("digit") == F.col("edge")).alias("open")))
        done = marked.where(F.col("at").isNull()).select("g", "item", "room").unionByName(met.where("NOT open").drop("open"))
        out = done if out is None else out.unionByName(done)
        ties = met.where("open").drop("open")


def ranked(rows: DataFrame, groups: list[str], value: str, item: str, k: int, few: int = FEW) -> DataFrame:
    """(*groups, item, value, rank): the rows of the first k ranks of each group, by falling value and then by the item's UTF-8 bytes.

    Items of a group differ and aren't null; null groups are groups.  Rows without a value have no rank; a value is a
    whole number of 0 or more.  A group of fewer rows has them all; an empty table has none."""
    rows = saved(rows.where(F.col(value).isNotNull()).select(F.struct(*groups).alias("g"), F.col(value).cast("long").alias("value"), F.col(item).cast("string").alias("item")))
    least = thresholds(rows.select("g", "value"), k)
    met = joined(rows, least, "g", "left")
    above = met.where(F.col("least").isNull() | (F.col("value") > F.col("least"))).select("g", "value", "item")
    ties = saved(met.where(F.col("value") == F.col("least")).select("g", F.col("item").cast("binary").alias("item"), "room"))
    tied = joined(first_ties(ties, few).select("g", F.col("item").cast("string").alias("item")), least.select("g", F.col("least").alias("value")), "g").select("g", "value", "item")
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item"))
    return above.unionByName(tied).withColumn("rank", rank).where(F.col("rank") <= k).select("g.*", "item", "value", "rank")
