"""Bounded samples of labelled rows, and the held-out rule of the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.frames import crc_mod


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is 0 modulo 5; false for a null id."""
    return F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False))


def lowest(ids: DataFrame, rows: int, seed: int) -> list[int]:
    """The `rows` ids (doc_id) of the lowest hashes.

    A bound on the hash, with room to spare, leaves about that many before any task sorts; without it every task would
    send its own lowest."""
    n = ids.count()
    h = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 31))
    near = ids.where(h < int(min(1.0, (1.5 * rows + 100) / max(n, 1)) * (1 << 31)))
    return [r.doc_id for r in near.orderBy(h, "doc_id").limit(rows).collect()]


def sample(labels: DataFrame, label_col: str, value: int, rows: int, id_col: str = "doc_id") -> list[int]:
    """Ids with this label, not held out, `rows` at most, in order of a hash; an id with both labels counts as 1."""
    pool = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    one = pool.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).alias("label")).where(F.col("label") == value)
    return lowest(one.select("doc_id"), rows, 0)


def share(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> float | None:
    """Mean label over the ids that aren't held out; null without any."""
    pool = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    return pool.groupBy(id_col).agg(F.max(label_col).alias("label")).agg(F.avg("label")).first()[0]
