"""Snapshots of tables with a manifest of their measures, and the drill that reads one back and compares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.relational import fingerprint


def measures(tables: dict[str, DataFrame], ids: dict[str, str] | None = None) -> DataFrame:
    """Rows, fingerprint, schema and greatest id (its sequence) of each table."""
    out = None
    for name, t in sorted(tables.items()):
        key = (ids or {}).get(name)
        last = t.agg(F.max(key).cast("long").alias("last_id")) if key else t.limit(1).agg(F.lit(None).cast("long").alias("last_id"))
        one = fingerprint(t).crossJoin(last).select(F.lit(name).alias("table_name"), "*", F.lit(t.schema.simpleString()).alias("schema"))
        out = one if out is None else out.unionByName(one)
    return out


def write_snapshot(tables: dict[str, DataFrame], path: str, ids: dict[str, str] | None = None) -> None:
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    measures({n: spark.read.parquet(f"{path}/{n}") for n in tables}, ids).write.mode("overwrite").parquet(f"{path}/manifest")


def compare(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Tables whose measures differ: missing, unexpected, schema, rows, content or sequence."""
    a, b = expected.alias("a"), found.alias("b")
    rows = a.join(b, F.col("a.table_name") == F.col("b.table_name"), "full_outer")
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    problem = F.when(F.col("b.table_name").isNull(), "missing").when(F.col("a.table_name").isNull(), "unexpected").when(~same("schema"), "schema").when(~same("row_count"), "rows").when(~(same("xor_hash") & same("sum_hash")), "content").when(~same("last_id"), "sequence")
    return rows.select(F.coalesce("a.table_name", "b.table_name").alias("table_name"), problem.alias("problem")).where("problem IS NOT NULL")


def restore_drill(spark: SparkSession, path: str, ids: dict[str, str] | None = None) -> DataFrame:
    """Problems of a snapshot read back against its manifest; none for a sound one."""
    manifest = spark.read.parquet(f"{path}/manifest")
    names = [r.table_name for r in manifest.select("table_name").collect()]
    return compare(manifest, measures({n: spark.read.parquet(f"{path}/{n}") for n in names}, ids))


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with their side."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def migrated(table: DataFrame, target: str) -> DataFrame:
    """The table with the target schema's columns: missing ones null, others cast.  Columns that the target lacks are an error."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(target)
    if extra := set(table.columns) - set(schema.names):
        raise TypeError(f"the target has no {sorted(extra)}")
    return table.select(*[(F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
