"""Access-log lines: parsing, kinds of request, quiet time before each, stage durations and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import scalar as S
from ridgeline.plans.storage import saved

#: The form of a request in the log, and the stages that a traced one names.
LINE = r"^(GET|POST|PUT|DELETE) (\S+) (\d{3})( ABORTED-BY-CLIENT)? (\d+)ms"
STAGES = ("network", "rideOrder", "extents", "growth", "lines", "respond", "deliver", "toClose")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with message and timestamp."""
    return spark.read.schema("message string, timestamp timestamp, level string").json(path)


def parse(log: DataFrame) -> DataFrame:
    """Request lines (message, timestamp) by parts; other lines go."""
    part = lambda i: F.regexp_extract("message", LINE, i)
    number = lambda name: F.nullif(F.regexp_extract("message", rf"\b{name}=(\d+)\b", 1), F.lit("")).cast("long")
    rows = log.where(F.coalesce(F.col("message"), F.lit("")).rlike(LINE))
    url = part(2)
    rows = rows.withColumns({"method": part(1), "url": url, "path": F.regexp_extract(url, r"^([^?#]*)", 1), "query": F.regexp_extract(url, r"\?([^#]*)", 1), "status": part(3).cast("int"), "aborted": part(4) != "", "ms": part(5).cast("long")})
    traced = F.col("message").rlike(r"\bpool=\d+/\d+/\d+\b") & number("opened").isNotNull()
    stages = F.transform(F.regexp_extract_all("message", F.lit(r"\b(\w+=\d+-\d+)\b"), 1), lambda s: F.struct(F.split(s, "=")[0].alias("name"), F.split(F.split(s, "=")[1], "-")[0].cast("long").alias("from_ms"), F.split(F.split(s, "=")[1], "-")[1].cast("long").alias("to_ms")))
    return rows.withColumns({"opened": F.when(traced, number("opened")), "finish_ms": F.when(traced, number("finish")), "stages": F.when(traced, stages)})


def parameter(name: str) -> Column:
    """Null where the query has no such parameter."""
    return F.when(F.col("query").rlike(rf"(^|&){name}="), F.regexp_extract("query", rf"(?:^|&){name}=([^&]*)", 1))


def with_kind(rows: DataFrame) -> DataFrame:
    width = parameter("maxLon").cast("double") - parameter("minLon").cast("double")
    path = F.when(parameter("toSegmentId").isNull(), "path:from").when(parameter("grow") == "false", "path:connect-only").otherwise("path:connect+grow")
    kind = F.when(F.col("path") == "/segments", F.when(width > 100, "tiles:world").otherwise("tiles:box")).when(F.col("path") != "/segments/path", F.col("path")).otherwise(F.concat(path, F.when(parameter("avoid").isNotNull(), "+avoid").otherwise("")))
    return rows.withColumn("kind", kind)


def with_quiet(rows: DataFrame, slots: Column | None = None) -> DataFrame:
    """Seconds without a request before each one.  `slots` deals the log into stretches of time that are ordered on their own (the first request of each has none); without it, the log is dealt into ranges of time, and the first request of each follows the last one of the ranges before it."""
    quiet = lambda last: (S.micros(F.col("timestamp")) - F.col("ms") * 1000 - S.micros(last)) / 1e6
    if slots is not None:
        return rows.withColumn("quiet_s", quiet(F.lag("timestamp").over(Window.partitionBy(slots).orderBy("timestamp", "message"))))
    ranged = saved(rows.repartitionByRange("timestamp", "message").withColumn("_part", F.spark_partition_id()))
    ends = ranged.groupBy("_part").agg(F.max("timestamp").alias("_end"))  # a row for each partition
    ends = ends.select("_part", F.max("_end").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    last = F.coalesce(F.lag("timestamp").over(Window.partitionBy("_part").orderBy("timestamp", "message")), F.col("_before"))
    return ranged.join(F.broadcast(ends), "_part").withColumn("quiet_s", quiet(last)).drop("_part", "_before")


def stage_durations(rows: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, stage, duration_ms): each traced stage, with deliver and toClose after it responded."""
    respond = F.get(F.filter("stages", lambda s: s["name"] == "respond"), 0)
    late = F.when(respond.isNotNull() & F.col("finish_ms").isNotNull(), F.array(F.struct(F.lit("deliver").alias("stage"), (F.col("finish_ms") - respond["to_ms"]).alias("duration_ms")), F.struct(F.lit("toClose").alias("stage"), (F.col("ms") - F.col("finish_ms")).alias("duration_ms"))))
    own = F.transform("stages", lambda s: F.struct(s["name"].alias("stage"), (s["to_ms"] - s["from_ms"]).alias("duration_ms")))
    every = F.concat(own, F.coalesce(late, F.array().cast("array<struct<stage:string,duration_ms:bigint>>")))
    return rows.where("stages IS NOT NULL").select(*keep, F.inline(every))


def quantile_report(rows: DataFrame, key: str, value: str = "ms") -> DataFrame:
    """n, median, p90 (by the rank floor(q (n - 1) + 0.5)), max and min of each kind; ranks over counts of equal values."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    at = lambda q: F.min(F.when(F.col("upto") > S.half_up((F.col("n") - 1) * F.lit(q)), F.col(value)))
    return ranked.groupBy(key, "n").agg(at(0.5).alias("median"), at(0.9).alias("p90"), F.max(value).alias("max"), F.min(value).alias("min"))


def server_timing(header: Column) -> Column:
    """name -> milliseconds of a Server-Timing header."""
    parts = F.regexp_extract_all(header, F.lit(r"(\w+;dur=[0-9.]+)"), 1)
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.split(p, ";dur=")[0], F.split(p, ";dur=")[1].cast("double"))))


def within_budget(reports: DataFrame, warm_ms: float = 1000, quiet_ms: float = 1200) -> DataFrame:
    """Whether a report (kind, median, max) keeps the latency budget: the median where warm, every request after quiet."""
    return reports.withColumn("ok", F.when(F.col("kind") == "warm", F.col("median") <= warm_ms).otherwise(F.col("max") <= quiet_ms))
