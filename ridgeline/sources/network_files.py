"""Reading map extracts and writing networks: nodes and ways from a JSON extract, GeoJSON features, keys of a network file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "type string, id long, lon double, lat double, nodes array<long>, tags map<string,string>"


def read_extract(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ways, nodes) of an extract {"elements": [...]} (or of many such files): way_id, tags, nodes; node_id, lon, lat."""
    raw = spark.read.schema(f"elements array<struct<{', '.join(c.replace(' ', ':', 1) for c in ELEMENT.split(', '))}>>").json(path, multiLine=True)
    every = raw.select(F.explode("elements").alias("e")).select("e.*")
    ways = every.where("type = 'way' AND tags['highway'] IS NOT NULL").select(F.col("id").alias("way_id"), "tags", F.coalesce("nodes", F.array().cast("array<long>")).alias("nodes"))
    return ways, every.where("type = 'node'").select(F.col("id").alias("node_id"), "lon", "lat")


def features(segments: DataFrame) -> DataFrame:
    """One GeoJSON feature text for each segment (line: array of [lon, lat]); every other column becomes a property."""
    properties = [c for c in segments.columns if c != "line"]
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates"))
    return segments.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def write_features(segments: DataFrame, path: str) -> None:
    """A file of one feature a line in each partition; no task gathers the collection."""
    features(segments).write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Segments from feature lines; `properties` is their DDL."""
    kind = f"geometry struct<type:string,coordinates:array<array<double>>>, properties struct<{', '.join(c.replace(' ', ':', 1) for c in properties.split(', '))}>"
    rows = spark.read.schema(kind).json(path)
    return rows.select("properties.*", F.col("geometry.coordinates").alias("line"))


def with_box(segments: DataFrame) -> DataFrame:
    """Segments with their first and last point and bounding box, which scans can be pruned by."""
    at = lambda k: F.transform("line", lambda p: p[k])
    return segments.withColumns({
        "lon0": F.col("line")[0][0], "lat0": F.col("line")[0][1], "lon1": F.element_at("line", -1)[0], "lat1": F.element_at("line", -1)[1],
        "minx": F.array_min(at(0)), "miny": F.array_min(at(1)), "maxx": F.array_max(at(0)), "maxy": F.array_max(at(1)),
    })


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_responses(rows: DataFrame, path: str) -> None:
    """Nested rows as JSON text."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
