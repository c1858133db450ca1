"""Selections of paths: joining, cutting and reading paths of pieces and spans, and their responses.

pieces: path_id, i, segment_id, direction, from_m, to_m, at_m, length_m, source, street_name, rides, last_us;
spans: path_id, i, piece, at_m, length_m, slope_pct, rise_m, height_m, color, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import NO_DATA_COLOR, SLOPE_BANDS
from ridgeline.functions import scalar as S
from ridgeline.functions.geo import is_finite


def ends(spans: DataFrame) -> DataFrame:
    """Length, pieces, and height at the end of each path."""
    return spans.groupBy("path_id").agg(F.max(F.col("at_m") + F.col("length_m")).alias("whole_m"), (F.max("piece") + 1).alias("n_pieces"), F.max_by(F.col("height_m") + F.col("rise_m"), F.col("i")).alias("end_m"), F.max("i").alias("last_i"))


def joined(first: DataFrame, second: DataFrame) -> DataFrame:
    """Spans of the second path set after those of the first with the same path_id: metres, pieces, heights and order go on."""
    e = ends(first)
    after = second.join(e, "path_id").select("path_id", (F.col("i") + F.col("last_i") + 1).alias("i"), (F.col("piece") + F.col("n_pieces")).alias("piece"), (F.col("at_m") + F.col("whole_m")).alias("at_m"), "length_m", "slope_pct", "rise_m", (F.col("height_m") + F.col("end_m")).alias("height_m"), "color", "source")
    return first.select(after.columns).unionByName(after).unionByName(second.join(e.select("path_id"), "path_id", "left_anti").select(after.columns))


def appended(selection: DataFrame, response: DataFrame) -> DataFrame:
    return joined(selection, response)


def prepended(selection: DataFrame, response: DataFrame) -> DataFrame:
    return joined(response, selection)


def _merged(rows: DataFrame, points: DataFrame, at: Column, what: Column, *, ahead: bool) -> DataFrame:
    """points (path_id, m, x) with the row of its path (as the struct `what`) that is nearest in place behind x, or ahead of it, in one ordered pass; x itself counts.

    Rows of one place go by i: the last of them is behind, the first ahead."""
    own = rows.select("path_id", at.alias("x"), F.col("i").cast("long").alias("i"), F.lit(None).cast("double").alias("m"), what.alias("s"))
    asked = points.select("path_id", "x", F.lit(-1 if ahead else 2**62).cast("long").alias("i"), F.col("m").cast("double").alias("m"))
    every = own.unionByName(asked, allowMissingColumns=True)
    # from the far end where x looks ahead, since a frame that ends with the partition is computed anew for each row
    order = [F.desc("x"), F.desc("i")] if ahead else ["x", "i"]
    near = F.last("s", ignorenulls=True).over(Window.partitionBy("path_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return every.withColumn("near", near).where("m IS NOT NULL AND near IS NOT NULL").select("path_id", "m", "x", F.col("near").alias("s"))


def pieces_at(pieces: DataFrame, points: DataFrame) -> DataFrame:
    """The piece under each metre (path_id, m): the first that ends at or after it, else the last; with the metre of travel on its line."""
    last = F.max("i").over(Window.partitionBy("path_id"))
    rows = pieces.withColumn("x", F.when(F.col("i") == last, F.lit(float("inf"))).otherwise(F.col("at_m") + F.col("length_m")))
    best = _merged(rows, points.select("path_id", "m", F.col("m").cast("double").alias("x")).distinct(), F.col("x"), F.struct("i", "segment_id", "direction", "from_m", "at_m", "length_m"), ahead=True)
    into = S.clamp(F.col("m") - F.col("s.at_m"), 0, float("inf"))
    return best.select("path_id", "m", "s.i", "s.segment_id", "s.direction", (F.col("s.from_m") + F.least(into, F.col("s.length_m"))).alias("on_line_m"))


def profile_at(spans: DataFrame, points: DataFrame) -> DataFrame:
    """Height and grade under each metre (path_id, m): in the last span that starts at or before it."""
    whole = spans.groupBy("path_id").agg(F.max(F.col("at_m") + F.col("length_m")).alias("whole_m"))
    rows = points.where(is_finite(F.col("m").cast("double"))).join(whole, "path_id").select("path_id", "m", F.greatest(F.lit(0.0), F.least("whole_m", "m")).alias("x")).distinct()
    best = _merged(spans, rows, F.when(F.col("i") == 0, F.lit(float("-inf"))).otherwise(F.col("at_m")), F.struct("at_m", "length_m", "height_m", "rise_m", "slope_pct", "source"), ahead=False)
    into = F.greatest(F.lit(0.0), F.least(F.col("s.length_m"), F.col("x") - F.col("s.at_m")))
    height = F.col("s.height_m") + F.when(F.col("s.length_m") > 0, F.col("s.rise_m") * into / F.col("s.length_m")).otherwise(0.0)
    return best.select("path_id", "m", F.col("x").alias("at_m"), height.alias("height_m"), F.when(F.col("s.source") != "none", F.col("s.slope_pct")).alias("grade_pct"))


def readouts(points: DataFrame) -> DataFrame:
    """The texts under a cursor."""
    return points.select("path_id", "m", F.concat(S.format_distance(F.col("at_m")), F.lit(" in")).alias("distance"), S.format_rise(F.col("height_m")).alias("height"), F.when(F.col("grade_pct").isNull(), "no data").otherwise(S.format_grade(F.col("grade_pct"))).alias("grade"))


def scrub_metres(x: Column, band_from: Column, band_to: Column, length_m: Column) -> Column:
    """The metre under a screen position; 0 where the band or the path is empty."""
    ok = (band_to > band_from) & (length_m > 0) & is_finite(x)
    return F.when(ok, S.clamp((x - band_from) / (band_to - band_from), 0, 1) * length_m).otherwise(0.0)


def rides_of(pieces: DataFrame) -> DataFrame:
    """Least and most rides behind a path's pieces with data, and its last ride."""
    known = F.when(F.col("source") != "none", F.col("rides"))
    return pieces.groupBy("path_id").agg(F.min(known).alias("rides_min"), F.max(known).alias("rides_max"), F.max("last_us").alias("last_us"))


def segment_ids(pieces: DataFrame) -> DataFrame:
    """The distinct segments of each path in order."""
    firsts = pieces.groupBy("path_id", "segment_id").agg(F.min("i").alias("i"))
    return firsts.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "segment_id"))), lambda s: s["segment_id"]).alias("segment_ids"))


def connection_end(pieces: DataFrame, targets: DataFrame, near_m: float = 0.01) -> DataFrame:
    """Where along its path each target (path_id, segment_id, direction, on_line_m) lies: in the first piece that holds it."""
    rows = targets.join(pieces, ["path_id", "segment_id", "direction"]).where((F.col("on_line_m") >= F.col("from_m") - near_m) & (F.col("on_line_m") <= F.col("to_m") + near_m))
    return rows.groupBy("path_id", "segment_id", "direction", "on_line_m").agg(F.min(F.struct("i", (F.col("at_m") + F.col("on_line_m") - F.col("from_m")).alias("m"))).alias("p")).select("path_id", "segment_id", "direction", "on_line_m", F.col("p.m").alias("end_m"))


def piece_features(pieces: DataFrame, merged: DataFrame) -> DataFrame:
    """Coloured stretches of each piece (merged_spans()); a piece without spans is one stretch without data."""
    own = pieces.where("length_m > 0").select("path_id", F.col("i").alias("piece"), F.col("at_m").alias("p_at"), F.col("length_m").alias("p_len"))
    rows = own.join(merged, ["path_id", "piece"], "left")
    return rows.select(
        "path_id", "piece", F.coalesce("start_m", "p_at").alias("start_m"), F.coalesce("end_m", F.col("p_at") + F.col("p_len")).alias("end_m"), F.coalesce("color", F.lit(NO_DATA_COLOR)).alias("color"), F.coalesce("no_data", F.lit(True)).alias("no_data"),
        ((F.coalesce("start_m", "p_at") - F.col("p_at")) / F.col("p_len")).alias("from_fraction"), ((F.coalesce("end_m", F.col("p_at") + F.col("p_len")) - F.col("p_at")) / F.col("p_len")).alias("to_fraction"),
    )


def growing(features: DataFrame, grown: DataFrame) -> DataFrame:
    """Of each path (grown_m), the stretch that is being drawn, and the part of it that is."""
    rows = features.join(grown, "path_id").where("start_m < grown_m AND grown_m < end_m")
    w = Window.partitionBy("path_id").orderBy("start_m")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").withColumn("part", (F.col("grown_m") - F.col("start_m")) / (F.col("end_m") - F.col("start_m"))).drop("r")


def bounds(lines: DataFrame) -> DataFrame:
    """Bounding box of the lines (path_id, line) of each path."""
    at = lambda k: F.transform("line", lambda p: p[k])
    return lines.groupBy("path_id").agg(F.min(F.array_min(at(0))).alias("min_lon"), F.min(F.array_min(at(1))).alias("min_lat"), F.max(F.array_max(at(0))).alias("max_lon"), F.max(F.array_max(at(1))).alias("max_lat"))


def responses(pieces: DataFrame, spans: DataFrame, stops: DataFrame) -> DataFrame:
    """One nested row a path: pieces and spans in order, why it stopped (path_id, reason, ahead_m, branches), and the bands."""
    p = pieces.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("i", *[c for c in pieces.columns if c not in ("path_id", "i")]))).alias("pieces"), F.max(F.col("at_m") + F.col("length_m")).alias("length_m"))
    s = spans.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("i", *[c for c in spans.columns if c not in ("path_id", "i")]))).alias("spans"))
    bands = F.array(*[F.struct(F.lit(m).cast("double").alias("max_slope_pct"), F.lit(c).alias("color")) for m, c in SLOPE_BANDS])
    rows = stops.join(p, "path_id", "left").join(s, "path_id", "left")
    length = F.coalesce("length_m", F.lit(0.0))
    return rows.select("path_id", "pieces", "spans", length.alias("length_m"), F.struct("reason", length.alias("at_m"), "ahead_m", "branches").alias("stop"), bands.alias("bands"))


def previews(lines: DataFrame, stops: DataFrame, least_m: float = 1.0) -> DataFrame:
    """Spans of the stand-in selection from where each line is pressed to its drawn end, as the map colours it.

    lines: path_id, direction, geometry_m, pressed_m (both along the geometry, which runs forward); stops: path_id, i,
    fraction, color, each up to the next one, the last up to 1.  A line without stops or with less than `least_m` ahead
    has no preview; one whose stops leave nothing ahead is one span without data."""
    w = Window.partitionBy("path_id").orderBy("i")
    runs = stops.select("path_id", "color", F.col("fraction").alias("a"), F.lead("fraction", 1, 1.0).over(w).alias("b")).where("b > a")
    start = F.when(F.col("direction") == "forward", F.col("pressed_m") / F.col("geometry_m")).otherwise(1 - F.col("pressed_m") / F.col("geometry_m"))
    held = lines.where("geometry_m > 0").withColumn("start", start).withColumn("ahead_m", (1 - F.col("start")) * F.col("geometry_m")).where(F.col("ahead_m") >= least_m)
    held = held.join(stops.select("path_id").distinct(), "path_id", "left_semi")
    forward = F.col("direction") == "forward"
    drawn = held.join(runs, "path_id").select("path_id", "geometry_m", "start", "color", F.when(forward, F.col("a")).otherwise(1 - F.col("b")).alias("a"), F.when(forward, F.col("b")).otherwise(1 - F.col("a")).alias("b")).where("b > start")
    begin = F.greatest("a", "start")
    drawn = drawn.select("path_id", ((begin - F.col("start")) * F.col("geometry_m")).alias("at_m"), ((F.col("b") - begin) * F.col("geometry_m")).alias("length_m"), "color", F.lit("line").alias("source"))
    rows = held.select("path_id", "ahead_m").join(drawn, "path_id", "left")
    return rows.select("path_id", F.coalesce("at_m", F.lit(0.0)).alias("at_m"), F.coalesce("length_m", "ahead_m").alias("length_m"), F.coalesce("color", F.lit(NO_DATA_COLOR)).alias("color"), F.coalesce("source", F.lit("none")).alias("source"))


def problems(pieces: DataFrame, spans: DataFrame, near_m: float = 0.01) -> DataFrame:
    """(path_id, problem, n): where selections break what holds for every sound one.

    tiles: a piece that doesn't begin where the pieces before it end; spans: a piece that its spans don't fill; heights: a
    span that doesn't end at the next one's height; card: a path whose climb less descent isn't its rise from end to end."""
    w = Window.partitionBy("path_id").orderBy("i")
    before = F.coalesce(F.sum("length_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    tiles = pieces.withColumn("off", F.abs(F.col("at_m") - before)).where(F.col("off") > near_m).select("path_id", F.lit("tiles").alias("problem"))
    filled = spans.groupBy("path_id", "piece").agg(F.sum("length_m").alias("filled_m"))
    empty = pieces.select("path_id", F.col("i").alias("piece"), "length_m").join(filled, ["path_id", "piece"], "left").where(F.abs(F.col("length_m") - F.coalesce("filled_m", F.lit(0.0))) > near_m)
    steps = spans.withColumn("step", F.lead("height_m").over(w) - F.col("height_m") - F.col("rise_m")).where(F.abs("step") > near_m)
    rise = spans.groupBy("path_id").agg(F.sum("rise_m").alias("net_m"), F.min_by("height_m", "i").alias("a"), F.max_by(F.col("height_m") + F.col("rise_m"), F.col("i")).alias("b"))
    out = tiles.unionByName(empty.select("path_id", F.lit("spans").alias("problem"))).unionByName(steps.select("path_id", F.lit("heights").alias("problem")))
    out = out.unionByName(rise.where(F.abs(F.col("b") - F.col("a") - F.col("net_m")) > near_m).select("path_id", F.lit("card").alias("problem")))
    return out.groupBy("path_id", "problem").agg(F.count("*").alias("n"))
