"""Operators over ordered sequences that windows can express."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import DEFAULT, EngineConfig
from ridgeline.functions import scalar as S
from ridgeline.functions.geo import haversine_m, is_finite, offset_m
from ridgeline.operators.model import LINE


def _ride() -> Window:
    return Window.partitionBy("session_id").orderBy("recorded_at")


def derived_headings(samples: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Compass heading from the fix before to the fix after (one-sided at the ends); null where they are too near."""
    w = _ride()
    at = {c: (F.coalesce(F.lag(c).over(w), F.col(c)), F.coalesce(F.lead(c).over(w), F.col(c))) for c in ("lon", "lat")}
    rows = samples.select("*", at["lon"][0].alias("_alon"), at["lat"][0].alias("_alat"), at["lon"][1].alias("_blon"), at["lat"][1].alias("_blat"), F.count(F.lit(1)).over(Window.partitionBy("session_id")).alias("_n"))
    x, y = offset_m(F.col("_alon"), F.col("_alat"), F.col("_blon"), F.col("_blat"))
    far = is_finite(x) & is_finite(y) & (F.sqrt(x * x + y * y) >= config.min_derive_m) & (F.col("_n") > 1)
    return rows.withColumn("derived_deg", F.when(far, (F.degrees(F.atan2(x, y)) + 360) % 360)).drop("_alon", "_alat", "_blon", "_blat", "_n")


def spike_measures(samples: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Cross- and along-track distance of each inner fix from the chord of its neighbours, the implied speed and the span."""
    w = _ride()
    rows = samples.select("session_id", "id", "lon", "lat", "recorded_at", *[f(c).over(w).alias(f"{p}_{c}") for c in ("lon", "lat", "recorded_at") for f, p in ((F.lag, "a"), (F.lead, "b"))])
    rows = rows.where("a_recorded_at IS NOT NULL AND b_recorded_at IS NOT NULL")
    for c in ("lon", "lat", "a_lon", "a_lat", "b_lon", "b_lat"):
        rows = rows.where(is_finite(F.col(c)))
    cx, cy = offset_m(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    sx, sy = offset_m(F.col("a_lon"), F.col("a_lat"), F.col("lon"), F.col("lat"))
    ox, oy = offset_m(F.col("lon"), F.col("lat"), F.col("b_lon"), F.col("b_lat"))
    chord, to, after = F.sqrt(cx * cx + cy * cy), F.sqrt(sx * sx + sy * sy), F.sqrt(ox * ox + oy * oy)
    short = chord < config.min_chord_m
    legs = [S.seconds_between(F.col("a_recorded_at"), F.col("recorded_at")), S.seconds_between(F.col("recorded_at"), F.col("b_recorded_at"))]
    speed = [F.when(t > 0, d / t).otherwise(F.lit(float("inf"))) for d, t in zip((to, after), legs, strict=True)]
    return rows.select(
        "session_id", "id",
        F.when(short, to).otherwise(F.abs(cx * sy - cy * sx) / chord).alias("cross_m"), F.when(short, 0.0).otherwise((cx * sx + cy * sy) / chord).alias("along_m"), chord.alias("chord_m"),
        F.greatest(*speed).alias("implied_mps"), (legs[0] + legs[1]).alias("span_s"),
    )


def spike_census(measures: DataFrame, crosses: list[float], ratios: list[float]) -> DataFrame:
    """Fixes that each pair of thresholds would call a spike.  The grid is a few literals."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("min_cross_m"), F.lit(float(r)).alias("ratio")) for c in crosses for r in ratios]))
    rows = measures.select("*", grid.alias("g")).select("*", "g.*")
    ratio = F.when(F.col("chord_m") <= 0, True).otherwise(F.col("cross_m") / F.col("chord_m") >= F.col("ratio"))
    return rows.groupBy("min_cross_m", "ratio").agg(F.count_if((F.col("cross_m") >= F.col("min_cross_m")) & ratio).alias("spikes"), F.count("*").alias("fixes"))


def transitions(runs: DataFrame) -> DataFrame:
    """Each run's line and the line of the session's next run, in order of start, then match; the last run has none."""
    w = Window.partitionBy("session_id").orderBy("started_at", "match_id")
    rows = runs.select("session_id", *LINE, F.lead("segment_id").over(w).alias("next_segment_id"), F.lead("direction").over(w).alias("next_direction"))
    return rows.where("next_segment_id IS NOT NULL")


def transition_rides(moves: DataFrame) -> DataFrame:
    """Distinct rides from each line to each next one."""
    return moves.groupBy(*LINE, "next_segment_id", "next_direction").agg(F.countDistinct("session_id").alias("rides"))


def stitched(runs: DataFrame, window_s: float = DEFAULT.stitch_window_s) -> DataFrame:
    """Runs of a session on a line whose gap is within the window, as one."""
    w = Window.partitionBy("session_id", *LINE).orderBy("started_at", "ended_at", "match_id")
    gap = S.seconds_between(F.lag("ended_at").over(w), F.col("started_at"))
    rows = runs.withColumn("gap_s", gap).withColumn("new", F.when(F.col("gap_s") <= window_s, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w))
    return rows.groupBy("session_id", *LINE, "island").agg(F.min("match_id").alias("match_id"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.sum("fixes").alias("fixes"), F.count("*").alias("parts"))


def gaps_to_previous(runs: DataFrame) -> DataFrame:
    """Seconds from the end of the session's last run on the line to the start of this one."""
    w = Window.partitionBy("session_id", *LINE).orderBy("started_at", "ended_at", "match_id")
    return runs.withColumn("gap_to_previous_s", S.seconds_between(F.lag("ended_at").over(w), F.col("started_at")))


def interior_holes(buckets: DataFrame, size: float = DEFAULT.bucket_m) -> DataFrame:
    """Gaps between a line's buckets of more than one bucket."""
    rows = buckets.where(is_finite(F.col("distance_m").cast("double"))).select(*LINE, "distance_m").distinct()
    w = Window.partitionBy(*LINE).orderBy("distance_m")
    rows = rows.select(*LINE, F.col("distance_m").alias("from_m"), F.lead("distance_m").over(w).alias("to_m")).where(F.col("to_m") - F.col("from_m") > size)
    gap = F.col("to_m") - F.col("from_m")
    return rows.select(*LINE, "from_m", "to_m", gap.alias("gap_m"), (S.half_up(gap / size) - 1).cast("int").alias("missing"))


def hole_tally(holes: DataFrame) -> DataFrame:
    return holes.agg(F.countDistinct(F.struct(*LINE)).alias("lines"), F.count("*").alias("holes"), F.sum("gap_m").alias("metres"))


def straddling_pairs(holes: DataFrame, placed: DataFrame) -> DataFrame:
    """Of each hole, the consecutive fixes of a run whose buckets enclose it that are nearest in time, and the ground between them.

    placed: match_id, segment_id, direction, at_s, along_m, lon, lat."""
    w = Window.partitionBy("match_id").orderBy("at_s", "along_m")
    b = S.bucket(F.col("along_m"))
    rows = placed.select(*LINE, "at_s", "lon", "lat", b.alias("b"), F.lag(b).over(w).alias("a"), F.lag("at_s").over(w).alias("a_s"), F.lag("lon").over(w).alias("a_lon"), F.lag("lat").over(w).alias("a_lat")).where("a IS NOT NULL")
    rows = rows.select(*LINE, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), (F.col("at_s") - F.col("a_s")).alias("gap_s"), haversine_m(F.col("a_lon"), F.col("a_lat"), F.col("lon"), F.col("lat")).alias("ground_m"))
    hit = holes.join(rows, LINE).where("lo <= from_m AND hi >= to_m")
    return hit.groupBy(*LINE, "from_m", "to_m").agg(F.min(F.struct("gap_s", "ground_m")).alias("m")).select(*LINE, "from_m", "to_m", "m.gap_s", "m.ground_m")


def repeat_shares(samples: DataFrame) -> DataFrame:
    """Share of consecutive fixes with the same height: of all pairs, and of pairs of barometer fixes."""
    w = _ride()
    same = (F.col("elevation_m") == F.lag("elevation_m").over(w)).cast("double")
    both = (F.col("elevation_source") == "barometer") & (F.lag("elevation_source").over(w) == "barometer")
    rows = samples.select("session_id", same.alias("same"), F.coalesce(both, F.lit(False)).alias("both"))
    return rows.groupBy("session_id").agg(F.avg("same").alias("repeat_share"), F.avg(F.when(F.col("both"), F.col("same"))).alias("barometer_repeat_share"))


def gps_islands(samples: DataFrame, unmeasured_s: float = 30.0, least_s: float = 2.0, multiple: float = 2.0) -> DataFrame:
    """Stretches of GPS heights in each session, with the time before and after them that is charged to them.

    A gap of `unmeasured_s` or more is charged to no one; a shorter one up to the bracket: twice the session's median
    gap, between `least_s` and `unmeasured_s`."""
    w = _ride()
    at = S.micros(F.col("recorded_at")) / 1e6
    rows = samples.select("session_id", at.alias("s"), F.coalesce(F.col("elevation_source") == "gps", F.lit(False)).alias("gps"), F.lag(at).over(w).alias("before"), F.lead(at).over(w).alias("after"), F.row_number().over(w).alias("i"))
    brackets = rows.groupBy("session_id").agg(F.median(F.col("s") - F.col("before")).alias("m")).select("session_id", F.least(F.lit(unmeasured_s), F.greatest(F.lit(least_s), F.coalesce("m", F.lit(least_s)) * multiple)).alias("bracket_s"))
    gps = rows.where("gps").withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("session_id").orderBy("i")))
    found = gps.groupBy("session_id", "island").agg(F.count("*").alias("fixes"), F.min(F.struct("i", "s", "before")).alias("a"), F.max(F.struct("i", "s", "after")).alias("b")).join(brackets, "session_id")

    def charged(gap: Column) -> Column:
        return F.when(gap.isNull() | (gap >= unmeasured_s), 0.0).otherwise(F.least(gap, F.col("bracket_s")))

    own = F.col("b.s") - F.col("a.s")
    return found.select("session_id", "fixes", F.col("a.s").alias("started_s"), F.col("b.s").alias("ended_s"), own.alias("own_s"), (own + charged(F.col("a.s") - F.col("a.before")) + charged(F.col("b.after") - F.col("b.s"))).alias("seconds"))


def barometer_reports(samples: DataFrame, repeat_limit: float = 0.2, long_run_s: float = 30.0, unmeasured_limit: float = 0.5, unmeasured_s: float = 30.0) -> DataFrame:
    """What a session shows of its barometer, and the verdict; the first rule that holds decides."""
    w = _ride()
    gap = S.seconds_between(F.lag("recorded_at").over(w), F.col("recorded_at"))
    rows = samples.select("*", gap.alias("gap_s"))
    base = rows.groupBy("session_id").agg(
        F.count("*").alias("fixes"), F.count("elevation_source").alias("labelled"), F.count_if(F.col("elevation_source") == "barometer").alias("barometer_fixes"), F.countDistinct("elevation_m").alias("distinct_heights"),
        F.median("gap_s").alias("median_gap_s"), F.coalesce(F.sum(F.when(F.col("gap_s") >= unmeasured_s, F.col("gap_s"))), F.lit(0.0)).alias("unmeasured_s"), F.sum("gap_s").alias("duration_s"), F.median("altitude_accuracy_m").alias("median_accuracy_m"),
    )
    islands = gps_islands(samples, unmeasured_s).groupBy("session_id").agg(F.max("seconds").alias("longest_gps_s"), F.count_if(F.col("seconds") >= long_run_s).alias("long_gps_runs"))
    out = base.join(repeat_shares(samples), "session_id").join(islands, "session_id", "left").withColumn("long_gps_runs", F.coalesce("long_gps_runs", F.lit(0)))
    out = out.withColumn("barometer_share", F.when(F.col("labelled") > 0, F.col("barometer_fixes") / F.col("labelled"))).withColumn("unmeasured_share", F.when(F.col("duration_s") > 0, F.col("unmeasured_s") / F.col("duration_s")))
    verdict = F.when(F.col("barometer_share").isNull(), "unlabelled").when(F.col("barometer_share") == 0, "no-barometer").when(F.col("barometer_repeat_share") > repeat_limit, "claimed-but-stuck").when(F.col("long_gps_runs") > 0, "stopped").when(F.col("unmeasured_share") >= unmeasured_limit, "unmeasured").otherwise("alive")
    return out.withColumn("verdict", verdict)


def source_strips(samples: DataFrame, slot_s: float = 60.0) -> DataFrame:
    """A character for each slot of a session: B all barometer, g none, a digit for tenths, a dot for no labelled fix."""
    at = S.micros(F.col("recorded_at")) / 1e6
    rows = samples.select("session_id", F.floor((at - F.min(at).over(Window.partitionBy("session_id"))) / slot_s).cast("int").alias("slot"), "elevation_source").where("elevation_source IS NOT NULL")
    cells = rows.groupBy("session_id", "slot").agg(F.avg((F.col("elevation_source") == "barometer").cast("double")).alias("share"))
    mark = F.when(F.col("share") == 1, "B").when(F.col("share") == 0, "g").otherwise(S.half_up(F.col("share") * 10).cast("string"))
    found = cells.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", mark))).alias("m"), F.max("slot").alias("last"))
    return found.select("session_id", F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("."))), "").alias("strip"))


def recent_shares(samples: DataFrame, fixes: int = 10, least: int = 5, proving_s: float = 20.0) -> DataFrame:
    """Barometer share of the last fixes, and whether a native barometer would be given up by then."""
    w = _ride()
    last = w.rowsBetween(-(fixes - 1), 0)
    baro = F.coalesce(F.col("elevation_source") == "barometer", F.lit(False)).cast("double")
    elapsed = S.seconds_between(F.first("recorded_at").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("recorded_at"))
    return samples.select("session_id", "id", F.avg(baro).over(last).alias("share"), ((elapsed >= proving_s) & (F.count(F.lit(1)).over(last) >= least) & (F.sum(baro).over(last) == 0)).alias("abandon"))


def ride_extents(samples: DataFrame) -> DataFrame:
    """How far the furthest fix is from the first, and whether the ride is long enough to keep."""
    w = _ride().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = samples.select("session_id", haversine_m(F.first("lon").over(w), F.first("lat").over(w), F.col("lon"), F.col("lat")).alias("m"))
    return rows.groupBy("session_id").agg(F.max("m").alias("extent_m")).withColumn("saveable", F.col("extent_m") >= DEFAULT.min_saveable_extent_m)


def windowed_altitude(samples: DataFrame) -> DataFrame:
    """Height relative to the session's first, on top of its first GPS height."""
    w = _ride().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_gps = F.first(F.when(F.col("elevation_source") == "gps", F.col("elevation_m")), ignorenulls=True).over(w)
    return samples.select("session_id", "id", (F.col("elevation_m") - F.first("elevation_m").over(w) + F.coalesce(first_gps, F.lit(0.0))).alias("fused_m"))


# paths: rows of pieces or spans (path_id, i, ...)


def _path() -> Window:
    return Window.partitionBy("path_id").orderBy("i")


def running_metres(pieces: DataFrame) -> DataFrame:
    """Where along the path each piece begins."""
    return pieces.withColumn("at_m", F.coalesce(F.sum("length_m").over(_path().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def running_heights(spans: DataFrame) -> DataFrame:
    """Rise of each span, and the height at its start above the path's."""
    rise = F.col("slope_pct") * F.col("length_m") / 100
    rows = spans.withColumn("rise_m", rise)
    return rows.withColumn("height_m", F.coalesce(F.sum("rise_m").over(_path().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def unmeasured_slopes(pieces: DataFrame) -> DataFrame:
    """One slope for each stretch of pieces without data, from the heights at both its ends; 0 where an end has none.

    pieces: path_id, i, source, length_m, from_height_m and to_height_m (heights at the piece's own ends)."""
    w = _path()
    rows = pieces.withColumn("none", F.col("source") == "none")
    rows = rows.withColumn("island", F.sum(F.when(F.col("none") & F.lag("none", 1, False).over(w), 0).otherwise(1)).over(w))
    rows = rows.withColumn("before_m", F.lag("to_height_m").over(w)).withColumn("after_m", F.lead("from_height_m").over(w))
    runs = rows.where("none").groupBy("path_id", "island").agg(F.sum("length_m").alias("run_m"), F.min(F.struct("i", "before_m")).alias("a"), F.max(F.struct("i", "after_m")).alias("b"))
    slope = F.when((F.col("run_m") > 0) & F.col("a.before_m").isNotNull() & F.col("b.after_m").isNotNull(), S.clamp_slope((F.col("b.after_m") - F.col("a.before_m")) / F.col("run_m") * 100)).otherwise(0.0)
    return rows.where("none").select("path_id", "i", "island", "length_m").join(runs.select("path_id", "island", slope.alias("slope_pct")), ["path_id", "island"]).select("path_id", "i", "length_m", "slope_pct")


def path_stats(spans: DataFrame) -> DataFrame:
    """Distance, climb, descent, net rise, mean grade and metres without data of each path (spans with rise_m)."""
    out = spans.groupBy("path_id").agg(
        F.sum("length_m").alias("distance_m"), F.sum(F.greatest("rise_m", F.lit(0.0))).alias("climb_m"), F.sum(F.greatest(-F.col("rise_m"), F.lit(0.0))).alias("descent_m"), F.sum("rise_m").alias("net_m"), F.sum(F.when(F.col("source") == "none", F.col("length_m")).otherwise(0.0)).alias("no_data_m")
    )
    return out.withColumn("average_grade_pct", F.when(F.col("distance_m") > 0, F.col("net_m") / F.col("distance_m") * 100))


def band_shares(spans: DataFrame) -> DataFrame:
    """Metres with data in each slope band, and their share of the whole path."""
    whole = spans.groupBy("path_id").agg(F.sum("length_m").alias("distance_m"))
    by = spans.where("source <> 'none'").groupBy("path_id", S.band_index(F.col("color"), F.col("slope_pct")).cast("int").alias("band")).agg(F.sum("length_m").alias("length_m"))
    return by.join(whole, "path_id").select("path_id", "band", "length_m", (F.col("length_m") / F.col("distance_m")).alias("share"))


def cut_spans(spans: DataFrame, cuts: DataFrame) -> DataFrame:
    """Spans (with at_m, rise_m) up to each path's cut_m: the last one in part, its rise by length."""
    rows = spans.join(cuts, "path_id").where("at_m < cut_m")
    keep = F.least(F.col("length_m"), F.col("cut_m") - F.col("at_m"))
    return rows.withColumn("rise_m", F.when(F.col("length_m") > 0, F.col("rise_m") * keep / F.col("length_m")).otherwise(F.col("rise_m"))).withColumn("length_m", keep).drop("cut_m")


def merged_spans(spans: DataFrame, near_m: float = 0.01) -> DataFrame:
    """Consecutive spans of a piece with one colour, and with or without data alike, as one."""
    w = Window.partitionBy("path_id", "piece").orderBy("i")
    no_data = F.col("source") == "none"
    rows = spans.withColumn("no_data", no_data).withColumn("end_m", F.col("at_m") + F.col("length_m"))
    same = (F.lag("color").over(w) == F.col("color")) & (F.lag("no_data").over(w) == F.col("no_data")) & (F.abs(F.lag("end_m").over(w) - F.col("at_m")) < near_m)
    rows = rows.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    return rows.groupBy("path_id", "piece", "run").agg(F.min("at_m").alias("start_m"), F.max("end_m").alias("end_m"), F.first("color").alias("color"), F.first("no_data").alias("no_data"))


def profile_columns(spans: DataFrame, count: int) -> DataFrame:
    """Height and colour of each path at the midpoints of `count` equal parts (spans with at_m, height_m, rise_m)."""
    whole = spans.groupBy("path_id").agg(F.max(F.col("at_m") + F.col("length_m")).alias("whole_m")).where("whole_m > 0")
    bins = whole.select("path_id", "whole_m", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("bin")).withColumn("x", (F.col("bin") + 0.5) / count * F.col("whole_m"))
    # the span of a midpoint is the last that starts at or before it: spans and midpoints sorted together
    both = spans.select("path_id", F.col("at_m").alias("x"), F.lit(0).alias("kind"), F.struct("at_m", "length_m", "height_m", "rise_m", "color", "source").alias("s"), F.lit(None).cast("int").alias("bin"), "i")
    both = both.unionByName(bins.select("path_id", "x", F.lit(1).alias("kind"), F.lit(None).cast(both.schema["s"].dataType).alias("s"), "bin", F.lit(0).cast(both.schema["i"].dataType).alias("i")))
    w = Window.partitionBy("path_id").orderBy("x", "kind", "i").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("s", F.last("s", ignorenulls=True).over(w)).where("kind = 1").select("path_id", "bin", "x", "s.*")
    into = S.clamp(F.col("x") - F.col("at_m"), 0, float("inf"))
    height = F.col("height_m") + F.when(F.col("length_m") > 0, F.col("rise_m") * F.least(into, F.col("length_m")) / F.col("length_m")).otherwise(0.0)
    return rows.select("path_id", "bin", height.alias("height_m"), "color", (F.col("source") == "none").alias("no_data"))


def street_names(pieces: DataFrame, least_m: float = DEFAULT.named_min_m) -> DataFrame:
    """Names along each path in order, without those of a short stretch in all (unless all are), each stretch once."""
    named = pieces.where("street_name IS NOT NULL AND street_name <> ''")
    total = F.sum("length_m").over(Window.partitionBy("path_id", "street_name"))
    rows = named.withColumn("total_m", total).withColumn("any_long", F.max((F.col("total_m") >= least_m).cast("int")).over(Window.partitionBy("path_id")))
    rows = rows.where((F.col("any_long") == 0) | (F.col("total_m") >= least_m))
    rows = rows.withColumn("was", F.lag("street_name").over(_path())).where("was IS NULL OR was <> street_name")
    return rows.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "street_name"))), lambda s: s["street_name"]), " / ").alias("names"))


def twin_lines(pieces: DataFrame) -> DataFrame:
    """The way back along each path: pieces in reverse, directions flipped, neighbours on one segment as one."""
    w = Window.partitionBy("path_id").orderBy(F.desc("i"))
    rows = pieces.withColumn("direction", S.opposite(F.col("direction")))
    rows = rows.withColumn("run", F.sum(F.when(F.col("segment_id") == F.lag("segment_id").over(w), 0).otherwise(1)).over(w))
    return rows.groupBy("path_id", "run", "segment_id").agg(F.max(F.struct("i", "direction")).alias("d"), F.sum("length_m").alias("length_m")).select("path_id", "run", "segment_id", F.col("d.direction").alias("direction"), "length_m")


def length_chunks(lines: DataFrame, most_m: float = DEFAULT.flip_chunk_m) -> DataFrame:
    """Greedy chunks of consecutive lines (path_id, run, length_m) up to most_m each; a longer line stands alone.

    Where a chunk begins depends on all chunks before it, so each path is walked in order, by batches: a task holds the
    sum of one chunk only."""

    def walk(batches):
        path, chunk, total = object(), 0, 0.0
        for pdf in batches:
            out = []
            for p, m in zip(pdf.path_id.tolist(), pdf.m.tolist(), strict=True):
                if p != path:
                    path, chunk, total = p, 0, m
                elif total + m > most_m:
                    chunk, total = chunk + 1, m
                else:
                    total += m
                out.append(chunk)
            yield pd.DataFrame({"path_id": pdf.path_id, "run": pdf.run, "chunk": np.array(out, dtype=np.int32)})

    rows = lines.select("path_id", F.col("run").cast("long").alias("run"), F.col("length_m").cast("double").alias("m"))
    return rows.repartition("path_id").sortWithinPartitions("path_id", "run").mapInPandas(walk, f"path_id {lines.schema['path_id'].dataType.simpleString()}, run long, chunk int")
