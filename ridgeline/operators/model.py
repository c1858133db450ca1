"""The crowd-sourced model: buckets of runs, running means, coverage, anchors, slopes and drawn lines.

Pass buckets (one row for each pass and bucket) are the source of truth; every aggregate is derived from them by sums
that combine before their shuffle, so a busy line is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import DEFAULT, EngineConfig
from ridgeline.functions import scalar as S
from ridgeline.functions.geo import is_finite

LINE = ["segment_id", "direction"]


def bucketize(fixes: DataFrame, keys: list[str], size: float = DEFAULT.bucket_m) -> DataFrame:
    """Mean height per run and bucket of fixes (keys, along_m, elevation_m)."""
    return fixes.groupBy(*keys, S.bucket(F.col("along_m"), size).alias("distance_m")).agg(F.avg("elevation_m").alias("elevation_m"))


def run_profile(fixes: DataFrame, keys: list[str], neighbours: DataFrame | None = None) -> DataFrame:
    """Covered stretch and span of each run (keys, along_m, length_m); the fixes just before and after it count for both.

    Coverage stays within the line, the span doesn't."""
    own = fixes.select(*keys, "along_m", "length_m", F.lit(1).alias("own"))
    if neighbours is not None:
        own = own.unionByName(neighbours.select(*keys, "along_m", "length_m", F.lit(0).alias("own")))
    ends = own.groupBy(*keys).agg(F.min("along_m").alias("low"), F.max("along_m").alias("high"), F.max("length_m").alias("length_m"), F.sum("own").alias("fixes"))
    return ends.select(*keys, "length_m", "fixes", F.greatest(F.lit(0.0), "low").alias("covered_from_m"), F.least("length_m", "high").alias("covered_to_m"), F.when(F.col("fixes") > 0, F.col("high") - F.col("low")).otherwise(0.0).alias("span_m"))


def assess(profiles: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Adds the share of the line that a run spans, and whether it passes the gate."""
    share = F.when(F.col("length_m") > 0, F.col("span_m") / F.col("length_m")).otherwise(0.0)
    return profiles.withColumn("coverage_fraction", share).withColumn("qualified", S.qualifies(F.col("span_m"), share, config.min_span_m, config.min_coverage))


def clamp_to_passage(profiles: DataFrame) -> DataFrame:
    """Coverage reaches an end of the line that the run entered or left through (entered_through, exited_through); it never narrows."""
    return profiles.withColumn("covered_from_m", F.when(F.col("entered_through"), 0.0).otherwise(F.col("covered_from_m"))).withColumn("covered_to_m", F.when(F.col("exited_through"), F.col("length_m")).otherwise(F.col("covered_to_m")))


def passages(runs: DataFrame, neighbours: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """entered_through and exited_through of runs (segment_id, direction, before_segment, before_gap_s, after_segment, after_gap_s).

    A run went through an end if the fix next to it, within the gap, is on a line that touches that end:
    neighbours (segment_id, which, other)."""
    touching = neighbours.select(F.col("segment_id").alias("n_seg"), F.col("which"), F.col("other"))

    def through(rows: DataFrame, fix: str, gap: str, forward_end: str, out: str) -> DataFrame:
        other_end = "end" if forward_end == "start" else "start"
        n = touching.select("n_seg", F.col("which").alias("n_which"), F.col("other").alias("n_other")).distinct()
        side = F.when(F.col("direction") == "forward", forward_end).otherwise(other_end)
        hit = (F.col("segment_id") == F.col("n_seg")) & (F.col(fix) == F.col("n_other")) & (side == F.col("n_which")) & (F.col(gap) <= config.anchor_max_gap_s)
        return rows.join(n, hit, "left").withColumn(out, F.col("n_seg").isNotNull()).drop("n_seg", "n_which", "n_other")

    return through(through(runs, "before_segment", "before_gap_s", "start", "entered_through"), "after_segment", "after_gap_s", "end", "exited_through")


def bucket_model(passes: DataFrame) -> DataFrame:
    """Mean height and number of passes of each line and bucket."""
    return passes.groupBy(*LINE, "distance_m").agg(F.avg("elevation_m").alias("elevation_m"), F.count("*").alias("sample_count"))


def merge_model(stored: DataFrame, passes: DataFrame) -> DataFrame:
    """The stored model with further passes folded in: (old * n + sum) / (n + m)."""
    old = stored.select(*LINE, "distance_m", (F.col("elevation_m") * F.col("sample_count")).alias("total"), F.col("sample_count").alias("n"))
    new = passes.groupBy(*LINE, "distance_m").agg(F.sum("elevation_m").alias("total"), F.count("*").alias("n"))
    both = old.unionByName(new).groupBy(*LINE, "distance_m").agg(F.sum("total").alias("total"), F.sum("n").alias("sample_count"))
    return both.select(*LINE, "distance_m", (F.col("total") / F.col("sample_count")).alias("elevation_m"), "sample_count")


def merge_coverage(*parts: DataFrame) -> DataFrame:
    """The hull of covered stretches of each line."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*LINE).agg(F.min("covered_from_m").alias("covered_from_m"), F.max("covered_to_m").alias("covered_to_m"))


def residuals(passes: DataFrame, dem: DataFrame) -> DataFrame:
    """Our height less the terrain's, where the terrain has the bucket."""
    return passes.join(dem.where(F.col("dem_m").isNotNull()), [*LINE, "distance_m"]).withColumn("residual_m", F.col("elevation_m") - F.col("dem_m"))


def fit_anchor(rows: DataFrame, key: str = "session_id", config: EngineConfig = DEFAULT) -> DataFrame:
    """Median residual of each session; null with too few points, or where it is implausible."""
    r = F.when(is_finite(F.col("residual_m")), F.col("residual_m"))
    found = rows.groupBy(key).agg(F.count(r).alias("points"), F.median(r).alias("m"))
    return found.select(key, "points", F.when((F.col("points") >= config.min_anchor_points) & (F.abs("m") <= config.max_anchor_m), F.col("m")).alias("anchor_m"))


def anchored(passes: DataFrame, anchors: DataFrame, key: str = "session_id") -> DataFrame:
    """Heights less their session's anchor; raw where there is none."""
    return passes.join(anchors.select(key, "anchor_m"), key, "left").withColumn("elevation_m", F.col("elevation_m") - F.coalesce("anchor_m", F.lit(0.0))).drop("anchor_m")


def _along_line() -> Window:
    return Window.partitionBy(*LINE).orderBy("distance_m")


def regression_slopes(buckets: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Least-squares slope of the buckets around each one that has a next; percent, clamped, 0 where undefined."""
    w = _along_line()
    pct = 100 * F.regr_slope(F.col("elevation_m").cast("double"), F.col("distance_m").cast("double")).over(w.rowsBetween(-config.slope_window, config.slope_window + 1))
    rows = buckets.withColumn("next_m", F.lead("distance_m").over(w)).withColumn("slope_pct", S.clamp_slope(F.coalesce(F.when(is_finite(pct), pct), F.lit(0.0))))
    return rows.where("next_m IS NOT NULL")


def piece_slopes(buckets: DataFrame, passes: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Slope of each piece by its passes where every bucket of its window has all of them on file, else by the means.

    A pass counts by its points in the window; one with a single point doesn't count."""
    w = _along_line()
    ranked = buckets.select(*LINE, "distance_m", "sample_count", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(*LINE)).alias("n"))
    on_file = passes.groupBy(*LINE, "distance_m").agg(F.count("*").alias("filed"))
    ranked = ranked.join(on_file, [*LINE, "distance_m"], "left")
    steps = F.sequence(F.greatest(F.lit(1), F.col("i") - config.slope_window - 1), F.least(F.col("i") + config.slope_window, F.col("n") - 1))
    windows = ranked.select(*LINE, "distance_m", (F.coalesce("filed", F.lit(0)) == F.col("sample_count")).alias("complete"), F.explode(steps).alias("at"))
    complete = windows.groupBy(*LINE, "at").agg(F.min("complete").alias("complete"))
    points = windows.join(passes.select(*LINE, "distance_m", "match_id", "elevation_m"), [*LINE, "distance_m"])
    per_pass = points.groupBy(*LINE, "at", "match_id").agg(F.regr_slope(F.col("elevation_m"), F.col("distance_m").cast("double")).alias("s"), F.count("*").alias("k"))
    per_pass = per_pass.where(F.col("s").isNotNull() & ~F.isnan("s")).groupBy(*LINE, "at").agg((100 * F.sum(F.col("s") * F.col("k")) / F.sum("k")).alias("by_pass"))
    base = regression_slopes(buckets, config).withColumn("at", F.row_number().over(w))
    out = base.join(complete, [*LINE, "at"], "left").join(per_pass, [*LINE, "at"], "left")
    own = F.when(F.col("complete") & is_finite(F.col("by_pass")), S.clamp_slope(F.col("by_pass")))
    return out.select(*LINE, "distance_m", "next_m", "elevation_m", "sample_count", own.isNotNull().alias("by_passes"), F.coalesce(own, F.col("slope_pct")).alias("slope_pct"))


def pooled_slopes(points: DataFrame, keys: list[str]) -> DataFrame:
    """One slope over all passes that share it: the sum of the passes' covariances over that of their variances."""
    d, e = F.col("distance_m").cast("double"), F.col("elevation_m")
    each = points.groupBy(*keys, "match_id").agg(F.regr_sxy(e, d).alias("sxy"), F.regr_sxx(e, d).alias("sxx"))
    return each.groupBy(*keys).agg((100 * F.sum("sxy") / F.nullif(F.sum("sxx"), F.lit(0.0))).alias("pooled_pct"))


def extents(buckets: DataFrame, coverage: DataFrame, lines: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Drawn stretch of each line: its coverage within the line, else half a bucket around its buckets; empty ones go."""
    ends = buckets.groupBy(*LINE).agg(F.min("distance_m").alias("first_m"), F.max("distance_m").alias("last_m"))
    rows = ends.join(coverage, LINE, "left").join(lines.select("segment_id", "length_m"), "segment_id")
    half = config.bucket_m / 2
    known = F.col("covered_from_m").isNotNull() & F.col("covered_to_m").isNotNull()
    from_m = F.greatest(F.lit(0.0), F.when(known, F.col("covered_from_m")).otherwise(F.col("first_m") - half))
    to_m = F.least(F.col("length_m"), F.when(known, F.col("covered_to_m")).otherwise(F.col("last_m") + half))
    return rows.select(*LINE, "length_m", from_m.alias("from_m"), to_m.alias("to_m")).where("to_m > from_m")


def drawn_stops(buckets: DataFrame, coverage: DataFrame, lines: DataFrame, passes: DataFrame | None = None) -> DataFrame:
    """Pieces of each drawn line with start, end, fraction along the line's own direction, slope and colour.

    The first and last piece reach to the drawn ends; a line of one bucket is one flat piece."""
    slopes = piece_slopes(buckets, passes) if passes is not None else regression_slopes(buckets)
    single = buckets.groupBy(*LINE).agg(F.count("*").alias("k"), F.min("distance_m").alias("distance_m")).where("k = 1").select(*LINE, "distance_m", F.col("distance_m").alias("next_m"), F.lit(0.0).alias("slope_pct"))
    rows = slopes.select(*LINE, "distance_m", "next_m", "slope_pct").unionByName(single).join(extents(buckets, coverage, lines), LINE)
    whole = Window.partitionBy(*LINE)
    start = F.when(F.col("distance_m") == F.min("distance_m").over(whole), F.col("from_m")).otherwise(F.col("distance_m").cast("double"))
    end = F.when(F.col("next_m") == F.max("next_m").over(whole), F.col("to_m")).otherwise(F.col("next_m").cast("double"))
    rows = rows.withColumn("start_m", start).withColumn("end_m", end)

    def fraction(m: Column) -> Column:
        drawn = F.col("to_m") - F.col("from_m")
        return S.clamp(F.when(F.col("direction") == "forward", (m - F.col("from_m")) / drawn).otherwise((F.col("to_m") - m) / drawn), 0, 1)

    return rows.select(*LINE, "length_m", "from_m", "to_m", "start_m", "end_m", F.least(fraction(F.col("start_m")), fraction(F.col("end_m"))).alias("fraction"), "slope_pct", S.slope_color(F.col("slope_pct")).alias("color"))


def drawn_ranges(stops: DataFrame) -> DataFrame:
    """Stops as ranges in travel metres, each to the next stop; empty ranges go."""
    to = F.coalesce(F.lead("fraction").over(Window.partitionBy(*LINE).orderBy("fraction", "start_m")), F.lit(1.0))
    rows = stops.withColumn("f1", to).where("f1 > fraction")
    drawn = F.col("to_m") - F.col("from_m")
    forward = F.col("direction") == "forward"
    low = F.when(forward, F.col("from_m") + F.col("fraction") * drawn).otherwise(F.col("to_m") - F.col("f1") * drawn)
    high = F.when(forward, F.col("from_m") + F.col("f1") * drawn).otherwise(F.col("to_m") - F.col("fraction") * drawn)
    return rows.select(*LINE, low.alias("range_from_m"), high.alias("range_to_m"), "slope_pct", "color")


def twin_ranges(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """The ranges as the opposite direction sees them: mirrored, slopes negated."""
    rows = ranges.join(lines.select("segment_id", F.col("length_m").alias("whole_m")), "segment_id")
    return rows.select("segment_id", S.opposite(F.col("direction")).alias("direction"), (F.col("whole_m") - F.col("range_to_m")).alias("range_from_m"), (F.col("whole_m") - F.col("range_from_m")).alias("range_to_m"), (-F.col("slope_pct")).alias("slope_pct"), S.slope_color(-F.col("slope_pct")).alias("color"))


def viewport(lines: DataFrame, buckets: DataFrame, coverage: DataFrame, passes: DataFrame | None = None) -> DataFrame:
    """Each segment with its drawn lines nested: direction, stretch and colour stops in order of fraction."""
    stops = drawn_stops(buckets, coverage, lines, passes)
    drawn = stops.groupBy(*LINE, "from_m", "to_m").agg(F.array_sort(F.collect_list(F.struct("fraction", "color", "slope_pct"))).alias("stops"))
    return drawn.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("direction", "from_m", "to_m", "stops"))).alias("lines"))


def line_rides(matches: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct rides over each line, and when the last one started."""
    rows = matches.join(sessions.select(F.col("id").alias("session_id"), "started_at"), "session_id")
    return rows.groupBy(*LINE).agg(F.countDistinct("session_id").alias("rides"), F.max("started_at").alias("last_ridden_at"))


def heights_at(buckets: DataFrame, points: DataFrame) -> DataFrame:
    """Height of each point (segment_id, direction, travel_m): between its buckets by distance, at the ends the end bucket's."""
    cuts = buckets.groupBy(*LINE).agg(F.array_sort(F.collect_list(F.struct(F.col("distance_m").cast("double").alias("d"), F.col("elevation_m").alias("e")))).alias("b"))
    rows = points.join(cuts, LINE, "left")
    m = F.col("travel_m")
    low, high = F.try_element_at(F.filter("b", lambda x: x["d"] < m), F.lit(-1)), F.try_element_at(F.filter("b", lambda x: x["d"] >= m), F.lit(1))
    between = low["e"] + (m - low["d"]) / (high["d"] - low["d"]) * (high["e"] - low["e"])
    return rows.withColumn("height_m", F.when(low.isNull(), high["e"]).when(high.isNull(), low["e"]).otherwise(between)).drop("b")
