"""The registered queries of the engine over the surrogate tables, each beside the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.config import SLOPE_BANDS
from ridgeline.functions import geo as G
from ridgeline.functions import scalar as S
from ridgeline.operators import model as M
from ridgeline.operators import relational as R
from ridgeline.operators import windows as W
from ridgeline.sources.surrogate import model_table, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

R_M = "6371008.8e0"
HAV = "(2 * {r} * asin(least(1e0, sqrt(pow(sin((radians({y2}) - radians({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2)))))"


def hav(x1: str, y1: str, x2: str, y2: str) -> str:
    return HAV.format(r=R_M, x1=x1, y1=y1, x2=x2, y2=y2)


def color_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {m}e0 THEN '{c}'" for m, c in SLOPE_BANDS[:-1]) + f" ELSE '{SLOPE_BANDS[-1][1]}' END"


def query(name: str, tables: str, sql: str | None = None):
    """Registers f(*tables) under the name; `sql` may use the same tables."""
    names = tuple(tables.split())

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[model_table(spark, sf_dir, t) for t in names])
        if sql is not None:
            ORACLES[name] = with_tables(names, sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles at fixed places, zero without a sign."""
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in columns})


BUCKET = "CAST(floor(along_m / 15 + 0.5e0) AS INT) * 15"
W6 = "(PARTITION BY segment_id, direction ORDER BY distance_m ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)"

# --- the model


@query("model_run_buckets", "run_fixes", f"SELECT match_id, segment_id, direction, {BUCKET} AS distance_m, round(avg(elevation_m), 6) AS elevation_m FROM run_fixes GROUP BY ALL")
def _(fixes):
    return rounded(M.bucketize(fixes, ["match_id", "segment_id", "direction"]), "elevation_m")


PROFILE_SQL = """SELECT match_id, segment_id, direction, count(*) AS fixes, round(max(greatest(0e0, lo)), 6) AS covered_from_m, round(max(least(length_m, hi)), 6) AS covered_to_m, round(max(hi - lo), 6) AS span_m,
    round(max((hi - lo) / length_m), 6) AS coverage_fraction, bool_or(hi - lo >= 25 OR (hi - lo) / length_m >= 0.7e0) AS qualified
    FROM (SELECT f.match_id, f.segment_id, f.direction, l.length_m, min(along_m) OVER w AS lo, max(along_m) OVER w AS hi FROM run_fixes f JOIN lines l ON l.segment_id = f.segment_id WINDOW w AS (PARTITION BY match_id)) GROUP BY match_id, segment_id, direction"""


@query("model_run_assessment", "run_fixes lines", PROFILE_SQL)
def _(fixes, lines):
    rows = M.assess(M.run_profile(fixes.join(lines, "segment_id"), ["match_id", "segment_id", "direction"]))
    return rounded(rows.drop("length_m"), "covered_from_m", "covered_to_m", "span_m", "coverage_fraction")


@query("model_buckets", "pass_buckets", "SELECT segment_id, direction, distance_m, round(avg(elevation_m), 6) AS elevation_m, count(*) AS sample_count FROM pass_buckets GROUP BY 1, 2, 3")
def _(passes):
    return rounded(M.bucket_model(passes), "elevation_m")


@query("model_incremental_merge", "pass_buckets", "SELECT segment_id, direction, distance_m, round(avg(elevation_m), 6) AS elevation_m, count(*) AS sample_count FROM pass_buckets GROUP BY 1, 2, 3")
def _(passes):
    early = F.col("recorded_at") < F.lit("1999-01-01").cast("timestamp_ntz")
    return rounded(M.merge_model(M.bucket_model(passes.where(early)), passes.where(~early)), "elevation_m")


@query("model_coverage", "runs", "SELECT segment_id, direction, min(greatest(0e0, from_m)) AS covered_from_m, max(least(length_m, to_m)) AS covered_to_m FROM runs WHERE span_m >= 25 OR span_m / length_m >= 0.7e0 GROUP BY 1, 2")
def _(runs):
    rows = M.assess(runs).where("qualified").select("segment_id", "direction", F.greatest(F.lit(0.0), "from_m").alias("covered_from_m"), F.least("length_m", "to_m").alias("covered_to_m"))
    return M.merge_coverage(rows)


RESIDUALS = "res AS (SELECT p.session_id, p.segment_id, p.direction, p.distance_m, p.elevation_m - d.dem_m AS r FROM pass_buckets p JOIN dem d ON d.segment_id = p.segment_id AND d.direction = p.direction AND d.distance_m = p.distance_m)"


@query("model_residuals", "pass_buckets dem", f"WITH {RESIDUALS} SELECT session_id, segment_id, direction, distance_m, round(r, 6) AS residual_m FROM res")
def _(passes, dem):
    return rounded(M.residuals(passes, dem).select("session_id", "segment_id", "direction", "distance_m", "residual_m"), "residual_m")


@query("model_anchor_fit", "pass_buckets dem", f"WITH {RESIDUALS} SELECT segment_id, count(r) AS points, round(CASE WHEN count(r) >= 10 AND abs(median(r)) <= 60 THEN median(r) END, 6) AS anchor_m FROM res GROUP BY 1")
def _(passes, dem):
    return rounded(M.fit_anchor(M.residuals(passes, dem), "segment_id"), "anchor_m")


@query("model_anchored_buckets", "pass_buckets dem", f"""WITH {RESIDUALS}, a AS (SELECT segment_id, CASE WHEN count(r) >= 10 AND abs(median(r)) <= 60 THEN median(r) END AS anchor_m FROM res GROUP BY 1)
    SELECT p.segment_id, p.direction, p.distance_m, round(avg(p.elevation_m - coalesce(a.anchor_m, 0)), 6) AS elevation_m, count(*) AS sample_count FROM pass_buckets p LEFT JOIN a ON a.segment_id = p.segment_id GROUP BY 1, 2, 3""")
def _(passes, dem):
    anchors = M.fit_anchor(M.residuals(passes, dem), "segment_id")
    return rounded(M.bucket_model(M.anchored(passes, anchors, "segment_id")), "elevation_m")


SLOPES = f"""sl AS (SELECT segment_id, direction, distance_m, lead(distance_m) OVER (PARTITION BY segment_id, direction ORDER BY distance_m) AS next_m, sample_count, elevation_m,
    greatest(-25e0, least(25e0, coalesce(100 * regr_slope(elevation_m, distance_m) OVER {W6}, 0e0))) AS slope_pct FROM buckets)"""


@query("line_slopes", "buckets", f"WITH {SLOPES} SELECT segment_id, direction, distance_m, sample_count, round(slope_pct, 5) + 0e0 AS slope_pct, {color_sql('round(slope_pct, 5)')} AS color FROM sl WHERE next_m IS NOT NULL")
def _(buckets):
    rows = rounded(M.regression_slopes(buckets), "slope_pct", places=5)
    return rows.select("segment_id", "direction", "distance_m", "sample_count", "slope_pct", S.slope_color(F.col("slope_pct")).alias("color"))


PIECES = f"""{SLOPES}, rk AS (SELECT *, row_number() OVER (PARTITION BY segment_id, direction ORDER BY distance_m) AS i FROM buckets),
    pp AS (SELECT a.segment_id, a.direction, a.i, p.match_id, regr_slope(p.elevation_m, p.distance_m) AS s, count(*) AS k FROM rk a JOIN rk b ON b.segment_id = a.segment_id AND b.direction = a.direction AND b.i BETWEEN a.i - 2 AND a.i + 3
      JOIN pass_buckets p ON p.segment_id = b.segment_id AND p.direction = b.direction AND p.distance_m = b.distance_m GROUP BY 1, 2, 3, 4),
    bp AS (SELECT segment_id, direction, i, 100 * sum(s * k) / sum(k) AS w FROM pp WHERE s IS NOT NULL AND NOT isnan(s) GROUP BY 1, 2, 3),
    pc AS (SELECT sl.segment_id, sl.direction, sl.distance_m, sl.next_m, bp.w IS NOT NULL AS by_passes, CASE WHEN bp.w IS NULL THEN sl.slope_pct ELSE greatest(-25e0, least(25e0, bp.w)) END AS slope_pct
      FROM sl JOIN rk ON rk.segment_id = sl.segment_id AND rk.direction = sl.direction AND rk.distance_m = sl.distance_m LEFT JOIN bp ON bp.segment_id = rk.segment_id AND bp.direction = rk.direction AND bp.i = rk.i WHERE sl.next_m IS NOT NULL)"""


@query("line_slopes_by_pass", "buckets pass_buckets", f"WITH {PIECES} SELECT segment_id, direction, distance_m, by_passes, round(slope_pct, 5) + 0e0 AS slope_pct FROM pc")
def _(buckets, passes):
    return rounded(M.piece_slopes(buckets, passes), "slope_pct", places=5).select("segment_id", "direction", "distance_m", "by_passes", "slope_pct")


@query("line_pooled_slopes", "pass_buckets", """WITH e AS (SELECT segment_id, direction, match_id, regr_sxy(elevation_m, distance_m) AS sxy, regr_sxx(elevation_m, distance_m) AS sxx FROM pass_buckets GROUP BY 1, 2, 3)
    SELECT segment_id, direction, round(100 * sum(sxy) / nullif(sum(sxx), 0), 5) AS pooled_pct FROM e GROUP BY 1, 2""")
def _(passes):
    return rounded(M.pooled_slopes(passes, ["segment_id", "direction"]), "pooled_pct", places=5)


EXTENTS = """ext AS (SELECT segment_id, direction, length_m, from_m, to_m FROM (SELECT b.segment_id, b.direction, max(l.length_m) AS length_m, greatest(0e0, coalesce(max(c.covered_from_m), min(b.distance_m) - 7.5e0)) AS from_m,
    least(max(l.length_m), coalesce(max(c.covered_to_m), max(b.distance_m) + 7.5e0)) AS to_m FROM buckets b JOIN lines l ON l.segment_id = b.segment_id LEFT JOIN coverage c ON c.segment_id = b.segment_id AND c.direction = b.direction GROUP BY 1, 2) x WHERE to_m > from_m)"""


@query("line_extents", "buckets coverage lines", f"WITH {EXTENTS} SELECT * FROM ext")
def _(buckets, coverage, lines):
    return M.extents(buckets, coverage, lines)


STOPS = f"""{PIECES}, {EXTENTS}, al AS (SELECT segment_id, direction, distance_m, next_m, slope_pct FROM pc UNION ALL SELECT segment_id, direction, min(distance_m), min(distance_m), 0e0 FROM buckets GROUP BY 1, 2 HAVING count(*) = 1),
    se AS (SELECT al.segment_id, al.direction, e.length_m, e.from_m, e.to_m, slope_pct, CASE WHEN distance_m = min(distance_m) OVER w THEN e.from_m ELSE distance_m END AS start_m, CASE WHEN next_m = max(next_m) OVER w THEN e.to_m ELSE next_m END AS end_m
      FROM al JOIN ext e ON e.segment_id = al.segment_id AND e.direction = al.direction WINDOW w AS (PARTITION BY al.segment_id, al.direction)),
    st AS (SELECT *, least(greatest(0e0, least(1e0, CASE WHEN direction = 'forward' THEN (start_m - from_m) / (to_m - from_m) ELSE (to_m - start_m) / (to_m - from_m) END)), greatest(0e0, least(1e0, CASE WHEN direction = 'forward' THEN (end_m - from_m) / (to_m - from_m) ELSE (to_m - end_m) / (to_m - from_m) END))) AS fraction FROM se)"""


@query("line_drawing", "buckets coverage lines pass_buckets", f"WITH {STOPS} SELECT segment_id, direction, round(start_m, 6) AS start_m, round(end_m, 6) AS end_m, round(fraction, 6) + 0e0 AS fraction, round(slope_pct, 5) + 0e0 AS slope_pct FROM st")
def _(buckets, coverage, lines, passes):
    rows = M.drawn_stops(buckets, coverage, lines, passes)
    return rounded(rounded(rows, "start_m", "end_m", "fraction"), "slope_pct", places=5).select("segment_id", "direction", "start_m", "end_m", "fraction", "slope_pct")


RANGES = f"""{STOPS}, nx AS (SELECT *, coalesce(lead(fraction) OVER (PARTITION BY segment_id, direction ORDER BY fraction, start_m), 1e0) AS f1 FROM st),
    rg AS (SELECT segment_id, direction, length_m, slope_pct, CASE WHEN direction = 'forward' THEN from_m + fraction * (to_m - from_m) ELSE to_m - f1 * (to_m - from_m) END AS a, CASE WHEN direction = 'forward' THEN from_m + f1 * (to_m - from_m) ELSE to_m - fraction * (to_m - from_m) END AS b FROM nx WHERE f1 > fraction)"""


@query("line_drawn_ranges", "buckets coverage lines pass_buckets", f"WITH {RANGES} SELECT segment_id, direction, round(a, 6) + 0e0 AS range_from_m, round(b, 6) + 0e0 AS range_to_m, round(slope_pct, 5) + 0e0 AS slope_pct FROM rg")
def _(buckets, coverage, lines, passes):
    rows = M.drawn_ranges(M.drawn_stops(buckets, coverage, lines, passes)).drop("color")
    return rounded(rounded(rows, "range_from_m", "range_to_m"), "slope_pct", places=5)


@query("line_twin_ranges", "buckets coverage lines pass_buckets", f"""WITH {RANGES} SELECT segment_id, CASE WHEN direction = 'forward' THEN 'backward' ELSE 'forward' END AS direction, round(length_m - b, 6) + 0e0 AS range_from_m, round(length_m - a, 6) + 0e0 AS range_to_m, round(-slope_pct, 5) + 0e0 AS slope_pct FROM rg""")
def _(buckets, coverage, lines, passes):
    rows = M.twin_ranges(M.drawn_ranges(M.drawn_stops(buckets, coverage, lines, passes)), lines).drop("color")
    return rounded(rounded(rows, "range_from_m", "range_to_m"), "slope_pct", places=5)


@query("viewport_lines", "buckets coverage lines", f"""WITH {SLOPES}, {EXTENTS} SELECT l.segment_id, count(DISTINCT e.direction) AS drawn_lines FROM lines l JOIN ext e ON e.segment_id = l.segment_id GROUP BY 1""")
def _(buckets, coverage, lines):
    return M.viewport(lines, buckets, coverage).select("segment_id", F.size("lines").cast("long").alias("drawn_lines"))


@query("line_rides", "runs sessions", "SELECT segment_id, direction, count(DISTINCT session_id) AS rides, epoch_us(max(s.started_at)) AS last_us FROM (SELECT session_id, segment_id, direction FROM runs) r JOIN sessions s ON s.id = r.session_id GROUP BY 1, 2")
def _(runs, sessions):
    rows = M.line_rides(runs.select("session_id", "segment_id", "direction"), sessions)
    return rows.select("segment_id", "direction", "rides", S.micros(F.col("last_ridden_at")).alias("last_us"))


@query("line_heights_at", "buckets", """WITH p AS (SELECT DISTINCT segment_id, direction, CAST(x AS DOUBLE) AS travel_m FROM buckets CROSS JOIN (SELECT unnest([-5e0, 7e0, 33e0, 61e0, 400e0]) AS x)),
    n AS (SELECT p.*, max(b.distance_m) FILTER (b.distance_m < travel_m) AS d0, min(b.distance_m) FILTER (b.distance_m >= travel_m) AS d1, arg_max(b.elevation_m, b.distance_m) FILTER (b.distance_m < travel_m) AS e0, arg_min(b.elevation_m, b.distance_m) FILTER (b.distance_m >= travel_m) AS e1
      FROM p JOIN buckets b ON b.segment_id = p.segment_id AND b.direction = p.direction GROUP BY 1, 2, 3)
    SELECT segment_id, direction, travel_m, round(CASE WHEN d0 IS NULL THEN e1 WHEN d1 IS NULL THEN e0 ELSE e0 + (travel_m - d0) / (d1 - d0) * (e1 - e0) END, 6) AS height_m FROM n""")
def _(buckets):
    points = buckets.select("segment_id", "direction").distinct().select("*", F.explode(F.array(*[F.lit(x) for x in (-5.0, 7.0, 33.0, 61.0, 400.0)])).alias("travel_m"))
    return rounded(M.heights_at(buckets, points), "height_m")


@query("model_discard_reach", "runs lines", """WITH q AS (SELECT r.*, greatest(0e0, from_m) AS a, least(length_m, to_m) AS b FROM runs r), k AS (SELECT session_id, segment_id, direction, greatest(0e0, max(b) - min(a)) AS span, count(*) AS runs_on_line FROM q GROUP BY 1, 2, 3)
    SELECT q.match_id, runs_on_line, round(span, 6) AS stitched_span_m, span >= 25 OR span / length_m >= 0.7e0 AS stitched_qualifies FROM q JOIN k ON k.session_id = q.session_id AND k.segment_id = q.segment_id AND k.direction = q.direction WHERE NOT (span_m >= 25 OR span_m / length_m >= 0.7e0)""")
def _(runs, lines):
    rows = M.assess(runs.withColumn("covered_from_m", F.greatest(F.lit(0.0), "from_m")).withColumn("covered_to_m", F.least("length_m", "to_m")))
    return rounded(R.reach(rows).where("NOT qualified").select("match_id", "runs_on_line", "stitched_span_m", "stitched_qualifies"), "stitched_span_m")


# --- sessions and quality

STEPS = f"""stp AS (SELECT session_id, id, {hav('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS ground_m, abs(elevation_m - lag(elevation_m) OVER w) AS rise_m FROM samples WINDOW w AS (PARTITION BY session_id ORDER BY recorded_at)),
    bad AS (SELECT session_id, avg(CASE WHEN rise_m / ground_m * 100 > 100 THEN 1e0 ELSE 0e0 END) AS bad_share FROM stp WHERE ground_m > 1 GROUP BY 1)"""


@query("session_step_grades", "samples", f"WITH {STEPS} SELECT session_id, id, round(ground_m, 5) AS ground_m, round(rise_m / nullif(ground_m, 0) * 100, 4) AS grade_pct FROM stp")
def _(samples):
    return rounded(rounded(R.step_grades(samples).select("session_id", "id", "ground_m", "grade_pct"), "ground_m", places=5), "grade_pct", places=4)


@query("session_verdicts", "sessions samples", f"""WITH {STEPS}, o AS (SELECT session_id, count(id) AS samples, min(elevation_m) AS min_elev, count(elevation_source) AS labelled FROM samples GROUP BY 1)
    SELECT o.session_id, samples, round(min_elev, 6) AS min_elev, labelled, round(bad_share, 6) AS bad_share, coalesce(min_elev >= 1000, false) AS scale_ok, labelled > 0 OR coalesce(bad_share <= 0.15, true) AS plausible_ok,
    coalesce(min_elev >= 1000, false) AND (labelled > 0 OR coalesce(bad_share <= 0.15, true)) AS usable FROM sessions s JOIN o ON o.session_id = s.id LEFT JOIN bad ON bad.session_id = s.id""")
def _(sessions, samples):
    return rounded(R.session_verdicts(sessions, samples).drop("why_skipped"), "min_elev", "bad_share")


@query("session_empty", "sessions samples runs", "SELECT id FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM samples x WHERE x.session_id = s.id) AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.session_id = s.id)")
def _(sessions, samples, runs):
    return R.empty_sessions(sessions, samples, runs).select("id")


@query("session_unmatched", "sessions samples runs", "SELECT id FROM sessions s WHERE EXISTS (SELECT 1 FROM samples x WHERE x.session_id = s.id) AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.session_id = s.id)")
def _(sessions, samples, runs):
    return R.unmatched_sessions(sessions, samples, runs).select("id")


@query("session_padded_boxes", "samples", "SELECT session_id, round(min(lon) - 0.005, 8) AS min_lon, round(min(lat) - 0.005, 8) AS min_lat, round(max(lon) + 0.005, 8) AS max_lon, round(max(lat) + 0.005, 8) AS max_lat FROM samples GROUP BY 1")
def _(samples):
    rows = samples.groupBy("session_id").agg((F.min("lon") - 0.005).alias("min_lon"), (F.min("lat") - 0.005).alias("min_lat"), (F.max("lon") + 0.005).alias("max_lon"), (F.max("lat") + 0.005).alias("max_lat"))
    return rounded(rows, "min_lon", "min_lat", "max_lon", "max_lat", places=8)


@query("session_ride_extent", "samples", f"""WITH f AS (SELECT session_id, {hav('first_value(lon) OVER w', 'first_value(lat) OVER w', 'lon', 'lat')} AS m FROM samples WINDOW w AS (PARTITION BY session_id ORDER BY recorded_at))
    SELECT session_id, round(max(m), 5) AS extent_m, max(m) >= 75 AS saveable FROM f GROUP BY 1""")
def _(samples):
    return rounded(W.ride_extents(samples), "extent_m", places=5)


OBS = "obs AS (SELECT session_id, segment_id, direction, distance_m, elevation_m, epoch_us(recorded_at) / 1e6 AS at_s FROM pass_buckets)"


def _observations(passes: DataFrame) -> DataFrame:
    return passes.select("session_id", "segment_id", "direction", "distance_m", "elevation_m", (S.micros(F.col("recorded_at")) / 1e6).alias("at_s"))


@query("quality_self", "run_fixes", f"""WITH o AS (SELECT session_id % 50 AS session_id, segment_id, direction, {BUCKET} AS distance_m, elevation_m, epoch_us(recorded_at) / 1e6 AS at_s FROM run_fixes)
    SELECT segment_id, direction, distance_m, session_id, round(abs(arg_max(elevation_m, row(at_s, elevation_m)) - arg_min(elevation_m, row(at_s, elevation_m))), 6) AS off_m FROM o GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2 AND max(at_s) - min(at_s) >= 300""")
def _(fixes):
    o = fixes.select((F.col("session_id") % 50).alias("session_id"), "segment_id", "direction", S.bucket(F.col("along_m")).alias("distance_m"), "elevation_m", (S.micros(F.col("recorded_at")) / 1e6).alias("at_s"))
    return rounded(R.measure("self-consistency", o, None), "off_m")


@query("quality_cross_ride", "pass_buckets", """WITH m AS (SELECT segment_id, direction, distance_m, avg(elevation_m) AS a, count(DISTINCT session_id) AS r FROM pass_buckets GROUP BY 1, 2, 3)
    SELECT p.segment_id, p.direction, p.distance_m, round(avg(abs(elevation_m - a)), 6) AS off_m FROM pass_buckets p JOIN m ON m.segment_id = p.segment_id AND m.direction = p.direction AND m.distance_m = p.distance_m WHERE r >= 2 GROUP BY 1, 2, 3""")
def _(passes):
    return rounded(R.measure("cross-ride", _observations(passes), None), "off_m")


TERRAIN = "ter AS (SELECT p.segment_id, p.direction, p.distance_m, p.session_id, epoch_us(p.recorded_at) / 1e6 AS at_s, abs(p.elevation_m - d.dem_m) AS off_m FROM pass_buckets p JOIN dem d ON d.segment_id = p.segment_id AND d.direction = p.direction AND d.distance_m = p.distance_m)"


@query("quality_terrain", "pass_buckets dem", f"WITH {TERRAIN} SELECT segment_id, direction, distance_m, session_id, at_s, round(off_m, 6) AS off_m FROM ter")
def _(passes, dem):
    return rounded(R.measure("terrain", _observations(passes), dem), "off_m")


def summary_sql(rows: str, value: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    by = f" GROUP BY {keys}" if keys else ""
    return f"SELECT {k}n, non_finite, round(s[CAST(least(len(s) - 1, floor(len(s) * 0.5e0)) AS INT) + 1], 6) AS median, round(mean, 6) AS mean, round(s[CAST(least(len(s) - 1, floor(len(s) * 0.9e0)) AS INT) + 1], 6) AS p90, round(s[len(s)], 6) AS worst FROM (SELECT {k}count(*) AS n, CAST(0 AS BIGINT) AS non_finite, avg({value}) AS mean, list_sort(list({value})) AS s FROM {rows}{by})"


@query("quality_summary", "pass_buckets dem", f"WITH {TERRAIN} {summary_sql('ter', 'off_m')}")
def _(passes, dem):
    return rounded(R.summary(R.measure("terrain", _observations(passes), dem), "off_m"), "median", "mean", "p90", "worst")


@query("quality_summary_by_line", "pass_buckets dem", f"WITH {TERRAIN} {summary_sql('ter', 'off_m', 'segment_id')}")
def _(passes, dem):
    return rounded(R.summary(R.measure("terrain", _observations(passes), dem), "off_m", ["segment_id"]), "median", "mean", "p90", "worst")


@query("quality_shape_error", "pass_buckets dem", f"WITH {RESIDUALS}, m AS (SELECT segment_id, median(r) AS m FROM res GROUP BY 1 HAVING count(r) >= 10) SELECT res.segment_id, round(median(abs(r - m)), 6) AS shape_m FROM res JOIN m ON m.segment_id = res.segment_id GROUP BY 1")
def _(passes, dem):
    return rounded(R.shape_errors(M.residuals(passes, dem), "segment_id"), "shape_m")


@query("quality_spread", "pass_buckets", "SELECT segment_id, direction, distance_m, round(max(elevation_m) - min(elevation_m), 6) AS spread_m, count(DISTINCT session_id) AS rides FROM pass_buckets GROUP BY 1, 2, 3")
def _(passes):
    return rounded(R.spreads(passes, ["segment_id", "direction", "distance_m"]), "spread_m")


@query("quality_span_histogram", "runs", "SELECT CASE WHEN span_m <= 0 THEN '<=0' WHEN span_m <= 25 THEN '<=25' WHEN span_m <= 75 THEN '<=75' ELSE 'more' END AS band, count(*) AS n FROM runs GROUP BY 1")
def _(runs):
    return R.histogram(runs, F.col("span_m"), [0, 25, 75])


@query("model_diff", "pass_buckets", """WITH a AS (SELECT segment_id, direction, distance_m, avg(elevation_m) AS e FROM pass_buckets WHERE session_id % 3 <> 0 GROUP BY 1, 2, 3), b AS (SELECT segment_id, direction, distance_m, avg(elevation_m) AS e FROM pass_buckets WHERE session_id % 3 <> 1 GROUP BY 1, 2, 3)
    SELECT coalesce(a.segment_id, b.segment_id) AS segment_id, coalesce(a.direction, b.direction) AS direction, coalesce(a.distance_m, b.distance_m) AS distance_m, CASE WHEN a.e IS NULL THEN 'added' WHEN b.e IS NULL THEN 'removed' ELSE 'shared' END AS change, round(abs(b.e - a.e), 6) AS moved_m
    FROM a FULL JOIN b ON a.segment_id = b.segment_id AND a.direction = b.direction AND a.distance_m = b.distance_m""")
def _(passes):
    a, b = (M.bucket_model(passes.where(F.col("session_id") % 3 != k)) for k in (0, 1))
    return rounded(R.model_diff(a, b).drop("before_m", "after_m"), "moved_m")


RIDDEN = ", ".join(f"{name} AS (SELECT segment_id, direction FROM runs WHERE session_id % 2 = {k} GROUP BY 1, 2 HAVING count(*) >= (SELECT count(*) / count(DISTINCT (segment_id, direction)) FROM runs WHERE session_id % 2 = {k}))" for k, name in enumerate("ab"))


def _ridden(runs: DataFrame, k: int) -> DataFrame:
    """Lines that even (0) or odd (1) sessions ride as often as their mean line or more."""
    counts = runs.where(F.col("session_id") % 2 == k).groupBy("segment_id", "direction").agg(F.count("*").alias("rides"))
    mean = counts.agg(F.avg("rides")).first()[0] or 0.0
    return counts.where(F.col("rides") >= mean).select("segment_id", "direction")


@query("model_changed_lines", "runs", f"""WITH {RIDDEN}
    SELECT segment_id, direction, 'lost' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT segment_id, direction, 'gained' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def _(runs):
    return R.changed_lines(*[_ridden(runs, k) for k in (0, 1)])


@query("model_witness_disagreement", "runs", f"""WITH {RIDDEN}, s AS (SELECT segment_id FROM a INTERSECT SELECT segment_id FROM b)
    SELECT segment_id, direction, 'lost' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) WHERE segment_id IN (FROM s) UNION ALL SELECT segment_id, direction, 'gained' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) WHERE segment_id IN (FROM s)""")
def _(runs):
    return R.witness_disagreement(*[_ridden(runs, k) for k in (0, 1)])


@query("table_text_fingerprint", "buckets", """WITH h AS (SELECT md5(concat_ws('|', CAST(segment_id AS VARCHAR), direction, CAST(distance_m AS VARCHAR), CAST(sample_count AS VARCHAR))) AS h FROM buckets),
    f AS (SELECT substr(h, 1, 6) AS digits, count(*) AS n, md5(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1), c AS (SELECT substr(digits, 1, 3) AS digits, sum(n) AS n, md5(string_agg(digits || h, '' ORDER BY digits || h)) AS h FROM f GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS row_count, md5(string_agg(digits || h, '' ORDER BY digits || h)) AS fingerprint FROM c""")
def _(buckets):
    return R.text_fingerprint(buckets, ["segment_id", "direction", "distance_m", "sample_count"])


@query("table_fingerprint", "buckets")
def _(buckets):
    return R.fingerprint(buckets.select("segment_id", "direction", "distance_m", "sample_count"))


# --- ordered sequences


@query("ride_derived_headings", "samples", """WITH n AS (SELECT session_id, id, coalesce(lag(lon) OVER w, lon) AS ax, coalesce(lag(lat) OVER w, lat) AS ay, coalesce(lead(lon) OVER w, lon) AS bx, coalesce(lead(lat) OVER w, lat) AS cy FROM samples WINDOW w AS (PARTITION BY session_id ORDER BY recorded_at)),
    d AS (SELECT session_id, id, (bx - ax) * 111320 * cos(radians(ay)) AS x, (cy - ay) * 111320 AS y FROM n) SELECT session_id, id, round(CASE WHEN sqrt(x * x + y * y) >= 6 THEN (degrees(atan2(x, y)) + 360) % 360 END, 5) AS derived_deg FROM d""")
def _(samples):
    return rounded(W.derived_headings(samples).select("session_id", "id", "derived_deg"), "derived_deg", places=5)


SPIKES = """sp AS (SELECT session_id, id, lon, lat, lag(lon) OVER w AS ax, lag(lat) OVER w AS ay, lead(lon) OVER w AS bx, lead(lat) OVER w AS by_, epoch_us(recorded_at) - lag(epoch_us(recorded_at)) OVER w AS t1, lead(epoch_us(recorded_at)) OVER w - epoch_us(recorded_at) AS t2 FROM samples WINDOW w AS (PARTITION BY session_id ORDER BY recorded_at)),
    v AS (SELECT session_id, id, (bx - ax) * 111320 * cos(radians(ay)) AS cx, (by_ - ay) * 111320 AS cy, (lon - ax) * 111320 * cos(radians(ay)) AS sx, (lat - ay) * 111320 AS sy, (bx - lon) * 111320 * cos(radians(lat)) AS ox, (by_ - lat) * 111320 AS oy, t1 / 1e6 AS t1, t2 / 1e6 AS t2 FROM sp WHERE t1 IS NOT NULL AND t2 IS NOT NULL),
    ms AS (SELECT session_id, id, CASE WHEN sqrt(cx * cx + cy * cy) < 2 THEN sqrt(sx * sx + sy * sy) ELSE abs(cx * sy - cy * sx) / sqrt(cx * cx + cy * cy) END AS cross_m, CASE WHEN sqrt(cx * cx + cy * cy) < 2 THEN 0e0 ELSE (cx * sx + cy * sy) / sqrt(cx * cx + cy * cy) END AS along_m, sqrt(cx * cx + cy * cy) AS chord_m,
      greatest(sqrt(sx * sx + sy * sy) / t1, sqrt(ox * ox + oy * oy) / t2) AS implied_mps, t1 + t2 AS span_s FROM v)"""


@query("ride_spike_measures", "samples", f"WITH {SPIKES} SELECT session_id, id, round(cross_m, 5) AS cross_m, round(along_m, 4) + 0e0 AS along_m, round(chord_m, 5) AS chord_m, round(implied_mps, 6) AS implied_mps, round(span_s, 6) AS span_s FROM ms")
def _(samples):
    rows = W.spike_measures(samples)
    return rounded(rounded(rounded(rows, "cross_m", "chord_m", places=5), "along_m", places=4), "implied_mps", "span_s")


@query("ride_spike_census", "samples", f"WITH {SPIKES} SELECT c AS min_cross_m, r AS ratio, count(*) FILTER (cross_m >= c AND (chord_m <= 0 OR cross_m / chord_m >= r)) AS spikes, count(*) AS fixes FROM ms, (SELECT unnest([10e0, 60e0, 200e0]) AS c), (SELECT unnest([0.5e0, 1e0]) AS r) GROUP BY 1, 2")
def _(samples):
    return W.spike_census(W.spike_measures(samples), [10, 60, 200], [0.5, 1])


TRANS = "tr AS (SELECT * FROM (SELECT session_id, segment_id, direction, lead(segment_id) OVER w AS next_segment_id, lead(direction) OVER w AS next_direction FROM runs WINDOW w AS (PARTITION BY session_id ORDER BY started_at, match_id)) WHERE next_segment_id IS NOT NULL)"


@query("ride_transitions", "runs", f"WITH {TRANS} SELECT * FROM tr")
def _(runs):
    return W.transitions(runs)


@query("ride_transition_counts", "runs", f"WITH {TRANS} SELECT segment_id, direction, next_segment_id, next_direction, count(DISTINCT session_id) AS rides FROM tr GROUP BY 1, 2, 3, 4")
def _(runs):
    return W.transition_rides(W.transitions(runs))


LINE_RUNS = "lr AS (SELECT session_id % 40 AS session_id, segment_id, direction, match_id, fixes, started_at, ended_at FROM runs)"


def _line_runs(runs: DataFrame) -> DataFrame:
    return runs.select((F.col("session_id") % 40).alias("session_id"), "segment_id", "direction", "match_id", "fixes", "started_at", "ended_at")


GAPS = "gp AS (SELECT *, (epoch_us(started_at) - epoch_us(lag(ended_at) OVER w)) / 1e6 AS gap_s FROM lr WINDOW w AS (PARTITION BY session_id, segment_id, direction ORDER BY started_at, ended_at, match_id))"


@query("run_stitching", "runs", f"""WITH {LINE_RUNS}, {GAPS}, isl AS (SELECT *, sum(CASE WHEN gap_s <= 8640000 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, segment_id, direction ORDER BY started_at, ended_at, match_id) AS island FROM gp)
    SELECT session_id, segment_id, direction, CAST(island AS BIGINT) AS island, min(match_id) AS match_id, epoch_us(min(started_at)) AS started_us, epoch_us(max(ended_at)) AS ended_us, CAST(sum(fixes) AS BIGINT) AS fixes, count(*) AS parts FROM isl GROUP BY 1, 2, 3, 4""")
def _(runs):
    rows = W.stitched(_line_runs(runs), 8_640_000)
    return rows.select("session_id", "segment_id", "direction", "island", "match_id", S.micros(F.col("started_at")).alias("started_us"), S.micros(F.col("ended_at")).alias("ended_us"), "fixes", "parts")


@query("run_gaps", "runs", f"WITH {LINE_RUNS}, {GAPS} SELECT match_id, gap_s AS gap_to_previous_s FROM gp")
def _(runs):
    return W.gaps_to_previous(_line_runs(runs)).select("match_id", "gap_to_previous_s")


HOLES = "bk AS (SELECT segment_id, direction, distance_m FROM buckets WHERE (segment_id + distance_m / 15) % 3 <> 0), ho AS (SELECT * FROM (SELECT segment_id, direction, distance_m AS from_m, lead(distance_m) OVER (PARTITION BY segment_id, direction ORDER BY distance_m) AS to_m FROM bk) WHERE to_m - from_m > 15)"


def _holes(buckets: DataFrame) -> DataFrame:
    return W.interior_holes(buckets.where((F.col("segment_id") + F.col("distance_m") / 15) % 3 != 0))


@query("line_holes", "buckets", f"WITH {HOLES} SELECT segment_id, direction, from_m, to_m, to_m - from_m AS gap_m, CAST(floor((to_m - from_m) / 15 + 0.5) - 1 AS INT) AS missing FROM ho")
def _(buckets):
    return _holes(buckets)


@query("line_hole_tally", "buckets", f"WITH {HOLES} SELECT count(DISTINCT (segment_id, direction)) AS lines, count(*) AS holes, CAST(sum(to_m - from_m) AS BIGINT) AS metres FROM ho")
def _(buckets):
    return W.hole_tally(_holes(buckets))


@query("line_hole_straddles", "buckets run_fixes", f"""WITH {HOLES}, pl AS (SELECT *, epoch_us(recorded_at) / 1e6 AS at_s, CAST(floor(along_m / 15 + 0.5e0) AS INT) * 15 AS b FROM run_fixes),
    pr AS (SELECT segment_id, direction, least(b, a) AS lo, greatest(b, a) AS hi, at_s - was AS gap_s FROM (SELECT segment_id, direction, b, at_s, lag(b) OVER w AS a, lag(at_s) OVER w AS was FROM pl WINDOW w AS (PARTITION BY match_id ORDER BY at_s, along_m)) WHERE a IS NOT NULL)
    SELECT ho.segment_id, ho.direction, from_m, to_m, min(gap_s) AS gap_s FROM ho JOIN pr ON pr.segment_id = ho.segment_id AND pr.direction = ho.direction AND lo <= from_m AND hi >= to_m GROUP BY 1, 2, 3, 4""")
def _(buckets, fixes):
    placed = fixes.select("match_id", "segment_id", "direction", (S.micros(F.col("recorded_at")) / 1e6).alias("at_s"), "along_m", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    return W.straddling_pairs(_holes(buckets), placed).drop("ground_m")


@query("barometer_repeats", "samples", """SELECT session_id, round(avg(CASE WHEN e IS NULL THEN NULL WHEN e = elevation_m THEN 1e0 ELSE 0e0 END), 6) AS repeat_share, round(avg(CASE WHEN elevation_source = 'barometer' AND s = 'barometer' THEN CASE WHEN e = elevation_m THEN 1e0 ELSE 0e0 END END), 6) AS barometer_repeat_share
    FROM (SELECT *, lag(elevation_m) OVER w AS e, lag(elevation_source) OVER w AS s FROM samples WINDOW w AS (PARTITION BY session_id ORDER BY recorded_at)) GROUP BY 1""")
def _(samples):
    return rounded(W.repeat_shares(samples), "repeat_share", "barometer_repeat_share")


ISLANDS = """sq AS (SELECT session_id, epoch_us(recorded_at) / 1e6 AS s, coalesce(elevation_source = 'gps', false) AS gps, lag(epoch_us(recorded_at) / 1e6) OVER w AS bf, lead(epoch_us(recorded_at) / 1e6) OVER w AS af, row_number() OVER w AS i FROM samples WINDOW w AS (PARTITION BY session_id ORDER BY recorded_at)),
    br AS (SELECT session_id, least({u}e0, greatest({m}e0, coalesce(median(s - bf), {m}e0) * 2)) AS bracket FROM sq GROUP BY 1), gi AS (SELECT *, i - row_number() OVER (PARTITION BY session_id ORDER BY i) AS island FROM sq WHERE gps),
    ga AS (SELECT session_id, island, count(*) AS fixes, min(s) AS a, max(s) AS b, arg_min(bf, i) AS lead_in, arg_max(af, i) AS lead_out FROM gi GROUP BY 1, 2),
    isl AS (SELECT ga.session_id, fixes, a AS started_s, b AS ended_s, b - a AS own_s, b - a + CASE WHEN lead_in IS NULL OR a - lead_in >= {u} THEN 0e0 ELSE least(a - lead_in, bracket) END + CASE WHEN lead_out IS NULL OR lead_out - b >= {u} THEN 0e0 ELSE least(lead_out - b, bracket) END AS seconds FROM ga JOIN br ON br.session_id = ga.session_id)"""


@query("barometer_gps_islands", "samples", f"WITH {ISLANDS.format(u=100000, m=1000)} SELECT session_id, fixes, round(started_s, 3) AS started_s, round(ended_s, 3) AS ended_s, round(own_s, 3) AS own_s, round(seconds, 3) AS seconds FROM isl")
def _(samples):
    return rounded(W.gps_islands(samples, 100_000, 1000), "started_s", "ended_s", "own_s", "seconds", places=3)


@query("barometer_verdicts", "samples", f"""WITH {ISLANDS.format(u=100000, m=2)}, b AS (SELECT session_id, count(elevation_source) AS labelled, count(*) FILTER (elevation_source = 'barometer') AS baro FROM samples GROUP BY 1), g AS (SELECT session_id, coalesce(sum(s - bf) FILTER (s - bf >= 100000), 0) / sum(s - bf) AS u FROM sq GROUP BY 1),
    r AS (SELECT session_id, avg(CASE WHEN elevation_source = 'barometer' AND s = 'barometer' THEN CASE WHEN e = elevation_m THEN 1e0 ELSE 0e0 END END) AS r FROM (SELECT *, lag(elevation_m) OVER w AS e, lag(elevation_source) OVER w AS s FROM samples WINDOW w AS (PARTITION BY session_id ORDER BY recorded_at)) GROUP BY 1),
    l AS (SELECT session_id, count(*) FILTER (seconds >= 250000) AS n FROM isl GROUP BY 1)
    SELECT b.session_id, CASE WHEN labelled = 0 THEN 'unlabelled' WHEN baro = 0 THEN 'no-barometer' WHEN r > 0.2 THEN 'claimed-but-stuck' WHEN n > 0 THEN 'stopped' WHEN u >= 0.5 THEN 'unmeasured' ELSE 'alive' END AS verdict
    FROM b JOIN g ON g.session_id = b.session_id JOIN r ON r.session_id = b.session_id LEFT JOIN l ON l.session_id = b.session_id""")
def _(samples):
    return W.barometer_reports(samples, long_run_s=250_000, unmeasured_s=100_000).select("session_id", "verdict")


@query("barometer_source_strips", "samples", """WITH r AS (SELECT session_id, CAST(floor((epoch_us(recorded_at) / 1e6 - min(epoch_us(recorded_at) / 1e6) OVER (PARTITION BY session_id)) / 86400) AS INT) AS slot, elevation_source FROM samples), c AS (SELECT session_id, slot, avg(CASE WHEN elevation_source = 'barometer' THEN 1e0 ELSE 0e0 END) AS share FROM r WHERE elevation_source IS NOT NULL GROUP BY 1, 2),
    a AS (SELECT session_id, unnest(generate_series(0, max(slot))) AS slot FROM c GROUP BY 1) SELECT a.session_id, string_agg(CASE WHEN share IS NULL THEN '.' WHEN share = 1 THEN 'B' WHEN share = 0 THEN 'g' ELSE CAST(CAST(floor(share * 10 + 0.5) AS INT) AS VARCHAR) END, '' ORDER BY a.slot) AS strip FROM a LEFT JOIN c ON c.session_id = a.session_id AND c.slot = a.slot GROUP BY 1""")
def _(samples):
    return W.source_strips(samples, 86_400)


@query("barometer_recent_share", "samples", """SELECT session_id, id, round(avg(CASE WHEN elevation_source = 'barometer' THEN 1e0 ELSE 0e0 END) OVER l, 6) AS share, (epoch_us(recorded_at) - min(epoch_us(recorded_at)) OVER (PARTITION BY session_id)) / 1e6 >= 20 AND count(*) OVER l >= 5 AND sum(CASE WHEN elevation_source = 'barometer' THEN 1e0 ELSE 0e0 END) OVER l = 0 AS abandon
    FROM samples WINDOW l AS (PARTITION BY session_id ORDER BY recorded_at ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def _(samples):
    return rounded(W.recent_shares(samples), "share")


@query("barometer_fused_altitude", "samples", """SELECT session_id, id, round(elevation_m - first_value(elevation_m) OVER w + coalesce(first_value(CASE WHEN elevation_source = 'gps' THEN elevation_m END IGNORE NULLS) OVER w, 0), 6) + 0e0 AS fused_m FROM samples WINDOW w AS (PARTITION BY session_id ORDER BY recorded_at ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def _(samples):
    return rounded(W.windowed_altitude(samples), "fused_m")
