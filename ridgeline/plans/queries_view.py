"""More registered queries: viewports, previews, selections under a cursor, lost passes, reports of the largest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import geo as G
from ridgeline.functions import scalar as S
from ridgeline.operators import diagnose as D
from ridgeline.operators import model as M
from ridgeline.operators import relational as R
from ridgeline.operators import selection as L
from ridgeline.operators import windows as W
from ridgeline.plans.queries import HOLES, STOPS, _holes, color_sql, query, rounded
from ridgeline.plans.queries_more import SP, _spans

# --- boxes

_BOX = "least({0}lon0, {0}lon1) AS x0, least({0}lat0, {0}lat1) AS y0, greatest({0}lon0, {0}lon1) AS x1, greatest({0}lat0, {0}lat1) AS y1"


@query("filter_inside_box", "segments", """WITH w AS (SELECT osm_way_id, min(least(lon0, lon1)) AS x0, min(least(lat0, lat1)) AS y0, max(greatest(lon0, lon1)) AS x1, max(greatest(lat0, lat1)) AS y1 FROM segments GROUP BY 1)
    SELECT id FROM segments s JOIN w ON w.osm_way_id = s.osm_way_id WHERE lat0 BETWEEN y0 + 150 / 111320e0 AND y1 - 150 / 111320e0 AND lon0 BETWEEN x0 + 150 / (111320 * cos(radians((y0 + y1) / 2))) AND x1 - 150 / (111320 * cos(radians((y0 + y1) / 2)))""")
def _(segments):
    ways = segments.groupBy("osm_way_id").agg(F.min(F.least("lon0", "lon1")).alias("x0"), F.min(F.least("lat0", "lat1")).alias("y0"), F.max(F.greatest("lon0", "lon1")).alias("x1"), F.max(F.greatest("lat0", "lat1")).alias("y1"))
    c = F.col
    return segments.join(ways, "osm_way_id").where(G.inside_box(c("lon0"), c("lat0"), c("x0"), c("y0"), c("x1"), c("y1"), 150)).select("id")


@query("viewport_covered", "segments", f"""WITH v AS (SELECT id, {_BOX.format("")} FROM segments), p AS (SELECT id, x0 - abs(x1 - x0) * 0.2e0 AS a, y0 - abs(y1 - y0) * 0.2e0 AS b, x1 + abs(x1 - x0) * 0.2e0 AS c, y1 + abs(y1 - y0) * 0.2e0 AS d FROM v)
    SELECT p.id, round(a, 9) AS min_lon, round(d, 9) AS max_lat, a <= s.lon1 AND b <= s.lat1 AND c >= s.lon1 AND d >= s.lat1 AS covered FROM p JOIN segments s ON s.id = p.id + 50""")
def _(segments):
    c = F.col
    views = segments.select((c("id") + 50).alias("next"), c("id").alias("view"), *[x.alias(n) for n, x in zip("abcd", G.padded_view(c("lon0"), c("lat0"), c("lon1"), c("lat1")), strict=True)])
    end = (c("lon1"), c("lat1"), c("lon1"), c("lat1"))
    rows = segments.join(views, segments["id"] == views["next"]).select(c("view").alias("id"), c("a").alias("min_lon"), c("d").alias("max_lat"), G.covers((c("a"), c("b"), c("c"), c("d")), end).alias("covered"))
    return rounded(rows, "min_lon", "max_lat", places=9)


@query("viewport_stops", "buckets coverage lines pass_buckets", f"WITH {STOPS} SELECT segment_id, direction, round(from_m, 6) AS from_m, round(to_m, 6) AS to_m, round(fraction, 6) + 0e0 AS fraction, round(slope_pct, 5) + 0e0 AS slope_pct FROM st")
def _(buckets, coverage, lines, passes):
    nested = M.viewport(lines, buckets, coverage, passes).select("segment_id", F.explode("lines").alias("l")).select("segment_id", "l.direction", "l.from_m", "l.to_m", F.explode("l.stops").alias("s"))
    return rounded(rounded(nested.select("segment_id", "direction", "from_m", "to_m", "s.fraction", "s.slope_pct"), "from_m", "to_m", "fraction"), "slope_pct", places=5)


# --- selections

_PIECES = "pc AS (SELECT path_id, piece AS i, sum(length_m) AS length_m FROM spans GROUP BY 1, 2), pi AS (SELECT *, coalesce(sum(length_m) OVER (PARTITION BY path_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_m FROM pc)"


def _pieces(spans: DataFrame) -> DataFrame:
    return W.running_metres(spans.groupBy("path_id", F.col("piece").alias("i")).agg(F.sum("length_m").alias("length_m")))


@query("selection_preview", "spans", f"""WITH {SP}, t AS (SELECT path_id, sum(length_m) AS g FROM spans GROUP BY 1), r AS (SELECT path_id, at_m / g AS a, coalesce(lead(at_m / g) OVER (PARTITION BY path_id ORDER BY i), 1e0) AS b, {color_sql("slope_pct")} AS color FROM sp JOIN t USING (path_id)),
    d AS (SELECT r.path_id, g, color, CASE WHEN path_id % 2 = 0 THEN a ELSE 1 - b END AS a, CASE WHEN path_id % 2 = 0 THEN b ELSE 1 - a END AS b, CASE WHEN path_id % 2 = 0 THEN 0.375e0 ELSE 0.625e0 END AS s FROM r JOIN t USING (path_id) WHERE b > a)
    SELECT path_id, round((greatest(a, s) - s) * g, 5) + 0e0 AS at_m, round((b - greatest(a, s)) * g, 5) + 0e0 AS length_m, color, 'line' AS source FROM d WHERE b > s""")
def _(spans):
    whole = spans.groupBy("path_id").agg(F.sum("length_m").alias("geometry_m"))
    stops = _spans(spans).join(whole, "path_id").select("path_id", "i", (F.col("at_m") / F.col("geometry_m")).alias("fraction"), "color")
    lines = whole.select("path_id", F.when(F.col("path_id") % 2 == 0, "forward").otherwise("backward").alias("direction"), "geometry_m", (F.col("geometry_m") * 0.375).alias("pressed_m"))
    return rounded(L.previews(lines, stops), "at_m", "length_m", places=5)


@query("selection_problems", "spans", f"""WITH {SP}, {_PIECES}, pp AS (SELECT path_id, i, length_m, CASE WHEN path_id % 3 = 0 AND i = 2 THEN at_m + 0.5 ELSE at_m END AS at_m, at_m AS due FROM pi), ss AS (SELECT path_id, piece, i, length_m, rise_m, CASE WHEN path_id % 7 = 0 AND i = 3 THEN height_m + 1 ELSE height_m END AS height_m FROM sp WHERE NOT (path_id % 5 = 0 AND source = 'twin')),
    f AS (SELECT path_id, piece, sum(length_m) AS m FROM ss GROUP BY 1, 2), n AS (SELECT path_id, lead(height_m) OVER (PARTITION BY path_id ORDER BY i) - height_m - rise_m AS step FROM ss), c AS (SELECT path_id, sum(rise_m) AS net, min_by(height_m, i) AS a, max_by(height_m + rise_m, i) AS b FROM ss GROUP BY 1),
    o AS (SELECT path_id, 'tiles' AS problem FROM pp WHERE abs(at_m - due) > 0.01 UNION ALL SELECT pp.path_id, 'spans' FROM pp LEFT JOIN f ON f.path_id = pp.path_id AND f.piece = pp.i WHERE abs(pp.length_m - coalesce(m, 0)) > 0.01 UNION ALL SELECT path_id, 'heights' FROM n WHERE abs(step) > 0.01 UNION ALL SELECT path_id, 'card' FROM c WHERE abs(b - a - net) > 0.01)
    SELECT path_id, problem, count(*) AS n FROM o GROUP BY 1, 2""")
def _(spans):
    pieces = _pieces(spans).withColumn("at_m", F.when((F.col("path_id") % 3 == 0) & (F.col("i") == 2), F.col("at_m") + 0.5).otherwise(F.col("at_m")))
    bad = _spans(spans).where(~((F.col("path_id") % 5 == 0) & (F.col("source") == "twin")))
    return L.problems(pieces, bad.withColumn("height_m", F.when((F.col("path_id") % 7 == 0) & (F.col("i") == 3), F.col("height_m") + 1).otherwise(F.col("height_m"))))


@query("selection_profile_at", "spans", f"""WITH {SP}, t AS (SELECT path_id, sum(length_m) AS g FROM spans GROUP BY 1), q AS (SELECT path_id, k * g / 8 AS m, greatest(0e0, least(g, k * g / 8)) AS x FROM t, (SELECT unnest([-1, 0, 3, 5, 9]) AS k))
    SELECT q.path_id, round(m, 6) + 0e0 AS m, round(x, 6) + 0e0 AS at_m, round(height_m + rise_m * greatest(0e0, least(length_m, x - at_m)) / length_m, 8) + 0e0 AS height_m, CASE WHEN source <> 'none' THEN slope_pct END AS grade_pct FROM q ASOF JOIN sp ON sp.path_id = q.path_id AND q.x >= sp.at_m""")
def _(spans):
    points = spans.groupBy("path_id").agg(F.sum("length_m").alias("g")).select("path_id", F.explode(F.array(*[F.col("g") * k / 8 for k in (-1, 0, 3, 5, 9)])).alias("m"))
    return rounded(rounded(L.profile_at(_spans(spans), points), "m", "at_m"), "height_m", places=8)


@query("selection_features", "spans", f"""WITH {SP}, {_PIECES} SELECT pi.path_id, i AS piece, at_m AS start_m, at_m + length_m AS end_m, '#6b7280' AS color, true AS no_data, 0e0 AS from_fraction, 1e0 AS to_fraction FROM pi WHERE path_id % 4 = 0
    UNION ALL SELECT pi.path_id, pi.i, pi.at_m, pi.at_m + pi.length_m / 2, 'k', false, 0e0, 0.5e0 FROM pi WHERE path_id % 4 <> 0""")
def _(spans):
    pieces = _pieces(spans)
    half = pieces.where("path_id % 4 <> 0").select("path_id", F.col("i").alias("piece"), F.col("at_m").alias("start_m"), (F.col("at_m") + F.col("length_m") / 2).alias("end_m"), F.lit("k").alias("color"), F.lit(False).alias("no_data"))
    return rounded(L.piece_features(pieces, half), "from_fraction", "to_fraction")


# --- why passes were lost

_LOST = """WITH r AS (SELECT session_id, segment_id, direction, epoch_us(started_at) / 1e6 AS s, epoch_us(ended_at) / 1e6 AS e, match_id % 3 <> 0 AS q FROM runs),
    m AS (SELECT p.session_id, p.segment_id, p.direction, p.s, p.e, bool_or(r.direction = p.direction AND r.q) AS found, bool_or(r.direction <> p.direction AND r.q) AS opp, count(*) FILTER (WHERE r.direction = p.direction) AS here
      FROM r p JOIN r ON r.session_id = p.session_id AND r.segment_id = p.segment_id AND p.s <= r.e AND r.s <= p.e GROUP BY 1, 2, 3, 4, 5),
    f AS (SELECT session_id, epoch_us(recorded_at) / 1e6 AS t, line_no % 3 <> 0 AS ok, segment_id AS seg, line_no % 2 = 0 AS drawn FROM run_fixes),
    k AS (SELECT m.*, count(t) AS n, count(t) FILTER (WHERE NOT ok) AS un, count(t) FILTER (WHERE seg <> m.segment_id AND drawn) AS away, count(t) FILTER (WHERE seg <> m.segment_id AND drawn AND w.osm_way_id = v.osm_way_id) AS same
      FROM m LEFT JOIN f ON f.session_id = m.session_id AND t BETWEEN m.s AND m.e LEFT JOIN segments w ON w.id = m.segment_id LEFT JOIN segments v ON v.id = seg WHERE NOT found GROUP BY ALL)
    SELECT session_id, segment_id, s AS started, e AS ended, direction, n AS fixes, CASE WHEN opp THEN 'wrong-dir' WHEN n > 0 AND away / n >= 0.5 THEN 'next-door' WHEN un > n / 2 THEN 'dropped' WHEN here > 0 THEN 'gate' ELSE 'no-run' END AS cause, n > 0 AND same / n >= 0.5 AS same_way FROM k"""


@query("diagnose_lost_passes", "runs run_fixes segments", _LOST)
def _(runs, fixes, segments):
    s = lambda c: S.micros(F.col(c)) / 1e6
    own = runs.select("session_id", "segment_id", "direction", s("started_at").alias("started"), s("ended_at").alias("ended"), (F.col("match_id") % 3 != 0).alias("qualified"))
    landed = fixes.select("session_id", s("recorded_at").alias("at_s"), (F.col("line_no") % 3 != 0).alias("available"), F.col("segment_id").alias("landed_segment"), F.col("direction").alias("landed_direction"), (F.col("line_no") % 2 == 0).alias("landed_drawn"))
    return D.lost_passes(own.drop("qualified"), own, landed, segments.select(F.col("id").alias("segment_id"), "osm_way_id"), slot_s=7 * 86400.0)


# --- reports and answers


@query("top_widest_holes", "buckets", f"WITH {HOLES} SELECT segment_id, direction, from_m, to_m, to_m - from_m AS gap_m FROM ho ORDER BY gap_m DESC, segment_id, direction, from_m LIMIT 25")
def _(buckets):
    ties = ["segment_id", "direction", "from_m"]
    return R.largest(_holes(buckets), "gap_m", ties, 25).select(*ties, "to_m", "gap_m")


@query("top_largest_moves", "pass_buckets", """WITH a AS (SELECT segment_id, direction, distance_m, avg(elevation_m) AS e FROM pass_buckets WHERE session_id % 3 <> 0 GROUP BY 1, 2, 3), b AS (SELECT segment_id, direction, distance_m, avg(elevation_m) AS e FROM pass_buckets WHERE session_id % 3 <> 1 GROUP BY 1, 2, 3)
    SELECT a.segment_id, a.direction, a.distance_m, round(abs(b.e - a.e), 6) AS moved_m FROM a JOIN b ON a.segment_id = b.segment_id AND a.direction = b.direction AND a.distance_m = b.distance_m ORDER BY 4 DESC, 1, 2, 3 LIMIT 25""")
def _(passes):
    a, b = (M.bucket_model(passes.where(F.col("session_id") % 3 != k)) for k in (0, 1))
    ties = ["segment_id", "direction", "distance_m"]
    return R.largest(rounded(R.model_diff(a, b), "moved_m"), "moved_m", ties, 25).select(*ties, "moved_m")


@query("schema_live_positions", "segments", "SELECT street_name AS table_name, id AS position, CAST(row_number() OVER (PARTITION BY street_name ORDER BY id) AS INT) AS place FROM segments WHERE NOT is_tunnel AND street_name IS NOT NULL")
def _(segments):
    return R.live_positions(segments.where("street_name IS NOT NULL").select(F.col("street_name").alias("table_name"), F.col("id").alias("position"), F.col("is_tunnel").alias("dropped")))


@query("replay_changed_answers", "buckets", """WITH q AS (SELECT segment_id, direction, distance_m, sample_count AS n FROM buckets) SELECT segment_id || direction || distance_m AS request, CASE WHEN segment_id % 7 = 0 THEN 'missing' WHEN segment_id % 5 = 0 THEN 'new' ELSE 'changed' END AS change FROM q
    WHERE (segment_id % 7 = 0) <> (segment_id % 5 = 0) OR (segment_id % 7 <> 0 AND segment_id % 5 <> 0 AND n > 3)""")
def _(buckets):
    asked = buckets.select(F.concat(F.col("segment_id").cast("string"), "direction", F.col("distance_m").cast("string")).alias("request"), "segment_id", F.col("sample_count").alias("answer"))
    return R.changed_answers(asked.where("segment_id % 5 <> 0"), asked.where("segment_id % 7 <> 0").withColumn("answer", F.least("answer", F.lit(3))))
