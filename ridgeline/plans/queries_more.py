"""Further registered queries: predicates, joins, scalars, the network, matching, paths, logs and maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgeline.functions import geo as G
from ridgeline.functions import scalar as S
from ridgeline.operators import clean as C
from ridgeline.operators import diagnose as D
from ridgeline.operators import growth as Y
from ridgeline.operators import match as X
from ridgeline.operators import model as M
from ridgeline.operators import network as N
from ridgeline.operators import paths as P
from ridgeline.operators import relational as R
from ridgeline.operators import selection as E
from ridgeline.operators import windows as W
from ridgeline.plans.queries import BUCKET, EXTENTS, QUERIES, RANGES, SPIKES, TRANS, color_sql, hav, query, rounded
from ridgeline.plans.storage import saved
from ridgeline.sources import accesslog as L

# --- predicates


@query("filter_bbox", "segments", "SELECT id FROM segments WHERE canonical_segment_id IS NULL AND greatest(lon0, lon1) >= -104.79 AND least(lon0, lon1) <= -104.77 AND greatest(lat0, lat1) >= 38.801 AND least(lat0, lat1) <= 38.82")
def _(segments):
    box = G.boxes_overlap(F.least("lon0", "lon1"), F.least("lat0", "lat1"), F.greatest("lon0", "lon1"), F.greatest("lat0", "lat1"), (-104.79, 38.801, -104.77, 38.82))
    return segments.where(F.col("canonical_segment_id").isNull() & box).select("id")


BIKES = "coalesce(bicycle IN ('yes', 'designated', 'permissive'), false)"


@query("filter_way_kinds", "tags", f"""SELECT way_id, CASE WHEN highway IS NULL THEN NULL WHEN highway = 'track' THEN CASE WHEN bicycle = 'designated' THEN 'cycleway' WHEN {BIKES} THEN 'footway' END WHEN highway IN ('service', 'motorway') OR (access = 'private' AND NOT {BIKES}) OR (highway = 'footway' AND footway = 'crossing') THEN NULL
    WHEN highway = 'residential' THEN 'road' WHEN highway = 'cycleway' OR (highway = 'path' AND bicycle = 'designated') THEN 'cycleway' WHEN highway IN ('footway', 'path') THEN 'footway' END AS kind, coalesce(tunnel NOT IN ('', 'no', 'false'), false) OR coalesce(covered = 'building_passage', false) AS is_tunnel, {BIKES} AS bikes FROM tags""")
def _(tags):
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in ("highway", "bicycle", "access", "footway", "tunnel", "covered")]), F.array("highway", "bicycle", "access", "footway", "tunnel", "covered"))
    rows = tags.select("way_id", m.alias("t"))
    return rows.select("way_id", N.classify(F.col("t")).alias("kind"), N.is_tunnel(F.col("t")).alias("is_tunnel"), N.bikes_allowed(F.col("t")).alias("bikes"))


@query("filter_admissible_fixes", "samples", "SELECT session_id, id FROM samples WHERE heading_deg >= 0 AND (accuracy_m IS NULL OR accuracy_m <= 30)")
def _(samples):
    return X.admissible(samples, "heading_deg").select("session_id", "id")


@query("filter_gate_sweep", "runs", "SELECT s AS min_span_m, c AS min_coverage, count(*) FILTER (span_m >= s OR span_m / length_m >= c) AS admitted, count(*) AS runs FROM runs, (SELECT unnest([10e0, 25e0, 75e0]) AS s), (SELECT unnest([0.5e0, 0.7e0]) AS c) GROUP BY 1, 2")
def _(runs):
    gates = F.explode(F.array(*[F.struct(F.lit(s).alias("min_span_m"), F.lit(c).alias("min_coverage")) for s in (10.0, 25.0, 75.0) for c in (0.5, 0.7)]))
    rows = runs.select("span_m", "length_m", gates.alias("g")).select("*", "g.*")
    return rows.groupBy("min_span_m", "min_coverage").agg(F.count_if((F.col("span_m") >= F.col("min_span_m")) | (F.col("span_m") / F.col("length_m") >= F.col("min_coverage"))).alias("admitted"), F.count("*").alias("runs"))


@query("filter_position_spikes", "samples", f"WITH {SPIKES} SELECT session_id, id FROM ms WHERE cross_m >= 60 AND (chord_m <= 0 OR cross_m / chord_m >= 0.5)")
def _(samples):
    return X.spike_ids(samples, 60, 0.5)


@query("filter_fold_eligible", "segments", "SELECT id FROM segments WHERE kind IN ('footway', 'cycleway') AND (street_name IS NULL OR street_name ILIKE '%sidewalk%')")
def _(segments):
    return segments.where(N.fold_eligible(F.col("kind"), F.col("street_name"))).select("id")


@query("filter_padded_box", "segments", "SELECT id, round(x0 - 100 / (111320 * cos(radians((y0 + y1) / 2))), 9) AS a, round(y0 - 100 / 111320e0, 9) AS b, round(x1 + 100 / (111320 * cos(radians((y0 + y1) / 2))), 9) AS c, round(y1 + 100 / 111320e0, 9) AS d FROM (SELECT id, least(lon0, lon1) AS x0, greatest(lon0, lon1) AS x1, least(lat0, lat1) AS y0, greatest(lat0, lat1) AS y1 FROM segments)")
def _(segments):
    box = G.padded_box(F.least("lon0", "lon1"), F.least("lat0", "lat1"), F.greatest("lon0", "lon1"), F.greatest("lat0", "lat1"), 100)
    return rounded(segments.select("id", *[x.alias(n) for n, x in zip("abcd", box, strict=True)]), *"abcd", places=9)


# --- joins


@query("join_semi_with_data", "segments buckets", "SELECT id FROM segments s WHERE EXISTS (SELECT 1 FROM buckets b WHERE b.segment_id = s.id)")
def _(segments, buckets):
    return R.with_data(segments, buckets).select("id")


@query("join_anti_orphans", "segments", "SELECT id FROM segments s WHERE NOT EXISTS (SELECT 1 FROM segments k WHERE k.id % 4 <> 1 AND k.osm_way_id = s.osm_way_id AND k.start_node_id = s.start_node_id AND k.end_node_id = s.end_node_id AND k.piece_index = s.piece_index)")
def _(segments):
    return R.orphans(segments, segments.where("id % 4 <> 1")).select("id")


@query("top_longest_orphans", "segments", "SELECT id, length_m FROM segments s WHERE NOT EXISTS (SELECT 1 FROM segments k WHERE k.id % 4 <> 1 AND k.osm_way_id = s.osm_way_id AND k.start_node_id = s.start_node_id AND k.end_node_id = s.end_node_id AND k.piece_index = s.piece_index) ORDER BY length_m DESC, id LIMIT 8")
def _(segments):
    return R.longest_orphans(segments, segments.where("id % 4 <> 1")).select("id", "length_m")


@query("join_tuple_in", "pass_buckets dem", "SELECT match_id, distance_m FROM pass_buckets WHERE (segment_id, direction, distance_m) IN (SELECT (segment_id, direction, distance_m) FROM dem WHERE dem_m > 1850)")
def _(passes, dem):
    return R.in_keys(passes, dem.where("dem_m > 1850"), ["segment_id", "direction", "distance_m"]).select("match_id", "distance_m")


@query("join_clamped_fraction", "buckets lines", "SELECT b.segment_id, b.direction, b.distance_m, round(greatest(0e0, least(1e0, CASE WHEN b.direction = 'forward' THEN b.distance_m ELSE l.length_m - b.distance_m END / l.length_m)), 9) + 0e0 AS fraction FROM buckets b JOIN lines l ON l.segment_id = b.segment_id")
def _(buckets, lines):
    m = F.when(F.col("direction") == "forward", F.col("distance_m")).otherwise(F.col("length_m") - F.col("distance_m"))
    rows = buckets.join(lines, "segment_id").select("segment_id", "direction", "distance_m", S.clamp(m / F.col("length_m"), 0, 1).alias("fraction"))
    return rounded(rows, "fraction", places=9)


@query("join_dem_lookup", "buckets dem", "SELECT b.segment_id, b.direction, b.distance_m, d.dem_m FROM buckets b LEFT JOIN dem d ON d.segment_id = b.segment_id AND d.direction = b.direction AND d.distance_m = b.distance_m")
def _(buckets, dem):
    return buckets.join(dem, ["segment_id", "direction", "distance_m"], "left").select("segment_id", "direction", "distance_m", "dem_m")


@query("join_twins", "buckets coverage lines", f"WITH {EXTENTS} SELECT a.segment_id, a.direction, a.from_m, a.to_m, a.length_m - b.to_m AS twin_from_m, a.length_m - b.from_m AS twin_to_m FROM ext a JOIN ext b ON b.segment_id = a.segment_id AND b.direction <> a.direction")
def _(buckets, coverage, lines):
    return R.twins(M.extents(buckets, coverage, lines)).drop("length_m")


FAMILY = "nb AS (SELECT *, least(start_node_id, end_node_id) AS lo, greatest(start_node_id, end_node_id) AS hi, least(lon0, lon1) AS x0, greatest(lon0, lon1) AS x1, least(lat0, lat1) AS y0, greatest(lat0, lat1) AS y1 FROM segments WHERE canonical_segment_id IS NULL)"


@query("join_near_drawn", "segments buckets", f"""WITH {FAMILY}, dr AS (SELECT * FROM nb WHERE x1 >= -104.79 AND x0 <= -104.77 AND y1 >= 38.8 AND y0 <= 38.803 AND id IN (SELECT segment_id FROM buckets)),
    fm AS (SELECT DISTINCT n.osm_way_id, n.lo, n.hi FROM dr d JOIN nb n ON n.x1 >= d.x0 - 0.0025 AND n.x0 <= d.x1 + 0.0025 AND n.y1 >= d.y0 - 0.0025 AND n.y0 <= d.y1 + 0.0025) SELECT DISTINCT nb.id FROM nb JOIN fm ON fm.osm_way_id = nb.osm_way_id AND fm.lo = nb.lo AND fm.hi = nb.hi""")
def _(segments, buckets):
    return X.near_drawn(segments, buckets, (-104.79, 38.8, -104.77, 38.803)).select("id")


ENDS = """kf AS (SELECT *, count(*) OVER f AS pieces, max(piece_index) OVER f AS last_piece, lag(id) OVER (f ORDER BY piece_index, id) AS prev_id, lag(piece_index) OVER (f ORDER BY piece_index, id) AS prev_piece FROM segments WINDOW f AS (PARTITION BY osm_way_id, least(start_node_id, end_node_id), greatest(start_node_id, end_node_id))),
    en AS (SELECT id, 'start' AS which, start_node_id AS node, lon0 AS x, lat0 AS y FROM kf WHERE pieces < 2 OR piece_index = 0 UNION ALL SELECT id, 'end', end_node_id, lon1, lat1 FROM kf WHERE pieces < 2 OR piece_index = last_piece),
    ad AS (SELECT id AS segment_id, 'start' AS which, prev_id AS other FROM kf WHERE piece_index - prev_piece = 1 UNION SELECT prev_id, 'end', id FROM kf WHERE piece_index - prev_piece = 1 UNION SELECT a.id, a.which, b.id FROM en a JOIN en b ON a.node = b.node AND a.id <> b.id)"""


@query("graph_end_neighbours", "segments@hubs", f"WITH {ENDS} SELECT * FROM ad")
def _(segments):
    return X.end_neighbours(segments)


@query("graph_snapped_neighbours", "segments@hubs", f"WITH {ENDS} SELECT * FROM ad UNION SELECT a.id, a.which, b.id FROM en a JOIN en b ON a.id <> b.id AND abs(a.y - b.y) < 0.0005 AND abs(a.x - b.x) < 0.0006 AND {hav('a.x', 'a.y', 'b.x', 'b.y')} <= 40")
def _(segments):
    return X.end_neighbours(segments, 40)


@query("graph_adjacency", "segments@hubs", f"WITH {ENDS} SELECT DISTINCT segment_id, other FROM ad")
def _(segments):
    return X.adjacent(segments)


EDGE_DISTANCE = """fx AS (SELECT id AS fix_id, lon, lat, heading_deg AS h FROM samples WHERE heading_deg >= 0 AND (accuracy_m IS NULL OR accuracy_m <= 30)),
    lg AS (SELECT fix_id, h, s.id AS segment_id, s.bearing_deg AS t, (lon0 - lon) * 111320 * cos(radians(lat)) AS ax, (lat0 - lat) * 111320 AS ay, (lon1 - lon) * 111320 * cos(radians(lat)) AS bx, (lat1 - lat) * 111320 AS by_ FROM fx JOIN segments s ON lon BETWEEN least(lon0, lon1) - 0.0005 AND greatest(lon0, lon1) + 0.0005 AND lat BETWEEN least(lat0, lat1) - 0.0005 AND greatest(lat0, lat1) + 0.0005),
    tt AS (SELECT *, greatest(0e0, least(1e0, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS u FROM lg),
    dd AS (SELECT fix_id, segment_id, sqrt(pow(ax + u * (bx - ax), 2) + pow(ay + u * (by_ - ay), 2)) AS distance_m, abs(h - t) % 360 AS d1, abs(h - (t + 180) % 360) % 360 AS d2 FROM tt),
    cd AS (SELECT fix_id, segment_id, distance_m, CASE WHEN least(d1, 360 - d1) <= 45 THEN 'forward' WHEN least(d2, 360 - d2) <= 45 THEN 'backward' END AS direction FROM dd WHERE distance_m <= 25)"""


@query("match_candidates", "samples segments", f"WITH {EDGE_DISTANCE} SELECT fix_id, segment_id, direction, round(distance_m, 5) AS distance_m FROM cd WHERE direction IS NOT NULL")
def _(samples, segments):
    found = X.candidates(X.admissible(samples, "heading_deg"), X.straight_edges(segments))
    return rounded(found.select("fix_id", "segment_id", "direction", "distance_m"), "distance_m", places=5)


@query("match_nearest", "samples segments", f"WITH {EDGE_DISTANCE} SELECT fix_id, segment_id, direction, round(distance_m, 5) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY fix_id ORDER BY distance_m, segment_id) AS r FROM cd WHERE direction IS NOT NULL) WHERE r = 1")
def _(samples, segments):
    found = X.nearest(X.candidates(X.admissible(samples, "heading_deg"), X.straight_edges(segments)))
    return rounded(found.select("fix_id", "segment_id", "direction", "distance_m"), "distance_m", places=5)


#: Settings of matching that are compared: reach in metres, most degrees between heading and edge.
ARMS = {"narrow": (10.0, 20.0), "usual": (25.0, 45.0), "wide": (40.0, 80.0)}
ARM_ROWS = ", ".join(f"('{k}', {r}e0, {d}e0)" for k, (r, d) in ARMS.items())


@query("match_sweep", "samples segments", f"""WITH {EDGE_DISTANCE}, am(arm, reach, most) AS (VALUES {ARM_ROWS}), ac AS (SELECT arm, fix_id, segment_id, distance_m, CASE WHEN least(d1, 360 - d1) <= most THEN 'forward' WHEN least(d2, 360 - d2) <= most THEN 'backward' END AS direction FROM dd JOIN am ON distance_m <= reach),
    an AS (SELECT *, count(*) OVER (PARTITION BY arm, fix_id) AS n, row_number() OVER (PARTITION BY arm, fix_id ORDER BY distance_m, segment_id) AS r FROM ac WHERE direction IS NOT NULL)
    SELECT arm, count(*) AS fixes, CAST(sum(n) AS BIGINT) AS candidates, count(DISTINCT (segment_id, direction)) AS lines, round(avg(distance_m), 5) AS mean_m FROM an WHERE r = 1 GROUP BY arm""")
def _(samples, segments):
    """All arms from one candidate join."""
    found = X.candidate_arms(X.admissible(samples, "heading_deg"), X.straight_edges(segments), ARMS)
    return rounded(X.sweep_report(found), "mean_m", places=5)


LINE_TIMES = "t1 AS (SELECT match_id, segment_id, direction, epoch_us(started_at) / 1e6 AS started, epoch_us(ended_at) / 1e6 + 86400 * 3 AS ended FROM runs WHERE session_id % 2 = 0), t2 AS (SELECT match_id, segment_id, direction, epoch_us(started_at) / 1e6 AS started, epoch_us(ended_at) / 1e6 + 86400 * 3 AS ended FROM runs WHERE session_id % 2 = 1)"


@query("join_interval_overlap", "runs", f"WITH {LINE_TIMES} SELECT t1.match_id, t2.match_id AS run_id FROM t1 JOIN t2 ON t1.segment_id = t2.segment_id AND t1.direction = t2.direction AND t1.started <= t2.ended AND t2.started <= t1.ended")
def _(runs):
    at = runs.select("match_id", "segment_id", "direction", "session_id", (S.micros(F.col("started_at")) / 1e6).alias("started"), (S.micros(F.col("ended_at")) / 1e6 + 86400 * 3).alias("ended"))
    a, b = at.where("session_id % 2 = 0"), at.where("session_id % 2 = 1").withColumnRenamed("match_id", "run_id").drop("session_id")
    return R.overlapping(a, b, ["segment_id", "direction"]).select("match_id", "run_id")


@query("join_fixes_in_interval", "samples", """WITH w AS (SELECT session_id, id AS window_id, epoch_us(recorded_at) / 1e6 AS started, epoch_us(recorded_at) / 1e6 + 90000 AS ended FROM samples) SELECT w.window_id, s.id FROM w JOIN samples s ON s.session_id = w.session_id AND epoch_us(s.recorded_at) / 1e6 BETWEEN started AND ended""")
def _(samples):
    at = (S.micros(F.col("recorded_at")) / 1e6).alias("at_s")
    windows = samples.select("session_id", F.col("id").alias("window_id"), at.alias("started")).withColumn("ended", F.col("started") + 90000)
    return R.fixes_within(windows, samples.select("session_id", "id", at), "session_id", 100_000).select("window_id", "id")


@query("barometer_windowed_altitude", "readings", """WITH f AS (SELECT event_id AS fix_id, phone, at_ms + 100 AS t FROM readings) SELECT fix_id, round(44330 * (1 - pow(avg(hpa) / 1013.25, 1 / 5.255)), 6) AS altitude_m, count(*) AS readings, round(avg(at_ms - t), 6) AS mean_offset_ms FROM f JOIN readings r ON r.phone = f.phone AND abs(at_ms - t) <= 500 AND hpa BETWEEN 300 AND 1100 GROUP BY 1""")
def _(readings):
    fixes = readings.select(F.col("event_id").alias("fix_id"), "phone", (F.col("at_ms") + 100).alias("at_ms"))
    return rounded(R.readings_near(fixes, readings.select("phone", "at_ms", "hpa"), key="phone"), "altitude_m", "mean_offset_ms")


@query("barometer_decode", "readings", "SELECT b AS batch, at_ms, hpa FROM (SELECT event_id // 8 AS b, at_ms, hpa FROM readings)")
def _(readings):
    flat = readings.groupBy(F.floor(F.col("event_id") / 8).cast("long").alias("batch")).agg(F.flatten(F.collect_list(F.array("at_ms", "hpa"))).alias("flat"))
    return R.decoded_readings(flat)


@query("barometer_height_fallback", "samples", "SELECT id, CASE WHEN id % 4 = 0 THEN elevation_m WHEN id % 4 <> 1 AND id % 9 < 5 THEN elevation_m + 1 ELSE elevation_m - 1 END AS height_m FROM samples")
def _(samples):
    e, i = F.col("elevation_m"), F.col("id")
    return samples.select("id", R.resolved_height(F.when(i % 4 == 0, e), F.when(i % 4 != 1, e + 1), i % 9, e - 1).alias("height_m"))


# --- writes


@query("upsert_latest", "segments", "SELECT id, kind, length_m FROM segments WHERE id % 3 <> 0 UNION ALL SELECT id, 'new', length_m + 1 FROM segments WHERE id % 3 = 0")
def _(segments):
    own = segments.select("id", "kind", "length_m")
    return R.upsert(own.where("id % 2 = 0 OR id % 3 <> 0"), own.where("id % 3 = 0").select("id", F.lit("new").alias("kind"), (F.col("length_m") + 1).alias("length_m")), ["id"])


@query("insert_ignore", "samples", "SELECT session_id, id FROM samples")
def _(samples):
    own = samples.select("session_id", "recorded_at", "id")
    return R.insert_new(own.where("id % 3 <> 0"), own.unionByName(own.select("session_id", "recorded_at", (F.col("id") + 1_000_000).alias("id"))), ["session_id", "recorded_at"]).select("session_id", "id")


@query("update_by_key", "segments", "SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN id + 7 ELSE canonical_segment_id END AS canonical_segment_id FROM segments")
def _(segments):
    new = segments.where("id % 5 < 2").select("id", F.when(F.col("id") % 5 == 1, F.col("id") + 7).alias("canonical_segment_id"))
    return R.updated(segments, new, "id", "canonical_segment_id").select("id", "canonical_segment_id")


@query("delete_cascade", "pass_buckets runs", "SELECT match_id, distance_m FROM pass_buckets WHERE session_id % 7 <> 0")
def _(passes, runs):
    return R.deleted(passes, runs.where("session_id % 7 = 0").select("match_id").distinct(), "match_id", "match_id").select("match_id", "distance_m")


#: Links of the network before and after a run: some change, some go, some come.
LINKS = """bf AS (SELECT id, canonical_segment_id AS parent, street_name, length_m FROM segments WHERE id % 11 <> 0), af AS (SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN id + 1 ELSE canonical_segment_id END AS parent, street_name, length_m FROM segments WHERE id % 7 <> 0)"""


def _links(segments):
    keep = segments.select("id", F.col("canonical_segment_id").alias("parent"), "street_name", "length_m")
    after = keep.withColumn("parent", F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 == 1, F.col("id") + 1).otherwise(F.col("parent")))
    return keep.where("id % 11 <> 0"), after.where("id % 7 <> 0")


@query("link_changes", "segments", f"""WITH {LINKS} SELECT coalesce(bf.id, af.id) AS id, CASE WHEN bf.id IS NULL THEN 'insert' WHEN af.id IS NULL THEN 'delete' ELSE 'update' END AS change, bf.parent AS old_parent, af.parent AS new_parent FROM bf FULL JOIN af ON bf.id = af.id WHERE bf.id IS NULL OR af.id IS NULL OR bf.parent IS DISTINCT FROM af.parent""")
def _(segments):
    return R.change_set(*_links(segments), ["id"]).select("id", "change", F.col("old.parent").alias("old_parent"), F.col("new.parent").alias("new_parent"))


@query("link_changes_applied", "segments", f"WITH {LINKS} SELECT * FROM af")
def _(segments):
    before, after = _links(segments)
    return R.applied(before, R.change_set(before, after, ["id"]))


@query("link_changes_reversed", "segments", f"WITH {LINKS} SELECT * FROM bf")
def _(segments):
    """Applied and taken back."""
    before, after = _links(segments)
    changes = saved(R.change_set(before, after, ["id"]))
    return R.applied(R.applied(before, changes), R.inverse(changes))


@query("delete_set_null", "segments", "SELECT id, CASE WHEN canonical_segment_id % 4 = 0 THEN NULL ELSE canonical_segment_id END AS canonical_segment_id FROM segments")
def _(segments):
    return R.set_null(segments, segments.where("id % 4 = 0").select("id"), "canonical_segment_id", "id").select("id", "canonical_segment_id")


@query("link_decisions", "segments", """WITH p AS (SELECT id, canonical_segment_id AS cur, (id % 10) / 10e0 AS f, (id % 7) / 10e0 AS b, CASE WHEN id % 11 > 0 THEN id - id % 11 END AS par, id % 3 = 0 AS con FROM segments WHERE kind <> 'road'), n AS (SELECT *, CASE WHEN f >= 0.6 AND (con OR b >= 0.4) THEN par END AS np FROM p)
    SELECT CASE WHEN cur IS NULL AND np IS NOT NULL THEN 'fold' WHEN cur IS NOT NULL AND np IS NULL THEN 'unfold' WHEN cur IS DISTINCT FROM np THEN 'reparent' ELSE 'unchanged' END AS change, count(*) AS n FROM n GROUP BY 1""")
def _(segments):
    i = F.col("id")
    plan = segments.where("kind <> 'road'").select("id", "street_name", F.col("canonical_segment_id").alias("current_parent"), (i % 10 / 10.0).alias("frontage"), (i % 7 / 10.0).alias("best_street_frontage"), F.when(i % 11 > 0, i - i % 11).alias("parent_id"), (i % 3 == 0).alias("connected"))
    return N.link_tally(N.decide(plan))


# --- scalars


@query("scalar_geo", "segments", f"""SELECT id, round({hav('lon0', 'lat0', 'lon1', 'lat1')}, 6) AS haversine_m, round((degrees(atan2(sin(radians(lon1 - lon0)) * cos(radians(lat1)), cos(radians(lat0)) * sin(radians(lat1)) - sin(radians(lat0)) * cos(radians(lat1)) * cos(radians(lon1 - lon0)))) + 360) % 360, 6) AS bearing,
    least(abs(bearing_deg - 100) % 360, 360 - abs(bearing_deg - 100) % 360) AS delta_deg, abs((((100 - bearing_deg) % 360) + 540) % 360 - 180) AS turn, least(abs(bearing_deg % 180 - 30) % 180, 180 - abs(bearing_deg % 180 - 30) % 180) AS undirected, round(40075016.686 * cos(radians(lat0)) / (512 * pow(2e0, piece_index)), 6) AS metres_per_point FROM segments""")
def _(segments):
    b, c = F.col("bearing_deg"), F.col
    rows = segments.select("id", G.haversine_m(c("lon0"), c("lat0"), c("lon1"), c("lat1")).alias("haversine_m"), G.compass(G.bearing_deg(c("lon0"), c("lat0"), c("lon1"), c("lat1"))).alias("bearing"), G.bearing_delta(b, F.lit(100.0)).alias("delta_deg"), G.turn_deg(b, F.lit(100.0)).alias("turn"), G.heading_delta(b % 180, F.lit(30.0)).alias("undirected"), G.metres_per_point(c("piece_index"), c("lat0")).alias("metres_per_point"))
    return rounded(rows, "haversine_m", "bearing", "metres_per_point")


@query("scalar_model", "run_fixes", f"""SELECT match_id, line_no, along_m, {BUCKET} AS bucket, {color_sql('along_m / 4 - 16')} AS color, greatest(-25e0, least(25e0, along_m - 60)) AS clamped, CASE WHEN direction = 'forward' THEN 'backward' ELSE 'forward' END AS opposite, CAST(segment_id AS VARCHAR) || ':' || direction AS line_key,
    CASE WHEN along_m <= 15 THEN '<=15s' WHEN along_m <= 45 THEN '<=45s' ELSE '>45s' END AS gap_band, round(44330 * (1 - pow((900 + along_m) / 1013.25, 1 / 5.255)), 6) AS altitude_m, round(120 + 280 * greatest(0e0, least(1e0, along_m / 50 / 2)), 6) AS speed, CAST(CASE WHEN along_m > 5 THEN floor(greatest(1000e0, least(4000e0, 11 / (along_m - 5) * 1000)) / 500 + 0.5) * 500 ELSE 4000 END AS BIGINT) AS interval_ms FROM run_fixes""")
def _(fixes):
    m = F.col("along_m")
    rows = fixes.select("match_id", "line_no", "along_m", S.bucket(m).alias("bucket"), S.slope_color(m / 4 - 16).alias("color"), S.clamp_slope(m - 60).alias("clamped"), S.opposite(F.col("direction")).alias("opposite"), S.line_key(F.col("segment_id"), F.col("direction")).alias("line_key"), S.gap_band(m, (15, 45)).alias("gap_band"), S.altitude_from_hpa(900 + m).alias("altitude_m"), S.growth_speed(m / 50).alias("speed"), S.interval_for_speed(m - 5).alias("interval_ms"))
    return rounded(rows, "altitude_m", "speed")


@query("scalar_names", "segments", "SELECT id, lower(regexp_replace(trim(coalesce('  ' || street_name || '   X ', '')), '\\s+', ' ', 'g')) AS name_key FROM segments")
def _(segments):
    return segments.select("id", S.name_key(F.concat(F.lit("  "), "street_name", F.lit("   X "))).alias("name_key"))


@query("scalar_formats", "segments", """SELECT id, CASE WHEN length_m * 9 / 0.3048 < 2640 THEN format('{:,}', CAST(floor(floor(length_m * 9 / 0.3048 / 10 + 0.5) * 10 + 0.5) AS BIGINT)) || ' ft' ELSE printf('%.2f', length_m * 9 / 0.3048 / 5280) || ' mi' END AS distance,
    CASE WHEN floor(abs(length_m - 80) / 0.3048 + 0.5) = 0 THEN '0 ft' ELSE (CASE WHEN length_m > 80 THEN '+' ELSE '−' END) || format('{:,}', CAST(floor(abs(length_m - 80) / 0.3048 + 0.5) AS BIGINT)) || ' ft' END AS rise,
    CASE WHEN floor((length_m - 80) / 7 * 10 + 0.5) = 0 THEN '0.0%' ELSE (CASE WHEN length_m > 80 THEN '+' ELSE '−' END) || printf('%.1f', abs(floor((length_m - 80) / 7 * 10 + 0.5) / 10)) || '%' END AS grade FROM segments""")
def _(segments):
    m = F.col("length_m")
    return segments.select("id", S.format_distance(m * 9).alias("distance"), S.format_rise(m - 80).alias("rise"), S.format_grade((m - 80) / 7).alias("grade"))


# --- paths

SP = "sp0 AS (SELECT *, slope_pct * length_m / 100 AS rise_m FROM spans), sp AS (SELECT *, coalesce(sum(length_m) OVER w, 0) AS at_m, coalesce(sum(rise_m) OVER w, 0) AS height_m FROM sp0 WINDOW w AS (PARTITION BY path_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


def _spans(spans):
    return W.running_metres(W.running_heights(spans)).withColumn("color", S.slope_color(F.col("slope_pct")))


@query("path_profile", "spans", f"WITH {SP} SELECT path_id, i, at_m, round(rise_m, 6) + 0e0 AS rise_m, round(height_m, 6) + 0e0 AS height_m FROM sp")
def _(spans):
    return rounded(_spans(spans).select("path_id", "i", "at_m", "rise_m", "height_m"), "rise_m", "height_m")


@query("path_stats", "spans", f"""WITH {SP} SELECT path_id, sum(length_m) AS distance_m, round(sum(greatest(rise_m, 0)), 6) + 0e0 AS climb_m, round(sum(greatest(-rise_m, 0)), 6) + 0e0 AS descent_m, round(sum(rise_m), 6) + 0e0 AS net_m, sum(CASE WHEN source = 'none' THEN length_m ELSE 0 END) AS no_data_m, round(sum(rise_m) / sum(length_m) * 100, 6) + 0e0 AS average_grade_pct FROM sp GROUP BY 1""")
def _(spans):
    return rounded(W.path_stats(_spans(spans)), "climb_m", "descent_m", "net_m", "average_grade_pct")


@query("path_band_shares", "spans", "WITH t AS (SELECT path_id, sum(length_m) AS w FROM spans GROUP BY 1), b AS (SELECT path_id, CAST(CASE WHEN slope_pct <= -8 THEN 0 WHEN slope_pct <= -3 THEN 1 WHEN slope_pct <= 0 THEN 2 WHEN slope_pct <= 3 THEN 3 WHEN slope_pct <= 6 THEN 4 WHEN slope_pct <= 9 THEN 5 WHEN slope_pct <= 12 THEN 6 ELSE 7 END AS INT) AS band, sum(length_m) AS length_m FROM spans WHERE source <> 'none' GROUP BY 1, 2) SELECT b.path_id, band, length_m, round(length_m / w, 9) AS share FROM b JOIN t ON t.path_id = b.path_id")
def _(spans):
    return rounded(W.band_shares(_spans(spans)), "share", places=9)


@query("path_cut", "spans", f"WITH {SP} SELECT path_id, i, least(length_m, 100.25 + path_id - at_m) AS length_m, round(rise_m * least(length_m, 100.25 + path_id - at_m) / length_m, 6) + 0e0 AS rise_m FROM sp WHERE at_m < 100.25 + path_id")
def _(spans):
    cuts = spans.select("path_id").distinct().withColumn("cut_m", F.lit(100.25) + F.col("path_id"))
    return rounded(W.cut_spans(_spans(spans), cuts).select("path_id", "i", "length_m", "rise_m"), "rise_m")


@query("path_merged_spans", "spans", f"""WITH {SP}, m AS (SELECT *, {color_sql('slope_pct')} AS color, source = 'none' AS no_data, at_m + length_m AS end_m FROM sp), k AS (SELECT *, CASE WHEN lag(color) OVER w = color AND lag(no_data) OVER w = no_data AND abs(lag(end_m) OVER w - at_m) < 0.01 THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY path_id, piece ORDER BY i)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY path_id, piece ORDER BY i) AS run FROM k) SELECT path_id, piece, CAST(run AS BIGINT) AS run, min(at_m) AS start_m, max(end_m) AS end_m, any_value(color) AS color, any_value(no_data) AS no_data FROM r GROUP BY 1, 2, 3""")
def _(spans):
    return W.merged_spans(_spans(spans))


@query("path_profile_columns", "spans", f"""WITH {SP}, t AS (SELECT path_id, max(at_m + length_m) AS w FROM sp GROUP BY 1), x AS (SELECT path_id, CAST(b AS INT) AS bin, (b + 0.5) / 16 * w AS x FROM t, (SELECT unnest(range(16)) AS b)), j AS (SELECT x.path_id, bin, x, arg_max(row(at_m, length_m, height_m, rise_m, slope_pct, source), i) AS s FROM x JOIN sp ON sp.path_id = x.path_id AND sp.at_m <= x.x GROUP BY 1, 2, 3)
    SELECT path_id, bin, round(s[3] + s[4] * least(x - s[1], s[2]) / s[2], 9) + 0e0 AS height_m, {color_sql('s[5]')} AS color, s[6] = 'none' AS no_data FROM j""")
def _(spans):
    return rounded(W.profile_columns(_spans(spans), 16), "height_m", places=9)


@query("path_street_names", "spans", """WITH n AS (SELECT *, sum(length_m) OVER (PARTITION BY path_id, street_name) AS t FROM spans WHERE street_name IS NOT NULL), a AS (SELECT *, max(CASE WHEN t >= 400 THEN 1 ELSE 0 END) OVER (PARTITION BY path_id) AS anyl FROM n), k AS (SELECT *, lag(street_name) OVER (PARTITION BY path_id ORDER BY i) AS was FROM a WHERE anyl = 0 OR t >= 400) SELECT path_id, string_agg(street_name, ' / ' ORDER BY i) AS names FROM k WHERE was IS DISTINCT FROM street_name GROUP BY 1""")
def _(spans):
    return W.street_names(spans, 400)


TWINS = "tw AS (SELECT *, sum(CASE WHEN was = segment_id THEN 0 ELSE 1 END) OVER (PARTITION BY path_id ORDER BY i DESC) AS run FROM (SELECT *, lag(segment_id) OVER (PARTITION BY path_id ORDER BY i DESC) AS was FROM spans))"


@query("path_twin_lines", "spans", f"WITH {TWINS} SELECT path_id, CAST(run AS BIGINT) AS run, segment_id, CASE WHEN arg_max(direction, i) = 'forward' THEN 'backward' ELSE 'forward' END AS direction, sum(length_m) AS length_m FROM tw GROUP BY 1, 2, 3")
def _(spans):
    return W.twin_lines(spans)


@query("path_length_chunks", "spans", f"""WITH RECURSIVE {TWINS}, l AS (SELECT path_id, CAST(run AS BIGINT) AS run, sum(length_m) AS m FROM tw GROUP BY 1, 2), c AS (SELECT path_id, run, m AS total, 0 AS chunk FROM l WHERE run = 1 UNION ALL SELECT l.path_id, l.run, CASE WHEN c.total + l.m > 300 THEN l.m ELSE c.total + l.m END, CASE WHEN c.total + l.m > 300 THEN c.chunk + 1 ELSE c.chunk END FROM c JOIN l ON l.path_id = c.path_id AND l.run = c.run + 1) SELECT path_id, run, chunk FROM c""")
def _(spans):
    return W.length_chunks(W.twin_lines(spans), 300)


@query("path_unmeasured_slopes", "spans", f"""WITH {SP}, z AS (SELECT *, 1000 + height_m AS fh, 1000 + height_m + rise_m + (i % 5) AS th, CASE WHEN source = 'none' AND lag(source) OVER w = 'none' THEN 0 ELSE 1 END AS fresh FROM sp WINDOW w AS (PARTITION BY path_id ORDER BY i)), y AS (SELECT *, sum(fresh) OVER (PARTITION BY path_id ORDER BY i) AS isl, lag(CASE WHEN source <> 'none' THEN th END) OVER w AS bf, lead(CASE WHEN source <> 'none' THEN fh END) OVER w AS af FROM z WINDOW w AS (PARTITION BY path_id ORDER BY i)),
    r AS (SELECT path_id, isl, sum(length_m) AS m, arg_min(row(bf), i)[1] AS bf, arg_max(row(af), i)[1] AS af FROM y WHERE source = 'none' GROUP BY 1, 2) SELECT y.path_id, y.i, y.length_m, round(CASE WHEN r.bf IS NULL OR r.af IS NULL THEN 0 ELSE greatest(-25, least(25, (r.af - r.bf) / r.m * 100)) END, 5) + 0e0 AS slope_pct FROM y JOIN r ON r.path_id = y.path_id AND r.isl = y.isl WHERE y.source = 'none'""")
def _(spans):
    rows = _spans(spans)
    known = F.col("source") != "none"
    rows = rows.withColumn("from_height_m", F.when(known, 1000 + F.col("height_m"))).withColumn("to_height_m", F.when(known, 1000 + F.col("height_m") + F.col("rise_m") + F.col("i") % 5))
    return rounded(W.unmeasured_slopes(rows), "slope_pct", places=5)


@query("graph_fork_history", "runs", f"WITH {TRANS}, c AS (SELECT segment_id, direction, next_segment_id, next_direction, count(DISTINCT session_id) AS rides FROM tr GROUP BY 1, 2, 3, 4), m AS (SELECT *, max(rides) OVER w AS top, count(*) OVER (PARTITION BY segment_id, direction, rides) AS k FROM c WINDOW w AS (PARTITION BY segment_id, direction)) SELECT segment_id, direction, next_segment_id, next_direction, rides FROM m WHERE rides = top AND k = 1")
def _(runs):
    return P.fork_history(W.transitions(runs))


@query("graph_leave_one_out", "runs", f"""WITH {TRANS}, md AS (SELECT DISTINCT * FROM tr), ct AS (SELECT segment_id, direction, next_segment_id, next_direction, count(*) AS rides FROM md GROUP BY 1, 2, 3, 4),
    al AS (SELECT s.session_id, s.segment_id, s.direction, c.next_segment_id, c.next_direction, c.rides - CASE WHEN o.session_id IS NULL THEN 0 ELSE 1 END AS rides FROM (SELECT DISTINCT session_id, segment_id, direction FROM md) s JOIN ct c ON c.segment_id = s.segment_id AND c.direction = s.direction LEFT JOIN md o ON o.session_id = s.session_id AND o.segment_id = c.segment_id AND o.direction = c.direction AND o.next_segment_id = c.next_segment_id AND o.next_direction = c.next_direction),
    tp AS (SELECT *, max(rides) OVER (PARTITION BY session_id, segment_id, direction) AS top FROM al WHERE rides > 0), ld AS (SELECT session_id, segment_id, direction, any_value(next_segment_id) AS ns, any_value(next_direction) AS nd FROM tp WHERE rides = top GROUP BY 1, 2, 3 HAVING count(*) = 1)
    SELECT CASE WHEN ns IS NULL THEN 'stopped' WHEN ns = next_segment_id AND nd = next_direction THEN 'right' ELSE 'wrong' END AS verdict, count(*) AS moves FROM md LEFT JOIN ld ON ld.session_id = md.session_id AND ld.segment_id = md.segment_id AND ld.direction = md.direction GROUP BY 1""")
def _(runs):
    return P.leave_one_out(W.transitions(runs))


@query("graph_source_metres", "buckets coverage lines", f"""WITH {EXTENTS}, b AS (SELECT segment_id, length_m, d AS direction FROM lines, (SELECT unnest(['forward', 'backward']) AS d)), j AS (SELECT b.*, o.from_m AS a, o.to_m AS e, b.length_m - t.to_m AS c, b.length_m - t.from_m AS f FROM b LEFT JOIN ext o ON o.segment_id = b.segment_id AND o.direction = b.direction LEFT JOIN ext t ON t.segment_id = b.segment_id AND t.direction <> b.direction),
    k AS (SELECT *, coalesce(e - a, 0) AS l, coalesce(f - c, 0) AS t, CASE WHEN a IS NULL OR c IS NULL THEN 0 ELSE greatest(0, least(e, f) - greatest(a, c)) END AS s FROM j) SELECT segment_id, direction, CAST(l AS DOUBLE) AS line_m, CAST(t - s AS DOUBLE) AS twin_m, CAST(length_m - l - t + s AS DOUBLE) AS none_m FROM k""")
def _(buckets, coverage, lines):
    return P.source_bounds(M.extents(buckets, coverage, lines), lines)


@query("graph_locate", "buckets coverage lines", f"WITH {EXTENTS}, r AS (SELECT segment_id, direction, CASE WHEN segment_id % 3 = 0 THEN NULL ELSE segment_id * 3e0 - 40 END AS asked_m FROM buckets GROUP BY 1, 2) SELECT r.segment_id, r.direction, r.asked_m, CASE WHEN asked_m IS NOT NULL THEN greatest(0e0, least(l.length_m, asked_m)) WHEN e.from_m IS NULL THEN 0e0 ELSE greatest(e.from_m, least(e.to_m, 0e0)) END AS at_m FROM r JOIN lines l ON l.segment_id = r.segment_id LEFT JOIN ext e ON e.segment_id = r.segment_id AND e.direction = r.direction")
def _(buckets, coverage, lines):
    asked = buckets.select("segment_id", "direction").distinct().withColumn("asked_m", F.when(F.col("segment_id") % 3 != 0, F.col("segment_id") * 3.0 - 40))
    return P.locate_request(asked, lines, M.extents(buckets, coverage, lines))


@query("top_destinations", "runs", f"""WITH {TRANS}, c AS (SELECT segment_id, direction, next_segment_id AS v, count(*) AS c FROM tr GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY segment_id, direction ORDER BY c DESC, v) AS r, count(*) OVER (PARTITION BY segment_id, direction) AS k FROM c)
    SELECT segment_id, direction, string_agg(CAST(c AS VARCHAR) || 'x ' || CAST(v AS VARCHAR), ', ' ORDER BY r) || CASE WHEN any_value(k) > 3 THEN ', +' || CAST(any_value(k) - 3 AS VARCHAR) || ' more' ELSE '' END AS destinations FROM r WHERE r <= 3 GROUP BY 1, 2""")
def _(runs):
    return R.top_destinations(W.transitions(runs), ["segment_id", "direction"], "next_segment_id")


# --- logs

LOG = r"""lg AS (SELECT event_id, ts, message, regexp_extract(message, '^(GET|POST|PUT|DELETE) (\S+) (\d{3})( ABORTED-BY-CLIENT)? (\d+)ms', ['method', 'url', 'status', 'ab', 'ms']) AS p FROM access_log WHERE regexp_matches(message, '^(GET|POST|PUT|DELETE) (\S+) (\d{3})( ABORTED-BY-CLIENT)? (\d+)ms')),
    lp AS (SELECT event_id, ts, message, p.method AS method, split_part(p.url, '?', 1) AS path, CASE WHEN contains(p.url, '?') THEN split_part(p.url, '?', 2) ELSE '' END AS q, CAST(p.status AS INT) AS status, p.ab <> '' AS aborted, CAST(p.ms AS BIGINT) AS ms FROM lg),
    lk AS (SELECT *, CASE WHEN path = '/segments' THEN CASE WHEN CAST(regexp_extract(q, 'maxLon=([^&]*)', 1) AS DOUBLE) - CAST(regexp_extract(q, 'minLon=([^&]*)', 1) AS DOUBLE) > 100 THEN 'tiles:world' ELSE 'tiles:box' END WHEN path <> '/segments/path' THEN path
      ELSE CASE WHEN NOT contains(q, 'toSegmentId=') THEN 'path:from' WHEN contains(q, 'grow=false') THEN 'path:connect-only' ELSE 'path:connect+grow' END || CASE WHEN contains(q, 'avoid=') THEN '+avoid' ELSE '' END END AS kind FROM lp)"""


def _log(log):
    return L.with_kind(L.parse(log.withColumnRenamed("ts", "timestamp")))


@query("log_requests", "access_log", f"WITH {LOG} SELECT event_id, method, path, status, aborted, ms, kind FROM lk")
def _(log):
    return _log(log).select("event_id", "method", "path", "status", "aborted", "ms", "kind")


@query("log_quiet_gaps", "access_log", f"WITH {LOG} SELECT event_id, round((epoch_us(ts) - ms * 1000 - lag(epoch_us(ts)) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, message)) / 1e6, 6) AS quiet_s FROM lk")
def _(log):
    return rounded(L.with_quiet(_log(log), F.to_date("timestamp")).select("event_id", "quiet_s"), "quiet_s")


@query("log_kind_report", "access_log", f"WITH {LOG} SELECT kind, count(*) AS n, list_sort(list(ms))[CAST(floor(0.5 * (count(*) - 1) + 0.5) AS INT) + 1] AS median, list_sort(list(ms))[CAST(floor(0.9 * (count(*) - 1) + 0.5) AS INT) + 1] AS p90, max(ms) AS max, min(ms) AS min FROM lk GROUP BY 1")
def _(log):
    return L.quantile_report(_log(log), "kind")


@query("log_stage_durations", "access_log", f"""WITH {LOG}, t AS (SELECT *, CAST(regexp_extract(message, ' network=0-(\\d+)', 1) AS BIGINT) AS nw, CAST(regexp_extract(message, ' growth=(\\d+)-', 1) AS BIGINT) AS g0, CAST(regexp_extract(message, ' growth=\\d+-(\\d+)', 1) AS BIGINT) AS g1, CAST(regexp_extract(message, ' respond=60-(\\d+)', 1) AS BIGINT) AS rs, CAST(regexp_extract(message, ' finish=(\\d+)', 1) AS BIGINT) AS fi FROM lk WHERE contains(message, 'pool='))
    SELECT event_id, 'network' AS stage, nw AS duration_ms FROM t UNION ALL SELECT event_id, 'growth', g1 - g0 FROM t UNION ALL SELECT event_id, 'respond', rs - 60 FROM t UNION ALL SELECT event_id, 'deliver', fi - rs FROM t UNION ALL SELECT event_id, 'toClose', ms - fi FROM t""")
def _(log):
    return L.stage_durations(_log(log), "event_id")


# --- counts


@query("count_distinct_lines", "buckets", "SELECT count(*) AS rows_n, count(DISTINCT segment_id) AS segments, count(DISTINCT (segment_id, direction)) AS lines, count(DISTINCT (segment_id, direction)) FILTER (sample_count > 25) AS busy_lines, count(*) FILTER (distance_m > 60) AS far FROM buckets")
def _(buckets):
    busy = F.when(F.col("sample_count") > 25, F.struct("segment_id", "direction"))
    return buckets.agg(F.count("*").alias("rows_n"), F.countDistinct("segment_id").alias("segments"), F.countDistinct(F.struct("segment_id", "direction")).alias("lines"), F.countDistinct(busy).alias("busy_lines"), F.count_if(F.col("distance_m") > 60).alias("far"))


@query("count_by_session_line", "runs", "SELECT session_id, segment_id, direction, count(*) AS runs FROM runs GROUP BY 1, 2, 3 HAVING count(*) > 0")
def _(runs):
    return runs.groupBy("session_id", "segment_id", "direction").agg(F.count("*").alias("runs")).where("runs > 0")


@query("median_speed_by_run", "samples", "SELECT session_id, round(median(CASE WHEN speed_mps >= 0 THEN speed_mps END), 6) AS median_mps FROM samples GROUP BY 1")
def _(samples):
    return rounded(samples.groupBy("session_id").agg(F.median(F.when(F.col("speed_mps") >= 0, F.col("speed_mps"))).alias("median_mps")), "median_mps")


# --- one ride at a time, and graph searches: held against plain Python in the tests


def _rows(samples):
    """Rides of places a few metres apart, one fix a second."""
    return samples.select("session_id", "id", F.timestamp_seconds(F.col("id") * 1.0).alias("recorded_at"), "lon", "lat", "elevation_m")


#: Each ride's fixes by number, and walks over them one fix at a time: `last` is the number of the last fix kept.
RIDE = "fx AS (SELECT session_id, id, CAST(id AS DOUBLE) AS t, lon, lat, elevation_m AS h, row_number() OVER (PARTITION BY session_id ORDER BY id) AS k FROM samples)"


def _half_up(c):
    """Averages of decimals are often exact halves at the last place: these go up, whatever the order of the additions."""
    return (F.col(c) + 3.14159265e-8).alias(c)


def _sift_sql(wrong: str) -> str:
    return f"""WITH RECURSIVE {RIDE}, wk AS (SELECT session_id, id, k, k AS last, true AS kept FROM fx WHERE k = 1
    UNION ALL SELECT x.session_id, x.id, x.k, CASE WHEN x.bad THEN x.last ELSE x.k END, NOT x.bad FROM (SELECT c.session_id, c.id, c.k, wk.last, n.k IS NOT NULL AND {wrong} AS bad FROM wk JOIN fx c ON c.session_id = wk.session_id AND c.k = wk.k + 1 JOIN fx l ON l.session_id = wk.session_id AND l.k = wk.last LEFT JOIN fx n ON n.session_id = wk.session_id AND n.k = wk.k + 2) x)
    SELECT session_id, id FROM wk WHERE kept"""


def _fast_sql(a: str, b: str) -> str:
    return f"{b}.t > {a}.t AND sqrt(pow(({b}.lon - {a}.lon) * 111320 * cos(radians({a}.lat)), 2) + pow(({b}.lat - {a}.lat) * 111320, 2)) / ({b}.t - {a}.t) > 20"


_INTO, _OUT = hav("l.lon", "l.lat", "c.lon", "c.lat"), hav("c.lon", "c.lat", "n.lon", "n.lat")


@query("ride_reject_speeds", "samples", _sift_sql(f"{_fast_sql('l', 'c')} AND {_fast_sql('c', 'n')}"))
def _(samples):
    return C.reject_speeds(_rows(samples)).select("session_id", "id")


@query("ride_reject_heights", "samples", _sift_sql(f"{_INTO} + {_OUT} >= 1 AND abs(c.h - (l.h * {_OUT} + n.h * {_INTO}) / ({_INTO} + {_OUT})) * 100 > 100 * greatest(least({_INTO}, {_OUT}), 1)"))
def _(samples):
    return C.reject_heights(_rows(samples)).select("session_id", "id")


@query("ride_smoothed", "samples", f"""WITH RECURSIVE {RIDE}, sz AS (SELECT session_id, count(*) AS n, least(count(*) - 1, 24) AS p, arg_min(h, k) AS h0, arg_max(h, k) AS h1 FROM fx GROUP BY session_id),
    ex AS (SELECT fx.session_id, id, p + k AS i, h FROM fx JOIN sz ON sz.session_id = fx.session_id UNION ALL SELECT fx.session_id, NULL, p + 2 - k, 2 * h0 - h FROM fx JOIN sz ON sz.session_id = fx.session_id WHERE k BETWEEN 2 AND p + 1
      UNION ALL SELECT fx.session_id, NULL, p + 2 * n - k, 2 * h1 - h FROM fx JOIN sz ON sz.session_id = fx.session_id WHERE k BETWEEN n - p AND n - 1),
    fw AS (SELECT session_id, id, i, h AS y FROM ex WHERE i = 1 UNION ALL SELECT ex.session_id, ex.id, ex.i, 0.485e0 * ex.h + 0.515e0 * fw.y FROM fw JOIN ex ON ex.session_id = fw.session_id AND ex.i = fw.i + 1),
    bw AS (SELECT fw.session_id, fw.id, fw.i, fw.y FROM fw JOIN sz ON sz.session_id = fw.session_id AND fw.i = sz.n + 2 * sz.p UNION ALL SELECT fw.session_id, fw.id, fw.i, 0.485e0 * fw.y + 0.515e0 * bw.y FROM bw JOIN fw ON fw.session_id = bw.session_id AND fw.i = bw.i - 1)
    SELECT session_id, id, round(y + 3.14159265e-8, 6) + 0e0 AS elevation_m FROM bw WHERE id IS NOT NULL""")
def _(samples):
    return rounded(C.smooth(_rows(samples)).select("session_id", "id", _half_up("elevation_m")), "elevation_m")


@query("ride_smoothed_causal", "samples", f"""WITH RECURSIVE {RIDE}, wk AS (SELECT session_id, id, k, h AS y FROM fx WHERE k = 1 UNION ALL SELECT fx.session_id, fx.id, fx.k, 0.3e0 * fx.h + 0.7e0 * wk.y FROM wk JOIN fx ON fx.session_id = wk.session_id AND fx.k = wk.k + 1)
    SELECT session_id, id, round(y + 3.14159265e-8, 6) + 0e0 AS elevation_m FROM wk""")
def _(samples):
    return rounded(C.smooth_causal(_rows(samples)).select("session_id", "id", _half_up("elevation_m")), "elevation_m")


@query("ride_passes", "run_fixes")
def _(fixes):
    rows = fixes.select((F.col("session_id") % 40).alias("session_id"), "segment_id", (S.micros(F.col("recorded_at")) / 8.64e10).alias("at_s"), "along_m", F.lit(0.0).alias("offset_m"))
    return C.passes(rows)


def _lines(segments):
    return segments.where("canonical_segment_id IS NULL").withColumn("line", F.array(F.array("lon0", "lat0"), F.array("lon1", "lat1")))


def _graph(segments, buckets, coverage, lines, runs):
    """Lines, neighbours, extents and moves; an area is all that is connected, so no path leaves it."""
    ways = _lines(segments)
    near = saved(X.end_neighbours(ways, 5.0))
    areas = ways.select(F.col("id").alias("segment_id")).join(X.components(near), "segment_id", "left")
    areas = saved(areas.withColumn("area", F.coalesce("area", "segment_id")))
    extents = M.extents(buckets, coverage, lines).select("segment_id", "direction", "from_m", "to_m").join(areas, "segment_id")
    ways = ways.join(areas.withColumnRenamed("segment_id", "id"), "id").select("area", "id", "line", "length_m", "street_name")
    return ways, near.join(areas, "segment_id"), extents, W.transitions(runs).join(areas, "segment_id")


def _from_all(ways):
    """One request for every line: forward from its start."""
    return ways.select("area", F.col("id").alias("path_id"), F.col("id").alias("segment_id"), F.lit("forward").alias("direction"), F.lit(0.0).alias("at_m"))


def _bearing_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"degrees(atan2(sin(radians({x2} - {x1})) * cos(radians({y2})), cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos(radians({x2} - {x1}))))"


#: The paths again, one line at a time: wk is the chain of each path, pc its stretches with their running sums, gr the answer.
GROWN = f"""RECURSIVE {TRANS}, {EXTENTS}, sg AS (SELECT * FROM segments WHERE canonical_segment_id IS NULL), {ENDS.replace("FROM segments", "FROM sg")},
    nx AS (SELECT * FROM ad UNION SELECT a.id, a.which, b.id FROM en a JOIN en b ON a.id <> b.id AND abs(a.y - b.y) < 0.0001e0 AND abs(a.x - b.x) < 0.0001e0 WHERE {hav('a.x', 'a.y', 'b.x', 'b.y')} <= 5),
    wl AS (SELECT *, least(1e0, 15 / nullif({hav('lon0', 'lat0', 'lon1', 'lat1')}, 0)) AS sh FROM sg),
    md AS (SELECT *, lon0 + (lon1 - lon0) * sh AS ax, lat0 + (lat1 - lat0) * sh AS ay, lon0 + (lon1 - lon0) * (1 - sh) AS bx, lat0 + (lat1 - lat0) * (1 - sh) AS bq FROM wl),
    ln AS (SELECT id, 0 AS d, length_m, lower(trim(coalesce(street_name, ''))) AS nm, lon1 AS tx, lat1 AS ty, {_bearing_sql('lon0', 'lat0', 'ax', 'ay')} AS inw, {_bearing_sql('bx', 'bq', 'lon1', 'lat1')} AS outw FROM md
      UNION ALL SELECT id, 1, length_m, lower(trim(coalesce(street_name, ''))), lon0, lat0, {_bearing_sql('lon1', 'lat1', 'bx', 'bq')}, {_bearing_sql('ax', 'ay', 'lon0', 'lat0')} FROM md),
    a1 AS (SELECT DISTINCT l.id, l.d, o.id AS t, CASE WHEN {hav('l.tx', 'l.ty', 'o.lon1', 'o.lat1')} < {hav('l.tx', 'l.ty', 'o.lon0', 'o.lat0')} THEN 1 ELSE 0 END AS td, l.outw, l.nm FROM nx JOIN ln l ON l.id = nx.segment_id AND l.d = CASE WHEN nx.which = 'end' THEN 0 ELSE 1 END JOIN sg o ON o.id = nx.other),
    rd AS (SELECT segment_id AS id, CASE WHEN direction = 'forward' THEN 0 ELSE 1 END AS d, next_segment_id AS t, CASE WHEN next_direction = 'forward' THEN 0 ELSE 1 END AS td, count(DISTINCT session_id) AS rides FROM tr GROUP BY ALL),
    dw AS (SELECT DISTINCT segment_id AS id, CASE WHEN direction = 'forward' THEN 0 ELSE 1 END AS d, from_m AS p, to_m AS q FROM ext),
    ar AS (SELECT a1.id, a1.d, a1.t, a1.td, abs(((m.inw - a1.outw) % 360 + 540) % 360 - 180) AS turn, CASE WHEN w.id IS NOT NULL THEN 0 WHEN v.id IS NOT NULL THEN 1 ELSE 2 END AS src, coalesce(rd.rides, 0) AS rides, a1.nm <> '' AND a1.nm = m.nm AS same
      FROM a1 JOIN ln m ON m.id = a1.t AND m.d = a1.td LEFT JOIN dw w ON w.id = a1.t AND w.d = a1.td LEFT JOIN dw v ON v.id = a1.t AND v.d = 1 - a1.td LEFT JOIN rd ON rd.id = a1.id AND rd.d = a1.d AND rd.t = a1.t AND rd.td = a1.td),
    st AS (SELECT DISTINCT id AS bf, t AS id, td AS d FROM ar UNION ALL SELECT DISTINCT -1, id, d FROM ar),
    cd AS (SELECT st.bf, ar.*, max(CASE WHEN src = 0 THEN rides ELSE 0 END) OVER (PARTITION BY st.bf, ar.id, ar.d) AS top FROM st JOIN ar ON ar.id = st.id AND ar.d = st.d AND ar.t <> st.bf),
    rk AS (SELECT *, src = 0 AND rides = top AS led, row_number() OVER (PARTITION BY bf, id, d ORDER BY CASE WHEN same THEN 0 ELSE 1 END, turn, src, t, td) AS by_name, row_number() OVER (PARTITION BY bf, id, d ORDER BY CASE WHEN turn <= 60 THEN 0 ELSE 1 END, src, turn, t, td) AS by_turn FROM cd),
    c1 AS (SELECT bf, id, d, count(*) AS arms, max(top) AS top, count(*) FILTER (led) AS leaders, max(t * 2 + td) FILTER (led) AS h, max(t * 2 + td) FILTER (by_name = 1 AND same) AS n, max(t * 2 + td) FILTER (by_turn = 1 AND turn <= 60) AS u, max(t * 2 + td) AS o FROM rk GROUP BY bf, id, d),
    ch AS (SELECT bf, id, d, arms, CASE WHEN top > 0 AND leaders = 1 THEN h WHEN n IS NOT NULL THEN n WHEN u IS NOT NULL THEN u WHEN arms = 1 THEN o END AS nx, CASE WHEN top > 0 AND leaders = 1 THEN 'history' WHEN n IS NOT NULL THEN 'name' WHEN u IS NOT NULL THEN 'turn' WHEN arms = 1 THEN 'only' END AS rule FROM c1),
    wk AS (SELECT id AS path_id, 0 AS leg, CAST(-1 AS BIGINT) AS bf, id, 0 AS d, length_m, length_m AS reach, [id] AS passed, 'start' AS rule FROM sg
      UNION ALL SELECT wk.path_id, wk.leg + 1, wk.id, l.id, l.d, l.length_m, wk.reach + l.length_m, list_append(wk.passed, l.id), ch.rule FROM wk JOIN ch ON ch.bf = wk.bf AND ch.id = wk.id AND ch.d = wk.d JOIN ln l ON l.id = ch.nx // 2 AND l.d = ch.nx % 2 WHERE wk.reach <= 5000 AND NOT list_contains(wk.passed, l.id)),
    la AS (SELECT wk.path_id, CASE WHEN wk.reach > 5000 THEN 'limit' WHEN ch.rule IS NOT NULL THEN 'loop' WHEN ch.arms > 0 THEN 'fork' ELSE 'end' END AS reason, coalesce(ch.arms, 0) AS arms FROM wk LEFT JOIN ch ON ch.bf = wk.bf AND ch.id = wk.id AND ch.d = wk.d QUALIFY row_number() OVER (PARTITION BY wk.path_id ORDER BY wk.leg DESC) = 1),
    kn AS (SELECT l.id, l.d, l.length_m, w.p, w.q, l.length_m - v.q AS r, l.length_m - v.p AS s FROM ln l LEFT JOIN dw w ON w.id = l.id AND w.d = l.d LEFT JOIN dw v ON v.id = l.id AND v.d = 1 - l.d),
    k1 AS (SELECT DISTINCT id, d, p, q, r, s, greatest(0e0, least(length_m, x)) AS x FROM (SELECT *, unnest([0e0, p, q, r, s, length_m]) AS x FROM kn) WHERE x IS NOT NULL),
    k2 AS (SELECT *, lead(x) OVER (PARTITION BY id, d ORDER BY x) AS y FROM k1),
    k3 AS (SELECT id, d, x, y, CASE WHEN (x + y) / 2 BETWEEN p AND q THEN 0 WHEN (x + y) / 2 BETWEEN r AND s THEN 1 ELSE 2 END AS src FROM k2 WHERE y > x),
    k4 AS (SELECT *, row_number() OVER (PARTITION BY id, d ORDER BY x) - row_number() OVER (PARTITION BY id, d, src ORDER BY x) AS isle FROM k3),
    sr AS (SELECT id, d, src, min(x) AS x, max(y) AS y FROM k4 GROUP BY id, d, src, isle),
    p1 AS (SELECT wk.path_id, wk.leg, wk.id, wk.d, sr.x, sr.y, sr.src, wk.rule, row_number() OVER o - 1 AS i, wk.leg <> coalesce(lag(wk.leg) OVER o, -1) AS head, sum(y - x) OVER o AS fin, sum(CASE WHEN src = 2 THEN y - x ELSE 0 END) OVER o AS bares FROM wk JOIN sr ON sr.id = wk.id AND sr.d = wk.d WINDOW o AS (PARTITION BY wk.path_id ORDER BY wk.leg, sr.x)),
    p2 AS (SELECT *, fin - (y - x) AS beg, bares - max(CASE WHEN src = 2 THEN 0 ELSE bares END) OVER (PARTITION BY path_id ORDER BY i) AS bare FROM p1),
    p3 AS (SELECT path_id, count(*) AS n, coalesce(min(i) FILTER (bare > 150), count(*)) AS gap, coalesce(min(i) FILTER (beg >= 5000), count(*)) AS ful, coalesce(min(i) FILTER (fin > 5000), count(*)) AS ovr FROM p2 GROUP BY path_id),
    p4 AS (SELECT *, gap < n AND gap <= least(ful, ovr) AS gapped FROM p3),
    p5 AS (SELECT p4.*, CASE WHEN gapped THEN gap WHEN ful < n OR ovr < n THEN least(ful, ovr + 1) ELSE n END AS stop, CASE WHEN gapped THEN 'gap' WHEN ful < n OR ovr < n THEN 'limit' ELSE la.reason END AS reason, la.arms FROM p4 JOIN la ON la.path_id = p4.path_id),
    pc AS (SELECT p2.*, p5.reason, p5.arms, CASE WHEN ovr < ful AND ovr + 1 = stop AND p5.reason = 'limit' AND i = ovr THEN x + 5000 - beg ELSE y END AS z, coalesce(max(CASE WHEN src <> 2 THEN i + 1 END) OVER (PARTITION BY p2.path_id), 0) AS kept FROM p2 JOIN p5 ON p5.path_id = p2.path_id WHERE i < stop),
    ps AS (SELECT *, sum(CASE WHEN i >= kept THEN z - x ELSE 0 END) OVER (PARTITION BY path_id) AS ahead FROM pc),
    gr AS (SELECT path_id, CAST(i AS INT) AS i, id AS segment_id, CASE WHEN d = 0 THEN 'forward' ELSE 'backward' END AS direction, x AS from_m, z AS to_m, beg AS at_m, CASE src WHEN 0 THEN 'line' WHEN 1 THEN 'twin' ELSE 'none' END AS source, CASE WHEN head THEN rule END AS rule, reason, ahead AS ahead_m, CAST(CASE WHEN reason IN ('fork', 'end') THEN arms ELSE 0 END AS INT) AS branches FROM ps WHERE i < kept
      UNION ALL SELECT p5.path_id, NULL, p5.path_id, 'forward', NULL, NULL, NULL, NULL, NULL, p5.reason, coalesce(m.ahead, 0), CAST(CASE WHEN p5.reason IN ('fork', 'end') THEN p5.arms ELSE 0 END AS INT) FROM p5 LEFT JOIN (SELECT path_id, max(ahead) AS ahead FROM ps GROUP BY path_id) m ON m.path_id = p5.path_id WHERE p5.path_id NOT IN (SELECT path_id FROM ps WHERE i < kept))"""


def _grown(segments, buckets, coverage, lines, runs):
    """The path of every line: forward from its start."""
    ways = saved(_lines(segments))
    extents = saved(M.extents(buckets, coverage, lines).select("segment_id", "direction", "from_m", "to_m"))
    asked = ways.select(F.col("id").alias("path_id"), F.col("id").alias("segment_id"), F.lit("forward").alias("direction"), F.lit(0.0).alias("at_m"))
    return Y.grow_paths(asked, ways.select("id", "line", "length_m", "street_name"), X.end_neighbours(ways, 5.0), extents, W.transitions(runs))


@query("graph_grow", "segments buckets coverage lines runs", f"WITH {GROWN} SELECT path_id, i, segment_id, direction, round(from_m, 6) AS from_m, round(to_m, 6) AS to_m, round(at_m, 6) AS at_m, source, rule, reason, round(ahead_m, 6) AS ahead_m, branches FROM gr")
def _(segments, buckets, coverage, lines, runs):
    return rounded(_grown(segments, buckets, coverage, lines, runs), "from_m", "to_m", "at_m", "ahead_m")


@query("graph_growth_census", "segments buckets coverage lines runs", f"""WITH {GROWN}, x AS (SELECT path_id, max(reason) AS reason, coalesce(sum(to_m - from_m), 0) AS metres, coalesce(sum(CASE WHEN source = 'twin' THEN to_m - from_m END), 0) AS twin_m, coalesce(sum(CASE WHEN source = 'none' THEN to_m - from_m END), 0) AS none_m FROM gr GROUP BY path_id)
    SELECT reason, count(*) AS paths, round(sum(metres), 3) AS metres, round(sum(twin_m), 3) AS twin_m, round(sum(none_m), 3) AS none_m, round(quantile_cont(metres, 0.25), 3) AS metres_p25, round(quantile_cont(metres, 0.5), 3) AS metres_p50, round(quantile_cont(metres, 0.75), 3) AS metres_p75 FROM x GROUP BY reason""")
def _(segments, buckets, coverage, lines, runs):
    return rounded(P.growth_census(_grown(segments, buckets, coverage, lines, runs)), "metres", "twin_m", "none_m", "metres_p25", "metres_p50", "metres_p75", places=3)


@query("graph_rule_census", "segments buckets coverage lines runs", f"WITH {GROWN} SELECT rule, count(*) AS choices, count(DISTINCT path_id) AS paths FROM gr WHERE rule IS NOT NULL GROUP BY rule")
def _(segments, buckets, coverage, lines, runs):
    return P.rule_census(_grown(segments, buckets, coverage, lines, runs))


@query("path_drawn_spans", "segments buckets coverage lines runs pass_buckets", f"""WITH {RANGES}, gw AS (WITH {GROWN} SELECT * FROM gr WHERE i IS NOT NULL),
    dr AS (SELECT segment_id, direction, 'line' AS source, a, b, slope_pct FROM rg UNION ALL SELECT segment_id, CASE WHEN direction = 'forward' THEN 'backward' ELSE 'forward' END, 'twin', length_m - b, length_m - a, -slope_pct FROM rg),
    px AS (SELECT gw.*, l.length_m, k.source IS NOT NULL AS known FROM gw JOIN lines l ON l.segment_id = gw.segment_id LEFT JOIN (SELECT DISTINCT segment_id, direction, source FROM dr) k ON k.segment_id = gw.segment_id AND k.direction = gw.direction AND k.source = gw.source),
    ms AS (SELECT path_id, i, at_m + greatest(from_m, a) - from_m AS at_m, least(to_m, b) - greatest(from_m, a) AS length_m, slope_pct, px.source FROM px JOIN dr ON dr.segment_id = px.segment_id AND dr.direction = px.direction AND dr.source = px.source WHERE least(to_m, b) > greatest(from_m, a)),
    hp AS (SELECT path_id, i, k, segment_id, CASE WHEN (source = 'line') = (direction = 'forward') THEN 'forward' ELSE 'backward' END AS direction, CASE WHEN source = 'line' THEN m ELSE length_m - m END AS m FROM (SELECT *, 0 AS k, from_m AS m FROM px UNION ALL SELECT *, 1, to_m FROM px) WHERE known),
    hn AS (SELECT path_id, i, k, m, max(distance_m) FILTER (distance_m < m) AS d0, min(distance_m) FILTER (distance_m >= m) AS d1, arg_max(elevation_m, distance_m) FILTER (distance_m < m) AS e0, arg_min(elevation_m, distance_m) FILTER (distance_m >= m) AS e1 FROM hp JOIN buckets b ON b.segment_id = hp.segment_id AND b.direction = hp.direction GROUP BY path_id, i, k, m),
    hh AS (SELECT path_id, i, k, CASE WHEN d0 IS NULL THEN e1 WHEN d1 IS NULL THEN e0 ELSE e0 + (m - d0) / (d1 - d0) * (e1 - e0) END AS h FROM hn),
    pb AS (SELECT px.path_id, px.i, px.at_m, NOT known AS bare, to_m - from_m AS m, f.h AS fh, t.h AS th FROM px LEFT JOIN hh f ON f.path_id = px.path_id AND f.i = px.i AND f.k = 0 LEFT JOIN hh t ON t.path_id = px.path_id AND t.i = px.i AND t.k = 1),
    pz AS (SELECT *, CASE WHEN bare AND lag(bare) OVER w THEN 0 ELSE 1 END AS fresh, lag(th) OVER w AS bf, lead(fh) OVER w AS af FROM pb WINDOW w AS (PARTITION BY path_id ORDER BY i)), py AS (SELECT *, sum(fresh) OVER (PARTITION BY path_id ORDER BY i) AS isl FROM pz),
    pr AS (SELECT path_id, isl, sum(m) AS m, arg_min(row(bf), i)[1] AS bf, arg_max(row(af), i)[1] AS af FROM py WHERE bare GROUP BY 1, 2)
    SELECT path_id, i, round(at_m, 6) AS at_m, round(length_m, 6) AS length_m, round(slope_pct, 5) + 0e0 AS slope_pct, source FROM (SELECT * FROM ms
      UNION ALL SELECT py.path_id, py.i, py.at_m, py.m, CASE WHEN pr.bf IS NULL OR pr.af IS NULL OR pr.m <= 0 THEN 0 ELSE greatest(-25, least(25, (pr.af - pr.bf) / pr.m * 100)) END, 'none' FROM py JOIN pr ON pr.path_id = py.path_id AND pr.isl = py.isl WHERE py.bare)""")
def _(segments, buckets, coverage, lines, runs, passes):
    """What is drawn along every grown path."""
    pieces = _grown(segments, buckets, coverage, lines, runs).where("i IS NOT NULL")
    ranges = saved(M.drawn_ranges(M.drawn_stops(buckets, coverage, lines, passes)))
    return rounded(rounded(Y.path_spans(pieces, ranges, buckets, lines), "at_m", "length_m"), "slope_pct", places=5)


@query("graph_score_rules", "segments buckets coverage lines runs", f"""WITH {GROWN}, mv AS (SELECT DISTINCT session_id, segment_id AS id, CASE WHEN direction = 'forward' THEN 0 ELSE 1 END AS d, next_segment_id AS t, CASE WHEN next_direction = 'forward' THEN 0 ELSE 1 END AS td FROM tr),
    ms AS (SELECT DISTINCT session_id, id, d FROM mv), s1 AS (SELECT ms.session_id, ar.* REPLACE (ar.rides - CASE WHEN mv.t IS NULL THEN 0 ELSE 1 END AS rides) FROM ms JOIN ar ON ar.id = ms.id AND ar.d = ms.d LEFT JOIN mv ON mv.session_id = ms.session_id AND mv.id = ar.id AND mv.d = ar.d AND mv.t = ar.t AND mv.td = ar.td),
    s2 AS (SELECT *, max(CASE WHEN src = 0 THEN rides ELSE 0 END) OVER g AS top, row_number() OVER (g ORDER BY CASE WHEN same THEN 0 ELSE 1 END, turn, src, t, td) AS by_name, row_number() OVER (g ORDER BY CASE WHEN turn <= 60 THEN 0 ELSE 1 END, src, turn, t, td) AS by_turn FROM s1 WINDOW g AS (PARTITION BY session_id, id, d)),
    s3 AS (SELECT session_id, id, d, max(top) AS top, count(*) FILTER (src = 0 AND rides = top) AS leaders, max(t * 2 + td) FILTER (src = 0 AND rides = top) AS h, max(t * 2 + td) FILTER (by_name = 1 AND same) AS n, max(t * 2 + td) FILTER (by_turn = 1 AND turn <= 60) AS u FROM s2 GROUP BY session_id, id, d HAVING count(*) > 1),
    s4 AS (SELECT *, CASE WHEN top > 0 AND leaders = 1 THEN 'history' WHEN n IS NOT NULL THEN 'name' WHEN u IS NOT NULL THEN 'turn' END AS rule, CASE WHEN top > 0 AND leaders = 1 THEN h WHEN n IS NOT NULL THEN n ELSE u END AS nx FROM s3)
    SELECT rule, CASE WHEN rule IS NULL THEN 'stopped' WHEN nx = t * 2 + td THEN 'right' ELSE 'wrong' END AS verdict, count(*) AS moves FROM s4 JOIN mv ON mv.session_id = s4.session_id AND mv.id = s4.id AND mv.d = s4.d GROUP BY 1, 2""")
def _(segments, buckets, coverage, lines, runs):
    """Every session's moves at forks, judged by all rules in order against the rides of the others."""
    ways = saved(_lines(segments))
    extents = M.extents(buckets, coverage, lines).select("segment_id", "direction", "from_m", "to_m")
    return Y.score_rules(ways.select("id", "line", "length_m", "street_name"), X.end_neighbours(ways, 5.0), extents, W.transitions(runs))


@query("graph_connect", "segments buckets coverage lines runs")
def _(segments, buckets, coverage, lines, runs):
    """From every line to the one whose id is 40 further, counted round after the last id; a target that is folded into another line has no way."""
    graph = _graph(segments, buckets, coverage, lines, runs)
    ids = (segments.agg(F.max("id")).first()[0] or 0) + 1
    asked = _from_all(graph[0]).withColumn("to_segment_id", (F.col("segment_id") + 40) % ids)
    return P.connect_all(asked.withColumns({"to_direction": F.lit("forward"), "to_m": F.lit(5.0)}), *graph)


@query("path_steepest", "spans", f"""WITH {SP}, nx AS (SELECT *, row_number() OVER w AS k, lead(at_m) OVER w AS at1, lead(height_m) OVER w AS h1, sum(CASE WHEN source = 'none' THEN length_m ELSE 0 END) OVER w AS g1 FROM sp WINDOW w AS (PARTITION BY path_id ORDER BY i)),
    sg AS (SELECT path_id, at_m AS x0, coalesce(at1, at_m + length_m) AS x1, height_m AS h0, coalesce(h1, height_m + rise_m) AS h1, g1 - CASE WHEN source = 'none' THEN length_m ELSE 0 END AS g0, g1 FROM nx), wh AS (SELECT path_id, max(x1) AS m FROM sg GROUP BY path_id),
    ed AS (SELECT path_id, x0 AS x FROM sg UNION SELECT path_id, x1 FROM sg), c0 AS (SELECT DISTINCT e.path_id, greatest(0e0, least(e.x - d, m - 100)) AS x FROM ed e JOIN wh ON wh.path_id = e.path_id, (SELECT unnest([0e0, 100e0]) AS d) WHERE m >= 100),
    c1 AS (SELECT c.path_id, c.x, h0 + (h1 - h0) * (c.x - x0) / (x1 - x0) AS ha, g0 + (g1 - g0) * (c.x - x0) / (x1 - x0) AS ga FROM c0 c ASOF JOIN sg ON sg.path_id = c.path_id AND c.x >= sg.x0),
    c2 AS (SELECT *, x + 100 AS y FROM c1), c3 AS (SELECT c.path_id, c.x, 25 - (g0 + (g1 - g0) * least(1, (y - x0) / (x1 - x0)) - ga) AS spare, h0 + (h1 - h0) * least(1, (y - x0) / (x1 - x0)) - ha AS up FROM c2 c ASOF JOIN sg ON sg.path_id = c.path_id AND c.y >= sg.x0),
    c4 AS (SELECT *, lead(x) OVER w AS xn, lead(spare) OVER w AS sn, lead(up) OVER w AS un FROM c3 WINDOW w AS (PARTITION BY path_id ORDER BY x)),
    c5 AS (SELECT path_id, x, up FROM c3 WHERE spare >= -0.0001e0 UNION ALL SELECT path_id, x + spare / (spare - sn) * (xn - x), up + spare / (spare - sn) * (un - up) FROM c4 WHERE spare * sn < 0),
    c6 AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY round(abs(up), 9) DESC, x) AS r FROM c5)
    SELECT wh.path_id, round(up, 5) + 0e0 AS grade_pct, round(x, 5) + 0e0 AS at_m FROM wh LEFT JOIN c6 ON c6.path_id = wh.path_id AND r = 1""")
def _(spans):
    return rounded(P.steepest(_spans(spans)), "grade_pct", "at_m", places=5)


@query("match_place_on_line", "samples segments", f"""WITH fx AS (SELECT a.id, g.id AS segment_id, a.lon, a.lat FROM samples a JOIN segments g ON g.id = a.id % 500),
    pt AS (SELECT id AS segment_id, unnest([0, 1, 2, 3]) AS k, unnest([lon0, lon0, (lon0 + lon1) / 2 + 3e-4, lon1]) AS x, unnest([lat0, lat0, (lat0 + lat1) / 2, lat1]) AS y FROM segments),
    lg AS (SELECT segment_id, k, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM pt WINDOW w AS (PARTITION BY segment_id ORDER BY k)), lm AS (SELECT *, {hav('x', 'y', 'x1', 'y1')} AS m, sum({hav('x', 'y', 'x1', 'y1')}) OVER (PARTITION BY segment_id ORDER BY k) AS fin FROM lg WHERE x1 IS NOT NULL),
    fl AS (SELECT fx.id, fx.segment_id, lm.k, lm.m, lm.fin, (lm.x - fx.lon) * 111320 * cos(radians(fx.lat)) AS ax, (lm.y - fx.lat) * 111320 AS ay, (lm.x1 - lm.x) * 111320 * cos(radians(fx.lat)) AS dx, (lm.y1 - lm.y) * 111320 AS dy FROM fx JOIN lm ON lm.segment_id = fx.segment_id WHERE lm.m >= 0.01e0),
    ft AS (SELECT *, greatest(0e0, least(1e0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM fl), fo AS (SELECT *, sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) AS off FROM ft)
    SELECT id, segment_id, round(fin - m + t * m, 5) + 0e0 AS along_m, round(off, 5) + 0e0 AS offset_m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY off, k) AS r FROM fo) WHERE r = 1""")
def _(samples, segments):
    """Every fix on a line of several legs, one of them of no length."""
    bend = F.array((F.col("lon0") + F.col("lon1")) / 2 + 3e-4, (F.col("lat0") + F.col("lat1")) / 2)
    lines = segments.select(F.col("id").alias("segment_id"), F.array(F.array("lon0", "lat0"), F.array("lon0", "lat0"), bend, F.array("lon1", "lat1")).alias("line"))
    fixes = samples.select("id", (F.col("id") % 500).alias("segment_id"), "lon", "lat")
    return rounded(X.located(fixes, lines, 0.01).select("id", "segment_id", "along_m", "offset_m"), "along_m", "offset_m", places=5)


@query("match_sessions", "samples segments")
def _(samples, segments):
    """Whole-session processing; the rides of the surrogate jump about, so that few runs qualify."""
    rows = _rows(samples).withColumn("accuracy_m", F.lit(None).cast("double"))
    ways = _lines(segments)
    return X.process_sessions(rows, ways)["runs"].select("session_id", "run", "segment_id", "direction", "fixes", "qualified")


@query("link_frontage", "segments")
def _(segments):
    ways = _lines(segments)
    return rounded(N.frontage(ways.where("kind <> 'road'"), ways.where("kind = 'road'")), "metres")


@query("link_plan", "segments")
def _(segments):
    ways = _lines(segments)
    plan = N.link_plan(ways.where(N.fold_eligible(F.col("kind"), F.col("street_name"))), ways.where("kind = 'road'"))
    return rounded(N.decide(plan).select("id", "frontage", "parent_id", "parent_frontage", "best_street_frontage", "connected", "change", "new_parent"), "frontage", "parent_frontage", "best_street_frontage")


# --- diagnosis


@query("diagnose_hole_causes", "buckets run_fixes", f"""WITH bk AS (SELECT segment_id, direction, distance_m FROM buckets WHERE (segment_id + distance_m / 15) % 3 <> 0), ho AS (SELECT * FROM (SELECT segment_id, direction, distance_m AS from_m, lead(distance_m) OVER (PARTITION BY segment_id, direction ORDER BY distance_m) AS to_m FROM bk) WHERE to_m - from_m > 15),
    pl AS (SELECT *, epoch_us(recorded_at) / 1e6 AS at_s, {BUCKET} AS b FROM run_fixes), pr AS (SELECT segment_id, direction, least(b, a) AS lo, greatest(b, a) AS hi FROM (SELECT segment_id, direction, b, lag(b) OVER (PARTITION BY match_id ORDER BY at_s, along_m) AS a FROM pl) WHERE a IS NOT NULL),
    ls AS (SELECT segment_id, direction, b AS distance_m, count(*) FILTER (line_no = 3) AS dropped, count(*) FILTER (line_no > 3) AS elsewhere FROM pl GROUP BY 1, 2, 3)
    SELECT ho.*, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE pr.segment_id = ho.segment_id AND pr.direction = ho.direction AND lo <= from_m AND hi >= to_m) THEN 'crossed' WHEN EXISTS (SELECT 1 FROM ls WHERE ls.segment_id = ho.segment_id AND ls.direction = ho.direction AND ls.distance_m > from_m AND ls.distance_m < to_m AND dropped > 0) THEN 'dropped'
      WHEN EXISTS (SELECT 1 FROM ls WHERE ls.segment_id = ho.segment_id AND ls.direction = ho.direction AND ls.distance_m > from_m AND ls.distance_m < to_m AND elsewhere > 0) THEN 'elsewhere' ELSE 'between-runs' END AS cause FROM ho""")
def _(buckets, fixes):
    holes = W.interior_holes(buckets.where((F.col("segment_id") + F.col("distance_m") / 15) % 3 != 0))
    placed = fixes.select("match_id", "segment_id", "direction", (S.micros(F.col("recorded_at")) / 1e6).alias("at_s"), "along_m", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    losses = fixes.groupBy("segment_id", "direction", S.bucket(F.col("along_m")).alias("distance_m")).agg(F.count_if(F.col("line_no") == 3).alias("dropped"), F.count_if(F.col("line_no") > 3).alias("elsewhere"))
    return D.hole_causes(holes, W.straddling_pairs(holes, placed), losses).select("segment_id", "direction", "from_m", "to_m", "cause")


FATES = "ft AS (SELECT segment_id, direction, (match_id % 10) / 10e0 AS share FROM runs), ln AS (SELECT segment_id, direction, CAST(segment_id * 2 AS DOUBLE) AS length_m FROM runs GROUP BY 1, 2)"


def _fates(runs):
    fates = runs.select("segment_id", "direction", (F.col("match_id") % 10 / 10.0).alias("share"))
    return runs.select("segment_id", "direction").distinct().withColumn("length_m", F.col("segment_id") * 2.0), fates


@query("diagnose_line_verdicts", "runs", f"WITH {FATES} SELECT ln.segment_id, ln.direction, ln.length_m, CASE WHEN count(share) = 0 THEN CASE WHEN ln.length_m < 25 THEN 'no-witness' ELSE 'phantom' END WHEN min(share) >= 0.5 THEN 'next-door' ELSE 'real-loss' END AS verdict FROM ln LEFT JOIN ft ON ft.segment_id = ln.segment_id AND ft.direction = ln.direction GROUP BY 1, 2, 3")
def _(runs):
    return D.line_verdicts(*_fates(runs))


@query("diagnose_sensitivity", "runs", f"WITH {FATES} SELECT s AS share, verdict, count(*) AS lines FROM (SELECT s, ln.segment_id, ln.direction, CASE WHEN count(share) = 0 THEN CASE WHEN any_value(ln.length_m) < 25 THEN 'no-witness' ELSE 'phantom' END WHEN min(share) >= s THEN 'next-door' ELSE 'real-loss' END AS verdict FROM ln CROSS JOIN (SELECT unnest([0.3e0, 0.7e0]) AS s) LEFT JOIN ft ON ft.segment_id = ln.segment_id AND ft.direction = ln.direction GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(runs):
    return D.sensitivity(*_fates(runs), [0.3, 0.7])


@query("diagnose_run_fates", "runs", f"WITH {FATES} SELECT ln.segment_id, ln.direction, CASE WHEN count(share) = 0 THEN 'unknown' WHEN min(share) >= 0.5 THEN 'drawn-elsewhere' ELSE 'drawn-nowhere' END AS fate FROM ln LEFT JOIN ft ON ft.segment_id = ln.segment_id AND ft.direction = ln.direction GROUP BY 1, 2")
def _(runs):
    return D.run_fates(*_fates(runs)).drop("length_m")


@query("diagnose_judged_admissions", "runs", """WITH r AS (SELECT match_id, session_id // 40 % 2 AS half, session_id % 40 AS session_id, segment_id, direction, epoch_us(started_at) / 1e6 AS started, epoch_us(ended_at) / 1e6 + 9e6 AS ended FROM runs), a AS (SELECT * FROM r WHERE half = 0), p AS (SELECT * FROM r WHERE half = 1)
    SELECT a.match_id, CASE WHEN count(p.match_id) FILTER (p.direction = a.direction) > 0 THEN 'witnessed' WHEN count(p.match_id) > 0 THEN 'denied' ELSE 'unjudgeable' END AS judged FROM a LEFT JOIN p ON p.session_id = a.session_id AND p.segment_id = a.segment_id AND a.started <= p.ended AND p.started <= a.ended GROUP BY 1""")
def _(runs):
    """Odd and even blocks of 40 sessions: sessions are compared by their place in a block, so that both halves have each."""
    r = runs.select("match_id", "session_id", "segment_id", "direction", (S.micros(F.col("started_at")) / 1e6).alias("started"), (S.micros(F.col("ended_at")) / 1e6 + 9e6).alias("ended"))
    a, b = [r.where(F.floor(F.col("session_id") / 40) % 2 == k).withColumn("session_id", F.col("session_id") % 40) for k in (0, 1)]
    return D.judged_admissions(a, b.drop("match_id")).select("match_id", "judged")


@query("diagnose_faithful_buckets", "buckets pass_buckets", """WITH x AS (SELECT segment_id, direction, distance_m, avg(elevation_m) AS e, count(*) AS n FROM pass_buckets WHERE session_id % 50 <> 0 GROUP BY 1, 2, 3) SELECT b.segment_id, b.direction, b.distance_m, coalesce(b.sample_count = x.n AND abs(b.elevation_m - x.e) < 0.05, false) AS faithful FROM buckets b LEFT JOIN x ON x.segment_id = b.segment_id AND x.direction = b.direction AND x.distance_m = b.distance_m""")
def _(buckets, passes):
    return D.faithful_buckets(buckets, M.bucket_model(passes.where("session_id % 50 <> 0"))).select("segment_id", "direction", "distance_m", "faithful")


@query("model_discard_report", "runs segments", """WITH q AS (SELECT r.*, greatest(0e0, from_m) AS a, least(r.length_m, to_m) AS b, s.kind FROM runs r JOIN segments s ON s.id = r.segment_id), k AS (SELECT session_id, segment_id, direction, greatest(0e0, max(b) - min(a)) AS span FROM q GROUP BY 1, 2, 3)
    SELECT kind, count(*) FILTER (span >= 25 OR span / length_m >= 0.7e0) AS fragments, count(*) FILTER (NOT (span >= 25 OR span / length_m >= 0.7e0)) AS touches, count(*) AS runs FROM q JOIN k ON k.session_id = q.session_id AND k.segment_id = q.segment_id AND k.direction = q.direction WHERE NOT (span_m >= 25 OR span_m / length_m >= 0.7e0) GROUP BY 1""")
def _(runs, segments):
    rows = M.assess(runs.withColumn("covered_from_m", F.greatest(F.lit(0.0), "from_m")).withColumn("covered_to_m", F.least("length_m", "to_m")))
    return R.discard_report(R.reach(rows).join(segments.select(F.col("id").alias("segment_id"), "kind"), "segment_id"))


# --- selections


def _path_pieces(spans):
    rows = W.running_metres(spans)
    return rows.withColumns({"from_m": F.lit(2.0), "to_m": F.col("length_m") + 2, "rides": F.col("segment_id") + 1, "last_us": F.col("segment_id") * 1000})


@query("selection_append", "spans", f"""WITH {'sp0 AS (SELECT *, slope_pct * length_m / 100 AS rise_m FROM spans)'}, u AS (SELECT path_id % 150 AS path_id, path_id >= 150 AS late, i, length_m, rise_m FROM sp0), o AS (SELECT path_id, late, i, length_m, rise_m FROM u)
    SELECT path_id, CAST(row_number() OVER w AS BIGINT) AS n, coalesce(sum(length_m) OVER p, 0) AS at_m, round(coalesce(sum(rise_m) OVER p, 0), 6) + 0e0 AS height_m FROM o WINDOW w AS (PARTITION BY path_id ORDER BY late, i), p AS (PARTITION BY path_id ORDER BY late, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spans):
    rows = _spans(spans).withColumn("piece", F.col("i"))
    a, b = rows.where("path_id < 150"), rows.where("path_id >= 150").withColumn("path_id", F.col("path_id") - 150)
    both = E.appended(a, b)
    n = F.row_number().over(Window.partitionBy("path_id").orderBy("i")).cast("long")
    return rounded(both.select("path_id", n.alias("n"), "at_m", "height_m"), "height_m")


@query("selection_pieces_at", "spans", f"""WITH {'sp AS (SELECT *, coalesce(sum(length_m) OVER (PARTITION BY path_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_m FROM spans)'}, t AS (SELECT path_id, max(i) AS l FROM sp GROUP BY 1), m AS (SELECT DISTINCT path_id, x AS m FROM spans, (SELECT unnest([0e0, 33.3e0, 200.7e0, 1e7]) AS x))
    SELECT m.path_id, m.m, min(i) AS i, arg_min(segment_id, i) AS segment_id, arg_min(direction, i) AS direction, round(arg_min(2 + least(greatest(0, m.m - at_m), length_m), i), 6) AS on_line_m FROM m JOIN sp ON sp.path_id = m.path_id JOIN t ON t.path_id = m.path_id WHERE m.m <= at_m + length_m OR i = l GROUP BY 1, 2""")
def _(spans):
    points = spans.select("path_id").distinct().select("path_id", F.explode(F.array(*[F.lit(x) for x in (0.0, 33.3, 200.7, 1e7)])).alias("m"))
    return rounded(E.pieces_at(_path_pieces(spans), points), "on_line_m")


@query("selection_rides", "spans", "SELECT path_id, min(segment_id + 1) FILTER (source <> 'none') AS rides_min, max(segment_id + 1) FILTER (source <> 'none') AS rides_max, max(segment_id * 1000) AS last_us FROM spans GROUP BY 1")
def _(spans):
    return E.rides_of(_path_pieces(spans))


@query("selection_segment_ids", "spans", "WITH f AS (SELECT path_id, segment_id, min(i) AS i FROM spans GROUP BY 1, 2) SELECT path_id, string_agg(CAST(segment_id AS VARCHAR), ',' ORDER BY i) AS ids FROM f GROUP BY 1")
def _(spans):
    return E.segment_ids(_path_pieces(spans)).select("path_id", F.array_join(F.col("segment_ids").cast("array<string>"), ",").alias("ids"))


# the same queries under the names that their forms over whole tables had while SQL fixed slices
