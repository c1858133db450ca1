"""Map matching: candidate join by grid cells, the run state machine, adjacency of segment ends, and whole-session processing."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import DEFAULT, EngineConfig
from ridgeline.functions import geo as G
from ridgeline.functions import scalar as S
from ridgeline.operators import network as N
from ridgeline.operators.growth import legs
from ridgeline.operators.windows import derived_headings, spike_measures
from ridgeline.plans.storage import saved, shuffled

#: Degrees of a grid cell: more than the match distance at any latitude that has streets.
CELL_DEG = 0.0005
#: Ends of a node in one salt; all ends of the node meet each salt, so that they are copied as often as this many fit in them.
CROWD = 16_384


def segment_edges(segments: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Edges of segments (id, line, bearing_deg) with their local tangent: the bearing over the window around their middle."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                line = np.array([list(p) for p in r.line], dtype=float)
                if len(line) < 2:
                    continue
                at = N.line_metres(line)
                for k in range(len(line) - 1):
                    tangent = r.bearing_deg
                    if config.tangent_window_m > 0:
                        mid = (at[k] + at[k + 1]) / 2
                        a, b = (N.point_at(line, at, mid + s * config.tangent_window_m) for s in (-1, 1))
                        if N.haversine(a[0], a[1], b[0], b[1]) >= 1:
                            tangent = (N.bearing(a, b) + 360) % 360
                    out.append((r.id, k, *line[k], *line[k + 1], tangent))
            yield pd.DataFrame(out, columns=["segment_id", "edge", "ax", "ay", "bx", "by", "tangent_deg"])

    return segments.select("id", "line", "bearing_deg").mapInPandas(run, "segment_id long, edge int, ax double, ay double, bx double, by double, tangent_deg double")


def straight_edges(segments: DataFrame) -> DataFrame:
    """Edges of segments of one leg (id, lon0, lat0, lon1, lat1, bearing_deg), without Python."""
    return segments.select(F.col("id").alias("segment_id"), F.lit(0).alias("edge"), F.col("lon0").alias("ax"), F.col("lat0").alias("ay"), F.col("lon1").alias("bx"), F.col("lat1").alias("by"), F.col("bearing_deg").alias("tangent_deg"))


def admissible(samples: DataFrame, heading: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """Fixes with a heading that are accurate enough, or say nothing of their accuracy."""
    return samples.where(F.col(heading).isNotNull() & (F.col(heading) >= 0) & (F.col("accuracy_m").isNull() | (F.col("accuracy_m") <= config.max_accuracy_m)))


def _near(fixes: DataFrame, edges: DataFrame, heading: str, config: EngineConfig) -> DataFrame:
    """Each fix with every edge within reach, whichever way it runs: session_id, fix_id, recorded_at, heading, the edge and distance_m.

    Fixes meet edges in the grid cells that an edge, widened by the reach, covers; so no fix meets every edge."""
    reach = config.max_match_distance_m / 111_320.0
    lat_pad = reach * 1.001
    lon_pad = lambda a, b: reach * 1.001 / F.greatest(F.lit(0.01), F.least(F.cos(F.radians(a)), F.cos(F.radians(b))))
    span = lambda a, b, pad: F.explode(F.sequence(G.cell(F.least(a, b) - pad, CELL_DEG), G.cell(F.greatest(a, b) + pad, CELL_DEG)))
    e = edges.withColumn("cx", span(F.col("ax"), F.col("bx"), lon_pad(F.col("ay"), F.col("by")))).withColumn("cy", span(F.col("ay"), F.col("by"), F.lit(lat_pad)))
    f = fixes.select("session_id", F.col("id").alias("fix_id"), "recorded_at", "lon", "lat", F.col(heading).alias("heading"), G.cell(F.col("lon"), CELL_DEG).alias("cx"), G.cell(F.col("lat"), CELL_DEG).alias("cy"))
    near = f.join(shuffled(e), ["cx", "cy"])
    return near.withColumn("distance_m", G.point_to_edge_m(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).where(F.col("distance_m") <= config.max_match_distance_m)


def candidates(fixes: DataFrame, edges: DataFrame, heading: str = "heading_deg", config: EngineConfig = DEFAULT) -> DataFrame:
    """Each fix with every segment whose nearest aligned edge is within reach: distance and direction."""
    near = _near(fixes, edges, heading, config)
    near = near.withColumn("direction", G.direction_for_bearing(F.col("heading"), F.col("tangent_deg"), config.max_bearing_delta_deg)).where("direction IS NOT NULL")
    best = near.groupBy("session_id", "fix_id", "recorded_at", "segment_id").agg(F.min(F.struct("distance_m", "edge", "direction")).alias("m"))
    return best.select("session_id", "fix_id", "recorded_at", "segment_id", F.col("m.direction").alias("direction"), F.col("m.distance_m").alias("distance_m"))


def candidate_arms(fixes: DataFrame, edges: DataFrame, arms: dict[str, tuple[float, float]], heading: str = "heading_deg", config: EngineConfig = DEFAULT) -> DataFrame:
    """candidates() under each arm of a sweep (name: reach in metres, most degrees off), with the arm: one join at the widest setting serves all.

    What an arm takes of a fix's edges is decided before the arms part, so no row is copied to an arm that it isn't in."""
    widest = replace(config, max_match_distance_m=max(r for r, _ in arms.values()))
    near = _near(fixes, edges, heading, widest)
    taken = [F.struct(F.lit(name).alias("arm"), F.when(F.col("distance_m") <= reach, G.direction_for_bearing(F.col("heading"), F.col("tangent_deg"), most)).alias("direction")) for name, (reach, most) in arms.items()]
    near = near.withColumn("x", F.explode(F.filter(F.array(*taken), lambda x: x["direction"].isNotNull())))
    best = near.groupBy("session_id", "fix_id", "recorded_at", "segment_id", F.col("x.arm").alias("arm")).agg(F.min(F.struct("distance_m", "edge", F.col("x.direction").alias("direction"))).alias("m"))
    return best.select("arm", "session_id", "fix_id", "recorded_at", "segment_id", F.col("m.direction").alias("direction"), F.col("m.distance_m").alias("distance_m"))


def sweep_report(found: DataFrame) -> DataFrame:
    """Per arm: fixes with a candidate, candidates, the lines that are nearest to any fix, and the mean distance of the nearest."""
    per_fix = found.groupBy("arm", "session_id", "fix_id").agg(F.min(F.struct("distance_m", "segment_id", "direction")).alias("m"), F.count("*").alias("n"))
    return per_fix.groupBy("arm").agg(F.count("*").alias("fixes"), F.sum("n").alias("candidates"), F.countDistinct("m.segment_id", "m.direction").alias("lines"), F.avg("m.distance_m").alias("mean_m"))


def nearest(found: DataFrame) -> DataFrame:
    """The nearest candidate of each fix; ties go to the lower segment id."""
    best = found.groupBy("session_id", "fix_id").agg(F.min(F.struct("distance_m", "segment_id", "direction")).alias("m"))
    return best.select("session_id", "fix_id", "m.segment_id", "m.direction", "m.distance_m")


def end_neighbours(segments: DataFrame, snap_m: float = DEFAULT.endpoint_snap_m) -> DataFrame:
    """(segment_id, which, other): segments that touch the start or end of a segment.

    Consecutive pieces of one cut way touch at their cut; real ends touch at a shared node and, with a snap distance,
    where they are that near.  Pairs come from equality joins on way, node or grid cell."""
    return _touching(segments, snap_m, ["segment_id", "which"])


def _touching(segments: DataFrame, snap_m: float, key: list[str]) -> DataFrame:
    """The key (a segment, or one of its ends) with the other segments that it touches, each once.

    The pairs of a node are many where many ends meet, so they are dealt over salts and aren't shuffled again: a pair is
    taken at the least node that both have, and cuts and near ends, which are few, leave out what shares a node."""
    keyed = segments.withColumn("lo", F.least("start_node_id", "end_node_id")).withColumn("hi", F.greatest("start_node_id", "end_node_id"))
    family = Window.partitionBy("osm_way_id", "lo", "hi")
    w = family.orderBy("piece_index", "id")
    rows = keyed.select("*", F.count("*").over(family).alias("pieces"), F.max("piece_index").over(family).alias("last_piece"), F.lag("id").over(w).alias("prev_id"), F.lag("piece_index").over(w).alias("prev_piece"))
    rows = rows.withColumn("real_start", (F.col("pieces") < 2) | (F.col("piece_index") == 0)).withColumn("real_end", (F.col("pieces") < 2) | (F.col("piece_index") == F.col("last_piece")))
    rows = saved(rows.select("id", "start_node_id", "end_node_id", "lon0", "lat0", "lon1", "lat1", "piece_index", "prev_id", "prev_piece", "real_start", "real_end"))
    chained = rows.where(F.col("piece_index") - F.col("prev_piece") == 1)
    cuts = chained.select(F.col("id").alias("segment_id"), F.lit("start").alias("which"), F.col("prev_id").alias("other")).unionByName(chained.select(F.col("prev_id").alias("segment_id"), F.lit("end").alias("which"), F.col("id").alias("other")))
    few = cuts.select(*key, "other")
    at = lambda real, which, node, lon, lat: rows.where(real).select(F.col("id").alias("segment_id"), F.lit(which).alias("which"), F.col(node).alias("node"), F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    ends = at("real_start", "start", "start_node_id", "lon0", "lat0").unionByName(at("real_end", "end", "end_node_id", "lon1", "lat1"))
    if snap_m > 0:
        size = snap_m / 70_000
        here = ends.select(*key, "lon", "lat", G.cell(F.col("lon"), size).alias("cx"), G.cell(F.col("lat"), size).alias("cy"))
        around = here.select(F.col("segment_id").alias("other"), F.col("lon").alias("olon"), F.col("lat").alias("olat"), F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cy").withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
        close = here.join(shuffled(around), ["cx", "cy"]).where("segment_id <> other").where(G.haversine_m(F.col("lon"), F.col("lat"), F.col("olon"), F.col("olat")) <= snap_m)
        few = few.unionByName(close.select(*key, "other"))
    nodes = ends.groupBy(*key).agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    theirs = ends.groupBy(F.col("segment_id").alias("other")).agg(F.collect_set("node").alias("theirs"))
    few = few.distinct().join(shuffled(nodes), key, "left").join(shuffled(theirs), "other", "left").where((F.col("segment_id") == F.col("other")) | ~F.coalesce(F.arrays_overlap("nodes", "theirs"), F.lit(False)))
    crowds = ends.where("node IS NOT NULL").groupBy("node").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("salts")).where("salts > 1")
    crowds = F.broadcast(saved(crowds))  # a row for CROWD ends
    salts = F.coalesce("salts", F.lit(1))
    one = nodes.select(*key, "nodes", F.explode("nodes").alias("node")).join(crowds, "node", "left").select(*key, "node", F.filter("nodes", lambda x: x < F.col("node")).alias("before"), F.pmod(F.xxhash64(*key), salts).cast("int").alias("salt"))
    other = theirs.select("other", "theirs", F.explode("theirs").alias("node")).join(crowds, "node", "left").select("other", "theirs", "node", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    part = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = one.repartition(part, "node", "salt").join(shuffled(other.repartition(part, "node", "salt")), ["node", "salt"])
    pairs = pairs.where((F.col("segment_id") != F.col("other")) & ((F.size("before") == 0) | ~F.arrays_overlap("before", "theirs")))
    return pairs.select(*key, "other").unionByName(few.select(*key, "other"))


def components(neighbours: DataFrame) -> DataFrame:
    """(segment_id, area) of every segment that touches another: area is the least id that it is connected with.

    Least labels among neighbours, then the label of that label; every round is cut by a checkpoint."""
    ways = saved(neighbours.select("segment_id", "other").union(neighbours.select("other", "segment_id")).distinct())
    labels = saved(ways.groupBy("segment_id").agg(F.min("other").alias("m")).select("segment_id", F.least("segment_id", "m").alias("area"), F.lit(True).alias("changed")))
    while labels.where("changed").limit(1).count():
        near = ways.join(shuffled(labels.select("segment_id", "area")), "segment_id").select(F.col("other").alias("segment_id"), "area", F.lit(None).cast("long").alias("was"))
        least = near.union(labels.select("segment_id", "area", F.col("area").alias("was"))).groupBy("segment_id").agg(F.min("area").alias("area"), F.max("was").alias("was"))
        far = least.select(F.col("segment_id").alias("area"), F.col("area").alias("beyond"))
        labels = saved(least.join(shuffled(far), "area").select("segment_id", F.least("area", "beyond").alias("area"), (F.least("area", "beyond") < F.col("was")).alias("changed")))
    return labels.select("segment_id", "area")


def adjacent(segments: DataFrame, snap_m: float = DEFAULT.endpoint_snap_m) -> DataFrame:
    """(segment_id, other): segments that touch at either end."""
    return _touching(segments, snap_m, ["segment_id"])


def adjacency(neighbours: DataFrame) -> DataFrame:
    """Segments that touch at either end, of their neighbours by end."""
    return neighbours.select("segment_id", "other").distinct()


def near_drawn(segments: DataFrame, buckets: DataFrame, box: tuple[float, float, float, float], config: EngineConfig = DEFAULT) -> DataFrame:
    """All pieces of the ways near drawn segments in a box: drawn ones by their own boxes, their neighbours by boxes widened by near_drawn_deg.

    Boxes meet through grid cells of that size."""
    rows = segments.where("canonical_segment_id IS NULL").withColumns({"minx": F.least("lon0", "lon1"), "maxx": F.greatest("lon0", "lon1"), "miny": F.least("lat0", "lat1"), "maxy": F.greatest("lat0", "lat1")})
    rows = rows.withColumn("lo", F.least("start_node_id", "end_node_id")).withColumn("hi", F.greatest("start_node_id", "end_node_id"))
    drawn = rows.where(G.boxes_overlap(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), box)).join(buckets.select(F.col("segment_id").alias("id")).distinct(), "id", "left_semi")
    pad = config.near_drawn_deg
    cells = lambda df, p: df.withColumn("cx", F.explode(F.sequence(G.cell(F.col("minx") - p, pad), G.cell(F.col("maxx") + p, pad)))).withColumn("cy", F.explode(F.sequence(G.cell(F.col("miny") - p, pad), G.cell(F.col("maxy") + p, pad))))
    d = cells(drawn, pad).select("cx", "cy", *[F.col(c).alias(f"d_{c}") for c in ("minx", "miny", "maxx", "maxy")])
    n = cells(rows, 0.0).join(d, ["cx", "cy"]).where(f"maxx >= d_minx - {pad} AND minx <= d_maxx + {pad} AND maxy >= d_miny - {pad} AND miny <= d_maxy + {pad}")
    return rows.join(n.select("osm_way_id", "lo", "hi").distinct(), ["osm_way_id", "lo", "hi"], "left_semi").drop("minx", "maxx", "miny", "maxy", "lo", "hi")


def assign_runs(at_s: np.ndarray, bounds: np.ndarray, segment: np.ndarray, way: np.ndarray, metres: np.ndarray, touching: np.ndarray, config: EngineConfig = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """For each fix of a ride, in order of time, its run and the candidate chosen for it (-1 without any).

    Fix i has the candidates bounds[i]:bounds[i + 1], in order of segment; `touching` are pairs of segments.  A candidate
    costs its distance, and a penalty where it doesn't touch the segment of the last matched fix, which is remembered for a
    while.  A run holds its line while that costs no more than a margin above the cheapest; a fix without candidates ends
    it."""
    ids, place = np.unique(segment, return_inverse=True)
    linked = np.eye(len(ids), dtype=bool)
    pair = touching[np.isin(touching, ids).all(axis=1)] if len(touching) else touching
    if len(pair):
        linked[np.searchsorted(ids, pair[:, 0]), np.searchsorted(ids, pair[:, 1])] = True
    line = 2 * place + (way == "backward")
    fee = np.where(linked, 0.0, config.disconnect_penalty_m)
    runs, chosen = np.full(len(at_s), -1), np.full(len(at_s), -1)
    held, seen_s, run = -1, -np.inf, -1
    last = -1  # place of the last matched segment
    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if lo == hi:
            held = -1
            continue
        cost = metres[lo:hi] + fee[last, place[lo:hi]] if last >= 0 and at_s[i] - seen_s <= config.anchor_max_gap_s else metres[lo:hi]
        pick = int(cost.argmin())
        same = np.flatnonzero(line[lo:hi] == held)
        if len(same) and cost[same[0]] <= cost[pick] + config.switch_margin_m:
            pick = int(same[0])
        else:
            run += 1
        held, last, seen_s = line[lo + pick], place[lo + pick], at_s[i]
        runs[i], chosen[i] = run, lo + pick
    return runs, chosen


def match_runs(fixes: DataFrame, found: DataFrame, touching: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Fixes (session_id, id, recorded_at) with the run, segment and direction that they belong to; those without a candidate break a run and go.

    A session's candidates and the adjacency among their segments are grouped together: one ride, one group."""
    nested = found.groupBy("session_id", F.col("fix_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("segment_id", "direction", "distance_m"))).alias("found"))
    rows = fixes.select("session_id", "id", (S.micros(F.col("recorded_at")) / 1e6).alias("at_s")).join(shuffled(nested), ["session_id", "id"], "left")
    used = found.select(F.col("session_id").alias("ride"), "segment_id").distinct()
    pairs = used.join(shuffled(touching), "segment_id").select("ride", "segment_id", "other")

    def run(key: tuple, ride: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        ride = ride.sort_values(["at_s", "id"], kind="stable")
        lists = [list(x) if x is not None else [] for x in ride.found]
        flat = [c for x in lists for c in x]
        segment = np.array([c["segment_id"] for c in flat], dtype=np.int64)
        way = np.array([c["direction"] for c in flat], dtype=object)
        metres = np.array([c["distance_m"] for c in flat], dtype=float)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        runs, chosen = assign_runs(ride.at_s.to_numpy(float), bounds, segment, way, metres, near[["segment_id", "other"]].to_numpy(np.int64), config)
        got = chosen >= 0
        return pd.DataFrame({"session_id": key[0], "id": ride.id.to_numpy()[got], "at_s": ride.at_s.to_numpy()[got], "run": runs[got], "segment_id": segment[chosen[got]], "direction": way[chosen[got]]})

    return rows.groupBy("session_id").cogroup(pairs.groupBy("ride")).applyInPandas(run, "session_id long, id long, at_s double, run int, segment_id long, direction string")


def stitch(matched: DataFrame, window_s: float = DEFAULT.stitch_window_s) -> DataFrame:
    """Matched fixes with their runs joined: a run within the window of the last one on the same line continues it."""
    key = ["session_id", "segment_id", "direction"]
    ends = matched.groupBy(*key, "run").agg(F.min("at_s").alias("a"), F.max("at_s").alias("b"))
    w = Window.partitionBy(*key).orderBy("run")
    ends = ends.withColumn("island", F.sum(F.when(F.col("a") - F.lag("b").over(w) <= window_s, 0).otherwise(1)).over(w))
    names = ends.withColumn("stitched", F.min("run").over(Window.partitionBy(*key, "island"))).select(*key, "run", "stitched")
    return matched.join(shuffled(names), [*key, "run"]).drop("run").withColumnRenamed("stitched", "run")


def located(fixes: DataFrame, lines: DataFrame, least_leg_m: float = 0.0) -> DataFrame:
    """Fixes (segment_id, lon, lat, ...) with along_m in geometry order and offset_m: the nearest point of their line, the first of equally near ones.

    Lines (segment_id, line) are tables of legs with running metres; a leg of less than least_leg_m is passed over.  Each
    leg is flat about the fix.  Fixes of a line without legs have no row."""
    leg = F.struct("leg", "lon0", "lat0", "lon1", "lat1", "start_m", "end_m")
    by_line = legs(lines.select(F.col("segment_id").alias("id"), "line")).where(F.col("end_m") - F.col("start_m") >= least_leg_m).groupBy("segment_id").agg(F.collect_list(leg).alias("legs_"))

    def nearest(x: Column) -> Column:
        ax, ay = G.offset_m(F.col("lon"), F.col("lat"), x["lon0"], x["lat0"])
        bx, by = G.offset_m(F.col("lon"), F.col("lat"), x["lon1"], x["lat1"])
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / square))).otherwise(0.0)
        return F.struct(F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2)).alias("off"), x["leg"].alias("leg"), (x["start_m"] + t * (x["end_m"] - x["start_m"])).alias("along"))

    rows = fixes.join(shuffled(by_line), "segment_id").withColumn("place_", F.array_min(F.transform("legs_", nearest)))
    return rows.select(*fixes.columns, F.col("place_.along").alias("along_m"), F.col("place_.off").alias("offset_m"))


def process_sessions(samples: DataFrame, segments: DataFrame, dem: DataFrame | None = None, config: EngineConfig = DEFAULT) -> dict[str, DataFrame]:
    """Cleans, matches, stitches, assesses and (with dem) anchors rides: `runs` with their verdict and `passes`, the pass buckets of those that qualify.

    segments: id, osm_way_id, start_node_id, end_node_id, piece_index, line, lon0, lat0, lon1, lat1, length_m, bearing_deg."""
    from ridgeline.operators import clean as C
    from ridgeline.operators import model as M

    rides = saved(derived_headings(C.cleaned(samples, config), config))
    found = saved(candidates(admissible(rides, "derived_deg", config), segment_edges(segments, config), "derived_deg", config))
    ends = saved(end_neighbours(segments, config.endpoint_snap_m))
    ok = admissible(rides, "derived_deg", config)
    matched = saved(stitch(match_runs(ok, found, adjacency(ends), config), config.stitch_window_s))
    places = rides.select("session_id", "id", "lon", "lat", "elevation_m")
    lines = segments.select(F.col("id").alias("segment_id"), "line", "length_m")
    flip = lambda df: df.withColumn("along_m", F.when(F.col("direction") == "forward", F.col("along_m")).otherwise(F.col("length_m") - F.col("along_m")))
    on = saved(flip(located(matched.join(shuffled(places), ["session_id", "id"]).join(shuffled(lines.select("segment_id", "length_m")), "segment_id"), lines)))
    key = ["session_id", "run", "segment_id", "direction"]
    # the fixes just before and after each run in the cleaned ride, and where they landed
    w = Window.partitionBy("session_id").orderBy("recorded_at", "id")
    order = rides.select("session_id", "id", (S.micros(F.col("recorded_at")) / 1e6).alias("s"), *[f(c).over(w).alias(f"{n}_{c}") for f, n in ((F.lag, "before"), (F.lead, "after")) for c in ("id", "lon", "lat")])
    order = order.withColumn("before_s", F.lag("s").over(Window.partitionBy("session_id").orderBy("s", "id"))).withColumn("after_s", F.lead("s").over(Window.partitionBy("session_id").orderBy("s", "id")))
    runs = matched.groupBy(*key).agg(F.min(F.struct("at_s", "id")).alias("a"), F.max(F.struct("at_s", "id")).alias("b"), F.count("*").alias("samples"))
    early = order.select(F.col("session_id").alias("sid"), F.col("id").alias("fid"), "before_id", "before_lon", "before_lat", "before_s")
    runs = runs.join(shuffled(early), (F.col("session_id") == F.col("sid")) & (F.col("a.id") == F.col("fid"))).drop("sid", "fid")
    late = order.select(F.col("session_id").alias("sid"), F.col("id").alias("lid"), "after_id", "after_lon", "after_lat", "after_s")
    runs = runs.join(shuffled(late), (F.col("session_id") == F.col("sid")) & (F.col("b.id") == F.col("lid"))).drop("sid", "lid")
    landed = matched.select(F.col("session_id").alias("sid"), F.col("id").alias("lid"), F.col("segment_id").alias("landed"))
    for side, end, gap in (("before", "a", F.col("a.at_s") - F.col("before_s")), ("after", "b", F.col("after_s") - F.col("b.at_s"))):
        runs = runs.join(shuffled(landed), (F.col("session_id") == F.col("sid")) & (F.col(f"{side}_id") == F.col("lid")), "left").withColumn(f"{side}_segment", F.col("landed")).withColumn(f"{side}_gap_s", F.abs(gap)).drop("sid", "lid", "landed")
    beside = [runs.where(F.col(f"{s}_lon").isNotNull()).select(*key, F.col(f"{s}_lon").alias("lon"), F.col(f"{s}_lat").alias("lat")) for s in ("before", "after")]
    beside = flip(located(beside[0].unionByName(beside[1]).join(shuffled(lines.select("segment_id", "length_m")), "segment_id"), lines))
    profiles = M.assess(M.run_profile(on, key, beside), config)
    through = M.passages(runs.select(*key, F.col("a.id").alias("first_sample_id"), F.col("b.id").alias("last_sample_id"), "before_segment", "before_gap_s", "after_segment", "after_gap_s"), ends, config)
    profiles = saved(M.clamp_to_passage(profiles.join(shuffled(through), key)))
    good = profiles.where("qualified")
    passes = saved(M.bucketize(on, key, config.bucket_m).join(good.select(*key), key, "left_semi"))
    anchors = None
    if dem is not None:
        anchors = M.fit_anchor(M.residuals(passes, dem), "session_id", config)
        passes = M.anchored(passes, anchors)
    return {"runs": profiles, "passes": passes.withColumn("match_id", F.xxhash64(*key)), "coverage": M.merge_coverage(good.select("segment_id", "direction", "covered_from_m", "covered_to_m")), "model": M.bucket_model(passes), "anchors": anchors, "discards": profiles.where("NOT qualified")}


def spike_ids(samples: DataFrame, min_cross_m: float, ratio: float) -> DataFrame:
    """Fixes that a position filter leaves out."""
    return spike_measures(samples).where(S.is_spike(F.col("cross_m"), F.col("chord_m"), min_cross_m, ratio)).select("session_id", "id")


def nearest_edges(points: DataFrame, edges: DataFrame, reach_m: float = DEFAULT.max_match_distance_m) -> DataFrame:
    """The nearest segment of each point (point_id, lon, lat) within reach, whatever its direction; ties to the lower id."""
    reach = reach_m / 111_320.0 * 1.001
    lon_pad = reach / F.greatest(F.lit(0.01), F.least(F.cos(F.radians("ay")), F.cos(F.radians("by"))))
    size = max(CELL_DEG, reach)
    span = lambda a, b, pad: F.explode(F.sequence(G.cell(F.least(a, b) - pad, size), G.cell(F.greatest(a, b) + pad, size)))
    e = edges.withColumn("cx", span(F.col("ax"), F.col("bx"), lon_pad)).withColumn("cy", span(F.col("ay"), F.col("by"), F.lit(reach)))
    near = points.select("point_id", "lon", "lat", G.cell(F.col("lon"), size).alias("cx"), G.cell(F.col("lat"), size).alias("cy")).join(e, ["cx", "cy"])
    near = near.withColumn("d", G.point_to_edge_m(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).where(F.col("d") <= reach_m)
    return near.groupBy("point_id").agg(F.min(F.struct("d", "segment_id")).alias("m")).select("point_id", "m.segment_id", F.col("m.d").alias("distance_m"))
