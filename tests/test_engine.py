"""Operators that SQL can't express, against plain Python or cases with known answers."""

import json
import math
from collections import Counter, defaultdict
from dataclasses import replace
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.config import DEFAULT, NO_DATA_COLOR
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
from ridgeline.plans import queries as plans
from ridgeline.plans import queries_more, queries_view
from ridgeline.plans import requests as Q
from ridgeline.plans.engine import Engine
from ridgeline.sources import accesslog, dem, network_files, snapshot
from ridgeline.sources.surrogate import model_table
from ridgeline.streaming import ingest

LON0, LAT0 = -104.82, 38.82
KX = 111_320 * math.cos(math.radians(LAT0))
T0 = datetime(2026, 5, 1)


def at(x, y):
    """A point x metres east and y north."""
    return [LON0 + x / KX, LAT0 + y / 111_320]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


# --- cleaning


def test_speed_filter_keeps_ends_and_needs_both_legs():
    t = np.arange(5.0)
    xs = [0, 5, 400, 15, 20]
    lon, lat = np.array([at(x, 0)[0] for x in xs]), np.full(5, LAT0)
    assert C.possible_speeds(t, lon, lat, 20).tolist() == [True, True, False, True, True]
    assert C.possible_speeds(np.zeros(5), lon, lat, 20).all()  # no time, no evidence
    assert C.possible_speeds(t[:2], lon[:2], lat[:2], 20).all()
    lon2 = np.array([at(x, 0)[0] for x in (0, 5, 400, 405, 410)])  # a jump that stays
    assert C.possible_speeds(t, lon2, lat, 20).all()


def test_height_filter():
    lon, lat = np.array([at(x, 0)[0] for x in (0, 5, 10, 15)]), np.full(4, LAT0)
    assert C.plausible_heights(lon, lat, np.array([100.0, 101, 130, 101]), 100, 1).tolist() == [True, False, False, True]  # the second is off the line to the spike, too
    assert C.plausible_heights(lon, lat, np.array([100.0, 103, 105, 101]), 100, 1).all()
    still = np.full(4, LON0)
    assert C.plausible_heights(still, lat, np.array([100.0, 500, 130, 101]), 100, 1).all()


@pytest.mark.parametrize("n", [1, 2, 5, 60])
def test_zero_phase_average(n):
    r = np.random.default_rng(n)
    h = r.normal(0, 3, n)
    k = min(n - 1, 24)
    x = [2 * h[0] - h[i] for i in range(k, 0, -1)] + list(h) + [2 * h[-1] - h[n - 1 - i] for i in range(1, k + 1)]
    for _ in range(2):
        level, out = None, []
        for v in x:
            level = v if level is None else 0.485 * v + 0.515 * level
            out.append(level)
        x = out[::-1]
    assert np.allclose(C.zero_phase(h, 0.485, 24), x[k : k + n])
    if n > 50:  # a straight climb stays one
        assert np.allclose(C.zero_phase(np.linspace(0, 30, n), 0.485, 24), np.linspace(0, 30, n), atol=0.01)


def test_passes():
    t = np.arange(6.0)
    assert C.find_passes(t, np.arange(0, 120, 20.0), 25, 15, 45) == [("forward", 0, 100, 100, 0, 5, 6)]
    there_and_back = np.array([0, 20, 40, 60, 50, 30, 10.0])
    found = C.find_passes(np.arange(7.0), there_and_back, 25, 15, 45)
    assert [(p[0], p[1], p[2]) for p in found] == [("forward", 0, 60), ("backward", 60, 10)]
    wobble = np.array([0, 20, 40, 30, 50, 70.0])  # 10 m back is noise
    assert [(p[0], p[1], p[2]) for p in C.find_passes(t, wobble, 25, 15, 45)] == [("forward", 0, 70)]
    gap = np.array([0, 1, 2, 60, 61, 62.0])
    assert [p[1:3] for p in C.find_passes(gap, np.array([0, 20, 40, 60, 80, 100.0]), 25, 15, 45)] == [(0, 40), (60, 100)]
    assert C.find_passes(t[:1], t[:1], 25, 15, 45) == []


# --- network


def test_split_ways(spark, tmp_path):
    nodes = {1: at(0, 0), 2: at(100, 0), 3: at(200, 0), 4: at(100, 400), 5: at(104, 400)}
    ways = [(10, {"highway": "residential", "name": "Main"}, [1, 2, 3]), (11, {"highway": "path", "bicycle": "designated", "tunnel": "yes"}, [2, 4]), (12, {"highway": "motorway"}, [1, 3]), (13, {"highway": "residential"}, [4, 5]), (14, {"highway": "residential"}, [5, 99])]
    elements = [{"type": "node", "id": i, "lon": p[0], "lat": p[1]} for i, p in nodes.items()] + [{"type": "way", "id": i, "tags": t, "nodes": n} for i, t, n in ways]
    (tmp_path / "extract.json").write_text(json.dumps({"elements": elements}))
    w, n = network_files.read_extract(spark, str(tmp_path / "extract.json"))
    rows = sorted(N.split_ways(w, n).collect(), key=lambda r: (r.osm_way_id, r.start_node_id, r.piece_index))
    assert [(r.osm_way_id, r.kind, r.start_node_id, r.end_node_id, r.piece_index) for r in rows] == [(10, "road", 1, 2, 0), (10, "road", 2, 3, 0), (11, "cycleway", 2, 4, 0), (11, "cycleway", 2, 4, 1), (11, "cycleway", 2, 4, 2)]
    assert rows[2].is_tunnel and rows[0].street_name == "Main" and rows[0].bearing_deg == pytest.approx(90, abs=0.1) and rows[2].bearing_deg == pytest.approx(0, abs=0.1)
    assert [r.length_m for r in rows[2:]] == pytest.approx([400 / 3] * 3, rel=0.01)
    uses = {r.node_id: r.uses for r in N.node_uses(w).collect()}
    assert uses[2] == 2 and uses[99] == 1
    segments = N.split_ways(w, n)
    network_files.write_features(segments, str(tmp_path / "out"))
    again = network_files.read_features(spark, str(tmp_path / "out"), "osm_way_id long, length_m double, piece_index int")
    assert sorted((r.osm_way_id, r.piece_index) for r in again.collect()) == sorted((r.osm_way_id, r.piece_index) for r in rows)
    box = network_files.with_box(again).where("osm_way_id = 10").agg(F.min("minx"), F.max("maxx")).first()
    assert box[0] == pytest.approx(LON0) and box[1] == pytest.approx(at(200, 0)[0])


def test_lines():
    line = np.array([at(0, 0), at(100, 0), at(100, 50)])
    along = N.line_metres(line)
    assert along[-1] == pytest.approx(150, rel=0.01)
    assert np.allclose(N.point_at(line, along, 1e9), line[-1]) and np.allclose(N.point_at(line, along, -5), line[0])
    assert N.line_metres(N.slice_line(line, 40, 120))[-1] == pytest.approx(80, rel=0.01)
    m, off = N.locate(line, *at(60, 7))
    assert m == pytest.approx(60, rel=0.01) and off == pytest.approx(7, rel=0.01)
    side = N.travel_slice(line[:2], 100.0, "forward", 10, 60)
    assert side[0][1] < LAT0 and N.line_metres(side)[-1] == pytest.approx(50, rel=0.02)  # right of an eastbound line is south
    back = N.travel_slice(line[:2], 100.0, "backward", 10, 60)
    assert back[0][0] > back[-1][0] and back[0][1] > LAT0


SEGMENT = "id long, kind string, street_name string, start_node_id long, end_node_id long, canonical_segment_id long, line array<array<double>>"


def test_frontage_and_link_plan(spark):
    rows = [
        (1, "road", "Main", 1, 2, None, [at(0, 0), at(100, 0)]), (2, "road", "Main", 2, 3, None, [at(100, 0), at(200, 0)]), (3, "road", "Cross", 2, 9, None, [at(100, 0), at(100, 200)]),
        (10, "footway", None, 20, 21, None, [at(0, 10), at(200, 10)]), (11, "footway", None, 22, 23, 1, [at(0, 60), at(200, 60)]), (12, "footway", "Park Path", 24, 25, None, [at(10, 8), at(90, 8)]),
    ]
    df = spark.createDataFrame(rows, SEGMENT)
    roads, paths = df.where("kind = 'road'"), df.where("kind = 'footway'")
    got = {(r.path_id, r.road_id): r.metres for r in N.frontage(paths, roads).collect()}
    assert set(got) == {(10, 1), (10, 2), (12, 1)} and sum(v for k, v in got.items() if k[0] == 10) == pytest.approx(200, rel=0.01)
    plan = {r.id: r for r in N.link_plan(paths, roads).collect()}
    assert plan[10].parent_id in (1, 2) and plan[10].connected and plan[10].streets == 1 and plan[10].frontage == pytest.approx(1) and plan[11].frontage == 0
    decided = N.decide(N.link_plan(paths, roads))
    assert {r.id: r.change for r in decided.collect()} == {10: "fold", 11: "unfold", 12: "fold"}
    assert {r.id: r.action for r in N.link_writes(decided).collect()} == {10: "fold", 12: "fold"}
    assert {r.id: r.action for r in N.link_writes(decided, unfold=True).collect()} == {10: "fold", 11: "release", 12: "fold"}
    assert [r.id for r in N.unintended_folds(N.link_writes(decided)).collect()] == [12]


def test_tie_goes_to_lower_road(spark):
    rows = [(5, "road", "A", 1, 2, None, [at(0, -10), at(100, -10)]), (4, "road", "B", 3, 4, None, [at(0, 10), at(100, 10)]), (9, "footway", None, 7, 8, None, [at(0, 0), at(100, 0)])]
    df = spark.createDataFrame(rows, SEGMENT)
    plan = N.link_plan(df.where("id = 9"), df.where("kind = 'road'")).first()
    assert plan.parent_id in (4, 5) and plan.frontage == pytest.approx(1)


# --- matching


def street(i, way, a, b, piece, x0, y0, x1, y1, name="Main"):
    line = [at(x0, y0), at((x0 + x1) / 2, (y0 + y1) / 2), at(x1, y1)]
    length = math.hypot(x1 - x0, y1 - y0)
    return (i, way, "road", name, a, b, piece, None, line, *line[0], *line[-1], length, math.degrees(math.atan2(x1 - x0, y1 - y0)) % 360)


STREETS = "id long, osm_way_id long, kind string, street_name string, start_node_id long, end_node_id long, piece_index int, canonical_segment_id long, line array<array<double>>, lon0 double, lat0 double, lon1 double, lat1 double, length_m double, bearing_deg double"


def town(spark):
    return spark.createDataFrame([street(1, 1, 1, 2, 0, 0, 0, 120, 0), street(2, 2, 2, 3, 0, 120, 0, 240, 0), street(3, 3, 2, 4, 0, 120, 0, 120, 150, "Cross"), street(4, 4, 8, 9, 0, 0, 14, 240, 14, "Alley")], STREETS)


def ride(session, points, t=0):
    return [(session, session * 1000 + i, T0 + timedelta(seconds=t + i), *at(*p), 1500.0 + i, None, 4.0) for i, p in enumerate(points)]


SAMPLE = "session_id long, id long, recorded_at timestamp, lon double, lat double, elevation_m double, elevation_source string, accuracy_m double"


def test_runs_are_held_within_the_margin():
    fixes = [(0, [(1, 3.0)]), (1, [(1, 10.0), (2, 3.0)]), (2, [(1, 12.0), (2, 3.0)]), (3, []), (4, [(7, 2.0), (1, 7.0)]), (40, [(7, 2.0), (1, 13.0)])]
    flat = [c for _, x in fixes for c in x]
    bounds = np.cumsum([0] + [len(x) for _, x in fixes])
    segment = np.array([s for s, _ in flat])
    runs, chosen = X.assign_runs(np.array([t for t, _ in fixes], float), bounds, segment, np.array(["forward"] * len(flat), object), np.array([d for _, d in flat]), np.array([(1, 2), (2, 1)]))
    # within the margin; beyond it; no candidate; 7 doesn't touch 2, so 6 m more; the last segment is forgotten
    assert [(int(r), int(segment[c]) if c >= 0 else None) for r, c in zip(runs, chosen, strict=True)] == [(0, 1), (0, 1), (1, 2), (-1, None), (2, 1), (3, 7)]


def test_process_sessions(spark):
    fixes = ride(1, [(x, 2) for x in range(0, 245, 7)]) + ride(2, [(240 - x, -2) for x in range(0, 245, 7)]) + ride(3, [(0, 0)])
    samples = spark.createDataFrame(fixes, SAMPLE)
    out = X.process_sessions(samples, town(spark))
    runs = [(r.session_id, r.segment_id, r.direction, r.qualified) for r in out["runs"].collect()]
    assert {(1, 1, "forward", True), (1, 2, "forward", True), (2, 2, "backward", True), (2, 1, "backward", True)} <= set(runs)
    assert not [r for r in runs if r[1] == 4 and r[3]]
    model = {(r.segment_id, r.direction, r.distance_m): r for r in out["model"].collect()}
    assert all(k[2] % 15 == 0 for k in model) and model[1, "forward", 60].sample_count == 1
    cover = {(r.segment_id, r.direction): r for r in out["coverage"].collect()}
    assert cover[1, "forward"].covered_to_m == pytest.approx(120) and cover[2, "forward"].covered_from_m == pytest.approx(0)
    half = 1500 + 60 / 7
    assert model[1, "forward", 60].elevation_m == pytest.approx(half, abs=1.5)
    flat = spark.createDataFrame([(i, d, m, 1400.0) for i in (1, 2) for d in ("forward", "backward") for m in range(0, 135, 15)], "segment_id long, direction string, distance_m int, dem_m double")
    moved = X.process_sessions(samples, town(spark), flat, DEFAULT)
    assert all(r.anchor_m is None or abs(r.anchor_m) <= 60 for r in moved["anchors"].collect())


def test_order_of_rides_does_not_matter(spark):
    p = spark.createDataFrame([(1, "forward", 15 * (i % 4), float(i), i, i) for i in range(40)], "segment_id long, direction string, distance_m int, elevation_m double, match_id long, session_id long")
    key = lambda r: (r.segment_id, r.direction, r.distance_m, r.sample_count)
    whole = {key(r): r.elevation_m for r in M.bucket_model(p).collect()}
    for cut in (3, 17):
        merged = {key(r): r.elevation_m for r in M.merge_model(M.bucket_model(p.where(f"match_id < {cut}")), p.where(f"match_id >= {cut}")).collect()}
        assert merged == pytest.approx(whole)


def test_nearest_edges(spark):
    e = X.segment_edges(town(spark))
    points = spark.createDataFrame([(1, *at(60, 5)), (2, *at(130, 100)), (3, *at(60, 90))], "point_id long, lon double, lat double")
    assert {r.point_id: r.segment_id for r in X.nearest_edges(points, e).collect()} == {1: 1, 2: 3}


# --- paths


def test_components(spark):
    links = spark.createDataFrame([(9, "end", 4), (4, "start", 30), (30, "end", 17), (8, "end", 16)], "segment_id long, which string, other long")
    assert {tuple(r) for r in X.components(links).collect()} == {(4, 4), (9, 4), (17, 4), (30, 4), (8, 8), (16, 8)}


def test_leave_one_out_of_all_sessions(spark, sf):
    made = set(map(tuple, W.transitions(model_table(spark, sf, "runs")).collect()))
    rode = defaultdict(lambda: defaultdict(set))
    for session, segment, direction, *following in made:
        rode[segment, direction][tuple(following)].add(session)
    want = Counter()
    for session, segment, direction, *following in made:
        counts = Counter({n: len(s - {session}) for n, s in rode[segment, direction].items()})
        top = max(counts.values())
        leaders = [n for n, k in counts.items() if k == top]
        want["stopped" if top == 0 or len(leaders) > 1 else "right" if leaders[0] == tuple(following) else "wrong"] += 1
    assert {r.verdict: r.moves for r in plans.QUERIES["graph_leave_one_out"](spark, sf).collect()} == want
    assert sum(want.values()) == len(made)


def test_whole_tables_in_two_halves(spark, sf):
    """Each row is on one side, and all pairs of the sides count."""
    runs = model_table(spark, sf, "runs").collect()
    us = lambda t: (t - datetime(1970, 1, 1)) / timedelta(seconds=1)
    rows = lambda name: [tuple(r) for r in plans.QUERIES[name](spark, sf).collect()]
    line = lambda r: (r.segment_id, r.direction)
    even, odd = ([r for r in runs if r.session_id % 2 == k] for k in (0, 1))
    ridden = [Counter(map(line, half)) for half in (even, odd)]
    a, b = ({x for x, k in c.items() if k >= sum(c.values()) / len(c)} for c in ridden)
    change = {(*x, "lost") for x in a - b} | {(*x, "gained") for x in b - a}
    assert set(rows("model_changed_lines")) == change
    shared = {x[0] for x in a} & {x[0] for x in b}
    assert set(rows("model_witness_disagreement")) == {x for x in change if x[0] in shared}
    on = defaultdict(list)
    for r in odd:
        on[line(r)].append(r)
    late = timedelta(days=3)
    want = sorted((p.match_id, r.match_id) for p in even for r in on[line(p)] if p.started_at <= r.ended_at + late and r.started_at <= p.ended_at + late)
    assert sorted(rows("join_interval_overlap")) == want and len(want) > 100
    shares = defaultdict(list)
    for r in runs:
        shares[line(r)].append(r.match_id % 10 / 10)
    worst = {x: min(s) for x, s in shares.items()}
    assert {x[:2]: x[3] for x in rows("diagnose_line_verdicts")} == {x: "next-door" if m >= 0.5 else "real-loss" for x, m in worst.items()}
    assert {x[:2]: x[2] for x in rows("diagnose_run_fates")} == {x: "drawn-elsewhere" if m >= 0.5 else "drawn-nowhere" for x, m in worst.items()}
    got = Counter({(r.share, r.verdict): r.lines for r in plans.QUERIES["diagnose_sensitivity"](spark, sf).collect()})
    assert got == Counter((s, "next-door" if m >= s else "real-loss") for s in (0.3, 0.7) for m in worst.values())
    passes = defaultdict(list)
    for r in runs:
        if r.session_id // 40 % 2:
            passes[r.session_id % 40, r.segment_id].append(r)
    slack, judged = timedelta(seconds=9e6), {}
    for r in runs:
        if not r.session_id // 40 % 2:
            met = [p.direction for p in passes[r.session_id % 40, r.segment_id] if r.started_at <= p.ended_at + slack and p.started_at <= r.ended_at + slack]
            judged[r.match_id] = "witnessed" if r.direction in met else "denied" if met else "unjudgeable"
    assert dict(rows("diagnose_judged_admissions")) == judged and len(set(judged.values())) == 3
    fixes = defaultdict(list)
    for r in model_table(spark, sf, "samples").collect():
        fixes[r.session_id].append((r.id, us(r.recorded_at)))
    want = sorted((i, j) for own in fixes.values() for i, t in own for j, u in own if t <= u <= t + 90000)
    assert sorted(rows("join_fixes_in_interval")) == want
    readings = model_table(spark, sf, "readings").collect()
    near = {r.event_id: sum(q.phone == r.phone and abs(q.at_ms - r.at_ms - 100) <= 500 and 300 <= q.hpa <= 1100 for q in readings) for r in readings}
    assert {r.fix_id: r.readings for r in plans.QUERIES["barometer_windowed_altitude"](spark, sf).collect()} == {i: n for i, n in near.items() if n}


@pytest.mark.parametrize(("name", "rows"), [("graph_end_neighbours", 256_140), ("graph_snapped_neighbours", 258_596), ("graph_adjacency", 192_556)])
def test_neighbours_of_all_ends_at_61_nodes(spark, name, rows):
    """Segments meet at 61 nodes, however many they are, so that neighbours grow with the square of the table."""
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.01").count() == rows


@pytest.mark.parametrize("snap", [0, 40])
def test_neighbours_once_where_nodes_are_crowded_and_ids_repeat(spark, monkeypatch, snap):
    """The ends of a node are dealt over salts; pairs that meet at several nodes, at a cut or nearby too, come once."""
    monkeypatch.setattr(X, "CROWD", 3)
    r = np.random.default_rng(4)
    segments = pd.DataFrame({"id": r.integers(0, 90, 140), "osm_way_id": r.integers(0, 4, 140), "start_node_id": r.integers(0, 5, 140), "end_node_id": r.integers(0, 5, 140), "piece_index": r.integers(0, 3, 140), **{c: b + r.integers(0, 20, 140) * 1e-4 for c, b in (("lon0", LON0), ("lat0", LAT0), ("lon1", LON0), ("lat1", LAT0))}})
    con = duckdb.connect()
    con.register("segments", segments)
    near = f"UNION SELECT a.id, a.which, b.id FROM en a JOIN en b ON a.id <> b.id AND {plans.hav('a.x', 'a.y', 'b.x', 'b.y')} <= {snap}" if snap else ""
    want = con.sql(f"WITH {queries_more.ENDS} SELECT segment_id, which, other FROM ad {near}").fetchall()
    table = spark.createDataFrame(segments)
    assert sorted(map(tuple, X.end_neighbours(table, snap).select("segment_id", "which", "other").collect())) == sorted(want)
    assert sorted(map(tuple, X.adjacent(table, snap).collect())) == sorted({(i, j) for i, _, j in want})


@pytest.mark.parametrize("most", [P.REQUESTS, 20])
def test_paths_of_all_lines_over_the_whole_network(spark, sf, monkeypatch, most):
    """Every line is asked for, and each answer is that of one graph of all lines and all neighbours."""
    monkeypatch.setattr(P, "REQUESTS", most)
    table = lambda n: model_table(spark, sf, n)
    segments = table("segments")
    ways = segments.where("canonical_segment_id IS NULL")
    line = F.array(F.array("lon0", "lat0"), F.array("lon1", "lat1")).alias("line")
    extents = M.extents(table("buckets"), table("coverage"), table("lines")).select("segment_id", "direction", "from_m", "to_m")
    frames = [t.toPandas() for t in (ways.select("id", line, "length_m", "street_name"), X.end_neighbours(ways, 5.0), extents, W.transitions(table("runs")))]
    graph = P.build_graph(*frames)
    last = segments.agg(F.max("id")).first()[0]
    grown, joined = [], []
    for i in frames[0].id:
        pieces, reason, *_ = graph.grow((i, "forward"), 0.0)
        grown += [(i, k, *p[0], p[1], p[2], reason) for k, p in enumerate(pieces)] or [(i, None, i, "forward", None, None, reason)]
        way = graph.connect((i, "forward"), 0.0, ((i + 40) % (last + 1), "forward"), 5.0) or []
        joined += [(i, k, *p[0], p[1], p[2], "connected") for k, p in enumerate(way)]
    key = lambda r: (r[0], r[1] or 0)
    for name, want in (("graph_grow", grown), ("graph_connect", joined)):
        got = plans.QUERIES[name](spark, sf).select("path_id", "i", "segment_id", "direction", "from_m", "to_m", "reason").collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r.paths for r in plans.QUERIES["graph_growth_census"](spark, sf).collect()) == len(frames[0])


def grid(extents, moves=(), box=None):
    segments = pd.DataFrame([dict(zip(("id", "line", "length_m", "street_name"), (s[0], s[8], s[13], s[3]), strict=True)) for s in TOWN])
    ends = pd.DataFrame([(1, "end", 2), (1, "end", 3), (2, "start", 1), (2, "start", 3), (3, "start", 1), (3, "start", 2)], columns=["segment_id", "which", "other"])
    ext = pd.DataFrame([(s, d, a, b) for (s, d), (a, b) in extents.items()], columns=["segment_id", "direction", "from_m", "to_m"])
    mv = pd.DataFrame(list(moves), columns=["session_id", "segment_id", "direction", "next_segment_id", "next_direction"])
    return P.build_graph(segments, ends, ext, mv, box=box)


TOWN = [street(1, 1, 1, 2, 0, 0, 0, 120, 0), street(2, 2, 2, 3, 0, 120, 0, 240, 0), street(3, 3, 2, 4, 0, 120, 0, 120, 150, "Cross")]
ALL = {(1, "forward"): (0.0, 120.0), (2, "forward"): (0.0, 120.0), (3, "forward"): (0.0, 150.0)}


def test_fork_rules():
    g = grid(ALL)
    found = g.candidates((1, "forward"))
    assert [(c.line, round(c.turn)) for c in found] == [((2, "forward"), 0), ((3, "forward"), 90)]
    assert g.pick((1, "forward"))[1] == "name"
    rode = grid(ALL, [(5, 1, "forward", 3, "forward"), (6, 1, "forward", 3, "forward"), (7, 1, "forward", 2, "forward")])
    assert rode.pick((1, "forward")) == (rode.candidates((1, "forward"))[1], "history")
    tie = grid(ALL, [(5, 1, "forward", 3, "forward"), (7, 1, "forward", 2, "forward")])
    assert tie.pick((1, "forward"))[1] == "name"
    assert rode.rides((1, "forward"), (3, "forward"), but=5) == 1
    assert g.pick((3, "backward")) is None  # both at right angles
    assert g.pick((3, "backward"), ("least",))[1] == "least"


def test_growing():
    pieces, reason, _, ahead = grid(ALL).grow((1, "forward"), 20.0)
    assert [(p[0][0], p[1], p[2], p[3], p[5]) for p in pieces] == [(1, 20, 120, 0, "start"), (2, 0, 120, 100, "name")] and reason == "end" and ahead == 0
    assert grid(ALL).grow((1, "forward"), 0.0, most_m=150)[1] == "limit"
    assert grid(ALL).grow((3, "backward"), 0.0)[1] == "fork"
    assert grid(ALL).grow((1, "forward"), 0.0, avoid=(2,))[1] == "loop"
    bare = {(1, "forward"): (0.0, 120.0)}
    pieces, reason, _, ahead = grid(bare).grow((1, "forward"), 0.0)
    assert reason == "end" and ahead == pytest.approx(120) and len(pieces) == 1
    assert grid({}).grow((3, "backward"), 0.0)[1] in ("fork", "gap")
    assert grid(ALL, box=(LON0 - 1, LAT0 - 1, at(60, 0)[0], LAT0 + 1)).grow((1, "forward"), 0.0)[1] == "limit"
    assert grid({}).parts((1, "forward"), 0, 120) == [(0, 120, "none")]
    assert grid({(1, "backward"): (20.0, 60.0)}).parts((1, "forward"), 0, 120) == [(0, 60, "none"), (60, 100, "twin"), (100, 120, "none")]


def test_connecting():
    g = grid(ALL)
    way = g.connect((1, "forward"), 60.0, (3, "forward"), 50.0)
    assert [(p[0][0], p[1], p[2], p[3]) for p in way] == [(1, 60, 120, 0), (3, 0, 50, 60)]
    assert g.connect((1, "forward"), 10.0, (1, "forward"), 90.0)[0][1:3] == (10, 90)
    assert g.connect((1, "forward"), 60.0, (3, "forward"), 50.0, most_m=100) is None
    assert g.connect((1, "backward"), 0.0, (2, "forward"), 5.0) is None and g.connect((9, "forward"), 0, (1, "forward"), 1) is None
    q = Q.PathRequest.parse({"segmentId": "1", "direction": "forward", "lon": "-104", "lat": "38", "toSegmentId": "2", "toDirection": "forward", "toLon": "-104", "toLat": "38"})
    pieces, reason, *_ = Q.answer(g, q, 60.0, 30.0)
    assert reason == "end" and [p[3] for p in pieces] == [0, 60, 90]


def test_path_spans(spark):
    """Ranges clipped to the pieces, the other direction's turned round, one slope between the heights beside a stretch without data."""
    pieces = spark.createDataFrame([(7, 0, 1, "forward", 0.0, 60.0, 0.0, "line"), (7, 1, 3, "forward", 0.0, 20.0, 60.0, "none"), (7, 2, 2, "forward", 0.0, 40.0, 80.0, "twin"), (8, 0, 3, "forward", 0.0, 20.0, 0.0, "none")], "path_id long, i int, segment_id long, direction string, from_m double, to_m double, at_m double, source string")
    ranges = spark.createDataFrame([(1, "forward", 0.0, 50.0, 2.0), (1, "forward", 50.0, 120.0, 4.0), (2, "backward", 0.0, 120.0, 3.0)], "segment_id long, direction string, range_from_m double, range_to_m double, slope_pct double")
    buckets = spark.createDataFrame([(1, "forward", 0, 100.0), (1, "forward", 120, 112.0), (2, "backward", 0, 120.0), (2, "backward", 120, 108.0)], "segment_id long, direction string, distance_m int, elevation_m double")
    lines = spark.createDataFrame([(1, 120.0), (2, 120.0), (3, 150.0)], "segment_id long, length_m double")
    got = sorted((r.path_id, r.at_m, r.length_m, round(r.slope_pct, 6), r.source) for r in Y.path_spans(pieces, ranges, buckets, lines).collect())
    assert got == [(7, 0, 50, 2, "line"), (7, 50, 10, 4, "line"), (7, 60, 20, 10, "none"), (7, 80, 40, -3, "twin"), (8, 0, 20, 0, "none")]


def test_growing_by_joins(spark):
    """The same paths as one graph's, over networks with forks, loops, stretches without data, lines of several legs and requests off the network."""
    r = np.random.default_rng(5)
    nodes = {i: tuple(map(float, at(*r.uniform(0, 900, 2)))) for i in range(26)}
    segments, ends = [], []
    for i in range(60):
        a, b = r.choice(26, 2, replace=False).tolist()
        bend = [nodes[a][k] + (nodes[b][k] - nodes[a][k]) * 0.4 + 1e-5 for k in (0, 1)]
        line = [list(nodes[a]), *([bend] if i % 3 else []), list(nodes[b])]
        segments.append((i, line, float(N.line_metres(np.array(line))[-1]), [None, "A", "b  Street", "B street"][i % 4], a, b))
    for s in segments:
        for t in segments:
            ends += [(s[0], which, t[0]) for which, node in (("start", s[4]), ("end", s[5])) if s[0] != t[0] and node in t[4:6]]
    extents = [(i, d, 0.1 * segments[i][2], float(r.uniform(0.3, 1.0)) * segments[i][2]) for i in range(60) for d in ("forward", "backward") if r.random() < 0.45]
    moves = [(int(r.integers(9)), s, d, t, e) for s, which, t in ends for d in [{"end": "forward", "start": "backward"}[which]] for e in ("forward", "backward") if r.random() < 0.3]
    asked = [(i, i % 63, "forward" if i % 2 else "backward", float(r.uniform(-10, 200))) for i in range(126)]
    frames = [pd.DataFrame(x, columns=c) for x, c in ((segments, ["id", "line", "length_m", "street_name", "a", "b"]), (ends, ["segment_id", "which", "other"]), (extents, ["segment_id", "direction", "from_m", "to_m"]), (moves, ["session_id", "segment_id", "direction", "next_segment_id", "next_direction"]))]
    schemas = ["id long, line array<array<double>>, length_m double, street_name string", "segment_id long, which string, other long", "segment_id long, direction string, from_m double, to_m double", "session_id long, segment_id long, direction string, next_segment_id long, next_direction string"]
    tables = [spark.createDataFrame([tuple(x[:4]) for x in rows] if k == 0 else rows, s) for k, (rows, s) in enumerate(zip((segments, ends, extents, moves), schemas, strict=True))]
    requests = spark.createDataFrame(asked, "path_id long, segment_id long, direction string, at_m double")
    seen = set()
    for config in (replace(DEFAULT, max_no_data_m=1000.0), replace(DEFAULT, max_path_m=700.0, max_no_data_m=400.0)):
        graph, want = P.build_graph(*frames, config=config), []
        for p, s, d, m in asked:
            pieces, reason, branches, ahead = graph.grow((s, d), m)
            base = (reason, round(float(ahead), 6), len(branches))
            want += [(p, k, *x[0], *(round(v, 6) for v in x[1:4]), x[4], x[5], *base) for k, x in enumerate(pieces)] or [(p, None, s, d, None, None, None, None, None, *base)]
        got = [tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in Y.grow_paths(requests, *tables, config).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
        seen |= {x[9] for x in got}
    assert len(seen) >= 4


def test_steepest_window_is_the_best_of_all():
    r = np.random.default_rng(4)
    for _ in range(30):
        length = r.uniform(5, 60, 12)
        rise = r.normal(0, 3, 12)
        none = r.random(12) < 0.3
        starts, heights = np.cumsum(length) - length, np.cumsum(rise) - rise
        got = P.steepest_window(starts, length, heights, rise, none, 100.0, 0.25)
        xs, hs = np.append(starts, length.sum()), np.append(heights, rise.sum())
        es = np.concatenate(([0.0], np.cumsum(np.where(none, length, 0))))
        x = np.linspace(0, max(0, length.sum() - 100), 4001)
        ok = np.interp(x + 100, xs, es) - np.interp(x, xs, es) <= 25 + 1e-9
        grades = np.abs(np.interp(x + 100, xs, hs) - np.interp(x, xs, hs))[ok]
        if got is None:
            assert not len(grades)
        elif len(grades):
            assert abs(got[0]) >= grades.max() - 1e-6
    assert P.steepest_window(*[np.array([])] * 4, np.array([], bool), 100, 0.25) is None


# --- drawing and scalars


@pytest.mark.parametrize("low, high, color", [(-25, -8, "#7c3aed"), (-7.99, -3, "#2563eb"), (-2.99, 0, "#22c55e"), (0.01, 3, "#eab308"), (3.01, 6, "#f97316"), (6.01, 9, "#dc2626"), (9.01, 12, "#881337"), (12.01, 25, "#450a0a")])
def test_color_bands(spark, low, high, color):
    for x in (low, high):
        assert one(spark, S.slope_color(F.col("x")), x=float(x)) == color


def test_gate_and_anchor(spark):
    for span, share, want in ((25, 0, True), (24.99, 0.69, False), (0, 0.7, True), (200, 0.1, True)):
        assert one(spark, S.qualifies(F.col("a"), F.col("b")), a=float(span), b=float(share)) is want
    rows = [(n, float(v)) for n, vs in ((9, range(9)), (10, range(10)), (11, [70] * 11), (12, [60] * 12)) for v in vs]
    got = {r.session_id: r.anchor_m for r in M.fit_anchor(spark.createDataFrame(rows, "session_id long, residual_m double")).collect()}
    assert got == {9: None, 10: 4.5, 11: None, 12: 60}


def test_quantiles(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(20)] + [(float("nan"),)], "v double")
    r = R.summary(rows, "v").first()
    assert (r.n, r.non_finite, r.median, r.p90, r.worst, r["mean"]) == (21, 1, 10, 18, 19, 9.5)
    a = F.array(*[F.lit(float(i)) for i in range(20)])
    assert spark.range(1).select(S.nearest_rank(a, 0.5), S.rounded_rank(a, 0.5)).first()[:] == (10, 10)


def test_holes(spark):
    df = spark.createDataFrame([(1, "forward", d) for d in (0, 15, 45, 60)] + [(2, "forward", d) for d in (0, 90)], "segment_id long, direction string, distance_m int")
    assert sorted(tuple(r)[2:] for r in W.interior_holes(df).collect()) == [(0, 90, 90, 5), (15, 45, 30, 1)]


def test_formats(spark):
    assert one(spark, S.format_distance(F.col("m")), m=100.0) == "330 ft" and one(spark, S.format_distance(F.col("m")), m=5000.0) == "3.11 mi"
    assert one(spark, S.format_rise(F.col("m")), m=-500.0) == "−1,640 ft" and one(spark, S.format_rise(F.col("m")), m=0.01) == "0 ft"
    assert one(spark, S.format_grade(F.col("p")), p=-0.04) == "0.0%" and one(spark, S.format_grade(F.col("p")), p=3.25) == "+3.3%"
    assert one(spark, S.format_rides(F.col("a"), F.col("b")), a=1, b=1) == "built from 1 ride" and one(spark, S.format_rides(F.col("a"), F.col("b")), a=1, b=4) == "built from 1 to 4 rides"
    assert one(spark, S.format_ride_date(F.col("a").cast("date"), F.col("b").cast("date")), a="2025-03-09", b="2026-01-01") == "Mar 9, 2025"
    assert one(spark, S.interval_for_speed(F.col("v")), v=5.0) == 2000 and one(spark, S.interval_for_speed(F.col("v")), v=-1.0) == 4000


def test_nan_is_no_number(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "x double")
    assert df.where(G.is_finite(F.col("x"))).count() == 1


# --- diagnosis, selections, requests


def test_lost_passes(spark):
    passes = spark.createDataFrame([(1, s, "forward", 0.0, 9.0) for s in range(1, 7)], "session_id long, segment_id long, direction string, started double, ended double")
    runs = spark.createDataFrame([(1, 1, "forward", 5.0, 20.0, True), (1, 2, "backward", 5.0, 20.0, True), (1, 3, "forward", 0.0, 3.0, False)], "session_id long, segment_id long, direction string, started double, ended double, qualified boolean")
    fixes = spark.createDataFrame([(1, float(t), t > 5, 4 if t < 2 else None, "forward", True) for t in range(10)], "session_id long, at_s double, available boolean, landed_segment long, landed_direction string, landed_drawn boolean")
    ways = spark.createDataFrame([(i, i // 2) for i in range(1, 7)], "segment_id long, osm_way_id long")
    got = {r.segment_id: r.cause for r in D.lost_passes(passes, runs, fixes, ways).collect()}
    assert got == {2: "wrong-dir", 3: "dropped", 4: "dropped", 5: "dropped", 6: "dropped"}
    free = fixes.withColumn("available", F.lit(True))
    assert {r.segment_id: r.cause for r in D.lost_passes(passes, runs, free, ways).collect()} == {2: "wrong-dir", 3: "gate", 4: "no-run", 5: "no-run", 6: "no-run"}
    away = free.withColumn("landed_segment", F.lit(4).cast("long"))
    near = {r.segment_id: (r.cause, r.same_way) for r in D.lost_passes(passes, runs, away, ways).collect()}
    assert near[5] == ("next-door", True) and near[6] == ("next-door", False) and near[4] == ("no-run", False)


def test_selection(spark):
    spans = spark.createDataFrame([(1, 0, 0, 0.0, 50.0, 2.0, 1.0, 0.0, "#eab308", "line"), (1, 1, 1, 50.0, 50.0, -4.0, -2.0, 1.0, "#2563eb", "none")], "path_id long, i int, piece int, at_m double, length_m double, slope_pct double, rise_m double, height_m double, color string, source string")
    both = E.appended(spans, spans).orderBy("i").collect()
    assert [(r.at_m, r.height_m, r.piece) for r in both] == [(0, 0, 0), (50, 1, 1), (100, -1, 2), (150, 0, 3)]
    assert E.prepended(spans, spans).count() == 4 and E.appended(spans.limit(0), spans).count() == 2
    at_points = spark.createDataFrame([(1, 25.0), (1, 75.0), (1, 999.0), (1, float("nan"))], "path_id long, m double")
    got = {r.m: (r.height_m, r.grade_pct) for r in E.profile_at(spans, at_points).collect()}
    assert got == {25.0: (0.5, 2.0), 75.0: (0.0, None), 999.0: (-1.0, None)}
    assert {r.m: r.grade for r in E.readouts(E.profile_at(spans, at_points)).collect()}[75.0] == "no data"
    merged = W.merged_spans(spans)
    pieces = spark.createDataFrame([(1, 0, 0.0, 50.0), (1, 1, 50.0, 50.0), (1, 2, 100.0, 10.0)], "path_id long, i int, at_m double, length_m double")
    f = {r.piece: r for r in E.piece_features(pieces, merged).collect()}
    assert f[2].no_data and f[2].color == "#6b7280" and f[0].to_fraction == 1
    grown = E.growing(E.piece_features(pieces, merged), spark.createDataFrame([(1, 75.0)], "path_id long, grown_m double")).first()
    assert grown.part == 0.5
    assert one(spark, E.scrub_metres(F.col("x"), F.col("a"), F.col("b"), F.col("l")), x=150.0, a=100.0, b=200.0, l=40.0) == 20
    whole = E.responses(pieces, spans, spark.createDataFrame([(1, "end", 0.0, 0)], "path_id long, reason string, ahead_m double, branches int")).first()
    assert whole.length_m == 110 and [p.i for p in whole.pieces] == [0, 1, 2] and len(whole.bands) == 8


def test_requests():
    base = {"segmentId": "1", "direction": "forward", "lon": "-104", "lat": "38"}
    assert Q.PathRequest.parse(base).grow and Q.PathRequest.parse({**base, "avoid": "1,2"}).avoid == (1, 2)
    for bad in ({"segmentId": "0"}, {"segmentId": "1.5"}, {"direction": "up"}, {"lat": "91"}, {"lon": "nan"}, {"toSegmentId": "4"}, {"grow": "false"}, {"grow": "maybe"}, {"avoid": "1,,2"}, {"avoid": ",".join(["1"] * 501)}, {"atM": "-1"}):
        with pytest.raises(ValueError):
            Q.PathRequest.parse({**base, **bad})
    assert Q.viewport_box({"minLon": "1", "minLat": "2", "maxLon": "3", "maxLat": "4"}) == (1, 2, 3, 4)


def test_ids(spark):
    assert R.checked_ids(spark.createDataFrame([(3.0,)], "id double"), "id").first().id == 3
    with pytest.raises(Exception, match="no id"):
        R.checked_ids(spark.createDataFrame([(1.5,)], "id double"), "id").collect()
    R.schema_contract(spark.createDataFrame([(1, "a")], "id long, name string"), "id long, name string")
    with pytest.raises(TypeError):
        R.schema_contract(spark.createDataFrame([(1, "a")], "id long, name string"), "id int, name string")


# --- sources and streams


def test_access_log(spark, tmp_path):
    lines = [
        {"message": "GET /segments/path?segmentId=5 200 886ms pool=1/4/0 opened=0 network=0-610 rideOrder=0-120 extents=610-639 growth=639-654 lines=654-739 respond=739-742 finish=759 extra", "timestamp": "2026-01-01T00:00:10Z"},
        {"message": "started", "timestamp": "2026-01-01T00:00:11Z"}, {"message": "GET /segments/path?segmentId=5&toSegmentId=9&grow=false 200 ABORTED-BY-CLIENT 862ms", "timestamp": "2026-01-01T00:00:50Z"}, {"timestamp": "2026-01-01T00:00:55Z"},
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = accesslog.with_quiet(accesslog.with_kind(accesslog.parse(accesslog.read_log(spark, str(tmp_path / "log.jsonl")))))
    got = rows.orderBy("timestamp").collect()
    assert [(r.kind, r.aborted, r.quiet_s) for r in got] == [("path:from", False, None), ("path:connect-only", True, 39.138)]
    stages = {r.stage: r.duration_ms for r in accesslog.stage_durations(rows).collect()}
    assert stages == {"network": 610, "rideOrder": 120, "extents": 29, "growth": 15, "lines": 85, "respond": 3, "deliver": 17, "toClose": 127}
    assert one(spark, accesslog.server_timing(F.col("h")), h="db;dur=12.5, total;dur=40") == {"db": 12.5, "total": 40.0}


def test_snapshot(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, v string")
    snapshot.write_snapshot({"a": a, "b": a.limit(0)}, str(tmp_path), {"a": "id"})
    assert snapshot.restore_drill(spark, str(tmp_path), {"a": "id"}).count() == 0
    a.where("id = 1").write.mode("overwrite").parquet(f"{tmp_path}/a")
    assert [tuple(r) for r in snapshot.restore_drill(spark, str(tmp_path), {"a": "id"}).collect()] == [("a", "rows")]
    assert snapshot.differing_rows(a, a.where("id = 1")).count() == 1
    assert snapshot.migrated(a, "id long, v string, source string").columns == ["id", "v", "source"]
    with pytest.raises(TypeError):
        snapshot.migrated(a, "id long")


def test_dem(spark):
    wanted = spark.createDataFrame([(1, "forward", 60), (1, "backward", 60), (1, "forward", 0)], "segment_id long, direction string, distance_m int")
    stored = spark.createDataFrame([(1, "forward", 0, 5.0)], "segment_id long, direction string, distance_m int, dem_m double")
    got = {(r.direction, r.distance_m): r.dem_m for r in dem.ensure(wanted, stored, town(spark), lambda ps: [p[0] for p in ps]).collect()}
    assert got["forward", 0] == 5 and got["forward", 60] == pytest.approx(at(60, 0)[0]) == got["backward", 60]

    def broken(points):
        raise OSError("no network")

    assert dem.ensure(wanted, stored, town(spark), broken).count() == 1 and dem.ensure(wanted, stored, town(spark)).count() == 1


def test_streamed_ingest_and_model(spark, tmp_path):
    schema = "session_id long, segment_id long, direction string, along_m double, elevation_m double, recorded_at timestamp"
    rows = [(i % 3, i % 2, "forward", float(i % 60), 100.0 + i, T0 + timedelta(seconds=i)) for i in range(300)]
    df = spark.createDataFrame(rows, schema)
    ingest.write_chunks(df.coalesce(1), f"{tmp_path}/in", 50)
    ingest.write_chunks(df.where("session_id = 0").coalesce(1), f"{tmp_path}/in")  # sent again
    stream = ingest.deduplicated(ingest.read_chunks(spark, f"{tmp_path}/in", schema, 2))
    ingest.run_available(stream.writeStream.format("parquet").option("path", f"{tmp_path}/stored").option("checkpointLocation", f"{tmp_path}/c1"))
    stored = spark.read.parquet(f"{tmp_path}/stored")
    assert stored.count() == 300
    merge = ingest.merge_into(spark, f"{tmp_path}/model")
    batches = [df.where(f"session_id = {k}").select("segment_id", "direction", S.bucket(F.col("along_m")).alias("distance_m"), "elevation_m") for k in range(3)]
    for k in (0, 1, 1, 2):  # batch 1 runs twice
        merge(batches[k], k)
    final = {tuple(r)[:3]: (r.elevation_m, r.sample_count) for r in spark.read.parquet(f"{tmp_path}/model/version=2").collect()}
    whole = {tuple(r)[:3]: (pytest.approx(r.elevation_m), r.sample_count) for r in M.bucket_model(df.select("segment_id", "direction", S.bucket(F.col("along_m")).alias("distance_m"), "elevation_m")).collect()}
    assert final == whole
    live = ingest.live_buckets(ingest.read_chunks(spark, f"{tmp_path}/in", schema))
    ingest.run_available(live.writeStream.outputMode("complete").format("memory").queryName("live_buckets").option("checkpointLocation", f"{tmp_path}/c2"))
    assert spark.table("live_buckets").agg(F.sum("n")).first()[0] == 400


def test_turn_modes(spark, tmp_path):
    headings = [0, 0, 30, 30, 30, 30, 30, 30, 31, 31]
    spark.createDataFrame([(1, T0 + timedelta(seconds=i), float(h)) for i, h in enumerate(headings)], "session_id long, recorded_at timestamp, heading_deg double").coalesce(1).write.parquet(f"{tmp_path}/in")
    modes = ingest.turn_modes(ingest.read_chunks(spark, f"{tmp_path}/in", "session_id long, recorded_at timestamp, heading_deg double"))
    ingest.run_available(modes.writeStream.format("memory").queryName("modes").outputMode("append").option("checkpointLocation", f"{tmp_path}/c"))
    start = spark.read.parquet(f"{tmp_path}/in").agg(F.min(S.micros(F.col("recorded_at"))) / 1e6).first()[0]
    assert [(r.at_s - start, r["mode"]) for r in spark.table("modes").orderBy("at_s").collect()] == [(2.0, "turn"), (7.0, "cruise")]


def test_health(spark):
    rows = [(None, None, None, None, None, "absent"), ("sensors", True, 5.0, 1.0, 0, "fallback"), ("native", False, 5.0, 1.0, 0, "offline"), ("native", True, 0.0, None, 0, "silent"), ("native", True, 5.0, None, 0, "good"), ("native", True, 5.0, 0.0, 0, "silent"), ("native", True, 5.0, 0.9, 2, "degraded"), ("native", True, 5.0, 0.5, 0, "patchy"), ("native", True, 1.0, 0.9, 0, "slow"), ("native", True, 5.0, 0.9, None, "good")]
    df = spark.createDataFrame(rows, "path string, registered boolean, hz double, used double, repaired int, want string")
    v = ingest.health_verdict(*[F.col(c) for c in ("path", "registered", "hz", "used", "repaired")])
    assert df.where(v != F.col("want")).count() == 0


def test_engine(spark):
    fixes = ride(1, [(x, 2) for x in range(0, 245, 7)])
    engine = Engine(spark, town(spark).withColumn("area", F.lit(1).cast("long")))
    samples = spark.createDataFrame(fixes, SAMPLE)
    sessions = spark.createDataFrame([(1, T0)], "id long, started_at timestamp")
    out = engine.rebuild(sessions, samples)
    boxes = engine.viewport((LON0 - 1, LAT0 - 1, LON0 + 1, LAT0 + 1), out["model"], out["coverage"])
    assert {r.segment_id for r in boxes.collect()} >= {1, 2}
    runs = spark.createDataFrame([(1, 1, "forward", T0, 1), (1, 2, "forward", T0 + timedelta(seconds=30), 2)], "session_id long, segment_id long, direction string, started_at timestamp, match_id long")
    asked = spark.createDataFrame([(1, 7, 1, "forward", 0.0)], "area long, path_id long, segment_id long, direction string, at_m double")
    grown = engine.paths(asked, out["model"], out["coverage"], runs).orderBy("i").collect()
    assert [r.segment_id for r in grown][:1] == [1] and 2 in [r.segment_id for r in grown]
    assert engine.ingest(samples, samples).count() == samples.count()


def test_previews(spark):
    lines = spark.createDataFrame([(1, "forward", 100.0, 20.0), (2, "backward", 100.0, 20.0), (3, "forward", 100.0, 99.5), (4, "forward", 0.0, 0.0), (5, "forward", 100.0, 50.0), (6, "forward", 100.0, 10.0)], "path_id long, direction string, geometry_m double, pressed_m double")
    stops = spark.createDataFrame([(k, i, f, c) for k in (1, 2, 3, 4) for i, f, c in ((0, 0.0, "a"), (1, 0.5, "b"), (2, 0.5, "c"))] + [(6, 0, 1.0, "z")], "path_id long, i int, fraction double, color string")
    got = sorted((r.path_id, round(r.at_m, 6), round(r.length_m, 6), r.color, r.source) for r in E.previews(lines, stops).collect())
    assert got == [(1, 0.0, 30.0, "a", "line"), (1, 30.0, 50.0, "c", "line"), (2, 0.0, 20.0, "a", "line"), (6, 0.0, 90.0, NO_DATA_COLOR, "none")]


def test_sound_selections_have_no_problems(spark, sf):
    spans = queries_more._spans(model_table(spark, sf, "spans"))
    assert E.problems(queries_view._pieces(spans), spans).count() == 0
    assert {r.problem for r in E.problems(queries_view._pieces(spans), spans.where("i <> 2")).select("problem").distinct().collect()} >= {"spans", "heights", "card"}


def test_changed_answers(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, None), (5, "z")], "request long, answer string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, None), (4, "w"), (6, None)], "request long, answer string")
    assert sorted((r.request, r.change) for r in R.changed_answers(a, b).collect()) == [(3, "changed"), (4, "changed"), (5, "missing"), (6, "new")]


def test_change_sets_are_reversible(spark):
    """Applied and reversed, a table has its fingerprint again; changes that don't fit any more are listed and left alone."""
    schema = "id long, parent long, name string"
    before = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 7, None), (None, 1, "null key"), (4, 4, "stays")], schema)
    after = spark.createDataFrame([(1, 6, "a"), (2, None, None), (None, 2, "null key"), (4, 4, "stays"), (9, None, "new")], schema)
    changes = R.change_set(before, after, ["id"]).cache()
    assert sorted(((r.id or 0), r.change) for r in changes.collect()) == [(0, "update"), (1, "update"), (2, "update"), (3, "delete"), (9, "insert")]
    print_of = lambda t: tuple(R.fingerprint(t.select("id", "parent", "name")).first())
    there = R.applied(before, changes)
    assert print_of(there) == print_of(after) and print_of(R.applied(there, R.inverse(changes))) == print_of(before)
    assert R.misfits(before, changes).count() == 0 and R.change_set(before, before, ["id"]).count() == 0
    moved = spark.createDataFrame([(1, 99, "a"), (2, None, "b"), (9, 1, "taken")], schema)
    assert sorted((r.id or 0) for r in R.misfits(moved, changes).collect()) == [0, 1, 3, 9]
    assert sorted(map(tuple, R.applied(moved, changes).collect()), key=str) == [(1, 99, "a"), (2, None, None), (9, 1, "taken")]
    none = before.limit(0)
    assert R.applied(none, R.change_set(none, after, ["id"])).count() == 5 and R.applied(before, R.change_set(before, none, ["id"])).count() == 0


def test_unintended_folds_stop_a_run(spark):
    rows = spark.createDataFrame([(1, "fold", "Main Street"), (2, "fold", "Main Sidewalk"), (3, "release", "Oak")], "id long, action string, street_name string")
    assert N.checked_writes(rows.where("id > 1")).count() == 2
    with pytest.raises(ValueError, match="Main Street"):
        N.checked_writes(rows)


def test_places_on_lines_of_several_legs(spark):
    """The same as by arrays, for each fix and line."""
    r = np.random.default_rng(3)
    lines = [(i, [list(map(float, p)) for p in np.array([LON0, LAT0]) + np.cumsum(r.normal(0, 4e-4, (r.integers(2, 6), 2)), axis=0)]) for i in range(12)]
    fixes = [(k, k % 12, float(LON0 + r.normal(0, 8e-4)), float(LAT0 + r.normal(0, 8e-4))) for k in range(200)]
    got = X.located(spark.createDataFrame(fixes, "id long, segment_id long, lon double, lat double"), spark.createDataFrame(lines, "segment_id long, line array<array<double>>")).collect()
    assert len(got) == 200
    for g in got:
        along, off = N.locate(np.array(lines[g.segment_id][1]), g.lon, g.lat)
        assert g.along_m == pytest.approx(along, abs=1e-6) and g.offset_m == pytest.approx(off, abs=1e-6)


def test_arms_of_a_sweep_are_runs_of_their_own(spark, sf):
    fixes, edges = X.admissible(model_table(spark, sf, "samples"), "heading_deg"), X.straight_edges(model_table(spark, sf, "segments"))
    got = X.candidate_arms(fixes, edges, queries_more.ARMS).cache()
    for arm, (reach, most) in queries_more.ARMS.items():
        own = X.candidates(fixes, edges, config=replace(DEFAULT, max_match_distance_m=reach, max_bearing_delta_deg=most))
        assert sorted(map(str, map(tuple, got.where(F.col("arm") == arm).drop("arm").collect()))) == sorted(map(str, map(tuple, own.collect())))
