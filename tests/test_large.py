"""What large tables brought to light: no pairs where an order will do, no broadcasts of what explode has made, no frames that are computed anew for each row."""

import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import diagnose as D
from ridgeline.operators import relational as R
from ridgeline.operators import selection as E
from ridgeline.operators import windows as W
from ridgeline.plans import queries as Q
from ridgeline.plans import queries_more, queries_view  # noqa: F401


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_long_paths_are_walked_not_gathered(spark):
    rng = random.Random(3)
    rows = [(p, k, rng.choice([10.0, 45.5, 120.0, 400.0])) for p in (1, 2) for k in range(25_000)]
    rng.shuffle(rows)
    df = W.length_chunks(spark.createDataFrame(rows, "path_id long, run long, length_m double"), 300)
    assert "collect_list" not in plan(df)
    got = {(r.path_id, r.run): r.chunk for r in df.collect()}
    for p in (1, 2):
        chunk, total = 0, 0.0
        for k, m in sorted((k, m) for q, k, m in rows if q == p):
            if k and total + m > 300:
                chunk, total = chunk + 1, 0.0
            total += m
            assert got[p, k] == chunk


def test_pieces_at_has_no_frame_to_the_end(spark):
    rng = random.Random(4)
    lengths = [rng.choice([0.0, 1.5, 20.0]) for _ in range(400)]
    starts = [sum(lengths[:k], 0.0) for k in range(400)]
    pieces = spark.createDataFrame([(1, k, k % 7, "forward", 2.0, a, m) for k, (a, m) in enumerate(zip(starts, lengths, strict=True))], "path_id long, i long, segment_id long, direction string, from_m double, at_m double, length_m double")
    points = [-1.0, 0.0, 1e9, *rng.sample(starts, 40), *[rng.uniform(0, sum(lengths)) for _ in range(40)]]
    df = E.pieces_at(pieces, spark.createDataFrame([(1, m) for m in points], "path_id long, m double"))
    assert "currentrow$(), unboundedfollowing" not in plan(df).lower()
    for r in df.collect():
        i = next((k for k in range(400) if starts[k] + lengths[k] >= r.m), 399)
        assert r.i == i and r.on_line_m == 2 + min(max(r.m - starts[i], 0), lengths[i])


def test_admissions_are_judged_without_pairs(spark):
    rng = random.Random(12)

    def runs(n, first):
        out = []
        for k in range(n):
            a = rng.choice([None, *range(0, 60, 2)]) if k % 9 == 0 else rng.randrange(60)
            out.append((first + k, rng.choice([1, 2, None]), rng.randrange(3), rng.choice(["forward", "backward"]), None if a is None else float(a), None if a is None or k % 11 == 0 else float(a + rng.randrange(4))))
        return out

    kind = "match_id long, session_id long, segment_id long, direction string, started double, ended double"
    a, b = runs(300, 0), runs(60, 1000)
    df = D.judged_admissions(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind).drop("match_id"))
    assert "Join" not in plan(df)
    want = {}
    for i, s, g, d, t0, t1 in a:
        met = [x[3] for x in b if s is not None and x[1] == s and x[2] == g and None not in (t0, t1, x[4], x[5]) and t0 <= x[5] and x[4] <= t1]
        want[i] = "witnessed" if d in met else "denied" if met else "unjudgeable"
    assert {r.match_id: r.judged for r in df.collect()} == want and len(set(want.values())) == 3


@pytest.mark.parametrize("key", ["phone", None])
def test_readings_near_fixes_come_from_running_sums(spark, key):
    rng = random.Random(21)
    at = lambda: rng.choice([rng.randrange(-3000, 9000), rng.randrange(-3000, 9000) + 0.25])
    readings = [(k % 2, float(at()), rng.choice([float("nan"), 200.0, *[900 + x / 64 for x in range(200)]])) for k in range(1500)]
    fixes = [(k, k % 3, rng.choice([None, float("nan"), 60_000.0]) if k % 40 == 0 else float(at())) for k in range(300)]
    df = R.readings_near(spark.createDataFrame(fixes, "fix_id long, phone long, at_ms double"), spark.createDataFrame(readings, "phone long, at_ms double, hpa double"), key=key)
    assert "Generate" not in plan(df)
    want = {}
    for i, p, t in fixes:
        near = [(m - t, h) for q, m, h in readings if t is not None and (key is None or q == p) and abs(m - t) <= 500 and 300 <= h <= 1100]
        if near:
            want[i] = (len(near), sum(x for x, _ in near) / len(near), sum(h for _, h in near) / len(near))
    got = {r.fix_id: r for r in df.collect()}
    assert got.keys() == want.keys()
    for i, (n, off, h) in want.items():
        assert got[i].readings == n and abs(got[i].mean_offset_ms - off) < 1e-9 and abs(got[i].altitude_m - 44330 * (1 - (h / 1013.25) ** (1 / 5.255))) < 1e-6


def test_overlaps_meet_in_slots_of_time(spark):
    rng = random.Random(16)

    def times(n):
        at = [rng.randrange(-50, 400) / 2 for _ in range(n)]
        return [(k, k % 2, t, t + rng.choice([0, 0.5, 3, 3, 40, -1])) for k, t in enumerate(at)] + [(n, 0, None, 5.0)]

    a, b = times(150), times(120)
    df = R.overlapping(spark.createDataFrame(a, "a long, k long, started double, ended double"), spark.createDataFrame(b, "b long, k long, started double, ended double"), ["k"])
    assert "slot" in plan(df)
    got = sorted((r.a, r.b) for r in df.collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and None not in (x[2], y[2]) and x[2] <= y[3] and y[2] <= x[3])


def test_ends_of_a_hub_are_copied_a_few_times():
    """At 6 GB 7,200,000 segments have their ends at 61 nodes."""
    from ridgeline.operators import match as X

    assert 2 * 7_200_000 / 61 / X.CROWD < 16
