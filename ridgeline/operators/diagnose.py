"""Why ground was not drawn: causes of holes and of lost passes, and verdicts over whole lines."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.model import LINE
from ridgeline.operators.relational import fixes_within

NEXT_DOOR = 0.5
WAYS = ("forward", "backward")


def hole_causes(holes: DataFrame, straddles: DataFrame, losses: DataFrame, size: float = 15.0) -> DataFrame:
    """crossed, dropped, elsewhere or between-runs for each hole (segment_id, direction, from_m, to_m).

    straddles: gap_s of the fixes that enclose a hole; losses: by line and bucket, how many fixes were `dropped` and how
    many matched `elsewhere`.  Holes meet their inner buckets by equality."""
    inner = holes.select(*LINE, "from_m", "to_m", F.explode(F.sequence(F.col("from_m") + int(size), F.col("to_m"), F.lit(int(size)))).alias("distance_m")).where("distance_m < to_m")
    lost = inner.join(losses, [*LINE, "distance_m"]).groupBy(*LINE, "from_m", "to_m").agg(F.sum("dropped").alias("dropped"), F.sum("elsewhere").alias("elsewhere"))
    rows = holes.join(straddles.select(*LINE, "from_m", "to_m", "gap_s"), [*LINE, "from_m", "to_m"], "left").join(lost, [*LINE, "from_m", "to_m"], "left")
    rows = rows.fillna(0, ["dropped", "elsewhere"])
    return rows.withColumn("cause", F.when(F.col("gap_s").isNotNull(), "crossed").when(F.col("dropped") > 0, "dropped").when(F.col("elsewhere") > 0, "elsewhere").otherwise("between-runs"))


def loss_cause(opposite_drawn: Column, fixes: Column, drawn_elsewhere: Column, unavailable: Column, runs_here: Column) -> Column:
    """Why a pass was lost; the first rule that holds decides."""
    share = F.when(fixes > 0, drawn_elsewhere / fixes).otherwise(0.0)
    return F.when(opposite_drawn, "wrong-dir").when(share >= NEXT_DOOR, "next-door").when(unavailable > fixes / 2, "dropped").when(runs_here > 0, "gate").otherwise("no-run")


def lost_passes(passes: DataFrame, runs: DataFrame, fixes: DataFrame, ways: DataFrame, slot_s: float = 600.0) -> DataFrame:
    """Passes (session_id, segment_id, direction, started, ended) without a qualified run of their direction over the same time, with their cause.

    runs: session_id, segment_id, direction, started, ended, qualified.  fixes: session_id, at_s, available, and where
    each landed (landed_segment, landed_direction, landed_drawn).  ways: segment_id, osm_way_id.  Passes meet fixes by
    slots of slot_s seconds."""
    key = ["session_id", "segment_id", "started", "ended"]
    p = passes.select(*key, F.col("direction").alias("p_direction"))
    r = runs.select("session_id", "segment_id", F.col("direction").alias("r_direction"), F.col("started").alias("a"), F.col("ended").alias("b"), "qualified")
    met = p.join(r, ["session_id", "segment_id"]).where("started <= b AND a <= ended")
    same = F.col("r_direction") == F.col("p_direction")
    met = met.groupBy(*key, "p_direction").agg(F.max(same & F.col("qualified")).alias("found"), F.max(~same & F.col("qualified")).alias("opposite_drawn"), F.count_if(same).alias("runs_here"))
    rows = p.join(met, [*key, "p_direction"], "left").fillna(False, ["found", "opposite_drawn"]).fillna(0, ["runs_here"]).where("NOT found")
    way = ways.select("segment_id", F.col("osm_way_id").alias("own_way"))
    landed = ways.select(F.col("segment_id").alias("landed_segment"), F.col("osm_way_id").alias("landed_way"))
    inside = fixes_within(rows, fixes, "session_id", slot_s).join(way, "segment_id", "left").join(landed, "landed_segment", "left")
    away = F.coalesce((F.col("landed_segment") != F.col("segment_id")) & F.col("landed_drawn"), F.lit(False))
    counts = inside.groupBy(*key, "p_direction").agg(F.count("*").alias("fixes"), F.count_if(~F.col("available")).alias("unavailable"), F.count_if(away).alias("elsewhere"), F.count_if(away & (F.col("own_way") == F.col("landed_way"))).alias("same_way"))
    rows = rows.join(counts, [*key, "p_direction"], "left").fillna(0, ["fixes", "unavailable", "elsewhere", "same_way"])
    cause = loss_cause(F.col("opposite_drawn"), F.col("fixes"), F.col("elsewhere"), F.col("unavailable"), F.col("runs_here"))
    return rows.select(*key, F.col("p_direction").alias("direction"), "fixes", cause.alias("cause"), F.coalesce(F.try_divide("same_way", "fixes") >= NEXT_DOOR, F.lit(False)).alias("same_way"))


def line_verdicts(lines: DataFrame, fates: DataFrame, floor_m: float = 25.0, next_door: float = NEXT_DOOR) -> DataFrame:
    """no-witness, phantom, next-door or real-loss for each line (segment_id, direction, length_m) by its passes' fates (share drawn elsewhere)."""
    all_near = fates.groupBy(*LINE).agg(F.min((F.col("share") >= next_door).cast("int")).alias("near"))
    rows = lines.join(all_near, LINE, "left")
    return rows.withColumn("verdict", F.when(F.col("near").isNull(), F.when(F.col("length_m") < floor_m, "no-witness").otherwise("phantom")).when(F.col("near") == 1, "next-door").otherwise("real-loss")).drop("near")


def run_fates(lines: DataFrame, fates: DataFrame, next_door: float = NEXT_DOOR) -> DataFrame:
    """drawn-elsewhere, drawn-nowhere or unknown for each line by its runs' fates."""
    all_near = fates.groupBy(*LINE).agg(F.min((F.col("share") >= next_door).cast("int")).alias("near"))
    return lines.join(all_near, LINE, "left").withColumn("fate", F.when(F.col("near").isNull(), "unknown").when(F.col("near") == 1, "drawn-elsewhere").otherwise("drawn-nowhere")).drop("near")


def sensitivity(lines: DataFrame, fates: DataFrame, shares: list[float]) -> DataFrame:
    """Lines by verdict at each share."""
    out = None
    for s in shares:
        one = line_verdicts(lines, fates, next_door=s).groupBy("verdict").agg(F.count("*").alias("lines")).withColumn("share", F.lit(float(s)))
        out = one if out is None else out.unionByName(one)
    return out


def judged_admissions(admitted: DataFrame, passes: DataFrame, key: tuple[str, ...] = ("session_id", "segment_id")) -> DataFrame:
    """witnessed, denied or unjudgeable for each admitted run: a pass over the same ground and time in its direction, in the other, or none.

    Of the passes that have started when a run ends, the one that ends last tells whether any meets the run, so runs and
    passes go together in order of time and no pairs are made."""
    own = [c for c in admitted.columns]
    p = passes.select(*key, F.col("started").alias("x"), F.lit(0).alias("kind"), F.col("direction").alias("p_direction"), F.col("ended").alias("b"))
    a = admitted.select(*key, F.col("ended").alias("x"), F.lit(1).alias("kind"), F.struct(*own).alias("a"))
    both = p.unionByName(a, allowMissingColumns=True)
    until = Window.partitionBy(*key).orderBy(F.col("x").asc_nulls_last(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda way: F.max(F.when(F.col("p_direction") == way, F.col("b"))).over(until).alias(f"last_{way}")
    rows = both.select("a", *key, "x", F.max("b").over(until).alias("last_any"), *map(last, WAYS)).where("a IS NOT NULL")
    same = F.when(F.col("a.direction") == WAYS[0], F.col(f"last_{WAYS[0]}")).when(F.col("a.direction") == WAYS[1], F.col(f"last_{WAYS[1]}"))
    real = reduce(and_, [F.col(k).isNotNull() for k in (*key, "x")])
    hit = lambda c: real & F.coalesce(F.col("a.started") <= c, F.lit(False))
    return rows.select("a.*", F.when(hit(same), "witnessed").when(hit(F.col("last_any")), "denied").otherwise("unjudgeable").alias("judged"))


def faithful_buckets(stored: DataFrame, replayed: DataFrame, near_m: float = 0.05) -> DataFrame:
    """Whether each stored bucket is what a replay gives: as many passes, and a mean within near_m."""
    b = replayed.select(*LINE, "distance_m", F.col("elevation_m").alias("again_m"), F.col("sample_count").alias("again_n"))
    return stored.join(b, [*LINE, "distance_m"], "left").withColumn("faithful", F.coalesce((F.col("sample_count") == F.col("again_n")) & (F.abs(F.col("elevation_m") - F.col("again_m")) < near_m), F.lit(False)))


def sweep(grid: list[dict], run) -> DataFrame:
    """run(**parameters) for each row of a small grid, its results side by side with the parameters."""
    out = None
    for g in grid:
        one = run(**g).withColumns({k: F.lit(v) for k, v in g.items()})
        out = one if out is None else out.unionByName(one)
    return out


def describe_line(segment_id: Column, direction: Column, street: Column, holes: Column, metres: Column) -> Column:
    return F.format_string("#%d %s %s: %d holes, %.0f m", segment_id, direction, F.coalesce(street, F.lit("(unnamed)")), holes, metres.cast("double"))


