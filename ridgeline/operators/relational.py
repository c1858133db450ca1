"""Joins, aggregations and set operations of the model and its maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import DEFAULT, EngineConfig
from ridgeline.functions import scalar as S
from ridgeline.plans.storage import saved, shuffled
from ridgeline.functions.geo import haversine_m, is_finite
from ridgeline.operators.model import LINE


def with_data(segments: DataFrame, buckets: DataFrame, key: str = "id") -> DataFrame:
    """Segments that have buckets."""
    return segments.join(buckets.select(F.col("segment_id").alias(key)).distinct(), key, "left_semi")


def in_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key tuple is among `keys`."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def empty_sessions(sessions: DataFrame, samples: DataFrame, matches: DataFrame) -> DataFrame:
    """Sessions with neither fixes nor matches."""
    none = sessions.join(samples.select(F.col("session_id").alias("id")), "id", "left_anti")
    return none.join(matches.select(F.col("session_id").alias("id")), "id", "left_anti")


def unmatched_sessions(sessions: DataFrame, samples: DataFrame, matches: DataFrame) -> DataFrame:
    """Sessions with fixes, but no matches."""
    some = sessions.join(samples.select(F.col("session_id").alias("id")), "id", "left_semi")
    return some.join(matches.select(F.col("session_id").alias("id")), "id", "left_anti")


SEGMENT_KEY = ["osm_way_id", "start_node_id", "end_node_id", "piece_index"]


def orphans(segments: DataFrame, current: DataFrame) -> DataFrame:
    """Segments whose natural key is no longer in the network."""
    return segments.join(current.select(*SEGMENT_KEY), SEGMENT_KEY, "left_anti")


def longest_orphans(segments: DataFrame, current: DataFrame, n: int = 8) -> DataFrame:
    """A report of the n longest orphans; ties by id."""
    return orphans(segments, current).orderBy(F.desc("length_m"), "id").limit(n)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows with the new ones in place of theirs, or added; of several new rows the one greatest in all columns."""
    values = [c for c in stored.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(*values)).alias("v")).select(*keys, "v.*")
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(last.select(stored.columns))


def insert_new(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows and those new ones whose key isn't stored; of several new rows the one least in all columns."""
    values = [c for c in stored.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(*values)).alias("v")).select(*keys, "v.*")
    return stored.unionByName(first.join(stored.select(*keys), keys, "left_anti").select(stored.columns))


def updated(stored: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Stored rows with `column` from `new` where it has the key (its null counts)."""
    given = new.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    rows = stored.join(given, key, "left")
    return rows.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit").select(stored.columns)


def change_set(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, change, old, new): what turns `before` into `after`, a row for each key that is inserted, deleted or updated, with the whole row before and after.

    Both tables have the same columns and each key once; a null key is a key.  Nulls are values: a null that stays is no
    change."""
    columns = [c for c in before.columns if c not in keys]
    side = lambda t, name: t.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.struct(*columns).alias(name), F.lit(True).alias(f"_in_{name}"))
    same = [F.col(f"_old_{k}").eqNullSafe(F.col(f"_new_{k}")) for k in keys]
    met = side(before, "old").join(side(after, "new"), same, "full_outer")
    change = F.when(F.col("_in_old").isNull(), "insert").when(F.col("_in_new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    key = [F.when(F.col("_in_old"), F.col(f"_old_{k}")).otherwise(F.col(f"_new_{k}")).alias(k) for k in keys]
    return met.select(*key, change.alias("change"), "old", "new").where("change IS NOT NULL")


def inverse(changes: DataFrame) -> DataFrame:
    """The change set that takes the changes back."""
    keys = [c for c in changes.columns if c not in ("change", "old", "new")]
    return changes.select(*keys, F.when(F.col("change") == "insert", "delete").when(F.col("change") == "delete", "insert").otherwise("update").alias("change"), F.col("new").alias("old"), F.col("old").alias("new"))


def applied(table: DataFrame, changes: DataFrame) -> DataFrame:
    """The table with a change set applied.  A change whose row isn't as it was when the set was made isn't applied; misfits() lists these."""
    keys = [c for c in changes.columns if c not in ("change", "old", "new")]
    met = _met(table, changes, keys)
    new = lambda c: F.when(F.col("_fits") & F.col("_change").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
    gone = F.coalesce(F.col("_fits") & (F.col("_change") == "delete"), F.lit(False))
    kept = met.where(F.col("_in")).where(~gone).select(*[F.col(c) if c in keys else new(c) for c in table.columns])
    added = met.where(F.col("_in").isNull() & (F.col("_change") == "insert")).select(*[F.col(f"_key_{c}").alias(c) if c in keys else F.col("_new")[c].alias(c) for c in table.columns])
    return kept.unionByName(added)


def misfits(table: DataFrame, changes: DataFrame) -> DataFrame:
    """(*keys, change) of the changes that don't fit the table: the row to change or delete is gone or another one, or the row to insert is there."""
    keys = [c for c in changes.columns if c not in ("change", "old", "new")]
    met = _met(table, changes, keys).where(F.col("_change").isNotNull())
    fits = F.when(F.col("_in").isNull(), F.col("_change") == "insert").otherwise(F.col("_fits"))
    return met.where(~fits).select(*[F.col(f"_key_{k}").alias(k) for k in keys], F.col("_change").alias("change"))


def _met(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    own = table.withColumn("_in", F.lit(True))
    given = changes.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("change").alias("_change"), F.col("old").alias("_old"), F.col("new").alias("_new"))
    met = own.join(given, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], "full_outer")
    now = F.struct(*[c for c in table.columns if c not in keys])
    return met.withColumn("_fits", F.coalesce((F.col("_change") != "insert") & F.col("_old").eqNullSafe(now), F.lit(False)))


def model_diff(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """added, removed or shared for every bucket of two models, with the heights and how far they moved."""
    keys = keys or [*LINE, "distance_m"]
    a = before.select(*keys, F.col("elevation_m").alias("before_m"))
    b = after.select(*keys, F.col("elevation_m").alias("after_m"))
    rows = a.join(b, keys, "full_outer")
    return rows.withColumn("change", F.when(F.col("before_m").isNull(), "added").when(F.col("after_m").isNull(), "removed").otherwise("shared")).withColumn("moved_m", F.abs(F.col("after_m") - F.col("before_m")))


def twins(lines: DataFrame) -> DataFrame:
    """Lines that are drawn in both directions, each with its twin's stretch turned round."""
    other = lines.select("segment_id", S.opposite(F.col("direction")).alias("direction"), (F.col("length_m") - F.col("to_m")).alias("twin_from_m"), (F.col("length_m") - F.col("from_m")).alias("twin_to_m"))
    return lines.join(other, LINE)


def overlapping(passes: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a pass and a run with the same keys whose times overlap (started, ended; both ends count).

    Times meet in slots as wide as the mean of all times, so that all together cover about three slots for each of them;
    a pair counts in the slot in which the later of the two begins."""
    length = F.abs(F.col("ended") - F.col("started")).alias("m")
    mean = passes.select(length).unionByName(runs.select(length)).agg(F.avg("m")).first()[0]
    width = max(mean or 0.0, 1.0)
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    slots = F.explode(F.sequence(at("started"), at("ended"))).alias("slot")
    p = passes.select("*", slots)
    r = runs.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("started").alias("r_started"), F.col("ended").alias("r_ended"), *[c for c in runs.columns if c not in {*keys, "started", "ended"}], slots.alias("r_slot"))
    same = [p[k] == r[f"r_{k}"] for k in keys]
    once = F.floor(F.greatest(p["started"], r["r_started"]) / width).cast("long") == p["slot"]
    met = p.join(shuffled(r), [*same, p["slot"] == r["r_slot"], p["started"] <= r["r_ended"], r["r_started"] <= p["ended"], once])
    return met.drop(*[f"r_{k}" for k in keys], "slot", "r_slot")


def fixes_within(windows: DataFrame, fixes: DataFrame, key: str, width_s: float) -> DataFrame:
    """Fixes within each window (key, started, ended in seconds), by buckets of time so that no window meets every fix."""
    w = windows.withColumn("slot", F.explode(F.sequence(F.floor(F.col("started") / width_s).cast("long"), F.floor(F.col("ended") / width_s).cast("long"))))
    f = fixes.withColumn("slot", F.floor(F.col("at_s") / width_s).cast("long"))
    return w.join(f, [key, "slot"]).where("at_s >= started AND at_s <= ended").drop("slot")


def readings_near(fixes: DataFrame, readings: DataFrame, half_ms: float = 500.0, key: str | None = None) -> DataFrame:
    """Mean pressure within half_ms of each fix as an altitude, with the number of readings and their mean offset.

    fixes: fix_id, at_ms; readings: at_ms, hpa (unusable ones don't count).  With `key`, only readings of the same key
    (phone or ride) count.  A fix without readings has no row.

    Time is cut into slots as wide as the window, so a window is the end of one slot and the beginning of the next, and
    what a slot holds from a time on, or up to it, is a running sum: fixes and readings of a slot go together in order of
    time, and no pairs are made.  Equal times are summed up, and asked for, once."""
    same = [key] if key else []
    size = 2 * half_ms
    usable = readings.where(S.usable_reading(F.col("at_ms").cast("double"), F.col("hpa"))).select(*same, F.col("at_ms").cast("double").alias("x"), "hpa")
    slot = F.floor(F.col("x") / size).cast("long")
    read = usable.groupBy(*same, "x").agg(F.count("*").alias("n"), F.sum("hpa").alias("hpa")).withColumn("slot", slot).withColumn("off", F.col("n") * (F.col("x") - F.col("slot") * size))
    times = fixes.select(*same, F.col("at_ms").cast("double").alias("at_ms")).where(is_finite(F.col("at_ms"))).distinct()
    # the slot that the window begins in is asked from there on, the next one up to where the window ends
    low, high = F.col("at_ms") - half_ms, F.col("at_ms") + half_ms
    first = F.floor(low / size).cast("long")
    from_ = times.select(*same, "at_ms", low.alias("x"), first.alias("slot"), F.lit(1).alias("kind"))
    upto = times.select(*same, "at_ms", high.alias("x"), (first + 1).alias("slot"), F.lit(2).alias("kind"))
    every = read.withColumn("kind", F.lit(0)).unionByName(from_.unionByName(upto), allowMissingColumns=True)
    group = Window.partitionBy(*same, "slot")
    back = group.orderBy(F.desc("x"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = group.orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = lambda c: F.when(F.col("kind") == 1, F.sum(c).over(back)).otherwise(F.sum(c).over(ahead)).alias(c)
    parts = every.select(*same, "at_ms", "slot", "kind", *map(held, ("n", "hpa", "off"))).where("kind > 0 AND n > 0")
    whole = parts.withColumn("off", F.col("off") + F.col("n") * (F.col("slot") * size - F.col("at_ms"))).groupBy(*same, "at_ms").agg(*[F.sum(c).alias(c) for c in ("n", "hpa", "off")])
    met = fixes.withColumn("at_ms", F.col("at_ms").cast("double")).join(whole, [*same, "at_ms"]).groupBy("fix_id").agg(*[F.sum(c).alias(c) for c in ("n", "hpa", "off")])
    return met.select("fix_id", S.altitude_from_hpa(F.col("hpa") / F.col("n")).alias("altitude_m"), F.col("n").alias("readings"), (F.col("off") / F.col("n")).alias("mean_offset_ms"))


def resolved_height(native: Column, sensor: Column, sensor_age_s: Column, gps: Column, fresh_s: float = 5.0) -> Column:
    """The native pressure height; else a fresh sensor mean; else the GPS height."""
    return F.coalesce(native, F.when(sensor_age_s < fresh_s, sensor), gps)


def decoded_readings(rows: DataFrame, flat: str = "flat") -> DataFrame:
    """Readings from flat arrays of time, pressure, time, pressure ...; an odd last value is dropped, null arrays give none."""
    n = F.floor(F.size(flat) / 2).cast("int")
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(F.col(flat), 2 * i).alias("at_ms"), F.get(F.col(flat), 2 * i + 1).alias("hpa"))))
    return rows.select(*[c for c in rows.columns if c != flat], F.inline(pairs))


# verdicts and quality


def step_grades(samples: DataFrame) -> DataFrame:
    """Ground distance and grade of each step of a session."""
    w = Window.partitionBy("session_id").orderBy("recorded_at")
    ground = haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    rise = F.abs(F.col("elevation_m") - F.lag("elevation_m").over(w))
    rows = samples.select("session_id", "id", ground.alias("ground_m"), rise.alias("rise_m"))
    return rows.withColumn("grade_pct", F.try_divide(F.col("rise_m"), F.nullif(F.col("ground_m"), F.lit(0.0))) * 100)


def session_verdicts(sessions: DataFrame, samples: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Fixes, lowest height, share of implausible steps and whether a session is usable; sessions without fixes go."""
    bad = step_grades(samples).where("grade_pct IS NOT NULL AND ground_m > 1").groupBy("session_id").agg(F.avg(F.when(F.col("grade_pct") > config.max_grade_pct, 1.0).otherwise(0.0)).alias("bad_share"))
    own = samples.groupBy("session_id").agg(F.count("id").alias("samples"), F.min("elevation_m").alias("min_elev"), F.count("elevation_source").alias("labelled"))
    rows = sessions.select(F.col("id").alias("session_id")).join(own, "session_id").join(bad, "session_id", "left")
    scale = F.coalesce(F.col("min_elev") >= config.min_elevation_m, F.lit(False))
    plausible = (F.col("labelled") > 0) | F.coalesce(F.col("bad_share") <= config.max_bad_share, F.lit(True))
    rows = rows.withColumn("scale_ok", scale).withColumn("plausible_ok", plausible).withColumn("usable", F.col("scale_ok") & F.col("plausible_ok"))
    why = F.when(~F.col("scale_ok"), F.format_string("min elevation %.1fm is not absolute", "min_elev")).when(~F.col("plausible_ok"), F.format_string("%.1f%% of its steps are steeper than %.0f%%", F.coalesce("bad_share", F.lit(0.0)) * 100, F.lit(config.max_grade_pct)))
    return rows.withColumn("why_skipped", why)


def summary(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """n, values that aren't finite, median and p90 by nearest rank, mean and worst.

    Ranks come from running sums over counts of distinct values, so no key's values are gathered in one row.  Without
    keys, values are dealt into ranges; each range sums up its own counts and adds what the ranges before it hold."""
    keys = keys or []
    v = F.col(value)
    all_rows = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~is_finite(v)).alias("non_finite"), F.avg(F.when(is_finite(v), v)).alias("mean"), F.max(F.when(is_finite(v), v)).alias("worst"))
    counts = rows.where(is_finite(v)).groupBy(*keys, v.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    if keys:
        by = Window.partitionBy(*[F.col(k) for k in keys])
        ranked = counts.select(*keys, "x", F.sum("c").over(by.orderBy("x")).alias("upto"), F.sum("c").over(by).alias("total"))
    else:
        ranged = saved(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()))
        parts = ranged.groupBy("part").agg(F.sum("c").alias("own"))  # a row for each partition
        every = Window.partitionBy()
        parts = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(every).alias("total"))
        ranked = ranged.join(F.broadcast(parts), "part").select("x", (F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("x"))).alias("upto"), "total")
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * q)), F.col("x")))
    ranks = ranked.groupBy(*keys).agg(at(0.5).alias("median"), at(0.9).alias("p90"))
    return all_rows.join(ranks, keys, "left") if keys else all_rows.crossJoin(ranks)


def self_disagreements(observations: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Last less first height of each bucket and session with two passes or more, the revisit gap apart."""
    w = observations.groupBy(*LINE, "distance_m", "session_id").agg(F.count("*").alias("passes"), F.min(F.struct("at_s", "elevation_m")).alias("a"), F.max(F.struct("at_s", "elevation_m")).alias("b"))
    return w.where((F.col("passes") >= 2) & (F.col("b.at_s") - F.col("a.at_s") >= config.min_revisit_gap_s)).select(*LINE, "distance_m", "session_id", F.abs(F.col("b.elevation_m") - F.col("a.elevation_m")).alias("off_m"))


def cross_ride_disagreements(observations: DataFrame) -> DataFrame:
    """Mean distance of the passes' heights from their mean, in buckets with two sessions or more."""
    key = [*LINE, "distance_m"]
    means = observations.groupBy(*key).agg(F.avg("elevation_m").alias("mean_m"), F.countDistinct("session_id").alias("rides"))
    rows = observations.join(means.where("rides >= 2"), key)
    return rows.groupBy(*key).agg(F.avg(F.abs(F.col("elevation_m") - F.col("mean_m"))).alias("off_m"))


def terrain_disagreements(observations: DataFrame, dem: DataFrame) -> DataFrame:
    rows = observations.join(dem.where("dem_m IS NOT NULL"), [*LINE, "distance_m"])
    return rows.select(*LINE, "distance_m", "session_id", "at_s", F.abs(F.col("elevation_m") - F.col("dem_m")).alias("off_m"))


MEASURES = {"self-consistency": lambda o, dem: self_disagreements(o), "cross-ride": lambda o, dem: cross_ride_disagreements(o), "terrain": terrain_disagreements}


def measure(name: str, observations: DataFrame, dem: DataFrame) -> DataFrame:
    return MEASURES[name](observations, dem)


def shape_errors(rows: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Median distance of a session's residuals from their median, with `least` of them or more."""
    medians = rows.groupBy(key).agg(F.median("residual_m").alias("m"), F.count("residual_m").alias("n")).where(F.col("n") >= least)
    return rows.join(medians, key).groupBy(key).agg(F.median(F.abs(F.col("residual_m") - F.col("m"))).alias("shape_m"))


def spreads(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest less least height of each key."""
    return observations.groupBy(*keys).agg((F.max("elevation_m") - F.min("elevation_m")).alias("spread_m"), F.countDistinct("session_id").alias("rides"))


def histogram(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Rows by the first edge that isn't below the value ("more" beyond the last, "none" for null)."""
    label = F.when(value.isNull(), "none")
    for e in edges:
        label = label.when(value <= e, f"<={e:g}")
    return rows.groupBy(label.otherwise("more").alias("band")).agg(F.count("*").alias("n"))


def discard_report(runs: DataFrame) -> DataFrame:
    """Discarded runs by kind: fragments that the whole session's reach would carry over the gate, and touches."""
    return runs.where("NOT qualified").groupBy("kind").agg(F.count_if(F.col("stitched_qualifies")).alias("fragments"), F.count_if(~F.col("stitched_qualifies")).alias("touches"), F.count("*").alias("runs"))


def reach(runs: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """For each run, the stretch that all its session's runs on the line cover, their number, and whether that would pass the gate."""
    key = ["session_id", *LINE]
    each = runs.groupBy(*key).agg(F.min("covered_from_m").alias("low"), F.max("covered_to_m").alias("high"), F.count("*").alias("runs_on_line"))
    span = F.greatest(F.lit(0.0), F.col("high") - F.col("low"))
    rows = runs.join(each, key).withColumn("stitched_span_m", span)
    share = F.when(F.col("length_m") > 0, F.col("stitched_span_m") / F.col("length_m")).otherwise(0.0)
    return rows.withColumn("stitched_qualifies", S.qualifies(F.col("stitched_span_m"), share, config.min_span_m, config.min_coverage)).drop("low", "high")


def fingerprint(table: DataFrame) -> DataFrame:
    """An order-free fingerprint: rows, and the sum and exclusive or of their hashes."""
    h = F.xxhash64(*[F.col(c) for c in table.columns])
    return table.agg(F.count("*").alias("row_count"), F.bit_xor(h).alias("xor_hash"), F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("sum_hash"))


def text_fingerprint(table: DataFrame, columns: list[str]) -> DataFrame:
    """A fingerprint of a table whatever its order: the md5s of its rows, sorted and joined within each bucket of equal
    first six digits, hashed; these within each of equal first three; and those at last.  No task holds more than a bucket."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]).cast("binary"))
    joined = lambda c: F.md5(F.array_join(F.array_sort(F.collect_list(c)), "").cast("binary"))
    fine = table.select(row.alias("h")).groupBy(F.substring("h", 1, 6).alias("digits")).agg(F.count("*").alias("n"), joined("h").alias("h"))
    coarse = fine.groupBy(F.substring("digits", 1, 3).alias("digits")).agg(F.sum("n").alias("n"), joined(F.concat("digits", "h")).alias("h"))
    return coarse.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), joined(F.concat("digits", "h")).alias("fingerprint"))


def changed_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines that only one of two models has: lost or gained."""
    a, b = before.select(*LINE).distinct(), after.select(*LINE).distinct()
    return a.join(b, LINE, "left_anti").withColumn("change", F.lit("lost")).unionByName(b.join(a, LINE, "left_anti").withColumn("change", F.lit("gained")))


def witness_disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines that one of two witnesses has and the other hasn't, on segments that both have seen."""
    shared = a.select("segment_id").distinct().join(b.select("segment_id").distinct(), "segment_id", "left_semi")
    return changed_lines(a, b).join(shared, "segment_id", "left_semi")


def deleted(rows: DataFrame, gone: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows left when parents go: those that point at them go too."""
    return rows.join(gone.select(F.col(parent).alias(key)), key, "left_anti").select(rows.columns)


def set_null(rows: DataFrame, gone: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows with their pointer at parents that go set to null."""
    hit = gone.select(F.col(parent).alias("_gone")).distinct()
    return rows.join(hit, F.col(key) == F.col("_gone"), "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(rows.columns)


def top_destinations(rows: DataFrame, keys: list[str], value: str, n: int = 3) -> DataFrame:
    """Of each key, its n most frequent values as text with counts, and how many more there are."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.desc("c"), value)
    ranked = counts.withColumn("r", F.row_number().over(w)).withColumn("k", F.count("*").over(Window.partitionBy(*keys)))
    text = F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws("x ", F.col("c").cast("string"), F.col(value).cast("string")).alias("t")))), lambda s: s["t"])
    found = ranked.where(F.col("r") <= n).groupBy(*keys, "k").agg(F.array_join(text, ", ").alias("t"))
    return found.select(*keys, F.concat(F.col("t"), F.when(F.col("k") > n, F.concat(F.lit(", +"), (F.col("k") - n).cast("string"), F.lit(" more"))).otherwise("")).alias("destinations"))


def schema_contract(table: DataFrame, expected: str) -> None:
    """Raises where the table hasn't exactly the expected columns and types."""
    from pyspark.sql.types import _parse_datatype_string

    found, wanted = [(f.name, f.dataType) for f in table.schema], [(f.name, f.dataType) for f in _parse_datatype_string(expected)]
    if found != wanted:
        raise TypeError(f"expected {wanted}, found {found}")


def checked_ids(rows: DataFrame, column: str) -> DataFrame:
    """Fails at run time for an id that isn't a whole number of 0 to 2**53 - 1."""
    c = F.col(column).cast("double")
    bad = c.isNull() | F.isnan(c) | (c < 0) | (c >= 2.0**53) | (c != F.floor(c))
    return rows.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit(f"{column} is no id: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))).otherwise(F.col(column).cast("long")))


def ring(readings: DataFrame, capacity: int, key: str = "device_id", arrived: str = "arrived") -> DataFrame:
    """The last `capacity` readings of each device by arrival, as a ring that overwrites its oldest would hold."""
    w = Window.partitionBy(key).orderBy(F.desc(arrived))
    return readings.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= capacity).drop("_r")


def live_positions(columns: DataFrame) -> DataFrame:
    """Place of each column that isn't dropped among those of its table (table_name, position, dropped)."""
    w = Window.partitionBy("table_name").orderBy("position")
    return columns.where("NOT dropped").select("table_name", "position", F.row_number().over(w).alias("place"))


def largest(rows: DataFrame, by: str, ties: list[str], n: int) -> DataFrame:
    """A report of the n rows with the most of `by`; ties by the columns named."""
    return rows.where(F.col(by).isNotNull()).orderBy(F.desc(by), *ties).limit(n)


def changed_answers(recorded: DataFrame, replayed: DataFrame, key: str = "request", answer: str = "answer") -> DataFrame:
    """missing, new or changed for each request whose recorded answer (once a request) isn't the replayed one."""
    a = recorded.select(key, F.struct(answer).alias("a"))
    rows = a.join(replayed.select(key, F.struct(answer).alias("b")), key, "full_outer")
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(~F.col(f"a.{answer}").eqNullSafe(F.col(f"b.{answer}")), "changed")
    return rows.select(key, change.alias("change")).where("change IS NOT NULL")
