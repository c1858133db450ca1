"""Growing paths over a network of any size, as joins.

The fork rule looks at a line and at the segment that it was entered from, so these two are a state, and every state has
one state that follows it, or none.  Chains of states are found by doubling: a chain of 2**k lines is one of 2**(k-1) and
the one that begins where that ends.  A chain ends where nothing may follow, where it meets itself, or where it is longer
than a path may be, so it is never longer than the longest path of the shortest segments, and there are about as many
joins as the logarithm of its lines.  Paths are then the chains of their first line, cut into stretches by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import DEFAULT, EngineConfig
from ridgeline.functions import geo as G
from ridgeline.functions import scalar as S
from ridgeline.operators import model as M
from ridgeline.operators import windows as W
from ridgeline.plans.storage import saved, shuffled

LINE = ["segment_id", "direction"]
SOURCES = ("line", "twin", "none")


def legs(ways: DataFrame) -> DataFrame:
    """(segment_id, leg, lon0, lat0, lon1, lat1, start_m, end_m): the legs of ways (id, line), with running metres."""
    ends = F.arrays_zip(F.slice("line", F.lit(1), F.size("line") - 1).alias("a"), F.slice("line", F.lit(2), F.size("line") - 1).alias("b"))
    rows = ways.where(F.size("line") > 1).select(F.col("id").alias("segment_id"), F.posexplode(ends).alias("leg", "x"))
    rows = rows.select("segment_id", "leg", F.col("x.a")[0].alias("lon0"), F.col("x.a")[1].alias("lat0"), F.col("x.b")[0].alias("lon1"), F.col("x.b")[1].alias("lat1"))
    run = F.sum(G.haversine_m(F.col("lon0"), F.col("lat0"), F.col("lon1"), F.col("lat1"))).over(Window.partitionBy("segment_id").orderBy("leg"))
    rows = rows.withColumn("end_m", run)
    return rows.withColumn("start_m", F.coalesce(F.lag("end_m").over(Window.partitionBy("segment_id").orderBy("leg")), F.lit(0.0)))


def _point(m: Column, name: str) -> Column:
    """Of the legs of a group, the point m metres along, by distance within its leg."""
    inside = F.greatest(F.lit(0.0), F.least(m, F.col("whole")))
    share = F.when(F.col("end_m") > F.col("start_m"), (inside - F.col("start_m")) / (F.col("end_m") - F.col("start_m"))).otherwise(0.0)
    point = F.struct((F.col("lon0") + (F.col("lon1") - F.col("lon0")) * share).alias("lon"), (F.col("lat0") + (F.col("lat1") - F.col("lat0")) * share).alias("lat"))
    return F.min_by(point, F.when(F.col("end_m") >= inside, F.col("leg"))).alias(name)


def line_tips(ways: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(segment_id, direction, tip, entry_deg, exit_deg): the last point of each line, and its bearings over the first and last metres."""
    rows = legs(ways).withColumn("whole", F.max("end_m").over(Window.partitionBy("segment_id")))
    span = F.lit(config.heading_span_m)
    ends = rows.groupBy("segment_id").agg(
        F.min_by(F.struct(F.col("lon0").alias("lon"), F.col("lat0").alias("lat")), "leg").alias("a"), F.max_by(F.struct(F.col("lon1").alias("lon"), F.col("lat1").alias("lat")), "leg").alias("b"),
        _point(span, "after_a"), _point(F.col("whole") - span, "before_b"),
    )

    def bearing(p: str, q: str) -> Column:
        return G.bearing_deg(F.col(f"{p}.lon"), F.col(f"{p}.lat"), F.col(f"{q}.lon"), F.col(f"{q}.lat"))

    forward = F.struct(F.lit("forward").alias("direction"), F.col("b").alias("tip"), bearing("a", "after_a").alias("entry_deg"), bearing("before_b", "b").alias("exit_deg"))
    backward = F.struct(F.lit("backward").alias("direction"), F.col("a").alias("tip"), bearing("b", "before_b").alias("entry_deg"), bearing("after_a", "a").alias("exit_deg"))
    return ends.select("segment_id", F.explode(F.array(forward, backward)).alias("x")).select("segment_id", "x.*")


def arcs(ways: DataFrame, ends: DataFrame, extents: DataFrame, moves: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(segment_id, direction, to_segment_id, to_direction, turn, source, rides, same): what may follow each line.

    ways: id, line, length_m, street_name; ends: segment_id, which, other; extents: segment_id, direction; moves:
    session_id, segment_id, direction, next_segment_id, next_direction.  The next line begins at its end that is nearer
    (forward where both are).  source: 0 own data, 1 the other direction's, 2 none; rides: sessions that went so; same:
    the street's name goes on."""
    tips = saved(line_tips(ways, config))
    name = F.lower(F.trim(F.regexp_replace(F.coalesce("street_name", F.lit("")), r"\s+", " ")))
    names = ways.select(F.col("id").alias("segment_id"), name.alias("name"))
    out = ends.select("segment_id", F.when(F.col("which") == "end", "forward").otherwise("backward").alias("direction"), F.col("other").alias("to_segment_id")).distinct()
    out = out.join(shuffled(tips.select(*LINE, "tip", "exit_deg")), LINE)
    both = tips.groupBy(F.col("segment_id").alias("to_segment_id")).pivot("direction", ["forward", "backward"]).agg(F.first("tip").alias("tip"), F.first("entry_deg").alias("entry"))
    out = out.join(shuffled(both), "to_segment_id")
    away = [G.haversine_m(F.col("tip.lon"), F.col("tip.lat"), F.col(f"{d}_tip.lon"), F.col(f"{d}_tip.lat")) for d in ("forward", "backward")]
    back = away[0] < away[1]  # the forward tip is its end
    out = out.select(*LINE, "to_segment_id", F.when(back, "backward").otherwise("forward").alias("to_direction"), G.turn_deg(F.col("exit_deg"), F.when(back, F.col("backward_entry")).otherwise(F.col("forward_entry"))).alias("turn"))
    drawn = extents.select(F.col("segment_id").alias("to_segment_id"), F.col("direction").alias("own")).distinct().groupBy("to_segment_id").agg(F.collect_set("own").alias("drawn"))
    source = F.when(F.array_contains("drawn", F.col("to_direction")), 0).when(F.size("drawn") > 0, 1).otherwise(2)
    rides = moves.groupBy(*LINE, F.col("next_segment_id").alias("to_segment_id"), F.col("next_direction").alias("to_direction")).agg(F.countDistinct("session_id").alias("rides"))
    out = out.join(shuffled(drawn), "to_segment_id", "left").join(shuffled(rides), [*LINE, "to_segment_id", "to_direction"], "left").join(shuffled(names), "segment_id").join(shuffled(names.select(F.col("segment_id").alias("to_segment_id"), F.col("name").alias("to_name"))), "to_segment_id")
    return out.select(*LINE, "to_segment_id", "to_direction", "turn", source.alias("source"), F.coalesce("rides", F.lit(0)).alias("rides"), ((F.col("name") != "") & (F.col("name") == F.col("to_name"))).alias("same"))


def _listed(rows: DataFrame, *keys: str) -> DataFrame:
    """The arcs of each line as one array `c`; a junction's arms are few."""
    arc = F.struct("turn", "source", "rides", "same", F.col("to_segment_id").alias("seg"), (F.col("to_direction") == "backward").cast("int").alias("back"))
    return rows.groupBy(*keys).agg(F.collect_list(arc).alias("c"))


def chosen(c: Column, config: EngineConfig = DEFAULT) -> Column:
    """(seg, back, rule) of the first rule that decides among arcs, null where none does: history (one measured line with the most rides), name (the street goes on, by least turn), turn (gentle ones, measured first), only (a single one)."""
    rides = F.array_max(F.transform(c, lambda x: F.when(x["source"] == 0, x["rides"]).otherwise(0)))
    leaders = F.filter(c, lambda x: (x["source"] == 0) & (x["rides"] == rides))
    named = F.array_min(F.transform(F.filter(c, lambda x: x["same"]), lambda x: F.struct(x["turn"].alias("a"), x["source"].cast("double").alias("b"), x["seg"].alias("seg"), x["back"].alias("back"))))
    gentle = F.array_min(F.transform(F.filter(c, lambda x: x["turn"] <= config.max_turn_deg), lambda x: F.struct(x["source"].cast("double").alias("a"), x["turn"].alias("b"), x["seg"].alias("seg"), x["back"].alias("back"))))
    pick = lambda x, rule: F.struct(x["seg"].alias("seg"), x["back"].alias("back"), F.lit(rule).alias("rule"))
    return F.when((rides > 0) & (F.size(leaders) == 1), pick(F.get(leaders, 0), "history")).when(named.isNotNull(), pick(named, "name")).when(gentle.isNotNull(), pick(gentle, "turn")).when(F.size(c) == 1, pick(F.get(c, 0), "only"))


def _cut(chain: Column, *passed: Column) -> Column:
    """The chain up to where it meets itself or one of the segments passed."""
    met = F.transform(chain, lambda x, i: F.array_contains(F.concat(F.array(*passed), F.transform(F.slice(chain, F.lit(1), i), lambda y: y["seg"])), x["seg"]))
    at = F.array_position(met, True)
    return F.when(at > 0, F.slice(chain, F.lit(1), (at - 1).cast("int"))).otherwise(chain)


def _metres(chain: Column) -> Column:
    return F.aggregate(chain, F.lit(0.0), lambda acc, x: acc + x["length_m"])


def chains(states: DataFrame, most: float) -> DataFrame:
    """(before, seg, back, chain, reason, branches) of every state: the lines (seg, back, rule, length_m) that follow it, longer than `most` metres at most by the last, and why they stop (null: too long).

    states: before, seg, back, next (seg, back, rule, length_m; null for none), arms (how many could follow)."""
    key = ["before", "seg", "back"]
    none = F.array().cast("array<struct<seg:bigint,back:int,rule:string,length_m:double>>")
    open_ = F.col("next").isNotNull()
    rows = states.select(*key, F.when(open_, F.array("next")).otherwise(none).alias("chain"), open_.alias("open"), F.when(~open_, F.when(F.col("arms") > 0, "fork").otherwise("end")).alias("reason"), F.when(~open_, F.col("arms")).otherwise(0).alias("branches"))
    # a line that follows itself
    rows = _closed(rows.withColumn("whole", F.col("chain")), most)
    rows = saved(rows)
    while rows.where("open").limit(1).count():
        last = F.element_at("chain", -1)
        before = F.when(F.size("chain") > 1, F.try_element_at("chain", F.lit(-2))["seg"]).otherwise(F.col("seg"))
        going = rows.where("open").select(*key, "chain", before.alias("b"), last["seg"].alias("s"), last["back"].alias("k"))
        tail = rows.select(F.col("before").alias("b"), F.col("seg").alias("s"), F.col("back").alias("k"), F.col("chain").alias("tail"), "open", "reason", "branches")
        more = going.join(shuffled(tail), ["b", "s", "k"]).select(*key, F.concat("chain", "tail").alias("whole"), "open", "reason", "branches")
        rows = saved(rows.where("NOT open").unionByName(_closed(more, most)))
    return rows.drop("open")


def _closed(rows: DataFrame, most: float) -> DataFrame:
    """Rows with `whole` cut where it meets itself, and closed where it is or where it is longer than `most`."""
    rows = rows.withColumn("chain", _cut(F.col("whole"), F.col("seg")))
    loop = F.size("chain") < F.size("whole")
    return rows.select("before", "seg", "back", "chain", (F.col("open") & ~loop & (_metres(F.col("chain")) <= most)).alias("open"), F.when(loop, "loop").otherwise(F.col("reason")).alias("reason"), F.when(loop, 0).otherwise(F.col("branches")).alias("branches"))


def stretches(ways: DataFrame, extents: DataFrame) -> DataFrame:
    """(segment_id, direction, a_m, b_m, source): each line cut where its own data, or the other direction's, begin and end; equal neighbours are one."""
    both = ways.select(F.col("id").alias("segment_id"), "length_m", F.explode(F.array(F.lit("forward"), F.lit("backward"))).alias("direction"))
    own = extents.select(*LINE, F.col("from_m").alias("p"), F.col("to_m").alias("q"))
    twin = extents.select("segment_id", S.opposite(F.col("direction")).alias("direction"), F.col("from_m").alias("u"), F.col("to_m").alias("v"))
    rows = both.join(shuffled(own), LINE, "left").join(shuffled(twin), LINE, "left").withColumns({"r": F.col("length_m") - F.col("v"), "s": F.col("length_m") - F.col("u")})
    whole = F.col("length_m")
    knots = F.array_sort(F.array_distinct(F.transform(F.filter(F.array(F.lit(0.0), "p", "q", "r", "s", whole), lambda x: x.isNotNull()), lambda x: F.greatest(F.lit(0.0), F.least(x, whole)))))
    rows = rows.select(*LINE, "p", "q", "r", "s", F.explode(F.arrays_zip(F.slice(knots, F.lit(1), F.size(knots) - 1).alias("a"), F.slice(knots, F.lit(2), F.size(knots) - 1).alias("b"))).alias("x"))
    middle = (F.col("x.a") + F.col("x.b")) / 2
    kind = F.when(middle.between(F.col("p"), F.col("q")), 0).when(middle.between(F.col("r"), F.col("s")), 1).otherwise(2)
    rows = rows.select(*LINE, F.col("x.a").alias("a_m"), F.col("x.b").alias("b_m"), kind.alias("source"))
    w = Window.partitionBy(*LINE).orderBy("a_m")
    rows = rows.withColumn("new", F.coalesce((F.col("source") != F.lag("source").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(w))
    return rows.groupBy(*LINE, "run").agg(F.min("a_m").alias("a_m"), F.max("b_m").alias("b_m"), F.first("source").alias("source")).drop("run")


def grow_paths(requests: DataFrame, ways: DataFrame, ends: DataFrame, extents: DataFrame, moves: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Pieces of the path grown from each request (path_id, segment_id, direction, at_m), with why it stopped.

    (path_id, i, segment_id, direction, from_m, to_m, at_m, source, rule, reason, ahead_m, branches); a path without
    pieces has one row with i null.  The fork rule gives a chain of lines until it can't decide (fork), nothing follows
    (end), it meets itself (loop) or it is long enough (limit).  Its stretches are cut where one goes on for too long
    without data (gap) or at the greatest length (limit).  What it last went without data is taken back: ahead_m."""
    most = config.max_path_m
    lengths = ways.select(F.col("id").alias("seg"), "length_m")
    every = saved(arcs(ways, ends, extents, moves, config))
    out = saved(_listed(every, *LINE))
    back = (F.col("direction") == "backward").cast("int")

    def with_next(rows: DataFrame) -> DataFrame:
        """rows with c as next, with its length, and arms."""
        rows = rows.withColumn("n", chosen(F.col("c"), config)).withColumn("arms", F.size(F.coalesce("c", F.array().cast(rows.schema["c"].dataType)))).drop("c")
        rows = rows.join(shuffled(lengths.select(F.col("seg").alias("n_seg"), F.col("length_m").alias("n_m"))), F.col("n.seg") == F.col("n_seg"), "left")
        return rows.withColumn("next", F.when(F.col("n").isNotNull(), F.struct(F.col("n.seg").alias("seg"), F.col("n.back").alias("back"), F.col("n.rule").alias("rule"), F.col("n_m").alias("length_m")))).drop("n", "n_seg", "n_m")

    entered = every.select(F.col("segment_id").alias("before"), F.col("to_segment_id").alias("segment_id"), F.col("to_direction").alias("direction")).distinct()
    states = entered.join(shuffled(out), LINE, "left").withColumn("c", F.filter("c", lambda x: x["seg"] != F.col("before")))
    states = with_next(states.select("before", F.col("segment_id").alias("seg"), back.alias("back"), "c"))
    following = chains(states, most)

    asked = requests.select("path_id", *LINE, "at_m").join(shuffled(lengths.withColumnRenamed("seg", "segment_id")), "segment_id", "left").join(shuffled(out), LINE, "left")
    asked = with_next(asked).withColumn("at_m", F.greatest(F.lit(0.0), F.least("at_m", "length_m")))
    first = following.select(F.col("before").alias("f_before"), F.col("seg").alias("f_seg"), F.col("back").alias("f_back"), "chain", "reason", "branches")
    asked = asked.join(shuffled(first), (F.col("segment_id") == F.col("f_before")) & (F.col("next.seg") == F.col("f_seg")) & (F.col("next.back") == F.col("f_back")), "left")
    kind = "array<struct<seg:bigint,back:int,rule:string,length_m:double>>"
    whole = F.when(F.col("next").isNotNull(), F.concat(F.array("next"), F.coalesce("chain", F.array().cast(kind)))).otherwise(F.array().cast(kind))
    asked = asked.withColumn("whole", whole).withColumn("cut", _cut(F.col("whole"), F.col("segment_id")))
    reason = F.when(F.col("length_m").isNull(), "end").when(F.size("cut") < F.size("whole"), "loop").when(F.col("next").isNull(), F.when(F.col("arms") > 0, "fork").otherwise("end")).otherwise(F.col("reason"))
    branches = F.when(F.size("cut") < F.size("whole"), 0).when(F.col("next").isNull(), F.col("arms")).otherwise(F.col("branches"))
    asked = saved(asked.select("path_id", *LINE, "at_m", "length_m", "cut", reason.alias("reason"), F.coalesce(branches, F.lit(0)).alias("branches")))

    start = F.struct(F.col("segment_id").alias("seg"), back.alias("back"), F.lit("start").alias("rule"), F.col("length_m"))
    rows = asked.where("length_m IS NOT NULL").select("path_id", "at_m", "reason", "branches", F.posexplode(F.concat(F.array(start), "cut")).alias("leg", "x"))
    rows = rows.select("path_id", "reason", "branches", "leg", F.col("x.seg").alias("segment_id"), F.when(F.col("x.back") == 1, "backward").otherwise("forward").alias("direction"), F.col("x.rule").alias("rule"), F.when(F.col("leg") == 0, F.col("at_m")).otherwise(0.0).alias("a"), F.col("x.length_m").alias("b"))
    # no line begins beyond the greatest length
    path = Window.partitionBy("path_id").orderBy("leg")
    reach = F.sum(F.col("b") - F.col("a")).over(path)
    rows = rows.withColumn("reach", reach).withColumn("limited", F.max(F.col("reach") > most).over(Window.partitionBy("path_id"))).where(F.col("reach") - (F.col("b") - F.col("a")) <= most)
    rows = rows.withColumns({"reason": F.when(F.col("limited"), "limit").otherwise(F.col("reason")), "branches": F.when(F.col("limited"), 0).otherwise(F.col("branches"))})

    rows = rows.join(shuffled(stretches(ways, extents)), LINE).withColumns({"p": F.greatest("a_m", "a"), "q": F.least("b_m", "b")}).where("q > p")
    order = Window.partitionBy("path_id").orderBy("leg", "p")
    rows = rows.withColumns({"i": F.row_number().over(order) - 1, "run": F.col("q") - F.col("p"), "bare": F.when(F.col("source") == 2, F.col("q") - F.col("p")).otherwise(0.0), "head": F.col("leg") != F.coalesce(F.lag("leg").over(order), F.lit(-1))})
    rows = rows.withColumns({"at": F.coalesce(F.sum("run").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "bares": F.sum("bare").over(order)})
    rows = rows.withColumn("end", F.sum("run").over(order)).withColumn("bare_run", F.col("bares") - F.max(F.when(F.col("source") == 2, 0.0).otherwise(F.col("bares"))).over(order))
    every_piece = Window.partitionBy("path_id")
    at = lambda cond: F.coalesce(F.min(F.when(cond, F.col("i"))).over(every_piece), F.count("*").over(every_piece))
    rows = rows.withColumns({"n": F.count("*").over(every_piece), "gap": at(F.col("bare_run") > config.max_no_data_m), "full": at(F.col("end") - F.col("run") >= most), "over": at(F.col("end") > most)})
    gapped = (F.col("gap") < F.col("n")) & (F.col("gap") <= F.least("full", "over"))
    ended = (F.col("full") < F.col("n")) | (F.col("over") < F.col("n"))
    rows = rows.withColumns({"stop": F.when(gapped, F.col("gap")).when(ended, F.least(F.col("full"), F.col("over") + 1)).otherwise(F.col("n")), "reason": F.when(gapped, "gap").when(ended, "limit").otherwise(F.col("reason"))})
    rows = rows.where("i < stop")
    short = (F.col("over") < F.col("full")) & (F.col("over") + 1 == F.col("stop")) & (F.col("reason") == "limit") & (F.col("i") == F.col("over"))
    rows = rows.withColumn("q", F.when(short, F.col("p") + most - F.col("at")).otherwise(F.col("q")))
    rows = rows.withColumn("kept", F.coalesce(F.max(F.when(F.col("source") != 2, F.col("i") + 1)).over(every_piece), F.lit(0)))
    rows = rows.withColumn("ahead_m", F.sum(F.when(F.col("i") >= F.col("kept"), F.col("q") - F.col("p")).otherwise(0.0)).over(every_piece))
    branches = F.when(F.col("reason").isin("fork", "end"), F.col("branches")).otherwise(0).cast("int")
    found = saved(rows.select("path_id", "i", *LINE, F.col("p").alias("from_m"), F.col("q").alias("to_m"), F.col("at").alias("at_m"), F.element_at(F.array(*map(F.lit, SOURCES)), F.col("source") + 1).alias("source"), F.when(F.col("head"), F.col("rule")).alias("rule"), "reason", "ahead_m", branches.alias("branches"), "kept"))
    pieces = found.where("i < kept").drop("kept")
    # paths without a piece: all taken back, cut before the first, or of no length
    bare = found.where("kept = 0").groupBy("path_id").agg(F.max("reason").alias("r"), F.max("ahead_m").alias("m"), F.max("branches").alias("b"))
    empty = asked.join(shuffled(pieces.select("path_id").distinct()), "path_id", "left_anti").join(shuffled(bare), "path_id", "left")
    gap_first = F.col("length_m").isNotNull() & F.col("r").isNull() & (F.col("at_m") < F.col("length_m"))
    why = F.coalesce("r", F.when(gap_first, "gap").otherwise(F.col("reason")))
    empty = empty.select("path_id", F.lit(None).cast("int").alias("i"), *LINE, *[F.lit(None).cast("double").alias(c) for c in ("from_m", "to_m", "at_m")], F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("rule"), why.alias("reason"), F.coalesce("m", F.lit(0.0)).alias("ahead_m"), F.when(why.isin("fork", "end"), F.coalesce("b", "branches")).otherwise(0).cast("int").alias("branches"))
    return pieces.unionByName(empty)


def score_rules(ways: DataFrame, ends: DataFrame, extents: DataFrame, moves: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(rule, verdict, moves): every session's moves at forks (two candidates or more) judged by all rules in order, the session's own rides left out of the history.

    Verdict: right or wrong by what the rule chose, stopped (with rule null) where none decides.  Lines that aren't on the
    network have no candidates."""
    back = lambda c: (F.col(c) == "backward").cast("int").alias("back")
    made = moves.select("session_id", *LINE, F.struct(F.col("next_segment_id").alias("seg"), back("next_direction")).alias("made")).distinct()
    took = made.groupBy("session_id", *LINE).agg(F.collect_set("made").alias("took"))  # a session's own moves from one line: a junction's arms at most
    out = _listed(arcs(ways, ends, extents, moves, config), *LINE).where(F.size("c") > 1)
    own = lambda x: F.array_contains("took", F.struct(x["seg"].alias("seg"), x["back"].alias("back"))).cast("int")
    others = F.transform("c", lambda x: F.struct(x["turn"].alias("turn"), x["source"].alias("source"), (x["rides"] - own(x)).alias("rides"), x["same"].alias("same"), x["seg"].alias("seg"), x["back"].alias("back")))
    rows = took.join(shuffled(out), LINE).withColumn("others", others).withColumn("n", chosen(F.col("others"), config)).select("n", F.explode("took").alias("made"))
    verdict = F.when(F.col("n").isNull(), "stopped").when((F.col("n.seg") == F.col("made.seg")) & (F.col("n.back") == F.col("made.back")), "right").otherwise("wrong")
    return rows.groupBy(F.col("n.rule").alias("rule"), verdict.alias("verdict")).agg(F.count("*").alias("moves"))


def path_spans(pieces: DataFrame, ranges: DataFrame, buckets: DataFrame, lines: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(path_id, i, at_m, length_m, slope_pct, source): the drawn ranges within the pieces of each path, and one slope over each run of pieces without any.

    pieces: path_id, i, segment_id, direction, from_m, to_m, at_m, source.  ranges: segment_id, direction, range_from_m,
    range_to_m, slope_pct of the lines' own data; a piece of the other direction's data has them mirrored.  Heights where
    the runs begin and end come from the buckets of the line whose data the piece beside has."""
    drawn = ranges.select(*LINE, "range_from_m", "range_to_m", "slope_pct").withColumn("source", F.lit("line"))
    drawn = drawn.unionByName(M.twin_ranges(ranges, lines).select(*LINE, "range_from_m", "range_to_m", "slope_pct").withColumn("source", F.lit("twin")))
    known = drawn.select(*LINE, "source").distinct().withColumn("known", F.lit(True))
    rows = pieces.join(shuffled(known), [*LINE, "source"], "left").join(shuffled(lines.select("segment_id", "length_m")), "segment_id").withColumn("known", F.coalesce("known", F.lit(False)))
    met = rows.where("known").drop("length_m").join(shuffled(drawn), [*LINE, "source"]).withColumns({"p": F.greatest("from_m", "range_from_m"), "q": F.least("to_m", "range_to_m")}).where("q > p")
    measured = met.select("path_id", "i", (F.col("at_m") + F.col("p") - F.col("from_m")).alias("at_m"), (F.col("q") - F.col("p")).alias("length_m"), "slope_pct", "source")

    def height(m: str) -> DataFrame:
        own = F.col("source") == "line"
        points = rows.where("known").select("path_id", "i", "segment_id", F.when(own, F.col("direction")).otherwise(S.opposite(F.col("direction"))).alias("direction"), F.when(own, F.col(m)).otherwise(F.col("length_m") - F.col(m)).alias("travel_m"))
        return M.heights_at(buckets, points).select("path_id", "i", F.col("height_m").alias(f"{m}_height"))

    bare = rows.select("path_id", "i", "at_m", F.when(F.col("known"), F.col("source")).otherwise("none").alias("source"), (F.col("to_m") - F.col("from_m")).alias("length_m"))
    bare = bare.join(shuffled(height("from_m")), ["path_id", "i"], "left").join(shuffled(height("to_m")), ["path_id", "i"], "left").withColumnsRenamed({"from_m_height": "from_height_m", "to_m_height": "to_height_m"})
    slopes = W.unmeasured_slopes(bare).join(shuffled(rows.select("path_id", "i", "at_m")), ["path_id", "i"])
    return measured.unionByName(slopes.select("path_id", "i", "at_m", "length_m", "slope_pct", F.lit("none").alias("source")))
