"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation, the dialogue is rendered with that speaker as assistant and the others as
named users; turns of the fixed roles (system) stay what they are and have no perspective of their own, unless a
conversation has no other role.  The mask lists the stretches, in code points of the whole dialogue, that the assistant
speaks.

A dialogue is stored in parts of PART turns, so that a very long one is many groups: the texts of its parts, one after
another, are the dialogue.  The order of turns is found by ranges: rows go to tasks by ranges of (conversation, turn,
role, beginning of the text), are numbered in each and then across them by the sums of the ranges.  What stands before a
part has the same length for every speaker but for the heads of the speaker's own turns, so that running sums over the
parts give each perspective its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.frames import joined, partitions, saved

PART = 64
FIXED = ("system",)
NO_ID = "none"
#: Code points of a text that rows are dealt by; longer ones that begin alike are in one range.
BEGINNING = 64
_OWN = "<|assistant|>\n"
_END = "<|end|>"


def _head(role: Column, fixed: tuple[str, ...]) -> Column:
    """The head of a turn that isn't the assistant's."""
    named = F.concat(F.lit("<|user:"), role, F.lit("|>\n"))
    return F.when(role.isin(*fixed), F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(named) if fixed else named


def _before(*keys: str, order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _placed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (conv, turn, role, said) once each, with part, place (in the order of the part) and n (times in the part)."""
    # equal rows are one from here on; then all rows of a range are in one task, in order of ranges
    rows = rows.groupBy("conv", "turn", "role", "said").agg(F.count("*").alias("n"))
    rows = rows.repartitionByRange(partitions(rows.sparkSession), "conv", F.col("turn").asc_nulls_first(), "role", F.substring("said", 1, BEGINNING))
    rows = saved(rows.withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("conv", "range").orderBy(F.col("turn").asc_nulls_first(), "role", "said").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "range").agg(F.sum("n").alias("all"))
    sums = sums.select("conv", "range", F.coalesce(F.sum("all").over(_before("conv", order="range")), F.lit(0)).alias("earlier"))
    first = F.col("earlier") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    rows = rows.join(sums, ["conv", "range"]).withColumn("first", first)
    rows = rows.withColumn("part", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("first") + F.col("n") - 1) / size))))
    begin = F.greatest("first", F.col("part") * size)
    return rows.select("conv", "part", begin.alias("place"), "role", "said", (F.least(F.col("first") + F.col("n"), (F.col("part") + 1) * size) - begin).cast("int").alias("n"))


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, size: int = PART, fixed: tuple[str, ...] = FIXED) -> DataFrame:
    """(conv_id, speaker, part, n_turns, text, mask): a row for each conversation, participant and part of `size` turns.

    Turns go by number (nulls first), then role, then text.  A null role speaks as "unknown", a null text is empty, all
    rows without a conv_id are one conversation.  Repeated rows are repeated turns.  The texts of the parts of a
    conversation and speaker make the whole dialogue.  mask: start:end of each stretch by the speaker (text and end mark),
    counted from the start of the dialogue, comma-joined; empty where the speaker is silent in the part.  An empty table
    gives no rows; other columns are left out."""
    rows = turns.select(F.coalesce(F.col(conv_col).cast("long").cast("string"), F.lit(NO_ID)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("said"))
    rows = saved(_placed(rows, size))
    who = rows.groupBy("conv", "role").agg(F.lit(1).alias("one"))
    free = F.sum((~F.col("role").isin(*fixed)).cast("int") if fixed else F.lit(1)).over(Window.partitionBy("conv"))
    speakers = saved(who.withColumn("free", free).where((F.col("free") == 0) | (~F.col("role").isin(*fixed) if fixed else F.lit(True))).select("conv", F.col("role").alias("speaker")))

    # where each part begins, with no turn the speaker's own; and by how much each own turn before it differs
    length = (F.length(_head(F.col("role"), fixed)) + F.length("said") + len(_END) + 1) * F.col("n")
    by_role = saved(rows.groupBy("conv", "part", "role").agg(F.sum("n").alias("own"), F.sum(length.cast("long")).alias("length")))
    parts = by_role.groupBy("conv", "part").agg(F.sum("own").alias("n_turns"), F.sum("length").alias("length"))
    parts = saved(parts.select("conv", "part", "n_turns", F.coalesce(F.sum("length").over(_before("conv", order="part")), F.lit(0)).alias("begins")))
    spoken = joined(parts, speakers, "conv").join(by_role.select("conv", "part", F.col("role").alias("speaker"), "own"), ["conv", "part", "speaker"], "left")
    earlier = F.coalesce(F.sum(F.coalesce("own", F.lit(0))).over(_before("conv", "speaker", order="part")), F.lit(0))
    begins = F.col("begins") + earlier * (len(_OWN) - F.length(_head(F.col("speaker"), fixed)))
    spoken = spoken.select("conv", "part", "speaker", "n_turns", begins.alias("begins"))

    once = F.array_sort(F.collect_list(F.struct("place", "role", "said", "n")))
    whole = rows.groupBy("conv", "part").agg(F.flatten(F.transform(once, lambda t: F.array_repeat(t, t["n"]))).alias("turns"))
    each = whole.join(spoken, ["conv", "part"])
    own = lambda t: t["role"] == F.col("speaker")
    pieces = F.transform("turns", lambda t: F.struct(F.when(own(t), F.lit(_OWN)).otherwise(_head(t["role"], fixed)).alias("head"), F.concat(t["said"], F.lit(_END)).alias("body"), own(t).alias("own")))
    each = each.select(F.when(F.col("conv") != NO_ID, F.col("conv")).cast("long").alias("conv_id"), "speaker", "part", F.col("n_turns").cast("long").alias("n_turns"), "begins", pieces.alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    start = F.struct(F.col("begins").cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, p):
        a = acc["at"] + F.length(p["head"])
        b = a + F.length(p["body"])
        return F.struct((b + 1).cast("long").alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(F.concat_ws(":", a.cast("string"), b.cast("string"))))).otherwise(acc["spans"]).alias("spans"))

    return each.select("conv_id", "speaker", "part", "n_turns", text.alias("text"), F.array_join(F.aggregate("pieces", start, step)["spans"], ",").alias("mask"))


def op5_chat_formatting(turns: DataFrame) -> DataFrame:
    """perspectives() with the default marks."""
    return perspectives(turns)


#: The same; {part} turns a part, counted over a whole conversation.
_SQL = r"""
WITH a AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS i FROM conversations
), w AS (SELECT DISTINCT conv_id, role FROM a
), k AS (SELECT conv_id, role FROM w WHERE role <> 'system' UNION ALL SELECT conv_id, role FROM w WHERE NOT EXISTS (SELECT 1 FROM w v WHERE v.role <> 'system' AND v.conv_id IS NOT DISTINCT FROM w.conv_id)
), p AS (
  SELECT a.conv_id, k.role AS speaker, i, a.role,
         CASE WHEN a.role = k.role THEN '<|assistant|>' WHEN a.role = 'system' THEN '<|system|>' ELSE '<|user:' || a.role || '|>' END || chr(10) AS head, said || '<|end|>' AS body
  FROM a JOIN k ON a.conv_id IS NOT DISTINCT FROM k.conv_id
), o AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(head) AS pos FROM p
)
SELECT conv_id, speaker, CAST(i // {part} AS BIGINT) AS part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY i) AS text,
       coalesce(string_agg(CASE WHEN role = speaker THEN CAST(pos AS VARCHAR) || ':' || CAST(pos + length(body) AS VARCHAR) END, ',' ORDER BY i), '') AS mask
FROM o GROUP BY conv_id, speaker, i // {part}
"""
OP5_SQL = _SQL.format(part=PART)
