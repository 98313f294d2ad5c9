"""Chat formatting: cumulative-snapshot collapse, then rendering.

Loggers that write a conversation after every turn leave snapshots, each a prefix of the next.
Every turn is hashed with its place, and a running XOR of those hashes identifies each turn prefix.
A conversation whose last prefix hash is an inner prefix hash of a longer one is a snapshot; an
anti-join on (length, hash) keeps the maximal conversations, and of equal ones the least id. The
prefix table is made distinct, with map-side combining, before the join: a first turn that a third of all
conversations share is one row. Turns are rendered one by one and joined only for the conversations kept.

DataFrame functions only. Two independent 64-bit hashes make 128-bit prefix keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import NULL_ID, external_id, internal_id, prepared

#: Turns of a conversation that one sort handles; longer ones are summed by such stretches first.
STRETCH = 512
# The ChatML frame of a turn.
OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


#: What tells conversations apart: the id, and a hash of the turn where there is no id.
KEY = ("conv", "alone")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv, alone, place (from 1), h1, h2 (hash of the prefix that ends there) of turns (conv, alone, turn, role, mark).

    Places and running XORs are found within stretches of turn numbers, then offset by the sums of the
    stretches before, so a conversation of any length is spread over tasks."""
    rows = turns.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    inside = Window.partitionBy(*KEY, "stretch").orderBy("turn", "role", "mark")
    sizes = rows.groupBy(*KEY, "stretch").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*KEY).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*KEY, "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = rows.withColumn("own", F.row_number().over(inside)).join(offsets, [*KEY, "stretch"])
    placed = placed.withColumn("place", F.col("own") + F.col("offset")).drop("own", "offset")
    hashed = placed.withColumn("a", F.xxhash64("place", "role", "mark")).withColumn("b", F.xxhash64(F.lit(1), "mark", "role", "place"))
    run = Window.partitionBy(*KEY, "stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.groupBy(*KEY, "stretch").agg(F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"))
    carried = sums.select(*KEY, "stretch", F.coalesce(F.bit_xor("x").over(before), F.lit(0)).alias("x"), F.coalesce(F.bit_xor("y").over(before), F.lit(0)).alias("y"))
    local = hashed.withColumn("p", F.bit_xor("a").over(run)).withColumn("q", F.bit_xor("b").over(run)).join(carried, [*KEY, "stretch"])
    return local.select(*KEY, "place", F.col("p").bitwiseXOR(F.col("x")).alias("h1"), F.col("q").bitwiseXOR(F.col("y")).alias("h2"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(BETWEEN), text, F.lit(CLOSE))


def collapse(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations, itself included), rendered: the maximal conversations.

    Turns are ordered by turn, role and md5 of the text; a null turn number comes first (as -1), a null
    role is 'unknown', a null text is empty. Nothing ties turns without a conversation id to each other, so each is a conversation of
    its own; of equal conversations one with an id comes first. Turns that are exact repeats (same id, number, role and text) count once. An empty table gives an empty result.
    A conversation is one output row, so its rendering must fit in one; no other step gathers one."""
    prepared(conversations.sparkSession)
    said = conversations.select(
        internal_id(conv_col).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("mark", F.md5("text")).withColumn("alone", F.when(F.col("conv") == F.lit(NULL_ID), F.xxhash64("turn", "role", "mark")).otherwise(F.lit(0)))
    prefixes = prefix_hashes(said.select(*KEY, "turn", "role", "mark").distinct()).checkpoint()
    sizes = prefixes.groupBy(*KEY).agg(F.max(F.struct("place", "h1", "h2")).alias("last")).select(*KEY, "last.*")
    distinct = sizes.groupBy("place", "h1", "h2").agg(F.min(F.struct(F.col("conv") == F.lit(NULL_ID), *KEY)).alias("least"), F.count("*").alias("copies"))
    inner = prefixes.join(sizes.select(*KEY, F.col("place").alias("n")), [*KEY]).where("place < n").select("place", "h1", "h2").distinct()
    maximal = distinct.join(inner, ["place", "h1", "h2"], "left_anti").select("least.conv", "least.alone", F.col("place").alias("n_turns"), "copies")
    whole = said.join(maximal, [*KEY]).groupBy(*KEY, "n_turns", "copies").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "mark", "text"))).alias("said"))
    text = F.array_join(F.transform("said", lambda s: render_turn(s["role"], s["text"])), "")
    return whole.select(external_id("conv").alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), F.col("copies").alias("n_copies"), text.alias("rendered"))


ORACLE = """
WITH turns AS (
  SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN 'alone ' || md5(coalesce(turn, -1) || ':' || coalesce(role, 'unknown') || ':' || coalesce(text, '')) ELSE conv_id::VARCHAR END AS conv, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), prefixes AS (
  SELECT conv_id, conv, row_number() OVER w AS place, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER w AS prefix
  FROM turns WINDOW w AS (PARTITION BY conv ORDER BY turn, role, md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), sizes AS (SELECT conv, max(place) AS n FROM prefixes GROUP BY conv
), wholes AS (SELECT p.conv_id, p.place, p.prefix FROM prefixes p JOIN sizes s ON p.conv = s.conv AND p.place = s.n
), inner_prefixes AS (SELECT DISTINCT p.place, p.prefix FROM prefixes p JOIN sizes s ON p.conv = s.conv AND p.place < s.n
), single AS (SELECT min(conv_id) AS conv_id, place, prefix, count(*) AS copies FROM wholes GROUP BY place, prefix)
SELECT conv_id, place::BIGINT AS n_turns, copies::BIGINT AS n_copies, prefix AS rendered FROM single s
WHERE NOT EXISTS (SELECT 1 FROM inner_prefixes i WHERE i.place = s.place AND i.prefix = s.prefix)
"""
