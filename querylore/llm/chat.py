"""Multi-party chat formatting by perspective rotation. DataFrame functions only.

Each conversation is rendered once for every participant: that speaker's turns become the assistant's, all other speakers become users
with their names, and the mask marks what the assistant says. Turns are gathered once, in parts of at most ``PART`` turns, and
rotated inside the row, so texts are shuffled once however many participants there are, and a conversation that holds a large part of the
table is many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = 64
CONTEXT_ROLES = ("system",)  # set the scene in every rendering and are nobody's perspective
# fixed values: the message marks
START, END = "<|im_start|>", "<|im_end|>"
NAMELESS = "unknown"


def _escaped(text: Column) -> Column:
    """A mark inside a message would end it, so it is broken by a space."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def rotate_perspectives(turns: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES, part: int = PART) -> DataFrame:
    """(conv_id, perspective, part, block, n_turns, text, spans) from turns (conv_id, turn, role, text, ...).

    ``spans`` are the character ranges [start, end) of text that the assistant says, end mark included. ``part`` is turn div 64;
    ``block`` is 0 unless repeated turn numbers put more than 64 turns in one part. Order is by turn, role, text, nulls first. A null
    text is an empty message, a null or empty role speaks as "unknown", null turns come first in part -1, rows without a conv_id
    are one conversation without an id. A conversation with context roles only has no participant and no rows. Other columns are
    ignored. An empty table gives an empty table.
    """
    spoken = turns.select(
        F.coalesce("conv_id", F.lit(0)).cast("long").alias("_id"), F.col("conv_id").isNotNull().alias("_named"),
        F.coalesce(F.floor(F.col("turn") / part), F.lit(-1)).cast("long").alias("part"), F.col("turn").cast("long").alias("turn"),
        F.when(F.length("role") > 0, F.col("role")).otherwise(NAMELESS).alias("role"), _escaped(F.col("text")).alias("text"),
    )
    key = ["_id", "_named", "part"]
    order = F.row_number().over(Window.partitionBy(*key).orderBy("turn", "role", "text")) - 1
    blocks = spoken.withColumn("block", F.floor(order / part).cast("long")).groupBy(*key, "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = spoken.filter(~F.col("role").isin(*context_roles)).select("_id", "_named", "role").distinct()
    places = spoken.select(*key).distinct()
    cast = places.join(speakers, ["_id", "_named"]).groupBy(*key).agg(F.sort_array(F.collect_set("role")).alias("speakers"))
    rows = blocks.join(cast, key).select(*key, "block", "turns", F.explode("speakers").alias("perspective"))

    def head(role: Column) -> Column:
        who = F.when(role == F.col("perspective"), "assistant").when(role.isin(*context_roles), role).otherwise(F.concat(F.lit("user name="), role))
        return F.concat(F.lit(START), who, F.lit("\n"))

    pieces = F.transform("turns", lambda t: F.struct(head(t["role"]).alias("head"), F.concat(t["text"], F.lit(END)).alias("said"), (t["role"] == F.col("perspective")).alias("own")))
    rows = rows.withColumn("_pieces", pieces)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        end = begin + F.length(p["said"])
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + 1).cast("long").alias("at"), F.when(p["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return rows.select(
        F.when(F.col("_named"), F.col("_id")).alias("conv_id"), "perspective", "part", "block", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["said"], F.lit("\n"))), "").alias("text"),
        F.aggregate("_pieces", zero, step, lambda s: s["spans"]).alias("spans"),
    )
