"""Preference formatting of pairs of conversations.

A pair has a chosen and a rejected conversation.  Their longest common prefix
of turns (same role and text, position by position) is the prompt, rendered
once; what follows in either is its completion, in which only assistant turns
bear loss.

Everything is done with DataFrame functions on single turns: the first
position where the two differ is a minimum per pair, which is summed up before
any exchange, so a conversation with a third of all turns is not gathered into
one task.  ``format_pairs`` returns segments; ``as_records`` joins the segments
of each pair into one record, for conversations that fit a row.

Defined results: turns of null position or null pair are left out; a null role
is ``user`` and a null text is empty; turns of one conversation and position
are ordered by role, text and numbered by ``tie`` among equals, so repeated
rows stay; a pair that has one side only has an empty prompt and one
completion; equal sides make a prompt only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def _turns(side: DataFrame) -> DataFrame:
    """Distinct turns of one side with the number of their copies."""
    clean = side.filter(F.col("pair_id").isNotNull() & F.col("turn").isNotNull())
    clean = clean.select("pair_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.groupBy("pair_id", "turn", "role", "text").agg(F.count("*").alias("copies"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Segments of each pair from two tables (pair_id, turn, role, text).

    Columns: pair_id, side (``prompt``, ``chosen``, ``rejected``), turn, role,
    copies (of a repeated row), segment (its rendering), loss (1 or 0).
    """
    both = _turns(chosen).withColumn("c", F.col("copies")).withColumn("r", F.lit(0).cast("long"))
    both = both.unionByName(_turns(rejected).withColumn("r", F.col("copies")).withColumn("c", F.lit(0).cast("long")))
    turns = both.groupBy("pair_id", "turn", "role", "text").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    # A turn that either side has more often than the other ends the common prefix.
    ends = turns.filter(F.col("c") != F.col("r")).groupBy("pair_id").agg(F.min("turn").alias("end"))
    placed = turns.join(ends, "pair_id", "left")
    common = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    sides = F.when(common, F.array(F.struct(F.lit("prompt").alias("side"), F.col("c").alias("copies")))).otherwise(
        F.array(F.struct(F.lit("chosen").alias("side"), F.col("c").alias("copies")), F.struct(F.lit("rejected").alias("side"), F.col("r").alias("copies")))
    )
    out = placed.select("pair_id", "turn", "role", "text", F.explode(sides).alias("s")).filter("s.copies > 0")
    loss = F.when((F.col("s.side") != "prompt") & (F.col("role") == "assistant"), 1).otherwise(0)
    return out.select("pair_id", F.col("s.side").alias("side"), "turn", "role", F.col("s.copies").alias("copies"), F.repeat(rendered(F.col("role"), F.col("text")), F.col("s.copies").cast("int")).alias("segment"), loss.cast("int").alias("loss"))


def as_records(segments: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen and rejected, with a mask of (characters, loss) per completion."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "segment", "loss")))
    sides = segments.groupBy("pair_id", "side").agg(parts.alias("parts"))
    joined = sides.select("pair_id", "side", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("text"), F.transform("parts", lambda p: F.struct(F.length(p["segment"]).alias("n_chars"), p["loss"].alias("loss"))).alias("mask"))
    pick = lambda side, what: F.max(F.when(F.col("side") == side, F.col(what)))
    return joined.groupBy("pair_id").agg(
        F.coalesce(pick("prompt", "text"), F.lit("")).alias("prompt"),
        F.coalesce(pick("chosen", "text"), F.lit("")).alias("chosen"),
        pick("chosen", "mask").alias("chosen_mask"),
        F.coalesce(pick("rejected", "text"), F.lit("")).alias("rejected"),
        pick("rejected", "mask").alias("rejected_mask"),
    )


def derived_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations, the conversation being the pair.

    The chosen side is the conversation.  The rejected side has the same turns
    up to its last assistant turn, which is replaced by the assistant turn of the
    same position in the partner conversation (ids 2p and 2p + 1 are partners),
    or by an empty answer where the partner has none.  Conversations without an
    assistant turn have equal sides.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = turns.filter(F.col("role") == "assistant").groupBy("pair_id").agg(F.max("turn").alias("last"))
    answers = turns.filter(F.col("role") == "assistant").groupBy(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("turn").alias("last")).agg(F.min("text").alias("other"))
    swapped = last.join(answers, ["pair_id", "last"], "left").select("pair_id", F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.coalesce("other", F.lit("")).alias("text"))
    before = turns.join(last, "pair_id", "left").filter(F.col("last").isNull() | (F.col("turn") < F.col("last"))).select("pair_id", "turn", "role", "text")
    return turns, before.unionByName(swapped)
