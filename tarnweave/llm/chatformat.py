"""Chat formatting: every dialogue from the perspective of each of its speakers.

Only DataFrame functions are used. For every participant of a dialogue it is
rendered with that speaker as the assistant, all others as users with their names,
and system turns as they are. The mask says which characters are the assistant's
own: the text of its turns and the marker that ends them.

Turns are numbered within their dialogue in the order of turn number, role and
text. A long dialogue is rendered in segments of ``segment_turns`` turns, one row
each, and each later segment begins with the dialogue's first system turn again.
Numbers come from ranges of the sorted table and the ranges' sizes, so no row or
task holds a whole dialogue of any length, whatever its turn numbers are;
``segment_turns=None`` renders each dialogue whole.

Defined cases: a null text is empty; a null or empty role is the speaker
``unknown``; a null turn number comes first; repeated rows are said again; a
dialogue of only system turns has no participant and no row; a null dialogue id is a
dialogue; an empty table gives an empty result; other columns are ignored, and a
dialogue column named like one of the result keeps its name with underscores before
the result's. Control markers within a text or a role are broken up by a space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.llm._names import fresh
from tarnweave.session import broadcast_if_small, settle

#: Fixed values of the chat markup.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
SEGMENT_TURNS = 256


def head_of(role: Column, perspective: Column) -> Column:
    """What stands before a turn's text."""
    name = F.when(role == SYSTEM, F.lit("system")).when(role == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(OPEN), name, F.lit("\n"))


def numbered(said: DataFrame) -> DataFrame:
    """``said`` with each turn's number ``k`` in its dialogue, from 0.

    Rows are dealt out by ranges of their order; a range's numbers go on from
    the sizes of the ranges before it, so a dialogue of many turns is spread.
    """
    order = ("turn", "role", "text", "place")
    said = settle(said.withColumn("place", F.monotonically_increasing_id()), "chat-turns")
    said = settle(said.repartitionByRange("conv", *order).withColumn("range", F.spark_partition_id()), "chat-ranges")
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = said.groupBy("conv", "range").agg(F.count("*").alias("n"))
    sizes = settle(sizes.select(F.col("conv").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "chat-sizes")
    own = F.row_number().over(Window.partitionBy("conv", "range").orderBy(*order))
    rows = said.withColumn("own_k", own).join(broadcast_if_small(sizes), said["conv"].eqNullSafe(sizes["of"]) & (said["range"] == sizes["at"]))
    return rows.select("conv", "role", "text", (F.col("own_k") + F.col("before") - 1).cast("long").alias("k"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment_turns: int | None = SEGMENT_TURNS) -> DataFrame:
    """(conv, perspective, segment, n_turns, n_own, rendered, mask): mask has (start, stop) of the perspective's own characters."""
    plain = lambda c: F.replace(c, F.lit("<|im_"), F.lit("<| im_"))
    said = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.when(F.trim(role) != "", plain(F.regexp_replace(F.trim(role), r"[\r\n]", " "))).otherwise("unknown").alias("role"),
        plain(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"),
    )
    said = settle(numbered(said), "chat-numbered")
    who = settle(said.where(F.col("role") != SYSTEM).select(F.col("conv").alias("of"), F.col("role").alias("perspective")).distinct(), "chat-speakers")
    segment = F.floor(F.col("k") / segment_turns) if segment_turns else F.lit(0).cast("long")
    pairs = said.join(broadcast_if_small(who), said["conv"].eqNullSafe(who["of"])).select("conv", "perspective", segment.alias("segment"), "k", "role", "text")
    if segment_turns:
        system = said.where((F.col("role") == SYSTEM)).groupBy("conv").agg(F.min_by("text", "k").alias("text"))
        system = settle(system.withColumnRenamed("conv", "with"), "chat-systems")
        later = pairs.where("segment > 0").select("conv", "perspective", "segment").distinct()
        later = later.join(broadcast_if_small(system), later["conv"].eqNullSafe(system["with"]))
        pairs = pairs.union(later.select("conv", "perspective", "segment", F.lit(-1).cast("long"), F.lit(SYSTEM), "text"))
    rows = pairs.withColumn("head", head_of(F.col("role"), F.col("perspective"))).withColumn("own", F.col("role") == F.col("perspective"))
    size = F.length("head") + F.length("text") + len(CLOSE) + 1
    before = Window.partitionBy("conv", "perspective", "segment").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    rows = rows.groupBy("conv", "perspective", "segment").agg(F.array_sort(F.collect_list(F.struct("k", "head", "text", "start", "own"))).alias("pieces"))
    rendered = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE + "\n"))), "")
    own = F.filter("pieces", lambda p: p["own"])
    mask = F.transform(own, lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.length(p["text"]) + len(CLOSE)).alias("stop")))
    given = F.size(F.filter("pieces", lambda p: p["k"] >= 0))
    made = {"perspective": F.col("perspective"), "segment": F.col("segment"), "n_turns": given.cast("long"), "n_own": F.size(own).cast("long"), "rendered": rendered, "mask": mask}
    return rows.select(F.col("conv").alias(conv), *(value.alias(fresh(name, [conv])) for name, value in made.items()))
