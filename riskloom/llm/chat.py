"""Chat formatting by rotating the perspective over all participants of a dialogue.

For each participant the dialogue is rendered once with that speaker as ``assistant`` and every other speaker as a user
with their own name; only the assistant's words are to be learnt, so the mask holds their spans (from, to; code points of
the rendered text, end marker included). A turn is ``<|assistant|>\\n`` or ``<|user:NAME|>\\n``, the text and
``<|end|>\\n``.

A dialogue may be very long, so it is never gathered: turns are numbered by prefix sums over range partitions, and
rendered perspectives come in parts of ``part_turns`` consecutive turns. Parts in order make the whole rendering; mask
spans and offsets count from the start of the whole rendering.

Defined results: a null speaker is the participant ``unknown``; a null text is empty; turns are ordered by turn (null
last), speaker, text; repeated rows are repeated turns; a null dialogue id is one more dialogue; line breaks and ``|`` in
a speaker's name become ``_``; dialogues without rows do not exist; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialise

PART_TURNS = 256


def numbered(turns: DataFrame) -> DataFrame:
    """One row per turn with its place in the dialogue, and characters before it, for turn headers of no length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.regexp_replace(F.coalesce(F.col("role"), F.lit("unknown")), r"[|\s]", "_")
    rows = turns.select("conv_id", "turn", name.alias("speaker"), text.alias("body"))
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("body")]
    ranged = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    length = F.length("body") + F.length(F.lit("<||>\n<|end|>\n"))
    user = F.length(F.concat(F.lit("user:"), F.col("speaker")))
    local = Window.partitionBy("part", "conv_id").orderBy(*order[1:])
    so_far = local.rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.select(
        "conv_id", "turn", "speaker", "body", "part", (F.row_number().over(local) - 1).alias("nth"),
        F.coalesce(F.sum(length + user).over(so_far), F.lit(0)).alias("chars"),
    )
    # of each (partition, dialogue) and (partition, dialogue, speaker): totals, then sums of earlier partitions
    totals = ranged.groupBy("part", "conv_id").agg(F.count("*").alias("n"), F.sum(length + user).alias("c"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("part").alias("p"), F.col("conv_id").alias("v"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"))
    same = (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("v"))
    return inside.join(offsets, same).select("conv_id", "turn", "speaker", "body", "part", (F.col("nth") + F.col("n0")).alias("place"), (F.col("chars") + F.col("c0")).alias("start"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, perspective, part, n_turns, rendered, mask): a row per perspective and part of a dialogue."""
    rows = materialise(numbered(turns), "numbered")
    block = F.floor(F.col("place") / part_turns).cast("long")
    blocks = rows.groupBy("conv_id", block.alias("block"), "speaker").agg(F.count("*").alias("own"))
    # a row per perspective and block, with the perspective's own turns before it: each is shorter or longer by a constant
    speakers = blocks.select(F.col("conv_id").alias("v"), F.col("speaker").alias("perspective")).distinct()
    grid = blocks.select("conv_id", "block").distinct().join(speakers, F.col("conv_id").eqNullSafe(F.col("v"))).drop("v")
    own = blocks.select(F.col("conv_id").alias("v"), F.col("block").alias("b"), F.col("speaker").alias("s"), "own")
    here = F.col("conv_id").eqNullSafe(F.col("v")) & (F.col("block") == F.col("b")) & (F.col("perspective") == F.col("s"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.coalesce("own", F.lit(0))).over(earlier), F.lit(0))
    grid = grid.join(own, here, "left").select(F.col("conv_id").alias("v"), F.col("block").alias("b"), "perspective", before.alias("before"))

    parts = rows.groupBy("conv_id", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", "speaker", "body"))).alias("turns"), F.min("start").alias("start")
    )
    each = grid.join(parts, F.col("conv_id").eqNullSafe(F.col("v")) & (F.col("block") == F.col("b")))
    shift = F.length(F.lit("assistant")) - F.length(F.concat(F.lit("user:"), F.col("perspective")))
    each = each.select("conv_id", "perspective", "block", "turns", (F.col("start") + F.col("before") * shift).alias("offset"))
    piece = "concat(if(t.speaker = perspective, '<|assistant|>\\n', concat('<|user:', t.speaker, '|>\\n')), t.body, '<|end|>\\n')"
    each = each.withColumn("pieces", F.expr(f"transform(turns, t -> {piece})"))
    spans = F.expr(
        "aggregate(arrays_zip(turns, pieces), struct(offset as at, cast(array() as array<struct<from: bigint, to: bigint>>) as spans), "
        "(a, x) -> struct(a.at + length(x.pieces) as at, if(x.turns.speaker = perspective, "
        "concat(a.spans, array(struct(a.at + length('<|assistant|>\\n') as `from`, a.at + length(x.pieces) - 1 as `to`))), a.spans) as spans)).spans"
    )
    return each.select("conv_id", "perspective", F.col("block").alias("part"), F.size("turns").alias("n_turns"), F.col("offset").alias("starts_at"), F.concat_ws("", "pieces").alias("rendered"), spans.alias("mask"))
