"""Gate for moved table blocks (C18, D15): which faces may follow their own lines, and how pages are counted.

Two fields of a face can only come to overlap by a move if their blocks move by different amounts, and whether they do
depends on the difference alone. So the pairs of a template become, once, intervals of differences at which a pair that
was apart overlaps; a page stabs these with the moves of its few blocks. No rect is moved and no rect of a page is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.operators.ranges import overlapping_pairs
from formloom.operators.sizing import broadcast_if_small

#: Reasons of a face that are counted for its page, the first one that holds on any face.
COUNTED = (("excluded", ("excluded",)), ("failsafe", ("failsafe", "overlap")))
#: Stands for fields of no block, which never move.
FIXED = -1


def overlap_index(rects: DataFrame, reach: int) -> DataFrame:
    """(template_id, face_id, a_block, b_block, lo, hi, n): ``n`` pairs of fields that are apart and overlap once block a
    moves by more than ``lo`` and less than ``hi`` further down than block b; a_block < b_block.

    ``rects`` has template_id, face_id, block_idx (null for fields that stay), field_id and x, y, w, h. ``reach`` is the
    largest difference of two moves; pairs that need more are left out. Rects of one field never count.
    """
    keys = ["template_id", "face_id"]
    half = -(-reach // 2)
    grown = rects.select(
        *keys, F.coalesce("block_idx", F.lit(FIXED)).alias("block"), "field_id", "x", (F.col("y") - half).alias("y"), "w", (F.col("h") + 2 * half).alias("h"),
        F.format_string("%s/%d/%d", "field_id", "x", "y").alias("ident"),
    ).distinct()
    pairs = overlapping_pairs(grown, keys, "ident", ["block", "field_id"])
    swap = F.col("a.block") > F.col("b.block")
    pairs = pairs.filter((F.col("a.block") != F.col("b.block")) & (F.col("a.field_id") != F.col("b.field_id")))
    pairs = pairs.select(*keys, F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    a_y, b_y = F.col("a.y") + half, F.col("b.y") + half
    a_h, b_h = F.col("a.h") - 2 * half, F.col("b.h") - 2 * half
    spans = pairs.select(*keys, F.col("a.block").alias("a_block"), F.col("b.block").alias("b_block"), (b_y - a_y - a_h).alias("lo"), (b_y + b_h - a_y).alias("hi"))
    apart = (F.col("lo") >= 0) | (F.col("hi") <= 0)  # a difference of 0 lies inside for pairs that overlap as printed
    return spans.filter(apart & (F.col("lo") < reach) & (F.col("hi") > -reach)).groupBy(*keys, "a_block", "b_block", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def packed_index(index: DataFrame) -> DataFrame:
    """One row a face of a template; its array grows with the pairs near each other on one sheet."""
    entry = F.struct("a_block", "b_block", "lo", "hi", "n")
    return index.groupBy("template_id", "face_id").agg(F.sort_array(F.collect_list(entry)).alias("near"))


def new_pairs(moves: Column, near: Column) -> Column:
    """Pairs that overlap by the moves (map of block to dy; blocks that aren't in it stay)."""

    def by(block: Column) -> Column:
        return F.coalesce(F.try_element_at(moves, block), F.lit(0))

    def hit(e: Column) -> Column:
        apart = by(e["a_block"]) - by(e["b_block"])
        return (apart > e["lo"]) & (apart < e["hi"])

    return F.aggregate(F.filter(near, hit), F.lit(0).cast("long"), lambda n, e: n + e["n"])


def block_moves() -> Column:
    """Column ``blocks`` of a plan as a map of block to dy."""
    return F.map_from_arrays(F.transform("blocks", lambda b: b["block_idx"]), F.transform("blocks", lambda b: b["dy"].cast("int")))


def new_overlaps(plan: DataFrame, index: DataFrame) -> DataFrame:
    """(page_id, face_id, new_pairs) of faces on which the moves of ``plan`` make fields overlap that were apart."""
    moved = plan.filter("applied").join(broadcast_if_small(packed_index(index), 20_000), ["template_id", "face_id"])
    return moved.select("page_id", "face_id", new_pairs(block_moves(), F.col("near")).alias("new_pairs")).filter(F.col("new_pairs") > 0)


def snap_gate(faces: DataFrame, estimates: DataFrame, plan: DataFrame, index: DataFrame, enabled: bool = True) -> DataFrame:
    """One row per (page, face) of ``estimates`` with reason, applied, new_pairs, snap_px and blocks.

    ``faces`` has template_id, face_id and n_blocks; ``estimates`` page_id, template_id, face_id and reason ('' when the
    face was placed); ``plan`` is that of ``snap_plan`` and ``index`` that of ``overlap_index``. Reasons in order:
    disabled, no_estimate, no_blocks, excluded, failsafe, overlap; '' for faces that move. ``snap_px`` is the largest
    move of a face that moves. With ``enabled`` off nothing else is looked at.
    """
    keys = ["page_id", "template_id", "face_id"]
    if not enabled:
        return estimates.select(
            *keys, F.lit("disabled").alias("reason"), F.lit(False).alias("applied"), F.lit(0).cast("long").alias("new_pairs"),
            F.lit(None).cast("long").alias("snap_px"),
        )
    planned = estimates.select(*keys, (F.col("reason") == "").alias("placed")).join(plan.select(*keys, "outcome", "blocks"), keys, "left")
    known = planned.join(broadcast_if_small(faces.select("template_id", "face_id", "n_blocks")), ["template_id", "face_id"], "left")
    known = known.join(broadcast_if_small(packed_index(index), 20_000), ["template_id", "face_id"], "left")
    found = known.withColumn("new_pairs", F.when(F.col("outcome") == "none", F.coalesce(new_pairs(block_moves(), F.col("near")), F.lit(0))).otherwise(F.lit(0)).cast("long"))
    no_blocks = F.coalesce(F.col("n_blocks"), F.lit(0)) == 0
    reason = (
        F.when(~F.col("placed"), "no_estimate").when(no_blocks, "no_blocks").when(F.col("outcome").isNull(), "no_estimate")
        .when(F.col("outcome") != "none", F.col("outcome")).when(F.col("new_pairs") > 0, "overlap").otherwise("")
    )
    gated = found.withColumn("reason", reason)
    largest = F.array_max(F.transform("blocks", lambda b: F.abs(b["dy"]))).cast("long")
    return gated.select(*keys, "reason", (F.col("reason") == "").alias("applied"), "new_pairs", F.when(F.col("reason") == "", largest).alias("snap_px"))


def snap_counters(gated: DataFrame) -> DataFrame:
    """(page_id, counted): excluded before failsafe before none; a page is counted once."""
    flags = gated.groupBy("page_id").agg(*[F.max(F.col("reason").isin(*reasons)).alias(name) for name, reasons in COUNTED])
    return flags.select("page_id", F.when(F.col("excluded"), "excluded").when(F.col("failsafe"), "failsafe").otherwise("none").alias("counted"))
