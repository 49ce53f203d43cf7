"""Range joins through grid buckets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.operators.sizing import BROADCAST_ROWS, HOT_ROWS, SALTS, broadcast_if_small, dealt, fits_broadcast
from formloom.session import kept


def _cells(start: Column, extent: Column, bucket: int) -> Column:
    """Bucket numbers touched by the half-open span [start, start + extent)."""
    first = F.floor(start / bucket)
    last = F.floor((start + F.greatest(extent, F.lit(1)) - 1) / bucket)
    return F.explode(F.sequence(first, last))


def bucketed(rects: DataFrame, bucket: int, reach: int = 0) -> DataFrame:
    """One row per rect and grid bucket (columns ``bx``, ``by``) it touches, moved up or down by ``reach`` at most."""
    return rects.withColumn("bx", _cells(F.col("x"), F.col("w"), bucket)).withColumn(
        "by", _cells(F.col("y") - reach, F.col("h") + 2 * reach, bucket)
    )


def first_hit(
    points: DataFrame,
    rects: DataFrame,
    keys: Sequence[str],
    payload: Sequence[str],
    priority: str = "priority",
    bucket: int = 128,
    out: str = "hit",
    also: tuple[str, Callable[[Column], Column]] | None = None,
    broadcast_rows: int | None = None,
    known_rows: int | None = None,
    salts: int = SALTS,
    hot_rows: int = HOT_ROWS,
    moved: tuple[int, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Attach to every point the containing rect of lowest ``priority`` (or NULL).

    ``also`` names a second column and a test: it receives the best containing
    rect among those that pass the test, from the same look-up.

    ``points`` has ``x``, ``y``; ``rects`` has ``x, y, w, h``. The bucket only
    decides who is compared, never the result. ``known_rows`` is an upper bound
    on the (rect, bucket) rows, if the caller has measured one.

    ``moved`` is for rects that each point sees at places of its own: how far
    they may lie above or below, at most, and the move of a candidate for the
    point's row. The rects stay in one index; a point is moved back instead.

    Each bucket is one row holding its candidates in priority order, so a point
    meets at most one row: equal points stay as many as they were, and nothing
    is grouped afterwards. If the rect table is small enough the join is a
    broadcast look-up without a shuffle. Otherwise both sides meet in an
    equi-join on (keys, bucket); points of buckets with more than ``hot_rows``
    of them are spread over ``salts`` tasks, and only those buckets are copied.
    """
    keys = list(keys)
    fields = ["x", "y", "w", "h", *payload]
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    cell = [*keys, "bx", "by"]
    spots = points.withColumn("bx", F.floor(F.col("x") / bucket)).withColumn(
        "by", F.floor(F.col("y") / bucket)
    )
    reach, move = moved or (0, lambda c: F.lit(0))
    cells = bucketed(rects.select(*keys, priority, *fields), bucket, reach)
    index = cells.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct(priority, *fields))).alias("_cand"))
    if (known_rows is not None and known_rows <= limit) or fits_broadcast(cells, limit):
        joined = spots.join(F.broadcast(index), cell, "left")
    else:
        heavy = spots.groupBy(*cell).count().filter(F.col("count") > hot_rows)
        heavy = broadcast_if_small(heavy.select(*cell, F.lit(True).alias("_hot")))
        spread = F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int")
        copies = F.sequence(F.lit(0), F.when(F.col("_hot"), salts - 1).otherwise(0))
        spots = spots.join(heavy, cell, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0)))
        index = index.join(heavy, cell, "left").withColumn("_salt", F.explode(copies))
        joined = spots.drop("_hot").join(index.drop("_hot"), [*cell, "_salt"], "left").drop("_salt")
    px, py = F.col("x"), F.col("y")
    found = F.filter(
        "_cand",
        lambda c: (px >= c["x"]) & (px < c["x"] + c["w"]) & (py - move(c) >= c["y"]) & (py - move(c) < c["y"] + c["h"]),
    )
    joined = joined.withColumn("_cand", found).withColumn(out, F.get("_cand", F.lit(0)))
    if also:
        joined = joined.withColumn(also[0], F.get(F.filter("_cand", also[1]), F.lit(0)))
    return joined.drop("_cand", "bx", "by")


def overlapping_pairs(
    rects: DataFrame,
    keys: Sequence[str],
    ident: str,
    payload: Sequence[str],
    bucket: int = 128,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    right: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Pairs of overlapping rects (positive area) with the same ``keys``.

    Output columns are ``keys``, ``a`` and ``b`` (structs of ``ident``, the
    rect and ``payload``). A self join yields each pair once with
    ``a.ident < b.ident``; with ``right`` given, all overlapping (left, right)
    pairs. Only rects that share a grid bucket are compared, and a pair is
    emitted by the one bucket that holds the corner of its intersection, so no
    distinct is needed. Buckets above ``hot_rows`` rows are split by salt; they
    are looked for in keys with that many rows only. Beyond the broadcast limit
    both sides are sorted: their files are far smaller than their rows, so Spark
    must not choose by the size of files.
    """
    keys = list(keys)
    self_join = right is None
    body = F.struct(ident, "x", "y", "w", "h", *payload)
    cell = [*keys, "bx", "by"]
    # written once: both sides, the size and the hot buckets read it from there
    left = kept(bucketed(rects, bucket).select(*cell, body.alias("a")))
    other = left if self_join else kept(bucketed(right, bucket).select(*cell, body.alias("a")))
    right_cells = other.withColumnRenamed("a", "b")
    if fits_broadcast(other, broadcast_rows):
        joined = left.join(F.broadcast(right_cells), cell)
    else:
        full = broadcast_if_small(left.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys))
        heavy = left.join(full, keys, "left_semi").groupBy(*cell).count().filter(F.col("count") > hot_rows)
        heavy = broadcast_if_small(kept(heavy.select(*cell, F.lit(True).alias("_hot"))))
        spread = F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int")
        left_cells = left.join(heavy, cell, "left").withColumn(
            "_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))
        ).drop("_hot")
        right_cells = right_cells.join(heavy, cell, "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), salts - 1).otherwise(0)))
        ).drop("_hot")
        on, rows = [*cell, "_salt"], left.count() + other.count()
        joined = dealt(left_cells, on, rows).hint("merge").join(dealt(right_cells, on, rows), on)
    a, b = F.col("a"), F.col("b")
    x0, y0 = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    keep = (
        (a["x"] < b["x"] + b["w"])
        & (b["x"] < a["x"] + a["w"])
        & (a["y"] < b["y"] + b["h"])
        & (b["y"] < a["y"] + a["h"])
        & (F.col("bx") == F.floor(x0 / bucket))
        & (F.col("by") == F.floor(y0 / bucket))
    )
    if self_join:
        keep = keep & (a[ident] < b[ident])
    return joined.filter(keep).select(*keys, "a", "b")
