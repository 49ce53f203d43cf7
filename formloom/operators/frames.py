"""Cell candidates of pages around what their template excludes (D21 with exclusions, faces and existing cells)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.operators.runs import (
    MIN_RECT, OUTLINE, Frames, assign_face, closed_cells, cluster_rails, grid_components, overlaps_existing, rail_table, scaled, wall_flags,
)
from formloom.operators.sizing import broadcast_if_small
from formloom.session import kept
from formloom.sources.templates import BASE_DPI, TemplateTables


def page_exclusions(pages: DataFrame, tables: TemplateTables) -> DataFrame:
    """Excluded rects of pages (page_id, template_id), in coordinates of the page: one array per page, maybe empty."""
    at = F.col("source")
    moved = F.transform("exclusions", lambda r: F.struct(
        (r["x"] + at["x"]).alias("x"), (r["y"] + at["y"]).alias("y"), r["w"].alias("w"), r["h"].alias("h")
    ))
    boxes = tables.faces.groupBy("template_id").agg(F.flatten(F.collect_list(moved)).alias("boxes"))
    return pages.select("page_id", "template_id").join(tables.small(boxes), "template_id", "left").select("page_id", "boxes")


def masked_runs(runs: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Runs (page_id, axis, scan, s, e) without the pixels of excluded rects.

    ``exclusions`` (page_id, boxes) has one row per page, as from :func:`page_exclusions`; pages that aren't in it stay
    whole. A run is swept once along the boxes on its scan line, in order of their start, so boxes may overlap; what is left
    comes out as runs again. Other columns are carried along. No run meets another run, so nothing is sorted or grouped.
    """
    flat = F.col("axis") == "h"

    def along(b: Column, scan_at: str, scan_len: str) -> Column:
        return (F.col("scan") >= b[scan_at]) & (F.col("scan") < b[scan_at] + b[scan_len])

    met = F.filter(F.coalesce("boxes", F.expr("CAST(array() AS ARRAY<STRUCT<x: INT, y: INT, w: INT, h: INT>>)")), lambda b: F.when(
        flat, along(b, "y", "h")).otherwise(along(b, "x", "w")))
    spans = F.array_sort(F.transform(met, lambda b: F.struct(
        F.when(flat, b["x"]).otherwise(b["y"]).cast("long").alias("lo"),
        F.when(flat, b["x"] + b["w"]).otherwise(b["y"] + b["h"]).cast("long").alias("hi"),
    )))
    start, end = F.col("s").cast("long"), F.col("e").cast("long")
    piece = "ARRAY<STRUCT<s: BIGINT, e: BIGINT>>"

    def step(state: Column, span: Column) -> Column:
        left = F.struct(state["at"].alias("s"), F.least(span["lo"] - 1, end).alias("e"))
        out = F.when((span["lo"] > state["at"]) & (state["at"] <= end), F.concat(state["out"], F.array(left))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["hi"]).alias("at"), out.alias("out"))

    swept = F.aggregate(spans, F.struct(start.alias("at"), F.expr(f"CAST(array() AS {piece})").alias("out")), step)
    rest = F.struct(F.col("_w.at").alias("s"), end.alias("e"))
    pieces = F.when(F.col("_w.at") <= end, F.concat(F.col("_w.out"), F.array(rest))).otherwise(F.col("_w.out"))
    others = [c for c in runs.columns if c not in ("s", "e")]
    return (
        runs.join(broadcast_if_small(exclusions), "page_id", "left").withColumn("_w", swept)
        .select(*others, F.explode(pieces).alias("_p")).select(*others, "_p.s", "_p.e")
    )


def page_frames(segments: DataFrame, pages: DataFrame, tables: TemplateTables, dpi: int = BASE_DPI, max_rails: int | None = None) -> Frames:
    """Cell candidates with their face, and for every page how many were left out and why.

    ``pages`` (page_id, template_id, page_w, page_h) has one row per page; those without a line are in the ledger too. A
    candidate that holds its centre in one face but leaves it straddles; one outside all faces has no face. A page
    without a template takes part like one without faces. ``overlaps`` tells candidates on a cell that the template has.

    The ledgers close: components = rects + non_rectangular + not_closed, and
    rects = cells + page_outline + too_small + straddles_face. ``zero_reason`` says why a page has no candidates: no_lines,
    too_many_lines, no_rect or all_filtered.
    """
    railed = cluster_rails(segments, dpi)
    parts = kept(grid_components(wall_flags(railed, max_rails)))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    small = scaled(MIN_RECT, dpi)
    sized = closed_cells(parts, railed).join(pages, "page_id").withColumn(
        "reason",
        F.when((w >= F.col("page_w") * OUTLINE) & (h >= F.col("page_h") * OUTLINE), "page_outline").when((w < small) | (h < small), "too_small").otherwise("cell"),
    )
    rects = sized.select(
        "page_id", "template_id", "y1", "x1", "y2", "x2", "residual", "reason",
        *[F.bround(c).cast("int").alias(n) for n, c in (("x", F.col("x1")), ("y", F.col("y1")), ("w", w), ("h", h))],
    )
    straddles = (F.col("reason") == "cell") & F.coalesce(F.col("face") == "straddle", F.lit(False))
    faced = kept(
        overlaps_existing(assign_face(rects, tables), tables, "page_id").withColumn("reason", F.when(straddles, "straddles_face").otherwise(F.col("reason")))
    )
    cells = faced.filter(F.col("reason") == "cell").select("page_id", "y1", "x1", "y2", "x2", "residual", "face", "overlaps")

    def counts(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
        return df.groupBy("page_id").agg(*[F.count_if(F.col(column) == value).alias(name) for value, name in names.items()])

    out = ["page_outline", "too_small", "straddles_face"]
    ledgers = [
        counts(segments, "axis", {"h": "lines_h", "v": "lines_v"}), counts(rail_table(railed), "axis", {"h": "rails_h", "v": "rails_v"}),
        counts(parts, "kind", {"rect": "rects", "non_rectangular": "non_rectangular", "not_closed": "not_closed"}),
        counts(faced, "reason", {"cell": "cells"} | {n: n for n in out}),
    ]
    joined = pages.select("page_id")
    for each in ledgers:
        joined = joined.join(each, "page_id", "left")
    names = ["lines_h", "lines_v", "rails_h", "rails_v", "rects", "non_rectangular", "not_closed", "cells", *out]
    zero = F.lit(0).cast("long")
    ledger = joined.select("page_id", *[F.coalesce(n, zero).alias(n) for n in names])
    ledger = ledger.withColumn("components", F.col("rects") + F.col("non_rectangular") + F.col("not_closed"))
    crowded = F.lit(False) if max_rails is None else F.greatest("rails_h", "rails_v") > max_rails
    why = (
        F.when(F.col("lines_h") + F.col("lines_v") == 0, "no_lines").when(crowded, "too_many_lines")
        .when(F.col("rects") == 0, "no_rect").when(F.col("cells") == 0, "all_filtered")
    )
    return Frames(cells, ledger.withColumn("zero_reason", why))
