"""Checks over templates, or over any table of rects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.operators.ranges import overlapping_pairs
from formloom.operators.sizing import dealt
from formloom.session import kept
from formloom.sources.templates import BASE_DPI, TemplateTables, column_names, receptors

MARK_MARGIN = 4
# Fixed values of the carving rule, px at 300 dpi and per cent of the area.
BAND_MIN = 6
MAIN_MIN_W, MAIN_MIN_H = 27, 36
CARVE_AUTO, CARVE_WARN = 10, 30


def receptor_overlaps(places: DataFrame, keys: list[str], ident: str = "ident") -> DataFrame:
    """Overlapping receptors of different fields, and a fallback over its own region.

    ``places``: keys, ident, field_id, kind (region or fallback) and a rect.
    """
    pairs = overlapping_pairs(places, keys, ident, ["field_id", "kind"], bucket=512)
    a, b = F.col("a"), F.col("b")
    same = a["field_id"] == b["field_id"]
    kinds = (
        F.when(same, "own_fallback")
        .when((a["kind"] == "region") & (b["kind"] == "region"), "regions")
        .when((a["kind"] == "fallback") & (b["kind"] == "fallback"), "fallbacks")
        .otherwise("fallback_region")
    )
    return pairs.filter(~same | (a["kind"] != b["kind"])).select(
        *keys, a["field_id"].alias("field_a"), b["field_id"].alias("field_b"),
        a[ident].alias("ident_a"), b[ident].alias("ident_b"), kinds.alias("problem"),
    )


def face_overlaps(tables: TemplateTables) -> DataFrame:
    """Faces of a template that overlap."""
    faces = tables.faces.select(
        "template_id", "face_ord", "face_id",
        F.col("source.x").alias("x"), F.col("source.y").alias("y"),
        F.col("source.w").alias("w"), F.col("source.h").alias("h"),
    )
    return overlapping_pairs(faces, ["template_id"], "face_ord", ["face_id"], bucket=1024).select(
        "template_id", F.col("a.face_id").alias("face_a"), F.col("b.face_id").alias("face_b")
    )


def adjacent_gaps(places: DataFrame, keys: list[str], ident: str = "ident") -> DataFrame:
    """Horizontal gaps between neighbouring receptors of different fields.

    b is right of a, their y ranges overlap, the gap is at least one pixel and
    nothing reaches into the gap within the shared band.

    A sweep instead of pairs: the y edges of a face cut it into strips. Inside
    one strip every receptor is compared with the next start to its right only
    (and with the furthest end so far, which tells whether the gap is really
    empty). A pair counts when it is adjacent on its whole shared band, so its
    strip heights are summed and compared with the band. Rows: strips x
    receptors, linear in the number of true neighbours. The receptors of the
    strips are written once; all joins sort, as exploded rows are many times
    what Spark expects of their source.
    """
    edges = places.select(
        *keys, F.explode(F.array(F.col("y"), F.col("y") + F.col("h"))).alias("y0")
    ).distinct()
    ahead = Window.partitionBy(*keys).orderBy("y0")
    strips = edges.withColumn("y1", F.lead("y0").over(ahead)).filter(F.col("y1").isNotNull())
    # strips as rects of full width: the receptors in a strip are a range join on y
    bucket = 256
    strip_cells = strips.withColumn(
        "by", F.explode(F.sequence(F.floor(F.col("y0") / bucket), F.floor((F.col("y1") - 1) / bucket)))
    )
    place_cells = places.filter((F.col("w") > 0) & (F.col("h") > 0)).withColumn(
        "by", F.explode(F.sequence(F.floor(F.col("y") / bucket), F.floor((F.col("y") + F.col("h") - 1) / bucket)))
    )
    inside = kept(
        place_cells.hint("merge").join(strip_cells, [*keys, "by"])
        .filter((F.col("y") <= F.col("y0")) & (F.col("y") + F.col("h") >= F.col("y1")))
        .filter(F.col("by") == F.floor(F.col("y0") / bucket))
    )
    rows = inside.count()
    row = Window.partitionBy(*keys, "y0").orderBy("x", ident)
    right_of = F.col("x") + F.col("w")
    # receptors whose right end is the furthest so far face the next start
    swept = (
        dealt(inside, [*keys, "y0"], rows).withColumn("end", right_of)
        .withColumn("reach", F.max("end").over(row.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next_x", F.lead("x").over(row))
    )
    gaps = swept.filter(F.col("next_x") > F.col("reach")).select(
        *keys, "y0", "y1", F.col("reach").alias("left_end"), F.col("next_x").alias("right_start")
    )
    body = F.struct(ident, "field_id", "x", "y", "w", "h")
    lefts = inside.withColumn("left_end", right_of).select(*keys, "y0", "left_end", body.alias("a"))
    rights = inside.withColumn("right_start", F.col("x")).select(*keys, "y0", "right_start", body.alias("b"))
    at_left, at_right = [*keys, "y0", "left_end"], [*keys, "y0", "right_start"]
    touching = dealt(gaps, at_left, rows).hint("merge").join(dealt(lefts, at_left, rows), at_left)
    touching = dealt(touching, at_right, rows).hint("merge").join(dealt(rights, at_right, rows), at_right)
    a, b = F.col("a"), F.col("b")
    band = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return (
        touching.groupBy(*keys, "a", "b")
        .agg(F.sum(F.col("y1") - F.col("y0")).alias("shared"))
        .filter((F.col("shared") == band) & (a["field_id"] != b["field_id"]))
        .select(
            *keys, a[ident].alias("ident_a"), b[ident].alias("ident_b"),
            a["field_id"].alias("field_a"), b["field_id"].alias("field_b"),
            (b["x"] - a["x"] - a["w"]).alias("gap"),
        )
    )


def hole_boxes(places: DataFrame, keys: list[str]) -> DataFrame:
    """The bounding box of every field with two or more region rects."""
    return (
        places.filter(F.col("kind") == "region")
        .groupBy(*keys, "field_id")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("x"), F.min("y").alias("y"),
            F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"),
        )
        .filter(F.col("n") >= 2)
        .select(*keys, "field_id", "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"))
    )


def hole_overlaps(places: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping holes; where they overlap the definition order decides."""
    return overlapping_pairs(hole_boxes(places, keys), keys, "field_id", [], bucket=256).select(
        *keys, F.col("a.field_id").alias("field_a"), F.col("b.field_id").alias("field_b")
    )


def exclusion_coverage(places: DataFrame, exclusions: DataFrame, keys: list[str], ident: str = "ident") -> DataFrame:
    """How much of each receptor its face's exclusions cover.

    ``strong`` when all of it is covered, when a fallback is touched, or when
    the main rect of a field with a fallback is touched.
    """
    pairs = overlapping_pairs(places, keys, ident, ["field_id", "kind", "is_main", "has_fallback"],
                              right=exclusions.withColumnRenamed("excl", ident).select(
                                  *keys, ident, "x", "y", "w", "h",
                                  F.lit(None).cast("string").alias("field_id"),
                                  F.lit("exclusion").alias("kind"),
                                  F.lit(False).alias("is_main"), F.lit(False).alias("has_fallback")))
    # few bytes, many rows: counted first, so that they are added up in a bounded number per task
    pairs = kept(pairs.select(*keys, "a", "b"))
    pairs = dealt(pairs, keys, pairs.count())
    a, b = F.col("a"), F.col("b")
    shared = (F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])) * (
        F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    )
    area = a["w"] * a["h"]
    covered = F.least(F.sum(shared), F.first(area))
    return pairs.groupBy(*keys, a[ident].alias("ident"), a["field_id"].alias("field_id"), a["kind"].alias("kind")).agg(
        covered.alias("covered"), F.first(area).alias("area"), F.first(a["is_main"] & a["has_fallback"]).alias("_main")
    ).select(
        *keys, "ident", "field_id", "kind", "covered", (F.col("covered") / F.col("area")).alias("ratio"),
        ((F.col("covered") >= F.col("area")) | (F.col("kind") == "fallback") | F.col("_main")).alias("strong"),
    )


def out_of_face(tables: TemplateTables) -> DataFrame:
    """Receptors and marks that leave their face."""
    faces = tables.faces.select(
        "template_id", "face_id", F.col("source.w").alias("fw"), F.col("source.h").alias("fh")
    )
    places = receptors(tables.cells).filter(F.col("kind") != "hole").select(
        "template_id", "face_id", "field_id", "kind", "x", "y", "w", "h"
    )
    marks = tables.cells.select("template_id", "face_id", "field_id", F.explode("marks").alias("m")).select(
        "template_id", "face_id", "field_id", F.concat(F.lit("mark "), F.col("m.value")).alias("kind"), "m.rect.*"
    )
    return places.unionByName(marks).join(tables.small(faces), ["template_id", "face_id"]).filter(
        (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("fw")) | (F.col("y") + F.col("h") > F.col("fh"))
    ).select("template_id", "face_id", "field_id", "kind")


def stray_marks(tables: TemplateTables) -> DataFrame:
    """Choice marks that stick out of their cell by more than the margin."""
    r, m = F.col("rect"), F.col("m.rect")
    over = F.greatest(
        r["x"] - m["x"], r["y"] - m["y"], m["x"] + m["w"] - r["x"] - r["w"], m["y"] + m["h"] - r["y"] - r["h"]
    )
    margin = F.bround(F.lit(MARK_MARGIN) * F.col("dpi") / BASE_DPI)
    return (
        tables.cells.select("template_id", "field_id", "dpi", "rect", F.explode("marks").alias("m"))
        .withColumn("over", over)
        .filter(F.col("over") > margin)
        .select("template_id", "field_id", F.col("m.value").alias("mark"), "over")
    )


def _repeated(name: str) -> Column:
    """How many different names of a list come more than once; lists without any are not looked through."""
    names = F.col(name)
    later = F.filter(names, lambda x, i: F.array_position(names, x) != i + 1)
    return F.when(F.size(F.array_distinct(names)) == F.size(names), F.lit(0)).otherwise(F.size(F.array_distinct(later)))


def _measured(tables: TemplateTables) -> DataFrame:
    """Counts, columns and exclusions of each template, inside its document's row.

    Documents that share an id count as one template. They alone are looked at again, as only ids meet in a shuffle.
    """
    tally = [
        F.size("cells").alias("cells"), F.size(F.filter("cells", lambda c: c["normalize"] == "amount")).alias("amount_cells"),
        F.size(F.filter("cells", lambda c: ~c["output"])).alias("no_output_cells"),
    ]
    lists = tables.packed.select(
        "template_id", *tally, F.transform("cells", lambda c: c["field_id"]).alias("fields"), column_names(F.col("cells")).alias("names"), "exclusions"
    )
    counts = ["cells", "amount_cells", "no_output_cells"]

    def judged(df: DataFrame) -> DataFrame:
        return df.withColumn("columns_", F.transform("names", lambda n: n["column"])).select(
            "template_id", *[F.col(n).cast("long").alias(n) for n in counts],
            F.aggregate(F.transform("exclusions", lambda f: f["n"]), F.lit(0), lambda a, n: a + n).cast("long").alias("exclusions"),
            F.size("names").cast("long").alias("columns"), _repeated("fields").cast("long").alias("duplicate_fields"),
            _repeated("columns_").cast("long").alias("duplicate_columns"), F.col("columns_").alias("column_names"),
            F.col("exclusions").alias("exclusions_by_face"),
        )

    # documents without faces go after they were written, as the filter would else parse each document again
    each = kept(judged(lists)).filter(F.size("exclusions_by_face") > 0)
    shared = kept(each.groupBy("template_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("template_id"))
    if shared.isEmpty():
        return each
    place = F.transform("names", lambda n: F.struct(n["cell_ord"].alias("cell_ord"), n["part"].alias("part"), n["column"].alias("column")))
    merged = lists.join(shared, "template_id", "left_semi").withColumn("names", place).groupBy("template_id").agg(
        *[F.sum(n).alias(n) for n in counts], F.flatten(F.collect_list("fields")).alias("fields"),
        F.sort_array(F.flatten(F.collect_list("names"))).alias("names"), F.sort_array(F.flatten(F.collect_list("exclusions"))).alias("exclusions"),
    )
    return kept(each.join(shared, "template_id", "left_anti").unionByName(judged(merged)))


def template_profile(tables: TemplateTables) -> DataFrame:
    """Counts per template, and what would make it unusable; templates without fields count too."""
    return _measured(tables).select(
        "template_id", "cells", "columns", "amount_cells", "no_output_cells", "exclusions", "duplicate_fields", "duplicate_columns"
    ).withColumn("usable", (F.col("columns") > 0) & (F.col("duplicate_fields") == 0) & (F.col("duplicate_columns") == 0))


def template_check(tables: TemplateTables, expected: DataFrame, meta: int = 0) -> DataFrame:
    """What is said of a template that is verified: column names in order, exclusions of each face, and whether it passes.

    ``expected`` (template_id, expect_columns) gives the number of columns that a
    template must not fall below; templates that aren't in it need none.
    ``meta`` columns of each row come on top of those of the fields. Reasons:
    ``duplicates``, ``no_columns``, ``too_few_columns``, or ''.
    """
    found = _measured(tables)
    least = expected.groupBy("template_id").agg(F.max("expect_columns").alias("expect_columns"))
    # a row holds all names of its columns, so few of them make a task
    rows = 4 * found.count()
    known = dealt(found, ["template_id"], rows).join(dealt(least, ["template_id"], rows).hint("merge"), "template_id", "left")
    columns = F.col("columns") + meta
    reason = (
        F.when(F.col("duplicate_fields") + F.col("duplicate_columns") > 0, "duplicates").when(F.col("columns") == 0, "no_columns")
        .when(columns < F.col("expect_columns"), "too_few_columns").otherwise("")
    )
    return known.select(
        "template_id", "cells", columns.alias("columns"), "amount_cells", "no_output_cells", "exclusions",
        F.transform("exclusions_by_face", lambda f: F.struct(f["face_id"].alias("face_id"), f["n"].alias("n"))).alias("exclusions_by_face"),
        "column_names", reason.alias("reason"), (reason == "").alias("ok"),
    )


def template_regression(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts that went down between two profiles of the same templates."""
    names = ["cells", "amount_cells", "exclusions", "columns"]
    rows = F.array(*[
        F.struct(F.lit(n).alias("measure"), F.col(f"b.{n}").alias("was"), F.col(f"a.{n}").alias("now")) for n in names
    ])
    count = before.count()
    return (
        dealt(before, ["template_id"], count).alias("b").hint("merge").join(dealt(after, ["template_id"], count).alias("a"), "template_id")
        .select("template_id", F.explode(rows).alias("r"))
        .select("template_id", "r.measure", "r.was", "r.now")
        .filter(F.col("now") < F.col("was"))
    )


def disabled_runs(cells: DataFrame) -> DataFrame:
    """Vertical runs of cells without output per table column, cut at block borders."""
    # A table cell is named after its table, its row and its column, which may hold digits and dashes of its own.
    head = F.format_string("%s_%02d_", "table_id", "row_no")
    name = F.substr("field_id", F.length(head) + 1)
    off = cells.filter(F.col("table_id").isNotNull() & ~F.col("output")).select(
        "template_id", "table_id", "block_idx", "row_no", name.alias("column")
    )
    w = Window.partitionBy("template_id", "table_id", "block_idx", "column").orderBy("row_no")
    return (
        off.withColumn("_isle", F.col("row_no") - F.row_number().over(w))
        .groupBy("template_id", "table_id", "block_idx", "column", "_isle")
        .agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"))
        .drop("_isle")
    )


def _pieces(main: Column, cut: Column) -> list[tuple[Column, Column]]:
    """The whole of ``main`` and its bands above, below, left and right of ``cut``, each with whether it stays."""
    x0, y0 = F.greatest(main["x"], cut["x"]), F.greatest(main["y"], cut["y"])
    x1 = F.least(main["x"] + main["w"], cut["x"] + cut["w"])
    y1 = F.least(main["y"] + main["h"], cut["y"] + cut["h"])
    apart = (x1 <= x0) | (y1 <= y0)

    def band(x: Column, y: Column, w: Column, h: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))

    above, below = y0 - main["y"], main["y"] + main["h"] - y1
    left, right = x0 - main["x"], main["x"] + main["w"] - x1
    high = ~apart & (y1 - y0 >= BAND_MIN)
    return [
        (apart, band(main["x"], main["y"], main["w"], main["h"])),
        (~apart & (above >= BAND_MIN), band(main["x"], main["y"], main["w"], above)),
        (~apart & (below >= BAND_MIN), band(main["x"], y1, main["w"], below)),
        (high & (left >= BAND_MIN), band(main["x"], y0, left, y1 - y0)),
        (high & (right >= BAND_MIN), band(x1, y0, right, y1 - y0)),
    ]


def subtract_rect(main: Column, cut: Column) -> Column:
    """``main`` without ``cut`` as up to four bands (above, below, left, right).

    Bands above and below have the full width of ``main`` and need the least
    height only; those beside ``cut`` need it in both directions.
    """
    return F.filter(F.array(*[F.when(stays, piece) for stays, piece in _pieces(main, cut)]), lambda r: r.isNotNull())


def rest_of_rect(main: Column, cut: Column, place: Column | int = 0) -> Column:
    """What ``subtract_rect`` leaves, as a struct: number of pieces, their area, and the largest of them (the first on a tie).

    It has no lambda, so it compiles. ``place`` tells the rects of one field apart in their order.
    """
    pieces = _pieces(main, cut)
    n = reduce(add, [F.when(stays, 1).otherwise(0) for stays, _ in pieces])

    def area(r: Column) -> Column:
        return r["w"].cast("long") * r["h"]

    total = reduce(add, [F.when(stays, area(r)).otherwise(0) for stays, r in pieces])
    ranked = [
        F.when(stays, F.struct(area(r).alias("area"), (-(F.lit(place) if isinstance(place, int) else place)).alias("place"), F.lit(-i).alias("piece"), r.alias("r")))
        for i, (stays, r) in enumerate(pieces)
    ]
    return F.struct(n.alias("pieces"), total.alias("area"), F.greatest(*ranked).alias("main"))


def carve_verdict(rects: Column | Sequence[Column], cut: Column, kind: Column, split_y: Column | None = None) -> Column:
    """Whether ``cut`` may be taken out of a field: auto, warn or skip.

    All rects of the field are cut; the largest piece becomes the main rect
    (the first on a tie). Slivers that are dropped count as lost area. ``rects``
    is an array, or a list of columns where all fields have as many rects.
    """

    def area(r: Column) -> Column:
        return r["w"].cast("long") * r["h"]

    if isinstance(rects, Column):
        rests = F.transform(rects, lambda r, i: rest_of_rect(r, cut, i))
        first = F.get(rects, F.lit(0))

        def total(rs: Column, of) -> Column:
            return F.aggregate(F.transform(rs, of), F.lit(0).cast("long"), lambda a, b: a + b)

        n, left, whole = total(rests, lambda r: r["pieces"].cast("long")), total(rests, lambda r: r["area"]), total(rects, area)
        main = F.array_max(F.transform(rests, lambda r: r["main"]))["r"]
    else:
        rests, first = [rest_of_rect(r, cut, i) for i, r in enumerate(rects)], rects[0]
        n, left, whole = (reduce(add, x) for x in ([r["pieces"] for r in rests], [r["area"] for r in rests], [area(r) for r in rects]))
        main = (F.greatest(*[r["main"] for r in rests]) if len(rests) > 1 else rests[0]["main"])["r"]
    lost = F.floor((1 - left / whole) * 100 + 0.5)
    skip = (kind != "text") | (n == 0) | (main["w"] < MAIN_MIN_W) | (main["h"] < MAIN_MIN_H) | (lost >= CARVE_WARN)
    if split_y is not None:
        skip = skip | ((first["y"] < split_y) != (main["y"] < split_y))
    return F.when(skip, "skip").when(lost >= CARVE_AUTO, "warn").otherwise("auto")
