"""Symbols to field contents.

One pass over the symbols: two broadcast look-ups on the map side, one shuffle
on (page, field), and small aggregates after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.functions.scalars import UNCLEAR
from formloom.operators.ranges import first_hit
from formloom.operators.sizing import broadcast_if_small, inside
from formloom.session import kept
from formloom.sources.templates import BASE_DPI, GRID, TemplateTables, receptors

# Fixed values, px at 300 dpi or plain ratios.
LINE_GAP = 30.0
BUCKET = GRID
BAND_OVERLAP = 0.5
NOISE_MAX = 1
MISMATCH_RATIO = 0.55
MISMATCH_CAP = 0.70
COVERAGE_BASE = 0.35


def to_face_local(symbols: DataFrame, tables: TemplateTables) -> DataFrame:
    """B1: symbols whose centre lies in a face, in face coordinates, outside its exclusions.

    ``symbols`` carries ``template_id``; a template has a handful of faces, so
    the join fans out by that many candidates at most and keeps one.
    """
    look_up = tables.small(
        tables.faces.select("template_id", "face_id", "dpi", "source", "exclusions", "zones")
    )
    placed = (
        symbols.join(look_up, "template_id")
        .filter(inside(F.col("x"), F.col("y"), F.col("source")))
        .withColumn("x", F.col("x") - F.col("source.x"))
        .withColumn("y", F.col("y") - F.col("source.y"))
    )
    px, py = F.col("x"), F.col("y")
    return placed.filter(~F.exists("exclusions", lambda e: inside(px, py, e))).drop("source", "exclusions")


def _move(block: Column) -> Column:
    """How far a block lies below its printed place on the symbol's page; 0 for fields of no block."""
    return F.coalesce(F.get("moves", block), F.lit(0))


def with_moves(local: DataFrame, moves: DataFrame, tables: TemplateTables) -> tuple[DataFrame, int]:
    """Symbols with the ``moves`` of their page's blocks, and the largest move there is, for ``assign_symbols``.

    ``moves`` (page_id, template_id, face_id, applied, blocks) has one row a face
    at most, ``blocks`` being structs with block_idx and dy, as ``snap_plan``
    gives them; ``applied`` is the word of ``snap_gate``. A face whose blocks
    are other than the template's doesn't move, nor do single fields,
    exclusions and symbols. Nothing is copied: a symbol carries the few moves
    of its face, and the template's index stays one.
    """
    blocks = F.sort_array("blocks")
    drawn = F.when(F.col("is_table"), F.size("geoms")).otherwise(0)
    known = moves.filter("applied").join(
        tables.small(tables.faces.select("template_id", "face_id", drawn.alias("_drawn"))), ["template_id", "face_id"]
    )
    whole = F.transform(blocks, lambda b: b["block_idx"]) == F.sequence(F.lit(0), F.col("_drawn") - 1)
    dys = F.transform(blocks, lambda b: b["dy"].cast("int"))
    some = known.filter((F.col("_drawn") > 0) & whole & F.exists(dys, lambda v: v != 0))
    some = kept(some.select("page_id", "face_id", dys.alias("moves")))
    far = some.agg(F.max(F.array_max(F.transform("moves", lambda v: F.abs(v)))).alias("far")).first().far
    return local.join(broadcast_if_small(some), ["page_id", "face_id"], "left"), far or 0


def assign_symbols(local: DataFrame, tables: TemplateTables, bucket: int = BUCKET, reach: int = 0) -> DataFrame:
    """Where each symbol goes.

    With a ``reach`` above 0, ``local`` comes from ``with_moves``: fields and
    table bottoms lie where the blocks of the symbol's page have moved.

    Adds ``kind`` (region, fallback, hole, below_table, other), ``field_id``,
    ``region`` and, for fallback symbols, ``probe_field``: the field whose hole
    takes the symbol should it be discarded. Regions of all fields come before
    all fallbacks, fallbacks before holes; ties go to definition order. The
    bucket width never changes the result.
    """
    more = ("block_idx",) if reach else ()
    places = receptors(tables.cells, *more)
    payload = ["kind", "field_id", "region", *more]
    keys = ["template_id", "face_id"]
    hit = first_hit(
        local, places, keys, payload, bucket=bucket, also=("probe", lambda c: c["kind"] != "fallback"),
        known_rows=tables.place_area if bucket >= GRID and not reach else None,
        moved=(reach, lambda c: _move(c["block_idx"])) if reach else None,
    )
    px, py = F.col("x"), F.col("y")
    zones = F.col("zones")
    if reach:  # zones lie in the order of their blocks
        zones = F.transform(zones, lambda z, i: z.withField("bottom", z["bottom"] + _move(i)))
    below = F.coalesce(
        F.exists(zones, lambda z: (px >= z["x_min"]) & (px < z["x_max"]) & (py >= z["bottom"])),
        F.lit(False),
    )
    return hit.select(
        *[c for c in local.columns if c not in ("zones", "moves")],
        F.coalesce("hit.kind", F.when(below, "below_table").otherwise("other")).alias("kind"),
        F.col("hit.field_id").alias("field_id"),
        F.col("hit.region").alias("region"),
        F.when((F.col("hit.kind") == "fallback") & (F.col("probe.kind") == "hole"), F.col("probe.field_id")).alias(
            "probe_field"
        ),
    )


def placement_counts(assigned: DataFrame) -> DataFrame:
    """Symbols per page, destination and, for holes, field; reduced before the shuffle."""
    return assigned.groupBy(
        "page_id", "template_id", "kind", F.when(F.col("kind") == "hole", F.col("field_id")).alias("hole_field")
    ).agg(F.count(F.lit(1)).alias("symbols"))


def disposition_counts(assigned: DataFrame) -> DataFrame:
    """C4: symbols per page and destination."""
    return assigned.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("symbols"))


def fallback_decision(n_main: Column, n_fb: Column) -> Column:
    """D3: 'fallback', 'conflict', '' or NULL when the field is blank."""
    return (
        F.when((n_main == 0) & (n_fb == 0), None)
        .when(n_main == 0, "fallback")
        .when((n_main <= NOISE_MAX) & (n_fb >= 2), "conflict")
        .otherwise("")
    )


def _band_keys(regions: Column, rounds: int) -> Column:
    """Per region its band's smallest y, found by passing labels between
    overlapping regions; ``rounds`` is one less than the regions of a field."""

    def overlap(a: Column, b: Column) -> Column:
        shared = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
        return shared >= F.least(a["h"], b["h"]) * BAND_OVERLAP

    bands = F.transform(
        regions,
        lambda r: F.struct(
            r["idx"].alias("idx"), r["x"].alias("x"), r["y"].alias("y"), r["h"].alias("h"), r["y"].alias("band")
        ),
    )
    def widen(bands: Column) -> Column:
        return F.transform(
            bands,
            lambda r: F.struct(
                r["idx"].alias("idx"), r["x"].alias("x"), r["y"].alias("y"), r["h"].alias("h"),
                F.array_min(
                    F.transform(F.filter(bands, lambda q: overlap(q, r)), lambda q: q["band"])
                ).alias("band"),
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), bands, lambda acc, _: widen(acc))


def _joined(symbols: Column) -> tuple[Column, Column]:
    """Text and per-character confidences of symbols that are already in order."""
    text = F.array_join(F.transform(symbols, lambda s: s["text"]), "")
    confs = F.flatten(F.transform(symbols, lambda s: F.array_repeat(s["conf"], F.length(s["text"]))))
    return text, confs


def field_contents(assigned: DataFrame, tables: TemplateTables) -> DataFrame:
    """One row per (page, field) that received symbols.

    Lines: within a region symbols are taken by y, a new line starts where the
    step to the previous symbol exceeds the gap; within a line by x; ties by
    ``seq``. Fields with several regions read band by band: regions whose y
    ranges overlap by half the lower height are one band, transitively, counting
    only regions that hold symbols.

    All symbols of one (page, field) meet in one row because together they are
    one output value; nothing wider than that is ever collected. The explicit
    repartition serves the line window and the grouping, so there is one shuffle.
    """
    spec = tables.cells.select(
        "template_id", "field_id", "cell_ord", F.col("output").alias("cell_output"),
        F.transform(
            F.concat(F.array("rect"), F.col("extra_rects")),
            lambda r, i: F.struct(i.alias("idx"), r["x"].alias("x"), r["y"].alias("y"), r["h"].alias("h")),
        ).alias("rects"),
    )
    most = tables.regions() - 1
    gap = LINE_GAP * F.col("dpi") / BASE_DPI
    keep = ["page_id", "template_id", "field_id", "kind", "region", "x", "y", "seq", "text", "conf",
            "probe_field", "dpi"]
    w = Window.partitionBy("page_id", "field_id", "kind", "region").orderBy("y", "seq")
    lines = (
        assigned.filter(F.col("kind").isin("region", "fallback"))
        .select(*keep)
        .repartition("page_id", "field_id")
        .withColumn("_brk", F.when(F.col("y") - F.lag("y").over(w) > gap, 1).otherwise(0))
        .withColumn("line", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    one = F.struct("region", "line", "x", "y", "seq", "text", "conf")
    grouped = lines.groupBy("page_id", "template_id", "field_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "region", one))).alias("main"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "fallback", one))).alias("fb"),
        F.collect_list(F.when(F.col("kind") == "fallback", F.coalesce("probe_field", F.lit("")))).alias("probes"),
    )
    out = grouped.join(tables.small(spec), ["template_id", "field_id"])
    ordered = F.col("main")
    if most:
        active = F.filter(
            "rects", lambda r: F.exists("main", lambda s: s["region"] == r["idx"])
        )
        out = out.withColumn("_bands", F.when(F.size("rects") > 1, _band_keys(active, most)))

        def keyed(s: Column) -> Column:
            band = F.get(F.filter("_bands", lambda b: b["idx"] == s["region"]), F.lit(0))
            return F.struct(
                band["band"].alias("band"), band["x"].alias("rx"), s["region"].alias("region"),
                s["line"].alias("line"), s["x"].alias("x"), s["y"].alias("y"), s["seq"].alias("seq"),
                s["text"].alias("text"), s["conf"].alias("conf"),
            )

        banded = F.array_sort(F.transform("main", keyed))
        text_m = F.when(F.col("_bands").isNull(), _joined(ordered)[0]).otherwise(_joined(banded)[0])
        confs_m = F.when(F.col("_bands").isNull(), _joined(ordered)[1]).otherwise(_joined(banded)[1])
    else:
        text_m, confs_m = _joined(ordered)
    text_f, confs_f = _joined(F.col("fb"))
    n_main, n_fb = F.size("main"), F.size("fb")
    origin = fallback_decision(n_main, n_fb)
    from_fb = origin == "fallback"
    return out.select(
        "page_id", "template_id", "field_id", "cell_ord", "cell_output",
        n_main.cast("long").alias("n_main"),
        n_fb.cast("long").alias("n_fb"),
        origin.alias("origin"),
        F.when(from_fb, text_f).otherwise(text_m).alias("raw"),
        F.when(from_fb, confs_f).otherwise(confs_m).alias("char_confs"),
        # discarded fallback symbols, by the hole they fall into ('' = none)
        F.when(from_fb, F.array().cast("array<string>")).otherwise(F.col("probes")).alias("discarded"),
    ).withColumn("conf", F.array_min("char_confs"))


def discarded_hits(contents: DataFrame) -> DataFrame:
    """Where discarded fallback symbols end up; ``hole_field`` '' counts as other."""
    return contents.select(
        "page_id", "template_id", "field_id", "cell_output", F.explode("discarded").alias("hole_field")
    )


def hole_hits(counts: DataFrame, contents: DataFrame) -> DataFrame:
    """Symbols per (page, field) that fell into the field's hole, directly or by C2."""
    direct = counts.filter(F.col("kind") == "hole").select(
        "page_id", "template_id", F.col("hole_field").alias("field_id"), "symbols"
    )
    probed = discarded_hits(contents).filter(F.col("hole_field") != "").select(
        "page_id", "template_id", F.col("hole_field").alias("field_id"), F.lit(1).cast("long").alias("symbols")
    )
    return direct.unionByName(probed).groupBy("page_id", "template_id", "field_id").agg(
        F.sum("symbols").alias("holes")
    )


def cell_contents(contents: DataFrame, holes: DataFrame) -> DataFrame:
    """Contents after the holes: a field with any hole hit is unclear as a whole."""
    both = contents.select(
        "page_id", "template_id", "field_id",
        F.struct("raw", "conf", "char_confs", "origin").alias("content"), F.lit(0).cast("long").alias("holes"),
    ).unionByName(
        holes.select(
            "page_id", "template_id", "field_id",
            F.lit(None).cast("struct<raw:string,conf:double,char_confs:array<double>,origin:string>").alias(
                "content"
            ),
            "holes",
        )
    )
    merged = both.groupBy("page_id", "template_id", "field_id").agg(
        F.first("content", ignorenulls=True).alias("c"), F.sum("holes").alias("holes")
    )
    hit = F.col("holes") > 0
    return merged.select(
        "page_id", "template_id", "field_id",
        F.when(hit, F.lit(UNCLEAR)).otherwise(F.col("c.raw")).alias("raw"),
        F.when(~hit, F.col("c.conf")).alias("conf"),
        F.when(hit, F.array().cast("array<double>")).otherwise(F.col("c.char_confs")).alias("char_confs"),
        F.when(hit, "").otherwise(F.col("c.origin")).alias("origin"),
        "holes",
    )


def pages_of(symbols: DataFrame) -> DataFrame:
    return symbols.select("page_id", "template_id").distinct()


def page_contents(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """Pages with all their contents as one map; a page has at most one entry per template cell."""
    packed = contents.groupBy("page_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("field_id", F.struct("raw", "conf", "char_confs", "origin")))
        ).alias("contents")
    )
    return pages.join(packed, "page_id", "left")


def table_rows(cells: DataFrame) -> DataFrame:
    """Text fields of every table row of a template."""
    return (
        cells.filter((F.col("kind") == "text") & F.col("table_id").isNotNull())
        .groupBy("template_id", "table_id", "row_no")
        .agg(F.collect_set("field_id").alias("fields"))
    )


def empty_rows(paged: DataFrame, tables: TemplateTables) -> DataFrame:
    """Table rows of a page without content in any text cell."""
    rows = tables.small(table_rows(tables.cells))
    filled = F.coalesce(F.map_keys("contents"), F.array().cast("array<string>"))
    return (
        paged.withColumn("_filled", filled)
        .join(rows, "template_id")
        .filter(~F.arrays_overlap("_filled", "fields"))
        .select("page_id", "template_id", "table_id", "row_no")
    )


def page_counters(pages: DataFrame, counts: DataFrame, contents: DataFrame, holes: DataFrame,
                  tables: TemplateTables) -> DataFrame:
    """Counters per page; every page of ``pages`` has a row."""
    lone = F.count_if

    def of(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("symbols")).otherwise(0))

    placed = counts.groupBy("page_id").agg(
        F.sum("symbols").alias("in_face"), of("below_table").alias("below"), of("other").alias("other_direct")
    )
    discarded = F.size("discarded").cast("long")
    lost = F.size(F.filter("discarded", lambda h: h == "")).cast("long")
    used = contents.groupBy("page_id").agg(
        lone(F.col("origin") == "fallback").alias("fallback_used"),
        F.sum(discarded).alias("fallback_discarded"),
        F.sum(F.when(~F.col("cell_output"), discarded).otherwise(0)).alias("fallback_discarded_excluded"),
        lone((F.col("origin") == "conflict") & ~F.col("cell_output")).alias("conflict_excluded"),
        F.sum(lost).alias("other_discarded"),
    )
    outputs = tables.small(tables.cells.select("template_id", "field_id", "output"))
    carved = holes.join(outputs, ["template_id", "field_id"]).groupBy("page_id").agg(
        F.sum("holes").alias("carve_hole"),
        F.sum(F.when(~F.col("output"), F.col("holes")).otherwise(0)).alias("carve_hole_excluded"),
    )
    joined = pages.join(placed, "page_id", "left").join(used, "page_id", "left").join(carved, "page_id", "left")
    names = ["in_face", "below", "fallback_used", "fallback_discarded", "carve_hole",
             "fallback_discarded_excluded", "carve_hole_excluded", "conflict_excluded"]
    zero = F.lit(0).cast("long")
    return joined.select(
        *pages.columns,
        *[F.coalesce(n, zero).alias(n) for n in names],
        (F.coalesce("other_direct", zero) + F.coalesce("other_discarded", zero)).alias("other"),
    )


def mismatch_ratios(tables: TemplateTables) -> DataFrame:
    """The share of stray symbols above which a page does not fit its template."""
    face_area = tables.faces.groupBy("template_id").agg(
        F.sum(F.col("source.w").cast("long") * F.col("source.h")).alias("face_area")
    )

    def area(r: Column) -> Column:
        return r["w"].cast("long") * r["h"]

    rects = F.concat(
        F.array("rect"), F.col("extra_rects"),
        F.when(F.col("fallback").isNotNull(), F.array("fallback")).otherwise(
            F.filter(F.array("rect"), lambda r: F.lit(False))
        ),
    )
    cell_area = tables.cells.groupBy("template_id").agg(
        F.sum(F.aggregate(F.transform(rects, area), F.lit(0).cast("long"), lambda a, b: a + b)).alias("cell_area")
    )
    coverage = F.when(F.col("face_area") <= 0, F.lit(1.0)).otherwise(F.col("cell_area") / F.col("face_area"))
    raised = MISMATCH_RATIO + (MISMATCH_CAP - MISMATCH_RATIO) * (1.0 - coverage / COVERAGE_BASE)
    return face_area.join(cell_area, "template_id").select(
        "template_id",
        F.when(coverage >= COVERAGE_BASE, F.lit(MISMATCH_RATIO)).otherwise(raised).alias("ratio"),
    )


def format_mismatch(counters: DataFrame, page_totals: DataFrame, tables: TemplateTables) -> DataFrame:
    """Pages that do not look like their template."""
    joined = counters.join(page_totals, "page_id").join(tables.small(mismatch_ratios(tables)), "template_id")
    share = F.col("other") / F.col("in_face")
    bad = (F.col("page_total") == 0) | (F.col("in_face") == 0) | (share > F.col("ratio"))
    return joined.select("page_id", "in_face", "other", F.coalesce(bad, F.lit(True)).alias("mismatch"))


def overflow_candidates(local: DataFrame, tables: TemplateTables, targets: DataFrame,
                        scale: float = 1.0) -> DataFrame:
    """Fields of known digit count that came out short with symbols right beside them.

    ``targets`` (template_id, face_id, field_id, rect, digits) is part of the
    template and small. Fields whose main rect holds nothing are skipped here
    and counted by ``empty_main``.
    """
    band_w = F.greatest(F.lit(1), F.bround(F.col("rect.h") * scale).cast("int"))
    aims = tables.small(
        targets.select(
            "template_id", "face_id", "field_id", "rect", "digits",
            F.struct(
                (F.col("rect.x") + F.col("rect.w")).alias("x"), F.col("rect.y").alias("y"),
                band_w.alias("w"), F.col("rect.h").alias("h"),
            ).alias("band"),
        )
    )
    taken = tables.small(
        receptors(tables.cells).filter(F.col("kind") != "hole")
        .groupBy("template_id", "face_id")
        .agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("rects"))
    )
    px, py = F.col("x"), F.col("y")
    in_main = inside(px, py, F.col("rect"))
    in_band = inside(px, py, F.col("band")) & ~in_main
    near = (
        local.join(aims, ["template_id", "face_id"])
        .filter(in_main | in_band)
        .withColumn("main", in_main)
        .join(taken, ["template_id", "face_id"], "left")
    )
    free = ~F.exists("rects", lambda r: inside(px, py, r))
    per_field = near.groupBy("page_id", "template_id", "field_id", "digits").agg(
        F.count_if("main").alias("main_symbols"),
        F.count_if(~F.col("main")).alias("right_symbols"),
        F.count_if(~F.col("main") & free).alias("right_outside_fields"),
    )
    return per_field.filter(
        (F.col("main_symbols") > 0) & (F.col("main_symbols") < F.col("digits")) & (F.col("right_symbols") > 0)
    )


def empty_main(local: DataFrame, tables: TemplateTables, targets: DataFrame) -> DataFrame:
    """(page_id, template_id, targets, empty_main) of every page with a symbol on a face, done or not.

    ``empty_main`` counts the fields of known digit count whose main rect holds
    nothing. Symbols shrink to one row per (page, field) before their shuffle.
    """
    aims = tables.small(targets.select("template_id", "face_id", "field_id", "rect"))
    sizes = tables.small(targets.groupBy("template_id").agg(F.count(F.lit(1)).alias("targets")))
    main = F.coalesce(inside(F.col("x"), F.col("y"), F.col("rect")), F.lit(False))
    fields = local.join(aims, ["template_id", "face_id"], "left").groupBy("page_id", "template_id", "field_id").agg(F.max(main).alias("filled"))
    pages = fields.groupBy("page_id", "template_id").agg(F.count_if("filled").alias("filled")).join(sizes, "template_id", "left")
    known = F.coalesce("targets", F.lit(0).cast("long"))
    return pages.select("page_id", "template_id", known.alias("targets"), (known - F.col("filled")).alias("empty_main"))
