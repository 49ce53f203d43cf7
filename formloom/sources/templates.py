"""Form templates: JSON documents to cell, face and geometry tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.operators.sizing import BROADCAST_ROWS, broadcast_if_small
from formloom.session import kept

BASE_DPI = 300
GRID = 128

_RECT = "STRUCT<x: INT, y: INT, w: INT, h: INT>"
TEMPLATE_SCHEMA = f"""
STRUCT<schema_version: INT, template_id: STRING, render_dpi: INT,
  image: STRUCT<width: INT, height: INT>, record: STRUCT<pages: INT>,
  faces: ARRAY<STRUCT<face_id: STRING,
    source: STRUCT<page_offset: INT, rect: {_RECT}>,
    exclusions: ARRAY<STRUCT<id: STRING, rect: {_RECT}>>,
    fields: ARRAY<STRUCT<field_id: STRING, kind: STRING, rect: {_RECT}, extra_rects: ARRAY<{_RECT}>,
      fallback_rect: {_RECT}, choice_marks: ARRAY<STRUCT<value: STRING, rect: {_RECT}>>,
      normalize: STRING, output: BOOLEAN>>,
    tables: ARRAY<STRUCT<table_id: STRING, row_pitch: INT, row_height: INT,
      blocks: ARRAY<STRUCT<origin: STRUCT<x: INT, y: INT>, rows: INT>>,
      columns: ARRAY<STRUCT<name: STRING, kind: STRING, x_offset: INT, width: INT,
        subfields: ARRAY<STRING>, normalize: STRING, output: BOOLEAN,
        choice_marks: ARRAY<STRUCT<value: STRING, x_offset: INT, y_offset: INT, width: INT, height: INT>>>>,
      output_disabled_cells: ARRAY<STRUCT<row_no: INT, column: STRING>>>>>>>
"""

# Anchors of a face without tables, px at 300 dpi.
ANCHOR_MIN_SPAN = 40
ANCHOR_SEARCH = 24


@dataclass(frozen=True)
class TemplateTables:
    """``cells``: one row per cell; ``faces``: one row per face with its arrays.

    ``cell_rows``, ``max_regions`` and ``place_area`` (an upper bound on the
    grid buckets all receptors touch) are measured by :meth:`settled`.
    ``packed``: one row per document with the arrays ``cells``, in definition
    order, and ``exclusions``, their number on each face.
    """

    cells: DataFrame
    faces: DataFrame
    cell_rows: int | None = None
    max_regions: int | None = None
    place_area: int | None = None
    packed: DataFrame | None = None

    def settled(self) -> TemplateTables:
        """The same tables computed once, measured, and cut from their JSON.

        Every later stage looks templates up several times; without this each
        look-up would parse the documents again.
        """
        cells, faces = kept(self.cells), kept(self.faces)
        def touched(r: Column) -> Column:
            return (F.floor(r["w"] / GRID) + 2) * (F.floor(r["h"] / GRID) + 2)

        rects = F.concat(F.array("rect", "fallback"), F.col("extra_rects"))
        places = F.aggregate(
            F.filter(rects, lambda r: r.isNotNull()), F.lit(0).cast("long"), lambda a, r: a + touched(r)
        )
        # a hole box spans at most its whole face
        page = F.when(F.size("extra_rects") > 0, 4096).otherwise(0)
        rows, regions, area = cells.agg(
            F.count(F.lit(1)), F.max(F.size("extra_rects") + 1), F.sum(places + page)
        ).first()
        return TemplateTables(cells, faces, rows, regions or 1, area or 0, self.packed)

    def regions(self) -> int:
        """The most regions any field has: one number out of the template table."""
        if self.max_regions is not None:
            return self.max_regions
        return self.cells.agg(F.max(F.size("extra_rects") + 1)).first()[0] or 1

    def small(self, df: DataFrame) -> DataFrame:
        """``df``, a table with at most a few rows per cell, hinted for broadcast if its size allows."""
        if self.cell_rows is not None and self.cell_rows * 4 <= BROADCAST_ROWS:
            return F.broadcast(df)
        return broadcast_if_small(df)


def _rect(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def _empty(column: Column, like: str) -> Column:
    return F.coalesce(column, F.from_json(F.lit("[]"), like))


def _table_columns_width(table: Column) -> Column:
    return F.array_max(F.transform(table["columns"], lambda c: c["x_offset"] + c["width"]))


def _zones(tables: Column) -> Column:
    def of_table(t: Column) -> Column:
        return F.transform(
            t["blocks"],
            lambda b: F.struct(
                t["table_id"].alias("table_id"),
                b["origin"]["x"].alias("x_min"),
                (b["origin"]["x"] + _table_columns_width(t)).alias("x_max"),
                (b["origin"]["y"] + t["row_pitch"] * (b["rows"] - 1) + t["row_height"]).alias("bottom"),
            ),
        )

    return F.flatten(F.transform(tables, of_table))


def _table_geoms(tables: Column) -> Column:
    def of_table(t: Column) -> Column:
        edges = F.array_sort(
            F.array_distinct(
                F.concat(
                    F.transform(t["columns"], lambda c: c["x_offset"]),
                    F.array(_table_columns_width(t)),
                )
            )
        )
        return F.transform(
            t["blocks"],
            lambda b: F.struct(
                b["origin"]["x"].alias("x_min"),
                (b["origin"]["x"] + _table_columns_width(t)).alias("x_max"),
                b["origin"]["y"].alias("y_min"),
                (b["origin"]["y"] + t["row_pitch"] * b["rows"]).alias("y_max"),
                F.transform(
                    F.sequence(F.lit(0), b["rows"]), lambda i: b["origin"]["y"] + t["row_pitch"] * i
                ).alias("h_lines"),
                F.transform(edges, lambda e: b["origin"]["x"] + e).alias("v_lines"),
                (t["row_pitch"] - t["row_height"]).alias("row_gap"),
            ),
        )

    return F.flatten(F.transform(tables, of_table))


#: Columns of a cell in the array of its document.
CELL = [
    "face_ord", "face_id", "field_id", "kind", "rect", "extra_rects", "fallback", "marks", "subfields", "normalize", "table_id", "row_no", "block_idx", "output",
]


def _listed(items: Column) -> Column:
    """An array, empty where it is missing."""
    return F.coalesce(items, F.array())


def _packed_cells(faces: Column) -> Column:
    """All cells of a document: face by face the single fields, then the tables with their rows and columns."""
    rects, marks, words = f"ARRAY<{_RECT}>", f"ARRAY<STRUCT<value: STRING, rect: {_RECT}>>", "ARRAY<STRING>"

    def cell(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for n, v in zip(CELL, values, strict=True)])

    def single(face: Column, face_ord: Column) -> Column:
        return F.transform(_listed(face["fields"]), lambda c: cell(
            face_ord, face["face_id"], c["field_id"], c["kind"], c["rect"], _empty(c["extra_rects"], rects), c["fallback_rect"],
            _empty(c["choice_marks"], marks), F.array().cast(words), F.when(c["kind"] == "text", c["normalize"]),
            F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.coalesce(c["output"], F.lit(True)),
        ))

    def tabled(face: Column, face_ord: Column) -> Column:
        def of_table(t: Column, pos: Column) -> Column:
            base = F.aggregate(F.slice(face["tables"], F.lit(1), pos), F.lit(0), lambda a, x: a + F.size(_listed(x["blocks"])))
            # counted once a block, as a lambda would count again for every cell
            placed = F.transform(_listed(t["blocks"]), lambda b, bi: F.struct(
                b.alias("b"), (base + bi).alias("block"),
                F.aggregate(F.slice(t["blocks"], F.lit(1), bi), F.lit(0), lambda a, x: a + x["rows"]).alias("above"),
            ))
            return F.flatten(F.transform(placed, lambda z: F.flatten(F.transform(
                _listed(F.sequence(F.lit(0), z["b"]["rows"] - 1)), lambda i: of_row(t, z["b"], z["block"], z["above"] + i + 1, i)
            ))))

        def of_row(t: Column, b: Column, block: Column, row_no: Column, i: Column) -> Column:
            ox, top = b["origin"]["x"], b["origin"]["y"] + t["row_pitch"] * i
            return F.transform(_listed(t["columns"]), lambda c: of_column(t, c, block, row_no, ox, top))

        def of_column(t: Column, c: Column, block: Column, row_no: Column, ox: Column, top: Column) -> Column:
            text, height = c["kind"] == "text", t["row_height"]
            split = F.when(text, _empty(c["subfields"], words)).otherwise(F.array().cast(words))
            disabled = F.exists(
                _empty(t["output_disabled_cells"], "ARRAY<STRUCT<row_no: INT, column: STRING>>"),
                lambda d: (d["row_no"] == row_no) & (d["column"] == c["name"]),
            )
            drawn = F.transform(c["choice_marks"], lambda m: F.struct(m["value"].alias("value"), _rect(
                ox + m["x_offset"], top + F.coalesce(m["y_offset"], F.lit(0)), m["width"],
                F.coalesce(m["height"], height - F.coalesce(m["y_offset"], F.lit(0))),
            ).alias("rect")))
            return cell(
                face_ord, face["face_id"], F.format_string("%s_%02d_%s", t["table_id"], row_no, c["name"]), c["kind"],
                _rect(ox + c["x_offset"], top, c["width"], height), F.from_json(F.lit("[]"), rects), F.lit(None).cast(_RECT),
                F.when(c["kind"] == "choice", drawn).otherwise(F.from_json(F.lit("[]"), marks)), split,
                F.when(text & (F.size(split) == 0), c["normalize"]), t["table_id"], row_no, block,
                F.coalesce(c["output"], F.lit(True)) & ~disabled,
            )

        return F.flatten(F.transform(_listed(face["tables"]), of_table))

    return F.flatten(F.transform(faces, lambda f, i: F.concat(single(f, i), tabled(f, i))))


def expand_templates(templates: DataFrame, body: str = "body") -> TemplateTables:
    """A4: expand template documents.

    Tables become blocks x rows x columns of cells; ``row_no`` runs across the
    blocks of a table, ``block_idx`` across the tables of a face. A cell is in
    the output when its column is and the cell is not in
    ``output_disabled_cells``. Choice cells drop subfields and normalisation,
    split cells drop normalisation. ``cell_ord`` is the definition order. Cells
    are numbered inside their document's row, so nothing is shuffled.
    """
    parsed = templates.select(F.from_json(F.col(body), TEMPLATE_SCHEMA).alias("t"))
    packed = parsed.select(
        F.col("t.template_id").alias("template_id"), F.col("t.render_dpi").alias("dpi"), _packed_cells(F.col("t.faces")).alias("cells"),
        F.transform("t.faces", lambda f, i: F.struct(
            i.alias("face_ord"), f["face_id"].alias("face_id"), F.size(_listed(f["exclusions"])).alias("n")
        )).alias("exclusions"),
    )
    # outer, as Spark would else build the cells once more to leave out documents without any
    cells = packed.select("template_id", "dpi", F.posexplode_outer("cells").alias("cell_ord", "c")).filter(F.col("c").isNotNull()).select(
        "template_id", "dpi", *[F.col("c")[n].alias(n) for n in CELL], "cell_ord"
    )

    docs = parsed.select(
        F.col("t.template_id").alias("template_id"),
        F.col("t.render_dpi").alias("dpi"),
        F.col("t.image.width").alias("image_w"),
        F.col("t.image.height").alias("image_h"),
        F.posexplode("t.faces").alias("face_ord", "f"),
    )
    head = ["template_id", "dpi", "face_ord", F.col("f.face_id").alias("face_id")]
    geoms = _table_geoms(F.col("tables"))
    span = F.greatest(F.lit(1), F.bround(F.lit(ANCHOR_MIN_SPAN) * F.col("dpi") / BASE_DPI).cast("int"))
    no_lines = F.array().cast("array<int>")
    field_geoms = F.filter(
        F.transform(
            F.col("fields"),
            lambda c: F.struct(
                c["rect"]["x"].alias("x_min"),
                (c["rect"]["x"] + c["rect"]["w"]).alias("x_max"),
                c["rect"]["y"].alias("y_min"),
                (c["rect"]["y"] + c["rect"]["h"]).alias("y_max"),
                F.when(c["rect"]["w"] >= span, F.array(c["rect"]["y"], c["rect"]["y"] + c["rect"]["h"]))
                .otherwise(no_lines)
                .alias("h_lines"),
                F.when(c["rect"]["h"] >= span, F.array(c["rect"]["x"], c["rect"]["x"] + c["rect"]["w"]))
                .otherwise(no_lines)
                .alias("v_lines"),
                F.lit(None).cast("int").alias("row_gap"),
            ),
        ),
        lambda g: (F.size(g["h_lines"]) > 0) | (F.size(g["v_lines"]) > 0),
    )
    faces = (
        docs.select(
            *head, "image_w", "image_h",
            F.col("f.source.rect").alias("source"),
            F.transform(
                _empty(F.col("f.exclusions"), f"ARRAY<STRUCT<id: STRING, rect: {_RECT}>>"), lambda e: e["rect"]
            ).alias("exclusions"),
            F.col("f.tables").alias("tables"),
            F.col("f.fields").alias("fields"),
        )
        .withColumn("is_table", F.coalesce(F.size("tables") > 0, F.lit(False)))
        .withColumn("zones", F.when(F.col("is_table"), _zones(F.col("tables"))))
        .withColumn("geoms", F.when(F.col("is_table"), geoms).otherwise(field_geoms))
        .drop("tables", "fields")
    )
    return TemplateTables(cells, faces, packed=packed)


def receptors(cells: DataFrame, *more: str) -> DataFrame:
    """All places a symbol can land in: regions, then fallbacks, then holes.

    ``priority`` orders them: every region before every fallback before every
    hole, each in definition order. The hole of a field is the bounding box of
    its rects and exists only with two or more of them. ``more`` names further
    columns of the cells to carry along.
    """
    base = ["template_id", "face_id", "field_id", "output", *more]
    rects = F.concat(F.array("rect"), F.col("extra_rects"))

    def layer(n: int, kind: str, region, rect: Column, source: DataFrame) -> DataFrame:
        return source.select(
            *base,
            F.struct(F.lit(n).alias("layer"), F.col("cell_ord").alias("ord"), region.alias("region")).alias(
                "priority"
            ),
            F.lit(kind).alias("kind"),
            region.alias("region"),
            rect["x"].alias("x"), rect["y"].alias("y"), rect["w"].alias("w"), rect["h"].alias("h"),
        )

    regions = cells.select(*base, "cell_ord", F.posexplode(rects).alias("idx", "r"))
    out = layer(0, "region", F.col("idx"), F.col("r"), regions)
    zero = F.lit(0)
    out = out.unionByName(
        layer(1, "fallback", zero, F.col("fallback"), cells.filter(F.col("fallback").isNotNull()))
    )
    x0 = F.array_min(F.transform(rects, lambda r: r["x"]))
    y0 = F.array_min(F.transform(rects, lambda r: r["y"]))
    x1 = F.array_max(F.transform(rects, lambda r: r["x"] + r["w"]))
    y1 = F.array_max(F.transform(rects, lambda r: r["y"] + r["h"]))
    holes = cells.filter(F.size("extra_rects") > 0).withColumn("r", _rect(x0, y0, x1 - x0, y1 - y0))
    return out.unionByName(layer(2, "hole", zero, F.col("r"), holes))


def column_names(cells: Column) -> Column:
    """B2 inside a document's row: field_id, kind, cell_ord, part and column of the output columns, in order."""
    numbered = F.filter(F.transform(cells, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"]["output"])

    def parts(x: Column) -> Column:
        c = x["c"]
        names = F.when(F.size(c["subfields"]) > 0, F.transform(c["subfields"], lambda s: F.concat(c["field_id"], F.lit("_"), s))).otherwise(F.array(c["field_id"]))
        return F.transform(names, lambda n, k: F.struct(
            c["field_id"].alias("field_id"), c["kind"].alias("kind"), x["i"].alias("cell_ord"), k.alias("part"), n.alias("column")
        ))

    return F.flatten(F.transform(numbered, parts))


def packed_columns(packed: DataFrame) -> DataFrame:
    """B2 of whole documents: the same rows as :func:`output_columns`, without a shuffle."""
    named = packed.select("template_id", column_names(F.col("cells")).alias("names"))
    return named.select("template_id", F.posexplode_outer("names").alias("col_ord", "n")).filter(F.col("n").isNotNull()).select("template_id", "n.*", "col_ord")


def output_columns(cells: DataFrame) -> DataFrame:
    """B2: ordered output columns; cells without output have none."""
    parts = F.when(F.size("subfields") > 0, F.transform(
        "subfields", lambda s: F.concat(F.col("field_id"), F.lit("_"), s)
    )).otherwise(F.array("field_id"))
    per_template = Window.partitionBy("template_id").orderBy("cell_ord", "part")
    return (
        cells.filter("output")
        .select("template_id", "field_id", "kind", "cell_ord", F.posexplode(parts).alias("part", "column"))
        .withColumn("col_ord", F.row_number().over(per_template) - 1)
    )


def template_hashes(templates: DataFrame, body: str = "body") -> DataFrame:
    """Content hash of the whole document and of its geometry only.

    The documents are compared as key-sorted JSON, so key order and white
    space do not matter.
    """
    doc = F.from_json(F.col(body), TEMPLATE_SCHEMA)
    geometry = F.to_json(
        F.struct(
            doc["render_dpi"].alias("dpi"),
            doc["image"].alias("image"),
            doc["record"].alias("record"),
            F.transform(
                doc["faces"],
                lambda f: F.struct(
                    f["face_id"].alias("face_id"), f["source"].alias("source"), f["exclusions"].alias("exclusions")
                ),
            ).alias("faces"),
        )
    )
    return templates.withColumn(
        "template_hash", F.sha2(F.to_json(F.parse_json(F.col(body))), 256)
    ).withColumn("geometry_hash", F.sha2(geometry, 256))
