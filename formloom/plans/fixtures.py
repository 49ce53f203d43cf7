"""Inputs of the registered queries, derived from the given tables.

Each ``*_SQL`` text runs unchanged in Spark and in the checking engine.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.sources.templates import TemplateTables, expand_templates


PARTS_PER_TASK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widened(df: DataFrame) -> DataFrame:
    """Spread rows over the cores when the scan yields fewer tasks than there are cores.

    A table of many files already has enough tasks and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all parts, which grow to many rows each, in tasks of a bounded number of them."""
    keys = table(spark, sf_dir, "part").select("p_partkey")
    return keys.repartition(max(spark.sparkContext.defaultParallelism, -(-keys.count() // PARTS_PER_TASK)))


def from_sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Run fixture SQL over the named tables."""
    for n in names:
        text = re.sub(rf"\bFROM {n}\b", f"FROM {{{n}}}", text)
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


# One symbol per line item. ``seq`` breaks ties of position; symbols that share
# it at one position are the same character with the same confidence.
SYM_SQL = """
SELECT CAST(floor(l_orderkey / 25) AS BIGINT) AS page_id,
 concat('form-', CAST(CAST(floor(l_orderkey / 25) AS BIGINT) % 25 AS STRING)) AS template_id,
 l_partkey AS seq,
 CAST((l_partkey * 37 + l_linenumber * 211) % 1800 AS DOUBLE) AS x,
 CAST((l_suppkey * 53 + l_linenumber * 80 + l_partkey * 29) % 1200 AS DOUBLE) AS y,
 substr('0123456789,./山田花子', CAST(1 + l_partkey % 17 AS INT), 1) AS text,
 CAST(0.5 AS DOUBLE) + CAST(l_partkey % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS conf
FROM lineitem"""

# Pages are the groups of 25 order keys; the table of orders knows all of them.
PAGE_SQL = """
SELECT page_id, concat('form-', CAST(page_id % 25 AS STRING)) AS template_id,
 concat('scan_', CAST(page_id % 40 AS STRING), '.pdf') AS source_file,
 CAST(floor(page_id / 40) AS BIGINT) AS page_no
FROM (SELECT DISTINCT CAST(floor(o_orderkey / 25) AS BIGINT) AS page_id FROM orders) AS p"""

AMT_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE CAST(l_linenumber % 7 AS INT)
 WHEN 0 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)
 WHEN 1 THEN concat(CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS STRING), 3, '0'))
 WHEN 2 THEN concat(CAST(l_partkey AS STRING), '円')
 WHEN 3 THEN concat(CAST(l_partkey AS STRING), '.5')
 WHEN 4 THEN concat(' ', CAST(l_partkey AS STRING), ' ')
 WHEN 5 THEN concat(CAST(l_suppkey AS STRING), ' ', '000') ELSE '' END AS raw FROM lineitem"""

DATE_SQL = """
SELECT o_orderkey, concat(CAST(year(o_orderdate) AS STRING), CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '.' WHEN 1 THEN '/' WHEN 2 THEN ' - ' ELSE '' END, CAST(month(o_orderdate) AS STRING), '.', CAST(day(o_orderdate) AS STRING)) AS raw FROM orders"""

LINE_SQL = """
SELECT DISTINCT CAST(floor(l_orderkey / 25) AS BIGINT) AS page_id, CAST((l_partkey * 7) % 420 AS INT) AS pos FROM lineitem"""

# Lines found on the faces of a page: the printed ones, all moved by up to twenty
# pixels, the lower block by up to three more, besides stray positions.
FOUND_SQL = """
SELECT DISTINCT CAST(floor(l_orderkey / 25) AS BIGINT) AS page_id,
 CASE WHEN l_linestatus = 'O' THEN 'front' ELSE 'back' END AS face_id,
 CASE WHEN l_suppkey % 4 = 0 THEN 'v' ELSE 'h' END AS axis,
 CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE CAST(floor(l_partkey % 12 / 6) AS INT) END AS block_idx,
 CAST(CASE WHEN l_linenumber >= 2 THEN (l_partkey % 12) * 60 + CAST(floor(l_orderkey / 25) AS BIGINT) % 41 - 20
   + CASE WHEN l_partkey % 12 >= 6 AND l_suppkey % 4 <> 0 THEN CAST(floor(l_orderkey / 25) AS BIGINT) % 7 - 3 ELSE 0 END
  ELSE (l_partkey * 7) % 720 END AS INT) AS pos FROM lineitem"""

# Printed lines of ruled forms: twelve rows in two blocks, each with all twelve columns.
PRINTED_SQL = """
SELECT concat('form-', CAST(n_nationkey AS STRING)) AS template_id, f.face_id, a.axis, b.block_idx, CAST(i.i * 60 AS INT) AS pos, 28 AS lim
FROM nation CROSS JOIN (VALUES ('front'), ('back')) AS f(face_id) CROSS JOIN (VALUES ('h'), ('v')) AS a(axis) CROSS JOIN (VALUES (0), (1)) AS b(block_idx)
 CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) AS i(i) WHERE a.axis = 'v' OR i.i // 6 = b.block_idx"""


def ruled_form(blocks: list[tuple[int, int]], pitch: int, columns: int) -> str:
    """A document without an id: two faces with a table of blocks (top, rows), rows and columns at one pitch."""
    high = max(y + pitch * rows for y, rows in blocks) + pitch
    table_of = {
        "table_id": "t", "row_pitch": pitch, "row_height": pitch - 2, "blocks": [{"origin": {"x": 0, "y": y}, "rows": rows} for y, rows in blocks],
        "columns": [{"name": f"c{i}", "kind": "text", "x_offset": i * pitch, "width": pitch} for i in range(columns)],
    }
    faces = [
        {"face_id": f, "source": {"page_offset": 0, "rect": {"x": 0, "y": i * high, "w": 1800, "h": high}}, "exclusions": [], "fields": [], "tables": [table_of | {"table_id": f}]}
        for i, f in enumerate(("front", "back"))
    ]
    return json.dumps({"schema_version": 1, "template_id": "@id", "render_dpi": 300, "image": {"width": 1800, "height": 2 * high}, "record": {"pages": 1}, "faces": faces})


def ruled_tables(spark: SparkSession, sf_dir: str) -> TemplateTables:
    """A ruled form for each nation."""
    name = F.concat(F.lit("form-"), F.col("n_nationkey").cast("string"))
    docs = table(spark, sf_dir, "nation").select(F.replace(F.lit(ruled_form([(0, 5), (360, 5)], 60, 11)), F.lit("@id"), name).alias("body"))
    return expand_templates(docs)


RUN_SQL = """
SELECT CAST(floor(l_orderkey / 25) AS BIGINT) AS page_id, CAST(l_suppkey % 40 AS INT) AS scan,
 CAST(l_partkey % 500 AS INT) AS s, CAST(l_partkey % 500 + 40 + CAST(l_quantity AS BIGINT) AS INT) AS e FROM lineitem"""

# Ink of a ruled grid on every page: five by five lines drawn piece by piece.
INK_SQL = """
SELECT CAST(floor(l_orderkey / 25) AS BIGINT) AS page_id, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS axis,
 CAST(CASE WHEN l_linenumber % 2 = 0 THEN 20 + (l_partkey % 5) * 70 ELSE 50 + (l_partkey % 5) * 60 END + CAST(l_quantity AS BIGINT) % 2 AS INT) AS scan,
 CAST(CASE WHEN l_linenumber % 2 = 0 THEN 50 + (l_suppkey % 4) * 60 ELSE 20 + (l_suppkey % 4) * 70 END AS INT) AS s,
 CAST(CASE WHEN l_linenumber % 2 = 0 THEN 50 + (l_suppkey % 4) * 60 + 58 + CAST(l_quantity AS BIGINT) % 5 ELSE 20 + (l_suppkey % 4) * 70 + 68 + CAST(l_quantity AS BIGINT) % 5 END AS INT) AS e
FROM lineitem"""

# Forms for that grid: a left and a right face that meet at a place of their own, an excluded rect and a field on the left.
FRAME_SPLITS = (200, 165, 320)
FRAME_SIZE = (400, 360)
FRAME_BOX = {"x": 100, "y": 80, "w": 30, "h": 24}
FRAME_FIELD = {"x": 60, "y": 30, "w": 40, "h": 40}


def frame_tables(spark: SparkSession, sf_dir: str) -> TemplateTables:
    """A form with two faces for each nation."""

    def doc(split: int) -> str:
        w, h = FRAME_SIZE
        field = {"field_id": "a", "kind": "text", "rect": FRAME_FIELD}
        left = {"face_id": "left", "source": {"page_offset": 0, "rect": {"x": 0, "y": 0, "w": split, "h": h}}, "exclusions": [{"id": "e", "rect": FRAME_BOX}], "fields": [field], "tables": []}
        right = {"face_id": "right", "source": {"page_offset": 0, "rect": {"x": split, "y": 0, "w": w - split, "h": h}}, "exclusions": [], "fields": [], "tables": []}
        return json.dumps({"schema_version": 1, "template_id": "@id", "render_dpi": 300, "image": {"width": w, "height": h}, "record": {"pages": 1}, "faces": [left, right]})

    n = F.col("n_nationkey")
    body = F.element_at(F.array(*[F.lit(doc(x)) for x in FRAME_SPLITS]), (n % 3 + 1).cast("int"))
    docs = table(spark, sf_dir, "nation").select(F.replace(body, F.lit("@id"), F.concat(F.lit("form-"), n.cast("string"))).alias("body"))
    return expand_templates(docs).settled()


# Segments of the same grid, as they come out of the ink.
SEGMENT_SQL = """
SELECT CAST(floor(l_orderkey / 25) AS BIGINT) AS page_id, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS axis,
 CASE WHEN l_linenumber % 2 = 0 THEN 20 + (l_partkey % 5) * 70 ELSE 50 + (l_partkey % 5) * 60 END + CAST(CAST(l_quantity AS BIGINT) % 4 AS DOUBLE) / CAST(2 AS DOUBLE) AS pos,
 CAST(CASE WHEN l_linenumber % 2 = 0 THEN 48 + (l_suppkey % 4) * 60 ELSE 18 + (l_suppkey % 4) * 70 END AS BIGINT) AS start,
 CAST(CASE WHEN l_linenumber % 2 = 0 THEN 48 + (l_suppkey % 4) * 60 + 64 ELSE 18 + (l_suppkey % 4) * 70 + 74 END AS BIGINT) AS "end",
 CAST(1 AS BIGINT) AS thickness FROM lineitem"""

STATE_SQL = """
SELECT o_orderkey AS page_id, concat('scan_', lpad(CAST(o_custkey AS STRING), 6, '0'), '.pdf') AS source_file,
 CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'expanded' ELSE 'failed' END AS state,
 substr(o_orderpriority, 1, 1) AS template_hash, CAST(o_orderkey % 5 AS INT) AS below FROM orders"""

EVT_SQL = """
SELECT user_id, event_type AS opt, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS opt_ord,
 CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS score FROM events GROUP BY user_id, event_type"""

HIST_SQL = """
SELECT event_type AS grp, CAST(least(255, floor(value)) AS INT) AS bin, count(*) AS n FROM events GROUP BY 1, 2"""

REQ_SQL = """
SELECT event_id, CAST(date_trunc('day', ts) AS DATE) AS period, CAST(1 + event_id % 3 AS INT) AS units FROM events"""

DOC_SQL = """
SELECT doc_id, concat('open /home/u', CAST(doc_id AS STRING), '/a.csv and C:', chr(92), 'tmp', chr(92), 'my files', chr(92), 'b.txt or and/or KEY=/x/y ', text) AS line FROM documents"""

ROW_SQL = """
SELECT c_custkey AS page_id, CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN '' WHEN 1 THEN concat('=', c_name) WHEN 2 THEN concat(c_name, chr(7)) WHEN 3 THEN concat('-', c_mktsegment) ELSE c_name END AS raw,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) + CAST(c_custkey % 500 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS conf,
 CASE CAST(c_custkey % 9 AS INT) WHEN 0 THEN 'conflict' WHEN 1 THEN 'fallback' ELSE '' END AS origin,
 c_custkey % 13 = 0 AS is_empty FROM customer"""

# Rects of one template per part: fields whose widths grow until gaps close.
RECTS = [
    ("name", 0, 100, 100, 400, 80), ("date", 1, 600, 100, 300, 80), ("note", 2, 100, 750, 850, 150),
    ("zip", 3, 1000, 100, 200, 80), ("memo", 4, 980, 760, 300, 100), ("name", 5, 560, 130, 20, 30),
    ("note", 6, 100, 900, 400, 90), ("memo", 7, 900, 880, 90, 60), ("date", 8, 100, 820, 60, 40),
]
RECT_SQL = f"""
SELECT p_partkey AS template_id, f.field_id, f.ord, CASE WHEN f.ord = 7 THEN 'fallback' ELSE 'region' END AS kind,
 CAST(f.x + p_partkey % 11 * 7 AS INT) AS x, f.y AS y, CAST(f.w + p_partkey % 5 * 40 AS INT) AS w, f.h AS h, p_partkey % 4 <> 0 AS output
FROM part CROSS JOIN (VALUES {", ".join(map(str, RECTS))}) AS f(field_id, ord, x, y, w, h)"""


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RECT_SQL: every part explodes into the rects of its template."""
    p = F.col("p_partkey")
    listed = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(("field_id", "ord", "x", "y", "w", "h"), r)]) for r in RECTS
    ])
    return parts(spark, sf_dir).select("p_partkey", F.explode(listed).alias("f")).select(
        p.alias("template_id"), "f.field_id", "f.ord",
        F.when(F.col("f.ord") == 7, "fallback").otherwise("region").alias("kind"),
        (F.col("f.x") + p % 11 * 7).cast("int").alias("x"), "f.y",
        (F.col("f.w") + p % 5 * 40).cast("int").alias("w"), "f.h", (p % 4 != 0).alias("output"),
    )


SRC_SQL = """
SELECT concat('scan_', lpad(CAST(doc_id AS STRING), 6, '0'), '.pdf') AS name, sha256(text) AS hash, CAST(1 + doc_id % 3 AS BIGINT) AS n_pages FROM documents"""


# ---- the form used with SYM ------------------------------------------------
# Integers written as "+n" move right with the template number.
FORM = {
    "schema_version": 1,
    "template_id": "@id",
    "render_dpi": 300,
    "image": {"width": 1800, "height": 1200},
    "record": {"pages": 1},
    "faces": [
        {
            "face_id": "front",
            "source": {"page_offset": 0, "rect": {"x": 0, "y": 0, "w": 1800, "h": 700}},
            "exclusions": [{"id": "stamp", "rect": {"x": "+1500", "y": 20, "w": 200, "h": 100}}],
            "fields": [
                {"field_id": "name", "kind": "text", "rect": {"x": "+100", "y": 100, "w": 400, "h": 80}},
                {"field_id": "total", "kind": "text", "rect": {"x": "+600", "y": 100, "w": 300, "h": 80},
                 "normalize": "amount"},
                {"field_id": "era", "kind": "choice", "rect": {"x": "+1000", "y": 100, "w": 120, "h": 60},
                 "choice_marks": [
                     {"value": "A", "rect": {"x": "+1000", "y": 100, "w": 40, "h": 60}},
                     {"value": "B", "rect": {"x": "+1040", "y": 100, "w": 40, "h": 60}},
                     {"value": "C", "rect": {"x": "+1080", "y": 100, "w": 40, "h": 60}},
                 ]},
            ],
            "tables": [
                {
                    "table_id": "visit", "row_pitch": 80, "row_height": 70,
                    "blocks": [{"origin": {"x": 100, "y": 260}, "rows": 3},
                               {"origin": {"x": 1000, "y": 260}, "rows": 2}],
                    "columns": [
                        {"name": "day", "kind": "text", "x_offset": 0, "width": 200, "subfields": ["m", "d"]},
                        {"name": "num", "kind": "text", "x_offset": 200, "width": 150, "normalize": "amount"},
                        {"name": "memo", "kind": "text", "x_offset": 350, "width": 400},
                    ],
                    "output_disabled_cells": [{"row_no": 2, "column": "memo"}],
                }
            ],
        },
        {
            "face_id": "back",
            "source": {"page_offset": 0, "rect": {"x": 0, "y": 700, "w": 1800, "h": 500}},
            "exclusions": [],
            "fields": [
                {"field_id": "addr", "kind": "text", "rect": {"x": "+500", "y": 50, "w": 300, "h": 60},
                 "extra_rects": [{"x": "+900", "y": 70, "w": 250, "h": 60}, {"x": "+100", "y": 100, "w": 300, "h": 60}]},
                {"field_id": "郵便番号", "kind": "text", "rect": {"x": "+1300", "y": 200, "w": 200, "h": 80},
                 "fallback_rect": {"x": "+410", "y": 60, "w": 85, "h": 90}},
                {"field_id": "memo", "kind": "text", "rect": {"x": "+100", "y": 300, "w": 600, "h": 100},
                 "fallback_rect": {"x": "+100", "y": 420, "w": 300, "h": 60}, "output": False},
            ],
            "tables": [],
        },
    ],
}
STEP = 3  # px a form moves per template number


def _form_json(number: Column) -> Column:
    """The document of form ``number`` as a string column."""
    text = json.dumps(FORM, ensure_ascii=False)
    pieces = re.split(r'"(\+\d+|@id)"', text)
    out = []
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            out.append(F.lit(piece))
        elif piece == "@id":
            out.append(F.concat(F.lit('"form-'), number.cast("string"), F.lit('"')))
        else:
            out.append((F.lit(int(piece[1:])) + number * STEP).cast("string"))
    return reduce(lambda a, b: F.concat(a, b), [F.concat(*out)])


def form_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template document per nation; symbols refer to them by template id."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("form-"), n.cast("string")).alias("template_id"), _form_json(n).alias("body")
    )


def part_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template document per part."""
    p = F.col("p_partkey")
    return parts(spark, sf_dir).select(
        F.concat(F.lit("form-"), p.cast("string")).alias("template_id"), _form_json(p % 50).alias("doc"), "p_partkey"
    ).select(
        "template_id", "p_partkey",
        F.regexp_replace("doc", r'"template_id": "[^"]*"', F.concat(F.lit('"template_id": "'), "template_id", F.lit('"'))).alias("body"),
    )


def form_tables(spark: SparkSession, sf_dir: str) -> TemplateTables:
    return expand_templates(form_templates(spark, sf_dir)).settled()


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widened(from_sql(spark, sf_dir, SYM_SQL, "lineitem"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, PAGE_SQL, "orders")


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of the two table blocks of each page's front; some pages don't move, others have a block too many."""
    block = "struct(CAST({} AS INT) AS block_idx, CAST({} AS INT) AS dy)".format
    known, extra = f"{block(1, 'page_id * 5 % 19 - 9')}, {block(0, 'page_id * 7 % 19 - 9')}", block(2, 4)
    return pages(spark, sf_dir).selectExpr(
        "page_id", "template_id", "'front' AS face_id", "page_id % 3 <> 0 AS applied", f"IF(page_id % 5 = 1, array({known}, {extra}), array({known})) AS blocks"
    )


# ---- the same form as relations for the checking engine --------------------
def _form_cells() -> list[tuple]:
    """(ord, face, field, kind, table, row, output, columns, normalize, [rects], fallback) from FORM."""
    out: list[tuple] = []
    for face in FORM["faces"]:
        for f in face["fields"]:
            out.append((len(out), face["face_id"], f["field_id"], f["kind"], None, None, f.get("output", True), [],
                        f.get("normalize"), [f["rect"], *f.get("extra_rects", [])], f.get("fallback_rect")))
        for t in face["tables"]:
            row = 0
            off = {(d["row_no"], d["column"]) for d in t["output_disabled_cells"]}
            for b in t["blocks"]:
                for i in range(b["rows"]):
                    row += 1
                    for c in t["columns"]:
                        rect = {"x": b["origin"]["x"] + c["x_offset"], "y": b["origin"]["y"] + t["row_pitch"] * i,
                                "w": c["width"], "h": t["row_height"]}
                        out.append((len(out), face["face_id"], f"{t['table_id']}_{row:02d}_{c['name']}", c["kind"],
                                    t["table_id"], row, (row, c["name"]) not in off, c.get("subfields", []),
                                    c.get("normalize"), [rect], None))
    return out


def _xy(rect: dict) -> str:
    moved = isinstance(rect["x"], str)
    x = int(str(rect["x"]).lstrip("+"))
    return f"{x}, {1 if moved else 0}, {rect['y']}, {rect['w']}, {rect['h']}"


def _q(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def form_ctes() -> str:
    """CTEs sym, spec, places, local, hit, probe, placed for the checking engine."""
    places, spec, zones = [], [], []
    for o, face, fid, kind, tab, row, output, subs, norm, rects, fb in _form_cells():
        spec.append(f"({o}, '{face}', '{fid}', '{kind}', {_q(tab)}, {_q(row)}, {str(output).lower()}, "
                    f"{_q(','.join(subs))}, {_q(norm)}, {len(rects)})")
        for i, r in enumerate(rects):
            places.append(f"(0, {o}, {i}, 'region', '{face}', '{fid}', {str(output).lower()}, {_xy(r)})")
        if fb:
            places.append(f"(1, {o}, 0, 'fallback', '{face}', '{fid}', {str(output).lower()}, {_xy(fb)})")
        if len(rects) > 1:
            x0 = min(int(str(r["x"]).lstrip("+")) for r in rects)
            y0 = min(r["y"] for r in rects)
            x1 = max(int(str(r["x"]).lstrip("+")) + r["w"] for r in rects)
            y1 = max(r["y"] + r["h"] for r in rects)
            box = {"x": f"+{x0}", "y": y0, "w": x1 - x0, "h": y1 - y0}
            places.append(f"(2, {o}, 0, 'hole', '{face}', '{fid}', {str(output).lower()}, {_xy(box)})")
    for face in FORM["faces"]:
        for t in face["tables"]:
            right = max(c["x_offset"] + c["width"] for c in t["columns"])
            for b in t["blocks"]:
                ox, oy = b["origin"]["x"], b["origin"]["y"]
                zones.append(f"('{face['face_id']}', {ox}, {ox + right}, "
                             f"{oy + t['row_pitch'] * (b['rows'] - 1) + t['row_height']})")
    nl = ",\n  "
    return f"""
WITH sym AS ({SYM_SQL}),
spec(ord, face_id, field_id, kind, table_id, row_no, output, subs, norm, n_rects) AS (VALUES {nl.join(spec)}),
place0(layer, ord, region, kind, face_id, field_id, output, x0, moved, y, w, h) AS (VALUES {nl.join(places)}),
tpl AS (SELECT n_nationkey AS num, concat('form-', n_nationkey) AS template_id FROM nation),
places AS (SELECT p.*, p.x0 + p.moved * {STEP} * t.num AS x, t.template_id FROM place0 p CROSS JOIN tpl t),
zone(face_id, x_min, x_max, bottom) AS (VALUES {nl.join(zones)}),
faced AS (SELECT row_number() OVER () AS rid, s.*, CAST(substr(s.template_id, 6) AS INT) AS num,
  CASE WHEN s.y < 700 THEN 'front' ELSE 'back' END AS face_id FROM sym s),
local AS (SELECT rid, page_id, template_id, face_id, seq, text, conf, x, CASE WHEN face_id = 'back' THEN y - 700 ELSE y END AS y
  FROM faced WHERE NOT (face_id = 'front' AND x >= 1500 + num * {STEP} AND x < 1700 + num * {STEP} AND y >= 20 AND y < 120)),
cand AS (SELECT l.*, p.layer, p.ord, p.region, p.kind AS pkind, p.field_id FROM local l JOIN places p
  ON p.template_id = l.template_id AND p.face_id = l.face_id AND l.x >= p.x AND l.x < p.x + p.w AND l.y >= p.y AND l.y < p.y + p.h),
hit AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY rid ORDER BY layer, ord, region) = 1),
probe AS (SELECT rid, field_id AS probe_field, layer AS probe_layer FROM cand WHERE layer <> 1
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY layer, ord, region) = 1),
placed AS (SELECT l.*, coalesce(h.pkind, CASE WHEN EXISTS (SELECT 1 FROM zone z WHERE z.face_id = l.face_id AND l.x >= z.x_min AND l.x < z.x_max AND l.y >= z.bottom)
   THEN 'below_table' ELSE 'other' END) AS kind, h.field_id, h.region,
   CASE WHEN h.layer = 1 AND p.probe_layer = 2 THEN p.probe_field END AS probe_field
  FROM local l LEFT JOIN hit h USING (rid) LEFT JOIN probe p USING (rid)),
tally AS (SELECT page_id, field_id, count(*) FILTER (kind = 'region') AS n_main, count(*) FILTER (kind = 'fallback') AS n_fb
  FROM placed WHERE kind IN ('region', 'fallback') GROUP BY 1, 2),
decided AS (SELECT *, CASE WHEN n_main = 0 THEN 'fallback' WHEN n_main = 1 AND n_fb >= 2 THEN 'conflict' ELSE '' END AS origin FROM tally),
used AS (SELECT p.*, d.origin FROM placed p JOIN decided d USING (page_id, field_id)
  WHERE p.kind = CASE WHEN d.origin = 'fallback' THEN 'fallback' ELSE 'region' END),
broken AS (SELECT *, CASE WHEN y - lag(y) OVER w > 30 THEN 1 ELSE 0 END AS brk FROM used WINDOW w AS (PARTITION BY page_id, field_id, kind, region ORDER BY y, seq)),
lined AS (SELECT *, sum(brk) OVER (PARTITION BY page_id, field_id, kind, region ORDER BY y, seq ROWS UNBOUNDED PRECEDING) AS line FROM broken),
act AS (SELECT DISTINCT l.page_id, l.template_id, l.field_id, l.region, p.x AS rx, p.y AS ry, p.h AS rh FROM lined l JOIN places p
  ON p.template_id = l.template_id AND p.field_id = l.field_id AND p.region = l.region AND p.kind = 'region' WHERE l.kind = 'region'),
touch AS (SELECT a.page_id, a.field_id, a.region AS ra, b.region AS rb, b.ry FROM act a JOIN act b ON a.page_id = b.page_id AND a.field_id = b.field_id
  AND least(a.ry + a.rh, b.ry + b.rh) - greatest(a.ry, b.ry) >= 0.5 * least(a.rh, b.rh)),
touch2 AS (SELECT a.page_id, a.field_id, a.ra, min(b.ry) AS band FROM touch a JOIN touch b ON a.page_id = b.page_id AND a.field_id = b.field_id AND a.rb = b.ra GROUP BY 1, 2, 3),
keyed AS (SELECT l.*, coalesce(t.band, 0) AS band, coalesce(a.rx, 0) AS rx FROM lined l
  LEFT JOIN touch2 t ON l.kind = 'region' AND t.page_id = l.page_id AND t.field_id = l.field_id AND t.ra = l.region
  LEFT JOIN act a ON l.kind = 'region' AND a.page_id = l.page_id AND a.field_id = l.field_id AND a.region = l.region),
content AS (SELECT page_id, template_id, field_id, any_value(origin) AS origin, string_agg(text, '' ORDER BY band, rx, region, line, x, y, seq) AS raw,
  string_agg(CAST(CAST(round(conf * 100) AS INT) AS STRING), ',' ORDER BY band, rx, region, line, x, y, seq) AS confs, min(conf) AS conf FROM keyed GROUP BY 1, 2, 3),
lost AS (SELECT p.* FROM placed p JOIN decided d USING (page_id, field_id) WHERE p.kind = 'fallback' AND d.origin <> 'fallback'),
hole AS (SELECT page_id, template_id, field_id, count(*) AS holes FROM (
  SELECT page_id, template_id, field_id FROM placed WHERE kind = 'hole' UNION ALL
  SELECT page_id, template_id, probe_field FROM lost WHERE probe_field IS NOT NULL) u GROUP BY 1, 2, 3),
cell AS (SELECT coalesce(c.page_id, h.page_id) AS page_id, coalesce(c.template_id, h.template_id) AS template_id, coalesce(c.field_id, h.field_id) AS field_id,
  CASE WHEN h.holes > 0 THEN '〓' ELSE c.raw END AS raw, CASE WHEN h.holes > 0 THEN NULL ELSE c.conf END AS conf,
  CASE WHEN h.holes > 0 THEN '' ELSE c.origin END AS origin, CASE WHEN h.holes > 0 THEN '' ELSE c.confs END AS confs, coalesce(h.holes, 0) AS holes
  FROM content c FULL JOIN hole h ON c.page_id = h.page_id AND c.field_id = h.field_id),
page AS ({PAGE_SQL})
"""


def moved_ctes() -> str:
    """``form_ctes`` with table fields and table bottoms where ``moves`` has them: each page's places are its own."""
    dy = "CASE WHEN l.face_id = 'front' AND l.page_id % 3 <> 0 AND l.page_id % 5 <> 1 THEN CASE WHEN {} THEN l.page_id * 7 % 19 ELSE l.page_id * 5 % 19 END - 9 ELSE 0 END".format
    field = f"CASE WHEN p.field_id LIKE 'visit_%' THEN {dy("substr(p.field_id, 7, 2) <= '03'")} ELSE 0 END"
    text = form_ctes()
    for old, new in (
        ("l.y >= p.y AND l.y < p.y + p.h", f"l.y - ({field}) >= p.y AND l.y - ({field}) < p.y + p.h"),
        ("l.y >= z.bottom", f"l.y - ({dy('z.x_min = 100')}) >= z.bottom"),
    ):
        if text.count(old) != 1:
            raise ValueError(old)
        text = text.replace(old, new)
    return text
