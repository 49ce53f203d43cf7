"""Queries over templates and tables of rects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.functions.scalars import expected_digits
from formloom.operators import lint as L
from formloom.plans import fixtures as X
from formloom.plans.catalog import Entry
from formloom.sources.templates import TemplateTables, expand_templates, packed_columns, receptors, template_hashes

KEYS = ["template_id"]


def _parts(spark: SparkSession, d: str) -> TemplateTables:
    return expand_templates(X.part_templates(spark, d))


def template_cells(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("rect")
    return _parts(spark, d).cells.select(
        "template_id", "cell_ord", "face_id", "field_id", "kind", r["x"].alias("x"), r["y"].alias("y"),
        r["w"].alias("w"), r["h"].alias("h"), "table_id", "row_no", "output", "normalize",
        F.array_join("subfields", ",").alias("subs"),
    )


def template_receptors(spark: SparkSession, d: str) -> DataFrame:
    return receptors(_parts(spark, d).cells).select(
        "template_id", "face_id", "field_id", "kind", "region", "x", "y", "w", "h", F.col("priority.layer").alias("layer")
    )


def template_output_columns(spark: SparkSession, d: str) -> DataFrame:
    return packed_columns(_parts(spark, d).packed).select("template_id", "col_ord", "column")


def template_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Expected lines and zones of every face."""
    faces = _parts(spark, d).faces
    return faces.select(
        "template_id", "face_id", "is_table", F.col("source.y").alias("source_y"), F.size("exclusions").alias("exclusions"),
        F.array_join(F.flatten(F.transform("geoms", lambda g: g["h_lines"])).cast("array<string>"), ",").alias("h_lines"),
        F.array_join(F.flatten(F.transform("geoms", lambda g: g["v_lines"])).cast("array<string>"), ",").alias("v_lines"),
        F.coalesce(F.array_join(F.transform("zones", lambda z: z["bottom"]).cast("array<string>"), ","), F.lit("")).alias("bottoms"),
    )


def digit_fields(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(
        [(r"郵便番号\s*\d*\s*$", 7, "postal code")], "pattern STRING, digits INT, rule STRING"
    )
    return expected_digits(_parts(spark, d).cells, rules).select("template_id", "field_id", "digits", "rule")


def template_profiles(spark: SparkSession, d: str) -> DataFrame:
    return L.template_profile(_parts(spark, d))


def template_checks(spark: SparkSession, d: str) -> DataFrame:
    """Templates of every third part miss their first amount, those of every fifth their stamp; all must have the columns that their part's size asks for."""
    p = F.col("p_partkey")
    docs = X.part_templates(spark, d)
    total, stamp = r'\{"field_id": "total"[^}]*\}, "normalize": "amount"\}, ', r'\{"id": "stamp", "rect": \{[^}]*\}\}'
    body = F.when(p % 3 == 0, F.regexp_replace("body", total, "")).otherwise(F.col("body"))
    docs = docs.withColumn("body", F.when(p % 5 == 0, F.regexp_replace(body, stamp, "")).otherwise(body))
    expected = X.table(spark, d, "part").select(F.concat(F.lit("form-"), p.cast("string")).alias("template_id"), F.col("p_size").alias("expect_columns"))
    found = L.template_check(expand_templates(docs), expected, meta=6)
    faces = F.transform("exclusions_by_face", lambda f: F.concat(f["face_id"], F.lit(":"), f["n"].cast("string")))
    return found.select("template_id", "cells", "columns", "amount_cells", "exclusions", F.array_join(faces, ",").alias("faces"), F.array_join("column_names", ",").alias("names"), "reason", "ok")


def template_regressions(spark: SparkSession, d: str) -> DataFrame:
    """Templates of larger parts lose their first field."""
    before = X.part_templates(spark, d)
    doc = F.regexp_replace(
        "body", r'\{"field_id": "total"[^}]*\}, "normalize": "amount"\}, ', ""
    )
    after = before.withColumn("body", F.when(F.col("p_partkey") % 2 == 0, doc).otherwise(F.col("body")))
    return L.template_regression(
        L.template_profile(expand_templates(before)), L.template_profile(expand_templates(after))
    )


def disabled_runs(spark: SparkSession, d: str) -> DataFrame:
    """Templates with more cells switched off, by part number."""
    docs = X.part_templates(spark, d)
    off = F.when(
        F.col("p_partkey") % 3 == 0,
        F.lit('[{"row_no": 1, "column": "num"}, {"row_no": 2, "column": "num"}, {"row_no": 3, "column": "num"}, {"row_no": 4, "column": "num"}, {"row_no": 1, "column": "memo"}, {"row_no": 3, "column": "memo"}]'),
    ).otherwise(F.lit('[{"row_no": 2, "column": "memo"}]'))
    body = F.regexp_replace(F.col("body"), F.lit(r'\[\{"row_no": 2, "column": "memo"\}\]'), off)
    return L.disabled_runs(expand_templates(docs.withColumn("body", body)).cells).drop("table_id", "block_idx")


def template_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    """Templates that share their content or geometry, whatever the order of keys and spaces."""
    docs = X.part_templates(spark, d)
    same = F.regexp_replace("body", r'"template_id": "[^"]*", ', "")
    spaced = F.when(F.col("p_partkey") % 2 == 0, F.regexp_replace(same, ": ", ":")).otherwise(same)
    moved = F.concat(F.regexp_replace(spaced, r'^\{"schema_version": ?1, ', "{"), F.lit(""))
    body = F.regexp_replace(moved, r"\}$", ', "schema_version": 1}')
    hashes = template_hashes(docs.withColumn("body", F.when(F.col("p_partkey") % 2 == 0, body).otherwise(same)))
    t = hashes.groupBy("template_hash").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))
    g = hashes.groupBy("geometry_hash").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))
    return t.select(F.lit("template").alias("what"), "n", "first").unionByName(
        g.select(F.lit("geometry").alias("what"), "n", "first")
    )


def receptor_overlaps(spark: SparkSession, d: str) -> DataFrame:
    places = X.rects(spark, d).withColumnRenamed("ord", "ident")
    return L.receptor_overlaps(places, KEYS)


def adjacent_gaps(spark: SparkSession, d: str) -> DataFrame:
    return L.adjacent_gaps(X.rects(spark, d).withColumnRenamed("ord", "ident"), KEYS)


def hole_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return L.hole_overlaps(X.rects(spark, d), KEYS)


def exclusion_coverage(spark: SparkSession, d: str) -> DataFrame:
    main_field = F.col("ord").isin(0, 1, 2, 3, 4)
    places = X.rects(spark, d).withColumn("is_main", main_field).withColumn(
        "has_fallback", F.col("field_id") == "memo"
    ).withColumnRenamed("ord", "ident")
    stamp = F.explode(F.array(
        F.struct(F.lit(0).alias("excl"), F.lit(550).alias("x"), F.lit(90).alias("y"), F.lit(100).alias("w"), F.lit(90).alias("h")),
        F.struct(F.lit(1).alias("excl"), F.lit(1000).alias("x"), F.lit(780).alias("y"), F.lit(40).alias("w"), F.lit(300).alias("h")),
        F.struct(F.lit(2).alias("excl"), F.lit(620).alias("x"), F.lit(100).alias("y"), F.lit(400).alias("w"), F.lit(80).alias("h")),
    ))
    exclusions = X.table(spark, d, "part").select(F.col("p_partkey").alias("template_id"), stamp.alias("s")).select(
        "template_id", "s.*"
    )
    return L.exclusion_coverage(places, exclusions, KEYS).drop("kind")


def faces_and_marks(spark: SparkSession, d: str) -> DataFrame:
    """Forms are pushed right by their part number until something leaves its face or cell."""
    docs = X.part_templates(spark, d)
    far = F.concat(F.lit('"rect": {"x": '), (F.col("p_partkey") % 300 + 1300).cast("string"), F.lit(', "y": 200'))
    body = F.regexp_replace(F.col("body"), F.lit(r'"rect": \{"x": \d+, "y": 200'), far)
    mark = F.concat(F.lit('"value": "C", "rect": {"x": '), (F.col("p_partkey") % 13 + 1080 + F.col("p_partkey") % 50 * 3).cast("string"))
    body = F.regexp_replace(body, F.lit(r'"value": "C", "rect": \{"x": \d+'), mark)
    back = F.concat(F.lit('"rect": {"x": 0, "y": '), (700 - F.col("p_partkey") % 2).cast("string"))
    body = F.regexp_replace(body, F.lit(r'"rect": \{"x": 0, "y": 700'), back)
    tables = expand_templates(docs.withColumn("body", body)).settled()
    return (
        L.out_of_face(tables).select("template_id", F.lit("out_of_face").alias("problem"), "field_id", F.lit(0).alias("over"))
        .unionByName(L.stray_marks(tables).select("template_id", F.lit("mark").alias("problem"), "field_id", "over"))
        .unionByName(L.face_overlaps(tables).select("template_id", F.lit("faces").alias("problem"),
                                                    F.concat("face_a", F.lit("+"), "face_b").alias("field_id"), F.lit(0).alias("over")))
    )


def carve_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every rect of every template cut by one claim."""
    rect = F.struct("x", "y", "w", "h")
    p = F.col("template_id")
    claim = F.struct(
        (560 + p % 90).cast("int").alias("x"), (90 + p % 70).cast("int").alias("y"),
        F.lit(500).alias("w"), F.lit(60).alias("h"),
    )
    kind = F.when(F.col("field_id") == "zip", "choice").otherwise("text")
    rest = L.rest_of_rect(rect, claim)
    return X.rects(spark, d).select(
        "template_id", "ord", rest["pieces"].alias("pieces"), rest["area"].cast("int").alias("left_area"),
        L.carve_verdict([rect], claim, kind).alias("verdict"),
    )


def _cells_sql(tail: str) -> str:
    """part templates as relations: cells(num moved) from the form."""
    spec, places = [], []
    for o, face, fid, kind, tab, row, output, subs, norm, rects, fb in X._form_cells():
        spec.append(f"({o}, '{face}', '{fid}', '{kind}', {X._q(tab)}, {X._q(row)}, {str(output).lower()}, '{','.join(subs)}', {X._q(norm)}, {X._xy(rects[0])})")
        for i, r in enumerate(rects):
            places.append(f"(0, {i}, 'region', '{face}', '{fid}', {X._xy(r)})")
        if fb:
            places.append(f"(1, 0, 'fallback', '{face}', '{fid}', {X._xy(fb)})")
        if len(rects) > 1:
            x0 = min(int(str(r["x"]).lstrip("+")) for r in rects)
            y0 = min(r["y"] for r in rects)
            x1 = max(int(str(r["x"]).lstrip("+")) + r["w"] for r in rects)
            y1 = max(r["y"] + r["h"] for r in rects)
            places.append(f"(2, 0, 'hole', '{face}', '{fid}', {x0}, 1, {y0}, {x1 - x0}, {y1 - y0})")
    return f"""WITH spec(ord, face_id, field_id, kind, table_id, row_no, output, subs, norm, x, moved, y, w, h) AS (VALUES {", ".join(spec)}),
 place(layer, region, kind, face_id, field_id, x, moved, y, w, h) AS (VALUES {", ".join(places)}),
 t AS (SELECT 'form-' || p_partkey AS template_id, p_partkey, p_partkey % 50 * {X.STEP} AS dx FROM part) {tail}"""


_N_CELLS = len(X._form_cells())
_OUT = [c for c in X._form_cells() if c[6]]
_N_COLS = sum(max(1, len(c[7])) for c in _OUT)
_N_AMOUNT = sum(1 for c in X._form_cells() if c[8] == "amount")
_N_OFF = _N_CELLS - len(_OUT)
_NAMES = ",".join(n for c in _OUT for n in ([f"{c[2]}_{part}" for part in c[7]] or [c[2]]))
_RECT = f"WITH r AS ({X.RECT_SQL})"

ENTRIES = {
    "template_cells": Entry(
        template_cells,
        _cells_sql("""SELECT template_id, ord AS cell_ord, face_id, field_id, kind, x + moved * dx AS x, y, w, h, table_id, row_no, output, norm AS normalize, subs FROM t CROSS JOIN spec"""),
    ),
    "template_receptors": Entry(
        template_receptors,
        _cells_sql("SELECT template_id, face_id, field_id, kind, region, x + moved * dx AS x, y, w, h, layer FROM t CROSS JOIN place"),
    ),
    "template_output_columns": Entry(
        template_output_columns,
        _cells_sql(""", u AS (SELECT ord, field_id, unnest(string_split(subs, ',')) AS s, unnest(range(len(string_split(subs, ',')))) AS part FROM spec WHERE output)
 SELECT template_id, row_number() OVER (PARTITION BY template_id ORDER BY ord, part) - 1 AS col_ord, CASE WHEN s = '' THEN field_id ELSE field_id || '_' || s END AS "column" FROM t CROSS JOIN u"""),
    ),
    "template_geometry": Entry(
        template_geometry,
        """WITH t AS (SELECT 'form-' || p_partkey AS template_id, p_partkey % 50 * 3 AS dx FROM part)
 SELECT template_id, 'front' AS face_id, true AS is_table, 0 AS source_y, 1 AS exclusions, '260,340,420,500,260,340,420' AS h_lines,
  '100,300,450,850,1000,1200,1350,1750' AS v_lines, '490,410' AS bottoms FROM t
 UNION ALL SELECT template_id, 'back', false, 700, 0, '50,110,200,280,300,400',
  concat_ws(',', 500 + dx, 800 + dx, 1300 + dx, 1500 + dx, 100 + dx, 700 + dx), '' FROM t""",
    ),
    "digit_fields": Entry(
        digit_fields, "SELECT 'form-' || p_partkey AS template_id, '郵便番号' AS field_id, 7 AS digits, 'postal code' AS rule FROM part"
    ),
    "template_profiles": Entry(
        template_profiles,
        f"""SELECT 'form-' || p_partkey AS template_id, {_N_CELLS} AS cells, {_N_COLS} AS columns, {_N_AMOUNT} AS amount_cells, {_N_OFF} AS no_output_cells,
 1 AS exclusions, 0 AS duplicate_fields, 0 AS duplicate_columns, true AS usable FROM part""",
    ),
    "template_checks": Entry(
        template_checks,
        f"""WITH c AS (SELECT p_partkey AS k, p_size, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS gone, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS stamps FROM part)
 SELECT 'form-' || k AS template_id, {_N_CELLS} - gone AS cells, {_N_COLS} - gone + 6 AS columns, {_N_AMOUNT} - gone AS amount_cells, stamps AS exclusions,
 'front:' || stamps || ',back:0' AS faces, CASE WHEN gone = 1 THEN replace('{_NAMES}', ',total,', ',') ELSE '{_NAMES}' END AS names,
 CASE WHEN {_N_COLS} - gone + 6 < p_size THEN 'too_few_columns' ELSE '' END AS reason, {_N_COLS} - gone + 6 >= p_size AS ok FROM c""",
    ),
    "template_regressions": Entry(
        template_regressions,
        f"""SELECT 'form-' || p_partkey AS template_id, m.measure, m.was, m.was - 1 AS now FROM part CROSS JOIN
 (VALUES ('cells', {_N_CELLS}), ('amount_cells', {_N_AMOUNT}), ('columns', {_N_COLS})) AS m(measure, was) WHERE p_partkey % 2 = 0""",
    ),
    "disabled_runs": Entry(
        disabled_runs,
        """SELECT 'form-' || p_partkey AS template_id, m.c AS "column", m.a AS first_row, m.b AS last_row FROM part CROSS JOIN
 (VALUES (true, 'num', 1, 3), (true, 'num', 4, 4), (true, 'memo', 1, 1), (true, 'memo', 3, 3), (false, 'memo', 2, 2)) AS m(third, c, a, b) WHERE (p_partkey % 3 = 0) = m.third""",
    ),
    "template_hash_groups": Entry(
        template_hash_groups,
        """WITH p AS (SELECT p_partkey % 50 AS k, p_partkey FROM part)
 SELECT 'template' AS what, count(*) AS n, min(p_partkey) AS first FROM p GROUP BY k
 UNION ALL SELECT 'geometry', count(*), min(p_partkey) FROM p GROUP BY k""",
    ),
    "receptor_overlaps": Entry(
        receptor_overlaps,
        _RECT + """ SELECT a.template_id, a.field_id AS field_a, b.field_id AS field_b, a.ord AS ident_a, b.ord AS ident_b,
  CASE WHEN a.field_id = b.field_id THEN 'own_fallback' WHEN a.kind = 'region' AND b.kind = 'region' THEN 'regions'
   WHEN a.kind = 'fallback' AND b.kind = 'fallback' THEN 'fallbacks' ELSE 'fallback_region' END AS problem
 FROM r a JOIN r b ON a.template_id = b.template_id AND a.ord < b.ord AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h
 WHERE a.field_id <> b.field_id OR a.kind <> b.kind""",
    ),
    "adjacent_gaps": Entry(
        adjacent_gaps,
        _RECT + """, pair AS (SELECT a.template_id, a.ord AS ident_a, b.ord AS ident_b, a.field_id AS field_a, b.field_id AS field_b, a.x + a.w AS ar, b.x AS bx,
   greatest(a.y, b.y) AS lo, least(a.y + a.h, b.y + b.h) AS hi FROM r a JOIN r b ON a.template_id = b.template_id AND a.ord <> b.ord AND a.field_id <> b.field_id
   AND b.x - (a.x + a.w) >= 1 AND greatest(a.y, b.y) < least(a.y + a.h, b.y + b.h))
 SELECT template_id, ident_a, ident_b, field_a, field_b, bx - ar AS gap FROM pair p WHERE NOT EXISTS (SELECT 1 FROM r c WHERE c.template_id = p.template_id
   AND c.ord <> p.ident_a AND c.ord <> p.ident_b AND c.x < p.bx AND c.x + c.w > p.ar AND least(c.y + c.h, p.hi) > greatest(c.y, p.lo))""",
    ),
    "hole_overlaps": Entry(
        hole_overlaps,
        _RECT + """, b AS (SELECT template_id, field_id, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM r WHERE kind = 'region' GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT a.template_id, a.field_id AS field_a, b.field_id AS field_b FROM b a JOIN b ON a.template_id = b.template_id AND a.field_id < b.field_id
  AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""",
    ),
    "exclusion_coverage": Entry(
        exclusion_coverage,
        _RECT + """, e(x, y, w, h) AS (VALUES (550, 90, 100, 90), (1000, 780, 40, 300), (620, 100, 400, 80)),
 s AS (SELECT r.template_id, r.ord AS ident, r.field_id, r.kind, r.w * r.h AS area,
   sum(greatest(0, least(r.x + r.w, e.x + e.w) - greatest(r.x, e.x)) * greatest(0, least(r.y + r.h, e.y + e.h) - greatest(r.y, e.y))) AS sh FROM r CROSS JOIN e GROUP BY ALL)
 SELECT template_id, ident, field_id, least(sh, area)::BIGINT AS covered, least(sh, area)::DOUBLE / area AS ratio,
  sh >= area OR kind = 'fallback' OR (field_id = 'memo' AND ident < 5) AS strong FROM s WHERE sh > 0""",
    ),
    "faces_and_marks": Entry(
        faces_and_marks,
        """WITH p AS (SELECT 'form-' || p_partkey AS template_id, p_partkey AS k, p_partkey % 50 * 3 AS dx FROM part)
 SELECT template_id, 'out_of_face' AS problem, '郵便番号' AS field_id, 0 AS over FROM p WHERE k % 300 + 1300 + 200 > 1800
 UNION ALL SELECT template_id, 'mark', 'era', (k % 13 + 1080 + dx + 40 - 1000 - dx - 120)::INT FROM p WHERE k % 13 > 4
 UNION ALL SELECT template_id, 'faces', 'front+back', 0 FROM p WHERE k % 2 = 1""",
    ),
    "carve_verdicts": Entry(
        carve_verdicts,
        _RECT + """, c AS (SELECT *, 560 + template_id % 90 AS cx, 90 + template_id % 70 AS cy FROM r),
 i AS (SELECT *, greatest(x, cx) AS x0, greatest(y, cy) AS y0, least(x + w, cx + 500) AS x1, least(y + h, cy + 60) AS y1 FROM c),
 b AS (SELECT *, x1 <= x0 OR y1 <= y0 AS apart, y0 - y AS top, y + h - y1 AS bottom, x0 - x AS lft, x + w - x1 AS rgt, y1 - y0 AS ih FROM i),
 q AS (SELECT *, CASE WHEN apart THEN [{'w': w, 'h': h}] ELSE list_concat(list_filter([{'w': w, 'h': top}, {'w': w, 'h': bottom}], lambda v: v.h >= 6), list_filter([{'w': lft, 'h': ih}, {'w': rgt, 'h': ih}], lambda v: v.w >= 6 AND v.h >= 6)) END AS ps FROM b),
 a AS (SELECT *, coalesce(list_sum(list_transform(ps, lambda v: v.w * v.h)), 0) AS left_area FROM q),
 m AS (SELECT *, list_filter(ps, lambda v: v.w * v.h = list_max(list_transform(ps, lambda u: u.w * u.h)))[1] AS big, floor((1 - left_area::DOUBLE / (w * h)) * 100 + 0.5) AS lost FROM a)
 SELECT template_id, ord, len(ps) AS pieces, left_area::BIGINT AS left_area, CASE WHEN field_id = 'zip' OR len(ps) = 0 OR big.w < 27 OR big.h < 36 OR lost >= 30 THEN 'skip' WHEN lost >= 10 THEN 'warn' ELSE 'auto' END AS verdict FROM m""",
    ),
}
