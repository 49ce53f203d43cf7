"""Template checks, empty digit fields and column names, on small literal cases."""

import json

from formloom.operators import assignment as A
from formloom.operators import lint as L
from formloom.sources.templates import expand_templates


def rect(x, y, w, h):
    return {"x": x, "y": y, "w": w, "h": h}


def doc(tid, fields, tables=(), exclusions=0):
    face = {
        "face_id": "front", "source": {"page_offset": 0, "rect": rect(0, 0, 500, 500)}, "fields": fields, "tables": list(tables),
        "exclusions": [{"id": f"e{i}", "rect": rect(400, 50 * i, 20, 20)} for i in range(exclusions)],
    }
    back = {**face, "face_id": "a-back", "fields": [], "tables": [], "exclusions": [], "source": {"page_offset": 0, "rect": rect(0, 500, 500, 500)}}
    return json.dumps({"schema_version": 1, "template_id": tid, "render_dpi": 300, "image": {"width": 500, "height": 1000}, "record": {"pages": 1}, "faces": [face, back]})


def text(fid, x):
    return {"field_id": fid, "kind": "text", "rect": rect(x, 0, 40, 20)}


def tables_of(spark, *docs):
    return expand_templates(spark.createDataFrame([(d,) for d in docs], "body STRING")).settled()


def test_template_check(spark):
    tables = tables_of(spark, doc("two", [text("b", 0), text("a", 50)], exclusions=2), doc("none", []), doc("twice", [text("a", 0), text("a", 50)]))
    expected = spark.createDataFrame([("two", 9), ("twice", 1), ("other", 3)], "template_id STRING, expect_columns INT")
    got = {r.template_id: r for r in L.template_check(tables, expected, meta=6).collect()}
    assert {t: (r.columns, r.reason, r.ok) for t, r in got.items()} == {"two": (8, "too_few_columns", False), "none": (6, "no_columns", False), "twice": (8, "duplicates", False)}
    assert got["two"].column_names == ["b", "a"] and got["none"].column_names == []
    assert [tuple(f) for f in got["two"].exclusions_by_face] == [("front", 2), ("a-back", 0)]
    free = L.template_check(tables, expected.limit(0))
    assert {r.template_id: r.ok for r in free.collect()} == {"two": True, "none": False, "twice": False}
    profile = {r.template_id: r for r in L.template_profile(tables).collect()}
    assert (profile["none"].cells, profile["none"].usable) == (0, False)


def test_disabled_runs_keep_names_with_digits(spark):
    columns = [{"name": n, "kind": "text", "x_offset": 50 * i, "width": 40} for i, n in enumerate(("no_01_x", "plain"))]
    table = {
        "table_id": "t_02_u", "row_pitch": 30, "row_height": 20, "blocks": [{"origin": rect(0, 50, 0, 0), "rows": 3}], "columns": columns,
        "output_disabled_cells": [{"row_no": r, "column": "no_01_x"} for r in (1, 2)] + [{"row_no": 3, "column": "plain"}],
    }
    runs = L.disabled_runs(tables_of(spark, doc("t", [], [table])).cells).collect()
    assert sorted((r["column"], r.first_row, r.last_row) for r in runs) == [("no_01_x", 1, 2), ("plain", 3, 3)]


def test_empty_main(spark):
    tables = tables_of(spark, doc("t", [text("zip1", 0), text("zip2", 50)]), doc("u", [text("name", 0)]))
    targets = tables.cells.filter("field_id LIKE 'zip%'").selectExpr("template_id", "face_id", "field_id", "rect", "7 AS digits")
    spots = [(1, "t", 5.0, 5.0), (1, "t", 6.0, 5.0), (2, "t", 300.0, 300.0), (3, "t", 5.0, 5.0), (3, "t", 55.0, 5.0), (4, "t", 5.0, 600.0), (5, "u", 5.0, 5.0), (6, "t", 900.0, 5.0)]
    symbols = spark.createDataFrame([(p, t, i, x, y) for i, (p, t, x, y) in enumerate(spots)], "page_id LONG, template_id STRING, seq INT, x DOUBLE, y DOUBLE")
    local = A.to_face_local(symbols, tables)
    got = sorted((r.page_id, r.targets, r.empty_main) for r in A.empty_main(local, tables, targets).collect())
    assert got == [(1, 2, 1), (2, 2, 2), (3, 2, 0), (4, 2, 2), (5, 0, 0)]
    assert A.empty_main(local.limit(0), tables, targets).count() == 0
