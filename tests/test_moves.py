"""Symbols on pages with moved blocks against a document that is moved by hand for each page."""

import copy
import json
import random

from formloom.operators import assignment as A
from formloom.sources.templates import expand_templates

MOVES = "page_id LONG, template_id STRING, face_id STRING, applied BOOLEAN, blocks ARRAY<STRUCT<block_idx INT, dy INT>>"
SYMBOLS = "page_id LONG, template_id STRING, page_no INT, seq INT, text STRING, conf DOUBLE, x DOUBLE, y DOUBLE"


def rect(x, y, w, h):
    return {"x": x, "y": y, "w": w, "h": h}


def column(name, x):
    return {"name": name, "kind": "text", "x_offset": x, "width": 40}


def table(name, blocks):
    return {
        "table_id": name, "row_pitch": 30, "row_height": 24, "columns": [column("a", 0), column("b", 45)],
        "blocks": [{"origin": {"x": x, "y": y}, "rows": n} for x, y, n in blocks],
    }


DOC = {
    "schema_version": 1, "template_id": "t", "render_dpi": 300, "image": {"width": 600, "height": 400}, "record": {"pages": 1},
    "faces": [
        {
            "face_id": "front", "source": {"page_offset": 0, "rect": rect(0, 0, 600, 400)},
            "exclusions": [{"id": "e", "rect": rect(500, 10, 50, 50)}],
            "fields": [
                {"field_id": "split", "kind": "text", "rect": rect(300, 40, 60, 20), "extra_rects": [rect(380, 70, 60, 20)], "fallback_rect": rect(10, 200, 90, 40)},
            ],
            "tables": [table("p", [(10, 50, 3), (120, 60, 2)]), table("q", [(300, 150, 4)])],
        },
    ],
}


def placed(spark, doc, symbols, moves=None):
    tables = expand_templates(spark.createDataFrame([(json.dumps(doc),)], "body STRING")).settled()
    local, reach = A.to_face_local(symbols, tables), 0
    if moves is not None:
        local, reach = A.with_moves(local, moves, tables)
    columns = ("page_id", "seq", "x", "y", "kind", "field_id", "region", "probe_field")
    got = A.assign_symbols(local, tables, reach=reach)
    assert "moves" not in got.columns
    return sorted(map(tuple, got.select(*columns).collect())), reach


def test_moved_blocks_against_moved_documents(spark):
    rnd = random.Random(4)
    want, rows, moves, changed = [], [], [], 0
    plans = [(True, [3, -7, 0]), (True, [-12, 12, 9]), (False, [5, 5, 5]), (True, [4, 4]), (True, [1, 2, 3, 4]), (True, [0, 0, 0]), (True, None), (None, None)]
    for page, (applied, dys) in enumerate(plans):
        own = [
            (page, "t", 1, i, "x", 0.9, float(rnd.choice([rnd.randrange(0, 460), 20, 130, 310])), float(rnd.randrange(0, 330)))
            for i in range(250)
        ] + [(page, "t", 1, 250, "x", 0.9, 20.0, 60.0)] * 2
        rows += own
        if applied is not None:
            blocks = None if dys is None else list(enumerate(dys))[::-1]
            moves.append((page, "t", "front", applied, blocks))
        doc = copy.deepcopy(DOC)
        if applied and dys and len(dys) == 3:
            flat = [b for t in doc["faces"][0]["tables"] for b in t["blocks"]]
            for b, dy in zip(flat, dys, strict=True):
                b["origin"]["y"] += dy
        symbols = spark.createDataFrame(own, SYMBOLS)
        by_hand = placed(spark, doc, symbols)[0]
        changed += by_hand != placed(spark, DOC, symbols)[0]
        want += by_hand
    symbols, moves = spark.createDataFrame(rows, SYMBOLS), spark.createDataFrame(moves, MOVES)
    got, reach = placed(spark, DOC, symbols, moves)
    assert got == sorted(want, key=lambda r: r) and reach == 12 and changed == 2
    assert {r[4] for r in got} == {"region", "fallback", "hole", "below_table", "other"}
    still, reach = placed(spark, DOC, symbols, moves.limit(0))
    assert reach == 0 and still == placed(spark, DOC, symbols)[0]
    assert placed(spark, DOC, symbols.limit(0), moves)[0] == []
