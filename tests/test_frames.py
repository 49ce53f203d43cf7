"""Ink around excluded rects, and cells on the faces of a template."""

import json
import random
from collections import defaultdict

from formloom.operators import frames as R
from formloom.operators import runs as U
from formloom.sources.templates import expand_templates

RUNS = "page_id LONG, axis STRING, scan INT, s INT, e INT, note STRING"
BOXES = "page_id LONG, boxes ARRAY<STRUCT<x: INT, y: INT, w: INT, h: INT>>"


def test_masked_runs_leave_the_other_pixels(spark):
    rnd = random.Random(3)
    runs = [(p, rnd.choice("hv"), rnd.randrange(12), s, s + rnd.randrange(20), "n") for p in range(6) for s in (rnd.randrange(30) for _ in range(25))]
    boxes = [(p, [(rnd.randrange(-3, 30), rnd.randrange(-3, 12), rnd.randrange(0, 9), rnd.randrange(0, 9)) for _ in range(p)]) for p in range(4)] + [(4, None)]
    out = R.masked_runs(spark.createDataFrame(runs, RUNS), spark.createDataFrame(boxes, BOXES)).collect()

    def excluded(page, x, y):
        return any(bx <= x < bx + w and by <= y < by + h for bx, by, w, h in dict(boxes).get(page) or [])

    want, got = defaultdict(int), defaultdict(int)
    for p, axis, scan, s, e, _ in runs:
        for at in range(s, e + 1):
            if not excluded(p, *((at, scan) if axis == "h" else (scan, at))):
                want[p, axis, scan, at] += 1
    for r in out:
        assert r.s <= r.e and r.note == "n"
        for at in range(r.s, r.e + 1):
            got[r.page_id, r.axis, r.scan, at] += 1
    assert got == want and len(out) > 100


def form(faces):
    made = [
        {"face_id": i, "source": {"page_offset": 0, "rect": dict(zip("xywh", rect))}, "exclusions": [{"id": "e", "rect": dict(zip("xywh", e))} for e in out],
         "fields": [{"field_id": f"{i}{n}", "kind": "text", "rect": dict(zip("xywh", f))} for n, f in enumerate(fields)], "tables": []}
        for i, rect, out, fields in faces
    ]
    return json.dumps({"schema_version": 1, "template_id": "t", "render_dpi": 300, "image": {"width": 400, "height": 400}, "record": {"pages": 1}, "faces": made})


def test_frames_on_faces(spark):
    """Three cells in a row: one on the left face, one across both, one on the right face, which is taken."""
    doc = form([("l", (0, 0, 150, 400), [(5, 6, 7, 8)], []), ("r", (150, 0, 250, 400), [(10, 20, 30, 40)], [(60, 20, 30, 30)])])
    tables = expand_templates(spark.createDataFrame([(doc,)], "body STRING")).settled()
    pages = spark.createDataFrame([(1, "t", 400, 400), (2, "t", 400, 400), (3, "none", 400, 400)], "page_id LONG, template_id STRING, page_w INT, page_h INT")
    grid = [("h", float(y), 20, 320, 2) for y in (20, 120)] + [("v", float(x), 20, 120, 2) for x in (20, 120, 200, 320)]
    found = R.page_frames(spark.createDataFrame([(p, *s) for p in (1, 3) for s in grid], U.SEGMENT_SCHEMA), pages, tables)
    cells = {(r.page_id, r.x1): (r.face, r.overlaps) for r in found.cells.collect()}
    assert cells == {(1, 20.0): ("l", False), (1, 200.0): ("r", True), (3, 20.0): (None, False), (3, 120.0): (None, False), (3, 200.0): (None, False)}
    ledger = {r.page_id: r for r in found.ledger.collect()}
    assert (ledger[1].cells, ledger[1].straddles_face, ledger[1].rects, ledger[1].zero_reason) == (2, 1, 3, None)
    assert (ledger[2].lines_h, ledger[2].zero_reason) == (0, "no_lines") and (ledger[3].cells, ledger[3].straddles_face) == (3, 0)
    for r in ledger.values():
        assert r.components == r.rects + r.non_rectangular + r.not_closed and r.rects == r.cells + r.page_outline + r.too_small + r.straddles_face
    crowded = R.page_frames(spark.createDataFrame([(1, *s) for s in grid], U.SEGMENT_SCHEMA), pages, tables, max_rails=3).ledger
    assert {r.page_id: r.zero_reason for r in crowded.collect()} == {1: "too_many_lines", 2: "no_lines", 3: "no_lines"}
    boxes = {r.page_id: r.boxes for r in R.page_exclusions(pages, tables).collect()}
    assert sorted(tuple(b) for b in boxes[1]) == [(5, 6, 7, 8), (160, 20, 30, 40)] and boxes[3] is None


def test_nothing(spark):
    tables = expand_templates(spark.createDataFrame([], "body STRING")).settled()
    pages = spark.createDataFrame([], "page_id LONG, template_id STRING, page_w INT, page_h INT")
    assert R.masked_runs(spark.createDataFrame([], RUNS), R.page_exclusions(pages, tables)).count() == 0
    found = R.page_frames(spark.createDataFrame([], U.SEGMENT_SCHEMA), pages, tables)
    assert found.cells.count() == found.ledger.count() == 0
