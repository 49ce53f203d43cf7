"""Line matching of faces with and without tables."""

import pytest

from formloom.operators import lines as L
from formloom.operators.lines import match_lines

PITCH, COUNT = 60, 8


@pytest.mark.parametrize(
    "block,axis,reason", [(None, None, ""), (None, "v", "edge_mismatch"), (None, "h", "edge_mismatch"), (0, "v", ""), (0, "h", "edge_mismatch")]
)
def test_edges(spark, block, axis, reason):
    """All lines of one axis lie one pitch further than printed, beyond the search limit."""
    expected = [("t", "f", a, i * PITCH, block, 24) for a in ("h", "v") for i in range(COUNT)]
    found = [("p", "f", a, i * PITCH + (PITCH if a == axis else 0)) for a in ("h", "v") for i in range(COUNT)]
    out = match_lines(
        spark.createDataFrame([("p", "t")], "page_id STRING, template_id STRING"),
        spark.createDataFrame(found, "page_id STRING, face_id STRING, axis STRING, pos INT"),
        spark.createDataFrame(expected, "template_id STRING, face_id STRING, axis STRING, pos INT, block_idx INT, limit INT"),
    )
    assert [r["reason"] for r in out.collect()] == [reason]


def test_expected_lines_follow_the_document(spark):
    """Search limits and the distance of rivals grow with the resolution; short sides of fields are no lines."""
    import json

    from formloom.sources.templates import expand_templates

    def form(name, dpi, faces):
        return json.dumps({"schema_version": 1, "template_id": name, "render_dpi": dpi, "image": {"width": 900, "height": 900}, "record": {"pages": 1}, "faces": faces})

    def face(fields=(), tables=()):
        return [{"face_id": "f", "source": {"page_offset": 0, "rect": {"x": 0, "y": 0, "w": 900, "h": 900}}, "exclusions": [], "fields": list(fields), "tables": list(tables)}]

    def field(i, x, y, w, h):
        return {"field_id": f"n{i}", "kind": "text", "rect": {"x": x, "y": y, "w": w, "h": h}}

    table = {
        "table_id": "t", "row_pitch": 50, "row_height": 44, "blocks": [{"origin": {"x": 10, "y": 100}, "rows": 2}],
        "columns": [{"name": "a", "kind": "text", "x_offset": 0, "width": 30}, {"name": "b", "kind": "text", "x_offset": 30, "width": 90}],
    }
    docs = [
        form("fields", 600, face([field(0, 100, 100, 200, 60), field(1, 50, 400, 300, 90)])),
        form("low", 150, face([field(0, 100, 100, 200, 15)])), form("table", 300, face(tables=[table])), form("blank", 300, face()),
    ]
    found = L.expected_lines(expand_templates(spark.createDataFrame([(d,) for d in docs], "body STRING")).faces).collect()
    got = {}
    for r in found:
        got.setdefault((r.template_id, r.axis), []).append((r.pos, r.limit, r.apart, r.block_idx, r.is_edge))
    assert sorted(got[("fields", "h")]) == [(100, 48, 8, None, True), (160, 48, 8, None, False), (400, 48, 8, None, False), (490, 48, 8, None, True)]
    assert sorted(got[("fields", "v")]) == [(50, 48, 8, None, True), (350, 48, 8, None, True)]  # sides of 80 px and more
    assert sorted(got[("low", "h")]) == [(100, 12, 2, None, True), (115, 12, 2, None, True)] and ("low", "v") not in got
    assert sorted(got[("table", "h")]) == [(100, 23, 4, 0, True), (150, 23, 4, 0, False), (200, 23, 4, 0, True)]
    assert sorted(got[("table", "v")]) == [(10, 13, 4, 0, False), (40, 13, 4, 0, False), (130, 13, 4, 0, False)]
    assert ("blank", "h") not in got
