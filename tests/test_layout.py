"""Segments, cells and tables on drawn forms."""

import random

from pyspark.sql import functions as F

from formloom.operators import lines as L
from formloom.operators import runs as U

SCHEMA = "page_id LONG, axis STRING, scan INT, s INT, e INT"


def h(page, y, x0, x1):
    return [(page, "h", y + k, x0, x1) for k in range(2)]


def v(page, x, y0, y1):
    return [(page, "v", x + k, y0, y1) for k in range(2)]


def frames(spark, runs, w=2000, ht=2000):
    segments = U.line_segments(spark.createDataFrame(runs, SCHEMA))
    return U.detect_frames(segments, w, ht)


def test_one_rectangle_and_an_l_shape(spark):
    one = h(1, 100, 100, 400) + h(1, 200, 100, 400) + v(1, 100, 100, 201) + v(1, 400, 100, 201)
    # page 2: an L made of three grid cells without inner walls
    ell = (h(2, 100, 100, 300) + h(2, 200, 200, 300) + h(2, 300, 100, 200)
           + v(2, 100, 100, 301) + v(2, 200, 200, 301) + v(2, 300, 100, 201))
    out = frames(spark, one + ell)
    cells = [(r["page_id"], r["y1"], r["x1"], r["y2"], r["x2"]) for r in out.cells.collect()]
    ledger = {r["page_id"]: r.asDict() for r in out.ledger.collect()}
    assert cells == [(1, 100.5, 100.5, 200.5, 400.5)]
    assert ledger[1]["cells"] == ledger[1]["rects"] == ledger[1]["components"] == 1
    assert ledger[2]["non_rectangular"] == 1 and ledger[2]["cells"] == 0
    for r in ledger.values():
        assert r["components"] == r["rects"] + r["non_rectangular"] + r["not_closed"]
        assert r["rects"] == r["cells"] + r["page_outline"] + r["too_small"]


def table(page, x, y, cols, rows, pitch, head=0):
    tops = [y] + ([y + head] if head else [])
    while len(tops) < rows + 1 + (1 if head else 0):
        tops.append(tops[-1] + pitch)
    right = x + cols * 100
    out = []
    for t in tops:
        out += h(page, t, x, right)
    for c in range(cols + 1):
        out += v(page, x + c * 100, tops[0], tops[-1] + 1)
    return out


def test_tables_and_headings(spark):
    runs = table(1, 100, 100, 3, 5, 80) + table(2, 100, 100, 3, 5, 80, head=140) + table(3, 100, 100, 2, 3, 70) + table(3, 600, 100, 3, 3, 70)
    out = frames(spark, runs)
    rows = U.table_rows(out.cells)
    got = {}
    for r in U.table_suggestions(rows).collect():
        got.setdefault(r["page_id"], []).append((r["rows"], len(r["columns"]), r["row_pitch"], r["row_height"], r["heading_excluded"]))
    assert got[1] == [(5, 3, 80.0, 80, False)]
    assert got[2] == [(5, 3, 80.0, 80, True)]
    assert sorted(got[3]) == [(3, 2, 70.0, 70, False), (3, 3, 70.0, 70, False)]
    cells = {r["page_id"]: r["cells"] for r in out.ledger.collect()}
    assert cells[1] == 15 and cells[2] == 18


def test_blocks_side_by_side(spark):
    """Two blocks on the same horizontal rails are two tables with the columns and cells of their own."""
    runs = table(1, 100, 100, 2, 2, 50) + table(1, 700, 100, 2, 2, 50)
    out = frames(spark, runs)
    found = sorted(U.table_suggestions(U.table_rows(out.cells)).collect(), key=lambda r: r["origin_x"])
    assert out.cells.count() == 8
    assert [(r["origin_x"], r["rows"], [(c["x_offset"], c["width"]) for c in r["columns"]], r["cell_indexes"]) for r in found] == [
        (100, 2, [(0, 100), (100, 100)], [0, 1, 4, 5]), (700, 2, [(0, 100), (100, 100)], [2, 3, 6, 7]),
    ]


def test_rail_scatter_is_residual(spark):
    """A line two pixels off the middle rail, far from the table, moves the rail and shows in the residual."""
    plain = table(1, 100, 100, 2, 2, 100) + table(2, 100, 100, 2, 2, 100) + h(2, 202, 700, 1100)
    got = {r["page_id"]: r["residual"] for r in U.table_suggestions(U.table_rows(frames(spark, plain).cells)).collect()}
    assert got[1] == 0.0 and abs(got[2] - 1.0) <= 0.3


def test_pitch_breaks_a_run(spark):
    """Rows at another pitch are another table; the row at the border stays with the first one."""
    rows = [(1, float(y), y + 30.0, 0, 10.0, [10.0, 60.0], 0.0, 1, [i]) for i, y in enumerate((0, 40, 80, 150, 220, 290))]
    schema = "page_id LONG, y1 DOUBLE, y2 DOUBLE, part LONG, x_first DOUBLE, bounds ARRAY<DOUBLE>, residual DOUBLE, cells LONG, cell_indexes ARRAY<INT>"
    got = sorted((r["origin_y"], r["rows"], r["row_pitch"], r["cell_indexes"]) for r in U.table_suggestions(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 3, 40.0, [0, 1, 2]), (150, 3, 70.0, [3, 4, 5])]


def test_linked_parts():
    """Chains of any order are one part each; parts are numbered by their first member."""
    rnd = random.Random(5)
    for _ in range(50):
        n = rnd.randrange(1, 40)
        links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(0, n))]
        part = list(range(n))
        for a, b in links:
            part = [part[b] if x == part[a] else x for x in part]
        names = list(dict.fromkeys(part))
        a, b = (U.np.array([link[k] for link in links], int) for k in (0, 1))
        assert U.linked(n, a, b).tolist() == [names.index(x) for x in part]


def test_too_many_rails(spark):
    rows = [(1, "h", float(i * 10), 0, 500, 1) for i in range(205)] + [(1, "v", float(i * 100), 0, 2100, 1) for i in range(3)]
    segments = spark.createDataFrame(rows, U.SEGMENT_SCHEMA)
    out = U.detect_frames(segments, 3000, 3000, max_rails=200)
    assert [r["zero_reason"] for r in out.ledger.collect()] == ["too_many_lines"]
    assert out.cells.count() == 0


def test_no_rail_limit_by_default(spark):
    """A page of 301 by 3 rails has all its 300 by 2 cells."""
    rows = [(1, "h", float(i * 30), 0, 200, 1) for i in range(301)] + [(1, "v", float(i * 100), 0, 9000, 1) for i in range(3)]
    out = U.detect_frames(spark.createDataFrame(rows, U.SEGMENT_SCHEMA), 10_000, 10_000)
    assert out.cells.count() == 600
    assert [r["zero_reason"] for r in out.ledger.collect()] == [None]


def brute_segments(runs):
    """Runs of one page and axis: bridge, link, drop blobs, join collinear pieces."""
    ink = {}
    for scan, s, e in runs:
        ink.setdefault(scan, set()).update(range(s, e + 1))
    parts = []
    for scan in sorted(ink):
        xs = sorted(ink[scan])
        spans = [[xs[0], xs[0]]]
        for x in xs[1:]:
            if x - spans[-1][1] - 1 <= 4:
                spans[-1][1] = x
            else:
                spans.append([x, x])
        if spans[0][0] <= 4:
            spans[0][0] = 0
        parts += [(scan, a, b) for a, b in spans if b - a + 1 >= 60]
    groups = [{i} for i in range(len(parts))]
    for i, (y, a, b) in enumerate(parts):
        for j, (z, c, d) in enumerate(parts):
            if z == y + 1 and min(b, d) - max(a, c) + 1 >= 0.5 * min(b - a + 1, d - c + 1):
                gi = next(g for g in groups if i in g)
                gj = next(g for g in groups if j in g)
                if gi is not gj:
                    gi |= gj
                    groups.remove(gj)
    bundles = []
    for g in sorted(groups, key=min):
        ys = [parts[i][0] for i in g]
        if len(set(ys)) <= 12:
            bundles.append([round(sum(ys) / len(ys), 1), min(parts[i][1] for i in g), max(parts[i][2] for i in g), len(set(ys))])
    free, lines = set(range(len(bundles))), []
    while free:
        line = {free.pop()}
        while new := {i for i in free for b in (bundles[j] for j in line) if abs(bundles[i][0] - b[0]) <= 2 and max(bundles[i][1] - b[2], b[1] - bundles[i][2]) - 1 <= 12}:
            line |= new
            free -= new
        own = [bundles[i] for i in sorted(line)]
        pixels = sum(b[2] - b[1] + 1 for b in own)
        at = round(sum(b[0] * (b[2] - b[1] + 1) for b in own) / pixels, 1)
        lines.append((at, min(b[1] for b in own), max(b[2] for b in own), max(b[3] for b in own)))
    return sorted(lines)


def test_segments_against_brute_force(spark):
    rnd = random.Random(3)
    pages = {}
    for page in range(4):
        rows = []
        for _ in range(120):
            s = rnd.randrange(0, 400)
            rows.append((rnd.randrange(0, 60), s, s + rnd.randrange(20, 140)))
        pages[page] = rows
    # a filled block on the last page is no line
    pages[3] += [(y, 500, 700) for y in range(20, 40)]
    df = spark.createDataFrame([(p, "h", *r) for p, rows in pages.items() for r in rows], SCHEMA)
    got = {}
    for r in U.line_segments(df).collect():
        got.setdefault(r["page_id"], []).append((r["pos"], r["start"], r["end"], r["thickness"]))
    for p, rows in pages.items():
        assert sorted(got.get(p, [])) == brute_segments(rows)


def test_otsu_defaults(spark):
    hist = spark.createDataFrame([("one", 7, 5), ("two", 10, 5), ("two", 200, 5)], "k STRING, bin INT, n LONG")
    got = {r["k"]: r["threshold"] for r in L.otsu_threshold(hist, ["k"]).collect()}
    assert got == {"one": 128, "two": 10}


def test_page_edge_holes(spark):
    df = spark.createDataFrame([(1, "h", 5, 3, 80, 90), (2, "h", 5, 3, 80, 84)], SCHEMA + ", width INT")
    got = {r["page_id"]: (r["s"], r["e"]) for r in U.bridged_runs(df, extent="width").collect()}
    assert got == {1: (0, 80), 2: (0, 83)}


def test_option_bands(spark):
    import json

    from formloom.sources.templates import expand_templates
    from test_forms import rect, template

    doc = template([
        {"field_id": "era", "kind": "choice", "rect": rect(100, 100, 60, 40),
         "choice_marks": [{"value": "A", "rect": rect(105, 100, 50, 20)}, {"value": "B", "rect": rect(105, 120, 50, 20)}]},
        {"field_id": "next", "kind": "text", "rect": rect(161, 100, 50, 40)},
    ], tid="o")
    cells = expand_templates(spark.createDataFrame([(json.dumps(doc),)], "body STRING")).cells
    # full ink right of the first mark, from 149 to the end of the slack and beyond
    runs = spark.createDataFrame([(1, "o", y, 149, 180) for y in range(100, 120)] + [(1, "o", 110, 149, 150)],
                                 "page_id LONG, template_id STRING, scan INT, s INT, e INT")
    plain = {r["option"]: r["score"] for r in U.band_ink_ratio(runs, cells.filter("size(marks) > 0"), 1800, 1200).collect()}
    cut = {r["option"]: r["score"] for r in U.band_ink_ratio(runs, U.with_occluders(cells), 1800, 1200).collect()}
    # left band 97..111, right band 149..163; with the neighbour at 161 the right one ends there
    assert plain == {"A": 14 / 28, "B": 0.0}
    assert cut == {"A": 12 / 26, "B": 0.0}
