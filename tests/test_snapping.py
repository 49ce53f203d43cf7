"""The gate for moved blocks against moved rects, and version diffs with one-sided pages and cells."""

import random

from formloom.operators import rows as R
from formloom.operators import snapping as G

RECTS = "template_id STRING, face_id STRING, block_idx INT, field_id STRING, x INT, y INT, w INT, h INT"
PLAN = "page_id LONG, template_id STRING, face_id STRING, outcome STRING, blocks ARRAY<STRUCT<block_idx INT, dy INT, reason STRING>>"


def meets(a, b, da=0, db=0):
    (_, _, xa, ya, wa, ha), (_, _, xb, yb, wb, hb) = a, b
    return xa < xb + wb and xb < xa + wa and ya + da < yb + db + hb and yb + db < ya + da + ha


def test_gate_against_moved_rects(spark):
    rnd = random.Random(11)
    forms = {
        f"t{t}": [(rnd.choice([None, 0, 1, 2]), f"f{i % 14}", rnd.randrange(0, 120), rnd.randrange(0, 200), rnd.randrange(5, 40), rnd.randrange(4, 25)) for i in range(18)]
        for t in range(4)
    }
    rects = spark.createDataFrame([(t, "front", *r) for t, rs in forms.items() for r in rs], RECTS)
    plans, want = [], {}
    for page in range(60):
        t, moves = f"t{page % 4}", {b: rnd.randrange(-6, 7) for b in range(3)}
        if page % 10 == 9:
            moves.pop(2)  # a block without a move stays
        plans.append((page, t, "front", "none", [(b, dy, "") for b, dy in moves.items()]))
        rs, dy = forms[t], lambda r: moves.get(r[0], 0)  # noqa: B023, E731
        want[page] = sum(
            a[1] != b[1] and not meets(a, b) and meets(a, b, dy(a), dy(b)) for i, a in enumerate(rs) for b in rs[:i]
        )
    plan = spark.createDataFrame(plans, PLAN)
    faces = spark.createDataFrame([(t, "front", 3) for t in forms], "template_id STRING, face_id STRING, n_blocks INT")
    estimates = plan.selectExpr("page_id", "template_id", "face_id", "'' AS reason")
    got = {r.page_id: r for r in G.snap_gate(faces, estimates, plan, G.overlap_index(rects, 12)).collect()}
    assert {p: r.new_pairs for p, r in got.items()} == want and 0 < sum(n > 0 for n in want.values()) < 60
    for page, r in got.items():
        assert (r.reason, r.applied) == (("overlap", False) if want[page] else ("", True))
        assert r.snap_px == (None if want[page] else max(abs(b[1]) for b in plans[page][4]))


def test_gate_reasons_and_counters(spark):
    blocks = [(0, 1, "")]
    plan = spark.createDataFrame(
        [(1, "a", "x", "excluded", blocks), (1, "a", "y", "failsafe", blocks), (2, "a", "x", "failsafe", blocks), (2, "a", "y", "none", blocks), (3, "b", "x", "none", blocks)],
        PLAN,
    )
    estimates = spark.createDataFrame(
        [(1, "a", "x", ""), (1, "a", "y", ""), (2, "a", "x", ""), (2, "a", "y", ""), (3, "b", "x", ""), (4, "a", "x", "few_lines"), (5, "a", "x", "")],
        "page_id LONG, template_id STRING, face_id STRING, reason STRING",
    )
    faces = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 0)], "template_id STRING, face_id STRING, n_blocks INT")
    index = G.overlap_index(spark.createDataFrame([], RECTS), 8)
    gated = G.snap_gate(faces, estimates, plan, index)
    assert sorted((r.page_id, r.face_id, r.reason) for r in gated.collect()) == [
        (1, "x", "excluded"), (1, "y", "failsafe"), (2, "x", "failsafe"), (2, "y", ""), (3, "x", "no_blocks"), (4, "x", "no_estimate"), (5, "x", "no_estimate"),
    ]
    assert sorted(map(tuple, G.snap_counters(gated).collect())) == [(1, "excluded"), (2, "failsafe"), (3, "none"), (4, "none"), (5, "none")]
    assert {r.reason for r in G.snap_gate(faces, estimates, plan, index, enabled=False).collect()} == {"disabled"}


def test_diff_counts_one_sided_pages_and_cells(spark):
    schema = "page_id LONG, column STRING, value STRING"
    a = [(1, "p", "x"), (1, "q", None), (2, "p", "x"), (2, "q", "y"), (3, "p", "x"), (5, "p", None), (6, "p", "")]
    b = [(1, "p", "x"), (1, "q", None), (2, "p", "z"), (2, "r", "y"), (4, "p", "x"), (4, "q", "x"), (5, "p", ""), (6, "p", "")]
    pages = R.page_diff(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    got = {r.page_id: (r.cells, r.diffs) for r in pages.collect()}
    assert got == {1: (2, []), 2: (3, ["p", "q", "r"]), 3: (1, ["p"]), 4: (2, ["p", "q"]), 5: (1, ["p"]), 6: (1, [])}
    assert tuple(R.diff_summary(pages).first()) == (6, 4, 10, 7)
    first = R.first_diffs(pages, 4).collect()
    assert [(r.page_id, r["column"]) for r in first] == [(2, "p"), (2, "q"), (2, "r"), (3, "p")] and first[0].total == 7 and first[0].truncated
    assert R.diff_summary(pages.limit(0)).first().pages == 0
