"""Plans and shapes that keep large inputs out of the driver and out of one task."""

import json
import math
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from formloom.operators import lines as L
from formloom.operators import lint as T
from formloom.operators import matching as M
from formloom.operators import runs as U
from formloom.operators import snapping as G
from formloom.operators.ranges import overlapping_pairs
from formloom.plans.catalog.symbols import _responses, document_responses
from formloom.session import kept
from formloom.sources.responses import explode_symbols
from formloom.sources.templates import expand_templates, output_columns, packed_columns

PLACE = "t LONG, ident INT, field_id STRING, kind STRING, x INT, y INT, w INT, h INT"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def places(spark):
    rows = [(t, i, f"f{i}", "region", i * 60, 0, 80, 40 + i) for t in range(3) for i in range(4)]
    return spark.createDataFrame(rows, PLACE)


def test_small_files_of_many_rows_are_not_broadcast(spark):
    """Beyond the limit of rows a join sorts, however few bytes its files have."""
    pairs = overlapping_pairs(places(spark), ["t"], "ident", ["field_id"], broadcast_rows=1)
    assert "SortMergeJoin" in physical(pairs)
    assert pairs.count() == 9


def test_exploded_rows_are_not_broadcast(spark, tmp_path):
    """Gaps come from joins of rows that are exploded from a source of few bytes."""
    spark.range(4).write.parquet(str(tmp_path / "t"))
    rect = F.struct(F.col("i").alias("ident"), F.format_string("f%d", "i").alias("field_id"), (F.col("i") * 100).alias("x"), F.lit(0).alias("y"), F.lit(60).alias("w"), F.lit(40).alias("h"))
    rects = spark.read.parquet(str(tmp_path / "t")).select("id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select(F.col("id").alias("t"), rect.alias("r")).select("t", "r.*")
    gaps = T.adjacent_gaps(rects, ["t"])
    assert "Broadcast" not in physical(gaps)
    assert gaps.groupBy("gap").count().collect() == [(40, 16)]


DOC = {
    "schema_version": 1, "template_id": "a", "render_dpi": 300, "image": {"width": 100, "height": 100}, "record": {"pages": 1},
    "faces": [{"face_id": "f", "source": {"page_offset": 0, "rect": {"x": 0, "y": 0, "w": 100, "h": 100}}, "exclusions": [],
               "fields": [{"field_id": "n", "kind": "text", "rect": {"x": 0, "y": 0, "w": 50, "h": 50}}],
               "tables": [{"table_id": "t", "row_pitch": 10, "row_height": 8, "blocks": [{"origin": {"x": 0, "y": 50}, "rows": 2}, {"origin": {"x": 50, "y": 50}, "rows": 1}],
                           "columns": [{"name": "c", "kind": "text", "x_offset": 0, "width": 20, "subfields": ["p", "q"]}]}]}],
}


def test_cells_are_numbered_in_their_row(spark):
    """Cells and columns of templates come without a shuffle, so no task sorts or holds more than one document."""
    tables = expand_templates(spark.createDataFrame([(json.dumps(DOC),)], "body STRING"))
    columns = packed_columns(tables.packed)
    for df in (tables.cells, columns):
        assert "Exchange" not in physical(df)
    cells = [(r.cell_ord, r.field_id, r.row_no, r.block_idx) for r in tables.cells.orderBy("cell_ord").collect()]
    assert cells == [(0, "n", None, None), (1, "t_01_c", 1, 0), (2, "t_02_c", 2, 0), (3, "t_03_c", 3, 1)]
    assert columns.exceptAll(output_columns(tables.cells).select(columns.columns)).isEmpty() and columns.count() == 7


def test_documents_of_one_id_are_one_template(spark):
    """Names are compared across the documents of an id; others are judged in their row."""
    other = DOC | {"template_id": "b"}
    tables = expand_templates(spark.createDataFrame([(json.dumps(d),) for d in (DOC, DOC, other)], "body STRING"))
    got = {r.template_id: (r.cells, r.columns, r.duplicate_fields, r.duplicate_columns, r.usable) for r in T.template_profile(tables).collect()}
    assert got == {"a": (8, 14, 4, 7, False), "b": (4, 7, 0, 0, True)}


def test_votes_are_counted_where_they_arise(spark):
    """Lines of a key are shuffled once and votes never; an entry votes once for a shift however many lines are near."""
    found = spark.createDataFrame([(1, "a", p) for p in (10, 11, 11, 52)], "page_id LONG, template_id STRING, pos INT")
    stats = spark.createDataFrame([("a", [10, 50, 50], 5)], "template_id STRING, lines ARRAY<INT>, limit INT")
    votes = L.axis_votes(found, stats, ["page_id"], ["template_id"])
    assert physical(votes).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    got = {r.shift: r.votes for r in votes.collect()}
    assert got == {-1: 1, 0: 1, 1: 3, 2: 3, 3: 2}


def test_walls_meet_their_segments_once(spark):
    """One join of rails and segments in tasks of a given number; coverage is counted where they meet, without another shuffle."""
    grid = [(1, "h", 10.0 * i, 0, 40 if i else 15, 1) for i in range(3)] + [(1, "v", 10.0 * i, 0, 20, 1) for i in range(3)] + [(2, "h", 5.0, 0, 9, 1)]
    walls = U.wall_flags(U.cluster_rails(spark.createDataFrame(grid, U.SEGMENT_SCHEMA)))
    plan = physical(walls).split("== Initial Plan ==")[-1]
    assert plan.count("SortMergeJoin") == 1 and "Broadcast" not in plan
    assert plan.split("SortMergeJoin")[0].count("Exchange") == 0
    open_walls = [(r.axis, r.rail, r.gap) for r in walls.filter("NOT closed").collect()]
    assert walls.count() == 12 and open_walls == [("h", 0, 1)]


def test_hits_of_gaps_are_not_shuffled(spark):
    """The lines of a page are dealt once; what they hit is counted in that task."""
    printed = [("a", "f", "h", 0, p, 8) for p in (100, 160, 230)]
    expected = spark.createDataFrame(printed, "template_id STRING, face_id STRING, axis STRING, block_idx INT, pos INT, limit INT")
    found = spark.createDataFrame([(1, "f", "h", p) for p in (104, 164, 234)] + [(2, "f", "h", p) for p in (10, 90)], "page_id LONG, face_id STRING, axis STRING, pos INT")
    pairs = spark.createDataFrame([(1, "a"), (2, "a")], "page_id LONG, template_id STRING")
    near = M.gap_candidates(pairs, found, expected)
    assert "REPARTITION_BY_NUM" in physical(near) and not re.search(r"hashpartitioning\([^)]*pair#", physical(near))
    assert [tuple(r) for r in near.collect()] == [(1, "a")]


def test_coverage_is_summed_in_bounded_tasks(spark):
    """Pairs of receptors and exclusions come in a number of tasks that follows their rows, not their bytes."""
    rects = places(spark).withColumn("is_main", F.lit(False)).withColumn("has_fallback", F.lit(False))
    cuts = spark.createDataFrame([(t, e, x, 0, 30, 10) for t in range(3) for e, x in ((0, 0), (1, 60))], "t LONG, excl INT, x INT, y INT, w INT, h INT")
    found = T.exclusion_coverage(rects, cuts, ["t"])
    assert "REPARTITION_BY_NUM" in physical(found)
    assert sorted(r.covered for r in found.filter("t = 1").collect()) == [300, 500]


def test_symbols_of_responses_are_compiled(spark):
    """A response is parsed once, the steps of a symbol are compiled without lambdas; missing coordinates count as 0, in any order."""

    def symbol(text, conf, vertices):
        return {"text": text, "confidence": conf, "boundingBox": {"vertices": vertices}}

    words = [
        {"symbols": [symbol("a", 0.5, [{"x": 4}, {"y": 6}, {"x": 10, "y": 8}]), symbol("b", True, [{"x": -8, "y": -2}, {}]), symbol(7, 0.5, [{"x": 2, "y": 2}])]},
        {"symbols": [symbol("c", 0.5, []), {"text": "d", "confidence": 1}, symbol("e", "0.5", [{"x": 3, "y": 5}])]}, {},
    ]
    body = json.dumps({"fullTextAnnotation": {"pages": [{"blocks": [{"paragraphs": [{"words": words}]}]}]}})
    stored = spark.createDataFrame([(1, body), (2, "{}"), (3, None), (4, "no")], "doc_id LONG, body STRING")
    rows = explode_symbols(stored, keep_dropped=True)
    assert physical(rows).count("from_json") == 1 and physical(rows).startswith("*(")
    got = [tuple(r) for r in rows.orderBy("doc_id", "seq").collect()]
    assert got == [
        (1, 0, "a", 5.0, 4.0, 0.5, False), (1, 1, "b", -4.0, -1.0, 0.0, False), (1, 2, None, 2.0, 2.0, 0.5, True),
        (1, 3, "c", None, None, 0.5, True), (1, 4, "d", None, None, 1.0, True), (1, 5, "e", 3.0, 5.0, 0.0, False),
    ]


def test_responses_of_odd_texts(spark, tmp_path):
    """Every character of a text is one symbol of its response, in small batches too."""
    texts = ["", " ", None, 'a"b\\c\n\t\x01[]{} 日本😀.5 x  y ', "ab9" * 700 + " é.e"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    rows = explode_symbols(document_responses(spark, str(tmp_path)), keep_dropped=True).orderBy("doc_id", "seq").collect()
    for doc_id, text in enumerate(texts):
        of = [(ch, i) for w in (text or "").split(" ") for i, ch in enumerate(w)]
        got = [r for r in rows if r.doc_id == doc_id]
        assert [r.text for r in got] == [None if ch in "0123456789" else ch for ch, _ in of]
        assert [(r.x, r.dropped) for r in got if r.text != "."] == [(i * 37 % 1800 + 4.5, ch in "0123456789") for ch, i in of if ch != "."]
        assert all(r.dropped for r in got if r.text == ".") and all((r.conf == 0) == (ch in "aeiou") for r, (ch, _) in zip(got, of))


def test_tables_of_pages_are_not_broadcast(spark, tmp_path):
    """Blocks and their overlaps come from sorted joins; only tables of templates go to the driver."""
    rows = [(p, f"t{p % 2}") for p in range(40)]
    spark.createDataFrame(rows, "page_id LONG, template_id STRING").write.parquet(str(tmp_path / "pages"))
    found = [(p, "f", "h", b, b * 200 + i * 30 + p % 3 + (b * 3 if p % 4 == 0 else 0)) for p in range(40) for b in (0, 1) for i in range(6)]
    spark.createDataFrame(found, "page_id LONG, face_id STRING, axis STRING, block_idx INT, pos INT").write.parquet(str(tmp_path / "found"))
    pages, lines = spark.read.parquet(str(tmp_path / "pages")), spark.read.parquet(str(tmp_path / "found"))
    printed = [(t, "f", "h", b, b * 200 + i * 30, 13) for t in ("t0", "t1") for b in (0, 1) for i in range(6)]
    expected = spark.createDataFrame(printed, "template_id STRING, face_id STRING, axis STRING, block_idx INT, pos INT, limit INT")
    shift = kept(pages.selectExpr("page_id", "template_id", "'f' AS face_id", "CAST(page_id % 3 AS INT) AS dy"))
    blocks = L.block_shifts(pages, lines, expected, shift)
    tolerance = expected.selectExpr("template_id", "face_id", "block_idx", "4 AS row_gap").distinct()
    rects = expected.selectExpr("template_id", "face_id", "block_idx", "concat('r', pos) AS field_id", "0 AS x", "pos AS y", "10 AS w", "CASE WHEN pos = 150 THEN 50 ELSE 20 END AS h")
    gap = rects.selectExpr("template_id", "face_id", "CAST(NULL AS INT) AS block_idx", "'single' AS field_id", "0 AS x", "371 AS y", "10 AS w", "9 AS h").distinct()
    found = G.new_overlaps(L.snap_plan(blocks, tolerance), kept(G.overlap_index(rects.union(gap), 8)))
    hashed = [line for line in physical(found).splitlines() if "BroadcastHashJoin" in line]
    assert hashed and not [line for line in hashed if "page_id" in line]
    assert sorted(map(tuple, found.collect())) == [(p, "f", 1) for p in range(0, 40, 4)]


def carved(rects, cut, kind):
    """The rule of carving in plain Python: pieces, their area, verdict."""
    pieces = []
    for x, y, w, h in rects:
        x0, y0, x1, y1 = max(x, cut[0]), max(y, cut[1]), min(x + w, cut[0] + cut[2]), min(y + h, cut[1] + cut[3])
        if x1 <= x0 or y1 <= y0:
            pieces.append((w, h))
            continue
        pieces += [p for p in ((w, y0 - y), (w, y + h - y1)) if p[1] >= 6] + [p for p in ((x0 - x, y1 - y0), (x + w - x1, y1 - y0)) if min(p) >= 6]
    left = sum(w * h for w, h in pieces)
    lost = math.floor((1 - left / sum(r[2] * r[3] for r in rects)) * 100 + 0.5)
    big = max(pieces, key=lambda p: p[0] * p[1], default=(0, 0))
    skip = kind != "text" or not pieces or big[0] < 27 or big[1] < 36 or lost >= 30
    return len(pieces), left, "skip" if skip else "warn" if lost >= 10 else "auto"


def test_carving_is_compiled(spark):
    """Rects are cut without lambdas where their number is known, with the results of arrays of rects."""
    rnd = random.Random(5)
    rows = [(i, *[rnd.randrange(0, 90) if j % 4 < 2 else rnd.randrange(20, 150) for j in range(12)], rnd.choice(["text"] * 4 + ["choice"])) for i in range(400)]
    names = [f"{n}{r}" for r in "abc" for n in "xywh"]
    df = spark.createDataFrame(rows, "i INT, " + ", ".join(f"{n} INT" for n in names) + ", kind STRING")
    a, b, cut = (F.struct(*[F.col(f"{n}{r}").alias(n) for n in "xywh"]) for r in "abc")
    rest = T.rest_of_rect(a, cut)
    known = df.select("i", rest["pieces"].alias("n"), rest["area"].alias("area"), T.carve_verdict([a], cut, F.col("kind")).alias("one"), T.carve_verdict([a, b], cut, F.col("kind")).alias("two"))
    assert physical(known).startswith("*(")
    listed = df.select("i", F.size(T.subtract_rect(a, cut)).alias("n"), T.carve_verdict(F.array(a, b), cut, F.col("kind")).alias("two"))
    want = {r[0]: (*carved([r[1:5]], r[9:13], r[13]), carved([r[1:5], r[5:9]], r[9:13], r[13])[2]) for r in rows}
    assert {r.i: (r.n, r.area, r.one, r.two) for r in known.collect()} == want and len({w[3] for w in want.values()}) == 3
    assert {r.i: (r.n, r.two) for r in listed.collect()} == {i: (w[0], w[3]) for i, w in want.items()}


def test_entries_of_responses_are_not_copied(spark):
    """No lambda hands entries on, no array is sorted; centres, and arrays that are missing on any level, are as with plain loops."""
    corners = [
        None, [], [{}], [None], [{"x": 3}], [{"x": 3, "y": 0}, {"y": 5}], [{"x": -3, "y": -4}, {"x": -7}], [{"x": 0}, {}, {"x": 9, "y": 2}],
        [{"x": "a", "y": 1}, {"x": 4, "y": 2}], [{"x": 1.5, "y": 2.5}, {"x": 8, "y": None}, None],
    ]
    words = [{"symbols": [{"text": str(i), "confidence": 1, "boundingBox": {"vertices": c}}]} for i, c in enumerate(corners)]
    gaps = [{"symbols": None}, {}, None, {"symbols": []}, {"symbols": [{"text": "n", "boundingBox": None}, None, {"text": None}]}]
    pages = [None, {}, {"blocks": None}, {"blocks": [None, {}, {"paragraphs": [None, {"words": None}, {"words": words[:4] + gaps}]}, {"paragraphs": [{"words": words[4:]}]}]}]
    stored = spark.createDataFrame([(1, json.dumps({"fullTextAnnotation": {"pages": pages}}))], "doc_id LONG, body STRING")
    rows = explode_symbols(stored, keep_dropped=True)
    assert "transform(" not in physical(rows) and "sort_array(" not in physical(rows)

    def centre(corners, name):
        at = [c[name] if c and isinstance(c.get(name), int | float) else 0 for c in corners or []]
        return (min(at) + max(at)) / 2 if at else None

    got = [tuple(r) for r in rows.orderBy("seq").select("seq", "text", "x", "y", "dropped").collect()]
    flat = [*((str(i), corners[i]) for i in range(4)), ("n", None), (None, None), (None, None), *((str(i), corners[i]) for i in range(4, len(corners)))]
    assert got == [(k, t, centre(c, "x"), centre(c, "y"), t is None or not c) for k, (t, c) in enumerate(flat)]


def test_bodies_are_made_by_batches():
    """Texts that share a batch keep their own bodies, those without a text in between too; a batch has a bounded number of characters."""

    def body(text):
        def symbol(ch, i):
            x = i * 37 % 1800
            box = "[]" if ch == "." else '[{"x":%d},{"x":%d,"y":7}]' % (x, x + 9)
            head = ch if ch in "0123456789" else json.dumps(ch, ensure_ascii=False)
            return '{"text":%s,"confidence":%s,"boundingBox":{"vertices":%s}}' % (head, "true" if ch in "aeiou" else "0.75", box)

        words = ",".join('{"symbols":[' + ",".join(symbol(ch, i) for i, ch in enumerate(w)) + "]}" for w in text.split(" "))
        return '{"fullTextAnnotation":{"pages":[{"blocks":[{"paragraphs":[{"words":[' + words + "]}]}]}]}}"

    texts = [None, "", "a.b 7", None, "  é", 'x"\\\n\x00😀 ', "ab" * 40_000, ". .", None, "e" * 30_000, "z"]
    table = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    made = list(_responses(iter([table, table.slice(0, 1), table.slice(4, 2)])))
    assert [b.num_rows for b in made] == [7, 4, 1, 2]
    found = [(r["doc_id"], r["body"]) for b in made for r in b.to_pylist()]
    assert found == [(i, None if texts[i] is None else body(texts[i])) for i in [*range(len(texts)), 0, 4, 5]]
