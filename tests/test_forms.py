"""End to end on literal forms: fields, fallbacks, holes, rows."""

import json

import pytest
from pyspark.sql import functions as F

from formloom.operators import assignment as A
from formloom.operators import rows as R
from formloom.plans.extraction import extract, form_rows
from formloom.sources.responses import explode_symbols
from formloom.sources.templates import expand_templates, template_hashes


def rect(x, y, w, h):
    return {"x": x, "y": y, "w": w, "h": h}


def template(fields, tables=(), tid="b"):
    return {
        "schema_version": 1, "template_id": tid, "render_dpi": 300, "image": {"width": 1800, "height": 1200},
        "record": {"pages": 1},
        "faces": [{"face_id": "f", "source": {"page_offset": 0, "rect": rect(0, 0, 1800, 1200)}, "exclusions": [],
                   "fields": fields, "tables": list(tables)}],
    }


SMALL = template(
    [{"field_id": n, "kind": "text", "rect": r} for n, r in
     (("氏名", rect(100, 100, 400, 80)), ("受付日", rect(600, 100, 300, 80)), ("備考", rect(100, 750, 850, 150)))],
    [{"table_id": "visit", "row_pitch": 80, "row_height": 70, "blocks": [{"origin": {"x": 100, "y": 300}, "rows": 5}],
      "columns": [{"name": "来場日", "kind": "text", "x_offset": 0, "width": 200},
                  {"name": "人数", "kind": "text", "x_offset": 200, "width": 150},
                  {"name": "メモ", "kind": "text", "x_offset": 350, "width": 400}]}],
)
TEXT = """山(165,140) 田(255,140) 花(345,140) 子(435,140) 9(663.5,140) .(750,140) 1(836.5,140) 視(221,790) 察(423.5,790) 対(626.5,790)
応(829,790) 9(138.5,335) .(200,335) 1(261.5,335) 3(375,335) 挨(506,335) 拶(602,335) 回(698,335) り(794,335) 9(138.5,415) .(200,415) 2(261.5,415)
5(375,415) 名(506,415) 刺(602,415) 交(698,415) 換(794,415) 9(138.5,575) .(200,575) 4(261.5,575) 9(138.5,655) .(200,655) 5(261.5,655) 2(375,655)
見(554,655) 学(746,655) 来(730,40) 場(790,40) 記(850,40) 録(910,40) 表(970,40) 氏(37.5,130) 名(72.5,130) 受(532.5,130) 付(557.5,130) 日(582.5,130)
備(37.5,775) 考(72.5,775) 来(116.5,280) 場(150,280) 日(183.5,280) 人(312.5,280) 数(337.5,280) メ(475,280) モ(525,280)""".split()


def small_symbols():
    for t in TEXT:
        x, y = t[2:-1].split(",")
        yield t[0], float(x), float(y)


def response(symbols, conf=0.97):
    out = [{"text": t, "confidence": conf, "boundingBox": {"vertices": [{"x": x - 2, "y": y - 2}, {"x": x + 2, "y": y + 2}]}}
           for t, x, y in symbols]
    return {"fullTextAnnotation": {"pages": [{"blocks": [{"paragraphs": [{"words": [{"symbols": out}]}]}]}]}}


@pytest.fixture(scope="module")
def small_tables(spark):
    docs = spark.createDataFrame([(json.dumps(SMALL),)], "body STRING")
    return expand_templates(docs).settled()


def test_small_form_from_response_to_wide_row(spark, small_tables):
    body = json.dumps(response(small_symbols()))
    symbols = explode_symbols(spark.createDataFrame([("p1", "b", body)], "page_id STRING, template_id STRING, body STRING"))
    assert symbols.count() == 55
    found = extract(symbols, small_tables)
    pages = spark.createDataFrame([("p1", "b", "s.pdf", 1, "", 0, True)],
                                  "page_id STRING, template_id STRING, source_file STRING, page_no INT, status STRING, below INT, processed BOOLEAN")
    keys = pages.select("page_id", "template_id")
    c = A.page_counters(keys, found.counts, found.contents, found.holes, small_tables)
    row = c.first()
    assert (row["in_face"], row["other"], row["below"]) == (55, 19, 0)
    ratio = A.mismatch_ratios(small_tables).first()["ratio"]
    assert abs(ratio - 0.611508) < 1e-6
    totals = keys.select("page_id", F.lit(55).alias("page_total"))
    assert A.format_mismatch(c, totals, small_tables).first()["mismatch"] is False

    wide = form_rows(symbols, pages, small_tables, "b").first().asDict()
    want = {"氏名": "山田花子", "受付日": "9.1", "備考": "視察対応"}
    for i, cells in enumerate((("9.1", "3", "挨拶回り"), ("9.2", "5", "名刺交換"), ("", "", ""), ("9.4", "〓", "〓"), ("9.5", "2", "見学")), 1):
        want |= {f"visit_{i:02d}_{n}": v for n, v in zip(("来場日", "人数", "メモ"), cells)}
    assert {k: wide[k] for k in want} == want
    assert list(wide)[:6] == list(R.META_COLUMNS)
    assert (wide["unclear_count"], wide["min_conf"], wide["status"]) == (2, "0.970", "正常")


def test_bucket_width_does_not_matter(spark, small_tables):
    symbols = spark.createDataFrame(
        [("p", "b", i, t, x, y, 0.9) for i, (t, x, y) in enumerate(small_symbols())],
        "page_id STRING, template_id STRING, seq LONG, text STRING, x DOUBLE, y DOUBLE, conf DOUBLE",
    )
    results = []
    for bucket in (128, 31, 1000):
        rows = extract(symbols.repartition(3), small_tables, bucket).cells.collect()
        results.append(sorted((r["field_id"], r["raw"]) for r in rows))
    assert results[0] == results[1] == results[2]


HOLES = template([
    {"field_id": "addr", "kind": "text", "rect": rect(100, 750, 850, 60), "extra_rects": [rect(100, 810, 400, 90)]},
    {"field_id": "zip", "kind": "text", "rect": rect(1000, 100, 200, 80), "fallback_rect": rect(600, 815, 100, 60)},
], tid="l")
CASES = {
    "only_fallback": ([(610, 830), (640, 830)], ("ab", "fallback"), None, dict(fallback_used=1, fallback_discarded=0, carve_hole=0)),
    "conflict": ([(1010, 130), (610, 830), (640, 830)], ("a", "conflict"), "〓", dict(fallback_used=0, fallback_discarded=2, carve_hole=2)),
    "one_each": ([(1010, 130), (610, 830)], ("a", ""), "〓", dict(fallback_used=0, fallback_discarded=1, carve_hole=1)),
    "two_main": ([(1010, 130), (1040, 130), (610, 830)], ("ab", ""), "〓", dict(fallback_used=0, fallback_discarded=1, carve_hole=1)),
    "direct_hole": ([(800, 850)], None, "〓", dict(fallback_used=0, fallback_discarded=0, carve_hole=1)),
}


def test_fallbacks_and_holes(spark):
    tables = expand_templates(spark.createDataFrame([(json.dumps(HOLES),)], "body STRING")).settled()
    rows = [(k, "l", i, "abc"[i], float(x), float(y), 0.9) for k, (pts, *_) in CASES.items() for i, (x, y) in enumerate(pts)]
    symbols = spark.createDataFrame(rows, "page_id STRING, template_id STRING, seq LONG, text STRING, x DOUBLE, y DOUBLE, conf DOUBLE")
    found = extract(symbols, tables)
    cells = {(r["page_id"], r["field_id"]): r for r in found.cells.collect()}
    pages = A.pages_of(symbols)
    counters = {r["page_id"]: r for r in A.page_counters(pages, found.counts, found.contents, found.holes, tables).collect()}
    for k, (pts, zip_, addr, counts) in CASES.items():
        z = cells.get((k, "zip"))
        assert (z and (z["raw"], z["origin"])) == zip_, k
        a = cells.get((k, "addr"))
        assert (a and a["raw"]) == addr, k
        assert {n: counters[k][n] for n in counts} == counts, k
        # every symbol is accounted for
        c = counters[k]
        kept = sum(r["n_main"] if r["origin"] != "fallback" else r["n_fb"] for r in found.contents.filter(F.col("page_id") == k).collect())
        assert c["in_face"] == kept + c["carve_hole"] + c["other"] + c["below"], k


def test_lines_and_bands(spark):
    doc = template([{"field_id": "a", "kind": "text", "rect": rect(500, 50, 300, 60),
                     "extra_rects": [rect(900, 70, 250, 60), rect(100, 100, 300, 60)]}], tid="r")
    tables = expand_templates(spark.createDataFrame([(json.dumps(doc),)], "body STRING")).settled()
    pts = {
        "linked": [("m", 510, 60), ("r", 910, 90), ("l", 110, 120)],  # the middle region links all three
        "apart": [("m", 510, 60), ("l", 110, 120)],
        "lines": [("2", 520, 100), ("1", 600, 60), ("0", 510, 62), ("3", 700, 101)],  # steps of 31 px and more break
    }
    rows = [(p, "r", i, t, float(x), float(y), 0.9) for p, s in pts.items() for i, (t, x, y) in enumerate(s)]
    symbols = spark.createDataFrame(rows, "page_id STRING, template_id STRING, seq LONG, text STRING, x DOUBLE, y DOUBLE, conf DOUBLE")
    got = {r["page_id"]: r["raw"] for r in extract(symbols, tables).contents.collect()}
    assert got == {"linked": "lmr", "apart": "ml", "lines": "0123"}


def test_broken_responses_do_not_stop_a_page(spark):
    bodies = {
        "none": "{}", "junk": "not json", "null": '{"fullTextAnnotation": null}',
        "mixed": json.dumps({"fullTextAnnotation": {"pages": [{"blocks": [{"paragraphs": [{"words": [{"symbols": [
            {"text": "a", "confidence": True, "boundingBox": {"vertices": [{"x": 3}, {"y": 4}]}},
            {"text": 5, "confidence": 0.5, "boundingBox": {"vertices": [{"x": 1, "y": 1}]}},
            {"text": "b", "confidence": "0.9", "boundingBox": {"vertices": [{"x": 1, "y": 1}]}},
            {"text": "c", "boundingBox": {"vertices": []}}, {"text": "d"},
            {"text": "e", "confidence": 1, "boundingBox": {"vertices": [{"x": 2, "y": 2}]}},
        ]}, {}]}, {}]}, {}]}, {}]}}),
    }
    df = spark.createDataFrame(list(bodies.items()), "page_id STRING, body STRING")
    got = [tuple(r) for r in explode_symbols(df).orderBy("seq").collect()]
    assert got == [("mixed", 0, "a", 1.5, 2.0, 0.0), ("mixed", 2, "b", 1.0, 1.0, 0.0), ("mixed", 5, "e", 2.0, 2.0, 1.0)]


def test_hashes_ignore_key_order(spark):
    shuffled = json.dumps(dict(reversed(list(SMALL.items()))), indent=2)
    moved = json.loads(json.dumps(SMALL))
    moved["faces"][0]["fields"][0]["rect"]["x"] = 101
    docs = [(1, json.dumps(SMALL)), (2, shuffled), (3, json.dumps(moved))]
    got = {r["n"]: r for r in template_hashes(spark.createDataFrame(docs, "n INT, body STRING")).collect()}
    assert got[1]["template_hash"] == got[2]["template_hash"] != got[3]["template_hash"]
    assert got[1]["geometry_hash"] == got[2]["geometry_hash"] == got[3]["geometry_hash"]
