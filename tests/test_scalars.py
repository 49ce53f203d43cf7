"""Literal cases of the column functions."""

import random
import unicodedata

from pyspark.sql import functions as F

from formloom.functions import scalars as S
from formloom.operators import lines as L
from formloom.operators import rows as R


def column(spark, values, schema="v STRING"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {schema}").orderBy("i")


def run(spark, values, fn, schema="v STRING"):
    return [r["o"] for r in column(spark, values, schema).select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_amounts(spark):
    good = {"100,000": 100000, "100.000": 100000, "100": 100, "１００": 100, "１０，０００": 10000, "10、000": 10000, "10 000": 10000, " 10000 ": 10000, "\u300010000": 10000}
    bad = ["1,00", "10,00,0", "10000円", "一万", "10.5", "/0.000", "", "〓", "100\n", "99999999999999999999"]
    assert run(spark, list(good), S.normalize_amount) == list(good.values())
    assert run(spark, bad[:-2], S.normalize_amount) == [None] * 8
    assert run(spark, bad[-2:], S.normalize_amount) == [100, None]  # white space at the end goes; too long is NULL


def test_nfkc(spark):
    """Random texts of characters that are translated, kept, and joined with others."""
    rnd = random.Random(11)
    pool = [chr(c) for c in (*range(0x20, 0x7F), *range(0x2FF0, 0x3100), *range(0xFF00, 0xFFA0), 0x0301, 0x3099, 0x309A, 0x4E00, 0x9FFF, 0xFA10, 0x1100, 0x1161, 0xFB01, 0x20BB7)]
    texts = [c for c in pool] + ["".join(rnd.choices(pool, k=rnd.randrange(1, 9))) for _ in range(3000)] + ["", "a\n", "Ａ\u0301", "か\u3099", "ｶﾞ"]
    assert run(spark, texts, S.nfkc) == [unicodedata.normalize("NFKC", t) for t in texts]
    assert run(spark, [None, "１"], S.nfkc) == [None, "1"]


def test_split(spark):
    good = {"7.7.20": ["7", "7", "20"], "3,8,30": ["3", "8", "30"], "H20.7.20": ["H20", "7", "20"], "7・7・20": ["7", "7", "20"],
            "7/7/20": ["7", "7", "20"], "7 . 7 . 20": ["7", "7", "20"], "７．７．２０": ["7", "7", "20"], "7･7･20": ["7", "7", "20"]}
    bad = ["7.720", "7.7.20.1", "7..20", "77 20", ""]
    assert run(spark, list(good), lambda c: S.split_composite(c, 3)) == list(good.values())
    assert run(spark, bad, lambda c: S.split_composite(c, 3)) == [None] * 5


def test_masks(spark):
    rows = [("旭川市", [0.99, 0.5, 0.99]), ("旭川市", [0.1, 0.1, 0.1]), ("旭川市", [0.85, 0.85, 0.85]), ("ab", [0.1]), ("𠮷野", [0.99, 0.2]), ("ab", [0.9, float("nan")])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, t STRING, c ARRAY<DOUBLE>")
    got = [(r["m"]["value"], r["m"]["kept"]) for r in df.select("i", S.mask_low_confidence(F.col("t"), F.col("c")).alias("m")).orderBy("i").collect()]
    assert got == [("旭〓市", 0.99), ("〓", None), ("〓", None), ("〓", None), ("𠮷〓", 0.99), ("a〓", 0.9)]


def test_reasons_and_display(spark):
    df = spark.createDataFrame([(0, "a\x07", 0.9), (1, "", 0.9), (2, "a", None), (3, "a", 0.8496), (4, "a", 0.85), (5, "\x07", None)], "i INT, t STRING, c DOUBLE")
    got = [r["o"] for r in df.select("i", S.unclear_reason(F.col("t"), F.col("c")).alias("o")).orderBy("i").collect()]
    assert got == ["control", "empty", "no_conf", "low_conf", None, "control"]
    assert run(spark, [0.8125, 0.8496, 1.0, None], S.format_conf, "v DOUBLE") == ["0.812", "0.850", "1.000", None]
    assert run(spark, ["0.5,0.25", "", "0.1,x", "nan,inf"], S.parse_char_confs) == [[0.5, 0.25], [], [], [0.0, 0.0]]


def test_status(spark):
    rows = [("送信失敗", 5, False), ("様式不一致", 5, True), ("", 3, True), ("", 2, True), ("", 9, False), ("legacy", 0, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, s STRING, b INT, p BOOLEAN")
    got = [r["o"] for r in df.select("i", S.compose_status(F.col("s"), F.col("b"), F.col("p")).alias("o")).orderBy("i").collect()]
    assert got == ["送信失敗", "様式不一致;超過あり", "超過あり", "正常", "未処理（中断）", "legacy"]


def test_paths(spark):
    cases = {
        "and/or 2026/09/07 a / b": "and/or 2026/09/07 a / b",
        "open /home/x/a.csv now": "open [path] now",
        "C:\\Program Files\\x y": "[path] y",
        "C:\\a\\b から C:\\c\\d": "[path] から [path]",
        "KEY=/x/y;z": "KEY=[path];z",
        "（現在: '\\\\srv\\share'）": "（現在: '[path]'）",
        "see FILE://a/b, ok": "see [path], ok",
    }
    assert run(spark, list(cases), S.redact_paths) == list(cases.values())


def test_choices(spark):
    cases = [([("A", 0, 0.3)], "A"), ([("A", 0, 0.10), ("B", 1, 0.03), ("C", 2, 0.02)], "A"), ([("A", 0, 0.10), ("B", 1, 0.09), ("C", 2, 0.02)], "undecided"),
             ([("A", 0, 0.04), ("B", 1, 0.03), ("C", 2, 0.02)], "unselected"), ([("A", 0, 0.2), ("B", 1, 0.2)], "undecided"), ([], "unselected"), (None, "unselected")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i INT, s ARRAY<STRUCT<option: STRING, ord: INT, score: DOUBLE>>")
    got = [r["o"] for r in df.select("i", R.choice_decision(F.col("s")).alias("o")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_verdict_comes_from_one_face(spark):
    faces = [("p", 0, "match", "", .95, 20, 16), ("p", 1, "match", "", .88, 24, 26), ("q", 0, "skipped", "", -1.0, 0, 0), ("q", 1, "mismatch", "lines", -1.0, 3, 4),
             ("q", 2, "mismatch", "lines", .5, 7, 8), ("r", 0, "skipped", "", -1.0, 0, 0)]
    df = spark.createDataFrame(faces, "page_id STRING, face_ord INT, verdict STRING, why STRING, score DOUBLE, detected INT, expected INT")
    got = {r["page_id"]: tuple(r)[1:] for r in L.fold_verdicts(df, ["page_id"]).collect()}
    assert got == {"p": ("match", "", .88, 24, 26), "q": ("mismatch", "lines", .5, 7, 8), "r": ("undecidable", "unknown", -1.0, 0, 0)}


def test_ranking(spark):
    rows = [(1, "b", "match", .95), (1, "a", "match", .80), (2, "b", "match", .95), (2, "a", "match", .90), (3, "b", "mismatch", .9), (3, "a", "undecidable", .1),
            (4, "b", "match", .6), (4, "a", "mismatch", .7), (5, "b", "match", .9)]
    df = spark.createDataFrame(rows, "page_id INT, name STRING, verdict STRING, score DOUBLE")
    cut = spark.createDataFrame([(5,)], "page_id INT")
    got = {}
    for r in L.rank_candidates(df, cut).orderBy("page_id", "rank").collect():
        got.setdefault(r["page_id"], []).append((r["name"], r["pick"]))
        assert r["show_score"] == (r["page_id"] not in (2, 5))
    assert got == {1: [("b", True), ("a", False)], 2: [("a", False), ("b", False)], 3: [("a", False), ("b", False)], 4: [("a", False), ("b", True)], 5: [("b", False)]}
