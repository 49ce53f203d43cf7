"""Queries over recognised symbols."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.functions.scalars import expected_digits
from formloom.operators import assignment as A
from formloom.plans import fixtures as X
from formloom.plans.catalog import Entry
from formloom.plans.extraction import Extraction, extract
from formloom.sources.responses import explode_symbols
from formloom.sources.templates import TemplateTables

CTE = X.form_ctes()


def _found(spark: SparkSession, d: str) -> Extraction:
    return extract(X.symbols(spark, d), X.form_tables(spark, d))


def face_local(spark: SparkSession, d: str) -> DataFrame:
    return A.to_face_local(X.symbols(spark, d), X.form_tables(spark, d)).select(
        "page_id", "face_id", "seq", "x", "y", "text", "conf"
    )


def symbol_assignment(spark: SparkSession, d: str) -> DataFrame:
    tables = X.form_tables(spark, d)
    local = A.to_face_local(X.symbols(spark, d), tables)
    return A.assign_symbols(local, tables).filter(F.col("field_id").isNotNull()).select(
        "page_id", "face_id", "seq", "x", "y", "kind", "field_id", "region"
    )


def unassigned_symbols(spark: SparkSession, d: str) -> DataFrame:
    tables = X.form_tables(spark, d)
    local = A.to_face_local(X.symbols(spark, d), tables)
    return A.assign_symbols(local, tables).filter(F.col("field_id").isNull()).select(
        "page_id", "face_id", "seq", "x", "y", "kind"
    )


def symbol_disposition(spark: SparkSession, d: str) -> DataFrame:
    tables = X.form_tables(spark, d)
    local = A.to_face_local(X.symbols(spark, d), tables)
    return A.disposition_counts(A.assign_symbols(local, tables))


def discarded_fallback_symbols(spark: SparkSession, d: str) -> DataFrame:
    return A.discarded_hits(_found(spark, d).contents).groupBy("page_id", "field_id", "hole_field").agg(
        F.count(F.lit(1)).alias("symbols")
    )


def _confs() -> F.Column:
    return F.array_join(
        F.transform("char_confs", lambda c: F.round(c * 100).cast("int").cast("string")), ","
    ).alias("confs")


def reading_order_text(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).contents.filter(F.col("field_id") != "addr").select(
        "page_id", "field_id", "raw", "conf", _confs()
    )


def multi_region_text(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).contents.filter(F.col("field_id") == "addr").select(
        "page_id", "field_id", "raw", "conf", _confs()
    )


def fallback_choice(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).contents.select("page_id", "field_id", "n_main", "n_fb", "origin")


def cell_contents(spark: SparkSession, d: str) -> DataFrame:
    return extract(X.symbols(spark, d), X.form_tables(spark, d), keep=True).cells.select("page_id", "field_id", "raw", "conf", "origin", _confs(), "holes")


def empty_table_rows(spark: SparkSession, d: str) -> DataFrame:
    tables = X.form_tables(spark, d)
    found = extract(X.symbols(spark, d), tables, keep=True)
    pages = X.pages(spark, d).select("page_id", "template_id")
    return A.empty_rows(A.page_contents(pages, found.cells), tables).select("page_id", "table_id", "row_no")


def page_counters(spark: SparkSession, d: str) -> DataFrame:
    tables = X.form_tables(spark, d)
    f = extract(X.symbols(spark, d), tables, keep=True)
    pages = X.pages(spark, d).select("page_id", "template_id")
    return A.page_counters(pages, f.counts, f.contents, f.holes, tables).drop("template_id")


def format_mismatch(spark: SparkSession, d: str) -> DataFrame:
    tables = X.form_tables(spark, d)
    symbols = X.symbols(spark, d)
    f = extract(symbols, tables, keep=True)
    pages = X.pages(spark, d).select("page_id", "template_id")
    counters = A.page_counters(pages, f.counts, f.contents, f.holes, tables)
    totals = pages.join(
        symbols.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")), "page_id", "left"
    ).select("page_id", F.coalesce("n", F.lit(0)).alias("page_total"))
    return A.format_mismatch(counters, totals, tables)


def _digit_targets(spark: SparkSession, tables: TemplateTables) -> DataFrame:
    rules = spark.createDataFrame(
        [(r"郵便番号\s*\d*\s*$", 7, "postal code")], "pattern STRING, digits INT, rule STRING"
    )
    return expected_digits(tables.cells, rules).select("template_id", "face_id", "field_id", "rect", "digits")


def overflow_candidates(spark: SparkSession, d: str) -> DataFrame:
    tables = X.form_tables(spark, d)
    local = A.to_face_local(X.symbols(spark, d), tables)
    return A.overflow_candidates(local, tables, _digit_targets(spark, tables)).drop("template_id")


def empty_main_fields(spark: SparkSession, d: str) -> DataFrame:
    tables = X.form_tables(spark, d)
    local = A.to_face_local(X.symbols(spark, d), tables)
    return A.empty_main(local, tables, _digit_targets(spark, tables)).drop("template_id")


RESPONSE_OPEN = '{"fullTextAnnotation":{"pages":[{"blocks":[{"paragraphs":[{"words":['
RESPONSE_CLOSE = "]}]}]}]}}"
WORD_OPEN, WORD_CLOSE = '{"symbols":[', "]}"
#: Every 1,800 symbols of a word the positions start again.
SYMBOL_TAILS = [
    ',"boundingBox":{"vertices":[{"x":%d},{"x":%d,"y":7}]}}' % (x, x + 9) for x in ((i * 37) % 1800 for i in range(1800))
]
#: Documents whose responses are parsed in one task.
DOCUMENTS_PER_TASK = 1_000
#: Characters of texts whose responses are made and handed over at once, some four million characters of JSON.
TEXT_CHARS = 60_000


def _symbol_head(ch: str) -> str:
    """Text and confidence of a symbol: digits are numbers, vowels have a boolean confidence."""
    text = ch if ch in "0123456789" else json.dumps(ch, ensure_ascii=False)
    return '{"text":' + text + (',"confidence":true' if ch in "aeiou" else ',"confidence":0.75')


class _Bodies:
    """Responses of many texts at once: two pieces a character, taken from one list of pieces into one buffer."""

    def __init__(self) -> None:
        self.pieces = [
            *SYMBOL_TAILS, ',"boundingBox":{"vertices":[]}}', WORD_CLOSE + "," + WORD_OPEN,
            RESPONSE_OPEN + WORD_OPEN, WORD_CLOSE + RESPONSE_CLOSE, "",
        ]
        self.bare, self.next_word, self.open, self.close, self.empty = range(len(SYMBOL_TAILS), len(self.pieces))
        # where a character's head stands in the list; after it the same behind a comma
        self.heads = np.full(0x110000, -1, np.int32)
        self.array = None

    def _learn(self, codes: np.ndarray) -> None:
        for code in np.unique(codes[self.heads[codes] < 0]).tolist():
            self.heads[code] = len(self.pieces)
            head = _symbol_head(chr(code))
            self.pieces += [head, "," + head]
            self.array = None
        if self.array is None:
            self.array = pa.array(self.pieces, pa.string())

    def __call__(self, texts: list[str]) -> pa.Array:
        """One body for each text. A blank stands behind each text, so that words begin behind blanks only."""
        codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le"), np.uint32)
        self._learn(codes)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        at = np.arange(len(codes), dtype=np.int32)
        blank = codes == ord(" ")
        place = at - np.maximum.accumulate(np.where(blank, at, -1)) - 1
        ids = np.empty(1 + 2 * len(codes), np.int32)
        ids[0] = self.open
        ids[1::2] = np.where(blank, self.next_word, self.heads[codes] + (place > 0))
        ids[2::2] = np.where(blank, self.empty, np.where(codes == ord("."), self.bare, place % len(SYMBOL_TAILS)))
        ids[1 + 2 * ends] = self.close
        ids[2 + 2 * ends[:-1]] = self.open
        taken = self.array.take(pa.array(ids))
        _, offsets, data = taken.buffers()
        bounds = np.concatenate([[0], np.frombuffer(offsets, np.int32)[2 + 2 * ends]]).astype(np.int32)
        return pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds), data)


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id and text to doc_id and body, a bounded number of characters at a time."""
    bodies = _Bodies()

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts = zip(*rows)
        known = [t for t in texts if t is not None]
        made = bodies(known) if known else pa.array([], pa.string())
        if len(known) < len(texts):
            order = itertools.count()
            made = made.take(pa.array([None if t is None else next(order) for t in texts], pa.int32()))
        return pa.record_batch([pa.array(ids, pa.int64()), made], names=["doc_id", "body"])

    for batch in batches:
        rows, held = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            rows.append((doc_id, text))
            held += len(text or "")
            if held > TEXT_CHARS:
                yield packed(rows)
                rows, held = [], 0
        if rows:
            yield packed(rows)


def document_responses(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a stored response: one word per blank-separated run, one symbol per character.

    Digits become JSON numbers, full stops lose their vertices, vowels carry a
    boolean confidence, so the robust paths are met on real text. One row stays
    one row: the response is built inside the row. A response has some 70 times
    the bytes of its text, so few documents make a task.
    """
    docs = X.table(spark, d, "documents").select("doc_id", "text")
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-docs.count() // DOCUMENTS_PER_TASK))
    return docs.repartition(tasks).mapInArrow(_responses, "doc_id LONG, body STRING")


def response_symbols(spark: SparkSession, d: str) -> DataFrame:
    rows = explode_symbols(document_responses(spark, d), keep_dropped=True)
    kept = ~F.col("dropped")
    return rows.groupBy("doc_id").agg(
        F.count_if(kept).alias("symbols"),
        F.count_if(F.col("dropped")).alias("dropped"),
        F.sum(F.when(kept, F.col("x") * 2).otherwise(0)).cast("long").alias("sum_x2"),
        F.sum(F.when(kept, F.col("y") * 2).otherwise(0)).cast("long").alias("sum_y2"),
        F.count_if(kept & (F.col("conf") == 0)).alias("no_conf"),
        F.sum(F.when(kept, F.length("text")).otherwise(0)).alias("chars"),
        F.sum(F.when(kept, F.ascii("text")).otherwise(0)).cast("long").alias("codes"),
    )


RESPONSE_SQL = """
WITH words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents),
syms AS (SELECT doc_id, unnest(regexp_extract_all(w, '(?s).')) AS ch, unnest(range(len(regexp_extract_all(w, '(?s).')))) AS i FROM words),
flags AS (SELECT *, regexp_matches(ch, '^[0-9]$') OR ch = '.' AS drop_it FROM syms)
SELECT d.doc_id, count(*) FILTER (NOT drop_it) AS symbols, count(*) FILTER (drop_it) AS dropped,
 coalesce(sum(((i * 37) % 1800) * 2 + 9) FILTER (NOT drop_it), 0)::BIGINT AS sum_x2,
 coalesce(sum(7) FILTER (NOT drop_it), 0)::BIGINT AS sum_y2,
 count(*) FILTER (NOT drop_it AND regexp_matches(ch, '^[aeiou]$')) AS no_conf,
 coalesce(sum(length(ch)) FILTER (NOT drop_it), 0)::BIGINT AS chars,
 coalesce(sum(unicode(ch)) FILTER (NOT drop_it), 0)::BIGINT AS codes
FROM flags d GROUP BY d.doc_id"""

COUNTERS_SQL = """
, c_face AS (SELECT page_id, count(*) AS in_face, count(*) FILTER (kind = 'below_table') AS below, count(*) FILTER (kind = 'other') AS other_direct FROM placed GROUP BY 1),
c_lost AS (SELECT l.page_id, count(*) AS fallback_discarded, count(*) FILTER (NOT s.output) AS fallback_discarded_excluded, count(*) FILTER (l.probe_field IS NULL) AS other_lost
  FROM lost l JOIN spec s USING (field_id) GROUP BY 1),
c_used AS (SELECT d.page_id, count(*) FILTER (origin = 'fallback') AS fallback_used, count(*) FILTER (origin = 'conflict' AND NOT s.output) AS conflict_excluded
  FROM decided d JOIN spec s USING (field_id) GROUP BY 1),
c_hole AS (SELECT h.page_id, sum(holes)::BIGINT AS carve_hole, coalesce(sum(holes) FILTER (NOT s.output), 0)::BIGINT AS carve_hole_excluded FROM hole h JOIN spec s USING (field_id) GROUP BY 1),
counters AS (SELECT p.page_id, p.template_id, coalesce(in_face, 0) AS in_face, coalesce(below, 0) AS below, coalesce(fallback_used, 0) AS fallback_used,
 coalesce(fallback_discarded, 0) AS fallback_discarded, coalesce(carve_hole, 0) AS carve_hole, coalesce(fallback_discarded_excluded, 0) AS fallback_discarded_excluded,
 coalesce(carve_hole_excluded, 0) AS carve_hole_excluded, coalesce(conflict_excluded, 0) AS conflict_excluded, coalesce(other_direct, 0) + coalesce(other_lost, 0) AS other
FROM page p LEFT JOIN c_face USING (page_id) LEFT JOIN c_lost USING (page_id) LEFT JOIN c_used USING (page_id) LEFT JOIN c_hole USING (page_id))
"""

ENTRIES = {
    "face_local_symbols": Entry(face_local, CTE + "SELECT page_id, face_id, seq, x, y, text, conf FROM local"),
    "symbol_assignment": Entry(
        symbol_assignment,
        CTE + "SELECT page_id, face_id, seq, x, y, kind, field_id, region FROM placed WHERE field_id IS NOT NULL",
    ),
    "unassigned_symbols": Entry(
        unassigned_symbols, CTE + "SELECT page_id, face_id, seq, x, y, kind FROM placed WHERE field_id IS NULL"
    ),
    "symbol_disposition": Entry(
        symbol_disposition, CTE + "SELECT page_id, kind, count(*) AS symbols FROM placed GROUP BY 1, 2"
    ),
    "discarded_fallback_symbols": Entry(
        discarded_fallback_symbols,
        CTE + "SELECT page_id, field_id, coalesce(probe_field, '') AS hole_field, count(*) AS symbols FROM lost GROUP BY 1, 2, 3",
    ),
    "reading_order_text": Entry(
        reading_order_text, CTE + "SELECT page_id, field_id, raw, conf, confs FROM content WHERE field_id <> 'addr'"
    ),
    "multi_region_text": Entry(
        multi_region_text, CTE + "SELECT page_id, field_id, raw, conf, confs FROM content WHERE field_id = 'addr'"
    ),
    "fallback_choice": Entry(fallback_choice, CTE + "SELECT page_id, field_id, n_main, n_fb, origin FROM decided"),
    "cell_contents": Entry(
        cell_contents, CTE + "SELECT page_id, field_id, raw, conf, origin, confs, holes FROM cell"
    ),
    "empty_table_rows": Entry(
        empty_table_rows,
        CTE + """SELECT p.page_id, r.table_id, r.row_no FROM page p CROSS JOIN
 (SELECT DISTINCT table_id, row_no FROM spec WHERE table_id IS NOT NULL) r
 WHERE NOT EXISTS (SELECT 1 FROM cell c JOIN spec s USING (field_id) WHERE c.page_id = p.page_id AND s.table_id = r.table_id AND s.row_no = r.row_no)""",
    ),
    "page_counters": Entry(page_counters, CTE + COUNTERS_SQL + "SELECT * EXCLUDE (template_id) FROM counters"),
    "format_mismatch": Entry(
        format_mismatch,
        CTE + COUNTERS_SQL + """, area AS (SELECT template_id, CAST(sum(w * h) FILTER (layer < 2) AS DOUBLE) / 2160000 AS coverage FROM places GROUP BY 1),
 ratio AS (SELECT template_id, CASE WHEN coverage >= 0.35 THEN 0.55 ELSE 0.55 + (0.70 - 0.55) * (1.0 - coverage / 0.35) END AS ratio FROM area)
 SELECT page_id, in_face, other, in_face = 0 OR CAST(other AS DOUBLE) / in_face > ratio AS mismatch FROM counters JOIN ratio USING (template_id)""",
    ),
    "overflow_candidates": Entry(
        overflow_candidates,
        CTE + """, aim AS (SELECT template_id, face_id, field_id, x, y, w, h FROM places WHERE kind = 'region' AND field_id = '郵便番号'),
 near AS (SELECT l.rid, l.page_id, a.field_id, l.x < a.x + a.w AS is_main, EXISTS (SELECT 1 FROM cand c WHERE c.rid = l.rid AND c.layer < 2) AS taken
  FROM local l JOIN aim a ON a.template_id = l.template_id AND a.face_id = l.face_id AND l.x >= a.x AND l.x < a.x + a.w + a.h AND l.y >= a.y AND l.y < a.y + a.h)
 SELECT page_id, field_id, 7 AS digits, count(*) FILTER (is_main) AS main_symbols, count(*) FILTER (NOT is_main) AS right_symbols,
  count(*) FILTER (NOT is_main AND NOT taken) AS right_outside_fields FROM near GROUP BY 1, 2
 HAVING count(*) FILTER (is_main) > 0 AND count(*) FILTER (is_main) < 7 AND count(*) FILTER (NOT is_main) > 0""",
    ),
    "empty_main_fields": Entry(
        empty_main_fields,
        CTE + """SELECT l.page_id, 1 AS targets, 1 - max(CASE WHEN p.rid IS NULL THEN 0 ELSE 1 END) AS empty_main FROM local l
 LEFT JOIN (SELECT DISTINCT rid FROM cand WHERE field_id = '郵便番号' AND pkind = 'region') p USING (rid) GROUP BY 1""",
    ),
    "response_symbols": Entry(response_symbols, RESPONSE_SQL),
}
