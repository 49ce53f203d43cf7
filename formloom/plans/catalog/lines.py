"""Queries over line positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.operators import lines as L
from formloom.operators import matching as M
from formloom.operators import runs as U
from formloom.operators import snapping as G
from formloom.plans import fixtures as X
from formloom.plans.catalog import Entry
from formloom.session import kept
from formloom.sources.templates import expand_templates

def found_lines(spark: SparkSession, d: str) -> DataFrame:
    return X.from_sql(spark, d, X.FOUND_SQL, "lineitem")


def printed_lines(spark: SparkSession, d: str) -> DataFrame:
    """What the documents of the ruled forms say is printed."""
    return kept(L.expected_lines(X.ruled_tables(spark, d).faces))


def expected_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of forms with tables on one face and single fields on the other."""
    return L.expected_lines(X.form_tables(spark, d).faces)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return X.pages(spark, d).select("page_id", "template_id")


def _estimates(spark: SparkSession, d: str) -> DataFrame:
    return L.match_lines(_pages(spark, d), found_lines(spark, d), printed_lines(spark, d))


def shift_estimates(spark: SparkSession, d: str) -> DataFrame:
    return _estimates(spark, d).select(
        "page_id", "face_id", "dx", "dy", "matched", "det_h", "det_v", "matched_uniq", "at_boundary", "reason"
    )


def face_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return L.face_verdicts(_estimates(spark, d)).select("page_id", "face_id", "verdict", "why", "score")


def page_verdicts(spark: SparkSession, d: str) -> DataFrame:
    faces = L.face_verdicts(_estimates(spark, d)).withColumn("face_ord", F.when(F.col("face_id") == "front", 0).otherwise(1))
    return L.fold_verdicts(faces, ["page_id"])


# Every eleventh page has no height, every fifth one has the shape of the dense forms.
MATCH_PAGE_SQL = """
SELECT page_id, CAST(page_id % 7 AS INT) AS catalogue, 1800 AS w, CASE WHEN page_id % 11 = 0 THEN 0 WHEN page_id % 5 = 0 THEN 1360 ELSE 1440 END AS h
FROM (SELECT DISTINCT CAST(floor(o_orderkey / 25) AS BIGINT) AS page_id FROM orders) AS p"""

# Each catalogue offers the forms of some nations; the first form is in three of them, and one name has no document.
CATALOGUE_SQL = """
SELECT CAST(n_nationkey % 7 AS INT) AS catalogue, CASE WHEN n_nationkey = 0 THEN 'shipped' ELSE 'user' END AS kind, concat('n', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS name FROM nation
UNION ALL SELECT c, k, name FROM (VALUES (1, 'shipped', 'n00'), (2, 'shipped', 'n00'), (3, 'user', 'gone')) AS x(c, k, name)"""

CANDIDATES = (("even", 60, 12), ("wide", 80, 9), ("dense", 40, 17), ("half", 120, 6))


def candidate_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every page against four forms; the list of forms is the candidate set of its aspect."""
    docs = [F.lit(X.ruled_form([(0, k - 1)], p, k - 1).replace("@id", n)) for n, p, k in CANDIDATES]
    expected = kept(L.expected_lines(expand_templates(spark.range(1).select(F.explode(F.array(*docs)).alias("body"))).faces))
    pages = _pages(spark, d).select("page_id", F.explode(F.array(*[F.lit(n) for n, _, _ in CANDIDATES])).alias("template_id"))
    faces = L.face_verdicts(L.match_lines(pages, found_lines(spark, d), expected)).withColumn(
        "face_ord", F.when(F.col("face_id") == "front", 0).otherwise(1)
    )
    folded = L.fold_verdicts(faces, ["page_id", "template_id"])
    return L.rank_candidates(folded.select("page_id", F.col("template_id").alias("name"), "verdict", "score"))


def _match_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages with a size and one of seven catalogues, the documents of all nations, and which catalogue offers which."""
    n = F.col("n_nationkey")
    form = F.element_at(F.array(*[F.lit(X.ruled_form([(0, k - 1)], p, k - 1)) for _, p, k in CANDIDATES]), (n % 4 + 1).cast("int"))
    body = F.replace(form, F.lit("@id"), F.concat(F.lit("id-"), n.cast("string")))
    two = F.lpad(n.cast("string"), 2, "0")
    nation = X.table(spark, d, "nation")
    documents = nation.withColumn("body", body).select(
        F.concat(F.lit("n"), two).alias("name"), F.concat(F.lit("2024-03-"), two).alias("updated_at"),
        F.when(n % 9 == 7, F.expr("left(body, length(body) - 5)")).when(n % 9 == 8, F.lit('{"faces": []}')).otherwise(F.col("body")).alias("body"),
    )
    return X.from_sql(spark, d, MATCH_PAGE_SQL, "orders"), documents, X.from_sql(spark, d, CATALOGUE_SQL, "nation")


def matched_templates(spark: SparkSession, d: str) -> DataFrame:
    pages, documents, catalogue = _match_inputs(spark, d)
    return M.matched_templates(pages, found_lines(spark, d), documents, catalogue)


def truncated_matches(spark: SparkSession, d: str) -> DataFrame:
    """Three entries of a catalogue are looked at; catalogues that have more give no pick."""
    pages, documents, catalogue = _match_inputs(spark, d)
    return M.matched_templates(pages, found_lines(spark, d), documents, catalogue, limit=3)


def gap_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pages against the readable forms of all nations: which have the gaps that a match needs."""
    _, documents, _ = _match_inputs(spark, d)
    expected = kept(L.expected_lines(expand_templates(L.renamed(documents.filter(F.col("body").endswith("}") & (F.length("body") > 20)))).faces))
    pairs = _pages(spark, d).select("page_id", F.explode(F.array(*[F.lit(f"n{i:02d}") for i in range(25)])).alias("template_id"))
    return M.gap_candidates(pairs, found_lines(spark, d), expected)


def screened_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Templates of all parts as candidates; some documents are cut short, empty or without output."""
    p = F.col("p_partkey")
    body = (
        F.when(p % 7 == 0, F.expr("left(body, length(body) - 5)"))
        .when(p % 7 == 1, F.lit('{"faces": []}'))
        .when(p % 7 == 2, F.regexp_replace("body", '"field_id": "total"', '"field_id": "name"'))
        .otherwise(F.col("body"))
    )
    docs = X.part_templates(spark, d).select(F.format_string("c%08d", p).alias("name"), body.alias("body"))
    return L.screen_candidates(docs)


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sheets of various sizes with the forms of their aspect."""
    pages = X.table(spark, d, "part").select(
        F.col("p_partkey").alias("page_id"), (F.col("p_partkey") % 50 * 6 + 1650).alias("w"),
        F.when(F.col("p_partkey") % 97 == 0, 0).otherwise(F.col("p_size") * 2 + 1150).alias("h"),
    )
    forms = X.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("template_id"), (F.col("n_nationkey") * 20 + 1600).alias("image_w"), F.lit(1200).alias("image_h")
    )
    return L.candidate_pairs(pages, forms)


def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages, their customers' markets as candidates with scores from the order."""
    raw = X.from_sql(
        spark, d,
        """SELECT l_orderkey AS page_id, concat('form-', CAST(l_linenumber AS STRING)) AS name, max(CAST(l_discount AS DOUBLE) * 10) AS score,
 CASE WHEN max(l_returnflag) = 'A' THEN 'mismatch' ELSE 'match' END AS verdict FROM lineitem GROUP BY 1, 2""",
        "lineitem",
    )
    cut = X.table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("page_id"))
    return L.rank_candidates(raw, cut)


def nearest_lines(spark: SparkSession, d: str) -> DataFrame:
    """Expected positions 0, 80, ..., 400 against the lines of every page."""
    lines = X.from_sql(spark, d, X.LINE_SQL, "lineitem")
    targets = lines.select("page_id").distinct().select(
        "page_id", F.explode(F.array(*[F.lit(80 * i) for i in range(6)])).alias("target")
    )
    return L.nearest_lines(targets, lines, ["page_id"])


def line_residuals(spark: SparkSession, d: str) -> DataFrame:
    return L.line_residuals(nearest_lines(spark, d), ["page_id"], F.lit(5))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    ok = kept(_estimates(spark, d).filter(F.col("reason") == ""))
    return L.block_shifts(_pages(spark, d), found_lines(spark, d), printed_lines(spark, d), ok)


def _tolerance(spark: SparkSession, d: str) -> DataFrame:
    return printed_lines(spark, d).select("template_id", "face_id", "block_idx", F.lit(2).alias("row_gap")).distinct()


def block_residuals(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("page_id", "face_id", "block_idx", "block_votes", "block_expected", "med", "max_abs", "pairs", "unpaired")


def snap_plans(spark: SparkSession, d: str) -> DataFrame:
    return L.snap_plan(_blocks(spark, d), _tolerance(spark, d)).select(
        "page_id", "face_id", "outcome", "applied",
        F.array_join(F.transform("blocks", lambda b: b["dy"].cast("string")), ",").alias("dys"),
    )


def _block_rects(spark: SparkSession, d: str) -> DataFrame:
    """One rect per printed row band, 58 px high, and a single field that does not move."""
    lines = printed_lines(spark, d).filter(F.col("axis") == "h")
    rects = lines.select(
        "template_id", "face_id", "block_idx", F.concat(F.lit("r"), F.lpad(F.col("pos").cast("string"), 3, "0")).alias("field_id"),
        F.lit(0).alias("x"), F.col("pos").alias("y"), F.lit(100).alias("w"), F.lit(58).alias("h"),
    )
    single = lines.select(
        "template_id", "face_id", F.lit(None).cast("int").alias("block_idx"), F.lit("single").alias("field_id"),
        F.lit(0).alias("x"), F.lit(720).alias("y"), F.lit(100).alias("w"), F.lit(40).alias("h"),
    ).distinct()
    return rects.unionByName(single)


def shifted_cells(spark: SparkSession, d: str) -> DataFrame:
    plan = L.snap_plan(_blocks(spark, d), _tolerance(spark, d))
    return L.apply_shift(_block_rects(spark, d), plan).select("page_id", "face_id", "field_id", "y", "new_y")


def new_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """With a tolerance of four pixels some blocks move into each other; two moves differ by eight at most."""
    wide = _tolerance(spark, d).withColumn("row_gap", F.lit(4))
    index = kept(G.overlap_index(_block_rects(spark, d), 8))
    return G.new_overlaps(L.snap_plan(_blocks(spark, d), wide), index)


def overlap_index(spark: SparkSession, d: str) -> DataFrame:
    """Moves of up to ten pixels each, so differences of up to twenty."""
    return G.overlap_index(_block_rects(spark, d), 20)


def _gated(spark: SparkSession, d: str) -> DataFrame:
    """Moves of up to four pixels; some forms have a face without tables, others one with a small table."""
    number = F.substring("template_id", 6, 9).cast("int")
    blocks = _blocks(spark, d).withColumn("block_expected", F.when((number % 7 == 3) & (F.col("face_id") == "front"), F.lit(4)).otherwise(F.col("block_expected")))
    tolerance = _tolerance(spark, d).withColumn("row_gap", F.lit(4))
    blockless = (number % 5 == 1) & (F.col("face_id") == "back")
    faces = tolerance.groupBy("template_id", "face_id").agg(F.count(F.lit(1)).alias("n")).withColumn("n_blocks", F.when(blockless, 0).otherwise(F.col("n")))
    index = kept(G.overlap_index(_block_rects(spark, d), 8))
    return G.snap_gate(faces, _estimates(spark, d), L.snap_plan(blocks, tolerance), index)


def snap_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).drop("template_id")


def snap_counters(spark: SparkSession, d: str) -> DataFrame:
    return G.snap_counters(_gated(spark, d)).groupBy("counted").agg(F.count(F.lit(1)).alias("pages"))


def otsu_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return L.otsu_threshold(X.from_sql(spark, d, X.HIST_SQL, "events"), ["grp"])


def ink_profile(spark: SparkSession, d: str) -> DataFrame:
    runs = X.from_sql(spark, d, X.RUN_SQL, "lineitem")
    return U.profile(runs, ["page_id"], F.lit(100), F.lit(500))


def line_positions(spark: SparkSession, d: str) -> DataFrame:
    return L.line_positions(ink_profile(spark, d), ["page_id"], F.lit(150))


PROFILE_SQL = f"""WITH r AS ({X.RUN_SQL}), c AS (SELECT page_id, scan, greatest(s, 100) AS s, least(e + 1, 500) AS e FROM r), d AS (SELECT * FROM c WHERE e > s),
b AS (SELECT *, max(e) OVER (PARTITION BY page_id, scan ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
i AS (SELECT *, sum(CASE WHEN s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, scan ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM b),
u AS (SELECT page_id, scan, isle, max(e) - min(s) AS len FROM i GROUP BY 1, 2, 3), prof AS (SELECT page_id, scan, sum(len)::BIGINT AS ink FROM u GROUP BY 1, 2)
"""


def _estimate_ctes(pages: str, printed: str) -> str:
    """CTE est (page_id, template_id, face_id, ...) by comparing every shift with every line."""
    return f"""
pg AS ({pages}), pr AS ({printed}), fo AS ({X.FOUND_SQL}),
det AS (SELECT DISTINCT page_id, face_id, axis, pos FROM fo),
sh AS (SELECT unnest(range(-60, 61))::INT AS s),
ex AS (SELECT *, row_number() OVER () AS eid FROM pr),
near0 AS (SELECT p.page_id, p.template_id, e.face_id, e.axis, e.eid, e.lim, d.pos - e.pos AS diff FROM pg p JOIN ex e USING (template_id)
  JOIN det d ON d.page_id = p.page_id AND d.face_id = e.face_id AND d.axis = e.axis AND abs(d.pos - e.pos) <= e.lim + 1),
vote AS (SELECT n.page_id, n.template_id, n.face_id, n.axis, sh.s, count(DISTINCT n.eid) AS votes FROM near0 n JOIN sh ON abs(n.diff - sh.s) <= 1 AND abs(sh.s) <= n.lim GROUP BY ALL),
base AS (SELECT p.page_id, p.template_id, e.face_id, e.axis, count(*) AS n_exp, count(DISTINCT e.pos) AS n_uniq, max(e.lim) AS lim FROM pg p JOIN ex e USING (template_id) GROUP BY ALL),
best AS (SELECT * FROM vote QUALIFY row_number() OVER (PARTITION BY page_id, template_id, face_id, axis ORDER BY votes DESC, abs(s), s) = 1),
ax AS (SELECT b.*, coalesce(t.s, 0) AS s, coalesce(t.votes, 0) AS votes,
  coalesce((SELECT max(v.votes) FROM vote v WHERE v.page_id = b.page_id AND v.template_id = b.template_id AND v.face_id = b.face_id AND v.axis = b.axis AND abs(v.s - coalesce(t.s, 0)) >= 4), 0) AS runner
  FROM base b LEFT JOIN best t USING (page_id, template_id, face_id, axis)),
tg AS (SELECT DISTINCT a.page_id, a.template_id, a.face_id, a.axis, a.s, e.pos FROM ax a JOIN ex e ON e.template_id = a.template_id AND e.face_id = a.face_id AND e.axis = a.axis),
dist AS (SELECT t.*, min(abs(d.pos - t.pos - t.s)) AS ad FROM tg t LEFT JOIN det d ON d.page_id = t.page_id AND d.face_id = t.face_id AND d.axis = t.axis GROUP BY ALL),
ends AS (SELECT template_id, face_id, axis, block_idx, min(pos) AS pos FROM pr GROUP BY ALL UNION SELECT template_id, face_id, axis, block_idx, max(pos) FROM pr GROUP BY ALL),
fact AS (SELECT t.page_id, t.template_id, t.face_id, t.axis, count(*) FILTER (ad <= 1) AS mu,
  bool_and(CASE WHEN t.axis = 'h' AND e.pos IS NOT NULL THEN coalesce(ad <= 2, false) ELSE true END) AS edges
  FROM dist t LEFT JOIN (SELECT DISTINCT template_id, face_id, axis, pos FROM ends) e USING (template_id, face_id, axis, pos) GROUP BY ALL),
cnt AS (SELECT page_id, face_id, axis, count(*) AS n FROM det GROUP BY ALL),
full0 AS (SELECT a.*, f.mu, f.edges, coalesce(c.n, 0) AS n_det, greatest(2, ceil(n_exp * 0.5)) AS need FROM ax a JOIN fact f USING (page_id, template_id, face_id, axis)
  LEFT JOIN cnt c ON c.page_id = a.page_id AND c.face_id = a.face_id AND c.axis = a.axis),
est AS (SELECT page_id, template_id, face_id, max(s) FILTER (axis = 'v') AS dx, max(s) FILTER (axis = 'h') AS dy, sum(votes)::BIGINT AS matched,
  max(n_det) FILTER (axis = 'h') AS det_h, max(n_det) FILTER (axis = 'v') AS det_v, max(n_uniq) FILTER (axis = 'h') AS exp_h, max(n_uniq) FILTER (axis = 'v') AS exp_v,
  sum(mu)::BIGINT AS matched_uniq, bool_or(abs(s) >= lim AND lim > 0) AS at_boundary,
  CASE WHEN bool_or(votes < need) THEN 'few_lines' WHEN bool_or(abs(s) >= lim AND lim > 0) THEN 'boundary' WHEN bool_or(votes - runner < 2) THEN 'ambiguous'
   WHEN NOT bool_and(edges) THEN 'edge_mismatch' ELSE '' END AS reason FROM full0 GROUP BY 1, 2, 3),
verd AS (SELECT *, CASE reason WHEN '' THEN 'match' WHEN 'boundary' THEN 'undecidable' WHEN 'edge_mismatch' THEN 'undecidable' WHEN 'ambiguous' THEN 'mismatch'
   ELSE CASE WHEN det_h < exp_h * 0.5 OR det_v < exp_v * 0.5 OR at_boundary THEN 'undecidable' ELSE 'mismatch' END END AS verdict,
  CASE reason WHEN '' THEN '' WHEN 'boundary' THEN 'boundary' WHEN 'edge_mismatch' THEN 'edge' WHEN 'ambiguous' THEN 'ambiguous'
   ELSE CASE WHEN det_h < exp_h * 0.5 OR det_v < exp_v * 0.5 THEN 'few_lines' WHEN at_boundary THEN 'boundary' ELSE 'lines' END END AS why,
  matched_uniq::DOUBLE / (exp_h + exp_v) AS score FROM est),
folded AS (SELECT * FROM verd QUALIFY row_number() OVER (PARTITION BY page_id, template_id ORDER BY CASE verdict WHEN 'mismatch' THEN 0 WHEN 'match' THEN 2 ELSE 1 END, score, face_id DESC) = 1)
"""


def _expected_sql() -> str:
    """The lines of FORM, listed document by document."""
    rows = []
    for face in X.FORM["faces"]:
        f, tables = face["face_id"], face["tables"]
        if tables:
            b, pitches, gaps, found = 0, [], [], []
            for t in tables:
                edges = sorted({c["x_offset"] for c in t["columns"]} | {max(c["x_offset"] + c["width"] for c in t["columns"])})
                gaps += [q - p for p, q in zip(edges, edges[1:])]
                for block in t["blocks"]:
                    y, n = block["origin"]["y"], block["rows"]
                    found += [(b, "h", y + i * t["row_pitch"], i in (0, n)) for i in range(n + 1)] + [(b, "v", block["origin"]["x"] + e, False) for e in edges]
                    pitches.append(t["row_pitch"])
                    b += 1
            limit = {"h": min(pitches) // 2 - 2, "v": min(gaps) // 2 - 2}
            rows += [f"('{f}', '{axis}', {block}, {pos}, 0, {limit[axis]}, {str(edge).lower()})" for block, axis, pos, edge in found]
        else:
            rects = [c["rect"] for c in face["fields"]]
            number = lambda v: int(str(v).lstrip("+"))
            for axis, at, size, across in (("h", "y", "h", "w"), ("v", "x", "w", "h")):
                ends = [p for r in rects if number(r[across]) >= 40 for p in (number(r[at]), number(r[at]) + number(r[size]))]
                moved = int(any(str(r[at]).startswith("+") for r in rects))
                rows += [f"('{f}', '{axis}', NULL, {p}, {moved}, 24, {str(p in (min(ends), max(ends))).lower()})" for p in ends]
    return f"""WITH l(face_id, axis, block_idx, p, moved, lim, is_edge) AS (VALUES {', '.join(rows)})
 SELECT 'form-' || n_nationkey AS template_id, face_id, axis, block_idx, p + moved * {X.STEP} * n_nationkey AS pos, lim AS "limit", 4 AS apart, is_edge FROM nation, l"""


_EST = "WITH" + _estimate_ctes(X.PAGE_SQL, X.PRINTED_SQL)
_CAND = ", ".join(f"('{n}', {p}, {k})" for n, p, k in CANDIDATES)
_CAND_EST = "WITH" + _estimate_ctes(
    f"SELECT p.page_id, c.n AS template_id FROM ({X.PAGE_SQL}) p CROSS JOIN (VALUES {_CAND}) c(n, p, k)",
    f"""SELECT c.n AS template_id, f.face_id, a.axis, 0 AS block_idx, (i.i * c.p)::INT AS pos, c.p // 2 - 2 AS lim FROM (VALUES {_CAND}) c(n, p, k), (VALUES ('front'), ('back')) f(face_id),
 (VALUES ('h'), ('v')) a(axis), (SELECT unnest(range(0, 17)) AS i) i WHERE i.i < c.k""",
)
_RANK = """, m AS (SELECT *, list_sort(list(score) FILTER (verdict = 'match') OVER (PARTITION BY page_id), 'DESC') AS ss FROM cand),
 c AS (SELECT *, NOT cut AND len(ss) > 0 AND coalesce(ss[1] - ss[2] >= 0.1, true) AS clear FROM m)
 SELECT page_id, name, verdict, score, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN coalesce(clear, false) THEN -score END, name) AS rank,
  coalesce(clear, false) AND verdict = 'match' AND score = ss[1] AS pick, NOT cut AND (ss[1] IS NULL OR coalesce(ss[1] - ss[2] >= 0.1, true)) AS show_score FROM c"""
_BLOCKS = _EST + f""", okp AS (SELECT page_id, template_id, face_id, dy FROM est WHERE reason = ''),
 bdet AS (SELECT DISTINCT page_id, face_id, block_idx, pos FROM fo WHERE axis = 'h'),
 bt AS (SELECT o.page_id, o.template_id, o.face_id, e.block_idx, e.pos, o.dy FROM okp o JOIN pr e ON e.template_id = o.template_id AND e.face_id = o.face_id AND e.axis = 'h'),
 bd0 AS (SELECT t.*, d.pos - t.pos - t.dy AS diff FROM bt t LEFT JOIN bdet d ON d.page_id = t.page_id AND d.face_id = t.face_id AND d.block_idx = t.block_idx),
 bd AS (SELECT * FROM bd0 QUALIFY row_number() OVER (PARTITION BY page_id, face_id, block_idx, pos ORDER BY abs(diff), diff DESC) = 1),
 br AS (SELECT page_id, template_id, face_id, block_idx, list_sort(list(diff) FILTER (abs(diff) <= 28)) AS ds, count(*) AS n FROM bd GROUP BY ALL),
 bv0 AS (SELECT t.page_id, t.face_id, t.block_idx, sh.s, count(DISTINCT t.pos) AS votes FROM (SELECT DISTINCT page_id, face_id, block_idx, pos FROM bt) t JOIN sh ON abs(sh.s) <= 28
   JOIN bdet d ON d.page_id = t.page_id AND d.face_id = t.face_id AND d.block_idx = t.block_idx AND abs(d.pos - t.pos - sh.s) <= 1 GROUP BY ALL),
 bv AS (SELECT page_id, face_id, block_idx, max(votes) AS votes FROM bv0 GROUP BY ALL),
 blk AS (SELECT r.page_id, r.template_id, r.face_id, r.block_idx, coalesce(v.votes, 0) AS block_votes, n AS block_expected, coalesce(ds[((len(ds) + 1) // 2)::INT], 0) AS med,
  coalesce(list_max(list_transform(ds, lambda q: abs(q))), 0) AS max_abs, coalesce(len(ds), 0) AS pairs, n - coalesce(len(ds), 0) AS unpaired FROM br r LEFT JOIN bv v USING (page_id, face_id, block_idx)),
 plan AS (SELECT page_id, template_id, face_id, bool_or(block_votes < greatest(2, ceil(block_expected / 2.0)) OR abs(med) > {{tol}}) AS failsafe,
  string_agg(med::VARCHAR, ',' ORDER BY block_idx) AS dys, list(med ORDER BY block_idx) AS dl FROM blk GROUP BY 1, 2, 3),
 rect AS (SELECT DISTINCT template_id, face_id, block_idx, 'r' || lpad(pos::VARCHAR, 3, '0') AS field_id, pos AS y, 58 AS h FROM pr WHERE axis = 'h'
  UNION SELECT DISTINCT template_id, face_id, NULL, 'single', 720, 40 FROM pr),
 moved AS (SELECT p.page_id, p.face_id, r.field_id, r.y, r.h, r.y + CASE WHEN p.failsafe OR r.block_idx IS NULL THEN 0 ELSE p.dl[r.block_idx + 1] END AS new_y
  FROM plan p JOIN rect r ON r.template_id = p.template_id AND r.face_id = p.face_id)
"""

_GATE = _BLOCKS.format(tol=4) + """, np AS (SELECT a.page_id, a.face_id, count(*) AS n FROM moved a JOIN moved b ON a.page_id = b.page_id AND a.face_id = b.face_id AND a.field_id < b.field_id
 AND a.new_y < b.new_y + b.h AND b.new_y < a.new_y + a.h AND NOT (a.y < b.y + b.h AND b.y < a.y + a.h) GROUP BY 1, 2),
gate0 AS (SELECT e.page_id, e.face_id, e.reason AS off, p.failsafe, p.dl, coalesce(np.n, 0) AS n, CAST(split_part(e.template_id, '-', 2) AS INT) AS num
 FROM est e LEFT JOIN plan p ON p.page_id = e.page_id AND p.face_id = e.face_id LEFT JOIN np ON np.page_id = e.page_id AND np.face_id = e.face_id),
gate1 AS (SELECT *, num % 7 = 3 AND face_id = 'front' AS small FROM gate0),
gate AS (SELECT page_id, face_id, CASE WHEN off <> '' THEN 'no_estimate' WHEN num % 5 = 1 AND face_id = 'back' THEN 'no_blocks' WHEN small THEN 'excluded' WHEN failsafe THEN 'failsafe'
 WHEN n > 0 THEN 'overlap' ELSE '' END AS reason, CASE WHEN off <> '' OR small OR failsafe THEN 0 ELSE n END AS new_pairs, list_max(list_transform(dl, lambda v: abs(v))) AS far FROM gate1)
"""

_DOCS = f"""SELECT n_nationkey AS n, 'n' || lpad(n_nationkey::VARCHAR, 2, '0') AS name, f.p, f.k, CASE n_nationkey % 9 WHEN 7 THEN 'parse' WHEN 8 THEN 'schema' END AS bad
 FROM nation JOIN (VALUES {', '.join(f"({i}, {p}, {k})" for i, (_, p, k) in enumerate(CANDIDATES))}) f(m, p, k) ON n_nationkey % 4 = f.m"""
_FORM_LINES = f"""SELECT c.name AS template_id, f.face_id, a.axis, 0 AS block_idx, (i.i * c.p)::INT AS pos, c.p // 2 - 2 AS lim FROM ({_DOCS}) c, (VALUES ('front'), ('back')) f(face_id),
 (VALUES ('h'), ('v')) a(axis), (SELECT unnest(range(0, 17)) AS i) i WHERE i.i < c.k AND c.bad IS NULL"""


def _matched_sql(limit: int) -> str:
    """Offers, sizes, all votes, and the order to show."""
    entries = f"""SELECT p.page_id, p.w, p.h, o.kind, o.name, d.n, 2.0 * d.p * d.k AS ih, CASE WHEN place > {limit} THEN 'limit' WHEN d.n IS NULL THEN 'not_found' ELSE d.bad END AS excluded
 FROM ({MATCH_PAGE_SQL}) p JOIN (SELECT *, row_number() OVER (PARTITION BY catalogue ORDER BY kind <> 'shipped', name) AS place FROM ({CATALOGUE_SQL.replace("AS STRING", "AS VARCHAR")}) q) o USING (catalogue)
 LEFT JOIN ({_DOCS}) d ON d.name = o.name"""
    fit = "excluded IS NULL AND h > 0 AND abs(w::DOUBLE / h - 1800 / ih) / (1800 / ih) <= 0.01"
    return "WITH" + _estimate_ctes(f"SELECT page_id, name AS template_id FROM ({entries}) WHERE {fit}", _FORM_LINES) + f""", en AS ({entries}),
 cand AS (SELECT e.page_id, e.kind, e.name, e.n, coalesce(f.verdict, 'mismatch') AS verdict, coalesce(f.why, 'size') AS why, coalesce(f.score, -1) AS score, coalesce(det_h + det_v, 0) AS detected,
  coalesce(exp_h + exp_v, 0) AS expected, bool_or(e.excluded = 'limit') OVER (PARTITION BY e.page_id) AS any_cut, e.excluded FROM en e LEFT JOIN folded f ON f.page_id = e.page_id AND f.template_id = e.name),
 live AS (SELECT *, coalesce(any_cut, false) AS cut FROM cand WHERE excluded IS NULL),
 m AS (SELECT *, list_sort(list(score) FILTER (verdict = 'match') OVER (PARTITION BY page_id), 'DESC') AS ss FROM live),
 c AS (SELECT *, coalesce(NOT cut AND len(ss) > 0 AND coalesce(ss[1] - ss[2] >= 0.1, true), false) AS clear FROM m)
 SELECT page_id, kind, name, 'id-' || n AS template_id, verdict, why, score, detected, expected, 0 AS fields, 2 AS tables, '2024-03-' || substr(name, 2) AS updated_at, NULL AS excluded,
  row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN clear THEN -score END, name) AS rank, clear AND verdict = 'match' AND score = ss[1] AS pick,
  NOT cut AND (ss[1] IS NULL OR coalesce(ss[1] - ss[2] >= 0.1, true)) AS show_score FROM c
 UNION ALL SELECT page_id, kind, name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN n IS NOT NULL THEN '2024-03-' || substr(name, 2) END, excluded, NULL, NULL, NULL FROM cand WHERE excluded IS NOT NULL"""


_GAP_SQL = f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY template_id, face_id, axis ORDER BY pos) AS i, count(*) OVER (PARTITION BY template_id, face_id, axis) AS n FROM ({_FORM_LINES})),
 d AS (SELECT DISTINCT page_id, face_id, axis, pos FROM ({X.FOUND_SQL})), g AS (SELECT a.template_id, a.face_id, a.axis, a.n, a.i, b.i AS j, a.pos, b.pos - a.pos AS gap, a.lim FROM e a JOIN e b
  ON a.template_id = b.template_id AND a.face_id = b.face_id AND a.axis = b.axis AND b.i - a.i BETWEEN 1 AND 3),
 q AS (SELECT a.page_id, a.face_id, a.axis, a.pos, b.pos - a.pos AS gap FROM d a JOIN d b ON a.page_id = b.page_id AND a.face_id = b.face_id AND a.axis = b.axis AND b.pos > a.pos),
 hit AS (SELECT q.page_id, g.template_id, g.face_id, g.axis, max(g.n) AS n, count(DISTINCT (g.i, g.j)) AS found FROM q JOIN g ON q.face_id = g.face_id AND q.axis = g.axis
  AND abs(q.gap - g.gap) <= 2 AND abs(q.pos - g.pos) <= g.lim + 1 GROUP BY ALL), ok AS (SELECT *, greatest(2, ceil(n / 2.0)) AS k FROM hit)
 SELECT page_id, template_id FROM ok WHERE found >= k - 1 - floor((n - k) / 3) AND page_id IN (SELECT page_id FROM ({X.PAGE_SQL})) GROUP BY ALL HAVING count(*) = 4"""

ENTRIES = {
    "matched_templates": Entry(matched_templates, _matched_sql(1000)),
    "truncated_matches": Entry(truncated_matches, _matched_sql(3)),
    "gap_candidates": Entry(gap_candidates, _GAP_SQL),
    "expected_lines": Entry(expected_lines, _expected_sql()),
    "shift_estimates": Entry(
        shift_estimates, _EST + "SELECT page_id, face_id, dx, dy, matched, det_h, det_v, matched_uniq, at_boundary, reason FROM est"
    ),
    "face_verdicts": Entry(face_verdicts, _EST + "SELECT page_id, face_id, verdict, why, score FROM verd"),
    "page_verdicts": Entry(
        page_verdicts, _EST + "SELECT page_id, verdict, why, score, det_h + det_v AS detected, exp_h + exp_v AS expected FROM folded"
    ),
    "candidate_matches": Entry(
        candidate_matches, _CAND_EST + ", cand AS (SELECT page_id, template_id AS name, verdict, score, false AS cut FROM folded)" + _RANK
    ),
    "screened_candidates": Entry(
        screened_candidates,
        """WITH c AS (SELECT printf('c%08d', p_partkey) AS name, CASE p_partkey % 7 WHEN 0 THEN 'parse' WHEN 1 THEN 'schema' WHEN 2 THEN 'schema' END AS bad FROM part)
 SELECT name, bad AS reason FROM c""",
    ),
    "candidate_pairs": Entry(
        candidate_pairs,
        """WITH p AS (SELECT p_partkey AS page_id, p_partkey % 50 * 6 + 1650 AS w, CASE WHEN p_partkey % 97 = 0 THEN 0 ELSE p_size * 2 + 1150 END AS h FROM part),
 f AS (SELECT n_nationkey AS template_id, n_nationkey * 20 + 1600 AS image_w, 1200 AS image_h FROM nation)
 SELECT page_id, template_id FROM p JOIN f ON h > 0 AND abs(w::DOUBLE / h - image_w::DOUBLE / image_h) / (image_w::DOUBLE / image_h) <= 0.01""",
    ),
    "ranked_candidates": Entry(
        ranked_candidates,
        """WITH cand AS (SELECT l_orderkey AS page_id, 'form-' || l_linenumber AS name, max(l_discount * 10) AS score, CASE WHEN max(l_returnflag) = 'A' THEN 'mismatch' ELSE 'match' END AS verdict,
  l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AS cut FROM lineitem GROUP BY ALL)""" + _RANK,
    ),
    "nearest_lines": Entry(
        nearest_lines,
        f"""WITH l AS ({X.LINE_SQL}), t AS (SELECT DISTINCT page_id, unnest([0, 80, 160, 240, 320, 400]) AS target FROM l)
 SELECT t.page_id, t.target, l.pos - t.target AS distance FROM t JOIN l USING (page_id) QUALIFY row_number() OVER (PARTITION BY t.page_id, t.target ORDER BY abs(l.pos - t.target), l.pos DESC) = 1""",
    ),
    "line_residuals": Entry(
        line_residuals,
        f"""WITH l AS ({X.LINE_SQL}), t AS (SELECT DISTINCT page_id, unnest([0, 80, 160, 240, 320, 400]) AS target FROM l),
 n AS (SELECT t.page_id, t.target, l.pos - t.target AS d FROM t JOIN l USING (page_id) QUALIFY row_number() OVER (PARTITION BY t.page_id, t.target ORDER BY abs(l.pos - t.target), l.pos DESC) = 1),
 g AS (SELECT page_id, list_sort(list(d) FILTER (abs(d) <= 5)) AS ds, count(*) AS n FROM n GROUP BY 1)
 SELECT page_id, coalesce(ds[((len(ds) + 1) // 2)::INT], 0) AS med, coalesce(list_max(list_transform(ds, lambda q: abs(q))), 0) AS max_abs, coalesce(len(ds), 0) AS pairs, n - coalesce(len(ds), 0) AS unpaired FROM g""",
    ),
    "block_residuals": Entry(
        block_residuals,
        _BLOCKS.format(tol=2) + "SELECT page_id, face_id, block_idx, block_votes, block_expected, med, max_abs, pairs, unpaired FROM blk",
    ),
    "snap_plans": Entry(
        snap_plans,
        _BLOCKS.format(tol=2) + "SELECT page_id, face_id, CASE WHEN failsafe THEN 'failsafe' ELSE 'none' END AS outcome, NOT failsafe AS applied, dys FROM plan",
    ),
    "shifted_cells": Entry(shifted_cells, _BLOCKS.format(tol=2) + "SELECT page_id, face_id, field_id, y, new_y FROM moved"),
    "new_overlaps": Entry(
        new_overlaps,
        _BLOCKS.format(tol=4) + """SELECT a.page_id, a.face_id, count(*) AS new_pairs FROM moved a JOIN moved b ON a.page_id = b.page_id AND a.face_id = b.face_id AND a.field_id < b.field_id
 AND a.new_y < b.new_y + b.h AND b.new_y < a.new_y + a.h AND NOT (a.y < b.y + b.h AND b.y < a.y + a.h) GROUP BY 1, 2""",
    ),
    "overlap_index": Entry(
        overlap_index,
        _BLOCKS.format(tol=4) + """, r AS (SELECT *, coalesce(block_idx, -1) AS block FROM rect), q AS (SELECT a.template_id, a.face_id, a.block AS a_block, b.block AS b_block, b.y - a.y - a.h AS lo, b.y + b.h - a.y AS hi
 FROM r a JOIN r b ON a.template_id = b.template_id AND a.face_id = b.face_id AND a.block < b.block AND a.field_id <> b.field_id)
 SELECT template_id, face_id, a_block, b_block, lo, hi, count(*) AS n FROM q WHERE (lo >= 0 OR hi <= 0) AND lo < 20 AND hi > -20 GROUP BY ALL""",
    ),
    "snap_gate": Entry(snap_gate, _GATE + "SELECT page_id, face_id, reason, reason = '' AS applied, new_pairs, CASE WHEN reason = '' THEN far END AS snap_px FROM gate"),
    "snap_counters": Entry(
        snap_counters,
        _GATE + """, c AS (SELECT page_id, CASE WHEN bool_or(reason = 'excluded') THEN 'excluded' WHEN bool_or(reason IN ('failsafe', 'overlap')) THEN 'failsafe' ELSE 'none' END AS counted FROM gate GROUP BY 1)
 SELECT counted, count(*) AS pages FROM c GROUP BY 1""",
    ),
    "otsu_thresholds": Entry(
        otsu_thresholds,
        f"""WITH h AS ({X.HIST_SQL}), t AS (SELECT grp, sum(n)::DOUBLE AS total, sum(n * bin)::DOUBLE AS m FROM h GROUP BY 1),
 k AS (SELECT h.grp, h.bin, sum(h.n) OVER w / t.total AS om, sum(h.n * h.bin) OVER w / t.total AS mu, t.m / t.total AS mean FROM h JOIN t USING (grp) WINDOW w AS (PARTITION BY h.grp ORDER BY h.bin)),
 s AS (SELECT grp, bin, (mean * om - mu) * (mean * om - mu) / (om * (1 - om)) AS sigma FROM k WHERE om * (1 - om) > 0)
 SELECT grp, coalesce((SELECT bin FROM s WHERE s.grp = t.grp ORDER BY sigma DESC, bin LIMIT 1), 128) AS threshold FROM t""",
    ),
    "ink_profile": Entry(ink_profile, PROFILE_SQL + "SELECT page_id, scan, ink FROM prof"),
    "line_positions": Entry(
        line_positions,
        PROFILE_SQL + """, d2 AS (SELECT page_id, scan FROM prof WHERE ink > 150), b2 AS (SELECT *, CASE WHEN scan - lag(scan) OVER (PARTITION BY page_id ORDER BY scan) > 6 THEN 1 ELSE 0 END AS brk FROM d2),
 g2 AS (SELECT *, sum(brk) OVER (PARTITION BY page_id ORDER BY scan) AS band FROM b2) SELECT page_id, floor(avg(scan))::INT AS pos FROM g2 GROUP BY page_id, band""",
    ),
}
