"""Queries over ink runs and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.operators import frames as R
from formloom.operators import runs as U
from formloom.plans import fixtures as X
from formloom.plans.catalog import Entry
from formloom.session import kept

PAGE_W, PAGE_H = 400, 360


def _ink(spark: SparkSession, d: str) -> DataFrame:
    return X.from_sql(spark, d, X.INK_SQL, "lineitem")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return X.from_sql(spark, d, X.SEGMENT_SQL.replace('AS "end"', "AS end"), "lineitem")


def bridged_runs(spark: SparkSession, d: str) -> DataFrame:
    return U.bridged_runs(X.from_sql(spark, d, X.RUN_SQL, "lineitem").withColumn("axis", F.lit("h")))


def line_segments(spark: SparkSession, d: str) -> DataFrame:
    return U.line_segments(_ink(spark, d))


def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    runs = X.from_sql(spark, d, X.RUN_SQL, "lineitem").select(
        "page_id", "scan", F.col("s").alias("start"), F.col("e").alias("end"), F.lit(100).alias("lo"), F.lit(450).alias("hi")
    )
    return U.interval_coverage(runs, ["page_id", "scan"], "lo", "hi")


def rails(spark: SparkSession, d: str) -> DataFrame:
    return U.rail_table(U.cluster_rails(_segments(spark, d)))


def wall_flags(spark: SparkSession, d: str) -> DataFrame:
    return U.wall_flags(U.cluster_rails(_segments(spark, d)))


def grid_components(spark: SparkSession, d: str) -> DataFrame:
    return U.grid_components(U.wall_flags(U.cluster_rails(_segments(spark, d))))


def _frames(spark: SparkSession, d: str) -> U.Frames:
    return U.detect_frames(_segments(spark, d), PAGE_W, PAGE_H)


def closed_cells(spark: SparkSession, d: str) -> DataFrame:
    railed = U.cluster_rails(_segments(spark, d))
    return U.closed_cells(U.grid_components(U.wall_flags(railed)), railed)


def frame_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d).ledger


def _masked(spark: SparkSession, d: str) -> DataFrame:
    return R.masked_runs(_ink(spark, d), R.page_exclusions(X.pages(spark, d), X.frame_tables(spark, d)))


def masked_runs(spark: SparkSession, d: str) -> DataFrame:
    """Ink around the excluded rect of the page's form; equal pieces stay as often as they come."""
    return _masked(spark, d)


def _page_frames(spark: SparkSession, d: str) -> U.Frames:
    """Every page of the orders, those without ink too."""
    pages = X.pages(spark, d).select("page_id", "template_id", F.lit(PAGE_W).alias("page_w"), F.lit(PAGE_H).alias("page_h"))
    ink = _masked(spark, d).filter(F.col("page_id") % 13 != 5)
    return R.page_frames(kept(U.line_segments(ink)), pages, X.frame_tables(spark, d))


def page_frames(spark: SparkSession, d: str) -> DataFrame:
    return _page_frames(spark, d).cells


def page_frame_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _page_frames(spark, d).ledger


def table_rows(spark: SparkSession, d: str) -> DataFrame:
    return U.table_rows(_frames(spark, d).cells).select(
        "page_id", "y1", "y2", "x_first", "cells", "residual",
        F.array_join(F.transform("bounds", lambda b: F.format_string("%.1f", b)), ",").alias("signature"),
    )


def table_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Tables found on every page, with their columns and cells, on the faces of the page's form."""
    found = U.table_suggestions(U.table_rows(_frames(spark, d).cells))
    named = found.withColumn("template_id", F.concat(F.lit("form-"), (F.col("page_id") % 25).cast("string")))
    placed = U.placed_suggestions(named, X.form_tables(spark, d))
    return placed.withColumn(
        "columns", F.array_join(F.transform("columns", lambda c: F.format_string("%d+%d", c["x_offset"], c["width"])), ",")
    ).withColumn("cell_indexes", F.array_join(F.transform("cell_indexes", lambda i: i.cast("string")), ","))


def ruled_grid(spark: SparkSession, d: str) -> DataFrame:
    lines = X.from_sql(spark, d, X.LINE_SQL, "lineitem")
    return U.fit_ruled_grid(lines.filter(F.col("pos") % 2 == 0), lines.filter(F.col("pos") % 2 == 1))


def uniform_grid(spark: SparkSession, d: str) -> DataFrame:
    parts = X.table(spark, d, "part").select(
        F.col("p_partkey").alias("region"), (F.col("p_size") * 17 + 100).cast("int").alias("w"), (F.col("p_size") * 11 + 60).cast("int").alias("h"),
        (F.col("p_partkey") % 6).cast("int").alias("rows"), (F.col("p_partkey") % 9).cast("int").alias("cols"),
    )
    return U.uniform_grid(parts)


def _candidate_rects(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(F.lit("form-"), (F.col("l_orderkey") % 25).cast("string")).alias("template_id"),
        ((F.col("l_partkey") * 37) % 1900).cast("int").alias("x"), ((F.col("l_suppkey") * 53 + F.col("l_partkey") * 29) % 1250).cast("int").alias("y"),
        (20 + F.col("l_quantity")).cast("int").alias("w"), (10 + F.col("l_quantity")).cast("int").alias("h"),
    )


def candidate_faces(spark: SparkSession, d: str) -> DataFrame:
    """Detected rects placed on the faces of their form and compared with its cells."""
    tables = X.form_tables(spark, d)
    faced = U.assign_face(_candidate_rects(spark, d), tables)
    return U.overlaps_existing(faced, tables, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x", "y", "face", "overlaps"
    )


def option_ink(spark: SparkSession, d: str) -> DataFrame:
    """Ink in the bands beside the option marks of every page."""
    tables = X.form_tables(spark, d)
    runs = X.from_sql(
        spark, d,
        """SELECT CAST(floor(l_orderkey / 25) AS BIGINT) AS page_id, concat('form-', CAST(CAST(floor(l_orderkey / 25) AS BIGINT) % 25 AS STRING)) AS template_id,
 CAST(95 + l_suppkey % 70 AS INT) AS scan, CAST(980 + l_partkey % 200 AS INT) AS s, CAST(980 + l_partkey % 200 + CAST(l_quantity AS BIGINT) AS INT) AS e FROM lineitem""",
        "lineitem",
    )
    return U.band_ink_ratio(runs, tables.cells.filter(F.size("marks") > 0), 1800, 700)


_BRIDGE = """b0 AS (SELECT page_id, axis, scan, s, max(e) AS e FROM ink GROUP BY ALL),
b1 AS (SELECT *, max(e) OVER (PARTITION BY page_id, axis, scan ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b0),
b2 AS (SELECT *, sum(CASE WHEN s - reach > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, axis, scan ORDER BY s ROWS UNBOUNDED PRECEDING) AS isle FROM b1),
b3 AS (SELECT page_id, axis, scan, CASE WHEN min(s) <= 4 THEN 0 ELSE min(s) END AS s, max(e) AS e FROM b2 GROUP BY page_id, axis, scan, isle),
brid AS (SELECT * FROM b3 WHERE e - s + 1 >= 60)"""

# Bundles, then lines, as parts of graphs.
_SEGMENTS = f"""WITH RECURSIVE ink AS ({X.INK_SQL}), {_BRIDGE},
node AS (SELECT *, row_number() OVER (ORDER BY page_id, axis, scan, s) AS id FROM brid),
edge AS (SELECT a.id AS i, b.id AS j FROM node a JOIN node b ON a.page_id = b.page_id AND a.axis = b.axis AND b.scan = a.scan + 1
  AND least(a.e, b.e) - greatest(a.s, b.s) + 1 >= 0.5 * least(a.e - a.s + 1, b.e - b.s + 1)),
both_ways AS (SELECT i, j FROM edge UNION ALL SELECT j, i FROM edge),
reach(id, lab) AS (SELECT id, id FROM node UNION SELECT r.id, e.j FROM reach r JOIN both_ways e ON e.i = r.lab),
comp AS (SELECT id, min(lab) AS lab FROM reach GROUP BY id),
bund AS (SELECT n.page_id, n.axis, c.lab, round_even(sum(n.scan)::DOUBLE / count(*), 1) AS pos, min(n.s)::BIGINT AS start, max(n.e)::BIGINT AS fin, count(DISTINCT n.scan)::BIGINT AS thick
  FROM node n JOIN comp c USING (id) GROUP BY 1, 2, 3 HAVING count(DISTINCT n.scan) <= 12),
along AS (SELECT a.lab AS i, b.lab AS j FROM bund a JOIN bund b ON a.page_id = b.page_id AND a.axis = b.axis AND a.lab <> b.lab AND abs(a.pos - b.pos) <= 2
  AND greatest(a.start - b.fin, b.start - a.fin) - 1 <= 12),
line(id, lab) AS (SELECT lab, lab FROM bund UNION SELECT l.id, e.j FROM line l JOIN along e ON e.i = l.lab),
whole AS (SELECT id, min(lab) AS line FROM line GROUP BY id)
SELECT page_id, axis, round_even(sum(pos * (fin - start + 1)) / sum(fin - start + 1), 1) AS pos, min(start) AS start, max(fin) AS "end", max(thick) AS thickness
FROM bund JOIN whole ON whole.id = bund.lab GROUP BY page_id, axis, line"""

_RAILS = f"""seg AS ({X.SEGMENT_SQL}),
r1 AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY page_id, axis ORDER BY pos) > 2 THEN 1 ELSE 0 END AS brk FROM seg),
r2 AS (SELECT *, sum(brk) OVER (PARTITION BY page_id, axis ORDER BY pos) AS rail FROM r1),
r3 AS (SELECT *, round_even(avg(pos) OVER (PARTITION BY page_id, axis, rail), 1) AS rail_pos FROM r2),
rt AS (SELECT page_id, axis, rail, any_value(rail_pos) AS rail_pos, max(abs(pos - rail_pos)) AS stray FROM r3 GROUP BY 1, 2, 3)"""
_WALLS = _RAILS + """,
okp AS (SELECT page_id FROM rt GROUP BY 1 HAVING count(*) FILTER (axis = 'h') >= 2 AND count(*) FILTER (axis = 'v') >= 2),
rr AS (SELECT * FROM rt JOIN okp USING (page_id)),
st AS (SELECT page_id, CASE axis WHEN 'h' THEN 'v' ELSE 'h' END AS axis, rail AS gap, rail_pos AS lo, lead(rail_pos) OVER (PARTITION BY page_id, axis ORDER BY rail) AS hi FROM rr),
wall AS (SELECT r.page_id, r.axis, r.rail, s.gap, s.lo, s.hi FROM rr r JOIN st s USING (page_id, axis) WHERE s.hi IS NOT NULL),
pc AS (SELECT w.*, greatest(w.lo, g.start) AS a, least(w.hi, g."end") AS b FROM wall w JOIN r3 g USING (page_id, axis, rail) WHERE least(w.hi, g."end") > greatest(w.lo, g.start)),
pr2 AS (SELECT *, max(b) OVER (PARTITION BY page_id, axis, rail, gap ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pc),
cov AS (SELECT page_id, axis, rail, gap, sum(greatest(0, b - greatest(a, coalesce(reach, a)))) AS len FROM pr2 GROUP BY 1, 2, 3, 4),
flag AS (SELECT w.page_id, w.axis, w.rail, w.gap, coalesce(c.len, 0) / (w.hi - w.lo) >= 0.90 AS closed FROM wall w LEFT JOIN cov c USING (page_id, axis, rail, gap))"""
_PARTS = _WALLS + """,
dim AS (SELECT page_id, count(*) FILTER (axis = 'h') - 1 AS nr, count(*) FILTER (axis = 'v') - 1 AS nc FROM rr GROUP BY 1),
cell AS (SELECT page_id, i, unnest(range(0, nc)) AS j FROM (SELECT page_id, nc, unnest(range(0, nr)) AS i FROM dim) q),
open AS (SELECT c.page_id, c.i, c.j, c.i AS i2, c.j + 1 AS j2 FROM cell c JOIN flag f ON f.page_id = c.page_id AND f.axis = 'v' AND f.rail = c.j + 1 AND f.gap = c.i AND NOT f.closed JOIN dim d ON d.page_id = c.page_id AND c.j + 1 < d.nc
  UNION ALL SELECT c.page_id, c.i, c.j, c.i + 1, c.j FROM cell c JOIN flag f ON f.page_id = c.page_id AND f.axis = 'h' AND f.rail = c.i + 1 AND f.gap = c.j AND NOT f.closed JOIN dim d ON d.page_id = c.page_id AND c.i + 1 < d.nr),
link AS (SELECT page_id, i * 1000 + j AS u, i2 * 1000 + j2 AS v FROM open UNION ALL SELECT page_id, i2 * 1000 + j2, i * 1000 + j FROM open),
walk(page_id, u, v) AS (SELECT page_id, i * 1000 + j, i * 1000 + j FROM cell UNION SELECT w.page_id, w.u, l.v FROM walk w JOIN link l ON l.page_id = w.page_id AND l.u = w.v),
lab AS (SELECT page_id, u, min(v) AS c FROM walk GROUP BY 1, 2),
box AS (SELECT page_id, c, min(u // 1000)::INT AS i0, max(u // 1000)::INT AS i1, min(u % 1000)::INT AS j0, max(u % 1000)::INT AS j1, count(*) AS n FROM lab GROUP BY 1, 2),
part AS (SELECT b.page_id, CASE WHEN n <> (i1 - i0 + 1) * (j1 - j0 + 1) THEN 'non_rectangular' WHEN EXISTS (SELECT 1 FROM flag f WHERE f.page_id = b.page_id AND NOT f.closed AND
   ((f.axis = 'h' AND f.rail IN (b.i0, b.i1 + 1) AND f.gap BETWEEN b.j0 AND b.j1) OR (f.axis = 'v' AND f.rail IN (b.j0, b.j1 + 1) AND f.gap BETWEEN b.i0 AND b.i1))) THEN 'not_closed' ELSE 'rect' END AS kind,
   i0, i1, j0, j1 FROM box b)"""
_CELLS = _PARTS + """,
closed AS (SELECT p.page_id, t.rail_pos AS y1, l.rail_pos AS x1, b.rail_pos AS y2, r.rail_pos AS x2, greatest(t.stray, b.stray, l.stray, r.stray) AS residual FROM part p
 JOIN rt t ON t.page_id = p.page_id AND t.axis = 'h' AND t.rail = p.i0 JOIN rt b ON b.page_id = p.page_id AND b.axis = 'h' AND b.rail = p.i1 + 1
 JOIN rt l ON l.page_id = p.page_id AND l.axis = 'v' AND l.rail = p.j0 JOIN rt r ON r.page_id = p.page_id AND r.axis = 'v' AND r.rail = p.j1 + 1 WHERE p.kind = 'rect')"""
_KEPT = _CELLS + f""",
judged AS (SELECT *, CASE WHEN x2 - x1 >= {PAGE_W} * 0.9 AND y2 - y1 >= {PAGE_H} * 0.9 THEN 'page_outline' WHEN x2 - x1 < 20 OR y2 - y1 < 20 THEN 'too_small' ELSE 'cell' END AS reason FROM closed)"""


_SPLIT = f"CASE page_id % 25 % 3 WHEN 0 THEN {X.FRAME_SPLITS[0]} WHEN 1 THEN {X.FRAME_SPLITS[1]} ELSE {X.FRAME_SPLITS[2]} END"


def _masked_sql() -> str:
    """What lies before and after the box, for runs on its scan lines."""
    b = X.FRAME_BOX
    on = f"(axis = 'h' AND scan >= {b['y']} AND scan < {b['y'] + b['h']} OR axis = 'v' AND scan >= {b['x']} AND scan < {b['x'] + b['w']})"
    lo, hi = f"CASE axis WHEN 'h' THEN {b['x']} ELSE {b['y']} END", f"CASE axis WHEN 'h' THEN {b['x'] + b['w']} ELSE {b['y'] + b['h']} END"
    return f"""SELECT page_id, axis, scan, s::BIGINT AS s, e::BIGINT AS e FROM ({X.INK_SQL}) i WHERE NOT {on}
 UNION ALL SELECT page_id, axis, scan, s, least(e, {lo} - 1) FROM ({X.INK_SQL}) i WHERE {on} AND s < {lo}
 UNION ALL SELECT page_id, axis, scan, greatest(s, {hi}), e FROM ({X.INK_SQL}) i WHERE {on} AND e >= {hi}"""


_FRAMES = "WITH RECURSIVE " + _KEPT.replace(X.SEGMENT_SQL, _SEGMENTS.replace(X.INK_SQL, f"SELECT * FROM ({_masked_sql()}) WHERE page_id % 13 <> 5")) + f""",
 fr AS (SELECT *, {_SPLIT} AS cut, round_even(x1, 0) AS x, round_even(y1, 0) AS y, round_even(x2 - x1, 0) AS w, round_even(y2 - y1, 0) AS h FROM judged),
 fd AS (SELECT *, CASE WHEN x + w / 2 < cut AND x + w <= cut THEN 'left' WHEN x + w / 2 >= cut AND x >= cut THEN 'right' ELSE 'straddle' END AS face FROM fr),
 fc AS (SELECT * REPLACE (CASE WHEN reason = 'cell' AND face = 'straddle' THEN 'straddles_face' ELSE reason END AS reason) FROM fd)
"""

ENTRIES = {
    "masked_runs": Entry(masked_runs, _masked_sql()),
    "page_frames": Entry(
        page_frames,
        _FRAMES + f"""SELECT page_id, y1, x1, y2, x2, residual, face, face = 'left' AND x < {X.FRAME_FIELD['x'] + X.FRAME_FIELD['w']} AND x + w > {X.FRAME_FIELD['x']}
 AND y < {X.FRAME_FIELD['y'] + X.FRAME_FIELD['h']} AND y + h > {X.FRAME_FIELD['y']} AS overlaps FROM fc WHERE reason = 'cell'""",
    ),
    "page_frame_ledger": Entry(
        page_frame_ledger,
        _FRAMES + f""", a AS (SELECT page_id, count(*) FILTER (axis = 'h') AS rails_h, count(*) FILTER (axis = 'v') AS rails_v FROM rt GROUP BY 1),
 s AS (SELECT page_id, count(*) FILTER (axis = 'h') AS lines_h, count(*) FILTER (axis = 'v') AS lines_v FROM seg GROUP BY 1),
 b AS (SELECT page_id, count(*) AS components, count(*) FILTER (kind = 'rect') AS rects, count(*) FILTER (kind = 'non_rectangular') AS non_rectangular, count(*) FILTER (kind = 'not_closed') AS not_closed FROM part GROUP BY 1),
 c AS (SELECT page_id, count(*) FILTER (reason = 'page_outline') AS page_outline, count(*) FILTER (reason = 'too_small') AS too_small, count(*) FILTER (reason = 'straddles_face') AS straddles_face, count(*) FILTER (reason = 'cell') AS cells FROM fc GROUP BY 1),
 l AS (SELECT p.page_id, {', '.join(f"coalesce({n}, 0) AS {n}" for n in "lines_h lines_v rails_h rails_v rects non_rectangular not_closed cells page_outline too_small straddles_face components".split())}
  FROM ({X.PAGE_SQL}) p LEFT JOIN s USING (page_id) LEFT JOIN a USING (page_id) LEFT JOIN b USING (page_id) LEFT JOIN c USING (page_id))
 SELECT *, CASE WHEN lines_h + lines_v = 0 THEN 'no_lines' WHEN rects = 0 THEN 'no_rect' WHEN cells = 0 THEN 'all_filtered' END AS zero_reason FROM l""",
    ),
    "bridged_runs": Entry(bridged_runs, f"WITH ink AS (SELECT *, 'h' AS axis FROM ({X.RUN_SQL}) r), {_BRIDGE} SELECT page_id, axis, scan, s, e FROM brid"),
    "line_segments": Entry(line_segments, _SEGMENTS),
    "interval_coverage": Entry(
        interval_coverage,
        f"""WITH r AS ({X.RUN_SQL}), k AS (SELECT DISTINCT page_id, scan FROM r), c AS (SELECT page_id, scan, greatest(s, 100) AS a, least(e, 450) AS b FROM r WHERE least(e, 450) > greatest(s, 100)),
 m AS (SELECT *, max(b) OVER (PARTITION BY page_id, scan ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
 t AS (SELECT page_id, scan, sum(greatest(0, b - greatest(a, coalesce(reach, a)))) AS len FROM m GROUP BY 1, 2)
 SELECT page_id, scan, coalesce(len, 0)::DOUBLE / 350 AS coverage FROM k LEFT JOIN t USING (page_id, scan)""",
    ),
    "rails": Entry(rails, f"WITH {_RAILS} SELECT page_id, axis, rail, rail_pos, stray FROM rt"),
    "wall_flags": Entry(wall_flags, f"WITH {_WALLS} SELECT page_id, axis, rail, gap, closed FROM flag"),
    "grid_components": Entry(grid_components, f"WITH RECURSIVE {_PARTS} SELECT page_id, kind, i0, i1, j0, j1 FROM part"),
    "closed_cells": Entry(closed_cells, f"WITH RECURSIVE {_CELLS} SELECT page_id, y1, x1, y2, x2, residual FROM closed"),
    "frame_ledger": Entry(
        frame_ledger,
        f"""WITH RECURSIVE {_KEPT}, a AS (SELECT page_id, count(*) FILTER (axis = 'h') AS rails_h, count(*) FILTER (axis = 'v') AS rails_v FROM rt GROUP BY 1),
 b AS (SELECT page_id, count(*) AS components, count(*) FILTER (kind = 'rect') AS rects, count(*) FILTER (kind = 'non_rectangular') AS non_rectangular, count(*) FILTER (kind = 'not_closed') AS not_closed FROM part GROUP BY 1),
 c AS (SELECT page_id, count(*) FILTER (reason = 'page_outline') AS page_outline, count(*) FILTER (reason = 'too_small') AS too_small, count(*) FILTER (reason = 'cell') AS cells FROM judged GROUP BY 1),
 l AS (SELECT page_id, rails_h, rails_v, coalesce(components, 0) AS components, coalesce(rects, 0) AS rects, coalesce(non_rectangular, 0) AS non_rectangular, coalesce(not_closed, 0) AS not_closed,
  coalesce(page_outline, 0) AS page_outline, coalesce(too_small, 0) AS too_small, coalesce(cells, 0) AS cells FROM a LEFT JOIN b USING (page_id) LEFT JOIN c USING (page_id))
 SELECT *, CASE WHEN rects = 0 THEN 'no_rect' WHEN cells = 0 THEN 'all_filtered' END AS zero_reason FROM l""",
    ),
    "table_rows": Entry(
        table_rows,
        f"""WITH RECURSIVE {_KEPT}, s AS (SELECT *, CASE WHEN x1 - lag(x2) OVER (PARTITION BY page_id, y1, y2 ORDER BY x1) > 2 THEN 1 ELSE 0 END AS brk FROM judged WHERE reason = 'cell'),
 g AS (SELECT *, sum(brk) OVER (PARTITION BY page_id, y1, y2 ORDER BY x1) AS part FROM s),
 b AS (SELECT page_id, y1, y2, part, unnest([x1, x2]) AS x, x1, residual FROM g),
 n AS (SELECT page_id, y1, y2, part, count(*) AS cells FROM g GROUP BY ALL)
 SELECT b.page_id, b.y1, b.y2, min(b.x1) AS x_first, any_value(n.cells) AS cells, max(residual) AS residual,
  array_to_string(list_transform(list_sort(list(DISTINCT b.x)), lambda v: printf('%.1f', v)), ',') AS signature FROM b JOIN n USING (page_id, y1, y2, part) GROUP BY b.page_id, b.y1, b.y2, b.part""",
    ),
    "table_suggestions": Entry(
        table_suggestions,
        "WITH RECURSIVE " + _KEPT + f""",
 places AS ({X.form_ctes()} SELECT template_id, face_id, layer, x, y, w, h FROM places),""" + """
 nc AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, y2, x2) - 1 AS cell FROM judged WHERE reason = 'cell'),
 ns AS (SELECT *, CASE WHEN x1 - lag(x2) OVER (PARTITION BY page_id, y1, y2 ORDER BY x1) > 2 THEN 1 ELSE 0 END AS brk FROM nc),
 ng AS (SELECT *, sum(brk) OVER (PARTITION BY page_id, y1, y2 ORDER BY x1) AS part FROM ns),
 nb AS (SELECT page_id, y1, y2, part, unnest([round(x1, 1), round(x2, 1)]) AS x FROM ng),
 nx AS (SELECT page_id, x, sum(brk) OVER (PARTITION BY page_id ORDER BY x) AS place
   FROM (SELECT page_id, x, CASE WHEN x - lag(x) OVER (PARTITION BY page_id ORDER BY x) > 2 THEN 1 ELSE 0 END AS brk FROM (SELECT DISTINCT page_id, x FROM nb) u) v),
 nf AS (SELECT nb.page_id, y1, y2, part, list_sort(list(DISTINCT nb.x)) AS bounds, list_sort(list(DISTINCT nx.place)) AS fam FROM nb JOIN nx ON nx.page_id = nb.page_id AND nx.x = nb.x GROUP BY ALL),
 nr AS (SELECT ng.page_id, ng.y1, ng.y2, ng.part, any_value(bounds) AS bounds, any_value(fam) AS fam, min(x1) AS x_first, max(residual) AS residual, list(cell) AS cells
   FROM ng JOIN nf USING (page_id, y1, y2, part) GROUP BY ng.page_id, ng.y1, ng.y2, ng.part),
 n1 AS (SELECT *, y1 - lag(y1) OVER o AS step, lag(y2 - y1) OVER o AS above FROM nr WINDOW o AS (PARTITION BY page_id, fam ORDER BY y1, y2, part)),
 n2 AS (SELECT *, sum(CASE WHEN step > 3.0 * greatest(above, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, fam ORDER BY y1, y2, part) AS stack FROM n1),
 n3 AS (SELECT *, row_number() OVER (PARTITION BY page_id, fam, stack ORDER BY y1, y2, part) AS place FROM n2),
 n4 AS (SELECT page_id, fam, stack, count(*) AS n, median(y2 - y1) FILTER (place >= 2) AS middle, max(y2 - y1) FILTER (place = 1) AS top, list(step ORDER BY place) FILTER (place >= 3) AS steps FROM n3 GROUP BY ALL),
 n5 AS (SELECT page_id, fam, stack FROM n4 WHERE n >= 3 AND middle > 0 AND abs(top - middle) > 0.20 * middle AND list_max(list_transform(steps, lambda g: abs(g - steps[1]))) <= 2),
 n6 AS (SELECT n3.*, n5.stack IS NOT NULL AND place = 2 AS after_heading, row_number() OVER (PARTITION BY n3.page_id, n3.fam ORDER BY y1, y2, part) AS k
   FROM n3 LEFT JOIN n5 ON n5.page_id = n3.page_id AND n5.fam = n3.fam AND n5.stack = n3.stack WHERE NOT (n5.stack IS NOT NULL AND place = 1)),
 go(page_id, fam, k, head, first_step, y) AS (
   SELECT page_id, fam, k, k, NULL::DOUBLE, y1 FROM n6 WHERE k = 1
   UNION ALL SELECT q.page_id, q.fam, q.k, CASE WHEN abs(q.y1 - go.y - go.first_step) > 2 THEN q.k ELSE go.head END,
     CASE WHEN abs(q.y1 - go.y - go.first_step) > 2 THEN NULL ELSE coalesce(go.first_step, q.y1 - go.y) END, q.y1
   FROM go JOIN n6 q ON q.page_id = go.page_id AND q.fam = go.fam AND q.k = go.k + 1),
 tb AS (SELECT page_id, fam, head, list(n6 ORDER BY k) AS r, flatten(list(cells)) AS cells FROM go JOIN n6 USING (page_id, fam, k) GROUP BY page_id, fam, head HAVING count(*) > 1),
 t2 AS (SELECT *, len(r) AS n, (r[-1].y1 - r[1].y1) / (len(r) - 1) AS pitch, list_transform(r[1].bounds, lambda b: round_even(b, 0)::BIGINT - round_even(r[1].x_first, 0)::BIGINT) AS edges FROM tb),
 t3 AS (SELECT page_id, 'form-' || (page_id % 25) AS template_id, round_even(r[1].x_first, 0)::BIGINT AS origin_x, round_even(r[1].y1, 0)::BIGINT AS origin_y,
   round_even(r[1].bounds[-1] - r[1].x_first, 0)::BIGINT AS width, round_even(r[-1].y2 - r[1].y1, 0)::BIGINT AS height, n AS rows, round_even(pitch, 2) AS row_pitch,
   round_even(list_sort(list_transform(r, lambda x: x.y2 - x.y1))[n // 2 + 1], 0)::BIGINT AS row_height,
   array_to_string(list_transform(range(1, len(edges)), lambda i: edges[i] || '+' || (edges[i + 1] - edges[i])), ',') AS columns,
   round_even(greatest(list_max(list_transform(r, lambda x, i: abs(x.y1 - (r[1].y1 + pitch * (i - 1))))), list_max(list_transform(r, lambda x: x.residual))), 2) AS residual,
   array_to_string(list_sort(cells), ',') AS cell_indexes, r[1].after_heading AS heading_excluded FROM t2),
 t4 AS (SELECT *, CASE WHEN origin_x + width / 2.0 >= 1800 OR origin_y + height / 2.0 >= 1200 THEN NULL WHEN origin_y + height / 2.0 < 700 THEN CASE WHEN origin_x + width <= 1800 AND origin_y + height <= 700 THEN 'front' ELSE 'straddle' END
   ELSE CASE WHEN origin_y >= 700 AND origin_x + width <= 1800 AND origin_y + height <= 1200 THEN 'back' ELSE 'straddle' END END AS face FROM t3)
 SELECT t4.*, EXISTS (SELECT 1 FROM places p WHERE p.template_id = t4.template_id AND p.face_id = t4.face AND p.layer = 0 AND t4.origin_x < p.x + p.w AND p.x < t4.origin_x + t4.width
   AND t4.origin_y - CASE t4.face WHEN 'back' THEN 700 ELSE 0 END < p.y + p.h AND p.y < t4.origin_y - CASE t4.face WHEN 'back' THEN 700 ELSE 0 END + t4.height) AS overlaps FROM t4""",
    ),
    "ruled_grid": Entry(
        ruled_grid,
        f"""WITH l AS ({X.LINE_SQL}), h AS (SELECT page_id, list_sort(list(DISTINCT pos)) AS h FROM l WHERE pos % 2 = 0 GROUP BY 1 HAVING count(DISTINCT pos) >= 3),
 v AS (SELECT page_id, list_sort(list(DISTINCT pos)) AS v FROM l WHERE pos % 2 = 1 GROUP BY 1 HAVING count(DISTINCT pos) >= 2),
 j AS (SELECT *, len(h) - 1 AS rows, (h[-1] - h[1])::DOUBLE / (len(h) - 1) AS pitch FROM h JOIN v USING (page_id))
 SELECT page_id, v[1] AS origin_x, h[1] AS origin_y, rows, round_even(pitch, 2) AS row_pitch, greatest(1, floor(pitch)::INT - 4) AS row_height, len(v) - 1 AS columns,
  round_even(list_max(list_transform(h, lambda p, i: abs(p - (h[1] + pitch * (i - 1))))), 2) AS residual FROM j""",
    ),
    "uniform_grid": Entry(
        uniform_grid,
        """WITH r AS (SELECT p_partkey AS region, p_size * 17 + 100 AS w, p_size * 11 + 60 AS h, p_partkey % 6 AS rows, p_partkey % 9 AS cols FROM part),
 c AS (SELECT *, unnest(range(0, cols)) AS col FROM r WHERE rows >= 1 AND cols >= 1)
 SELECT region, w, h, rows, cols, round_even(h::DOUBLE / rows, 2) AS row_pitch, greatest(1, floor(h::DOUBLE / rows)::INT - 4) AS row_height, col,
  round_even(w::DOUBLE * col / cols, 0)::INT AS x_offset, greatest(1, round_even(w::DOUBLE * (col + 1) / cols, 0)::INT - round_even(w::DOUBLE * col / cols, 0)::INT) AS width FROM c""",
    ),
    "candidate_faces": Entry(
        candidate_faces,
        X.form_ctes() + """, q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'form-' || (l_orderkey % 25) AS template_id, (l_partkey * 37) % 1900 AS x, (l_suppkey * 53 + l_partkey * 29) % 1250 AS y,
   (20 + l_quantity)::INT AS w, (10 + l_quantity)::INT AS h FROM lineitem),
 f AS (SELECT *, row_number() OVER () AS qid, CASE WHEN x + w / 2.0 >= 1800 OR y + h / 2.0 >= 1200 THEN NULL WHEN y + h / 2.0 < 700 THEN CASE WHEN x + w <= 1800 AND y + h <= 700 THEN 'front' ELSE 'straddle' END
   ELSE CASE WHEN y >= 700 AND x + w <= 1800 AND y + h <= 1200 THEN 'back' ELSE 'straddle' END END AS face FROM q),
 o AS (SELECT DISTINCT f.qid FROM f JOIN places p ON p.template_id = f.template_id AND p.face_id = f.face AND p.layer = 0 AND f.x < p.x + p.w AND p.x < f.x + f.w
   AND f.y - CASE f.face WHEN 'back' THEN 700 ELSE 0 END < p.y + p.h AND p.y < f.y - CASE f.face WHEN 'back' THEN 700 ELSE 0 END + f.h)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y, face, o.qid IS NOT NULL AS overlaps FROM f LEFT JOIN o USING (qid)""",
    ),
    "option_ink": Entry(
        option_ink,
        f"""WITH r AS (SELECT CAST(floor(l_orderkey / 25) AS BIGINT) AS page_id, CAST(floor(l_orderkey / 25) AS BIGINT) % 25 AS num, 95 + l_suppkey % 70 AS scan, 980 + l_partkey % 200 AS s, 980 + l_partkey % 200 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
 mk(ord, option, mx) AS (VALUES (0, 'A', 1000), (1, 'B', 1040), (2, 'C', 1080)),
 pg AS (SELECT DISTINCT page_id, num FROM r),
 band AS (SELECT p.page_id, m.ord, m.option, greatest(1000 + {X.STEP} * num - 4, b.a + {X.STEP} * num) AS a, least(1124 + {X.STEP} * num, b.b + {X.STEP} * num) AS b FROM pg p CROSS JOIN mk m
   CROSS JOIN LATERAL (VALUES (m.mx - 8, m.mx + 6), (m.mx + 34, m.mx + 48)) b(a, b)),
 px AS (SELECT DISTINCT page_id, scan, unnest(range(s, e + 1)) AS x FROM r WHERE scan >= 100 AND scan < 160),
 hit AS (SELECT b.page_id, b.ord, count(*) AS ink FROM band b JOIN px ON px.page_id = b.page_id AND px.x >= b.a AND px.x < b.b GROUP BY 1, 2),
 area AS (SELECT page_id, ord, option, sum(greatest(0, b - a)) * 60 AS area FROM band GROUP BY 1, 2, 3)
 SELECT page_id, 'era' AS field_id, option, ord, CASE WHEN area <= 0 THEN 0.0 ELSE coalesce(ink, 0)::DOUBLE / area END AS score FROM area LEFT JOIN hit USING (page_id, ord)""",
    ),
}
