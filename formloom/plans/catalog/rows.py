"""Queries that build output rows (H8-H10, C20, D8, B5, flagship)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.operators import assignment as A
from formloom.operators import rows as R
from formloom.plans import fixtures as X
from formloom.plans.catalog import Entry
from formloom.plans.catalog.symbols import COUNTERS_SQL, CTE
from formloom.plans.extraction import checked_rows, extract, form_values
from formloom.sources.templates import TemplateTables, output_columns


def page_choices(spark: SparkSession, d: str) -> DataFrame:
    """Choice decisions per page: option scores are the shares of the return flags on it."""
    flags = X.from_sql(
        spark, d, "SELECT CAST(floor(l_orderkey / 25) AS BIGINT) AS page_id, l_returnflag AS option FROM lineitem",
        "lineitem",
    )
    counts = flags.groupBy("page_id", "option").agg(F.count(F.lit(1)).alias("n"))
    packed = counts.groupBy("page_id").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("option", "n")).alias("opts")
    )
    scores = F.transform(
        "opts",
        lambda o: F.struct(
            o["option"].alias("option"), F.ascii(o["option"]).alias("ord"), (o["n"] / F.col("total")).alias("score")
        ),
    )
    return packed.select("page_id", F.create_map(F.lit("era"), R.choice_decision(scores)).alias("choice_map"))


def _values(spark: SparkSession, d: str, tables: TemplateTables, rules: R.RowRules = R.RowRules()) -> DataFrame:
    pages = X.pages(spark, d).select("page_id", "template_id")
    return form_values(X.symbols(spark, d), pages, tables, page_choices(spark, d), rules)


def row_values(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d, X.form_tables(spark, d)).select(
        "page_id", "col_ord", "column", "value", "value_long", "origin"
    )


def moved_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Where symbols go on pages whose table blocks have moved."""
    tables = X.form_tables(spark, d)
    local, reach = A.with_moves(A.to_face_local(X.symbols(spark, d), tables), X.moves(spark, d), tables)
    return A.assign_symbols(local, tables, reach=reach).select("page_id", "face_id", "seq", "x", "y", "kind", "field_id", "region", "probe_field")


def moved_template_rows(spark: SparkSession, d: str) -> DataFrame:
    pages = X.pages(spark, d).select("page_id", "template_id")
    values = form_values(X.symbols(spark, d), pages, X.form_tables(spark, d), page_choices(spark, d), moves=X.moves(spark, d))
    return values.select("page_id", "col_ord", "column", "value", "value_long", "origin")


def row_values_char_masked(spark: SparkSession, d: str) -> DataFrame:
    rules = R.RowRules(char_level=True)
    return _values(spark, d, X.form_tables(spark, d), rules).select("page_id", "column", "value", "origin", "kept_conf")


def row_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.row_totals(_values(spark, d, X.form_tables(spark, d)))


def failure_rows(spark: SparkSession, d: str) -> DataFrame:
    columns = output_columns(X.form_tables(spark, d).cells).select("template_id", "col_ord", "column")
    return R.failure_rows(X.pages(spark, d), columns).select("page_id", "col_ord", "column", "value")


def wide_names() -> list[str]:
    """Output columns of the form; all its templates share them."""
    out = []
    for _, _, fid, _, _, _, output, subs, *_ in X._form_cells():
        if output:
            out += [f"{fid}_{s}" for s in subs] or [fid]
    return out


def wide_rows(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: symbols and templates in, one trustworthy row per page out."""
    return checked_rows(X.symbols(spark, d), X.pages(spark, d), X.form_tables(spark, d), wide_names(), page_choices(spark, d))


def version_diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two_versions(spark, d)
    return R.diff_summary(R.page_diff(a, b))


def first_version_diffs(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two_versions(spark, d)
    return R.first_diffs(R.page_diff(a, b))


def _two_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same contents rendered with two confidence thresholds."""
    tables = X.form_tables(spark, d)
    found = extract(X.symbols(spark, d), tables, keep=True)
    paged = A.page_contents(X.pages(spark, d).select("page_id", "template_id"), found.cells)
    choices = page_choices(spark, d)
    return (
        R.build_rows(paged, tables, choices),
        R.build_rows(paged, tables, choices, R.RowRules(unclear_threshold=0.7)),
    )


def choice_decisions(spark: SparkSession, d: str) -> DataFrame:
    scores = X.from_sql(spark, d, X.EVT_SQL, "events").select(
        "user_id", F.col("opt").alias("option"), F.col("opt_ord").alias("ord"), "score"
    )
    return R.pack_choices(scores, ["user_id"]).select("user_id", R.choice_decision(F.col("scores")).alias("decision"))


def risky_prefix_cells(spark: SparkSession, d: str) -> DataFrame:
    raw = X.from_sql(spark, d, X.ROW_SQL, "customer")
    values = raw.select(
        "page_id", F.lit("raw").alias("column"), F.col("raw").alias("value"),
        F.lit(None).cast("long").alias("value_long"),
    )
    return R.risky_cells(values)


def values_sql(threshold: float = 0.85, name: str = "vals", char_level: bool = False) -> str:
    """CTE ``name`` (page_id, ord, col_ord, column, value, value_long, origin, kept_conf)."""
    masked = """WHEN live AND low AND plain AND NOT all_low THEN [array_to_string(list_transform(range(1, length(raw) + 1), lambda i: CASE WHEN cl[i] < 85 THEN '〓' ELSE raw[i] END), '')]""" if char_level else ""
    origin_m = "WHEN live AND low AND plain AND NOT all_low THEN origin" if char_level else ""
    conf_m = "WHEN live AND low AND plain AND NOT all_low THEN list_min(list_filter(cl, lambda q: q >= 85)) / 100.0" if char_level else ""
    return f""",
{name}_filled AS (SELECT DISTINCT c.page_id, s.table_id, s.row_no FROM cell c JOIN spec s USING (field_id) WHERE s.table_id IS NOT NULL AND s.kind = 'text'),
{name}_era0 AS (SELECT CAST(floor(l_orderkey / 25) AS BIGINT) AS page_id, l_returnflag AS opt, count(*) AS n FROM lineitem GROUP BY 1, 2),
{name}_era1 AS (SELECT page_id, opt, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY page_id) AS score FROM {name}_era0),
{name}_era2 AS (SELECT page_id, opt, score - CASE WHEN count(*) OVER (PARTITION BY page_id) >= 3 THEN min(score) OVER (PARTITION BY page_id) ELSE 0.0 END AS score FROM {name}_era1),
{name}_era3 AS (SELECT page_id, opt, score, row_number() OVER w AS rk, lead(score) OVER w AS second FROM {name}_era2 WINDOW w AS (PARTITION BY page_id ORDER BY score DESC, opt)),
{name}_era AS (SELECT page_id, CASE WHEN score < 0.05 THEN '〓' WHEN score - coalesce(second, 0.0) < 0.05 THEN '〓' ELSE opt END AS era FROM {name}_era3 WHERE rk = 1),
{name}_raw AS (SELECT p.page_id, s.*, coalesce(c.raw, '') AS raw, c.conf, coalesce(c.origin, '') AS origin, e.era,
  CAST(string_split(nullif(c.confs, ''), ',') AS INT[]) AS cl,
  s.table_id IS NOT NULL AND f.page_id IS NULL AS is_empty,
  CASE WHEN s.subs <> '' THEN string_split(s.subs, ',') ELSE [''] END AS sub_list
  FROM page p CROSS JOIN spec s LEFT JOIN cell c ON c.page_id = p.page_id AND c.field_id = s.field_id
  LEFT JOIN {name}_filled f ON f.page_id = p.page_id AND f.table_id = s.table_id AND f.row_no = s.row_no
  LEFT JOIN {name}_era e ON e.page_id = p.page_id WHERE s.output),
{name}_flag AS (SELECT *, kind = 'text' AND NOT is_empty AND origin <> 'conflict' AS live, raw = '' OR conf IS NULL OR conf < {threshold} AS bad,
  raw <> '' AND conf IS NOT NULL AND conf < {threshold} AS low, subs = '' AND norm IS NULL AS plain, len(list_filter(cl, lambda q: q >= 85)) = 0 AS all_low,
  CASE WHEN norm = 'amount' THEN CASE WHEN regexp_full_match(raw, '[0-9]+') THEN try_cast(raw AS BIGINT)
    WHEN regexp_full_match(raw, '[0-9]{{1,3}}([,.][0-9]{{3}})+') THEN try_cast(regexp_replace(raw, '[,.]', '', 'g') AS BIGINT) END END AS amount,
  string_split_regex(raw, '[.・/,-]') AS parts FROM {name}_raw),
{name}_list AS (SELECT *, live AND NOT bad AND (subs = '' OR (len(parts) = len(sub_list) AND NOT list_contains(parts, ''))) AND (norm IS NULL OR amount IS NOT NULL) AS shown FROM {name}_flag),
{name}_vals AS (SELECT *, CASE WHEN kind = 'choice' THEN [CASE WHEN is_empty THEN '' ELSE coalesce(era, '〓') END]
   WHEN is_empty THEN list_transform(sub_list, lambda q: '') WHEN NOT live THEN list_transform(sub_list, lambda q: '〓') {masked}
   WHEN NOT shown THEN list_transform(sub_list, lambda q: '〓')
   WHEN subs <> '' THEN parts WHEN norm = 'amount' THEN [CAST(amount AS VARCHAR)] ELSE [raw] END AS list,
   CASE WHEN shown THEN origin {origin_m} ELSE '' END AS o, CASE WHEN shown THEN conf {conf_m} END AS kept_conf,
   sum(len(sub_list)) OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING) - len(sub_list) AS base FROM {name}_list),
{name}_x AS (SELECT page_id, field_id, sub_list, base, o, kept_conf, shown, norm, amount, unnest(list) AS value, unnest(range(len(list))) AS part FROM {name}_vals),
{name} AS (SELECT page_id, (base + part)::BIGINT AS col_ord, CASE WHEN sub_list[part + 1] <> '' THEN field_id || '_' || sub_list[part + 1] ELSE field_id END AS "column",
  value, CASE WHEN shown AND norm = 'amount' THEN amount END AS value_long, o AS origin, kept_conf FROM {name}_x)
"""


def _wide_sql() -> str:
    # A page that fails the form check shows nothing that was read on it.
    picks = ", ".join(f"CASE WHEN any_value(mismatch) THEN '〓' ELSE max(value) FILTER (\"column\" = '{c}') END AS \"{c}\"" for c in wide_names())
    return (
        CTE + COUNTERS_SQL + values_sql()
        + f""", area AS (SELECT template_id, CAST(sum(w * h) FILTER (layer < 2) AS DOUBLE) / 2160000 AS coverage FROM places GROUP BY 1),
 ratio AS (SELECT template_id, CASE WHEN coverage >= 0.35 THEN 0.55 ELSE 0.55 + (0.70 - 0.55) * (1.0 - coverage / 0.35) END AS ratio FROM area),
 fit AS (SELECT page_id, below, in_face = 0 OR CAST(other AS DOUBLE) / in_face > ratio AS mismatch FROM counters JOIN ratio USING (template_id)),
 wide AS (SELECT page_id, CASE WHEN any_value(mismatch) THEN {len(wide_names())} ELSE count(*) FILTER (value = '〓') END AS unclear_count,
   CASE WHEN any_value(mismatch) THEN '' ELSE coalesce(printf('%.3f', min(kept_conf)), '') END AS min_conf, {picks} FROM vals JOIN fit USING (page_id) GROUP BY 1)
 SELECT w.*, p.source_file, p.page_no, CASE WHEN mismatch THEN '様式不一致' WHEN below >= 3 THEN '超過あり' ELSE '正常' END AS status
 FROM wide w JOIN page p USING (page_id) JOIN fit USING (page_id)"""
    )


_DIFF = CTE + values_sql() + values_sql(0.7, "vals2") + """, diff AS (SELECT a.page_id, a."column", a.value IS DISTINCT FROM b.value AS differs FROM vals a JOIN vals2 b ON a.page_id = b.page_id AND a."column" = b."column")
"""

ENTRIES = {
    "form_wide_rows": Entry(wide_rows, _wide_sql()),
    "row_values": Entry(
        row_values, CTE + values_sql() + 'SELECT page_id, col_ord, "column", value, value_long, origin FROM vals'
    ),
    "moved_symbols": Entry(moved_symbols, X.moved_ctes() + "SELECT page_id, face_id, seq, x, y, kind, field_id, region, probe_field FROM placed"),
    "moved_template_rows": Entry(
        moved_template_rows, X.moved_ctes() + values_sql() + 'SELECT page_id, col_ord, "column", value, value_long, origin FROM vals'
    ),
    "row_values_char_masked": Entry(
        row_values_char_masked,
        CTE + values_sql(char_level=True) + 'SELECT page_id, "column", value, origin, kept_conf FROM vals',
    ),
    "row_totals": Entry(
        row_totals,
        CTE + values_sql() + """SELECT page_id, count(*) FILTER (value = '〓') AS unclear_count, coalesce(printf('%.3f', min(kept_conf)), '') AS min_conf FROM vals GROUP BY 1""",
    ),
    "failure_rows": Entry(
        failure_rows, CTE + values_sql() + """SELECT page_id, col_ord, "column", '〓' AS value FROM vals"""
    ),
    "version_diff": Entry(
        version_diff,
        _DIFF + """SELECT count(DISTINCT page_id) AS pages, count(DISTINCT page_id) FILTER (differs) AS pages_changed, count(*) AS cells_compared, count(*) FILTER (differs) AS diff_cells FROM diff""",
    ),
    "first_version_diffs": Entry(
        first_version_diffs,
        _DIFF + """SELECT page_id, "column", (SELECT count(*) FROM diff WHERE differs) AS total, (SELECT count(*) FROM diff WHERE differs) > 200 AS truncated
 FROM diff WHERE differs ORDER BY page_id, "column" LIMIT 200""",
    ),
    "choice_decisions": Entry(
        choice_decisions,
        f"""WITH s AS ({X.EVT_SQL}), f AS (SELECT *, score - CASE WHEN count(*) OVER (PARTITION BY user_id) >= 3 THEN min(score) OVER (PARTITION BY user_id) ELSE 0.0 END AS adj FROM s),
 r AS (SELECT user_id, opt, adj, row_number() OVER w AS rk, lead(adj) OVER w AS second FROM f WINDOW w AS (PARTITION BY user_id ORDER BY adj DESC, opt_ord))
 SELECT user_id, CASE WHEN adj < 0.05 THEN 'unselected' WHEN adj - coalesce(second, 0.0) < 0.05 THEN 'undecided' ELSE opt END AS decision FROM r WHERE rk = 1""",
    ),
    "risky_prefix_cells": Entry(
        risky_prefix_cells,
        f"""WITH r AS ({X.ROW_SQL}) SELECT page_id, 'raw' AS "column" FROM r WHERE substr(raw, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13), chr(10))""",
    ),
}
