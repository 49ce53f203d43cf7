"""Queries over sources, pages and runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.operators import lineage as N
from formloom.operators import rows as R
from formloom.plans import fixtures as X
from formloom.plans.catalog import Entry
from formloom.session import ensure_checkpoint_dir
from formloom.sources import files as FS
from formloom.sources import responses as RS
from formloom.sources import sinks
from formloom.streaming import incremental as I

NOW = N.Current(template_hash="1", geometry_hash="g1", algo_version="2", snap_enabled=False)


def incoming(spark: SparkSession, d: str) -> DataFrame:
    return X.from_sql(spark, d, X.SRC_SQL.replace("sha256(text)", "sha2(text, 256)"), "documents")


MANIFEST_SQL = """
SELECT CASE WHEN doc_id % 7 = 0 THEN concat('old_', lpad(CAST(doc_id AS STRING), 6, '0'), '.pdf') ELSE concat('scan_', lpad(CAST(doc_id AS STRING), 6, '0'), '.pdf') END AS name,
 CASE WHEN doc_id % 11 = 0 THEN sha256(concat(text, '#')) ELSE sha256(text) END AS hash, doc_id FROM documents WHERE doc_id % 3 <> 0"""
KNOWN_PAGES_SQL = """
SELECT concat('scan_', lpad(CAST(doc_id AS STRING), 6, '0'), '.pdf') AS source_file, CASE WHEN doc_id % 2 = 0 THEN 'done' ELSE 'skipped_duplicate' END AS state,
 concat('scan_', lpad(CAST(doc_id AS STRING), 6, '0'), '_p0001') AS page_id, CAST(1 AS BIGINT) AS page_no FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 < 3"""


def manifest(spark: SparkSession, d: str) -> DataFrame:
    text = MANIFEST_SQL.replace("sha256(concat(text, '#'))", "sha2(concat(text, '#'), 256)").replace("sha256(text)", "sha2(text, 256)")
    all_rows = X.from_sql(spark, d, text, "documents")
    # a manifest holds each content once
    return all_rows.groupBy("hash").agg(F.min("name").alias("name"))


def known_pages(spark: SparkSession, d: str) -> DataFrame:
    return X.from_sql(spark, d, KNOWN_PAGES_SQL, "documents")


def _actions(spark: SparkSession, d: str) -> DataFrame:
    return N.reconcile_sources(incoming(spark, d), manifest(spark, d), known_pages(spark, d))


def reconciled_sources(spark: SparkSession, d: str) -> DataFrame:
    return _actions(spark, d).select("name", "replaced", "action", "other")


def skipped_duplicates(spark: SparkSession, d: str) -> DataFrame:
    counts = incoming(spark, d).select("name", F.col("n_pages").alias("pages"))
    return N.skip_rows(_actions(spark, d), counts)


def renamed_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = manifest(spark, d).select(
        F.col("name").alias("source_file"), F.regexp_replace("name", r"\.pdf$", "_p0001").alias("page_id")
    )
    return N.rename_pages(pages, _actions(spark, d))


def missing_inputs(spark: SparkSession, d: str) -> DataFrame:
    pages = manifest(spark, d).select(F.col("name").alias("source_file"))
    return N.missing_inputs(pages, incoming(spark, d))


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    replaced = _actions(spark, d).filter("replaced").select("name")
    pages = known_pages(spark, d)
    cells = pages.select("page_id", F.explode(F.array(*[F.lit(f"f{i}") for i in range(3)])).alias("field_id"))
    kept, derived = N.cascade_delete(pages, {"cell": cells, "alignment": pages.select("page_id")}, replaced)
    left = derived["cell"].groupBy("page_id").agg(F.count(F.lit(1)).alias("cells")).join(derived["alignment"], "page_id")
    return kept.join(left, "page_id").select("page_id", "source_file", "cells")


def source_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """Files named after documents in various formats, split into readable ones and the ledger."""
    docs = X.table(spark, d, "documents").select(
        F.concat(F.lit("f"), "doc_id", F.element_at(
            F.array(*[F.lit(s) for s in (".pdf", ".JPG", ".tiff", ".txt.png", "")]), (F.col("doc_id") % 5 + 1).cast("int")
        )).alias("name")
    )
    return FS.split_sources(docs)


def page_ids(spark: SparkSession, d: str) -> DataFrame:
    """Pages of two files per document that share a stem; a third of the files is known."""
    files = X.table(spark, d, "documents").select(
        F.explode(F.array(F.lit("pdf"), F.lit("png"))).alias("ext"), "doc_id"
    ).select(F.concat(F.lit("s"), "doc_id", F.lit("."), "ext").alias("source_file"), "doc_id", "ext")
    pages = files.select("source_file", F.explode(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 3 + 1)).alias("page_no"))
    existing = files.filter((F.col("doc_id") % 3 == 0) & (F.col("ext") == "png")).select(
        "source_file", F.lit(1).cast("long").alias("page_no"), F.format_string("s%d_p%04d", "doc_id", F.lit(1)).alias("page_id")
    )
    return FS.assign_page_ids(pages, existing)


PAGE_ID_SQL = """
WITH f AS (SELECT concat('s', doc_id, '.', e.ext) AS source_file, doc_id, e.ext FROM documents CROSS JOIN (VALUES ('pdf'), ('png')) e(ext)),
p AS (SELECT source_file, doc_id, ext, unnest(range(1, doc_id % 3 + 2)) AS page_no FROM f)
SELECT source_file, page_no, CASE WHEN doc_id % 3 = 0 AND page_no = 1 THEN CASE ext WHEN 'png' THEN printf('s%d_p%04d', doc_id, page_no) ELSE printf('s%d_%s_p%04d', doc_id, substr(sha1(source_file), 1, 8), page_no) END
 WHEN ext = 'pdf' THEN printf('s%d_p%04d', doc_id, page_no) ELSE printf('s%d_%s_p%04d', doc_id, substr(sha1(source_file), 1, 8), page_no) END AS page_id FROM p"""


def _stored(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents")
    body = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("{"), F.col("text"))).when(
        F.col("doc_id") % 4 == 1, F.to_json(F.array("text"))
    ).otherwise(F.to_json(F.struct("text")))
    saved = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, F.lit("x")).otherwise(F.sha2("text", 256))
    return docs.filter(F.col("n_chars") > 100).select(F.col("doc_id").alias("page_id"), body.alias("body"), saved.alias("saved_sha256"))


def replayed_responses(spark: SparkSession, d: str) -> DataFrame:
    pages = X.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"))
    return RS.replay_join(pages, _stored(spark, d)).select("page_id", F.length("body").alias("chars"), "send_error")


def reusable_responses(spark: SparkSession, d: str) -> DataFrame:
    pages = X.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.sha2("text", 256).alias("image_sha256"))
    return RS.reusable_responses(pages, _stored(spark, d)).select("page_id", "reusable")


def _state(spark: SparkSession, d: str) -> DataFrame:
    return X.from_sql(spark, d, X.STATE_SQL, "orders")


ALIGN_SQL = """
SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 10 = 0 THEN 'g0' ELSE 'g1' END AS geometry_hash, CASE WHEN o_orderkey % 17 = 0 THEN '1' ELSE '2' END AS algo_version,
 o_orderkey % 23 = 0 AS snap_enabled FROM orders WHERE o_totalprice > 50000"""


def _alignment(spark: SparkSession, d: str) -> DataFrame:
    return X.from_sql(spark, d, ALIGN_SQL, "orders")


def stale_pages(spark: SparkSession, d: str) -> DataFrame:
    return N.stale_pages(_state(spark, d), _alignment(spark, d), NOW)


def reuse_refusals(spark: SparkSession, d: str) -> DataFrame:
    """The guard for four settings of the present run."""
    pages, al = _state(spark, d), _alignment(spark, d)
    fixed = al.withColumn("geometry_hash", F.lit("g1"))
    same = fixed.withColumn("algo_version", F.lit("2"))
    plain = same.withColumn("snap_enabled", F.lit(False))
    cases = {"stored": al, "geometry_same": fixed, "method_same": same, "snap_same": plain}
    frames = [N.check_reusable(pages, a, NOW).withColumn("stored", F.lit(k)) for k, a in cases.items()]
    frames.append(N.check_reusable(pages, plain, NOW, check_template=False).withColumn("stored", F.lit("no_template")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def resend_plan(spark: SparkSession, d: str) -> DataFrame:
    pages = _state(spark, d)
    return N.resend_policy(pages, N.stale_pages(pages, _alignment(spark, d), NOW), True).groupBy("state").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("refused").alias("refused")
    )


def refused_pages(spark: SparkSession, d: str) -> DataFrame:
    """The other policy: stale pages keep their state and are marked."""
    pages = _state(spark, d)
    kept_back = N.resend_policy(pages, N.stale_pages(pages, _alignment(spark, d), NOW), False)
    return kept_back.select("page_id", "state", "refused")


def upserted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as stored rows; pages of open orders are written anew from their first line."""
    old = X.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("cell"), F.col("l_quantity").alias("value")
    )
    touched = X.table(spark, d, "orders").filter(F.col("o_orderstatus") == "O").select(F.col("o_orderkey").alias("page_id"))
    new = touched.select("page_id", F.lit(1).alias("cell"), F.lit(-1.0).alias("value"))
    return N.upsert_page_rows(old, new, touched)


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.run_summary(_state(spark, d))


def page_event_log(spark: SparkSession, d: str) -> DataFrame:
    return sinks.page_events(_state(spark, d))


def page_status_table(spark: SparkSession, d: str) -> DataFrame:
    return sinks.status_table(_state(spark, d))


def budget_gate(spark: SparkSession, d: str) -> DataFrame:
    requests = X.from_sql(spark, d, X.REQ_SQL, "events").withColumnRenamed("event_id", "ord")
    return N.budget_gate(requests, cap=500).select("ord", F.col("period").cast("string").alias("period"), "used", "admitted")


def send_limit_gate(spark: SparkSession, d: str) -> DataFrame:
    pages = _state(spark, d).select(
        "source_file", F.col("page_id").alias("page_no"), (F.col("state") == "done").alias("has_response")
    )
    return N.send_limit_gate(pages, 700)


EVENT_STATE = """CASE event_type WHEN 'click' THEN 'expanded' WHEN 'view' THEN 'aligned' WHEN 'signup' THEN 'sending'
 WHEN 'purchase' THEN CASE WHEN value > 60 THEN 'done' ELSE 'received' END ELSE 'failed' END"""
LOG_SQL = f"""
SELECT concat(CAST(user_id AS STRING), '-', substr(CAST(ts AS STRING), 1, 10)) AS page_id, ts, event_id AS ord, {EVENT_STATE} AS state, value > 40 AS has_response FROM events"""


def page_states(spark: SparkSession, d: str) -> DataFrame:
    return N.fold_page_state(X.from_sql(spark, d, LOG_SQL, "events"))


def _scratch(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def streamed_page_states(spark: SparkSession, d: str) -> DataFrame:
    """The event log as a stream; the newest versions must equal the batch result."""
    schema = X.table(spark, d, "events").schema
    raw = I.read_files(spark, f"{d}/events.parque*", schema)
    day = F.substring(F.col("ts").cast("string"), 1, 10)
    log = raw.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), day).alias("page_id"), "ts", F.col("event_id").alias("ord"),
        F.expr(EVENT_STATE).alias("state"), (F.col("value") > 40).alias("has_response"),
    )
    base = _scratch(spark)
    I.page_state_table(log, f"{base}/out", f"{base}/cp").awaitTermination()
    return I.latest_states(spark, f"{base}/out")


def streamed_first_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents seen by the stream, each once."""
    schema = X.table(spark, d, "documents").schema
    docs = I.read_files(spark, f"{d}/documents.parque*", schema)
    base = _scratch(spark)
    I.first_contents(docs.select("doc_id", F.sha2("text", 256).alias("hash")), f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("hash")


def streamed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows extracted batch by batch from a stream of line items as symbols."""
    schema = X.table(spark, d, "lineitem").schema
    raw = I.read_files(spark, f"{d}/lineitem.parque*", schema)
    page = F.floor(F.col("l_orderkey") / 25).cast("long")
    cols = X.SYM_SQL.split("SELECT", 1)[1].rsplit("FROM", 1)[0]
    symbols = raw.selectExpr(*[c.strip() for c in _split_columns(cols)])
    base = _scratch(spark)
    I.incremental_extract(symbols, X.form_tables(spark, d), f"{base}/out", f"{base}/cp").awaitTermination()
    out = spark.read.parquet(f"{base}/out").filter(F.col("column") != "era")
    return out.select("page_id", "column", "value")


def _split_columns(text: str) -> list[str]:
    """Split a select list at commas outside brackets and quotes."""
    out, depth, quoted, cur = [], 0, False, ""
    for ch in text:
        quoted ^= ch == "'"
        if not quoted:
            depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0 and not quoted:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def unseen_contents(spark: SparkSession, d: str) -> DataFrame:
    return N.dedupe_content(incoming(spark, d), manifest(spark, d))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Document texts through the CSV writer and back."""
    docs = X.table(spark, d, "documents").select(
        F.col("doc_id").alias("page_id"), "text", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang")).alias("lang")
    )
    base = _scratch(spark)
    sinks.write_wide_csv(docs, f"{base}/csv")
    back = spark.read.csv(f"{base}/csv", header=True, quote='"', escape='"', multiLine=True,
                          schema="page_id LONG, text STRING, lang STRING")
    return back.select("page_id", F.md5("text").alias("digest"), F.coalesce("lang", F.lit("")).alias("lang"))


_RECON = f"""WITH inc AS ({X.SRC_SQL}), man AS (SELECT hash, min(name) AS name FROM ({MANIFEST_SQL}) m GROUP BY 1), pg AS ({KNOWN_PAGES_SQL}),
flag AS (SELECT i.*, coalesce(m.hash <> i.hash, false) AS replaced FROM inc i LEFT JOIN man m USING (name)),
eff AS (SELECT m.name, m.hash, f.name IS NOT NULL AS present FROM man m LEFT JOIN flag f USING (name) WHERE NOT coalesce(f.replaced, false)),
busy AS (SELECT source_file, bool_or(state <> 'skipped_duplicate') AS hp FROM pg GROUP BY 1),
j AS (SELECT f.*, e.name AS known_as, e.present, min(f.name) OVER (PARTITION BY f.hash) AS first_name, coalesce(b.hp, false) AND NOT f.replaced AS hp
 FROM flag f LEFT JOIN eff e USING (hash) LEFT JOIN busy b ON b.source_file = f.name),
act AS (SELECT *, CASE WHEN name = known_as THEN 'same' WHEN present THEN 'duplicate' WHEN name <> first_name THEN 'duplicate' WHEN known_as IS NULL THEN 'new'
  WHEN hp THEN 'rename_fallback' ELSE 'renamed' END AS action FROM j),
res AS (SELECT name, hash, n_pages, replaced, action, CASE WHEN action = 'duplicate' THEN CASE WHEN present THEN known_as ELSE first_name END WHEN action LIKE 'rename%' THEN known_as END AS other FROM act)
"""
_STALE = f"""WITH p AS ({X.STATE_SQL}), a AS ({ALIGN_SQL}), stale AS (SELECT p.page_id FROM p LEFT JOIN a USING (page_id) WHERE p.state = 'done' AND
 (p.template_hash <> '1' OR a.geometry_hash IS NULL OR a.geometry_hash <> 'g1' OR a.algo_version <> '2' OR a.snap_enabled))"""
_FOLD = f"""WITH l AS ({LOG_SQL}), f AS (SELECT page_id, bool_or(state = 'done') AS done, arg_max(state, (ts, ord)) FILTER (state IN ('aligned', 'sending', 'received', 'failed')) AS step,
 arg_max(state, (ts, ord)) AS last, bool_or(has_response) AS response FROM l GROUP BY 1)
SELECT page_id, CASE WHEN done THEN 'done' WHEN step = 'sending' AND response THEN 'received' WHEN step IN ('aligned', 'sending', 'received') THEN step ELSE last END AS state FROM f"""


def _streamed_sql() -> str:
    from formloom.plans.catalog.rows import values_sql
    from formloom.plans.catalog.symbols import CTE

    return CTE + values_sql() + """SELECT page_id, "column", value FROM vals WHERE "column" <> 'era' AND page_id IN (SELECT page_id FROM sym)"""


ENTRIES = {
    "reconciled_sources": Entry(reconciled_sources, _RECON + "SELECT name, replaced, action, other FROM res"),
    "skipped_duplicates": Entry(
        skipped_duplicates,
        _RECON + """SELECT r.name AS source_file, r.other, unnest(range(1, greatest(coalesce(i.n_pages, 1), 1) + 1)) AS page_no FROM res r LEFT JOIN inc i ON i.name = r.other WHERE r.action = 'duplicate'""",
    ),
    "renamed_pages": Entry(
        renamed_pages,
        _RECON + """SELECT coalesce(r.name, m.name) AS source_file, regexp_replace(m.name, '\\.pdf$', '_p0001') AS page_id FROM man m LEFT JOIN res r ON r.other = m.name AND r.action = 'renamed'""",
    ),
    "missing_inputs": Entry(missing_inputs, _RECON + "SELECT name FROM man WHERE name NOT IN (SELECT name FROM inc)"),
    "cascade_delete": Entry(
        cascade_delete,
        _RECON + "SELECT page_id, source_file, 3 AS cells FROM pg WHERE source_file NOT IN (SELECT name FROM res WHERE replaced)",
    ),
    "source_suffixes": Entry(
        source_suffixes,
        """WITH f AS (SELECT concat('f', doc_id, (['.pdf', '.JPG', '.tiff', '.txt.png', ''])[doc_id % 5 + 1]) AS name, doc_id % 5 AS k FROM documents) SELECT name, k IN (0, 1, 3) AS accepted FROM f""",
    ),
    "page_ids": Entry(page_ids, PAGE_ID_SQL),
    "replayed_responses": Entry(
        replayed_responses,
        """SELECT doc_id AS page_id, CASE WHEN n_chars > 100 THEN CASE doc_id % 4 WHEN 0 THEN length(text) + 1 WHEN 1 THEN length(to_json([text])) ELSE length(to_json({'text': text})) END END AS chars,
 CASE WHEN n_chars > 100 THEN NULL ELSE 'REPLAY_MISSING' END AS send_error FROM documents""",
    ),
    "reusable_responses": Entry(
        reusable_responses, "SELECT doc_id AS page_id, n_chars > 100 AND doc_id % 4 IN (2, 3) AND doc_id % 5 <> 1 AS reusable FROM documents"
    ),
    "stale_pages": Entry(stale_pages, _STALE + "SELECT page_id FROM stale"),
    "reuse_refusals": Entry(
        reuse_refusals,
        f"""WITH p AS ({X.STATE_SQL}), a AS ({ALIGN_SQL}), f AS (SELECT coalesce(bool_or(geometry_hash <> 'g1'), false) AS g, coalesce(bool_or(algo_version <> '2'), false) AS m,
  coalesce(bool_or(snap_enabled), false) AS s, bool_or(template_hash <> '1') AS t FROM p LEFT JOIN a USING (page_id) WHERE state = 'done')
 SELECT 'stored' AS stored, CASE WHEN g THEN 'geometry' WHEN m THEN 'method' WHEN s THEN 'snap' WHEN t THEN 'template' END AS reason FROM f
 UNION ALL SELECT 'geometry_same', CASE WHEN m THEN 'method' WHEN s THEN 'snap' WHEN t THEN 'template' END FROM f
 UNION ALL SELECT 'method_same', CASE WHEN s THEN 'snap' WHEN t THEN 'template' END FROM f
 UNION ALL SELECT 'snap_same', CASE WHEN t THEN 'template' END FROM f UNION ALL SELECT 'no_template', NULL FROM f""",
    ),
    "resend_plan": Entry(
        resend_plan,
        _STALE + """SELECT CASE WHEN s.page_id IS NOT NULL THEN 'pending' ELSE p.state END AS state, count(*) AS pages, 0 AS refused FROM p LEFT JOIN stale s USING (page_id) GROUP BY 1""",
    ),
    "refused_pages": Entry(
        refused_pages, _STALE + """SELECT p.page_id, p.state, s.page_id IS NOT NULL AS refused FROM p LEFT JOIN stale s USING (page_id)"""
    ),
    "upserted_rows": Entry(
        upserted_rows,
        """SELECT l_orderkey AS page_id, l_linenumber AS cell, l_quantity AS value FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
 UNION ALL SELECT o_orderkey, 1, -1.0 FROM orders WHERE o_orderstatus = 'O'""",
    ),
    "run_summary": Entry(
        run_summary,
        f"""WITH p AS ({X.STATE_SQL}) SELECT count(*) AS pages, count(*) FILTER (state = 'done') AS done_pages, count(*) FILTER (state = 'failed') AS failed_pages,
 count(*) FILTER (state = 'done' AND below >= 3) AS overflow_pages, sum(below)::BIGINT AS below_symbols, true AS success FROM p""",
    ),
    "page_event_log": Entry(
        page_event_log,
        f"""SELECT page_id, '{{"event":"page","page_id":' || page_id || ',"source_file":"' || source_file || '","state":"' || state || '","below":' || below || '}}' AS line FROM ({X.STATE_SQL}) p""",
    ),
    "page_status_table": Entry(page_status_table, f"SELECT state, count(*) AS pages FROM ({X.STATE_SQL}) p GROUP BY 1"),
    "budget_gate": Entry(
        budget_gate,
        f"""WITH r AS ({X.REQ_SQL}), t AS (SELECT event_id AS ord, CAST(period AS VARCHAR) AS period, sum(units) OVER (PARTITION BY period ORDER BY event_id)::BIGINT AS used FROM r)
 SELECT *, used <= 500 AS admitted FROM t""",
    ),
    "send_limit_gate": Entry(
        send_limit_gate,
        f"""WITH p AS (SELECT source_file, page_id AS page_no, state = 'done' AS has_response FROM ({X.STATE_SQL}) s),
 c AS (SELECT *, coalesce(sum(CASE WHEN has_response THEN 0 ELSE 1 END) OVER (ORDER BY source_file, page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
 SELECT source_file, page_no, has_response, CASE WHEN before >= 700 THEN 'capped' WHEN has_response THEN 'reused' ELSE 'sent' END AS gate FROM c""",
    ),
    "page_states": Entry(page_states, _FOLD),
    "streamed_page_states": Entry(streamed_page_states, _FOLD),
    "streamed_first_contents": Entry(streamed_first_contents, "SELECT DISTINCT sha256(text) AS hash FROM documents"),
    "streamed_rows": Entry(streamed_rows, _streamed_sql()),
    "unseen_contents": Entry(
        unseen_contents, _RECON + "SELECT hash, min(name) AS name FROM inc WHERE hash NOT IN (SELECT hash FROM man) GROUP BY 1"
    ),
    "csv_round_trip": Entry(
        csv_round_trip, "SELECT doc_id AS page_id, md5(text) AS digest, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS lang FROM documents"
    ),
}
