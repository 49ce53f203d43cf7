"""Reconciling sources, gates and page states."""

import hashlib
import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from formloom.operators import lineage as N
from formloom.sources import files as FS
from formloom.streaming import incremental as I
from test_forms import SMALL, small_symbols

FILES = "name STRING, hash STRING"


def actions(spark, incoming, manifest, pages=()):
    out = N.reconcile_sources(
        spark.createDataFrame(incoming, FILES), spark.createDataFrame(manifest, FILES),
        spark.createDataFrame(list(pages), "source_file STRING, state STRING"),
    )
    return {r["name"]: (r["action"], r["other"], r["replaced"]) for r in out.collect()}


def test_every_kind_of_source(spark):
    got = actions(
        spark,
        [("a", "1"), ("b", "9"), ("new1", "5"), ("new2", "5"), ("moved", "7"), ("busy", "8"), ("copy", "1")],
        [("a", "1"), ("b", "2"), ("gone", "7"), ("gone2", "8")],
        [("busy", "done"), ("moved", "skipped_duplicate")],
    )
    assert got == {
        "a": ("same", None, False), "b": ("new", None, True), "new1": ("new", None, False), "new2": ("duplicate", "new1", False),
        "moved": ("renamed", "gone", False), "busy": ("rename_fallback", "gone2", False), "copy": ("duplicate", "a", False),
    }


def test_swapped_contents_are_both_processed(spark):
    got = actions(spark, [("x", "2"), ("y", "1")], [("x", "1"), ("y", "2")])
    assert got == {"x": ("new", None, True), "y": ("new", None, True)}


def test_a_second_run_changes_nothing(spark):
    files = [(f"f{i}", str(i)) for i in range(20)]
    assert {a for a, _, _ in actions(spark, files, files).values()} == {"same"}


def test_gates(spark):
    pages = spark.createDataFrame([("s", i, i in (1, 4)) for i in range(6)], "source_file STRING, page_no INT, has_response BOOLEAN")
    got = [r["gate"] for r in N.send_limit_gate(pages, 2).orderBy("page_no").collect()]
    assert got == ["sent", "reused", "sent", "capped", "capped", "capped"]
    assert {r["gate"] for r in N.send_limit_gate(pages, 0).collect()} == {"capped"}
    req = spark.createDataFrame([("m", i, u) for i, u in enumerate([400, 400, 200, 1])], "period STRING, ord INT, units LONG")
    assert [r["admitted"] for r in N.budget_gate(req, 900).orderBy("ord").collect()] == [True, True, False, False]


def test_page_ids_keep_and_avoid(spark):
    pages = spark.createDataFrame([("in/a.pdf", 1), ("in/a.png", 1), ("in/b.pdf", 1)], "source_file STRING, page_no LONG")
    known = spark.createDataFrame([("in/b.pdf", 1, "kept")], "source_file STRING, page_no LONG, page_id STRING")
    got = {r["source_file"]: r["page_id"] for r in FS.assign_page_ids(pages, known).collect()}
    assert got["in/b.pdf"] == "kept" and got["in/a.pdf"] == "a_p0001"
    assert got["in/a.png"].startswith("a_") and got["in/a.png"].endswith("_p0001") and len(got["in/a.png"]) == 16


def test_listing_files(spark):
    folder = Path(tempfile.mkdtemp(prefix="run-"))
    for name in ("b.PDF", "a.png", "c.txt"):
        (folder / name).write_bytes(b"x")
    (folder / "deep").mkdir()
    (folder / "deep" / "d.jPeG").write_bytes(b"y")
    (folder / "pdf").write_bytes(b"x")
    rows = FS.list_sources(spark, str(folder)).collect()
    assert {r["name"]: r["accepted"] for r in rows} == {"b.PDF": True, "a.png": True, "d.jPeG": True, "c.txt": False, "pdf": False} and len(rows) == 5
    for r in rows:
        data = b"y" if r["name"] == "d.jPeG" else b"x"
        assert r["hash"] == (hashlib.sha1(data).hexdigest() if r["accepted"] else None)
        assert r["bytes"] == 1


def test_states_never_go_back(spark):
    log = [("a", ["pending", "expanded", "aligned", "expanded"], "aligned"), ("b", ["aligned", "failed", "expanded"], "expanded"),
           ("c", ["done", "expanded"], "done"), ("d", ["sending"], "received"), ("e", ["expanded"], "expanded"), ("f", ["skipped_duplicate"], "skipped_duplicate")]
    rows = [(p, i, i, s, p == "d") for p, states, _ in log for i, s in enumerate(states)]
    df = spark.createDataFrame(rows, "page_id STRING, ts INT, ord INT, state STRING, has_response BOOLEAN")
    got = {r["page_id"]: r["state"] for r in N.fold_page_state(df).collect()}
    assert got == {p: want for p, _, want in log}


def test_streamed_batches_equal_one_batch(spark):
    from formloom.plans.extraction import form_values
    from formloom.sources.templates import expand_templates

    tables = expand_templates(spark.createDataFrame([(json.dumps(SMALL),)], "body STRING")).settled()
    base = tempfile.mkdtemp(prefix="run-")
    schema = "page_id STRING, template_id STRING, seq LONG, text STRING, x DOUBLE, y DOUBLE, conf DOUBLE"
    rows = [(f"p{k}", "b", i, t, x, y + k, 0.9) for k in range(3) for i, (t, x, y) in enumerate(small_symbols())]
    everything = spark.createDataFrame(rows, schema)
    for k in range(3):
        everything.filter(F.col("page_id") == f"p{k}").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = I.read_files(spark, f"{base}/in", everything.schema, per_trigger=1)
    I.incremental_extract(stream, tables, f"{base}/out", f"{base}/cp").awaitTermination()
    got = spark.read.parquet(f"{base}/out")
    assert got.select("batch_id").distinct().count() == 3
    want = form_values(everything, everything.select("page_id", "template_id").distinct(), tables)
    key = lambda df: sorted((r["page_id"], r["column"], r["value"]) for r in df.collect())
    assert key(got) == key(want)
