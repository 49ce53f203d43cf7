"""The whole way from symbols to rows, and its parts as named frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.operators import assignment as A
from formloom.operators import rows as R
from formloom.session import kept
from formloom.sources.templates import TemplateTables, output_columns


MISMATCH = "様式不一致"  # fixed value


@dataclass(frozen=True)
class Extraction:
    local: DataFrame
    assigned: DataFrame
    counts: DataFrame
    contents: DataFrame
    holes: DataFrame
    cells: DataFrame


def extract(symbols: DataFrame, tables: TemplateTables, bucket: int = A.BUCKET, keep: bool = False,
            moves: DataFrame | None = None) -> Extraction:
    """A1's symbols (with ``template_id``) to contents per (page, field).

    The symbols are read twice: once for the contents (one shuffle of the
    symbols that hit a field) and once for the counts, which are reduced on the
    map side. With ``keep`` both, a fraction of the symbols, are written to the
    shared checkpoint folder so that holes, counters and rows read them from there.
    ``moves`` are those of ``with_moves``, for pages whose table blocks have moved.
    """
    local = A.to_face_local(symbols, tables)
    placed, reach = (local, 0) if moves is None else A.with_moves(local, moves, tables)
    assigned = A.assign_symbols(placed, tables, bucket, reach)
    counts = A.placement_counts(assigned)
    contents = A.field_contents(assigned, tables)
    if keep:
        contents, counts = kept(contents), kept(counts)
    holes = A.hole_hits(counts, contents)
    return Extraction(local, assigned, counts, contents, holes, A.cell_contents(contents, holes))


def form_values(symbols: DataFrame, pages: DataFrame, tables: TemplateTables,
                choices: DataFrame | None = None, rules: R.RowRules = R.RowRules(), moves: DataFrame | None = None) -> DataFrame:
    """One row per (page, output column); every page of ``pages`` appears in full."""
    found = extract(symbols, tables, keep=True, moves=moves)
    paged = A.page_contents(pages, found.cells)
    return R.build_rows(paged, tables, choices=choices, rules=rules)


def checked_rows(symbols: DataFrame, pages: DataFrame, tables: TemplateTables, columns: list[str],
                 choices: DataFrame | None = None, rules: R.RowRules = R.RowRules()) -> DataFrame:
    """The whole job for pages of one set of columns: contents, counters, form check, status, and one row per page.

    ``pages`` has page_id, template_id, source_file and page_no; ``choices`` is
    the packed scores of choice cells. A page that fails the form check (D7) is
    a failure row. As many rows come out as pages go in.
    """
    pages = pages.select("page_id", "template_id", "source_file", "page_no")
    found = extract(symbols, tables, keep=True)
    values = R.build_rows(A.page_contents(pages.select("page_id", "template_id"), found.cells), tables, choices=choices, rules=rules)
    counters = A.page_counters(pages, found.counts, found.contents, found.holes, tables)
    totals = counters.select("page_id", F.col("in_face").alias("page_total"))
    bad = A.format_mismatch(counters, totals, tables).select("page_id", "mismatch")
    checked = counters.select("page_id", "below").join(bad, "page_id").withColumnRenamed("page_id", "_page")
    status = pages.join(checked, F.col("page_id") == F.col("_page"), "left").select(
        "page_id", "source_file", "page_no", "below",
        F.when(F.col("mismatch"), MISMATCH).otherwise("").alias("status"),
        (~F.coalesce("mismatch", F.lit(True))).alias("processed"),
    )
    return R.wide_rows(values, status, columns, rules)


def form_rows(symbols: DataFrame, pages: DataFrame, tables: TemplateTables, template_id,
              choices: DataFrame | None = None, rules: R.RowRules = R.RowRules()) -> DataFrame:
    """The wide table of one template."""
    ours = pages.filter(F.col("template_id") == template_id)
    names = [
        r["column"]
        for r in output_columns(tables.cells)
        .filter(F.col("template_id") == template_id)
        .orderBy("col_ord")
        .collect()  # the columns of one template
    ]
    return checked_rows(symbols.filter(F.col("template_id") == template_id), ours, tables, names, choices, rules)
