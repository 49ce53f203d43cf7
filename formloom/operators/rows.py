"""Output rows (H8, H9, H10), run summary (D27), version diff (C20), choice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.functions import scalars as S
from formloom.operators.sizing import broadcast_if_small
from formloom.session import kept
from formloom.sources.templates import TemplateTables

DECIDE_GAP = 0.05
CHOICE_THRESHOLD = 0.05
META_COLUMNS = ("page_id", "source_file", "page_no", "status", "unclear_count", "min_conf")


@dataclass(frozen=True)
class RowRules:
    """Thresholds of the row builder."""

    unclear_threshold: float = S.UNCLEAR_THRESHOLD
    choice_threshold: float = CHOICE_THRESHOLD
    char_level: bool = False


def choice_decision(scores: Column, threshold: float = CHOICE_THRESHOLD) -> Column:
    """The chosen option of ``array<struct<option, ord, score>>``.

    With three or more options the smallest score is taken off all of them.
    'unselected' without scores or below the threshold, 'undecided' when the
    two best are too close; equal scores keep option order.
    """
    floor = F.when(F.size(scores) >= 3, F.array_min(F.transform(scores, lambda s: s["score"]))).otherwise(0.0)
    ranked = F.array_sort(
        F.transform(
            scores,
            lambda s: F.struct(
                (-(s["score"] - floor)).alias("neg"), s["ord"].alias("ord"), s["option"].alias("option")
            ),
        )
    )
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    top = -best["neg"]
    runner = F.coalesce(-second["neg"], F.lit(0.0))
    return (
        F.when(scores.isNull() | (F.size(scores) == 0) | (top < threshold), "unselected")
        .when(top - runner < DECIDE_GAP, "undecided")
        .otherwise(best["option"])
    )


def pack_choices(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Option scores of a field as one array; a field has as many entries as its template has marks."""
    return scores.groupBy(*keys).agg(
        F.collect_list(F.struct("option", "ord", "score")).alias("scores")
    )


def build_rows(paged: DataFrame, tables: TemplateTables, choices: DataFrame | None = None,
               rules: RowRules = RowRules()) -> DataFrame:
    """H8: one row per (page, output column).

    ``paged`` has ``page_id, template_id, contents`` (a map of field to
    content). Cells come in by a broadcast join on ``template_id``, values by
    look-up in the map, so pages are shuffled once, before the fan-out.
    ``choices`` (page_id, choice_map) maps choice fields to their decision.

    Result: page_id, template_id, col_ord, column, value, value_long, origin,
    kept_conf (the confidence that counts towards the page minimum).
    """
    text_fields = (
        F.when(F.col("kind") == "text", F.lit(True)).otherwise(False)
    )
    spec = tables.cells.withColumn(
        "row_fields",
        F.when(
            F.col("table_id").isNotNull(),
            F.array_compact(
                F.collect_list(F.when(text_fields, F.col("field_id"))).over(
                    Window.partitionBy("template_id", "table_id", "row_no")
                )
            ),
        ),
    ).filter("output")
    numbered = Window.partitionBy("template_id").orderBy("cell_ord")
    width = F.greatest(F.size("subfields"), F.lit(1))
    spec = spec.select(
        "template_id", "field_id", "kind", "subfields", "normalize", "row_fields",
        (F.sum(width).over(numbered.rowsBetween(Window.unboundedPreceding, 0)) - width).alias("base"),
    )
    if choices is not None:
        paged = paged.join(choices, "page_id", "left")
        decision = F.try_element_at("choice_map", F.col("field_id"))
    else:
        decision = F.lit(None).cast("string")
    out = paged.join(tables.small(spec), "template_id")
    filled = F.coalesce(F.map_keys("contents"), F.array().cast("array<string>"))
    is_empty = F.coalesce(
        (F.size("row_fields") > 0) & ~F.arrays_overlap(filled, "row_fields"), F.lit(False)
    )
    out = out.withColumn("c", F.try_element_at("contents", F.col("field_id"))).withColumn("is_empty", is_empty)
    raw = F.coalesce(F.col("c.raw"), F.lit(""))
    conf = F.col("c.conf")
    split = F.size("subfields") > 0
    amount_cell = F.coalesce(F.col("normalize") == "amount", F.lit(False))
    # NFKC runs once per text, and only for cells that are normalised
    out = out.withColumn("_norm", F.when(split | amount_cell, S.nfkc(F.trim(raw))))
    out = out.withColumn("_reason", S.unclear_reason(raw, conf, rules.unclear_threshold))
    out = out.withColumn("_amount", F.when(amount_cell, S.normalize_amount(F.col("_norm"), True)))
    out = out.withColumn("_parts", F.when(split, S.split_composite(F.col("_norm"), F.size("subfields"), True)))
    if rules.char_level:
        masked = F.when(
            ~split & ~amount_cell & (F.col("_reason") == "low_conf"),
            S.mask_low_confidence(raw, F.col("c.char_confs"), rules.unclear_threshold),
        )
        out = out.withColumn("_masked", masked)
        low_value, low_conf = F.col("_masked.value"), F.col("_masked.kept")
    else:
        low_value, low_conf = F.lit(None).cast("string"), F.lit(None).cast("double")
    unclear = F.lit(S.UNCLEAR)
    width = F.greatest(F.size("subfields"), F.lit(1))
    choice_value = F.when(F.col("is_empty"), "").when(
        F.coalesce(decision.isin("unselected", "undecided"), F.lit(True)), unclear
    ).otherwise(decision)
    text_value = (
        F.when(split, F.coalesce("_parts", F.array_repeat(unclear, width)))
        .when(amount_cell, F.array(F.coalesce(F.col("_amount").cast("string"), unclear)))
        .otherwise(F.array(raw))
    )
    values = (
        F.when(F.col("kind") == "choice", F.array(choice_value))
        .when(F.col("is_empty"), F.array_repeat(F.lit(""), width))
        .when(F.col("c.origin") == "conflict", F.array_repeat(unclear, width))
        .when(F.col("_reason").isNotNull(), F.array_repeat(F.coalesce(low_value, unclear), width))
        .otherwise(text_value)
    )
    trusted = (F.col("kind") == "text") & ~F.col("is_empty") & ~F.coalesce(
        F.col("c.origin") == "conflict", F.lit(False)
    )
    passed = trusted & F.col("_reason").isNull()
    split_ok = ~split | F.col("_parts").isNotNull()
    amount_ok = ~amount_cell | F.col("_amount").isNotNull()
    shown = passed & split_ok & amount_ok
    kept = F.when(shown, conf).when(trusted, low_conf)
    out = out.select(
        "page_id", "template_id", "field_id", "subfields", "base",
        F.posexplode(values).alias("part", "value"),
        F.when(shown & amount_cell, F.col("_amount")).alias("value_long"),
        F.when(shown | (trusted & low_conf.isNotNull()), F.coalesce("c.origin", F.lit(""))).otherwise("").alias(
            "origin"
        ),
        kept.alias("kept_conf"),
    )
    column = F.when(
        F.size("subfields") > 0,
        F.concat(F.col("field_id"), F.lit("_"), F.get("subfields", F.col("part"))),
    ).otherwise(F.col("field_id"))
    return out.select(
        "page_id", "template_id", (F.col("base") + F.col("part")).cast("long").alias("col_ord"),
        column.alias("column"), "value", "value_long", "origin", "kept_conf",
    )


def row_totals(values: DataFrame, rules: RowRules = RowRules()) -> DataFrame:
    """Unclear count and lowest shown confidence per page."""
    masked = F.contains("value", F.lit(S.UNCLEAR)) if rules.char_level else F.col("value") == S.UNCLEAR
    return values.groupBy("page_id").agg(
        F.count_if(masked).alias("unclear_count"),
        F.coalesce(S.format_conf(F.min("kept_conf")), F.lit("")).alias("min_conf"),
    )


def failure_rows(pages: DataFrame, columns: DataFrame) -> DataFrame:
    """H9: every output column of a page that is not done is unclear."""
    return pages.join(broadcast_if_small(columns), "template_id").select(
        "page_id", "template_id", F.col("col_ord").cast("long").alias("col_ord"), "column",
        F.lit(S.UNCLEAR).alias("value"), F.lit(None).cast("long").alias("value_long"),
        F.lit("").alias("origin"), F.lit(None).cast("double").alias("kept_conf"),
    )


def wide_rows(values: DataFrame, pages: DataFrame, columns: list[str], rules: RowRules = RowRules()) -> DataFrame:
    """One row per page of one template: six meta columns, then the values in column order.

    The column list is explicit, so the pivot needs no extra pass. ``pages``
    has source_file, page_no, status, below and processed. Pages that were not
    processed, or have no values, become failure rows (H9): every column is
    unclear, whatever was read on them, and there is no confidence.
    """
    masked = F.contains("value", F.lit(S.UNCLEAR)) if rules.char_level else F.col("value") == S.UNCLEAR
    picks = [F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    packed = values.groupBy("page_id").agg(
        F.count_if(masked).alias("unclear_count"), F.min("kept_conf").alias("_conf"), *picks
    )
    status = S.compose_status(F.coalesce("status", F.lit("")), F.coalesce("below", F.lit(0)), F.col("processed"))
    failed = ~F.coalesce("processed", F.lit(False)) | F.col("unclear_count").isNull()
    return pages.join(packed, "page_id", "left").select(
        "page_id", "source_file", "page_no", status.alias("status"),
        F.when(failed, F.lit(len(columns))).otherwise(F.col("unclear_count")).cast("long").alias("unclear_count"),
        F.when(failed, "").otherwise(F.coalesce(S.format_conf(F.col("_conf")), F.lit(""))).alias("min_conf"),
        *[F.when(failed, S.UNCLEAR).otherwise(F.col(f"`{c}`")).alias(c) for c in columns],
    )


def risky_cells(values: DataFrame) -> DataFrame:
    """Cells whose text starts like a spreadsheet formula; values are not returned."""
    first = F.substring("value", 1, 1)
    return values.filter(
        F.col("value_long").isNull() & first.isin("=", "+", "-", "@", "\t", "\r", "\n")
    ).select("page_id", "column")


def version_pages(values: DataFrame) -> DataFrame:
    """C20: one row a page: a digest of its values in column order, their number, and the values themselves packed.

    Rows of a page come from one fan-out of the page, so this is the only shuffle of the long form.
    """
    cell = F.struct("column", F.col("value").isNull().alias("none"), F.coalesce("value", F.lit("")).alias("value"))
    packed = values.groupBy("page_id").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return packed.select("page_id", F.xxhash64("cells").alias("digest"), F.size("cells").cast("long").alias("n"), "cells")


def page_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """C20: (page_id, cells, diffs) of two versions, with ``diffs`` the names of the columns that differ.

    A page or a column that only one version has differs. Pages are compared by their digests; only those whose digests
    differ are looked at cell by cell, within their row.
    """
    left = version_pages(a).select("page_id", *[F.col(c).alias(f"a_{c}") for c in ("digest", "n", "cells")])
    right = version_pages(b).select("page_id", *[F.col(c).alias(f"b_{c}") for c in ("digest", "n", "cells")])
    both = left.join(right, "page_id", "full")
    none = F.array().cast("array<struct<column:string,none:boolean,value:string>>")
    own, other = F.coalesce("a_cells", none), F.coalesce("b_cells", none)
    names = lambda cells: F.transform(cells, lambda c: c["column"])
    loose = F.concat(F.array_except(own, other), F.array_except(other, own))
    same = F.coalesce(F.col("a_digest") == F.col("b_digest"), F.lit(False))
    no_diff = F.array().cast("array<string>")
    every = F.when(same, F.col("a_n")).otherwise(F.size(F.array_union(names(own), names(other))).cast("long"))
    return both.select("page_id", every.alias("cells"), F.when(same, no_diff).otherwise(F.array_sort(F.array_distinct(names(loose)))).alias("diffs"))


def diff_summary(pages: DataFrame) -> DataFrame:
    """C20: pages, changed pages, compared and differing cells of ``page_diff``."""
    n = F.size("diffs").cast("long")
    return pages.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(n > 0).alias("pages_changed"),
        F.coalesce(F.sum("cells"), F.lit(0)).alias("cells_compared"), F.coalesce(F.sum(n), F.lit(0)).alias("diff_cells"),
    )


def first_diffs(pages: DataFrame, limit: int = 200) -> DataFrame:
    """The first differing cells of ``page_diff`` in order, with the total and a truncated flag.

    The changed pages are written once; their number of cells is one sum, and
    ``orderBy().limit()`` keeps ``limit`` rows per task before merging.
    """
    changed = kept(pages.filter(F.size("diffs") > 0).select("page_id", "diffs"))
    total = changed.agg(F.coalesce(F.sum(F.size("diffs").cast("long")), F.lit(0)).alias("n")).first().n
    return (
        changed.select("page_id", F.explode("diffs").alias("column")).orderBy("page_id", "column").limit(limit)
        .withColumn("total", F.lit(total)).withColumn("truncated", F.lit(total > limit))
    )


def run_summary(pages: DataFrame) -> DataFrame:
    """Totals of a run over a page table with state, status, below, unclear and counters."""
    done = F.col("state") == "done"
    failed = F.col("state") == "failed"
    return pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(done).alias("done_pages"),
        F.count_if(failed).alias("failed_pages"),
        F.count_if(done & (F.col("below") >= S.OVERFLOW_MIN)).alias("overflow_pages"),
        F.coalesce(F.sum("below"), F.lit(0)).alias("below_symbols"),
    ).withColumn(
        "success", ~((F.col("done_pages") + F.col("failed_pages") > 0) & (F.col("done_pages") == 0))
    )
