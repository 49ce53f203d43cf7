"""Writing rows, column lists and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_KEYS = ("event", "page_id", "state", "status", "count", "reason", "elapsed_ms")


def write_wide_csv(wide: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: wide rows as CSV, every field quoted, quotes doubled, CRLF line ends.

    Spark writes one file per partition, each with its header; rows are sorted
    by (source file, page number) inside the files when both columns exist.
    The column list is written beside the data. A byte order mark is not written.
    Line feeds inside a value are written as CRLF too; Spark's own reader, left
    to find the line ends itself, turns them back.
    """
    order = [c for c in ("source_file", "page_no") if c in wide.columns]
    ready = wide.select([F.col(f"`{c}`").cast("string").alias(c) for c in wide.columns])
    if order:
        ready = ready.repartitionByRange(*order).sortWithinPartitions(*order)
    ready.write.mode(mode).csv(
        path, header=True, quoteAll=True, escape='"', lineSep="\r\n", emptyValue="", nullValue=""
    )
    spark = wide.sparkSession
    columns = spark.createDataFrame(list(enumerate(wide.columns)), "ord INT, column STRING")
    columns.coalesce(1).write.mode(mode).json(path.rstrip("/") + "_columns")


def page_events(pages: DataFrame) -> DataFrame:
    """One event per page, as it goes into the JSON Lines log."""
    return pages.select(
        "page_id",
        F.to_json(
            F.struct(F.lit("page").alias("event"), "page_id", "source_file", "state", "below")
        ).alias("line"),
    )


def status_table(pages: DataFrame) -> DataFrame:
    """Number of pages in each state."""
    return pages.groupBy("state").agg(F.count(F.lit(1)).alias("pages"))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append events as JSON Lines."""
    events.write.mode(mode).text(path) if events.columns == ["line"] else events.write.mode(mode).json(path)
