"""Streams: incremental extraction, page states, first sight of a content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from formloom.operators.lineage import fold_page_state
from formloom.operators.rows import RowRules
from formloom.plans.extraction import form_values
from formloom.sources.templates import TemplateTables


def read_files(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    """A file stream over parquet; each trigger takes at most ``per_trigger`` files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def write_batches(stream: DataFrame, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run ``work`` on every batch and write it below ``batch_id=N``.

    The batch number is part of the path and the write replaces it, so a batch
    repeated after a failure leaves no second copy.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def incremental_extract(symbols: DataFrame, tables: TemplateTables, out: str, checkpoint: str,
                        done: Callable[[], DataFrame] | None = None, rules: RowRules = RowRules()) -> StreamingQuery:
    """Rows for the pages of each batch of symbols.

    All symbols of a page arrive in one batch (a page is one response). Pages
    in ``done()`` are skipped; the call is made per batch, so pages finished by
    an earlier batch are seen.
    """

    def work(batch: DataFrame) -> DataFrame:
        todo = batch if done is None else batch.join(done().select("page_id"), "page_id", "left_anti")
        pages = todo.select("page_id", "template_id").distinct()
        return form_values(todo, pages, tables, rules=rules)

    return write_batches(symbols, out, checkpoint, work)


def page_state_table(log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Changed page states per batch, appended as versions below ``out``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        fold_page_state(log).writeStream.outputMode("update").foreachBatch(each)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_states(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of every page state."""
    return spark.read.parquet(out).groupBy("page_id").agg(F.max_by("state", "version").alias("state"))


def first_contents(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """S3: the first file of every content seen by this stream.

    Contents are remembered for good, as a late copy must still be found; which
    copy comes first inside one batch is not defined. The batch form against
    the manifest has the last word.
    """
    seen = files.dropDuplicates(["hash"])
    return (
        seen.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
