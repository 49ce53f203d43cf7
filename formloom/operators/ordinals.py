"""Running totals and ordinals over one global order without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formloom.operators.sizing import broadcast_if_small
from formloom.session import kept


def running_total(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    out: str,
    keys: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order`` within ``keys``.

    Two levels: range partitions are cut along (keys, order), so a key that
    holds most rows spans many of them; each partition sums its own rows; the
    totals of the earlier partitions of the key (at most one row per partition
    and key) are added. The partitioned rows are written once, so a lost
    executor cannot move a row to another range between the two passes.
    ``order`` must be unique within ``keys``.
    """
    spark = df.sparkSession
    keys, order = list(keys), list(order)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = kept(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    totals = cut.groupBy(*keys, "_part").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    local = (
        Window.partitionBy("_part", *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cut.withColumn("_local", F.sum(value).over(local))
        .join(broadcast_if_small(offsets), ["_part", *keys])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_part", "_local", "_offset")
    )
