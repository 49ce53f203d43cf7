"""Size checks before a broadcast, and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A broadcast side may hold this many (narrow) rows; beyond it we shuffle.
BROADCAST_ROWS = 200_000
# A key with more rows than this is spread over several tasks.
HOT_ROWS = 1_000_000
SALTS = 32
# Rows of one task where a sort or a hash table holds them.
TASK_ROWS = 1_000_000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows.

    The limit is pushed below the count, so a large input is not read to the end.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows one, else as it is."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` by the hash of ``keys`` in enough partitions that about ``TASK_ROWS`` of its ``rows`` meet in a task.

    Rows of templates and pages compress many times over. Adaptive execution sees compressed bytes only and would put
    rows of gigabytes in one task; it leaves a given number of partitions as it is.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // TASK_ROWS)), *keys)


def hot_safe_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    weight: str,
    spread: Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join where one key of ``big`` may hold a large share of all rows.

    ``small`` has one row per key and a column ``weight`` with the number of
    ``big`` rows of that key. Only keys above ``hot_rows`` are salted: their
    ``small`` row is copied ``salts`` times and their ``big`` rows are spread by
    the hash of ``spread``. The list of hot keys holds at most
    ``rows / hot_rows`` entries; it is broadcast only after a count.
    """
    keys = list(keys)
    hot = small.filter(F.col(weight) > hot_rows).select(*keys, F.lit(True).alias("_hot"))
    hot = broadcast_if_small(hot)
    salted_small = small.withColumn(
        "_salt",
        F.explode(F.sequence(F.lit(0), F.when(F.col(weight) > hot_rows, salts - 1).otherwise(0))),
    )
    salted_big = big.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)),
    )
    return salted_big.join(salted_small, [*keys, "_salt"], how).drop("_salt", "_hot")


def inside(px: Column, py: Column, rect: Column) -> Column:
    """Half-open containment of a point in a rect struct."""
    return (
        (px >= rect["x"])
        & (px < rect["x"] + rect["w"])
        & (py >= rect["y"])
        & (py < rect["y"] + rect["h"])
    )
