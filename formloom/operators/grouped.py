"""Walks over small ordered groups, many groups per Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

Rows = dict[str, list]


def map_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[tuple, Rows], list[tuple]], schema: str
) -> DataFrame:
    """``work(key, columns)`` for every group, its rows sorted by ``order``.

    Spark partitions by ``keys`` and sorts; a task then cuts its sorted rows into
    groups and carries the last one over to the next batch, so it holds one group
    and one batch at a time. Only for groups with a proven bound (a page of
    pixels, the rows of one table); a fixed partition number keeps small but
    busy inputs from ending up in a single task.
    """
    keys = list(keys)
    names = [c.strip().split()[0] for c in schema.split(",")]
    columns = df.columns
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Rows = {c: [] for c in columns}
        held_key: tuple | None = None
        for batch in batches:
            data = {c: batch[c].tolist() for c in columns}
            out: list[tuple] = []
            start = 0
            marks = list(zip(*(data[k] for k in keys)))
            for i in range(1, len(marks) + 1):
                if i < len(marks) and marks[i] == marks[start]:
                    continue
                if held_key is not None and held_key != marks[start]:
                    out.extend(work(held_key, held))
                    held = {c: [] for c in columns}
                held_key = marks[start]
                for c in columns:
                    held[c].extend(data[c][start:i])
                start = i
            if out:
                yield pd.DataFrame(out, columns=names)
        if held_key is not None:
            rest = work(held_key, held)
            if rest:
                yield pd.DataFrame(rest, columns=names)

    ready = df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    return ready.mapInPandas(run, schema)
