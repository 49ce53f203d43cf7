"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


def all_entries() -> dict[str, Entry]:
    from importlib import import_module

    out: dict[str, Entry] = {}
    for name in ("symbols", "rows", "scalars", "templates", "lineage", "lines", "runs"):
        module = import_module(f"{__name__}.{name}")
        overlap = out.keys() & module.ENTRIES.keys()
        if overlap:
            raise ValueError(f"registered twice: {sorted(overlap)}")
        out.update(module.ENTRIES)
    return out
