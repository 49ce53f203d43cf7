"""Compare registered queries with their SQL: python tests/check.py SF [name ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    try:
        return float(v) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, entry, sf_dir: str):
    df = entry.run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if entry.sql is None:
        return len(got), None, ""
    cur = con.execute(entry.sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(got), False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return len(got), True, ""
    extra, missing = [r for r in got if r not in want][:3] if len(got) < 3000 else [], []
    if len(got) >= 3000:
        g, w = set(map(repr, got)), set(map(repr, want))
        extra, missing = list(g - w)[:3], list(w - g)[:3]
    else:
        missing = [r for r in want if r not in got][:3]
    return len(got), False, f"rows {len(got)} vs {len(want)}; extra {extra}; missing {missing}; cols {sorted(names)}"


def main() -> int:
    from formloom.plans.catalog import all_entries
    from formloom.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    entries = all_entries()
    names = sys.argv[2:] or list(entries)
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            count, ok, why = compare(spark, con, entries[n], sf_dir)
        except Exception as e:  # report and go on
            count, ok, why = -1, False, "".join(traceback.format_exception_only(e))[:1500]
        mark = {True: "ok", None: "rows", False: "FAIL"}[ok]
        bad += ok is False
        print(f"{mark:5} {n:32} rows={count:<8} {time.time() - t0:6.1f}s {why}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
