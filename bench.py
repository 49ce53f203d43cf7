"""Time the headline queries and print one JSON line.

Each query runs to the end into a sink that discards rows; the time includes
planning. Rates per page and per symbol are reported beside the total.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from formloom.plans import fixtures as X  # noqa: E402
from formloom.plans.catalog import all_entries  # noqa: E402
from formloom.session import local_session  # noqa: E402

HEADLINE = (
    "symbol_assignment", "cell_contents", "row_values", "form_wide_rows", "page_counters", "version_diff",
    "response_symbols", "amounts", "reconciled_sources", "stale_pages", "budget_gate", "send_limit_gate",
    "template_cells", "receptor_overlaps", "adjacent_gaps", "shift_estimates", "page_verdicts", "new_overlaps",
    "line_segments", "closed_cells", "table_suggestions", "page_states",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, app="bench")
    entries = all_entries()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    symbols = X.table(spark, sf_dir, "lineitem").count()
    pages = X.pages(spark, sf_dir).count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cores": int(cores),
        "ms_per_page_symbols_to_rows": round(times.get("form_wide_rows", 0) * 1000 / pages, 3),
        "ms_per_page_assignment": round(times.get("symbol_assignment", 0) * 1000 / pages, 3),
        "symbols_per_sec_assignment": round(symbols / times.get("symbol_assignment", 1)),
        "pages": pages, "symbols": symbols,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
