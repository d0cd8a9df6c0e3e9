"""Headline queries, timed one by one: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8). Every
query is built and executed from the raw tables; nothing is shared between them
except where the metric says so (the state table, which later jobs read back).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from volpanel.registry import load  # noqa: E402
from volpanel.session import local_session  # noqa: E402

HEADLINE = (
    "s01_fixed_bar_scan",
    "s05_execution_windows",
    "w03_midrank_percentile",
    "x06_index_feature_history",
    "x01_expiry_surface",
    "x04_carrier_surface",
    "x10_published_phase",
    "x12_target_ledger",
    "x13_out_of_fold_scores",
    "x19_condor_candidates",
    "x24_opportunity_panel",
    "x23_ledger_report",
    "p14_quote_gate",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = load()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
