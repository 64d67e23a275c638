"""Times the headline queries: one JSON line. BENCH_SF_DIR: tables (default sf0.1); BENCH_CPUS: local cores (default 8).

Each query is run once to warm up and then timed while it is written to the no-op sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from orestrata.plans import driver_queries
from orestrata.session import build_session

ENGINE = (
    "monthly_drop_top3", "rolling_anomalies", "fk_orphans_by_month", "out_of_validity", "keep_latest_dedup", "scd2_history", "scd2_apply", "upsert_if_newer",
    "insert_only_reconcile", "point_in_time_join", "window_5min", "salted_sum", "hot_key_split_join", "range_join", "gold_plant_productivity", "gold_supplier_finance",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g", spark__checkpoint__dir=f"{shared}/checkpoint", spark__sql__warehouse__dir=f"{shared}/warehouse",
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = {name: driver_queries.QUERIES[name] for name in ENGINE}
    try:
        from orestrata.llm import queries as llm

        run |= llm.QUERIES
    except ImportError:
        pass
    took: dict[str, float] = {}
    for name, query in run.items():
        if len(sys.argv) > 1 and name not in sys.argv[1:]:
            continue
        for again in range(2 if name in ENGINE else 1):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
