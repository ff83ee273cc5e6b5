"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the tables. BENCH_CPUS: local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pitwall.plans.registry import QUERIES, stored_abt  # noqa: E402
from pitwall.session import spark_session  # noqa: E402

HEADLINE = [
    "champions",
    "last_n_rounds",
    "eligible_drivers",
    "asof_sessions",
    "driver_statistic_5",
    "driver_statistic_10",
    "driver_statistic_20",
    "driver_statistic_40",
    "driver_statistic_50",
    "driver_all_statistic",
    "tb_abt",
    "training_matrix",
    "roc_auc",
    "entity_dimension",
    "pivot_probability",
    "incremental_new_sessions",
    "fit_forest",
    "ingest_stream",
    "consolidate_published",
    "asof_any_date",
    "statistic_by_sql",
]
#: Run once before the clock starts, so that no timed query pays for the start of the session.
WARM_UP = "season_points"
#: The first query that reads the stored labelled table.
STORED_FIRST = "training_matrix"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = spark_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[WARM_UP](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        if name == STORED_FIRST:
            # What the queries from here on read, so that none of them pays for it.
            start = time.perf_counter()
            stored_abt(spark, sf_dir)
            seconds["store_abt"] = round(time.perf_counter() - start, 3)
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = Path(sf_dir).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
