"""Wall time of the headline queries. Prints one JSON line.

Steps that later queries read are built and timed first (``step:*``); each query
is then planned and run in full, its rows going to a sink that drops them.
``value`` is the sum of all of it.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rebaja.plans.queries import all_queries, run_of  # noqa: E402
from rebaja.session import builder  # noqa: E402

STEPS = ["lines", "elasticity", "features", "lifecycle", "sizes", "enhanced", "parent", "rows", "actions", "history_rows", "history"]
QUERIES = """weekly_sales velocity_features price_features target_variables stock_features elasticity_panel elasticity_by_parent
elasticity_by_category lifecycle_stage size_availability_stock size_availability_sales empirical_lift margin_targets parent_features
competitor_features category_interactions weighted_size_features price_increase_pass markdown_pass channel_actions cross_store_alerts
apply_decisions planner_queue outcomes outcome_summary brand_overview impact_breakdown walk_forward_metrics recommendations
price_position match_offers""".split()


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = builder("bench", cores, max(8, int(cores))).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run, queries, times = run_of(spark, path), all_queries(), {}
    spark.read.parquet(f"{path}/lineitem.parquet").count()  # start the executors
    for step in STEPS:
        start = time.time()
        getattr(run.t if step == "lines" else run, step)
        times[f"step:{step}"] = round(time.time() - start, 3)
    for name in QUERIES:
        start = time.time()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total wall time of weekly steps and headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(path.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
