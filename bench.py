"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR is the table folder, BENCH_CPUS the number of local cores,
BENCH_QUERIES an optional comma-separated choice.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from riskweave.plans.catalog import QUERIES  # noqa: E402
from riskweave.session import build_session  # noqa: E402

HEADLINE = [
    "import_versions", "latest_view", "label_bulk", "filter_groups", "search_page",
    "match_nodes", "match_merge", "pair_edges", "edge_refresh", "direct_connections",
    "connected", "connected_topk", "graph_tree", "simple_features", "graph_features",
    "feature_pack", "feature_violations", "score_rules", "score_channels",
    "process_orders", "recalculate", "run_percentiles", "payload_features",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.driver.memory": "20g",
        "spark.ui.enabled": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="riskweave-bench-"),
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(2 * int(cpus)),
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    times = {}
    for name in chosen:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
