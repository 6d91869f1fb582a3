"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opsreview.plans.catalog import QUERIES  # noqa: E402
from opsreview.session import local_session  # noqa: E402

HEADLINE = (
    "kpi_rollup",
    "period_features",
    "eg001_unescalated",
    "eg002_uninvestigated",
    "eg003_unremediated",
    "ns001_silent_assets",
    "ns002_vanished_telemetry",
    "pb001_peer_deviation",
    "trend_scores",
    "mrd001_divergence",
    "investigation_records",
    "running_baseline",
    "if_rep001_repetitive",
    "if_dev002_deviation",
    "if_mea003_missing_action",
    "an001_isolation_forest",
    "findings",
    "evidence_refs",
    "queue_merge",
    "ingest_alert_issues",
    "dataset_audit",
    "assessment_findings",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, partitions=int(cpus), app="opsreview-bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "eg001_unescalated", folder)  # start-up is not part of the measurement
    seconds = {name: round(run(spark, name, folder), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
