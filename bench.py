"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from repolith.plans import catalog  # noqa: E402
from repolith.session import build_session  # noqa: E402

HEADLINE = (
    "hot_files", "file_churn", "contributors", "contributor_areas", "commit_style", "commit_patterns",
    "co_change_counts", "co_change_topk", "missing_partners", "language_share", "architecture_facts",
    "module_rollup", "hot_dirs", "fan_in", "blast_radius", "type_declarations", "class_names", "todo_scan",
    "rule_scan", "lead_paragraph", "framework_detect", "pr_flatten", "question_dedup", "supersession",
    "confidence_score", "snapshot_merge", "throttle_user", "stream_frequency", "fleet_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        begin = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(name, times[name], file=sys.stderr)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
