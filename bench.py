"""Time the headline queries on ``local[$BENCH_CPUS]`` and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from loomlog.plans.queries import QUERIES
from loomlog.session import build_session

HEADLINE = (
    "action_groups", "parsed_groups", "action_summary", "actor_summary", "incoming_summary", "point_summary",
    "analysis_time", "marked_range_summary", "area_stays", "segment_assignment", "included_summary",
    "log_search_groups", "context_rows", "party_metrics", "timeline_events", "timeline_results", "layout_rows",
    "member_report", "action_report", "combined_order", "raw_dedupe", "canonicalize", "canonical_order",
    "snapshot_records", "flat_records", "document_keys",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "loomlog-bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's compilers on the smallest query, so that the first timing is like the others.
    QUERIES["ungrouped_lines"](spark, sf_dir).collect()
    times = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
