"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.registry import QUERIES  # noqa: E402
from checks.session import local_session  # noqa: E402

HEADLINE = (
    "profile_table", "numeric_stats", "categorical_stats", "top_values", "correlation_matrix",
    "dataset_summary", "semantic_types_insight", "grouped_aggregates", "clean_full", "change_log",
    "insight_num_num", "insight_cat_num", "insight_trend", "insight_cat_cat", "insight_quality",
    "chart_scatter", "chart_bar", "chart_grouped", "chart_line", "chart_histogram", "chart_box",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    small = "/root/testdata/sf0.001"
    if os.path.isdir(small):
        QUERIES["profile_table"](spark, small).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
