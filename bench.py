"""Time the headline queries; prints one JSON line.

Every query runs in full into Spark's no-op sink. One untimed run warms the
JVM, then the better of two timed runs counts.
"""

from __future__ import annotations

import json
import os
import time

from quern.plans import load_all
from quern.session import local_session

HEADLINES = (
    "b11_daily_order_stats", "b03_page", "b05_search_rows", "b07_format_cells", "b09_audit_summary",
    "b12_daily_active_users", "b13_top_products", "b14_monthly_sales", "b16_mask_columns",
    "c01_history_search", "c03_with_favorite_flag", "c04_with_theme_and_tables", "c06_query_statistics_by_user",
    "c11_popular_questions", "c13_add_favorites", "c16_apply_history_updates",
    "d08_search_metadata", "d15_effective_glossary", "d20_profile_columns", "d21_sample_values",
    "e01_user_permissions", "e03_user_permission_set", "e04_effective_grants_intersection", "e06_check_permissions",
    "f01_similar_items", "f02_similar_allowed", "f03_replace_documents",
    "g01_task_timeline", "g03_task_progress", "g04_validation_result", "g11_log_metrics",
    "h02_stream_query_stats", "h04_stream_task_timeout",
    "i02_inner_join", "i06_asof_join", "i07_group_having", "i08_cube", "i09_running_total", "i13_subqueries",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "quern-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all().QUERIES

    def run(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in HEADLINES:
        run(name)
        seconds[name] = round(min(run(name), run(name)), 4)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
