"""Times the headline queries once each and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "scan_projection filter_compound group_by_agg multi_join_chain inner_join left_join semi_join_exists anti_join_not_exists revenue_by_segment count_distinct "
    "row_number window_running_sum lag_lead top_k distinct union_distinct cte_chain stats_summary stats_ema rows_pipeline fn_date_format fn_json_extract"
).split()


def main() -> None:
    from tesselon.queries import QUERIES
    from tesselon.session import session

    spark = session(f"local[{CPUS}]", spark__ui__enabled="false", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["count_star"](spark, SF_DIR).collect()  # starts the JVM's code paths
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
