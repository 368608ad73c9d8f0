"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewire import plans  # noqa: E402
from tidewire.session import clear_steps, get_session  # noqa: E402

HEADLINE = [
    "a1_count_by_municipality", "a5_annual_summary", "a14_cycle_totals", "d3_near_duplicates", "d5_verdicts",
    "d6_title_pairs", "d9_cleanup_clusters", "e25_pin_audit", "j6_children_per_parent", "l5_related", "q8_verification",
    "s4_page_articles", "t6_content_hash", "t8_simhash", "t23_pii_redaction", "t24_copied_passages", "w4_trailing_mean",
    "w5_failure_streaks", "x11_fact_struct", "x13_traffic_gate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(plans.queries()) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = get_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        plans.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        clear_steps(spark)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
