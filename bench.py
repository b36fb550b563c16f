"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and print one JSON line.

Arguments name the queries to time instead; ``all`` times every query of the library's own. Every query runs once to
warm up, then $BENCH_RUNS times (3 if not given), of which the median counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

from clickmart_checks import jobs
from clickmart_checks.compare import local_session

HEADLINES = [
    "core_kpis",
    "monthly_kpis",
    "monthly_growth",
    "source_performance",
    "source_campaign_segments",
    "device_opportunity",
    "landing_page_performance",
    "funnel_steps",
    "session_paths",
    "product_performance",
    "product_refund_risk",
    "product_refund_summary",
    "monthly_product_mix",
    "attach_rate",
    "pk_uniqueness",
    "fk_orphans",
    "refunds_before_item",
    "header_line_reconciliation",
    "metrics_overall",
    "metrics_by_source",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="clickmart-bench")
    queries = jobs.queries()
    names = list(queries) if names == ["all"] else names or HEADLINES

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names:
        run(name)
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    seconds = {name: round(median(run(name) for _ in range(runs)), 3) for name in names}
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
