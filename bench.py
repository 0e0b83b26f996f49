"""Benchmark: every registered analysis on $BENCH_SF_DIR (default sf0.1) with local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (sum of per-query medians, sec, without
the iterative keys), "unit", "queries": {name: median sec}, "iterative": {...}, "sf", ...}.

* ``build_sales`` times the ETL (raw tables -> cleaned ``sales`` written to a
  fresh folder under ``spark.checkpoint.dir``) on its own, warm-up first.
* Every other query reads the materialised ``sales`` (as analyses do on a
  cluster). Headline queries run once to warm up and ``BENCH_REPEAT`` (default 3)
  timed times, all other keys once, after them. Results go to Spark's ``noop``
  sink, so nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "monthly_sales", "rolling_revenue", "mom_growth", "yoy_growth", "week_weekday_heatmap",
    "weekday_month_aov", "revenue_histogram", "category_boxplot", "channel_performance",
    "category_product_rollup", "region_performance", "top_products", "describe_numeric",
    "rfm_scores", "cohort_retention", "retention_curve", "revenue_forecast", "forecast_by_category",
    "welch_weekend_aov", "mannwhitney_channel_ltv", "segment_summary", "overview_kpis", "clean_sales",
]

#: Group of the iterative keys, reported apart.
ITERATIVE = "kmeans"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from orderscope.registry import load_all
    from orderscope.session import build_session, checkpoint_dir
    from orderscope.sources.sales import build_sales, load_sales

    spark = build_session(f"local[{cpus}]", max(cpus, 8))
    reg = load_all()
    names = only or [*HEADLINE, *[n for n in reg if n not in HEADLINE]]
    times: dict[str, float] = {}
    iterative: dict[str, float] = {}

    # ETL on its own: fresh, full builds of the cleaned table (each to a new
    # folder), one warm-up and ``repeat`` timed runs, like every query below.
    runs = []
    for i in range(repeat + 1):
        out = f"{checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex[:8]}/sales"
        t0 = time.perf_counter()
        build_sales(spark, sf_dir).write.mode("overwrite").parquet(out)
        if i:
            runs.append(time.perf_counter() - t0)
    times["build_sales"] = round(statistics.median(runs), 3)
    load_sales(spark, sf_dir).count()  # the shared materialisation the analyses read

    for name in names:
        e = reg[name]
        once = name not in HEADLINE
        runs = []
        for i in range(1 if once else repeat + 1):
            t0 = time.perf_counter()
            e.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i or once:
                runs.append(time.perf_counter() - t0)
        (iterative if e.group == ITERATIVE else times)[name] = round(statistics.median(runs), 3)

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "all_queries_total_sec", "value": total, "unit": "sec",
                      "queries": times, "iterative": iterative, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "cpus": cpus, "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
