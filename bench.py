"""Times the headline queries: one warm-up, then the median of the timed runs, rows to a noop sink.

BENCH_SF_DIR   folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query (default 2)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline list)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from dossier.plans import catalog

HEADLINE = [
    "a1_reports_per_theme", "a3_author_search", "a4_theme_coverage",
    "d1_identity_merge", "d3_reference_disposition", "d8_tags_in_order",
    "e2_latest_industry", "e6_exact_names", "e8_code_routing", "e12_bridge_vote",
    "f1_report_list", "f4_current_projection", "f7_theme_reports", "f17_theme_detail",
    "n1_normalize_title", "n3_normalize_company_name", "n5_clean_markdown", "n6_anchor_publish_date",
    "n13_chunk_bodies", "r1_index_build", "r2_conjunctive_match", "s6_search_references",
    "v2_resolve_themes", "v5_pool_backfill", "w4_retry_states", "w6_daily_quota",
    "x2_normalize_result", "x9_target_projection", "y1_evidence_selection", "y5_digest",
]


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def timed(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    catalog.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.queries()) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = session(cpus)
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        if runs > 0:
            timed(spark, name, folder)
        seconds[name] = round(statistics.median(timed(spark, name, folder) for _ in range(max(1, runs))), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
