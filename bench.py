"""Time the headline jobs and print one JSON line.

Every query starts from nothing: what queries share within a session is
dropped before each, and its whole result is read.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "p3_missing", "p4_distinct", "p8_quantiles", "p13_histogram", "p15_category_frequencies", "p17_spearman",
    "p18_group_profile", "p22_assembled_profile", "v3_privacy_scan", "g4_discrete", "g16_rank_correlation",
    "g18_groups", "q2_ks_statistic", "q9_correlation_error", "q10_quality_score", "r4_end_to_end",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from catalog import comparing, generating, inputs, profiling  # noqa: F401
    from catalog.registry import QUERIES

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds = {}
    for name in wanted:
        inputs.forget()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).collect()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
