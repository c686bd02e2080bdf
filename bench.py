"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every query
runs to a no-op sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from labelmill.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "validate_profile", "valid_rows", "annotator_vote", "clean_documents", "clean_accounting", "clean_legacy_documents",
    "language_vote", "noise_stats", "canonical_dedup", "resolve_majority", "conflict_audit", "doc_freq", "near_dup_survivors",
    "undersample", "stratified_split", "leakage", "length_stats", "vocab_size", "top_words", "class_report", "roc_auc",
    "qa_gate", "log_windows", "batch_score",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("labelmill-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.labelmill.dealOut", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()  # JVM start-up
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
