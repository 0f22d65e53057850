"""Benchmark: headline workloads at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of query seconds), "unit",
"queries": {name: seconds}, "sf"}.  Each query is fully executed (rows are
counted on the executors, nothing is collected).
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfsort.session import build_session  # noqa: E402
from shelfsort.workloads import QUERIES  # noqa: E402

HEADLINE = [
    "tag_names", "batch_tag", "hint_gate", "exact_lookup", "fuzzy_match", "vector_match",
    "vector_topk", "sub_keyword", "sub_fuzzy", "sub_vector", "dataset_sim",
    "near_dup_leaders", "dedup_priority", "prediction_merge", "correction_merge",
    "seed_insert", "vocabulary", "tfidf_weights", "char_grams", "model_score",
    "llm_replies", "table_stats",
]


def warm_up(spark) -> None:
    """Untimed: JVM code paths and the Python worker for the Arrow UDF start
    once, so the first timed query is not charged for process warm-up."""
    from pyspark.sql import functions as F
    from shelfsort.functions.fuzz import indel_ratio
    spark.range(2000).select(F.col("id").cast("string").alias("a")).select(
        indel_ratio("a", "a").alias("r")).agg(F.sum("r")).collect()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    warm_up(spark)
    times = {}
    for name in only:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
