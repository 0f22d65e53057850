"""Summarise physical plans of registered workloads (after execution, so the
AQE-final plan is shown) and write PLANS.md.

usage: python scripts/show_plans.py [sf_dir]
"""
from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from shelfsort.session import build_session  # noqa: E402
from shelfsort.sources.store import LabelStore  # noqa: E402
from shelfsort.workloads import QUERIES, catalogue_labels  # noqa: E402

OPS = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
       "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Window", "Generate", "ArrowEvalPython",
       "BatchEvalPython", "Exchange", "WholeStageCodegen"]
SHOW = ["exact_lookup", "prediction_merge", "dedup_priority", "vocabulary", "vector_match", "fuzzy_match",
        "sub_keyword", "tag_names", "batch_tag"]


def summary(df):
    df.collect()   # runs this DataFrame's own QueryExecution, so AQE's final plan is shown
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    c = Counter(re.findall("|".join(OPS[:-1]), plan))
    c["WholeStageCodegen"] = len(set(re.findall(r"\*\((\d+)\)", plan)))
    scans = sorted(set(re.findall(r"ReadSchema: struct<[^>]*>", plan)))
    pushed = sorted(set(m.split(", ReadSchema")[0] for m in re.findall(r"PushedFilters: \[[^\n]{0,160}", plan)
                        if not m.startswith("PushedFilters: []")))
    return c, scans, pushed


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    out = ["# Physical plans (AQE final), sf=" + sf.rsplit("sf", 1)[-1], "",
           "Generated by `scripts/show_plans.py`. Counts are operator occurrences in the executed plan "
           "(cached or checkpointed inputs appear as scans).", "",
           "| workload | " + " | ".join(o for o in OPS) + " |", "|---|" + "---|" * len(OPS)]
    details = []
    for name in SHOW:
        c, scans, pushed = summary(QUERIES[name](spark, sf))
        out.append(f"| {name} | " + " | ".join(str(c.get(o, 0)) for o in OPS) + " |")
        details.append(f"- **{name}** scans: " + "; ".join(s.replace("ReadSchema: ", "") for s in scans[:4])
                       + (("; pushed: " + "; ".join(pushed)) if pushed else ""))
    # predicate pushdown into a label snapshot: candidates read only seed/human rows
    root = os.path.join(spark.sparkContext.getCheckpointDir() or "/tmp", "plans-store")
    store = LabelStore(spark, root)
    if not store.versions():
        store.save_as_is(catalogue_labels(spark, sf))
    from shelfsort.operators.labels import sub_candidates
    c, scans, pushed = summary(sub_candidates(store.load()))
    details.append("- **sub-category candidates from a label snapshot** scans: "
                   + "; ".join(s.replace("ReadSchema: ", "") for s in scans) + "; pushed: " + "; ".join(pushed))
    out += ["", "Scans and pushed filters:", ""] + details
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write(
        "\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main()
