"""Scan the physical plan of every registered query:
python tools/plan_audit.py [sf_dir]

Reports nested-loop or cartesian joins (there should be none) and operators
that run in a single partition (global one-row aggregates, and windows over
histograms or over one row per partition)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpus_curator.plans.registry import all_queries  # noqa: E402
from corpus_curator.session import get_spark  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = get_spark(cpus=8)
cross, single = [], []
for name, fn in sorted(all_queries().items()):
    plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
    if "BroadcastNestedLoopJoin" in plan or "CartesianProduct" in plan:
        cross.append(name)
    if "SinglePartition" in plan:
        single.append(name)
print(f"queries: {len(all_queries())}")
print(f"nested-loop / cartesian joins: {cross or 'none'}")
print(f"single-partition exchanges (one-row aggregates, histograms, offsets): {single}")
