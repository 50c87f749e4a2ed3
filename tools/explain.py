"""Write the physical plans of the headline queries to PLANS.md:
python tools/explain.py [sf_dir]"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpus_curator.plans.registry import all_queries  # noqa: E402
from corpus_curator.session import get_spark  # noqa: E402

NAMES = ["q_weighted_sample_lineitem", "q_rating_sample_records", "q_tag_sample",
         "q_tag_probability", "q_clean_scores", "q_validate_first_level", "q_annotate_rate",
         "q_global_rank", "q_bt_gradient"]

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = get_spark(cpus=8)
qs = all_queries()
out = ["# Physical plans of the headline queries",
       "",
       f"Generated by `tools/explain.py` at `{sf}` (local[8]). Inputs derived from the given",
       "tables are written once as Parquet, so every plan starts at a pruned scan.",
       ""]
for name in NAMES:
    df = qs[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = [ln if len(ln) <= 220 else ln[:217] + "..." for ln in plan.splitlines()]
    out += [f"## {name}", "", "```", *lines[:60], "```", ""]
with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"),
          "w") as fh:
    fh.write("\n".join(out) + "\n")
print("wrote PLANS.md")
