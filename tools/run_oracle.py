"""Run registered queries against their DuckDB oracle: python tools/run_oracle.py [sf_dir] [names...]"""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpus_curator.plans.check import compare, duck_connect  # noqa: E402
from corpus_curator.plans.registry import all_oracle_sql, all_queries  # noqa: E402
from corpus_curator.session import get_spark  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = get_spark(cpus=8)
con = duck_connect(sf_dir)
qs, sqls = all_queries(), all_oracle_sql()
bad = 0
for name in (names or sorted(qs)):
    try:
        r = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
    except Exception as e:  # report and go on
        r = {"name": name, "status": f"error {type(e).__name__}: {str(e)[:400]}"}
    if r["status"] not in ("ok", "rows-only"):
        bad += 1
    print(json.dumps(r), flush=True)
print(f"{bad} not ok of {len(names or qs)}")
