"""Compare a registered Spark query with its SQL oracle (DuckDB) the way the
driver does: row count, column names, and an order-insensitive comparison of
the values with the columns sorted by name."""

from __future__ import annotations

import math
import time
from collections import Counter


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "array<bigint>": "BIGINT[]", "float": "FLOAT"}


def type_mismatches(spark_dtypes, duck_cols, duck_types) -> list:
    """Columns whose Spark type does not map to the DuckDB type."""
    duck = dict(zip(duck_cols, (str(t) for t in duck_types)))
    out = []
    for name, t in spark_dtypes:
        want = _TYPES.get(t, t.upper())
        if name in duck and duck[name] != want:
            out.append((name, t, duck[name]))
    return out


def duck_connect(sf_dir: str, tables=None):
    import duckdb
    con = duckdb.connect()
    names = tables or ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                       "events", "documents", "embeddings", "pages", "benchmark", "labels",
                       "conversations"]
    for t in names:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = {"name": name, "rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    o_cols = rel.columns
    mism = type_mismatches(df.dtypes, o_cols, rel.types)
    if mism:
        res["type_mismatch"] = mism
    o_rows = rel.fetchall()
    res["oracle_rows"] = len(o_rows)
    if sorted(s_cols) != sorted(o_cols):
        res["status"] = f"schema mismatch spark={s_cols} oracle={o_cols}"
        return res
    s_idx = [s_cols.index(c) for c in sorted(s_cols)]
    o_idx = [o_cols.index(c) for c in sorted(o_cols)]
    s_bag = Counter(tuple(_norm(r[i]) for i in s_idx) for r in s_rows)
    o_bag = Counter(tuple(_norm(r[i]) for i in o_idx) for r in o_rows)
    if len(s_rows) != len(o_rows):
        res["status"] = "row count mismatch"
    elif s_bag != o_bag:
        diff_s = list((s_bag - o_bag).elements())[:3]
        diff_o = list((o_bag - s_bag).elements())[:3]
        res["status"] = f"value mismatch spark-only={diff_s} oracle-only={diff_o}"
    else:
        res["status"] = "ok"
    return res
