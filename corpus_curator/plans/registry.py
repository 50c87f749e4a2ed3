"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries, queries_annotate, queries_io
    out = dict(queries.QUERIES)
    out.update(queries_annotate.QUERIES)
    out.update(queries_io.QUERIES)
    return out


def all_oracle_sql() -> dict[str, str]:
    from . import oracle, oracle_annotate, oracle_io
    out = dict(oracle.SQL)
    out.update(oracle_annotate.SQL)
    out.update(oracle_io.SQL)
    names = all_queries()
    return {k: v for k, v in out.items() if k in names}
