"""Record shaping: ids, uuids, content columns, truncation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_uuid(*keys: Column | str) -> Column:
    """uuid-formatted md5 of the keys joined by '|': the same record always
    gets the same id, whatever the partitioning or the re-computation."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    h = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def assign_uuid(df: DataFrame, mode: str = "stable", keys: Sequence[str] = (),
                seed: int | None = None, name: str = "uuid") -> DataFrame:
    """``mode="stable"``: md5 of ``keys``. ``mode="random"``: Spark's ``uuid()``
    (new ids on every computation, so the result must be written or
    checkpointed before it feeds two branches)."""
    if mode == "stable":
        if not keys:
            raise ValueError("stable uuids need key columns")
        return df.withColumn(name, stable_uuid(*keys))
    if mode == "random":
        return df.withColumn(name, F.expr("uuid()") if seed is None
                             else F.expr(f"uuid({int(seed)})"))
    raise ValueError("mode must be 'stable' or 'random'")


def concat_keys(df: DataFrame, keys: Sequence[str], out: str = "text") -> DataFrame:
    """Values of the named columns joined by newline, absent (null or missing)
    ones skipped, and no newline while the text so far is empty."""
    present = [F.col(k).cast("string") for k in keys if k in df.columns]
    if not present:
        return df.withColumn(out, F.lit(""))
    arr = F.filter(F.array(*present), lambda x: x.isNotNull())
    joined = F.aggregate(arr, F.lit(""), lambda acc, x: F.when(
        F.length(acc) > 0, F.concat(acc, F.lit("\n"), x)).otherwise(x))
    return df.withColumn(out, joined)


def empty_content_report(df: DataFrame, col: str = "text") -> DataFrame:
    """One row: ``n_rows`` and ``n_empty`` (content of length 0)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(F.length(col) == 0).alias("n_empty"))


def union_datasets(datasets: Sequence[tuple[DataFrame, str | None]]) -> DataFrame:
    """All rows of several datasets in one frame with a ``dataset`` column: the
    given name, or (None) the frame's own column. Columns one of them lacks are
    null there."""
    named = [df if name is None else df.withColumn("dataset", F.lit(name))
             for df, name in datasets]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def truncate_text(df: DataFrame, n: int = 2500, col: str = "text", out: str | None = None) -> DataFrame:
    """First n characters."""
    return df.withColumn(out or col, F.substring(F.col(col), 1, n))


def normalize_records(df: DataFrame, out: str = "text") -> DataFrame:
    """One text column from the raw record shapes. Precedence: the JSON string
    ``original_content`` (its ``clean_text``, else ``raw_content``), else
    ``content``, else ``summary``."""
    parts = []
    if "original_content" in df.columns:
        oc = F.from_json(F.col("original_content"),
                         "clean_text string, raw_content string")
        parts.append(F.when(F.col("original_content").isNotNull(),
                            F.coalesce(oc["clean_text"], oc["raw_content"])))
    for c in ("content", "summary"):
        if c in df.columns:
            parts.append(F.col(c))
    if not parts:
        return df.withColumn(out, F.lit(None).cast("string"))
    return df.withColumn(out, F.coalesce(*parts) if len(parts) > 1 else parts[0])


def assign_instance_id(df: DataFrame, order_by: Sequence[str], id_col: str = "instance_id",
                       start: int = 0, row_key: Sequence[str] = ()) -> DataFrame:
    """Keep a record's own ``instance_id``; records without one get their
    0-based ordinal in ``order_by`` order plus ``start``. ``row_key``: columns no two
    records agree in; only they are sorted then, not whole records."""
    from .rank import global_rank
    ranked = global_rank(df, list(order_by), name="_ord", start=0, row_key=row_key)
    if id_col in df.columns:
        ranked = ranked.withColumn(id_col, F.coalesce(F.col(id_col).cast("long"),
                                                      F.col("_ord") + F.lit(start)))
    else:
        ranked = ranked.withColumn(id_col, F.col("_ord") + F.lit(start))
    return ranked.drop("_ord")
