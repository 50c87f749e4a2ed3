"""Sinks. Output is written by all tasks in parallel (one file per partition)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite",
                  partition_by: str | list[str] | None = None) -> None:
    """Write records (JSON lines by default, UTF-8 kept)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)


def append_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append finished records to an output folder."""
    df.write.mode("append").format(fmt).save(path)


def write_ids(df: DataFrame, path: str, key: str = "uuid", mode: str = "overwrite") -> None:
    """Sampled ids, one ``{"uuid": ...}`` object per line."""
    df.select(key).write.mode(mode).json(path)


def write_scores(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``{task, id, score}`` lines."""
    df.select("task", "id", "score").write.mode(mode).json(path)


def write_pairs(pairs: DataFrame, path: str, n: int, compare: int,
                mode: str = "overwrite") -> None:
    """A pair set: ``path/pairs`` (one line per pair, written in parallel) and
    ``path/meta`` (one line ``n, n_pairs, compare``)."""
    pairs.write.mode(mode).json(f"{path}/pairs")
    meta = pairs.agg(F.lit(n).cast("long").alias("n"), F.count(F.lit(1)).alias("n_pairs"),
                     F.lit(compare).cast("long").alias("compare"))
    meta.write.mode(mode).json(f"{path}/meta")


def write_taxonomy(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A taxonomy as its edges, one ``{first, second, third}`` line each."""
    edges.select("first", "second", "third").write.mode(mode).json(path)


def preview(df: DataFrame, n: int = 20) -> list:
    """First n rows for a look (not part of a pipeline)."""
    return df.limit(n).collect()


def write_bucketed(df: DataFrame, table: str, key: str = "uuid", buckets: int = 4096,
                   mode: str = "overwrite", path: str | None = None) -> None:
    """Save the corpus as a table bucketed and sorted by ``key`` (in the
    session's warehouse folder, or under ``path``). Later joins on ``key`` with the same bucket
    count read it without shuffling it, so repeated draws shuffle only their
    ids."""
    writer = df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
