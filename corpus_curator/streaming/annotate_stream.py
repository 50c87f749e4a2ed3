"""Incremental annotation with Structured Streaming.

New input files in ``in_dir`` are annotated and appended to ``out_dir`` once:
the file source remembers which files it has read in the checkpoint (with ``key``
also which keys have passed, whatever file they come in), the file sink commits each micro-batch exactly once, and a restarted query (after a
crash or the loss of executors) resumes from the last committed batch. Run it
with ``available_now=True`` as a catch-up job (process everything new, then
stop) or as a long-running query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.annotate import annotate
from .resume import append_files, pass_once


def annotate_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, fn: Callable,
                    schema, prompt_col: str = "prompt", reply_col: str = "reply",
                    available_now: bool = True, max_files_per_trigger: int | None = None,
                    key: str | None = None, **kw) -> StreamingQuery:
    """Start the query (and wait for it when ``available_now``). ``key``: a record whose
    key came before, in any file or run, is not annotated again."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.json(in_dir)
    if key is not None:
        src = pass_once(src, key)
    out = annotate(src, fn, prompt_col, reply_col, **kw)
    return append_files(out, out_dir, checkpoint, available_now)


def read_annotated(spark: SparkSession, out_dir: str, schema) -> DataFrame:
    """The committed output of the sink (files of failed batches are ignored
    through the sink's metadata log)."""
    return spark.read.schema(schema).json(out_dir)
