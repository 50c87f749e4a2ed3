"""Resume as a stream: a record passes once, whatever file, micro-batch or run repeats it.

The keys that have passed are the query's state, hashed over the shuffle partitions and
kept in its checkpoint: a restarted query, also after lost executors, knows them. Keep
the state in RocksDB on a cluster (``session.cluster_settings`` does).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pass_once(stream: DataFrame, key: str) -> DataFrame:
    """The first record of each ``key``. Of records that repeat a key within one
    micro-batch any one passes. Records without a key pass once for each distinct
    content."""
    name = "_key"
    while name in stream.columns:
        name += "_"
    content = F.concat(F.lit("row:"), F.sha2(F.to_json(F.struct(*stream.columns)), 256))
    known = F.concat(F.lit("key:"), F.col(f"`{key}`").cast("string"))
    return stream.withColumn(name, F.coalesce(known, content)).dropDuplicates([name]).drop(name)


def append_files(out: DataFrame, out_dir: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Append a stream to JSON files (and wait for what is there now)."""
    writer = (out.writeStream.format("json").option("path", out_dir)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="30 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def remaining_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema,
                     key: str = "pair_id", available_now: bool = True) -> StreamingQuery:
    """The records of the files in ``in_dir`` whose key was not seen before, appended to
    ``out_dir``: ``operators.pairs.remaining`` without reading what is done again."""
    src = spark.readStream.schema(schema).json(in_dir)
    return append_files(pass_once(src, key), out_dir, checkpoint, available_now)
