"""Session helpers: a tuned local session for tests/bench, and the shared
checkpoint folder used to cut lineage.

On a cluster the checkpoint folder is whatever the cluster names in
``spark.checkpoint.dir`` (a shared file system). Only a local session that has
none gets a private folder under the system temp directory.
"""

from __future__ import annotations

import os
import tempfile
import uuid as _uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "corpus_curator", cpus: int | str = "*",
              shuffle_partitions: int = 8, driver_memory: str = "16g") -> SparkSession:
    """Session for tests and the bench (local mode)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting it from
    ``spark.checkpoint.dir`` when the context has none yet.

    A folder of our own is made only for a local master with no setting (tests);
    a cluster without the setting is an error, because a machine-local folder
    would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cc-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint root for written intermediate tables."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, f"{name}-{_uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives lost executors, and later reads prune columns and rows."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cluster_settings(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Session settings for a large run (pass to ``SparkSession.builder.config``).

    Shuffle partitions are sized so that a partition of the largest shuffle
    (at most the input) stays near ``target_partition_bytes`` before AQE
    coalesces small ones; skewed partitions are split by AQE; broadcasts stay
    below a fixed bound (our own broadcasts are size-checked separately);
    runtime Bloom filters let a small join side prune the scan of a large one.
    """
    parts = max(2 * cores, min(200_000, input_bytes // target_partition_bytes + 1))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
    }
