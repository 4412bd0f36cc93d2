"""Session helpers: one place for the configuration every job here relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators assume. Shuffle partitions are sized for local tests;
# on a cluster the deployment sets them (AQE coalesces small ones anyway).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Files are wide rows: keep Arrow batches small in the parse step.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "revline",
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when it is unset (local tests) do we create one of our own, and only in
    local mode: on a cluster a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="revline-ckpt-", dir=os.environ.get("REVLINE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint directory for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/revline-{name}"


def materialize(df, name: str):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used where several outputs read one expensive frame (e.g. findings after the parse): it is
    computed once, and a lost executor re-reads files instead of re-running the lineage.
    """
    import uuid
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def scale_conf(input_bytes: int, executors: int, cores_per_executor: int,
               executor_memory_gb: float = 16.0, target_partition_mb: int = 128) -> dict:
    """Settings for a cluster run over ``input_bytes`` of source files.

    Shuffle partitions: enough that each holds about ``target_partition_mb`` of the largest
    shuffle (the content dedup moves up to the whole corpus once), and at least two waves of
    tasks. Scan splits: source files are wide rows parsed in Python at well under 1 MB/s per core,
    so smaller splits (64 MB) keep parse tasks around a minute and spread hot folders. Arrow
    batches stay small because one row can be a multi-megabyte file.
    """
    cores = executors * cores_per_executor
    by_size = -(-input_bytes // (target_partition_mb << 20))
    shuffle_partitions = max(2 * cores, by_size)
    per_core_gb = executor_memory_gb / max(cores_per_executor, 1)
    return {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.files.maxPartitionBytes": str(64 << 20),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(min(target_partition_mb, int(per_core_gb * 256)) << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
