"""Spark session settings for the report jobs."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings every report job wants, local or cluster.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hot aggregation keys are handled by partial (map-side) aggregation; hot
    # join keys by AQE skew-join splitting of the big side.
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    # split a hot join key even when the join's partitioning is reused by the
    # next join on the same key (items -> orders on order_id twice in a row)
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "kpiloom", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the report defaults.

    On a cluster ``master`` comes from spark-submit; pass ``master=None``.
    ``shuffle_partitions`` should be sized so a partition is ~128-256 MB of
    shuffle data at the target scale; AQE coalesces small ones at runtime.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        pass
    return spark


def app_id(spark: SparkSession) -> str:
    """Identifier of the running application (keys per-run snapshots)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        return spark.conf.get("spark.app.id", None) or f"session-{id(spark)}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory the cluster configured.

    Reads ``spark.checkpoint.dir`` from the session; only when it is unset
    (local tests) a fresh scratch directory is created and registered. On a
    cluster an unset folder is an error: executors would each write to their
    own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001
        pass
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if not path:
        master = sc.master if sc is not None else (spark.conf.get("spark.master", None) or "local")
        if not re.match(r"local(\[[^\]]*\])?$", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="kpiloom-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # noqa: BLE001 - core conf may be read-only at runtime
            pass
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scale_conf(shuffle_bytes: int, partition_bytes: int = 256 << 20, broadcast_bytes: int = 64 << 20) -> dict[str, str]:
    """Settings for a cluster run, sized from the largest expected shuffle.

    ``spark.sql.shuffle.partitions`` is the initial number of shuffle
    partitions: enough for ``partition_bytes`` per partition at the biggest
    shuffle (AQE coalesces the smaller shuffles down to the same advisory
    size and splits skewed partitions). Input splits use the same size. The
    broadcast threshold bounds what Spark broadcasts by its size check (the
    dimension snapshots); anything larger is sort-merge joined.
    """
    n = max(1, -(-shuffle_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(min(partition_bytes, 64 << 20)),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(broadcast_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(broadcast_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
    }
