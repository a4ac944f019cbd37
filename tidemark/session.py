"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Static or cluster-wide settings; a cluster sets executors, memory and spark.checkpoint.dir itself.
BUILD_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Run-time settings, safe to apply to a session somebody else built.
RUN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split by AQE into several tasks once its partition is this large.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
}

DEFAULT_ZONE = "Asia/Shanghai"


def build_session(app: str, zone: str = DEFAULT_ZONE, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", zone)
    for key, value in {**BUILD_CONF, **RUN_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session."""
    for key, value in RUN_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared one; in local mode without one, a temporary folder."""
    if spark.sparkContext.master.startswith("local[") and not spark.conf.get("spark.checkpoint.dir", None):
        return tempfile.mkdtemp(prefix="tidemark-")
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set; pass a folder that all executors share")
    return folder.rstrip("/")
