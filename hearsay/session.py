"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings the plans rely on. Partition counts are left to AQE: it starts from
#: ``initialPartitionNum`` and merges small partitions to the advisory size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    # Window and duplicate state may outgrow the heap; this store keeps it on disk.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state."
    "RocksDBStateStoreProvider",
}


def session(app: str = "hearsay", master: str | None = None, **conf: object) -> SparkSession:
    """A session with :data:`SETTINGS`; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors can reach, from ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it then gets one
    temporary folder, kept in the session for later calls.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    key = "spark.hearsay.localFolder"
    folder = spark.conf.get(key, None)
    if folder and os.path.isdir(folder):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="hearsay-")
    spark.conf.set(key, folder)
    return folder


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path below :func:`shared_folder`; nothing is created yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
