"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

from .sources import files

# Settings a job on a cluster wants; none of them depends on the data at hand.
CLUSTER_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a panel compiles more pieces than the default hundred, and would do so each time
    "spark.sql.codegen.cache.maxEntries": "2000",
}


def local_session(cpus: str | int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark: one JVM, one shuffle partition per core."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in CLUSTER_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folders: dict[str, str] = {}
_scratch: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folders.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tallyloom-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses; ``drop_scratch`` removes it."""
    own = os.path.join(shared_folder(spark), f"tallyloom-{uuid.uuid4().hex}")
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(own)
    return os.path.join(own, name)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch folder of this application; frames that read them are spent."""
    for path in _scratch.pop(spark.sparkContext.applicationId, []):
        files.remove(spark, path)
