"""Files that Python workers open themselves, without Spark."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

#: Schemes of Hadoop next to those by which Arrow knows the same stores.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a full address, as Hadoop resolves it, in a scheme that workers can open.

    A path without a scheme is on the default file system, which on a cluster is not the
    machine's own. An error names the schemes that can be opened.
    """
    entry = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = entry.getFileSystem(spark._jsc.hadoopConfiguration())
    address = system.makeQualified(entry).toString()
    scheme, rest = address.split(":", 1)
    if scheme not in SCHEMES:
        raise ValueError(f"Python workers cannot open {address}; use one of {', '.join(SCHEMES)}")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return f"{SCHEMES[scheme]}:{rest}"


def store(address: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of an address given by ``qualified``."""
    scheme, rest = address.split(":", 1)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
