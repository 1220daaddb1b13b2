"""Folder operations through Hadoop, so any storage Spark reaches will do."""

from __future__ import annotations

import codecs
import uuid

from pyspark.sql import SparkSession


def _folder(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = _folder(spark, path)
    return system.exists(folder)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path: one listing, no data read."""
    system, folder = _folder(spark, path)
    if not system.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(folder) if s.isDirectory())


def file_names(spark: SparkSession, path: str) -> set[str]:
    system, folder = _folder(spark, path)
    if not system.exists(folder):
        return set()
    return {s.getPath().getName() for s in system.listStatus(folder) if s.isFile()}


def remove(spark: SparkSession, path: str) -> bool:
    system, folder = _folder(spark, path)
    return system.delete(folder, True)


def is_file(spark: SparkSession, path: str) -> bool:
    system, entry = _folder(spark, path)
    return system.exists(entry) and system.getFileStatus(entry).isFile()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, or None if there is none."""
    system, entry = _folder(spark, path)
    if not system.exists(entry):
        return None
    stream = system.open(entry)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """Write a small text file that does not exist yet, or replace it."""
    system, entry = _folder(spark, path)
    stream = system.create(entry, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def rename(spark: SparkSession, old: str, new: str) -> None:
    system, entry = _folder(spark, old)
    if not system.rename(entry, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"could not rename {old} to {new}")


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file that is not blank, unpacked if it is compressed; None if there is none."""
    system, entry = _folder(spark, path)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(entry)
    stream = system.open(entry)
    try:
        if codec is not None:
            stream = codec.createInputStream(stream)
        text = b""
        while True:
            part = bytes(stream.readNBytes(1 << 16))
            text = (text + part).removeprefix(codecs.BOM_UTF8).lstrip(b" \t\r\n")
            if b"\n" in text or b"\r" in text or not part:
                return text.splitlines()[0].decode() if text else None
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file that appears whole or not at all; one that is there already is an error."""
    temporary = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp"
    write_text(spark, temporary, text)
    fs = spark._jvm.org.apache.hadoop.fs
    source, target = fs.Path(temporary), fs.Path(path)
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    context = fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(system.makeQualified(source), system.makeQualified(target),
                       spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Exception:
        system.delete(source, False)
        raise
