"""Folders on the cluster's shared file system."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Only a local session may do without that setting; on a cluster a machine-local folder would
    be invisible to the other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="airmetrics-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when the folder exists on whatever file system the path names."""
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop)


def is_folder(spark: SparkSession, path: str) -> bool:
    """True when the path, taken literally, is a folder."""
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop) and fs.getFileStatus(hadoop).isDirectory()


def delete_files(spark: SparkSession, files: list[str]) -> None:
    """Delete files by name, on whatever file system they are."""
    for name in files:
        fs, hadoop = _file_system(spark, name)
        fs.delete(hadoop, False)


def child_folders(spark: SparkSession, path: str, column: str) -> list[tuple[str, str]]:
    """Value and path of the partitions of a folder by ``column``; none if there is no folder."""
    fs, hadoop = _file_system(spark, path)
    if not fs.exists(hadoop):
        return []
    prefix = f"{column}="
    found = [status.getPath() for status in fs.listStatus(hadoop)]
    return sorted((p.getName()[len(prefix) :], p.toString()) for p in found if p.getName().startswith(prefix))


def delete_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders with all they hold."""
    for name in paths:
        fs, hadoop = _file_system(spark, name)
        fs.delete(hadoop, True)


def drop_partitions_before(spark: SparkSession, path: str, column: str, day: str) -> list[str]:
    """Delete the date partitions of a folder that are older than ``day``; returns their names."""
    fs, hadoop = _file_system(spark, path)
    if not fs.exists(hadoop):
        return []
    prefix = f"{column}="
    dropped = []
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        if name.startswith(prefix) and name[len(prefix) :] < day:
            fs.delete(status.getPath(), True)
            dropped.append(name[len(prefix) :])
    return sorted(dropped)
