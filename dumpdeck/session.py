"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def build_session(app: str = "dumpdeck", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the toolkit is written for.

    On a cluster, master, memory and shuffle sizing come from spark-submit; only
    semantics are set here. Keyword arguments use ``__`` for the dots of a setting.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def pin_splits(spark: SparkSession) -> None:
    """Keep text splits the same from one job to the next.

    Split size depends on the number of live cores unless a fixed partition count is
    set, so losing executors between two passes over a dump would move the splits.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that every executor can see, under ``spark.checkpoint.dir``.

    Falls back to a local temporary folder only where there is one machine (local master).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix=f"dumpdeck-{label}-")
    return f"{base.rstrip('/')}/dumpdeck-{label}-{uuid.uuid4().hex}"


def posix_path(path: str) -> str:
    """Path of a mounted folder, for libraries that open files themselves."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return url.path
    raise ValueError(f"needs a mounted path, not {path}")


def ensure_folder(path: str) -> str:
    local = posix_path(path)
    os.makedirs(local, exist_ok=True)
    return local


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries, none if it is not there."""
    files, where = _file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)
