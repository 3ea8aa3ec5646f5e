"""Compressed input.

``.gz``, ``.bz2`` and ``.zst`` text is read in place by Spark. Archives with members (zip,
tar.gz, tgz) are unpacked by tasks, one archive each, streaming member by member into a shared
folder; nothing is held whole in memory.
"""

from __future__ import annotations

import os
import re
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 8 << 20
ARCHIVES = r"(?i)\.(zip|tgz|tar\.gz)$"
LAYOUT = "archive string, member string, path string, n_bytes long"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, n_bytes)`` of the files under a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.col("length").alias("n_bytes"))
    )


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a name as Spark prints it, which isn't escaped."""
    local = re.fullmatch(r"file:/+(.*)", uri, re.DOTALL)
    if local or "://" not in uri:
        return fs.LocalFileSystem(), f"/{local[1]}" if local else uri
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/@:')}")


def open_uri(uri: str):
    """Seekable stream of a file on any filesystem pyarrow knows."""
    system, path = file_system(uri)
    return system.open_input_file(path)


def _safe(name: str) -> str | None:
    """Relative member path, or None for one that would leave the folder."""
    clean = os.path.normpath(name.replace("\\", "/"))
    return None if clean.startswith(("/", "..")) or clean in (".", "") else clean


def _zip_members(uri: str) -> list[str]:
    with open_uri(uri) as stream, zipfile.ZipFile(stream) as z:
        return [i.filename for i in z.infolist() if not i.is_dir()]


def _contents(uri: str, member: str | None) -> Iterator[tuple[str, object]]:
    """One member of a zip, or all files of a tar, as streams."""
    with open_uri(uri) as stream:
        if member is not None:
            with zipfile.ZipFile(stream) as z:
                yield member, z.open(member)
            return
        with tarfile.open(fileobj=stream, mode="r|gz") as t:
            for info in t:
                # Links and devices carry no data.
                if info.isfile():
                    yield info.name, t.extractfile(info)


def _unpack(uri: str, only: str | None, folder: str) -> Iterator[tuple[str, str, str, int]]:
    system, root = file_system(folder)
    for name, source in _contents(uri, only):
        member = _safe(name)
        if member is None:
            raise ValueError(f"{uri}: member path leaves the folder: {name}")
        target = f"{root}/{member}"
        system.create_dir(os.path.dirname(target), recursive=True)
        # A lost or repeated task leaves only a whole file under the final name.
        partial = f"{target}.{uuid.uuid4().hex}.partial"
        size = 0
        with system.open_output_stream(partial, compression=None) as out:
            while chunk := source.read(CHUNK):
                size += out.write(chunk)
        system.move(partial, target)
        yield uri, member, f"{folder}/{member}", size


def unpack(spark: SparkSession, path: str, dest: str, tasks: int = 1000) -> DataFrame:
    """Unpack every archive under ``path`` into a folder of its own below ``dest``.

    Zip members are spread over the tasks one by one; a tar can only be read from its start, so
    it is one task. Returns ``(archive, member, path, n_bytes)``, read back from a table written
    next to the members, so the work is done once.
    """
    archives = list_files(spark, path).filter(F.col("path").rlike(ARCHIVES)).select("path")

    def members(batches):
        for pdf in batches:
            for uri in pdf["path"]:
                names = _zip_members(uri) if uri.lower().endswith(".zip") else [None]
                yield pd.DataFrame({"path": uri, "member": pd.Series(names, dtype=object)})

    def run(batches):
        for pdf in batches:
            for uri, member in zip(pdf["path"], pdf["member"]):
                # Archives of different folders may share a name.
                folder = f"{dest.rstrip('/')}/{os.path.basename(uri)}-{zlib.crc32(uri.encode()):08x}"
                done = list(_unpack(uri, member, folder))
                yield pd.DataFrame(done, columns=["archive", "member", "path", "n_bytes"])

    listing = f"{dest.rstrip('/')}/_members"
    found = archives.mapInPandas(members, "path string, member string")
    found.repartition(tasks).mapInPandas(run, LAYOUT).write.mode("overwrite").parquet(listing)
    return spark.read.parquet(listing)


def content_root(members: DataFrame) -> DataFrame:
    """``(archive, root)``: the file if there is one, the folder if there is one, else all.

    A zip with one file gives that file; a tar keeps its folder in that case.
    """
    folder = F.regexp_extract("path", r"^(.*)/", 1)
    top = F.when(F.contains("member", F.lit("/")), F.substring_index("member", "/", 1))
    grouped = members.groupBy("archive").agg(
        F.count("*").alias("n"),
        F.min("path").alias("first"),
        F.min(F.length("member")).alias("len"),
        F.min_by(F.struct("path", "member"), "path").alias("one"),
        F.count_distinct(top).alias("tops"),
        F.count(top).alias("nested"),
        F.min(top).alias("top"),
        F.min(folder).alias("folder"),
    )
    base = F.substr(F.col("one.path"), F.lit(1), F.length("one.path") - F.length("one.member") - 1)
    is_zip = F.lower("archive").endswith(".zip")
    one_folder = (F.col("tops") == 1) & ((F.col("nested") == F.col("n")) | ~is_zip)
    root = (
        F.when(is_zip & (F.col("n") == 1), F.col("first"))
        .when(one_folder, F.concat_ws("/", base, "top"))
        .otherwise(base)
    )
    return grouped.select("archive", root.alias("root"))
