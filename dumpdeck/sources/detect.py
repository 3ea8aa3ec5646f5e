"""Which dump format the files and folders of a landing zone hold."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpdeck.sources.archive import list_files, open_uri

HEAD = 64 << 10
HEAD_LINES = 30

# File magic, and how header lines of each format begin (or what they contain).
SQLITE_MAGIC = b"SQLite format 3\x00"
MARKERS = [
    ("pg_dump", r"(?i)^-- PostgreSQL database dump"),
    ("pg_dump", r"^\\restrict"),
    ("pg_dump", r"^SET statement_timeout"),
    ("pg_dump", r"^SELECT pg_catalog\.set_config"),
    ("mysqldump", r"(?i)^-- MySQL dump"),
    ("mysqldump", r"(?i)^-- MariaDB dump"),
    ("mysqldump", r"/\*!40101 SET"),
    ("mysqldump", r"^-- Server version"),
]


def heads(files: DataFrame) -> DataFrame:
    """``(path, n_bytes, head)``: the first bytes of each file, decompressed.

    Each task opens its files and stops after the head, however long they are.
    """

    def read(batches):
        for pdf in batches:
            yield pdf.assign(head=[_head(p) for p in pdf["path"]])

    return files.select("path", "n_bytes").mapInPandas(read, "path string, n_bytes long, head binary")


# File endings and the codec of the text inside.
CODECS = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}


def _head(uri: str) -> bytes:
    codec = next((c for ending, c in CODECS.items() if uri.lower().endswith(ending)), None)
    with open_uri(uri) as stream:
        if codec is None:
            return stream.read(HEAD)
        try:
            return pa.CompressedInputStream(stream, codec).read(HEAD)
        except OSError:
            return b""


def classify(head: Column) -> Column:
    """Format of one file from its head: SQLite magic, else the first line with a marker."""
    text = F.make_valid_utf8(head.cast("string"))
    lines = F.transform(F.slice(F.split(text, r"\r?\n"), 1, HEAD_LINES), lambda x: F.ltrim(x))

    def line_format(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(MARKERS):
            out = F.when(line.rlike(pattern), name).otherwise(out)
        return out

    first = F.get(F.filter(F.transform(lines, line_format), lambda x: x.isNotNull()), F.lit(0))
    is_sqlite = F.substring(head, 1, len(SQLITE_MAGIC)) == F.lit(SQLITE_MAGIC)
    return F.when(is_sqlite, "sqlite").otherwise(F.coalesce(first, F.lit("unknown")))


def detect_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, format, crlf)`` for every file under a folder."""
    found = heads(list_files(spark, path))
    # Strings may hold line ends of the other kind; the first one of the file is not in a string.
    first = F.substring_index(F.make_valid_utf8(F.col("head").cast("string")), "\n", 1)
    crlf = F.coalesce(first.endswith("\r"), F.lit(False))
    return found.select("path", classify(F.col("head")).alias("format"), crlf.alias("crlf"))


def detect_folders(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, format)``: ``@.json`` means a shell dump; else a lone .sql file decides; else
    ``*.tsv.zst`` data files mean a shell dump."""
    files = list_files(spark, path).select(
        "path",
        "n_bytes",
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
    )
    lone = (
        files.filter(F.col("name").endswith(".sql"))
        .groupBy("folder")
        .agg(F.count("*").alias("n_sql"), F.min("path").alias("path"))
        .filter("n_sql = 1")
    )
    inspected = heads(lone.withColumn("n_bytes", F.lit(0).cast("long"))).select(
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"),
        classify(F.col("head")).alias("sql_format"),
    )
    summary = files.groupBy("folder").agg(
        F.bool_or(F.col("name").isin("@.json", "%40.json")).alias("has_meta"),
        F.bool_or(F.col("name").endswith(".tsv.zst")).alias("has_chunks"),
    )
    return summary.join(inspected, "folder", "left").select(
        "folder",
        F.when(F.col("has_meta"), "mysqlshell")
        .when(F.col("sql_format").isNotNull(), F.col("sql_format"))
        .when(F.col("has_chunks"), "mysqlshell")
        .otherwise("unknown")
        .alias("format"),
    )
