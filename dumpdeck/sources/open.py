"""Open a dump of any format, and count what is in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpdeck.session import shared_folder
from dumpdeck.sources.archive import ARCHIVES, list_files, unpack
from dumpdeck.sources.detect import detect_files
from dumpdeck.sources.mysqldump import MysqlDump
from dumpdeck.sources.mysqlshell import MysqlShellDump
from dumpdeck.sources.pgdump import PgDump
from dumpdeck.sources.sqlite import SqliteDump

READERS = {
    "pg_dump": PgDump,
    "mysqldump": MysqlDump,
    "mysqlshell": MysqlShellDump,
    "sqlite": SqliteDump,
}


def open_dump(spark: SparkSession, path: str | list[str], fmt: str | None = None):
    """Reader for ``path``: a file, a folder of one format, a shell dump folder, or archives of these.

    Archives are unpacked into the shared folder by tasks first, and all of them read as one dump.
    """
    if _archived(spark, path):
        path = unpacked(spark, path)
    fmt = fmt or probe(spark, path)
    if fmt not in READERS:
        raise ValueError(f"{path}: not a known dump format")
    if fmt == "mysqlshell" and not isinstance(path, str):
        path = _shell_folder(spark, path)
    return READERS[fmt](spark, path)


def _listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return reduce(DataFrame.unionAll, [list_files(spark, p) for p in ([path] if isinstance(path, str) else path)])


def _archived(spark: SparkSession, path: str | list[str]) -> bool:
    return not _listed(spark, path).filter(F.col("path").rlike(ARCHIVES)).limit(1).isEmpty()


def unpacked(spark: SparkSession, path: str) -> list[str]:
    """Patterns that hold the members of all archives under ``path``: one for each depth of folders."""
    folder = shared_folder(spark, "unpacked")
    members = unpack(spark, path, folder)
    depths = members.select(F.size(F.split("member", "/")).alias("n")).distinct().orderBy("n").collect()
    # Each archive has a folder of its own, named with a hash.
    return [f"{folder}/*-????????" + "/*" * r.n for r in depths]


def _shell_folder(spark: SparkSession, path: list[str]) -> str:
    """The folder of the shell dump in an archive; a shell dump is one folder."""
    marks = _listed(spark, path).filter(F.col("path").rlike(r"/(@|%40)\.json$")).select("path").limit(2).collect()
    if len(marks) != 1:
        raise ValueError(f"{path}: one MySQL Shell dump at a time, found {len(marks)}")
    return marks[0].path.rsplit("/", 1)[0]


def probe(spark: SparkSession, path: str | list[str]) -> str:
    """Format of the dump at ``path``."""
    shell = r"(^|/)(@|%40)\.json$|\.tsv\.zst$"
    if _listed(spark, path).filter(F.col("path").rlike(shell)).limit(1).count():
        return "mysqlshell"
    # At most one row per known format. Parts of a split dump may lack the opening comments.
    found = [detect_files(spark, p).select("format") for p in ([path] if isinstance(path, str) else path)]
    seen = [r.format for r in reduce(DataFrame.unionAll, found).distinct().collect()]
    known = sorted(f for f in seen if f != "unknown")
    if len(known) > 1:
        raise ValueError(f"{path}: holds dumps of different formats: {known}")
    return known[0] if known else "unknown"


def inventory(dump) -> DataFrame:
    """``(table_name, n)`` with the total in the row whose name is null; nothing is loaded."""
    return dump.counts().rollup("table_name").agg(F.sum("n").alias("n"))


def skipped_indexes(constraints: DataFrame) -> DataFrame:
    """``(table_name, name, reason)`` of indexes that a single column cannot carry."""
    columns = F.col("columns")
    expression = F.exists(columns, lambda c: (c == "") | F.contains(c, F.lit("(")))
    reason = F.when(expression, "expression index").when(
        F.size(columns) > 1,
        F.when(F.col("kind") == "unique", "composite unique key").otherwise("composite index"),
    )
    found = constraints.filter(F.col("kind").isin("unique", "index")).withColumn("reason", reason)
    return found.filter("reason IS NOT NULL").select("table_name", "name", "reason").distinct()
