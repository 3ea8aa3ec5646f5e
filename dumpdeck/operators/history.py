"""Query history and recent lists over a log table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dumpdeck.session import delete_folder, folder_names, path_exists

SALTS = 64


def search(history: DataFrame, database: str, term: str | None = None) -> DataFrame:
    """Runs on one database whose text contains the term, newest first; case does not matter."""
    found = history.filter(F.lower("database_path") == database.lower())
    return containing(found, term).orderBy(F.desc("executed_at"))


def containing(history: DataFrame, term: str | None) -> DataFrame:
    """Runs whose text contains a term, in any case; all of them for a blank term."""
    if term and term.strip():
        return history.filter(F.contains(F.lower("sql"), F.lit(term.lower())))
    return history


def retain(history: DataFrame, keep: int = 200, tie: str | None = None) -> DataFrame:
    """Latest run of each (database, SQL text), and of those the newest ``keep`` per database.

    ``tie`` names a column that orders runs of the same instant. One database may hold a third
    of the log, so rows are ranked inside salted groups first and only their winners meet.
    """
    newest = [F.desc("executed_at")] + ([F.desc(tie)] if tie else [])
    stamp = F.struct("executed_at", *([tie] if tie else []))
    kept = [c for c in ("database_path", "sql", "executed_at", tie) if c]
    written = history.filter((F.trim("database_path") != "") & (F.trim("sql") != ""))
    latest = (
        written.withColumns({"sql": F.trim("sql"), "db_key": F.lower("database_path")})
        .groupBy("db_key", "sql")
        .agg(
            F.max(stamp).alias("stamp"),
            F.max_by("database_path", stamp).alias("database_path"),
        )
        .select("db_key", "database_path", "sql", "stamp.*")
        .withColumn("salt", F.pmod(F.xxhash64("sql"), F.lit(SALTS)))
    )
    rank = F.row_number()
    near = latest.withColumn("r", rank.over(Window.partitionBy("db_key", "salt").orderBy(*newest)))
    top = near.filter(F.col("r") <= keep).withColumn(
        "rank", rank.over(Window.partitionBy("db_key").orderBy(*newest))
    )
    return top.filter(F.col("rank") <= keep).select(*kept, "rank")


class Retained:
    """The result of ``retain`` kept up to date batch by batch, in a folder with one version per batch.

    Whatever falls out of the newest ``keep`` can only return by running again, so the kept rows and a new
    batch give what all batches at once would. State is bounded by ``keep`` rows per database, and batches
    may come late or in any order. A batch written again under its number replaces its version, so it suits
    ``foreachBatch``: ``stream.writeStream.foreachBatch(retained.update)``.
    """

    def __init__(self, path: str, keep: int = 200, tie: str | None = None):
        self.path, self.keep, self.tie = path.rstrip("/"), keep, tie

    def _version(self, number: int) -> str:
        return f"{self.path}/{number:012d}"

    def update(self, batch: DataFrame, number: int) -> None:
        """Merge batch ``number`` with the newest version before it."""
        spark = batch.sparkSession
        columns = [c for c in ("database_path", "sql", "executed_at", self.tie) if c]
        rows = batch.select(*columns)
        before = [n for n in self._numbers(spark) if n < number]
        if before:
            rows = rows.unionByName(spark.read.parquet(self._version(before[-1])).select(*columns))
        retain(rows, self.keep, self.tie).write.mode("overwrite").parquet(self._version(number))

    def rows(self, spark: SparkSession) -> DataFrame:
        """The newest version."""
        numbers = self._numbers(spark)
        if not numbers:
            raise ValueError(f"no batch in {self.path}")
        return spark.read.parquet(self._version(numbers[-1]))

    def drop_versions(self, spark: SparkSession, last: int = 2) -> None:
        """Delete all versions but the ``last`` ones."""
        for number in self._numbers(spark)[:-last]:
            delete_folder(spark, self._version(number))

    def _numbers(self, spark: SparkSession) -> list[int]:
        """Finished versions; a version whose write broke off has no marker."""
        names = [n for n in folder_names(spark, self.path) if n.isdigit()]
        return sorted(int(n) for n in names if path_exists(spark, f"{self.path}/{n}/_SUCCESS"))


def recent(log: DataFrame, keep: int = 10) -> DataFrame:
    """Most recently used paths: one entry per path without case, newest first."""
    return (
        log.groupBy(F.lower("path").alias("key"))
        .agg(F.max_by("path", "used_at").alias("path"), F.max("used_at").alias("used_at"))
        .orderBy(F.desc("used_at"), "key")
        .limit(keep)
        .select("path", "used_at")
    )


def prefix_top(catalog: DataFrame, prefix: str, keep: int = 100) -> DataFrame:
    """Names that start with a prefix (any case), by priority, then name."""
    return starts_with(catalog, prefix).orderBy(F.desc("priority"), "name").limit(keep)


def starts_with(catalog: DataFrame, prefix: str) -> DataFrame:
    return catalog.filter(F.lower("name").startswith(prefix.lower()))


# Rank of each kind of catalog entry.
PRIORITIES = {"primary key": 200, "column": 100, "table": 100, "keyword": 90}


def with_priority(entries: DataFrame) -> DataFrame:
    """Add ``priority`` to ``entries(name, kind)``."""
    out = F.lit(0)
    for kind, value in PRIORITIES.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return entries.withColumn("priority", out)
