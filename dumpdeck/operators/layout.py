"""Physical layout of written tables, chosen from declared indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_layout(constraints: DataFrame) -> DataFrame:
    """``(dump, table_name, kind, name, column_name, kept, reason)`` of declared indexes.

    Single-column indexes are kept as sort columns; composite and expression ones are not.
    """
    expression = F.exists("columns", lambda c: (c == "") | F.contains(c, F.lit("(")))
    unique = F.col("kind") == "unique"
    reason = F.when(expression, "expression index").when(
        F.size("columns") > 1, F.when(unique, "composite unique key").otherwise("composite index")
    )
    return constraints.filter(F.col("kind").isin("index", "unique")).select(
        "dump",
        "table_name",
        "kind",
        "name",
        F.when(reason.isNull(), F.col("columns")[0]).alias("column_name"),
        reason.isNull().alias("kept"),
        reason.alias("reason"),
    )


def write_sorted(
    df: DataFrame, path: str, column: str, partitions: int | None = None, mode: str = "errorifexists"
) -> None:
    """Parquet files that cover narrow ranges of ``column``, so scans skip by min / max.

    A value may fill a third of the table: ranges are cut on (column, row hash), which spreads
    one value over several files and keeps them sorted by it.
    """
    spread = df.withColumn("_spread", F.xxhash64(*df.columns))
    keys = [F.col(column), F.col("_spread")]
    ranged = spread.repartitionByRange(partitions, *keys) if partitions else spread.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).drop("_spread").write.mode(mode).parquet(path)
