"""Insert, update and delete by key, each giving the new version of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows by column name; columns they lack are null."""
    return df.unionByName(rows, allowMissingColumns=True).select(*df.columns)


def update(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Set the changed columns of the rows whose key is in ``changes``, nulls included.

    Two changes for one key are an error, found before anything is built. The join takes both
    sides as they are, so AQE can broadcast a small set of changes or split a hot key.
    """
    _need(keys)
    values = [c for c in changes.columns if c not in keys]
    unknown = [c for c in changes.columns if c not in df.columns]
    if unknown:
        raise ValueError(f"columns not in the table: {unknown}")
    clash = changes.groupBy(*keys).count().filter("count > 1").select(*keys).limit(1).collect()
    if clash:
        raise ValueError(f"several changes for one key: {clash[0].asDict()}")
    new = changes.select(*keys, *[F.col(v).alias(f"_new_{v}") for v in values], F.lit(True).alias("_hit"))
    joined = df.join(new, keys, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in df.columns
        ]
    )


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``gone``."""
    _need(keys)
    return df.join(gone.select(*keys), keys, "left_anti").select(*df.columns)


def _need(keys: list[str]) -> None:
    if not keys:
        raise ValueError("rows are addressed by key: name at least one key column")
