"""Synthetic ``perf_items`` rows of any number, generated where they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Category by last digit of the id.
CATEGORIES = [
    "alpha", "bravo", "charlie", "delta", "echo",
    "foxtrot", "golf", "hotel", "india", "juliet",
]


def perf_items(spark: SparkSession, n: int) -> DataFrame:
    """``(id, created_at, category, score, payload)`` for ids 1..n."""
    names = F.array(*map(F.lit, CATEGORIES))
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    created = start + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))
    return spark.range(1, n + 1).select(
        "id",
        created.alias("created_at"),
        F.get(names, (F.col("id") % 10).cast("int")).alias("category"),
        (F.col("id") % 1000).cast("int").alias("score"),
        F.concat(F.lit("payload-"), F.col("id"), F.lit("-" + "x" * 64)).alias("payload"),
    )
