"""Load whole dumps into tables, with a report and the rows that did not fit."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpdeck.functions.rows import DROPPED, REASON, accepted, rejects
from dumpdeck.functions.types import spark_type
from dumpdeck.operators.audit import declared_fk_problems, name_collisions
from dumpdeck.operators.layout import plan_layout, write_sorted
from dumpdeck.session import delete_folder, path_exists, shared_folder
from dumpdeck.sources.open import open_dump, skipped_indexes

REPORT = (
    "table_name string, target string, rows_read long, rows_loaded long, rows_rejected long, "
    "cells_rejected long, seconds double"
)
# A text dump with more tables than this is read once into a staging folder, not once per table. The
# rows are the same either way.
DIRECT_SCANS = 4


@dataclass
class LoadResult:
    """Targets by source table, the report and the rejects of one load."""

    spark: SparkSession
    targets: dict[str, str]
    report: DataFrame
    rejects: list[str]
    columns: DataFrame
    constraints: DataFrame
    unique_columns: DataFrame
    indexes: DataFrame
    skipped: DataFrame
    fk_problems: DataFrame
    warnings: list[str] = field(default_factory=list)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.targets[name])

    def totals(self) -> DataFrame:
        """The report with a last row (null name) of sums."""
        sums = [F.sum(c).alias(c) for c in ("rows_read", "rows_loaded", "rows_rejected", "cells_rejected")]
        return self.report.rollup("table_name").agg(*sums)


def normalise(name: str, identifier_case: str = "lower") -> str:
    if identifier_case == "lower":
        return name.lower()
    if identifier_case == "preserve":
        return name
    raise ValueError(f"unknown identifier case: {identifier_case}")


def check_names(columns: DataFrame, identifier_case: str = "lower") -> None:
    """Refuse dumps where two tables or columns would get one name."""
    clash = name_collisions(columns, identifier_case).limit(1).collect()
    if clash:
        c = clash[0]
        raise ValueError(f"{c.kind} name collision after normalization in {c.table_name}: {c.name}")


def load(
    spark: SparkSession,
    path: str,
    dest: str,
    *,
    fmt: str | None = None,
    mode: str = "errorifexists",
    identifier_case: str = "lower",
    tables: list[str] | None = None,
    sort_by_index: bool = False,
    parallel: int = 4,
    **options,
) -> LoadResult:
    """Write every declared table of a dump to ``dest/<name>`` as parquet.

    Table jobs are submitted together; each write commits or fails as a whole. ``sort_by_index``
    lays a table out by its first single-column index. ``options`` go to the typed reader
    (``rich``, ``unsigned``, ``decode_blobs``).
    """
    dump = open_dump(spark, path, fmt)
    try:
        return _load(spark, dump, dest, mode, identifier_case, tables, sort_by_index, parallel, options)
    finally:
        dump.close()


def _load(spark, dump, dest, mode, identifier_case, tables, sort_by_index, parallel, options) -> LoadResult:
    check_names(dump.columns, identifier_case)
    names = tables or dump.tables()
    base = dest.rstrip("/")
    targets = {n: f"{base}/{normalise(n, identifier_case)}" for n in names}
    reject_folders = {n: f"{base}/_load_rejects/{normalise(n, identifier_case)}" for n in names}
    if mode in ("error", "errorifexists"):
        # Before anything is written: a load into a used place leaves it as it is.
        taken = [n for n, target in targets.items() if path_exists(spark, target)]
        if taken:
            raise ValueError(f"{dest}: already exists: {', '.join(sorted(taken))}")
    if mode == "overwrite":
        for folder in reject_folders.values():
            delete_folder(spark, folder)
    staged = None
    try:
        if len(names) > DIRECT_SCANS and hasattr(dump, "stage"):
            staged = shared_folder(spark, "staged")
            dump.stage(staged)
        return _write(spark, dump, base, mode, identifier_case, targets, reject_folders, staged, sort_by_index, parallel, options)
    finally:
        if staged:
            delete_folder(spark, staged)


def _write(
    spark, dump, base, mode, identifier_case, targets, reject_folders, staged, sort_by_index, parallel, options
) -> LoadResult:
    names = list(targets)
    plan = plan_layout(dump.constraints)
    sort_columns = {}
    if sort_by_index:
        kept = plan.filter("kept AND kind = 'index'")
        first = kept.groupBy("table_name").agg(F.min_by("column_name", "name").alias("column_name"))
        sort_columns = {r.table_name: r.column_name for r in first.collect()}
    tallies = [
        F.count(F.lit(1)).alias("read"),
        F.count_if(F.col(DROPPED)).alias("dropped"),
        F.count_if(~F.col(DROPPED) & F.col(REASON).isNotNull()).alias("cells"),
    ]

    def one(name: str) -> tuple:
        started = time.monotonic()
        rows = dump.rows(name, staged=staged, **options)

        def good(df: DataFrame) -> DataFrame:
            kept = accepted(df)
            return kept.toDF(*[normalise(c, identifier_case) for c in kept.columns])

        if name in sort_columns:
            # Cutting ranges reads the rows once more, so a tally on the way would count them twice.
            n = rows.agg(*tallies).first()
            write_sorted(good(rows), targets[name], normalise(sort_columns[name], identifier_case), mode=mode)
        else:
            seen = Observation()
            good(rows.observe(seen, *tallies)).write.mode(mode).parquet(targets[name])
            n = seen.get
        # The second pass over the text is paid only where something was rejected.
        if n["dropped"] or n["cells"]:
            rejects(rows, name).write.mode(mode).parquet(reject_folders[name])
        taken = time.monotonic() - started
        return name, targets[name], n["read"], n["read"] - n["dropped"], n["dropped"], n["cells"], taken

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        report = list(pool.map(one, names))
    # The declared schema is kept with the tables; the dump is not read for it again.
    kept = {}
    for part in ("columns", "constraints"):
        where = f"{base}/_load_schema/{part}"
        getattr(dump, part).write.mode("overwrite").parquet(where)
        kept[part] = spark.read.parquet(where)
    plan = plan_layout(kept["constraints"])
    return LoadResult(
        spark=spark,
        targets=targets,
        report=spark.createDataFrame(report, REPORT),
        rejects=[reject_folders[r[0]] for r in report if r[4] or r[5]],
        columns=kept["columns"],
        constraints=kept["constraints"],
        unique_columns=kept["columns"].filter("is_unique").select("table_name", "column_name").distinct(),
        indexes=plan.filter("kept").select("table_name", "name", "column_name").distinct(),
        skipped=skipped_indexes(kept["constraints"]),
        fk_problems=declared_fk_problems(kept["columns"], kept["constraints"]),
        warnings=[
            f"{r[0]}: {r[4]} rows dropped, {r[5]} rows with unreadable values" for r in report if r[4] or r[5]
        ]
        + [
            f"{n}.{f.name}: {f.type} has no Spark type, kept as text"
            for n in names
            for f in dump.fields.get(n, [])
            if f.type.startswith("DECIMAL") and isinstance(spark_type(f), T.StringType)
        ],
    )


def load_rejects(spark: SparkSession, result: LoadResult) -> DataFrame:
    """``(dump, table_name, raw, reason, dropped)`` over all tables of this load."""
    layout = "dump string, table_name string, raw string, reason string, dropped boolean"
    if not result.rejects:
        return spark.createDataFrame([], layout)
    return spark.read.schema(layout).parquet(*result.rejects)
