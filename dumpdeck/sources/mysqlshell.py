"""MySQL Shell dump folders: ``@.json``, ``schema@table.json|sql`` and data chunks.

The dump tool cuts tables into chunks of bounded size; each chunk is one task.
"""

from __future__ import annotations

import json
import re
import urllib.parse
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpdeck.functions.escapes import split_fields, tsv_unescape
from dumpdeck.functions.rows import accepted, typed_rows
from dumpdeck.functions.types import Field
from dumpdeck.sources import ddl

LEADING = r"\A(?:\s++|--[^\n]*+(?:\n|\z)|/\*(?s:.*?)\*/;?)++"


@dataclass(frozen=True)
class TableMeta:
    """What ``schema@table.json`` says about the data files."""

    columns: tuple[str, ...] = ()
    separator: str = "\t"
    escaped_by: str = "\\"
    extension: str = "tsv.zst"
    primary_index: str | None = None


def _file_name() -> Column:
    """Name of a file as it is in its folder; schema and table names in it are still percent-encoded."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _plain(name: Column) -> Column:
    """A schema or table name out of a file name."""
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def _owner(extension: Column) -> tuple[Column, Column]:
    """Schema and table of a data file: ``schema@table.extension`` or ``schema@table@@number.extension``."""
    parts = F.split(_file_name(), "@")
    table = F.get(parts, F.lit(1))
    bare = F.when(F.size(parts) > 2, table).otherwise(F.regexp_replace(table, extension, F.lit("")))
    return _plain(F.get(parts, F.lit(0))), _plain(bare)


def _texts(spark: SparkSession, folder: str, glob: str) -> dict[str, str]:
    """Small metadata files by file name."""
    found = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select(_file_name().alias("name"), "value")
    return {r.name: r.value for r in found.collect()}


class MysqlShellDump:
    dialect = "mysql"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        metas = _texts(spark, self.folder, "*.json")
        if "@.json" not in metas:
            raise FileNotFoundError(f"{folder}: MySQL Shell dump metadata file @.json not found")
        self.schemas = json.loads(metas["@.json"]).get("schemas", [])
        self._metas = {
            tuple(map(urllib.parse.unquote, name[: -len(".json")].split("@", 1))): _parse_meta(text)
            for name, text in metas.items()
            if not name.startswith("@") and name.count("@") == 1
        }
        statements = (
            spark.read.option("pathGlobFilter", "*.sql")
            .text(self.folder, wholetext=True)
            .select(
                _file_name().alias("dump"),
                F.explode(F.split("value", r";\s*(?:\n|\z)")).alias("statement"),
            )
            .withColumn("statement", F.regexp_replace("statement", LEADING, ""))
            # Only schema@table.sql declares a table.
            .filter(F.col("dump").rlike(r"^[^@]+@[^@]+\.sql$"))
        )
        self._statements = statements
        self._declared = self._qualified(ddl.mysql_columns(statements))

    @cached_property
    def columns(self) -> DataFrame:
        return self._qualified(ddl.mysql_schema(self._statements)[0])

    @cached_property
    def constraints(self) -> DataFrame:
        return self._qualified(ddl.mysql_constraints(self._statements))

    @staticmethod
    def _qualified(df: DataFrame) -> DataFrame:
        """Table names as ``schema.table``: two schemas may hold the same table name."""
        schema = _plain(F.substring_index("dump", "@", 1))
        return df.withColumn("table_name", F.concat_ws(".", schema, "table_name"))

    def close(self) -> None:
        pass

    @cached_property
    def fields(self) -> dict[str, list[Field]]:
        return ddl.all_fields(self._declared)

    def tables(self) -> list[str]:
        return sorted(self.fields)

    def meta(self, table: str) -> TableMeta:
        schema, name = self._split(table)
        return self._metas.get((schema, name), TableMeta())

    def _split(self, table: str) -> tuple[str, str]:
        if "." in table:
            schema, name = table.split(".", 1)
            return schema, name
        owners = [s for s in self.schemas if (s, table) in self._metas]
        if len(owners) > 1:
            raise ValueError(f"table {table} is in schemas {owners}: name it schema.table")
        return (owners or self.schemas or [""])[0], table

    def chunk_lines(self, table: str) -> DataFrame:
        """``(dump, chunk, value)``, blank lines skipped; chunk files without number come last."""
        schema, name = self._split(table)
        extension = self.meta(table).extension
        # Chunked tables number their files; others have one.
        owner, stored = _owner(F.lit(rf"\.{re.escape(extension)}$"))
        number = F.regexp_extract("_metadata.file_name", r"@@?(\d+)\.", 1)
        return (
            self.spark.read.option("pathGlobFilter", f"*@*.{extension}")
            .schema("value string")
            .text(self.folder)
            .filter((owner == schema) & (stored == name))
            .select(
                F.col("_metadata.file_path").alias("dump"),
                F.coalesce(number.try_cast("long"), F.lit(2**63 - 1)).alias("chunk"),
                "value",
            )
            .filter(F.trim("value") != "")
        )

    def counts(self) -> DataFrame:
        """``(table_name, n)`` over all chunk files in one scan, 0 where there are none."""
        declared = self._declared.select("table_name").distinct()
        owner, stored = _owner(F.lit(r"\.tsv(\.\w+)?$"))
        counted = (
            self.spark.read.option("pathGlobFilter", "*@*.tsv{.zst,.gz,}")
            .schema("value string")
            .text(self.folder)
            .filter(F.trim("value") != "")
            .groupBy(F.concat_ws(".", owner, stored).alias("table_name"))
            .count()
        )
        return declared.join(counted, "table_name", "left").select(
            "table_name", F.coalesce("count", F.lit(0)).alias("n")
        )

    def rows(self, table: str, staged: str | None = None, **options) -> DataFrame:
        """Typed rows; fields follow the metadata's column list, or the declared order where it has none."""
        schema, name = self._split(table)
        declared = self.fields.get(f"{schema}.{name}")
        if not declared:
            raise ValueError(f"table {table} is not declared in the dump")
        meta = self.meta(table)
        # Column names of MySQL have no case.
        by_name = {f.name.casefold(): f for f in declared}
        if unknown := [c for c in meta.columns if c.casefold() not in by_name]:
            raise ValueError(f"table {table}: the metadata lists columns {unknown} that are not declared")
        fields = [by_name[c.casefold()] for c in meta.columns] or declared
        lines = self.chunk_lines(table)
        records = lines.select(
            "dump", F.col("value").alias("raw"), split_fields(F.col("value"), meta.separator).alias("tokens")
        )

        def text(token: Column, escaped: bool) -> Column:
            return F.when(token != "\\N", tsv_unescape(token, meta.escaped_by) if escaped else token)

        return typed_rows(records, fields, "mysql", text, pad=True, **options)


def _parse_meta(text: str) -> TableMeta:
    root = json.loads(text)
    options = root.get("options", {})
    default = TableMeta()
    return TableMeta(
        columns=tuple(options.get("columns", ())),
        separator=options.get("fieldsTerminatedBy", default.separator),
        escaped_by=options.get("fieldsEscapedBy", default.escaped_by),
        extension=root.get("extension", default.extension),
        primary_index=options.get("primaryIndex"),
    )


def read_mysqlshell(spark: SparkSession, folder: str, table: str, **options) -> DataFrame:
    """Rows of one table (``schema.table``, or a bare name that only one schema has)."""
    return accepted(MysqlShellDump(spark, folder).rows(table, **options))
