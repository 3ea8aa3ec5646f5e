"""Render DataFrames as dumps, to test the readers against any table.

Values are rendered by column expressions; tasks only frame the lines of their partition and
write their own file, so a dump of any size is a folder of part files.
"""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpdeck.functions.escapes import copy_escape, mysql_escape, tsv_escape
from dumpdeck.session import ensure_folder, posix_path

SPARK_TYPES = (T.LongType, T.IntegerType, T.DoubleType, T.BooleanType)
PG_NAMES = dict(zip(SPARK_TYPES, ("bigint", "integer", "double precision", "boolean")))
MYSQL_NAMES = dict(zip(SPARK_TYPES, ("bigint(20)", "int(11)", "double", "tinyint(1)")))
SQLITE_NAMES = dict(zip(SPARK_TYPES, ("INTEGER", "INTEGER", "REAL", "BOOLEAN")))


def _text(field: T.StructField, true: str, false: str) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, T.BooleanType):
        return F.when(c, true).when(~c, false)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def copy_lines(df: DataFrame) -> DataFrame:
    parts = [copy_escape(_text(f, "t", "f")) for f in df.schema.fields]
    return df.select(F.array_join(F.array(*parts), "\t", "\\N").alias("value"))


def framed(lines: DataFrame, first: list[str], last: list[str]) -> DataFrame:
    """Put lines around the rows of each partition that has any."""

    def lines_batch(values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([values], ["value"])

    def frame(batches):
        started = False
        for batch in batches:
            if batch.num_rows:
                if not started:
                    started = True
                    yield lines_batch(pa.array(first, pa.string()))
                yield lines_batch(batch.column(0))
        if started and last:
            yield lines_batch(pa.array(last, pa.string()))

    return lines.mapInArrow(frame, "value string")


def write_pgdump(
    tables: dict[str, DataFrame], folder: str, ddl: list[str] | None = None, required: set[str] = frozenset()
) -> str:
    """A folder with one schema file and, per table, part files of one COPY block each."""
    spark = next(iter(tables.values())).sparkSession
    text = ["--", "-- PostgreSQL database dump", "--", "", "SET statement_timeout = 0;", ""]
    for name, df in tables.items():
        text += [f"CREATE TABLE public.{name} ("]
        body = [
            f'    "{f.name}" {PG_NAMES.get(type(f.dataType), "text")}' + (" NOT NULL" if f.name in required else "")
            for f in df.schema.fields
        ]
        text += [line + "," for line in body[:-1]] + [body[-1], ");", ""]
    # One file, as in a dump: a single small partition.
    whole = "\n".join(text + (ddl or []))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{folder}/schema")
    for name, df in tables.items():
        header = ", ".join(f'"{c}"' for c in df.columns)
        lines = framed(copy_lines(df), [f"COPY public.{name} ({header}) FROM stdin;"], ["\\.", ""])
        lines.write.text(f"{folder}/{name}")
    return f"{folder}/*/*.txt"


def insert_statements(df: DataFrame, name: str, rows: int = 500) -> DataFrame:
    """``INSERT`` statements of up to ``rows`` row groups each."""

    def literal(f: T.StructField) -> Column:
        text = _text(f, "1", "0")
        if not isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            text = F.concat(F.lit("'"), mysql_escape(text), F.lit("'"))
        return text

    row = F.array_join(F.array(*map(literal, df.schema.fields)), ",", "NULL")
    groups = df.select(F.concat(F.lit("("), row, F.lit(")")).alias("value"))

    def join(batches):
        for batch in batches:
            values = batch.column(0).to_pylist()
            chunks = [values[i : i + rows] for i in range(0, len(values), rows)]
            out = [f"INSERT INTO `{name}` VALUES " + ",".join(c) + ";" for c in chunks]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return groups.mapInArrow(join, "value string")


def mysql_create(name: str, df: DataFrame, extra: list[str] | None = None) -> str:
    items = [f"  `{f.name}` {MYSQL_NAMES.get(type(f.dataType), 'longtext')}" for f in df.schema.fields]
    return f"CREATE TABLE `{name}` (\n" + ",\n".join(items + (extra or [])) + "\n) ENGINE=InnoDB;"


def write_mysqldump(tables: dict[str, DataFrame], folder: str) -> str:
    spark = next(iter(tables.values())).sparkSession
    text = ["-- MySQL dump 10.13", "--", "-- Server version\t8.0.36", "", "/*!40101 SET NAMES utf8mb4 */;"]
    for name, df in tables.items():
        text += ["", f"DROP TABLE IF EXISTS `{name}`;", mysql_create(name, df)]
    spark.createDataFrame([("\n".join(text),)], "value string").coalesce(1).write.text(f"{folder}/schema")
    for name, df in tables.items():
        lines = framed(insert_statements(df, name), [f"LOCK TABLES `{name}` WRITE;"], ["UNLOCK TABLES;"])
        lines.write.text(f"{folder}/{name}")
    return f"{folder}/*/*.txt"


def _write_parts(df: DataFrame, write: Callable[[int, object], object]) -> int:
    """Run ``write(partition, batches)`` in every task; returns the number of rows written."""

    def run(batches):
        from pyspark import TaskContext

        n = write(TaskContext.get().partitionId(), batches)
        yield pd.DataFrame({"n": [n]})

    done = df.mapInPandas(run, "n long").agg(F.sum("n")).first()
    return done[0] or 0


def write_mysqlshell(schema: str, name: str, df: DataFrame, folder: str) -> str:
    """``@.json``, ``schema@name.json|sql`` and one compressed chunk per partition."""
    local = ensure_folder(folder)
    meta = {"options": {"columns": df.columns, "compression": "zstd"}, "extension": "tsv.zst", "chunking": True}
    small = {
        "@.json": json.dumps({"schemas": [schema]}),
        f"{schema}@{name}.json": json.dumps(meta),
        f"{schema}@{name}.sql": mysql_create(name, df),
    }
    for file, text in small.items():
        with open(os.path.join(local, file), "w") as out:
            out.write(text)
    parts = [tsv_escape(_text(f, "1", "0")) for f in df.schema.fields]
    lines = df.select(F.array_join(F.array(*parts), "\t", "\\N").alias("value"))

    def write(part, batches):
        target = f"{local}/{schema}@{name}@@{part}.tsv.zst"
        partial = f"{target}.{uuid.uuid4().hex}.partial"
        n = 0
        with fs.LocalFileSystem().open_output_stream(partial, compression="zstd") as out:
            for pdf in batches:
                n += len(pdf)
                out.write("".join(v + "\n" for v in pdf["value"]).encode())
        os.replace(partial, target)
        return n

    _write_parts(lines, write)
    return folder


def write_sqlite(
    name: str, df: DataFrame, folder: str, key: str | None = None, declared: dict[str, str] | None = None,
    rules: list[str] | None = None, options: str = "",
) -> str:
    """One database file per partition, each with the same table."""
    local = ensure_folder(folder)
    types = {f.name: SQLITE_NAMES.get(type(f.dataType), "TEXT") for f in df.schema.fields} | (declared or {})
    columns = ", ".join(f'"{n}" {t}' + (" PRIMARY KEY" if n == key else "") for n, t in types.items())
    columns = ", ".join([columns, *(rules or [])])
    marks = ", ".join("?" * len(df.columns))
    times = (T.TimestampType, T.TimestampNTZType)
    stored = df.select(
        *[
            _text(f, "1", "0").alias(f.name) if isinstance(f.dataType, times) else F.col(f.name)
            for f in df.schema.fields
        ]
    )

    def write(part, batches):
        target = f"{local}/{name}-{part}.sqlite"
        partial = f"{target}.{uuid.uuid4().hex}.partial"
        n = 0
        db = sqlite3.connect(partial)
        db.execute(f'CREATE TABLE "{name}" ({columns}) {options}')
        for pdf in batches:
            n += len(pdf)
            rows = pdf.astype(object).where(pdf.notna(), None).values.tolist()
            db.executemany(f'INSERT INTO "{name}" VALUES ({marks})', rows)
        db.commit()
        db.close()
        os.replace(partial, target)
        return n

    _write_parts(stored, write)
    return f"{folder}/*.sqlite"


def write_zips(df: DataFrame, folder: str, member: str) -> str:
    """One zip per partition holding one text member with the ``value`` lines."""
    local = ensure_folder(folder)

    def write(part, batches):
        target = f"{local}/part-{part}.zip"
        partial = f"{target}.{uuid.uuid4().hex}.partial"
        n = 0
        with zipfile.ZipFile(partial, "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w") as out:
            for pdf in batches:
                n += len(pdf)
                out.write("".join(v + "\n" for v in pdf["value"]).encode())
        os.replace(partial, target)
        return n

    _write_parts(df, write)
    return posix_path(folder)
