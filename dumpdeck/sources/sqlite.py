"""SQLite files, read by tasks in slices of their key order.

``path`` is a file, a glob, a folder (searched for SQLite files) or a list of these, on a mount that all
executors share. Tables of one name in several files are one table: it has the columns of all of them, null where a
file lacks one. The driver lists names and opens no file. A first job plans slices in tasks, from row ids or
from keys sampled along the B-tree, and writes them; a second one reads a slice per task over its own
read-only connection.
"""

from __future__ import annotations

import glob
import os
import pickle
import sqlite3
import urllib.parse
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpdeck.functions.rows import DROPPED, DUMP, RAW, REASON
from dumpdeck.functions.types import Field, spark_type, sqlite_logical
from dumpdeck.session import posix_path, shared_folder
from dumpdeck.sources import ddl

#: Rows of a batch; slices up to which row ids of a file are cut evenly; tasks of one read.
BATCH, DENSE, MOST_TASKS = 2_000, 10_000, 100_000


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro", uri=True)


def free_row_id(db: sqlite3.Connection, table: str) -> str | None:
    """A name of the row id that no column of the table has, or None if all are taken."""
    taken = {r[1].lower() for r in db.execute(f"PRAGMA table_xinfo({quoted(table)})")}
    return next((n for n in ("rowid", "_rowid_", "oid") if n not in taken), None)


def files(path: str | list[str]) -> list[str]:
    found: set[str] = set()
    for one in [path] if isinstance(path, str) else path:
        for name in glob.glob(posix_path(one)):
            inside = [name] if os.path.isfile(name) else [os.path.join(d, f) for d, _, fs in os.walk(name) for f in fs]
            found.update(inside)
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def is_sqlite(file: str) -> bool:
    with open(file, "rb") as f:
        return f.read(16) == b"SQLite format 3\0"


def _each_file(spark: SparkSession, path: str | list[str], found: Callable, layout: str) -> DataFrame:
    """Rows of ``found(db, file)`` for every SQLite file, one file at a time in tasks."""
    names = [f.split()[0] for f in layout.split(", ")]
    listed = files(path)

    def run(batches):
        for pdf in batches:
            for file in pdf["file"]:
                if is_sqlite(file):
                    with connect(file) as db:
                        yield pd.DataFrame([(file, *r) for r in found(db, file)], columns=names, dtype=object)

    df = spark.createDataFrame([(f,) for f in listed], "file string")
    return df.repartition(max(1, min(len(listed), 1000))).mapInPandas(run, layout)


def slices(db: sqlite3.Connection, table: str, rows: int, most: int = DENSE) -> Iterator[tuple[str, bytes | None, bytes | None]]:
    """``(keys, after, upto)`` of the slices of a table; bounds are pickled tuples of key values.

    Row ids are cut evenly unless they are so sparse that most slices would be empty; then, and for tables
    without row ids, every ``rows``-th key is looked up from the one before.
    """
    name, row_id = quoted(table), free_row_id(db, table)
    try:
        if row_id is None:
            db.execute(f"SELECT rowid FROM {name} LIMIT 0")
            yield "", None, None  # the row id is out of reach: one slice
            return
        first, last = db.execute(f"SELECT min({row_id}), max({row_id}) FROM {name}").fetchone()
        keys = row_id
        if first is not None and (last - first) // rows < most:
            for at in range(first - 1, last, rows):
                yield keys, pickle.dumps((at,)), pickle.dumps((min(at + rows, last),))
            return
    except sqlite3.OperationalError:  # WITHOUT ROWID
        primary = sorted((r[5], r[1]) for r in db.execute(f"PRAGMA table_info({name})") if r[5])
        keys = ", ".join(quoted(k) for _, k in primary)
    after, marks = None, ", ".join("?" * len(keys.split(", ")))
    while True:
        where = f"WHERE ({keys}) > ({marks})" if after else ""
        found = db.execute(f"SELECT {keys} FROM {name} {where} ORDER BY {keys} LIMIT 1 OFFSET ?", (*(after or ()), rows - 1))
        upto = found.fetchone()
        yield keys, after and pickle.dumps(after), upto and pickle.dumps(upto)
        if upto is None:
            return
        after = upto


def read_slices(planned: DataFrame, table: str, names: list[str]) -> DataFrame:
    """``_file``, a text column per name, and ``_kinds``: the storage class of each value, one letter each.

    Values are text because SQLite columns are not strictly typed: n(ull) i(nteger) r(eal) t(ext) b(lob).
    """
    layout = T.StructType([T.StructField(n, T.StringType()) for n in ("_file", *names, "_kinds")])

    def read(batches):
        for batch in batches:
            for s in batch.to_pylist():
                with connect(s["file"]) as db:
                    own = {r[1].lower() for r in db.execute(f"PRAGMA table_info({quoted(table)})")}
                    there = [quoted(n) if n.lower() in own else "NULL" for n in names]
                    kinds = "||".join(f"substr(typeof({q}), 1, 1)" for q in there)
                    picks = ", ".join(
                        f"CASE typeof({q}) WHEN 'blob' THEN hex({q}) WHEN 'real' THEN printf('%!.17g', {q}) "
                        f"ELSE CAST({q} AS TEXT) END"
                        for q in there
                    )
                    where, bounds = [], []
                    for sign, bound in ((">", s["after"]), ("<=", s["upto"])):
                        if bound is not None:
                            values = pickle.loads(bound)
                            where.append(f"({s['keys']}) {sign} ({', '.join('?' * len(values))})")
                            bounds += values
                    sql = f"SELECT {picks}, {kinds} FROM {quoted(table)}" + (" WHERE " + " AND ".join(where) if where else "")
                    cursor = db.execute(sql, bounds)
                    while rows := cursor.fetchmany(BATCH):
                        columns = [pa.array(c, pa.string()) for c in zip(*rows)]
                        file = pa.array([s["file"]] * len(rows), pa.string())
                        yield pa.RecordBatch.from_arrays([file, *columns], ["_file", *names, "_kinds"])

    # One slice is one task: the number of them is counted where they were written.
    return planned.repartition(max(1, min(planned.count(), MOST_TASKS))).mapInArrow(read, layout)


def list_tables(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, table_name)`` of user tables, read by tasks, one file each."""
    sql = "SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'"
    return _each_file(spark, path, lambda db, file: db.execute(sql).fetchall(), "file string, table_name string")


def schema(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Columns and constraints of every file, in the shape of ``sources.ddl``."""
    layout = (
        "dump string, table_name string, pos int, column_name string, src_type string, "
        "not_null boolean, is_pk boolean"
    )
    rules = (
        "dump string, table_name string, kind string, name string, columns array<string>, "
        "ref_table string, ref_columns array<string>"
    )

    def describe_columns(batches):
        for pdf in batches:
            for file, table in zip(pdf["file"], pdf["table_name"]):
                with connect(file) as db:
                    rows = [
                        (file, table, r[0], r[1], r[2], bool(r[3]), bool(r[5]))
                        for r in db.execute(f"PRAGMA table_info({quoted(table)})")
                    ]
                names = ["dump", "table_name", "pos", "column_name", "src_type", "not_null", "is_pk"]
                yield pd.DataFrame(rows, columns=names)

    def describe_rules(batches):
        for pdf in batches:
            for file, table in zip(pdf["file"], pdf["table_name"]):
                with connect(file) as db:
                    yield pd.DataFrame(_rules(db, file, table), columns=[f.split()[0] for f in rules.split(", ")])

    tables = list_tables(spark, path)
    columns = tables.mapInPandas(describe_columns, layout)
    constraints = tables.mapInPandas(describe_rules, rules)
    alone = (
        constraints.filter((F.col("kind") == "unique") & (F.size("columns") == 1))
        .select("dump", "table_name", F.col("columns")[0].alias("column_name"), F.lit(True).alias("is_unique"))
        .distinct()
    )
    columns = columns.join(alone, ["dump", "table_name", "column_name"], "left").select(
        "dump",
        "table_name",
        "pos",
        "column_name",
        "src_type",
        sqlite_logical(F.col("src_type")).alias("type"),
        (F.col("not_null") | F.col("is_pk")).alias("not_null"),
        "is_pk",
        F.coalesce("is_unique", F.lit(False)).alias("is_unique"),
        F.lit(False).alias("auto_increment"),
    )
    return columns, constraints


def _rules(db: sqlite3.Connection, file: str, table: str) -> list[tuple]:
    out = []
    info = list(db.execute(f"PRAGMA table_info({quoted(table)})"))
    keys = [r[1] for r in sorted(info, key=lambda r: r[5]) if r[5]]
    if keys:
        out.append((file, table, "pk", "PRIMARY", keys, None, None))
    fks: dict[int, list] = {}
    for r in db.execute(f"PRAGMA foreign_key_list({quoted(table)})"):
        fks.setdefault(r[0], []).append(r)
    for number, rows in sorted(fks.items()):
        rows = [r for r in sorted(rows, key=lambda r: r[1])]
        targets = [r[4] for r in rows if r[4] is not None]
        out.append((file, table, "fk", f"fk{number}", [r[3] for r in rows], rows[0][2], targets))
    for r in db.execute(f"PRAGMA index_list({quoted(table)})").fetchall():
        if r[3] == "pk":
            continue
        # An expression has no column name.
        names = [c[2] or "" for c in db.execute(f"PRAGMA index_info({quoted(r[1])})")]
        out.append((file, table, "unique" if r[2] else "index", r[1], names, None, None))
    return out


class SqliteDump:
    dialect = "sqlite"

    def __init__(self, spark: SparkSession, path: str | list[str], rows_per_partition: int = 1_000_000):
        self.spark = spark
        self.path = path
        self.rows_per_partition = rows_per_partition
        self.columns, self.constraints = schema(spark, path)

    def close(self) -> None:
        pass

    @cached_property
    def fields(self) -> dict[str, list[Field]]:
        """Columns of all files per table: in the order of the first file that has them, as text where types differ."""
        place = F.struct("dump", "pos", "column_name", "src_type")
        merged = self.columns.groupBy("table_name", F.lower("column_name").alias("key")).agg(
            F.min(place).alias("first"), F.collect_set("type").alias("types")
        )
        one = F.when(F.size("types") == 1, F.col("types")[0]).otherwise("TEXT")
        entry = F.struct("first.dump", "first.pos", "first.column_name", one.alias("type"), "first.src_type")
        rows = merged.groupBy("table_name").agg(F.array_sort(F.collect_list(entry)).alias("fields")).collect()
        return {r.table_name: [Field(c.column_name, c.type, c.src_type) for c in r.fields] for r in rows}

    def _planned(self, table: str) -> DataFrame:
        """The slices of a table over all files, written by the tasks that planned them."""
        rows = self.rows_per_partition
        layout = "file string, keys string, after binary, upto binary"
        folder = shared_folder(self.spark, "sqlite-slices")

        def plan(db: sqlite3.Connection, file: str) -> list[tuple]:
            known = db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone()
            return list(slices(db, table, rows)) if known else []

        _each_file(self.spark, self.path, plan, layout).write.parquet(folder)
        return self.spark.read.schema(layout).parquet(folder)

    def tables(self) -> list[str]:
        return sorted(self.fields)

    def counts(self) -> DataFrame:
        """``(table_name, n)`` by counting in the files, one task per file."""
        def count(db: sqlite3.Connection, file: str) -> list[tuple]:
            names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'")]
            return [(n, db.execute(f"SELECT count(*) FROM {quoted(n)}").fetchone()[0]) for n in names]

        found = _each_file(self.spark, self.path, count, "file string, table_name string, n long")
        return found.groupBy("table_name").agg(F.sum("n").alias("n"))

    def rows(self, table: str, staged: str | None = None, rich: bool = False, **_) -> DataFrame:
        """Typed rows with bookkeeping columns (see ``functions.rows``)."""
        fields = self.fields.get(table)
        if not fields:
            raise ValueError(f"no table {table} in {self.path}")
        raw = read_slices(self._planned(table), table, [f.name for f in fields])
        values, misfits = [], []
        for i, f in enumerate(fields):
            text = F.col(quoted_column(f.name))
            kind = F.substring("_kinds", i + 1, 1)
            value = adapt(text, kind, f, spark_type(f, rich))
            values.append(value.alias(f.name))
            misfits.append(F.when(text.isNotNull() & value.isNull(), F.lit(f.name)))
        bad = F.concat_ws(",", *misfits)
        return raw.select(
            *values,
            F.col("_file").alias(DUMP),
            F.to_json(F.struct(*[F.col(quoted_column(f.name)) for f in fields])).alias(RAW),
            F.when(bad != "", F.concat(F.lit("does not fit: "), bad)).alias(REASON),
            F.lit(False).alias(DROPPED),
        )


def quoted_column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def adapt(text, kind, field: Field, target: T.DataType):
    """SQLite value (as text, with storage class) to the declared type; misfits give null."""
    if isinstance(target, T.BooleanType):
        return F.when(kind.isin("i", "r") & text.isin("1", "1.0"), True).when(
            kind.isin("i", "r") & text.isin("0", "0.0"), False
        )
    if isinstance(target, T.BinaryType):
        return F.when(kind == "b", F.unhex(text)).otherwise(F.encode(text, "UTF-8"))
    if isinstance(target, T.StringType):
        return F.when(kind == "b", F.make_valid_utf8(F.unhex(text).cast("string"))).otherwise(text)
    return F.when(kind != "b", text.try_cast(target))


def read_sqlite(spark: SparkSession, path: str | list[str], table: str, **options) -> DataFrame:
    rows = SqliteDump(spark, path, options.pop("rows_per_partition", 1_000_000)).rows(table, **options)
    return rows.drop(DUMP, RAW, REASON, DROPPED)
