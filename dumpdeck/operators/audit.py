"""Declared constraints as audits that return what violates them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _unpivot(df: DataFrame, names: list[str], measures: list[str]) -> DataFrame:
    """``measure_i`` columns of one summary row -> ``(column_name, measure...)`` rows."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("column_name"), *[F.col(f"{m}_{i}").alias(m) for m in measures])
            for i, n in enumerate(names)
        ]
    )
    return df.select(F.inline(rows))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, nulls)`` of every column in one pass."""
    names = columns or df.columns
    counts = [F.count_if(F.col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(names)]
    return _unpivot(df.agg(*counts), names, ["nulls"])


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    return null_counts(df, columns).filter("nulls > 0")


def duplicate_keys(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Key values held by more than one row, with their count. Null counts as a value."""
    return df.groupBy(*keys).agg(F.count("*").alias(name)).filter(F.col(name) > 1)


def primary_key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicate keys and keys with a null part."""
    broken = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | broken)


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicate values, leaving out rows where a part is null."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return duplicate_keys(df.filter(present), keys)


def orphan_keys(
    child: DataFrame, fk: list[str], parent: DataFrame, key: list[str] | None = None
) -> DataFrame:
    """Foreign key values without a parent, with the number of child rows.

    Children are counted per value before the join, so a value that fills a third of the table
    travels as one row per task.
    """
    key = key or fk
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fk])
    counted = child.filter(present).groupBy(*fk).agg(F.count("*").alias("n"))
    return counted.join(_parent_keys(parent, fk, key), fk, "left_anti")


def orphans(child: DataFrame, fk: list[str], parent: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Child rows without a parent."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fk])
    keys = _parent_keys(parent, fk, key or fk)
    return child.filter(present).join(keys, fk, "left_anti").select(*child.columns)


def _parent_keys(parent: DataFrame, fk: list[str], key: list[str]) -> DataFrame:
    return parent.select(*[F.col(k).alias(f) for k, f in zip(key, fk)])


def _comparable(name: str, own: T.DataType, other: T.DataType) -> Column:
    """A key column in the type that both sides of a foreign key are compared in."""
    c = F.col(f"`{name}`")
    if isinstance(own, T.IntegralType) and isinstance(other, T.IntegralType):
        return c.cast("long")
    if isinstance(own, T.NumericType) and isinstance(other, T.NumericType) and own != other:
        return c.cast("double") + 0.0
    if isinstance(own, T.FractionalType) and not isinstance(own, T.DecimalType):
        return c + 0.0  # one zero
    return c if own == other else c.cast("string")


def _entry(rule: int, kind: str, keys: list[Column], present: bool, parent: bool = False) -> Column:
    """What one row says to one rule, or null: the key's 128-bit hash, with the places of its nulls."""
    nulls = reduce(lambda a, b: a | b, [k.isNull() for k in keys])
    marks = F.concat(*[F.when(k.isNull(), "1").otherwise("0") for k in keys])
    said = F.struct(
        F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.xxhash64(marks, *keys).alias("h1"),
        F.xxhash64(F.lit(rule), *reversed(keys), marks).alias("h2"), nulls.alias("nulls"), F.lit(parent).alias("parent"),
    )
    return F.when(~nulls, said) if present else said


def check_declared(tables: dict[str, DataFrame], columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """``(table_name, kind, columns, violations)`` of every declared rule on loaded tables.

    Each table is scanned once: a row gives one entry per rule that concerns it, as child, as parent, or for
    its own key. Entries of all rules and tables are counted per (rule, key hash) in one shuffle, after
    partial counts in each task, so a value that fills a third of a table is one row per task; no table is joined. The
    rules themselves are metadata. ``tables`` is keyed by declared name.
    """
    spark = columns.sparkSession
    known = {name.lower(): df for name, df in tables.items()}
    rules: list[tuple[str, str, str]] = []
    entries: dict[str, list[Column]] = {}

    def add(table: str, kind: str, names: list[str]) -> int:
        rules.append((table, kind, ",".join(names)))
        return len(rules) - 1

    def types(table: str) -> dict[str, T.DataType]:
        return {f.name.lower(): f.dataType for f in known[table].schema}

    for r in columns.filter("not_null").select("table_name", "column_name").distinct().collect():
        table = r.table_name.lower()
        if table in known:
            rule, c = add(r.table_name, "not_null", [r.column_name]), F.col(f"`{r.column_name}`")
            said = _entry(rule, "not_null", [F.when(c.isNull(), F.lit(0))], False)
            entries.setdefault(table, []).append(F.when(c.isNull(), said))
    declared = constraints.filter("kind <> 'index'").drop("dump").distinct().collect()
    primary = {r.table_name.lower(): r.columns for r in declared if r.kind == "pk"}
    for r in declared:
        table = r.table_name.lower()
        if table not in known or "" in r.columns:
            continue
        own = types(table)
        if r.kind != "fk":
            keys = [_comparable(c, own[c.lower()], own[c.lower()]) for c in r.columns]
            said = _entry(add(r.table_name, r.kind, r.columns), r.kind, keys, r.kind == "unique")
            entries.setdefault(table, []).append(said)
            continue
        parent = r.ref_table.lower()
        # A foreign key that names no columns means the parent's primary key.
        key = r.ref_columns or primary.get(parent, [])
        if parent not in known or len(key) != len(r.columns):
            continue
        theirs = types(parent)
        pairs = [(c, own[c.lower()], k, theirs[k.lower()]) for c, k in zip(r.columns, key)]
        rule = add(r.table_name, "fk", r.columns)
        child = [_comparable(c, a, b) for c, a, _, b in pairs]
        entries.setdefault(table, []).append(_entry(rule, "fk", child, True))
        held = [_comparable(k, b, a) for _, a, k, b in pairs]
        entries.setdefault(parent, []).append(_entry(rule, "fk", held, True, parent=True))

    layout = "rule int, table_name string, kind string, columns string"
    listed = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], layout)
    if not entries:
        return listed.select("table_name", "kind", "columns", F.lit(0).cast("long").alias("violations"))
    said = [
        known[t].select(F.explode(F.filter(F.array(*found), lambda e: e.isNotNull())).alias("e")).select("e.*")
        for t, found in entries.items()
    ]
    counted = reduce(DataFrame.unionByName, said).groupBy("rule", "kind", "h1", "h2").agg(
        F.count_if(~F.col("parent")).alias("n"), F.bool_or("parent").alias("parent"), F.bool_or("nulls").alias("nulls")
    )
    bad = (
        F.when(F.col("kind") == "not_null", F.col("n"))
        .when(F.col("kind") == "fk", F.when(F.col("parent"), 0).otherwise(F.col("n")))
        .when((F.col("n") > 1) | ((F.col("kind") == "pk") & F.col("nulls")), 1)
        .otherwise(0)
    )
    found = counted.groupBy("rule").agg(F.sum(bad).alias("violations"))
    return listed.join(found, "rule", "left").select(
        "table_name", "kind", "columns", F.coalesce("violations", F.lit(0)).alias("violations")
    )


def declared_fk_problems(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """``(dump, table_name, problem, detail)``: foreign keys to a table the dump lacks, and
    columns with several targets."""
    tables = columns.select("dump", F.lower("table_name").alias("ref_key")).distinct()
    fks = constraints.filter("kind = 'fk'").withColumn("ref_key", F.lower("ref_table"))
    missing = fks.join(tables, ["dump", "ref_key"], "left_anti").select(
        "dump",
        "table_name",
        F.lit("missing table").alias("problem"),
        F.concat(F.concat_ws(",", "columns"), F.lit(" -> "), F.col("ref_table")).alias("detail"),
    )
    several = (
        fks.filter(F.size("columns") == 1)
        .groupBy("dump", "table_name", F.col("columns")[0].alias("detail"))
        .count()
        .filter("count > 1")
        .select("dump", "table_name", F.lit("several targets").alias("problem"), "detail")
    )
    return missing.unionByName(several)


def name_collisions(columns: DataFrame, identifier_case: str = "lower") -> DataFrame:
    """``(dump, table_name, kind, name, n)``: tables or columns that normalise to one name."""
    if identifier_case not in ("lower", "preserve"):
        raise ValueError(f"unknown identifier case: {identifier_case}")

    def norm(c: str):
        return F.lower(c) if identifier_case == "lower" else F.col(c)

    tables = (
        columns.groupBy("dump", norm("table_name").alias("name"))
        .agg(F.count_distinct("table_name").alias("n"))
        .select("dump", F.col("name").alias("table_name"), F.lit("table").alias("kind"), "name", "n")
    )
    cols = (
        columns.groupBy("dump", "table_name", norm("column_name").alias("name"))
        .agg(F.count_distinct("column_name", "pos").alias("n"))
        .select("dump", "table_name", F.lit("column").alias("kind"), "name", "n")
    )
    return tables.unionByName(cols).filter("n > 1")


def profile(df: DataFrame, declared: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """``(column_name, data_type, rows, nulls, distincts, max_length)``, with the declared flags
    of ``declared(column_name, type, not_null, is_pk)`` next to them if given.

    Distinct counts are sketches unless ``exact``; exact ones cost a shuffle per column.
    """
    names = df.columns
    count = F.count_distinct if exact else F.approx_count_distinct
    aggs = []
    for i, c in enumerate(names):
        aggs += [
            F.count("*").alias(f"rows_{i}"),
            F.count_if(F.col(c).isNull()).alias(f"nulls_{i}"),
            count(F.col(c)).alias(f"distincts_{i}"),
            F.max(F.length(F.col(c).cast("string"))).alias(f"max_length_{i}"),
        ]
    out = _unpivot(df.agg(*aggs), names, ["rows", "nulls", "distincts", "max_length"])
    types = F.create_map(*[x for n, t in df.dtypes for x in (F.lit(n), F.lit(t))])
    out = out.withColumn("data_type", types[F.col("column_name")])
    if declared is not None:
        out = out.join(declared.select("column_name", "type", "not_null", "is_pk"), "column_name", "left")
    return out
