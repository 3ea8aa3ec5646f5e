"""Paging through large results: by default limit, by offset, by key, or all at once."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

PAGE = 500
PREVIEW = 100
# Pages that end within this many rows are taken from per-task top rows; others are located first.
HEAD = 2 * PAGE
# Rows that one task may take to sort the range that holds a page.
SHALLOW = 100_000
CUTS = 64
SAMPLE = 2_048


class FirstPage(NamedTuple):
    rows: DataFrame
    default_limit_applied: bool
    ordered: bool


def sql_scan(spark: SparkSession, sql: str) -> DataFrame:
    """All rows of a SQL text; a trailing ``;`` is fine, a blank text is not."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise ValueError("SQL text is empty")
    return spark.sql(text)


def _outer_nodes(spark: SparkSession, sql: str) -> list[str]:
    """Names of the outermost analyzed operators of a query, as EXPLAIN shows them."""
    text = sql.strip().rstrip(";")
    shown = spark.sql(f"EXPLAIN EXTENDED {text}").first()[0]
    section = shown.split("== Analyzed Logical Plan ==")[1].split("== Optimized Logical Plan ==")[0]
    lines = section.strip().splitlines()
    if any(line.startswith("WithCTE") for line in lines):
        # The query itself is the last child, below the definitions.
        lines = lines[next(i for i, line in enumerate(lines) if line.startswith("+- ")) :]
    names = []
    for line in lines:
        # A second branch ends the outer chain.
        if line.lstrip(" ").startswith(":"):
            break
        if found := re.match(r"\s*(?:\+- )?([A-Z]\w+)\b(?!:)", line):
            names.append(found[1])
    return names


def first_page(spark: SparkSession, sql: str, size: int = PAGE, default_limit: bool = True) -> FirstPage:
    """First page of a query: cut at ``size`` unless switched off or the query has its own limit.

    Warns when pages have no order.
    """
    rows = sql_scan(spark, sql)
    outer = []
    for node in _outer_nodes(spark, sql):
        if node not in ("GlobalLimit", "LocalLimit", "Offset", "Project", "Sort"):
            break
        outer.append(node)
    applied = default_limit and "GlobalLimit" not in outer
    ordered = "Sort" in outer
    if not ordered:
        warnings.warn("the query has no ORDER BY: its pages may overlap or miss rows", stacklevel=2)
    return FirstPage(rows.limit(size) if applied else rows, applied, ordered)


def preview(df: DataFrame, n: int = PREVIEW) -> DataFrame:
    return df.limit(n)


def _keys(df: DataFrame, keys: list[str], last: list) -> tuple[Column, Column]:
    """Keys of the rows and a key, as structs, in which nulls come first like in a sort."""
    types = [f.dataType for f in df.select(*keys).schema]
    there = [(F.lit(v) if v is not None else F.lit(None).cast(t)).alias(k) for k, v, t in zip(keys, last, types)]
    return F.struct(*keys), F.struct(*there)


def _after(df: DataFrame, keys: list[str], last: list, strict: bool = True) -> Column:
    """Rows after a key. The condition on the first key alone reaches the file statistics."""
    first, value = F.col(keys[0]), F.lit(last[0])
    if len(keys) == 1:
        if last[0] is None:
            return first.isNotNull() if strict else F.lit(True)
        return first > value if strict else first >= value
    here, there = _keys(df, keys, last)
    after = here > there if strict else here >= there
    return after if last[0] is None else (first >= value) & after


def _before(df: DataFrame, keys: list[str], last: list) -> Column:
    """Rows before a key; those whose first key is null come first of all."""
    first, value = F.col(keys[0]), F.lit(last[0])
    if len(keys) == 1:
        return F.lit(False) if last[0] is None else first.isNull() | (first < value)
    here, there = _keys(df, keys, last)
    return (first.isNull() if last[0] is None else first.isNull() | (first <= value)) & (here < there)


def keyset_page(df: DataFrame, keys: list[str], size: int = PAGE, after: list | None = None) -> DataFrame:
    """The ``size`` rows after a key, in key order. Keys must be unique together; nulls come first."""
    rows = df if after is None else df.filter(_after(df, keys, after))
    return rows.orderBy(*keys).limit(size)


class Page(NamedTuple):
    rows: list[Row]
    next_after: list | None


def fetch_page(df: DataFrame, keys: list[str], size: int = PAGE, after: list | None = None) -> Page:
    """One page in the client, with the key to go on from, or None at the end."""
    rows = keyset_page(df, keys, size + 1, after).collect()
    more = len(rows) > size
    rows = rows[:size]
    return Page(rows, [rows[-1][k] for k in keys] if more else None)


def fetch_offset_page(
    df: DataFrame, keys: list[str], offset: int = 0, size: int = PAGE
) -> tuple[list[Row], int | None]:
    """One page in the client, with the offset to go on from, or None at the end."""
    rows = offset_page(df, keys, offset, size + 1).collect()
    return rows[:size], offset + size if len(rows) > size else None


def iterate_pages(df: DataFrame, keys: list[str], size: int = PAGE) -> Iterator[list[Row]]:
    """All pages in order, one in memory at a time. To store them use ``number_pages``."""
    after = None
    while True:
        page = fetch_page(df, keys, size, after)
        if page.rows:
            yield page.rows
        after = page.next_after
        if after is None:
            return


def offset_page(
    df: DataFrame, keys: list[str], offset: int, size: int = PAGE, shallow: int = SHALLOW
) -> DataFrame:
    """Rows ``offset .. offset+size`` in key order.

    Unless the page ends within the first ``HEAD`` rows, it is narrowed down: split points from a sample of the
    keys of fixed size, exact counts between them, then only the range that holds the page, until that
    range has at most ``shallow`` rows, which one task sorts. Each round reads key columns only; the result doesn't
    depend on the split points. Where equal keys keep a range above that, a hash of the whole row
    goes on dividing them, and a page of equal rows alone is taken unsorted. What is left to sort is above
    ``shallow`` only if the page itself is, or if its border lies inside so many equal rows.
    """
    if offset + size <= min(HEAD, shallow):
        return df.orderBy(*keys).offset(offset).limit(size)
    rows, order, left = df, [*keys], df.select(*keys).count()
    if offset >= left:
        return df.limit(0)
    while left > shallow:
        narrowed = _narrow(rows, order, offset, size, left)
        if narrowed is not None:
            rows, offset, left = narrowed
            if offset is None:
                return rows.select(*df.columns).limit(size)
        elif len(order) == len(keys):
            rows, order = rows.withColumn(TIE, _row_hash(df)), [*keys, TIE]
        else:
            break
    return rows.orderBy(*order).offset(offset).limit(size).select(*df.columns)


TIE = "_page_tie"


def _row_hash(df: DataFrame) -> Column:
    """Of all columns but those whose type holds a map or a variant, which have no hash."""
    names = [f.name for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*["`" + n.replace("`", "``") + "`" for n in names])


def _narrow(
    df: DataFrame, keys: list[str], offset: int, size: int, total: int
) -> tuple[DataFrame, int | None, int] | None:
    """Fewer rows that hold the page, its offset in them (None: all are equal), and their number."""
    only = df.select(*keys)
    # Random numbers choose rows, so the sample has the same size at every scale and is merged from tasks' samples.
    sample = only.withColumn("_draw", F.rand(1)).orderBy("_draw").limit(SAMPLE).select(*keys)
    # Sorted by Spark, whose order the pages follow: Python cannot compare nulls.
    sample = sample.orderBy(*keys).collect()
    step = max(len(sample) // CUTS, 1)
    cuts = [tuple(r) for r in sample[step::step]]
    cuts = [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]
    if not cuts:
        return None
    # Cuts at or before each row, and before it: rows are grouped by both numbers in one pass.
    types = [f.dataType for f in only.schema]
    points = F.array(*[F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, c, types)]) for c in cuts])
    here = F.struct(*keys)
    groups = only.select(
        F.size(F.filter(points, lambda c: c <= here)).alias("reached"), F.size(F.filter(points, lambda c: c < here)).alias("passed")
    )
    counts = groups.groupBy("reached", "passed").count().collect()
    starts = [sum(r["count"] for r in counts if r.reached <= i) for i in range(len(cuts))]
    if keys[-1] == TIE:
        stops = [sum(r["count"] for r in counts if r.passed <= i) for i in range(len(cuts))]
        for cut, start, stop in zip(cuts, starts, stops):
            if start <= offset and offset + size <= stop:
                _, there = _keys(df, keys, list(cut))
                return df.filter(here.eqNullSafe(there)), None, stop - start
    low = max((i for i, s in enumerate(starts) if s <= offset), default=None)
    high = next((i for i, s in enumerate(starts) if s >= offset + size), None)
    if low is None and high is None:
        return None
    conditions = []
    if low is not None:
        conditions.append(_after(df, keys, list(cuts[low]), strict=False))
    if high is not None:
        conditions.append(_before(df, keys, list(cuts[high])))
    begin = starts[low] if low is not None else 0
    end = starts[high] if high is not None else total
    if end - begin == total:
        return None
    return df.filter(reduce(lambda a, b: a & b, conditions)), offset - begin, end - begin


def number_pages(df: DataFrame, keys: list[str], path: str, size: int = PAGE) -> DataFrame:
    """Write all pages: the rows in key order with ``row_no`` (from 0) and ``page_no``.

    The sorted rows are written once with their place inside their partition; partition sizes
    then give the offsets, one per partition.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    df.orderBy(*keys).withColumn("_place", place).write.mode("errorifexists").parquet(path)
    stored = spark.read.parquet(path)
    part = F.shiftright("_place", 33)
    # One row per written partition.
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    row_no = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("row_no", row_no)
        .withColumn("page_no", F.floor(row_no / size).cast("long"))
        .drop("_part", "_place", "_start")
    )
