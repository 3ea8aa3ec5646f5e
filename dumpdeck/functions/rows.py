"""From split dump records to typed rows, keeping what does not fit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpdeck.functions.types import Field, spark_type, typed

DUMP, RAW, REASON, DROPPED = "_dump", "_raw", "_reason", "_dropped"


def part_key(*names: Column) -> Column:
    """Folder name for staged rows of a table: short whatever the names are, and always text."""
    return F.concat(F.lit("k"), F.substring(F.sha2(F.to_json(F.array(*names)), 256), 1, 40))


def _bare(target: T.DataType) -> bool:
    return isinstance(target, (T.NumericType, T.BooleanType))


def typed_rows(
    records: DataFrame,
    fields: list[Field],
    dialect: str,
    to_text: Callable[[Column, bool], Column],
    *,
    pad: bool = False,
    rich: bool = False,
    unsigned: bool = False,
    decode_blobs: bool = True,
) -> DataFrame:
    """``records(dump, raw, tokens[, broken])`` -> one column per field plus bookkeeping columns.

    ``to_text(token, escaped)`` gives the text of a token or null; ``escaped`` is false for
    numbers and booleans, whose texts hold no escapes.

    A record with the wrong number of tokens is dropped (``pad`` reads missing ones as null
    instead). A value that does not fit its type becomes null and the row is reported.
    """
    names = [f.name for f in fields]
    broken = F.col("broken") if "broken" in records.columns else F.lit(False)
    short = F.lit(False) if pad else F.size("tokens") != len(fields)
    targets = [spark_type(f, rich, unsigned) for f in fields]
    texts = [to_text(F.get("tokens", F.lit(i)), not _bare(t)) for i, t in enumerate(targets)]
    values = [typed(text, f, dialect, t, decode_blobs) for text, f, t in zip(texts, fields, targets)]
    misfits = [
        F.when(text.isNotNull() & value.isNull(), F.lit(name))
        for text, value, name in zip(texts, values, names)
    ]
    bad = F.concat_ws(",", *misfits)
    reason = (
        F.when(broken, "unterminated statement")
        .when(short, F.concat(F.lit(f"expected {len(fields)} fields, got "), F.size("tokens")))
        .when(bad != "", F.concat(F.lit("does not fit: "), bad))
    )
    return records.select(
        *[v.alias(n) for v, n in zip(values, names)],
        F.col("dump").alias(DUMP),
        F.col("raw").alias(RAW),
        reason.alias(REASON),
        (broken | short).alias(DROPPED),
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col(DROPPED)).drop(DUMP, RAW, REASON, DROPPED)


def rejects(rows: DataFrame, table: str) -> DataFrame:
    """``(dump, table_name, raw, reason, dropped)`` of every row not loaded as written."""
    return rows.filter(F.col(REASON).isNotNull()).select(
        F.col(DUMP).alias("dump"),
        F.lit(table).alias("table_name"),
        F.col(RAW).alias("raw"),
        F.col(REASON).alias("reason"),
        F.col(DROPPED).alias("dropped"),
    )
