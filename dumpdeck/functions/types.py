"""Declared database types -> logical types -> Spark types, and typed conversion."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpdeck.functions.tokens import bound

# Base type name -> logical type. Names not listed are TEXT.
PG_TYPES = {
    "INT64": [
        "INTEGER", "INT", "INT4", "SERIAL", "BIGINT", "INT8", "BIGSERIAL",
        "SMALLINT", "INT2", "SMALLSERIAL",
    ],
    "BOOL": ["BOOLEAN", "BOOL"],
    "FLOAT64": ["REAL", "FLOAT4", "DOUBLE PRECISION", "FLOAT8"],
    "UUID": ["UUID"],
    "BLOB": ["BYTEA"],
}
MYSQL_TYPES = {
    "INT64": ["INT", "INTEGER", "BIGINT", "SMALLINT", "MEDIUMINT", "TINYINT", "BIT"],
    "FLOAT64": ["FLOAT", "DOUBLE", "DOUBLE PRECISION", "REAL"],
    "BLOB": ["BLOB", "TINYBLOB", "MEDIUMBLOB", "LONGBLOB", "BINARY", "VARBINARY"],
}
# Texts that mean true, per dialect. Anything else is false.
TRUE_TEXTS = {"pg": ["t", "true", "1"], "mysql": ["1", "true", "TRUE"]}


def _lookup(base: Column, table: dict[str, list[str]], default: Column) -> Column:
    for logical, names in reversed(table.items()):
        default = F.when(base.isin(names), F.lit(logical)).otherwise(default)
    return default


def _with_params(text: Column) -> tuple[Column, Column]:
    return F.trim(F.regexp_replace(text, r"\(.*$", "")), F.regexp_extract(text, r"(\(.*)$", 1)


def pg_logical(src_type: Column) -> Column:
    def named(text: Column) -> Column:
        base, params = _with_params(text)
        return F.struct(text.alias("text"), base.alias("base"), params.alias("params"))

    def logical(s: Column) -> Column:
        decimal = F.when(s["params"] != "", F.concat(F.lit("DECIMAL"), s["params"])).otherwise("TEXT")
        other = F.when(s["base"].isin("NUMERIC", "DECIMAL"), decimal).otherwise("TEXT")
        return F.when(s["text"].endswith("[]"), "TEXT").otherwise(_lookup(s["base"], PG_TYPES, other))

    return bound(F.upper(F.trim(src_type)), lambda text: bound(named(text), logical))


def mysql_logical(src_type: Column) -> Column:
    def named(text: Column) -> Column:
        base = F.trim(F.regexp_replace(text, r"(?s)\(.*$", ""))
        return F.struct(base.alias("base"), F.regexp_extract(text, r"(\([^)]*\))", 1).alias("params"))

    def logical(s: Column) -> Column:
        decimal = F.when(s["params"] != "", F.concat(F.lit("DECIMAL"), s["params"])).otherwise("DECIMAL(18,6)")
        other = F.when(s["base"].isin("DECIMAL", "NUMERIC"), decimal).otherwise("TEXT")
        return F.when((s["base"] == "TINYINT") & (s["params"] == "(1)"), "BOOL").otherwise(
            _lookup(s["base"], MYSQL_TYPES, other)
        )

    text = F.trim(F.regexp_replace(F.upper(F.trim(src_type)), r"\s+(UNSIGNED|SIGNED|ZEROFILL)", ""))
    return bound(text, lambda t: bound(named(t), logical))


def sqlite_logical(src_type: Column) -> Column:
    """Substring tests in a fixed order, so POINT counts as an integer type."""
    text = F.coalesce(F.upper(F.trim(src_type)), F.lit(""))

    def has(*parts: str) -> Column:
        return text.rlike("|".join(parts))

    decimal = F.when(F.contains(text, F.lit("(")), F.replace(text, F.lit("NUMERIC"), F.lit("DECIMAL")))
    return (
        F.when(has("BOOL"), "BOOL")
        .when(has("INT"), "INT64")
        .when(has("REAL", "FLOA", "DOUB"), "FLOAT64")
        .when(has("BLOB"), "BLOB")
        .when(has("UUID"), "UUID")
        .when(has("DECIMAL", "NUMERIC"), decimal.otherwise("DECIMAL(18,6)"))
        .otherwise("TEXT")
    )


@dataclass(frozen=True)
class Field:
    """One column of a dump table."""

    name: str
    type: str = "TEXT"
    src_type: str = ""


def _decimal(logical: str) -> T.DecimalType | None:
    m = re.fullmatch(r"DECIMAL\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", logical)
    if not m or int(m[1]) > 38 or int(m[2] or 0) > int(m[1]):
        return None
    return T.DecimalType(int(m[1]), int(m[2] or 0))


def spark_type(field: Field, rich: bool = False, unsigned: bool = False) -> T.DataType:
    """Spark type of a field.

    ``rich`` turns dates, timestamps and JSON from text into their own types;
    ``unsigned`` reads BIGINT UNSIGNED as a decimal, since it can exceed a long.
    """
    src = field.src_type.upper()
    if unsigned and field.type == "INT64" and "BIGINT" in src and "UNSIGNED" in src:
        return T.DecimalType(20, 0)
    if rich and field.type == "TEXT" and not src.endswith("[]"):
        if src == "DATE":
            return T.DateType()
        if src.startswith(("TIMESTAMP", "DATETIME")):
            return T.TimestampType()
        if src in ("JSON", "JSONB"):
            return T.VariantType()
    simple = {
        "INT64": T.LongType(),
        "FLOAT64": T.DoubleType(),
        "BOOL": T.BooleanType(),
        "BLOB": T.BinaryType(),
    }
    return simple.get(field.type) or _decimal(field.type) or T.StringType()


UUID_TEXT = r"(?i)^\{?[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}\}?$"


def typed(text: Column, field: Field, dialect: str, target: T.DataType, decode_blobs: bool = True) -> Column:
    """Convert dump text to the field's type; text that does not fit gives null."""
    if isinstance(target, T.BooleanType):
        return F.when(text.isNotNull(), text.isin(TRUE_TEXTS[dialect]))
    if isinstance(target, T.DoubleType):
        # Java also takes a trailing type letter ("1.5d"), which is not a number in a dump.
        letter = text.endswith("d") | text.endswith("f") | text.endswith("D") | text.endswith("F")
        return F.when(~letter, text.try_cast(target))
    if isinstance(target, T.BinaryType):
        if not decode_blobs:
            return F.encode(text, "UTF-8")
        prefix = "\\x" if dialect == "pg" else "0x"
        return F.when(text.startswith(prefix), F.unhex(F.substr(text, F.lit(3)))).otherwise(
            F.encode(text, "UTF-8")
        )
    if isinstance(target, T.VariantType):
        return F.try_parse_json(text)
    if isinstance(target, T.StringType):
        return F.when(text.rlike(UUID_TEXT), F.lower(text)) if field.type == "UUID" else text
    return text.try_cast(target)
