"""CSV, JSON and TSV export, written in parallel as a folder of part files."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMESTAMPS = "yyyy-MM-dd HH:mm:ss"


def number_text(c: Column) -> Column:
    """Shortest text of a double: no ``.0``, plain digits below 1e15, else ``1.5E+20``."""
    text = c.cast("string")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    sign = F.when(exponent < 0, "-").otherwise("+")
    digits = F.abs(exponent).cast("string")
    digits = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)  # lpad cuts longer ones
    scientific = F.concat(mantissa, F.lit("E"), sign, digits)
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    return (
        F.when(text.endswith(".0"), F.substr(text, F.lit(1), F.length(text) - 2))
        .when(~F.contains(text, F.lit("E")), text)
        .when((F.abs(c) < 1e15) & (F.abs(c) >= 1e-4), plain)
        .otherwise(scientific)
    )


def export_text(f: T.StructField, timestamps: str | None = TIMESTAMPS) -> Column:
    """Value of one column as it is written: lower-case booleans, formatted times, base64.

    Without a pattern times are written as Spark prints them.
    """
    c = F.col("`" + f.name.replace("`", "``") + "`")
    if timestamps is None and isinstance(f.dataType, T.DatetimeType):
        return c.cast("string")
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, timestamps)
    if isinstance(f.dataType, T.DateType):
        return F.date_format(c.cast("timestamp"), timestamps)
    if isinstance(f.dataType, T.BinaryType):
        return F.base64(c)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return number_text(c)
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def _as_text(df: DataFrame, timestamps: str | None = TIMESTAMPS) -> DataFrame:
    return df.select(*[export_text(f, timestamps).alias(f.name) for f in df.schema.fields])


def write_csv(
    df: DataFrame,
    path: str,
    header: bool = True,
    timestamps: str | None = TIMESTAMPS,
    quote_all: bool = False,
    mode: str = "errorifexists",
    **options,
) -> None:
    """CSV: a field is quoted if it holds a comma, quote or line break (or always), quotes are
    doubled, null is empty."""
    text = _as_text(df, timestamps)
    (text.na.fill("") if quote_all else text).write.mode(mode).options(
        header=header,
        escape='"',
        quoteAll=quote_all,
        emptyValue='""' if quote_all else "",
        nullValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        **options,
    ).csv(path)


def write_json(
    df: DataFrame, path: str, timestamps: str = TIMESTAMPS, mode: str = "errorifexists", **options
) -> None:
    """JSON Lines with nulls kept."""
    df.write.mode(mode).options(
        ignoreNullFields=False, timestampFormat=timestamps, timestampNTZFormat=timestamps, **options
    ).json(path)


def json_text(df: DataFrame, timestamps: str = TIMESTAMPS, pretty: bool = False) -> DataFrame:
    """``value``: one JSON object per row."""
    options = {
        "ignoreNullFields": "false",
        "timestampFormat": timestamps,
        "timestampNTZFormat": timestamps,
        "pretty": str(pretty).lower(),
    }
    return df.select(F.to_json(F.struct(*df.columns), options).alias("value"))


def write_json_array(
    df: DataFrame, path: str, timestamps: str = TIMESTAMPS, pretty: bool = False, mode: str = "errorifexists"
) -> None:
    """JSON arrays: every part file is one valid array of its rows. Sort ``df`` first for order."""

    def frame(batches):
        held = None
        started = False
        for batch in batches:
            values = batch.column(0).to_pylist()
            if not values:
                continue
            if held is not None:
                yield _lines([held + ","])
            out = [v + "," for v in values[:-1]]
            if not started:
                started = True
                out = ["[", *out]
            held = values[-1]
            if out:
                yield _lines(out)
        yield _lines([held, "]"] if started else ["[]"])

    json_text(df, timestamps, pretty).mapInArrow(frame, "value string").write.mode(mode).text(path)


def json_object(df: DataFrame, timestamps: str = TIMESTAMPS) -> Column:
    """One JSON object per row, with values as CSV has them: numbers in their shortest text, dates by the
    pattern, base64. Numbers without a JSON form (NaN, infinities) are strings."""
    options = {"ignoreNullFields": "false", "timestampFormat": timestamps, "timestampNTZFormat": timestamps}
    members = []
    for f in df.schema.fields:
        name = json.dumps(f.name, ensure_ascii=False) + ":"
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
            text = F.when(finite, number_text(c)).otherwise(F.concat(F.lit('"'), c.cast("string"), F.lit('"')))
        elif isinstance(f.dataType, T.DateType):
            text = F.concat(F.lit('"'), export_text(f, timestamps), F.lit('"'))
        else:
            whole = F.to_json(F.struct(c.alias("v")), options)  # {"v":value}
            text = F.substr(whole, F.lit(6), F.length(whole) - 6)
        members.append(F.concat(F.lit(name), F.coalesce(text, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def write_json_parts(
    df: DataFrame, path: str, timestamps: str = TIMESTAMPS, mode: str = "errorifexists"
) -> DataFrame:
    """One JSON array over many part files, framed without a look at neighbouring rows or parts.

    Every row of a part but its first brings a comma. ``path/rows`` holds the parts; the manifest, written to
    ``path/manifest`` and returned, has one row per part that holds rows: ``part`` (its place), ``file``, ``bytes``, and the texts
    to put ``before`` and ``after`` it, so that all parts, joined in order, are one array. An empty
    table has one row without a file. Sort ``df`` first for order.
    """
    spark = df.sparkSession
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    comma = F.when(first, "").otherwise(",")
    # The number is drawn before anything else sees the rows, so a filter or sort above cannot move it.
    lines = df.select(F.concat(comma, json_object(df, timestamps)).alias("value"))
    lines.write.mode(mode).text(f"{path}/rows")
    # Part files are named by partition number; sizes come from the file listing, one row per part.
    listed = spark.read.format("binaryFile").load(f"{path}/rows/part-*").select("path", F.col("length").alias("bytes"))
    listed = listed.filter("bytes > 0").withColumn("file", F.substring_index("path", "/", -1))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("int")
    order = Window.orderBy(number, "file")
    parts = listed.select(
        (F.row_number().over(order) - 1).alias("part"),
        "file",
        "bytes",
        F.when(F.row_number().over(order) == 1, "[").otherwise(",").alias("before"),
        F.when(F.lead("file").over(order).isNull(), "]").otherwise("").alias("after"),
    )
    parts.write.mode(mode).parquet(f"{path}/manifest")
    manifest = spark.read.parquet(f"{path}/manifest")
    if manifest.isEmpty():
        empty = spark.createDataFrame([(0, None, 0, "[", "]")], manifest.schema)
        empty.write.mode("append").parquet(f"{path}/manifest")
        manifest = spark.read.parquet(f"{path}/manifest")
    return manifest


def _lines(values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])


def tsv_lines(df: DataFrame) -> DataFrame:
    """``value``: tab-joined values without quoting, null is empty."""
    return df.select(F.array_join(F.array(*map(export_text, df.schema.fields)), "\t", "").alias("value"))


def quoted_lines(df: DataFrame) -> DataFrame:
    """``value``: comma-joined values, every one quoted."""

    def quote(f: T.StructField) -> Column:
        return F.concat(F.lit('"'), F.replace(export_text(f), F.lit('"'), F.lit('""')), F.lit('"'))

    return df.select(F.array_join(F.array(*map(quote, df.schema.fields)), ",", '""').alias("value"))


def write_tsv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    """TSV part files, each with the header line."""
    lines = tsv_lines(df)
    if header:
        # The first row of each partition brings the header along; no row leaves the JVM for it.
        is_first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        names = F.lit("\t".join(df.columns) + "\n")
        lines = lines.select(F.concat(F.when(is_first, names).otherwise(""), "value").alias("value"))
    lines.write.mode(mode).text(path)
