"""Queries over the column functions: type maps, unescaping, typed conversion, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpdeck.functions import escapes
from dumpdeck.functions.rows import accepted, typed_rows
from dumpdeck.functions.types import Field, mysql_logical, pg_logical, sqlite_logical
from dumpdeck.operators.audit import name_collisions
from dumpdeck.operators.export import export_text, number_text
from dumpdeck.operators.load import normalise
from dumpdeck.plans.registry import query, table
from dumpdeck.sources.mysqldump import literal_text, row_groups
from dumpdeck.sources.pgdump import copy_text

# Type texts that take a number from the row, and the logical type each must map to.
PG = [
    ("integer", "INT64"), ("bigserial", "INT64"), ("boolean", "BOOL"), ("double precision", "FLOAT64"),
    ("numeric(%d,2)", "DECIMAL(%d,2)"), ("numeric", "TEXT"), ("character varying(%d)", "TEXT"),
    ("uuid", "UUID"), ("bytea", "BLOB"), ("timestamp(%d) without time zone", "TEXT"), ("integer[]", "TEXT"),
    ("jsonb", "TEXT"), ("float4", "FLOAT64"), ("mood%d", "TEXT"),
]
MYSQL = [
    ("int(%d)", "INT64"), ("bigint(%d) unsigned", "INT64"), ("tinyint(1)", "BOOL"), ("tinyint(4)", "INT64"),
    ("float", "FLOAT64"), ("double precision", "FLOAT64"), ("decimal(%d,2)", "DECIMAL(%d,2)"),
    ("decimal", "DECIMAL(18,6)"), ("varchar(%d)", "TEXT"), ("datetime(%d)", "TEXT"), ("varbinary(%d)", "BLOB"),
    ("longblob", "BLOB"), ("enum('a','%d')", "TEXT"), ("bit(%d)", "INT64"), ("json", "TEXT"),
]
SQLITE = [
    ("INTEGER", "INT64"), ("boolean", "BOOL"), ("DOUBLE PRECISION", "FLOAT64"), ("VARCHAR(%d)", "TEXT"),
    ("NUMERIC(%d,2)", "DECIMAL(%d,2)"), ("DECIMAL", "DECIMAL(18,6)"), ("POINT", "INT64"), ("BLOB", "BLOB"),
    ("uuid", "UUID"), ("WHATEVER%d", "TEXT"), ("", "TEXT"), ("BIGINT(%d)", "INT64"),
]


def _pick_sql(texts: list[str]) -> str:
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"replace([{listed}][p_partkey % {len(texts)} + 1], '%d', (p_size % 20 + 10)::VARCHAR)"


def _map_oracle(pairs: list[tuple[str, str]]) -> str:
    declared, logical = _pick_sql([p[0] for p in pairs]), _pick_sql([p[1] for p in pairs])
    return f"SELECT p_partkey, {declared} AS declared, {logical} AS logical FROM part"


def _mapped(spark: SparkSession, sf_dir: str, pairs, logical) -> DataFrame:
    texts = F.array(*[F.lit(p[0]) for p in pairs])
    declared = F.replace(
        F.get(texts, (F.col("p_partkey") % len(pairs)).cast("int")),
        F.lit("%d"),
        (F.col("p_size") % 20 + 10).cast("string"),
    )
    part = table(spark, sf_dir, "part").select("p_partkey", declared.alias("declared"))
    return part.withColumn("logical", logical(F.col("declared")))


@query("c1_sqlite_types", _map_oracle(SQLITE))
def sqlite_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, SQLITE, sqlite_logical)


@query("c2_pg_types", _map_oracle(PG))
def pg_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, PG, pg_logical)


@query("c3_mysql_types", _map_oracle(MYSQL))
def mysql_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, MYSQL, mysql_logical)


def _marked(spark: SparkSession, sf_dir: str, *tail: str) -> DataFrame:
    """Conversation texts as they are, plus a tail in escaped form; newlines are escaped too."""
    text = F.replace("text", F.lit("\n"), F.lit("\\n"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(text, *map(F.lit, tail)).alias("escaped")
    )


@query(
    "c4_copy_unescape",
    r"""
SELECT conv_id, turn, text || chr(9) || '\' || chr(13) || '\n' || '\x' AS value FROM conversations
""",
)
def unescape_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _marked(spark, sf_dir, r"\t\\\r", r"\\n", r"\x")
    return lines.select("conv_id", "turn", escapes.copy_unescape(F.col("escaped")).alias("value"))


@query(
    "c5_tsv_unescape",
    r"""
SELECT conv_id, turn, text || chr(9) || '\' || chr(13) || '\n' || '\q' AS value,
       replace(text, chr(10), '\n') || chr(9) || '^q' AS caret
FROM conversations
""",
)
def unescape_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _marked(spark, sf_dir, r"\t\\\r", r"\\n", r"\q")
    caret = F.concat(F.substring_index("escaped", r"\t\\", 1), F.lit("^t^q"))
    return lines.select(
        "conv_id",
        "turn",
        escapes.tsv_unescape(F.col("escaped")).alias("value"),
        escapes.tsv_unescape(caret, "^").alias("caret"),
    )


@query(
    "c6_mysql_unescape",
    r"""
SELECT conv_id, turn, text || '''' || chr(9) || '\' || '''' || '%' || '\n' AS value FROM conversations
""",
)
def unescape_mysql(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _marked(spark, sf_dir, r"\'\t\\''\%", r"\\n")
    return lines.select("conv_id", "turn", escapes.mysql_unescape(F.col("escaped")).alias("value"))


@query(
    "c7_split_fields",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 3 END::INTEGER AS fields, '' AS second,
       o_orderpriority AS third
FROM orders
""",
)
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty fields count, also at the end of a line."""
    line = F.concat(
        F.col("o_orderkey").cast("string"),
        F.lit("\t\t"),
        F.col("o_orderpriority"),
        F.when(F.col("o_orderkey") % 3 == 0, "\t").otherwise(""),
    )
    fields = escapes.split_fields(line)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.size(fields).alias("fields"), fields[1].alias("second"), fields[2].alias("third")
    )


@query(
    "c8_typed_copy",
    """
SELECT o_orderkey AS id,
       CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false END AS flag,
       CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price,
       (o_orderkey % 1000)::DECIMAL(10,2) AS amount
FROM orders
""",
)
def typed_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array(*map(F.lit, ["t", "true", "1", "yes", "\\N"]))
    tokens = F.array(
        F.col("o_orderkey").cast("string"),
        F.get(flags, (F.col("o_orderkey") % 5).cast("int")),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("1.5d")).otherwise(F.col("o_totalprice").cast("string")),
        F.concat((F.col("o_orderkey") % 1000).cast("string"), F.lit(".00")),
    )
    records = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("dump"), F.concat_ws("\t", tokens).alias("raw"), tokens.alias("tokens")
    )
    fields = [Field("id", "INT64"), Field("flag", "BOOL"), Field("price", "FLOAT64"), Field("amount", "DECIMAL(10,2)")]
    return accepted(typed_rows(records, fields, "pg", copy_text))


@query(
    "c8_typed_insert",
    """
SELECT c_custkey AS id, c_custkey % 2 = 1 AS flag, c_name || '''' AS name, c_acctbal AS balance FROM customer
""",
)
def typed_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted and bare literals convert alike."""
    statement = F.format_string(
        "INSERT INTO `c` VALUES ('%d',%d,'%s\\'','%s')",
        F.col("c_custkey"), F.col("c_custkey") % 2, F.col("c_name"), F.col("c_acctbal").cast("string"),
    )
    statements = table(spark, sf_dir, "customer").select(F.lit("c").alias("dump"), statement.alias("statement"))
    fields = [Field("id", "INT64"), Field("flag", "BOOL"), Field("name"), Field("balance", "FLOAT64")]
    return accepted(typed_rows(row_groups(statements), fields, "mysql", literal_text))


@query(
    "c10_names",
    """
SELECT c_custkey AS "custkey", c_name AS "fullname", c_mktsegment AS "segment" FROM customer
""",
)
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").toDF("CustKey", "FullName", "nation", "balance", "SEGMENT")
    kept = c.select("CustKey", "FullName", "SEGMENT")
    return kept.toDF(*[normalise(n, "lower") for n in kept.columns])


@query(
    "c11_collisions",
    """
SELECT 'd' || p_size AS dump, 't' || p_partkey AS table_name, 'column' AS kind, 'name' AS name, 2::BIGINT AS n
FROM part WHERE p_partkey % 3 = 0
""",
)
def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part declares a table; in each third one two columns differ only in case."""
    second = F.when(F.col("p_partkey") % 3 == 0, "NAME").otherwise("label")
    columns = table(spark, sf_dir, "part").select(
        F.concat(F.lit("d"), "p_size").alias("dump"),
        F.concat(F.lit("t"), "p_partkey").alias("table_name"),
        F.posexplode(F.array(F.lit("Name"), second)).alias("pos", "column_name"),
    )
    return name_collisions(columns)


@query(
    "c12_unquote",
    """
SELECT p_partkey, p_name AS bare, [p_brand, p_type] AS listed FROM part
""",
)
def unquote(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = [
        F.concat(F.lit('public."'), "p_name", F.lit('"')),
        F.concat(F.lit('"public"."'), "p_name", F.lit('"')),
        F.concat(F.lit("`"), "p_name", F.lit("`")),
        F.concat(F.lit(" "), "p_name", F.lit(" ")),
    ]
    form = F.get(F.array(*forms), (F.col("p_partkey") % 4).cast("int"))
    listed = F.concat(F.lit('"'), "p_brand", F.lit('", `'), "p_type", F.lit("`, "))
    return table(spark, sf_dir, "part").select(
        "p_partkey", escapes.bare_name(form).alias("bare"), escapes.name_list(listed).alias("listed")
    )


@query(
    "c13_export_values",
    """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
       CASE WHEN value > 20 THEN 'true' ELSE 'false' END AS big,
       CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END AS value,
       base64(event_type::BLOB) AS type_bytes
FROM events
""",
)
def export_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id", "ts", (F.col("value") > 20).alias("big"), "value", F.encode("event_type", "UTF-8").alias("type_bytes")
    )
    return e.select("event_id", *[export_text(f).alias(f.name) for f in e.schema.fields if f.name != "event_id"])


def rounded_text(c: Column) -> Column:
    return number_text(F.round(c, 2))
