"""Queries over SQL text, plan text and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpdeck.functions import sqltext
from dumpdeck.operators.lineage import resolve_aliases
from dumpdeck.plans.registry import query, table


def _log(spark: SparkSession, sf_dir: str, *parts) -> DataFrame:
    """A query log with one text per order; parts are texts or order columns."""
    pieces = [F.lit(p[1:]) if p.startswith("'") else F.col(p).cast("string") for p in parts]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(*pieces).alias("sql"))


@query(
    "i1_split",
    """
SELECT o_orderkey AS id, 0::INTEGER AS pos, 'SELECT '';it''''s ' || o_orderpriority || ''' AS a' AS statement FROM orders
UNION ALL
SELECT o_orderkey, 1, '-- c;omment' || chr(10) || 'SELECT "x;y", ' || o_orderkey FROM orders
UNION ALL
SELECT o_orderkey, 2, '/* ; */' FROM orders
""",
)
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(
        spark, sf_dir, "'SELECT ';it''s ", "o_orderpriority",
        "'' AS a; -- c;omment\nSELECT \"x;y\", ", "o_orderkey", "' ;; /* ; */ ; \n",
    )
    return sqltext.split_statements(log)


@query(
    "i2_aliases",
    """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'y' END AS alias, 'lines' AS table_name FROM orders
UNION ALL
SELECT o_orderkey, 'x', 't' || o_custkey FROM orders WHERE o_orderkey % 2 = 1
""",
)
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In even orders both tables share an alias, and the later one wins."""
    log = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(
            F.lit("select * from t"),
            F.col("o_custkey").cast("string"),
            F.lit(' x\nLEFT JOIN "lines" AS '),
            F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise("y"),
            F.lit(" on 1 = 1 JOIN parts WHERE x.a > 1"),
        ).alias("sql"),
    )
    return sqltext.table_aliases(log)


@query(
    "i3_format",
    """
SELECT o_orderkey AS id, 'SELECT a, b' || ' ' || chr(10) || 'FROM t' || o_custkey || ' ' || chr(10) || 'INNER ' || chr(10)
  || 'JOIN u on x = y ' || chr(10) || 'WHERE a > ' || o_orderkey || ' ' || chr(10) || '  AND b < 3 ' || chr(10)
  || 'ORDER BY a ' || chr(10) || 'LIMIT 5  OFFSET 2' AS formatted
FROM orders
""",
)
def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(
        spark, sf_dir, "' select a,  b\n from t", "o_custkey", "'\tinner   join u on x = y where a > ", "o_orderkey",
        "' and b < 3 order  by a limit 5 offset 2 ",
    )
    return log.select("id", sqltext.format_sql(F.col("sql")).alias("formatted"))


@query(
    "i4_plan_timing",
    """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey || '.25')::DOUBLE END AS planning_ms,
       o_orderkey::DOUBLE AS execution_ms
FROM orders
""",
)
def plan_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderkey") % 3 != 0, "planning time: ").otherwise("Planned: ")
    plans = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(
            F.lit("Seq Scan on t\n"), label, F.col("o_custkey").cast("string"), F.lit(".25 ms\nExecution  Time = "),
            F.col("o_orderkey").cast("string"), F.lit("ms\n"),
        ).alias("plan"),
    )
    return plans.select(
        "id",
        sqltext.planning_time(F.col("plan")).alias("planning_ms"),
        sqltext.execution_time(F.col("plan")).alias("execution_ms"),
    )


OCCURRENCES = """
SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'en', ''))) // 2 AS n FROM documents
"""


@query("i5_occurrences", f"SELECT doc_id, n::INTEGER AS n FROM ({OCCURRENCES}) WHERE n > 0")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqltext.matches(table(spark, sf_dir, "documents"), "EN", "doc_id", "text")


@query(
    "f4_matches",
    f"SELECT count(*) AS texts, coalesce(sum(n), 0)::BIGINT AS total FROM ({OCCURRENCES}) WHERE n > 0",
)
def match_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqltext.match_totals(sqltext.matches(table(spark, sf_dir, "documents"), "EN", "doc_id", "text"))


@query(
    "d3_sql_predicates",
    """
SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS ordered, o_orderkey % 3 = 1 AS limited FROM orders
""",
)
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in strings, names and comments do not count."""
    tail = F.get(
        F.array(F.lit(" order\n by 1"), F.lit(" limit 5"), F.lit(" -- order by 1 limit 5")), (F.col("o_orderkey") % 3).cast("int")
    )
    log = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("select 'order by limit', credit_limit from t where k = '"), "o_orderpriority", F.lit("'"), tail).alias("sql"),
    )
    return log.select("id", sqltext.has_order_by(F.col("sql")).alias("ordered"), sqltext.has_limit(F.col("sql")).alias("limited"))


@query(
    "e2_lineage",
    """
SELECT o_orderkey AS id, 'x' AS alias, n_name AS table_name, 'c' || (n_regionkey + i) AS column_name
FROM orders JOIN nation ON n_nationkey = o_custkey % 25, (SELECT unnest([0, 1]) AS i)
""",
)
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders query the nation tables; the catalog gives each of those two columns."""
    log = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("SELECT x.c FROM nation_"), (F.col("o_custkey") % 25).cast("string"), F.lit(" AS x")).alias("sql"),
    )
    catalog = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("table_name"),
        F.explode(
            F.array(F.concat(F.lit("c"), "n_regionkey"), F.concat(F.lit("c"), F.col("n_regionkey") + 1))
        ).alias("column_name"),
    )
    return resolve_aliases(sqltext.table_aliases(log), catalog)
