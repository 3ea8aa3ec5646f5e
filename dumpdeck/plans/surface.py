"""The SQL surface: one query per construct, run as text on Spark and on the oracle.

Sums of money go through decimals, so results do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dumpdeck.operators import changes
from dumpdeck.operators.page import sql_scan
from dumpdeck.plans.registry import query, table, views
from dumpdeck.session import shared_folder

# Text that both engines take.
SHARED = {
    "l1_distinct": "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders",
    "l2_predicates": """
        SELECT p_partkey, p_name, p_size FROM part
        WHERE (p_size BETWEEN 5 AND 20 OR p_brand IN ('Brand#1', 'Brand#2')) AND NOT p_name LIKE 'red%'
          AND p_type IS NOT NULL""",
    "l3_exists": """
        SELECT c_custkey, c_name FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
          AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
    "l4_inner_join": """
        SELECT o_orderkey, c_name, n_name, r_name FROM orders
        JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
        JOIN region ON r_regionkey = n_regionkey""",
    "l4_left_join": """
        SELECT c_custkey, o_orderkey FROM customer
        LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000""",
    "l4_right_join": """
        SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000""",
    "l4_full_join": """
        SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 4000) s
        FULL JOIN customer ON s_suppkey = c_custkey""",
    # The one safe use of a cross join: next to a single row.
    "l4_cross_join": """
        SELECT o_orderkey, o_totalprice / top_price AS share
        FROM orders CROSS JOIN (SELECT max(o_totalprice) AS top_price FROM orders) t""",
    "l5_aggregate": """
        SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
               CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS avg_qty
        FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1""",
    "l6_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    "l7_union": """
        SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""",
    "l7_union_all": """
        SELECT c_custkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier""",
    "l8_windows": """
        SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk,
               dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
    "l9_with": """
        WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey)
        SELECT c_name, n FROM big JOIN customer ON c_custkey = o_custkey WHERE n > 2""",
    "l9_recursive": """
        WITH RECURSIVE steps(regionkey, depth) AS (
          SELECT r_regionkey, 1 FROM region
          UNION ALL SELECT regionkey, depth + 1 FROM steps WHERE depth < 3)
        SELECT c_custkey, depth FROM customer JOIN nation ON n_nationkey = c_nationkey
        JOIN steps ON n_regionkey = regionkey""",
    "l10_case": """
        SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
               coalesce(nullif(p_type, 'ECONOMY'), 'basic') AS kind
        FROM part""",
    "l11_strings": """
        SELECT p_partkey, substring(p_name, 2, 4) AS part_of, length(p_name) AS len, upper(p_name) AS up, lower(p_brand) AS low,
               trim(concat('  ', p_name, ' ')) AS trimmed, replace(p_name, 'e', '3') AS replaced, p_brand || '-' || repeat('x', 3) AS joined
        FROM part""",
    "l13_math": """
        SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f,
               CAST(ceil(c_acctbal) AS BIGINT) AS c, power(c_nationkey, 2) AS p, sqrt(c_nationkey) AS s
        FROM customer""",
    "l14_cast": """
        SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,1)) AS price, o_custkey::VARCHAR(20) AS cust, CAST(o_orderkey AS INTEGER) AS k
        FROM orders""",
}
# Same meaning, different spelling: (Spark, oracle).
SPELLED = {
    "l12_dates": (
        """
        SELECT event_id, CAST(to_date(ts) AS STRING) AS day, date_format(ts + INTERVAL '7 seconds', 'yyyy-MM-dd HH:mm:ss') AS later,
               current_date() >= to_date(ts) AS past, CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ) <= ts AS recent, now() IS NULL AS no_clock
        FROM events""",
        """
        SELECT event_id, ts::DATE::VARCHAR AS day, strftime(ts + INTERVAL '7 seconds', '%Y-%m-%d %H:%M:%S') AS later,
               current_date >= ts::DATE AS past, TIMESTAMP '2024-01-01 00:00:00' <= ts AS recent, now() IS NULL AS no_clock
        FROM events""",
    ),
}
USED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _register(name: str, spark_text: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *[t for t in USED if t in spark_text])
        return sql_scan(spark, spark_text)


for _name, _text in SHARED.items():
    _register(_name, _text.replace("VARCHAR(20)", "STRING"), _text)
for _name, (_text, _oracle) in SPELLED.items():
    _register(_name, _text, _oracle)


@query("l15_ddl", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE / ALTER / DROP TABLE and views over a table kept in the shared folder."""
    path = f"{shared_folder(spark, 'ddl')}/orders"
    views(spark, sf_dir, "orders")
    for statement in (
        "DROP TABLE IF EXISTS dumpdeck_orders",
        f"CREATE TABLE dumpdeck_orders USING parquet LOCATION '{path}' AS SELECT o_orderkey, o_custkey FROM orders",
        "ALTER TABLE dumpdeck_orders ADD COLUMNS (note STRING)",
        "DROP TABLE dumpdeck_orders",
    ):
        spark.sql(statement)
    spark.read.parquet(path).createOrReplaceTempView("kept_orders")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW per_customer AS SELECT o_custkey, count(*) AS n FROM kept_orders GROUP BY o_custkey")
    return spark.table("per_customer")


@query(
    "l16_dml",
    """
SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'MACHINERY'
UNION ALL SELECT s_suppkey + 10000000, s_acctbal FROM supplier
""",
)
def dml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DELETE, UPDATE and INSERT as versions of a table."""
    from pyspark.sql import functions as F

    customer = table(spark, sf_dir, "customer")
    gone = customer.filter("c_mktsegment = 'MACHINERY'").select("c_custkey")
    new = customer.filter("c_nationkey = 3").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    rows = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal")
    )
    kept = changes.delete(customer.select("c_custkey", "c_acctbal"), gone, ["c_custkey"])
    return changes.insert(changes.update(kept, new, ["c_custkey"]), rows)


@query("l17_quoted_names", 'SELECT "o_orderkey" AS "Key", \'o_custkey\' AS "text" FROM orders')
def quoted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Double quotes name columns where the session says so; the setting is put back."""
    setting = "spark.sql.ansi.doubleQuotedIdentifiers"
    before = spark.conf.get(setting)
    views(spark, sf_dir, "orders")
    spark.conf.set(setting, "true")
    try:
        return sql_scan(spark, 'SELECT "o_orderkey" AS "Key", \'o_custkey\' AS "text" FROM orders')
    finally:
        spark.conf.set(setting, before)
