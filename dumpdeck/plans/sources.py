"""Queries over the dump readers. Each renders given tables as a dump and reads it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpdeck import encode
from dumpdeck.functions.rows import DROPPED, DUMP, RAW, REASON, accepted
from dumpdeck.operators.load import load, load_rejects
from dumpdeck.operators.page import sql_scan
from dumpdeck.plans.registry import query, table, views
from dumpdeck.session import shared_folder
from dumpdeck.sources import ddl
from dumpdeck.sources.archive import content_root, unpack
from dumpdeck.sources.detect import detect_files
from dumpdeck.sources.mysqldump import MysqlDump, read_mysqldump, skippable
from dumpdeck.sources.mysqlshell import MysqlShellDump, read_mysqlshell
from dumpdeck.sources.open import inventory
from dumpdeck.sources.perf import perf_items
from dumpdeck.sources.pgdump import PgDump, read_pgdump
from dumpdeck.sources.sqlite import SqliteDump, read_sqlite


@query(
    "a1_sql_scan",
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority",
)
def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return sql_scan(
        spark,
        "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority;",
    )


def _awkward_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with tabs, backslashes, quotes and nulls in their text."""
    c = table(spark, sf_dir, "customer")
    return c.withColumns(
        {
            "c_name": F.concat("c_name", F.lit("\t\\n'\\\\\n\"")),
            "c_mktsegment": F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")),
            "c_acctbal": F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")),
        }
    )


AWKWARD = r"""
SELECT c_custkey, c_name || chr(9) || '\n''\\' || chr(10) || '"' AS c_name,
       c_nationkey::BIGINT AS c_nationkey,
       CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS c_mktsegment
FROM customer
"""


@query("a2_pgdump_roundtrip", AWKWARD)
def pgdump_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = encode.write_pgdump({"customer": _awkward_customers(spark, sf_dir)}, shared_folder(spark, "pg"))
    return read_pgdump(spark, path, "customer")


MANY = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey"}


def _sums_sql(names) -> str:
    """Rows of several tables: how many, the sum of their keys, and the length of their texts."""
    texts = {"region": "r_name", "nation": "n_name", "customer": "c_name", "supplier": "s_name", "orders": "o_orderpriority"}
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n, sum({MANY[t]})::BIGINT AS keys, sum(length({texts[t]}))::BIGINT AS letters FROM {t}"
        for t in names
    )


def _sums(rows: dict[str, DataFrame]) -> DataFrame:
    texts = {"region": "r_name", "nation": "n_name", "customer": "c_name", "supplier": "s_name", "orders": "o_orderpriority"}
    parts = [
        df.agg(F.count("*").alias("n"), F.sum(MANY[t]).cast("long").alias("keys"), F.sum(F.length(texts[t])).cast("long").alias("letters"))
        .select(F.lit(t).alias("table_name"), "n", "keys", "letters")
        for t, df in rows.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("a2_pgdump_multitable", _sums_sql(("region", "nation", "supplier", "orders")))
def pgdump_one_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in ("region", "nation", "supplier", "orders")}
    path = encode.write_pgdump(tables, shared_folder(spark, "pg"))
    dump = PgDump(spark, path)
    return _sums({n: accepted(dump.rows(n)) for n in tables})


@query("a2_many_blocks", "SELECT c_custkey, c_name FROM customer")
def many_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A COPY block of its own for each customer."""
    c = table(spark, sf_dir, "customer")
    row = F.concat_ws("\t", "c_custkey", "c_name")
    block = F.concat(F.lit("COPY public.customer (c_custkey, c_name) FROM stdin;\n"), row, F.lit("\n\\.\n"))
    folder = shared_folder(spark, "blocks")
    create = "CREATE TABLE public.customer (\n    c_custkey bigint,\n    c_name text\n);"
    spark.createDataFrame([(create,)], "value string").write.text(f"{folder}/schema")
    c.select(block).write.text(f"{folder}/rows")
    return read_pgdump(spark, f"{folder}/*/*.txt", "customer")


@query(
    "a2_pgdump_lineitem",
    """
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS orders,
       sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, min(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS first_ship
FROM lineitem GROUP BY l_returnflag, l_linestatus
""",
)
def pgdump_then_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"lineitem": table(spark, sf_dir, "lineitem")}
    rows = read_pgdump(spark, encode.write_pgdump(tables, shared_folder(spark, "pg")), "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.count_distinct("l_orderkey").alias("orders"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"),
        F.min("l_shipdate").alias("first_ship"),
    )


@query(
    "a3_mysqldump_roundtrip",
    r"""
SELECT doc_id, text || '''\;' || chr(10) || '),(' AS text, lang, source, n_chars FROM documents
""",
)
def mysqldump_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("text", F.concat("text", F.lit("'\\;\n),(")))
    path = encode.write_mysqldump({"documents": docs}, shared_folder(spark, "mysql"))
    return read_mysqldump(spark, path, "documents")


@query("a3_mixed_line_ends", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def mixed_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the customers in files with LF, half with CR LF."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    paths = [
        encode.write_mysqldump({"customer": c.filter(F.col("c_custkey") % 2 == i)}, shared_folder(spark, "mysql"))
        for i in (0, 1)
    ]
    folder = shared_folder(spark, "crlf")
    spark.read.text(paths[1]).write.option("lineSep", "\r\n").text(folder)
    return read_mysqldump(spark, [paths[0], f"{folder}/*.txt"], "customer")


@query("a3_cut_statement", "SELECT p_partkey, p_name || ';' || chr(10) || p_type AS p_name FROM part")
def cut_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends stand in strings as they are, after a semicolon."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(";\n", "p_name", "p_type").alias("p_name"))
    path = encode.write_mysqldump({"part": p}, shared_folder(spark, "mysql"))
    folder = shared_folder(spark, "cut")
    spark.read.text(path).select(F.replace("value", F.lit("\\n"), F.lit("\n"))).write.text(folder)
    return read_mysqldump(spark, f"{folder}/*.txt", "part")


@query("a3_trigger_body", "SELECT s_suppkey, s_name FROM supplier")
def trigger_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trigger after each INSERT, which would insert the same rows again."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    path = encode.write_mysqldump({"supplier": s}, shared_folder(spark, "mysql"))
    value = F.col("value")
    body = F.concat(
        F.lit("DELIMITER ;;\n/*!50003 CREATE*/ /*!50003 TRIGGER `again` AFTER INSERT ON `x` FOR EACH ROW BEGIN\n"),
        value, F.lit("\n"), value, F.lit("\nEND */;;\nDELIMITER ;"),
    )
    folder = shared_folder(spark, "trigger")
    lines = F.when(value.startswith("INSERT"), F.concat(value, F.lit("\n"), body)).otherwise(value)
    spark.read.text(path).select(lines).write.text(folder)
    return read_mysqldump(spark, f"{folder}/*.txt", "supplier")


@query("a3_long_comments", "SELECT doc_id, n_chars FROM documents")
def long_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of each document as a block comment and as line comments in front of its INSERT."""
    text = F.coalesce("text", F.lit(""))
    block = F.concat(F.lit("/* "), F.replace(text, F.lit("*/"), F.lit("* /")), F.lit(" */\n"))
    lines = F.concat(F.lit("-- "), F.replace(text, F.lit("\n"), F.lit("\n-- ")), F.lit("\n"))
    values = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in ("doc_id", "n_chars")]
    row = F.concat(F.lit("INSERT INTO `d` VALUES ("), values[0], F.lit(","), values[1], F.lit(");"))
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "comments")
    docs.select(F.concat(block, lines, row)).write.text(f"{folder}/rows")
    declared = "CREATE TABLE `d` (\n  `doc_id` bigint,\n  `n_chars` bigint\n);"
    docs.select(F.lit(declared)).limit(1).write.text(f"{folder}/declared")
    return read_mysqldump(spark, [f"{folder}/declared/*.txt", f"{folder}/rows/*.txt"], "d", crlf=False)


NAMES = {"größe-1": "customer", "01": "part", "1": "nation", "T": "region", "t": "supplier"}


@query(
    "a3_a10_names", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {t}" for n, t in NAMES.items())
)
def hard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, t) for n, t in NAMES.items()}
    return MysqlDump(spark, encode.write_mysqldump(tables, shared_folder(spark, "mysql"))).counts()


@query("a3_mysqldump_nulls", AWKWARD)
def mysqldump_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = encode.write_mysqldump({"customer": _awkward_customers(spark, sf_dir)}, shared_folder(spark, "mysql"))
    return read_mysqldump(spark, path, "customer")


@query(
    "a4_mysqlshell_roundtrip",
    """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
FROM orders
""",
)
def mysqlshell_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").repartition(12)
    folder = encode.write_mysqlshell("shop", "orders", orders, shared_folder(spark, "shell"))
    return read_mysqlshell(spark, folder, "orders")


@query("a4_mysqlshell_escapes", AWKWARD)
def mysqlshell_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _awkward_customers(spark, sf_dir)
    folder = encode.write_mysqlshell("shop", "customer", customers, shared_folder(spark, "shell"))
    return read_mysqlshell(spark, folder, "shop.customer")


@query(
    "a5_sqlite_roundtrip",
    "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part",
)
def sqlite_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").repartition(2, "p_partkey")
    path = encode.write_sqlite("part", part, shared_folder(spark, "sqlite"), key="p_partkey")
    return read_sqlite(spark, path, "part", rows_per_partition=500)


@query("a5_without_rowid", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def sqlite_without_rowid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables stored in the order of a key of two columns, read in slices of 500 keys."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    path = encode.write_sqlite(
        "orders", rows.repartition(3), shared_folder(spark, "sqlite"),
        rules=["PRIMARY KEY (o_custkey, o_orderkey)"], options="WITHOUT ROWID",
    )
    return read_sqlite(spark, path, "orders", rows_per_partition=500)


@query(
    "a5_mixed_files",
    """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS p_name,
       CASE WHEN p_partkey % 2 = 1 THEN p_size::BIGINT END AS p_size FROM part
""",
)
def sqlite_mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files whose tables have different columns."""
    part, base = table(spark, sf_dir, "part").repartition(2), shared_folder(spark, "sqlite")
    encode.write_sqlite("part", part.filter("p_partkey % 2 = 0").select("p_partkey", "p_name"), f"{base}/a")
    encode.write_sqlite("part", part.filter("p_partkey % 2 = 1").select("p_size", "p_partkey"), f"{base}/b")
    return read_sqlite(spark, base, "part").select("p_partkey", "p_name", "p_size")


@query("a6_load_archives", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def load_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three zips, each with a dump of a third of the customers, loaded in one step."""
    lines = table(spark, sf_dir, "customer").select(F.concat_ws("\t", "c_custkey", "c_name", "c_mktsegment").alias("value"))
    head = [
        "--", "-- PostgreSQL database dump", "--", "CREATE TABLE public.customer (", "    c_custkey bigint,", "    c_name text,",
        "    c_mktsegment text", ");", "COPY public.customer (c_custkey, c_name, c_mktsegment) FROM stdin;",
    ]
    dumps = encode.framed(lines.repartition(3), head, ["\\."])
    packed = encode.write_zips(dumps, shared_folder(spark, "zips"), "shop/dump.sql")
    return load(spark, packed, shared_folder(spark, "loaded")).table("customer")


@query(
    "a6_archive",
    """
SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer
""",
)
def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "customer").select(
        F.concat_ws("\t", "c_custkey", "c_name", "c_mktsegment").alias("value")
    )
    packed = encode.write_zips(lines.repartition(4), shared_folder(spark, "zips"), "customer/data.tsv")
    members = unpack(spark, packed, shared_folder(spark, "unpacked"), tasks=8)
    # A bounded list: one path per archive.
    roots = [r.root for r in content_root(members).collect()]
    parts = F.split("value", "\t")
    return spark.read.text(roots).select(
        parts[0].alias("c_custkey"), parts[1].alias("c_name"), parts[2].alias("c_mktsegment")
    )


@query(
    "a7_detect",
    """
SELECT DISTINCT c_custkey % 4 AS kind, CASE c_custkey % 4 WHEN 0 THEN 'pg_dump' WHEN 1 THEN 'mysqldump'
                                       WHEN 2 THEN 'mysqldump' ELSE 'unknown' END AS format
FROM customer
""",
)
def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the lines of files of four kinds, some per task and kind."""
    heads = F.array(
        F.lit("--\n-- PostgreSQL database dump\n--"),
        F.lit("-- MariaDB dump 10.19"),
        F.lit("/*!40101 SET NAMES utf8 */;"),
        F.lit("SELECT 1;"),
    )
    kind = F.col("c_custkey") % 4
    lines = table(spark, sf_dir, "customer").select(
        kind.alias("kind"), F.concat_ws("\n", F.get(heads, kind.cast("int")), "c_name").alias("value")
    )
    folder = shared_folder(spark, "landing")
    lines.repartition(4).write.partitionBy("kind").text(folder)
    found = F.regexp_extract("path", r"/kind=(\d+)/", 1).cast("long")
    return detect_files(spark, folder).select(found.alias("kind"), "format").distinct()


@query(
    "a8_inventory",
    """
WITH c AS (SELECT 'region' AS table_name, count(*) AS n FROM region
           UNION ALL SELECT 'nation', count(*) FROM nation
           UNION ALL SELECT 'supplier', count(*) FROM supplier
           UNION ALL SELECT 'lineitem', count(*) FROM lineitem)
SELECT table_name, n FROM c UNION ALL SELECT NULL, sum(n)::BIGINT FROM c
""",
)
def pg_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in ("region", "nation", "supplier", "lineitem")}
    return inventory(PgDump(spark, encode.write_pgdump(tables, shared_folder(spark, "pg"))))


@query(
    "a8_sqlite_inventory",
    "SELECT 'part' AS table_name, count(*) AS n FROM part UNION ALL SELECT NULL, count(*) FROM part",
)
def sqlite_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = encode.write_sqlite("part", table(spark, sf_dir, "part"), shared_folder(spark, "sqlite"))
    return inventory(SqliteDump(spark, path))


def _declared(columns: DataFrame) -> DataFrame:
    return columns.select(
        "table_name", F.col("pos").cast("long").alias("pos"), "column_name", "type",
        "not_null", "is_pk", "is_unique", "auto_increment",
    )


@query(
    "a9_mysql_ddl",
    """
SELECT 't' || p_partkey AS table_name, 0::BIGINT AS pos, 'id' AS column_name, 'INT64' AS type,
       true AS not_null, true AS is_pk, false AS is_unique, true AS auto_increment FROM part
UNION ALL
SELECT 't' || p_partkey, 1, 'price', 'DECIMAL(' || (p_size % 20 + 10) || ',2)', true, false, false, false FROM part
UNION ALL
SELECT 't' || p_partkey, 2, 'label', 'TEXT', false, false, true, false FROM part
UNION ALL
SELECT 't' || p_partkey, 3, 'live', CASE WHEN p_size % 2 = 0 THEN 'BOOL' ELSE 'INT64' END, false, false, false, false FROM part
""",
)
def mysql_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CREATE TABLE per part, with types that depend on it."""
    text = F.format_string(
        "CREATE TABLE `t%d` (\n  `id` int(11) NOT NULL AUTO_INCREMENT,\n"
        "  `price` decimal(%d,2) unsigned NOT NULL DEFAULT '0.00',\n  `label` varchar(%d) DEFAULT NULL,\n"
        "  `live` tinyint(%d),\n  PRIMARY KEY (`id`),\n  UNIQUE KEY `u` (`label`),\n"
        "  KEY `k` (`price`,`label`)\n) ENGINE=InnoDB",
        F.col("p_partkey"),
        F.col("p_size") % 20 + 10,
        F.col("p_size"),
        F.col("p_size") % 2 + 1,
    )
    statements = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dump"), text.alias("statement"))
    return _declared(ddl.mysql_schema(statements)[0])


@query(
    "a9_pg_ddl",
    """
SELECT 'T' || p_partkey AS table_name, 0::BIGINT AS pos, 'id' AS column_name, 'INT64' AS type,
       true AS not_null, true AS is_pk, false AS is_unique, false AS auto_increment FROM part
UNION ALL
SELECT 'T' || p_partkey, 1, 'Price', 'DECIMAL(' || (p_size % 20 + 10) || ',2)', true, false, false, false FROM part
UNION ALL
SELECT 'T' || p_partkey, 2, 'at', 'TEXT', false, false, true, false FROM part
""",
)
def pg_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string(
        'CREATE TABLE public."T%d" (\n    id bigint NOT NULL,\n    "Price" numeric(%d,2) DEFAULT 0 NOT NULL,\n'
        "    at timestamp without time zone,\n    CONSTRAINT c CHECK ((id > 0))\n);\n"
        'ALTER TABLE ONLY public."T%d"\n    ADD CONSTRAINT pk PRIMARY KEY (id);\n'
        'CREATE UNIQUE INDEX u ON public."T%d" USING btree (at);',
        F.col("p_partkey"),
        F.col("p_size") % 20 + 10,
        F.col("p_partkey"),
        F.col("p_partkey"),
    )
    lines = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("dump"),
        F.col("p_partkey").alias("block"),
        F.posexplode(F.split(text, "\n")).alias("pos", "value"),
    )
    return _declared(ddl.pg_schema(lines)[0])


@query(
    "a10_counts_mysqldump",
    "SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders",
)
def mysql_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "orders")}
    return MysqlDump(spark, encode.write_mysqldump(tables, shared_folder(spark, "mysql"))).counts()


@query("a10_counts_mysqlshell", "SELECT 'shop.events' AS table_name, count(*) AS n FROM events")
def shell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").repartition(5)
    return MysqlShellDump(spark, encode.write_mysqlshell("shop", "events", events, shared_folder(spark, "shell"))).counts()


@query(
    "a11_perf_items",
    """
SELECT n AS id, TIMESTAMP '2020-01-01' + to_seconds(n) AS created_at,
       ['alpha','bravo','charlie','delta','echo','foxtrot','golf','hotel','india','juliet'][n % 10 + 1] AS category,
       (n % 1000)::INTEGER AS score, 'payload-' || n || '-' || repeat('x', 64) AS payload
FROM (SELECT unnest(generate_series(1, (SELECT count(*) FROM orders))) AS n)
""",
)
def perf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many generated rows as there are orders."""
    return perf_items(spark, table(spark, sf_dir, "orders").count())


@query(
    "b5_b6_load_report",
    """
SELECT 'nation' AS table_name, count(*) AS rows_read, count(*) AS rows_loaded, 0::BIGINT AS rows_rejected FROM nation
UNION ALL SELECT 'customer', count(*), count(*), 0 FROM customer
UNION ALL SELECT 'part', count(*), count(*), 0 FROM part
""",
)
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in ("nation", "customer", "part")}
    path = encode.write_mysqldump(tables, shared_folder(spark, "mysql"))
    result = load(spark, path, shared_folder(spark, "loaded"))
    return result.report.select("table_name", "rows_read", "rows_loaded", "rows_rejected")


@query(
    "b5_load_staged",
    """
SELECT 'region' AS table_name, r_regionkey::BIGINT AS r_regionkey, r_name FROM region
UNION ALL BY NAME
SELECT 'nation' AS table_name, n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation
UNION ALL BY NAME
SELECT 'customer' AS table_name, c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer
UNION ALL BY NAME
SELECT 'supplier' AS table_name, s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier
UNION ALL BY NAME
SELECT 'orders' AS table_name, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders
""",
)
def load_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and column of five tables; columns of the other tables are null."""
    path = encode.write_pgdump({n: table(spark, sf_dir, n) for n in MANY}, shared_folder(spark, "pg"))
    result = load(spark, path, shared_folder(spark, "loaded"))
    rows = [result.table(n).select(F.lit(n).alias("table_name"), "*") for n in MANY]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def _damaged_lines(spark: SparkSession, sf_dir: str, after: str = "") -> str:
    """A COPY dump where every 10th customer lacks a field and every 9th has a broken number."""
    c = table(spark, sf_dir, "customer")
    mark = F.when(F.col("c_custkey") % 9 == 4, "#").otherwise("")
    lines = c.select(
        F.concat_ws(
            "\t", F.concat(mark, "c_custkey"), "c_name", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment"))
        ).alias("value")
    )
    folder = shared_folder(spark, "pg")
    create = "CREATE TABLE public.customer (\n    id bigint,\n    name text,\n    segment text\n);"
    spark.createDataFrame([(create + after,)], "value string").write.text(f"{folder}/schema")
    encode.framed(lines, ["COPY public.customer (id, name, segment) FROM stdin;"], ["\\."]).write.text(f"{folder}/rows")
    return f"{folder}/*/*.txt"


@query(
    "b7_rejects",
    """
SELECT reason, dropped, count(*) AS n FROM (
  SELECT CASE WHEN c_custkey % 10 = 0 THEN 'expected 3 fields, got 2' ELSE 'does not fit: id' END AS reason,
         c_custkey % 10 = 0 AS dropped
  FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 9 = 4)
GROUP BY ALL
""",
)
def reject_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = load(spark, _damaged_lines(spark, sf_dir), shared_folder(spark, "loaded"), fmt="pg_dump")
    return load_rejects(spark, result).groupBy("reason", "dropped").agg(F.count("*").alias("n"))


@query(
    "b6_k5_report_sorted",
    """
SELECT count(*) AS rows_read, count(*) FILTER (c_custkey % 10 <> 0) AS rows_loaded,
       count(*) FILTER (c_custkey % 10 = 0) AS rows_rejected FROM customer
""",
)
def sorted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laid out by an index in descending order, with rejects."""
    path = _damaged_lines(spark, sf_dir, "\nCREATE INDEX by_id ON public.customer USING btree (id DESC NULLS LAST);")
    result = load(spark, path, shared_folder(spark, "loaded"), fmt="pg_dump", sort_by_index=True)
    return result.report.select("rows_read", "rows_loaded", "rows_rejected")


@query(
    "d5_arity_filter",
    """
SELECT CASE WHEN c_custkey % 9 <> 4 THEN c_custkey END AS id, c_name AS name, c_mktsegment AS segment
FROM customer WHERE c_custkey % 10 <> 0
""",
)
def arity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pgdump(spark, _damaged_lines(spark, sf_dir), "customer")


@query(
    "c9_sqlite_bool",
    """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN true END AS flag,
       o_orderkey % 4 = 2 AS rejected
FROM orders
""",
)
def sqlite_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 and 1 are booleans, null stays null, 2 is neither and is reported."""
    k = F.col("o_orderkey") % 4
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k < 3, k.cast("int")).alias("flag"))
    folder = shared_folder(spark, "sqlite")
    path = encode.write_sqlite("orders", orders, folder, declared={"flag": "BOOLEAN"})
    rows = SqliteDump(spark, path, 4_000).rows("orders")
    return rows.withColumn("rejected", F.col(REASON).isNotNull()).drop(DUMP, RAW, REASON, DROPPED)


@query(
    "d4_skip_lines",
    """
SELECT 'INSERT ' || s_suppkey AS statement FROM supplier WHERE s_suppkey % 7 = 6
""",
)
def skip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    openings = ["LOCK TABLES ", "UNLOCK TABLES ", "DROP TABLE ", "SET ", "-- ", "/*!40000 ", "INSERT "]
    opening = F.get(F.array(*map(F.lit, openings)), (F.col("s_suppkey") % 7).cast("int"))
    statements = table(spark, sf_dir, "supplier").select(F.concat(opening, F.col("s_suppkey").cast("string")).alias("statement"))
    return statements.filter(~skippable(F.col("statement")))
