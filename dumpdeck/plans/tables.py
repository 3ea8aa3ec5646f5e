"""Queries over the table operators: export, paging, audits, changes, history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpdeck import encode
from dumpdeck.functions.sqltext import total_time
from dumpdeck.operators import audit, changes, export, history, layout, load, lookup, page
from dumpdeck.plans.registry import ORACLES, query, table, views
from dumpdeck.session import shared_folder

# Customers with commas, quotes and nulls, in SQL and as a DataFrame.
SPECIAL = """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || ', Inc' WHEN 1 THEN 'the "' || c_name || '"' ELSE c_name END AS c_name,
       CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment, c_custkey % 2 = 0 AS even FROM customer
"""


def _special(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(k % 3 == 0, F.concat("c_name", F.lit(", Inc")))
        .when(k % 3 == 1, F.concat(F.lit('the "'), "c_name", F.lit('"')))
        .otherwise(F.col("c_name"))
        .alias("c_name"),
        F.when(k % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        (k % 2 == 0).alias("even"),
    )


@query(
    "b1_csv_fields",
    f"""
SELECT c_custkey || ',' || CASE WHEN contains(c_name, ',') OR contains(c_name, '"')
         THEN '"' || replace(c_name, '"', '""') || '"' ELSE c_name END
       || ',' || coalesce(c_mktsegment, '') || ',' || even AS line
FROM ({SPECIAL})
""",
)
def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark, 'csv')}/out"
    export.write_csv(_special(spark, sf_dir), path, header=False)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "b1_csv_orders",
    """
SELECT o_orderkey || ',' || CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR
         ELSE o_totalprice::VARCHAR END || ',' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS line
FROM orders
""",
)
def csv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark, 'csv')}/out"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    export.write_csv(orders, path, header=False)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "b2_json_lines",
    f"""
SELECT '{{"c_custkey":' || c_custkey || ',"c_name":"' || replace(c_name, '"', '\\"') || '","c_mktsegment":'
       || coalesce('"' || c_mktsegment || '"', 'null') || ',"even":' || even || '}}' AS line
FROM ({SPECIAL})
""",
)
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark, 'json')}/out"
    export.write_json(_special(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("b2_json_array", SPECIAL)
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part file is one JSON array."""
    path = f"{shared_folder(spark, 'json')}/out"
    special = _special(spark, sf_dir)
    export.write_json_array(special.repartition(4), path)
    return spark.read.schema(special.schema).json(path, multiLine=True)


@query(
    "b2_json_types",
    """
SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       o_totalprice / 8 AS eighth, base64(encode(o_orderpriority)) AS priority,
       CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END AS price_text
FROM orders
""",
)
def json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array over seven parts; read back from the parts joined by the manifest, number text included."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        "o_orderdate",
        (F.col("o_totalprice") / 8).alias("eighth"),
        F.col("o_orderpriority").cast("binary").alias("priority"),
    )
    path = f"{shared_folder(spark, 'json')}/out"
    manifest = export.write_json_parts(orders.repartition(7), path)
    # A line of a part after its first brings its comma; the first line of the whole array has none.
    lines = spark.read.text(f"{path}/rows").select("value", F.col("_metadata.file_name").alias("file"))
    framed = lines.join(F.broadcast(manifest), "file").withColumn("json", F.ltrim("value", F.lit(",")))
    text = F.regexp_extract("json", r'"o_totalprice":([^,]*)', 1)
    row = F.from_json("json", "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string, eighth double, priority string")
    return framed.select(row.alias("row"), text.alias("price_text")).select("row.*", "price_text")


@query(
    "b3_tsv_rows",
    f"SELECT c_custkey || chr(9) || c_name || chr(9) || coalesce(c_mktsegment, '') || chr(9) || even AS line FROM ({SPECIAL})",
)
def tsv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark, 'tsv')}/out"
    export.write_tsv(_special(spark, sf_dir), path, header=False)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "b4_quoted_rows",
    f"""
SELECT '"' || c_custkey || '","' || replace(c_name, '"', '""') || '","' || coalesce(c_mktsegment, '')
       || '","' || even || '"' AS line FROM ({SPECIAL})
""",
)
def quoted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark, 'csv')}/out"
    export.write_csv(_special(spark, sf_dir), path, header=False, quote_all=True)
    return spark.read.text(path).withColumnRenamed("value", "line")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a query history: user = database, event type = SQL text."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.when(F.col("event_id") % 2 == 0, "DB").otherwise("db"), "user_id").alias("database_path"),
        F.col("event_type").alias("sql"),
        F.col("ts").alias("executed_at"),
        "event_id",
    )


@query(
    "d1_history_search",
    """
SELECT event_id, 'db7' AS database, event_type AS sql FROM events WHERE user_id = 7 AND contains(event_type, 'c')
""",
)
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.search(_runs(spark, sf_dir), "Db7", "C")
    return found.select("event_id", F.lower("database_path").alias("database"), "sql")


# Searches over documents as a log: a database in another case or none, and a term.
SEARCHES = [("SRC7", "Tion"), (None, "schkeit"), (None, "e, "), (None, "q"), ("src1", None), (None, "no such text")]


@query(
    "d1_indexed_search",
    " UNION ALL ".join(
        f"SELECT {n} AS search, doc_id, source FROM documents WHERE source IS NOT NULL"
        + (f" AND lower(source) = '{database.lower()}'" if database else "")
        + (f" AND contains(lower(text), '{term.lower()}')" if term else "")
        for n, (database, term) in enumerate(SEARCHES)
    ),
)
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram postings over all documents give what reading all texts gives."""
    log = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.col("source").alias("database_path"), F.col("text").alias("sql"),
        F.col("doc_id").alias("executed_at"),
    )
    path = shared_folder(spark, "search")
    lookup.write_search_index(log, path, parts=8)
    found = [
        lookup.search_index(spark, path, *s).select(F.lit(n).alias("search"), "doc_id", "source")
        for n, s in enumerate(SEARCHES)
    ]
    return reduce(DataFrame.unionByName, found)


@query(
    "d2_prefix",
    "SELECT p_partkey, p_name AS name FROM part WHERE starts_with(lower(p_name), 'sm')",
)
def prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    return history.starts_with(parts, "SM")


@query(
    "g1_history_topn",
    """
WITH latest AS (
  SELECT user_id, event_type, ts, event_id,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM latest WHERE r = 1)
SELECT 'db' || user_id AS database, event_type AS sql, event_id, rank::INTEGER AS rank FROM ranked WHERE rank <= 3
""",
)
def history_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = history.retain(_runs(spark, sf_dir), keep=3, tie="event_id")
    return kept.select(F.lower("database_path").alias("database"), "sql", "event_id", "rank")


@query("g1_incremental", ORACLES["g1_history_topn"])
def history_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, merged one after the other, give what all runs at once give."""
    runs = _runs(spark, sf_dir)
    kept = history.Retained(shared_folder(spark, "history"), keep=3, tie="event_id")
    for n in range(3):
        kept.update(runs.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == n), n)
    return kept.rows(spark).select(F.lower("database_path").alias("database"), "sql", "event_id", "rank")


@query(
    "g2_mru",
    """
SELECT lower(event_type) || (event_id % 7) AS path, max(ts) AS used_at FROM events
GROUP BY lower(event_type) || (event_id % 7) ORDER BY used_at DESC, path LIMIT 10
""",
)
def most_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        F.concat("event_type", F.col("event_id") % 7).alias("path"), F.col("ts").alias("used_at")
    )
    return history.recent(log)


@query(
    "h5_prefix_topk",
    """
SELECT name, priority FROM (
  SELECT DISTINCT p_name AS name, 100::INTEGER AS priority FROM part WHERE starts_with(lower(p_name), 's')
  UNION ALL
  SELECT DISTINCT 's' || p_size, 200 FROM part)
ORDER BY priority DESC, name LIMIT 100
""",
)
def ranked_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name"), F.lit("column").alias("kind")).distinct()
    keys = part.select(F.concat(F.lit("s"), "p_size").alias("name"), F.lit("primary key").alias("kind")).distinct()
    entries = history.with_priority(names.unionByName(keys))
    return history.prefix_top(entries, "S").select("name", "priority")


# Prefixes looked up in the catalog of urls, parts and document words.
PREFIXES = ["HTTP", "s", "Th", "cold W", "http://therwh.example.org/es/12?", "zzzz", ""]
CATALOG = """
SELECT url AS name, (page_id % 7 * 10)::INTEGER AS priority FROM pages WHERE url IS NOT NULL
UNION ALL SELECT p_name, 100 FROM part
UNION ALL SELECT w, 90 FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)
"""


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("name"), (F.col("page_id") % 7 * 10).cast("int").alias("priority"))
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lit(100).alias("priority"))
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("name"), F.lit(90).alias("priority"))
    return urls.unionByName(parts).unionByName(words)


def _looked_up(spark: SparkSession, sf_dir: str, look) -> DataFrame:
    path = f"{shared_folder(spark, 'names')}/blocks"
    lookup.write_dictionary(_catalog(spark, sf_dir), path, parts=8)
    found = [look(spark, path, p).select(F.lit(p).alias("prefix"), "name", "priority") for p in PREFIXES]
    return reduce(DataFrame.unionByName, found)


@query(
    "h5_dictionary",
    f"WITH catalog AS ({CATALOG}) "
    + " UNION ALL ".join(
        f"(SELECT '{p}' AS prefix, name, priority FROM catalog WHERE starts_with(lower(name), '{p.lower()}')"
        " ORDER BY priority DESC, name LIMIT 100)"
        for p in PREFIXES
    ),
)
def dictionary_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first names of each prefix, from front-coded blocks."""
    return _looked_up(spark, sf_dir, lookup.dictionary_top)


@query(
    "d2_dictionary",
    f"WITH catalog AS ({CATALOG}) SELECT prefix, name, priority, count(*) AS times FROM catalog, "
    f"(VALUES {', '.join(f'({p!r})' for p in PREFIXES)}) AS v(prefix) "
    "WHERE starts_with(lower(name), lower(prefix)) GROUP BY ALL",
)
def dictionary_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of each prefix, from the same blocks, with how often the catalog has them."""
    rows = _looked_up(spark, sf_dir, lookup.dictionary_names)
    return rows.groupBy("prefix", "name", "priority").agg(F.count("*").alias("times"))


@query(
    "e1_fk_orphans",
    """
SELECT o_orderkey, o_custkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING')
""",
)
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return audit.orphans(orders, ["o_custkey"], parents, ["c_custkey"])


@query(
    "e1_fk_orphan_keys",
    """
SELECT l_partkey, count(*) AS n FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10) GROUP BY l_partkey
""",
)
def fk_orphan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "part").filter("p_size > 10")
    return audit.orphan_keys(table(spark, sf_dir, "lineitem"), ["l_partkey"], parents, ["p_partkey"])


@query(
    "k1_nulls",
    """
SELECT 'c_custkey' AS column_name, count(*) FILTER (c_custkey IS NULL) AS nulls FROM customer
UNION ALL SELECT 'c_name', count(*) FILTER (c_name IS NULL) FROM customer
UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_custkey % 5 = 0) FROM customer
UNION ALL SELECT 'even', count(*) FILTER (c_custkey % 2 IS NULL) FROM customer
""",
)
def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.null_counts(_special(spark, sf_dir))


@query(
    "k2_pk_duplicates",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.primary_key_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("k3_unique", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.unique_violations(table(spark, sf_dir, "part"), ["p_name"])


@query(
    "k4_fk_declared",
    """
SELECT 'd' || s_nationkey AS dump, 't' || s_suppkey AS table_name, 'missing table' AS problem, 'ref -> gone' AS detail
FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL
SELECT 'd' || s_nationkey, 't' || s_suppkey, 'several targets', 'ref' FROM supplier WHERE s_suppkey % 3 = 0
""",
)
def fk_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier declares a table; each third one points twice from one column, once to nowhere."""
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("d"), "s_nationkey").alias("dump"), F.concat(F.lit("t"), "s_suppkey").alias("table_name"), "s_suppkey"
    )
    targets = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.col("table_name"), F.lit("gone"))).otherwise(
        F.array("table_name")
    )
    rules = s.select(
        "dump",
        "table_name",
        F.lit("fk").alias("kind"),
        F.array(F.lit("ref")).alias("columns"),
        F.explode(targets).alias("ref_table"),
    )
    return audit.declared_fk_problems(s, rules)


@query(
    "k5_layout_plan",
    """
SELECT 'd' || s_nationkey AS dump, 't' || s_suppkey AS table_name, 'ix' AS name,
       CASE WHEN s_suppkey % 3 = 0 THEN 'a' END AS column_name, s_suppkey % 3 = 0 AS kept,
       CASE s_suppkey % 3 WHEN 1 THEN 'composite index' WHEN 2 THEN 'expression index' END AS reason
FROM supplier
""",
)
def layout_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    columns = F.when(k == 0, F.array(F.lit("a"))).when(k == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(
        F.array(F.lit("lower(a)"))
    )
    rules = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("d"), "s_nationkey").alias("dump"),
        F.concat(F.lit("t"), "s_suppkey").alias("table_name"),
        F.lit("index").alias("kind"),
        F.lit("ix").alias("name"),
        columns.alias("columns"),
    )
    return layout.plan_layout(rules).drop("kind")


@query(
    "k4_declared_audit",
    """
SELECT 'orders' AS table_name, 'pk' AS kind, 'o_orderkey' AS columns, 0::BIGINT AS violations FROM region WHERE r_regionkey = 0
UNION ALL
SELECT 'orders', 'fk', 'o_custkey', (SELECT count(*) FROM orders WHERE o_custkey % 10 = 3) FROM region WHERE r_regionkey = 0
UNION ALL
SELECT 'orders', 'unique', 'o_totalprice',
       (SELECT count(*) FROM (SELECT o_totalprice FROM orders GROUP BY o_totalprice HAVING count(*) > 1)) FROM region WHERE r_regionkey = 0
UNION ALL
SELECT 'orders', 'not_null', 'o_orderkey', 0 FROM region WHERE r_regionkey = 0
UNION ALL
SELECT 'customer', 'pk', 'c_custkey', 0 FROM region WHERE r_regionkey = 0
UNION ALL
SELECT 'customer', 'not_null', 'c_custkey', 0 FROM region WHERE r_regionkey = 0
UNION ALL
SELECT 'customer', 'not_null', 'c_mktsegment', (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 10 <> 3)
FROM region WHERE r_regionkey = 0
""",
)
def declared_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load two tables with declared rules, some of which their rows break, and check them all."""
    customers = _special(spark, sf_dir).filter("c_custkey % 10 <> 3").drop("even")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    rules = [
        "ALTER TABLE ONLY public.customer",
        "    ADD CONSTRAINT c_pk PRIMARY KEY (c_custkey);",
        "ALTER TABLE ONLY public.orders ADD CONSTRAINT o_pk PRIMARY KEY (o_orderkey);",
        "ALTER TABLE ONLY public.orders",
        "    ADD CONSTRAINT o_fk FOREIGN KEY (o_custkey) REFERENCES public.customer(c_custkey);",
        "CREATE UNIQUE INDEX o_price ON public.orders USING btree (o_totalprice);",
        "CREATE INDEX o_cust ON public.orders USING btree (o_custkey);",
    ]
    dump = {"customer": customers, "orders": orders}
    path = encode.write_pgdump(dump, shared_folder(spark, "pg"), rules, required={"c_mktsegment"})
    result = load.load(spark, path, shared_folder(spark, "loaded"), fmt="pg_dump", sort_by_index=True)
    tables = {name: result.table(name) for name in result.targets}
    return audit.check_declared(tables, result.columns, result.constraints)


RULES = [
    ("orders", "pk", ["o_orderkey"], None, None),
    ("orders", "unique", ["o_custkey", "o_totalprice"], None, None),
    ("orders", "fk", ["o_custkey"], "customer", ["c_custkey"]),
    ("orders", "fk", ["o_orderkey"], "part", ["p_partkey"]),
    ("lineitem", "pk", ["l_orderkey", "l_linenumber"], None, None),
    ("lineitem", "pk", ["l_partkey"], None, None),
    ("lineitem", "unique", ["l_shipdate"], None, None),
    ("lineitem", "fk", ["l_orderkey"], "orders", []),
    ("lineitem", "fk", ["l_suppkey"], "customer", ["c_custkey"]),
    ("lineitem", "fk", ["l_partkey"], "supplier", ["s_suppkey"]),
    ("customer", "fk", ["c_nationkey"], "nation", ["n_nationkey"]),
    ("nation", "fk", ["n_nationkey"], "region", ["r_regionkey"]),
    ("documents", "unique", ["text"], None, None),
    ("documents", "pk", ["source", "lang"], None, None),
]
LOOKED_AT = ["orders", "lineitem", "customer", "nation", "region", "part", "supplier", "documents"]


def _rule_sql() -> str:
    parts = []
    for table_, kind, keys, ref, ref_keys in RULES:
        listed, present = ", ".join(keys), " AND ".join(f"{k} IS NOT NULL" for k in keys)
        if kind == "fk":
            same = " AND ".join(f"r.{b} = c.{a}" for a, b in zip(keys, ref_keys or ["o_orderkey"]))
            bad = f"SELECT count(*) FROM {table_} c WHERE {present} AND NOT EXISTS (SELECT 1 FROM {ref} r WHERE {same})"
        else:
            where = f"WHERE {present}" if kind == "unique" else ""
            broken = "" if kind == "unique" else f" OR NOT ({present})"
            bad = f"SELECT count(*) FROM (SELECT {listed}, count(*) AS n FROM {table_} {where} GROUP BY {listed}) WHERE n > 1{broken}"
        parts.append(f"SELECT '{table_}' AS table_name, '{kind}' AS kind, '{','.join(keys)}' AS columns, ({bad})::BIGINT AS violations")
    return "\nUNION ALL\n".join(parts)


@query("e1_rule_set", _rule_sql())
def rule_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and references of eight tables at once, kept and broken ones."""
    layout = "dump string, table_name string, kind string, name string, columns array<string>, ref_table string, ref_columns array<string>"
    rules = spark.createDataFrame([("d", t, k, f"r{i}", c, r, rc) for i, (t, k, c, r, rc) in enumerate(RULES)], layout)
    columns = spark.createDataFrame([], "dump string, table_name string, column_name string, not_null boolean")
    return audit.check_declared({t: table(spark, sf_dir, t) for t in LOOKED_AT}, columns, rules)


@query("k5_layout", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def sorted_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark, 'sorted')}/orders"
    layout.write_sorted(table(spark, sf_dir, "orders"), path, "o_custkey")
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "m1_profile",
    """
SELECT 'o_orderkey' AS column_name, count(*) AS rows, 0::BIGINT AS nulls, count(DISTINCT o_orderkey) AS distincts,
       max(length(o_orderkey::VARCHAR))::INTEGER AS max_length, 'bigint' AS data_type FROM orders
UNION ALL
SELECT 'o_custkey', count(*), 0, count(DISTINCT o_custkey), max(length(o_custkey::VARCHAR)), 'bigint' FROM orders
UNION ALL
SELECT 'o_orderpriority', count(*), 0, count(DISTINCT o_orderpriority), max(length(o_orderpriority)), 'string' FROM orders
""",
)
def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return audit.profile(orders, exact=True)


@query("h1_first_page", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 500")
def first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return page.first_page(spark, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey;").rows


@query("h1_own_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 700")
def own_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return page.first_page(spark, "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 700").rows


@query("h2_offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 300")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return page.offset_page(orders, ["o_orderkey"], 300, 100)


@query(
    "h2_deep_offset_page",
    "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100 OFFSET 10000",
)
def deep_offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return page.offset_page(orders, ["o_custkey", "o_orderkey"], 10_000, 100, shallow=1_000)


@query(
    "h2_tied_offset_page",
    """
SELECT l_returnflag, count(*) AS n FROM (
  SELECT l_returnflag FROM lineitem ORDER BY l_returnflag LIMIT 700 OFFSET (SELECT count(*) // 3 FROM lineitem))
GROUP BY l_returnflag
""",
)
def tied_offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page inside a key that holds a third or more of all rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    rows = page.offset_page(lines, ["l_returnflag"], lines.count() // 3, 700, shallow=2_000)
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(
    "h3_keyset_page",
    """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE (o_custkey, o_orderkey) > (70, 5000)
ORDER BY o_custkey, o_orderkey LIMIT 200
""",
)
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return page.keyset_page(orders, ["o_custkey", "o_orderkey"], 200, after=[70, 5000])


@query("h4_ordering", "SELECT false AS ordered, true AS limited, count(*) AS n FROM (SELECT 1 FROM orders LIMIT 500)")
def ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    first = page.first_page(spark, "SELECT o_orderkey FROM orders")
    return first.rows.agg(
        F.lit(first.ordered).alias("ordered"), F.lit(first.default_limit_applied).alias("limited"), F.count("*").alias("n")
    )


@query("h6_preview", "SELECT count(*) AS n FROM (SELECT 1 FROM orders LIMIT 100)")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows a preview shows is not defined, only how many."""
    return page.preview(table(spark, sf_dir, "orders")).agg(F.count("*").alias("n"))


@query(
    "h7_all_pages",
    """
SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS row_no,
       (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) // 500 AS page_no FROM orders
""",
)
def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    numbered = page.number_pages(orders, ["o_custkey", "o_orderkey"], f"{shared_folder(spark, 'pages')}/orders")
    return numbered.select("o_orderkey", "row_no", "page_no")


@query(
    "j1_insert",
    """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
UNION ALL SELECT c_custkey + 1000000, c_name, NULL, c_acctbal FROM customer
""",
)
def insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1_000_000).alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"), F.col("c_name").alias("s_name")
    )
    return changes.insert(table(spark, sf_dir, "supplier"), rows)


@query(
    "j2_update",
    """
SELECT c_custkey, c_name, c_nationkey,
       CASE WHEN n IS NULL THEN c_acctbal WHEN n % 2 = 0 THEN n::DOUBLE END AS c_acctbal, c_mktsegment
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey)
  ON o_custkey = c_custkey
""",
)
def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New balances from order counts; odd counts set the balance to null."""
    counted = (
        table(spark, sf_dir, "orders")
        .filter("o_totalprice > 100000")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n"))
    )
    new = counted.select("c_custkey", F.when(F.col("n") % 2 == 0, F.col("n").cast("double")).alias("c_acctbal"))
    return changes.update(table(spark, sf_dir, "customer"), new, ["c_custkey"])


@query(
    "j3_delete",
    """
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
""",
)
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return changes.delete(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), gone, ["c_custkey"])


@query(
    "f1_counts",
    """
SELECT lang AS table_name, count(*) AS n FROM documents GROUP BY lang
""",
)
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("table_name")).agg(F.count("*").alias("n"))


@query(
    "f2_rollup",
    "SELECT event_type AS table_name, count(*) AS n FROM events GROUP BY ROLLUP (event_type)",
)
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").rollup(F.col("event_type").alias("table_name")).agg(F.count("*").alias("n"))


@query(
    "f3_total_time",
    """
SELECT l_returnflag, count(*) AS runs, sum(ms)::BIGINT AS total_ms, max(ms)::BIGINT AS slowest_ms FROM (
  SELECT l_returnflag, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END, 0) + l_suppkey
         + coalesce(CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey END, 0) AS ms FROM lineitem)
GROUP BY l_returnflag
""",
)
def run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as runs: part key = database ms (known for even lines), supplier key = fetch ms."""
    ms = total_time(
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")),
        F.col("l_suppkey"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("l_orderkey")),
    )
    runs = table(spark, sf_dir, "lineitem").select("l_returnflag", ms.alias("ms"))
    return runs.groupBy("l_returnflag").agg(
        F.count("*").alias("runs"), F.sum("ms").alias("total_ms"), F.max("ms").alias("slowest_ms")
    )
