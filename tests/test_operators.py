import datetime as dt
import json
import warnings

import pytest
from pyspark.sql import functions as F

from dumpdeck.operators import audit, changes, export, history, layout, load, page
from dumpdeck.sources.perf import perf_items


@pytest.fixture
def items(spark):
    rows = [(1, "Item 1", 10.5), (2, "Item 2", 20.0), (3, "Item 3", 30.25), (4, "Item 4", 40.75), (5, "Item 5", 50.0)]
    df = spark.createDataFrame(rows, "id long, name string, value double")
    df.createOrReplaceTempView("test_items")
    return df


def ids(df):
    return [r.id for r in df.collect()]


def test_first_page(spark, items):
    first = page.first_page(spark, "SELECT * FROM test_items ORDER BY id", 2)
    assert ids(first.rows) == [1, 2] and first.default_limit_applied and first.ordered
    free = page.first_page(spark, "SELECT * FROM test_items ORDER BY id;", 2, default_limit=False)
    assert len(ids(free.rows)) == 5 and not free.default_limit_applied
    own = page.first_page(spark, "SELECT * FROM test_items ORDER BY id LIMIT 3", 2)
    assert ids(own.rows) == [1, 2, 3] and not own.default_limit_applied
    inner = page.first_page(spark, "SELECT * FROM (SELECT * FROM test_items ORDER BY id LIMIT 4) ORDER BY id", 2)
    assert ids(inner.rows) == [1, 2] and inner.default_limit_applied
    with_cte = page.first_page(spark, "WITH t AS (SELECT * FROM test_items) SELECT * FROM t ORDER BY id LIMIT 4", 2)
    assert ids(with_cte.rows) == [1, 2, 3, 4] and not with_cte.default_limit_applied
    named = page.first_page(spark, "SELECT id, 1 AS credit_limit FROM test_items ORDER BY id", 2)
    assert ids(named.rows) == [1, 2]
    assert ids(page.first_page(spark, "SELECT * FROM test_items WHERE id > 1000 ORDER BY id").rows) == []


def test_ordering_warning(spark, items):
    with pytest.warns(UserWarning, match="ORDER BY"):
        page.first_page(spark, "SELECT * FROM test_items")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        page.first_page(spark, "SELECT name FROM test_items ORDER BY id")


def test_sql_scan(spark, items):
    assert page.sql_scan(spark, " SELECT * FROM test_items ;\n").count() == 5
    with pytest.raises(ValueError):
        page.sql_scan(spark, " ; ")


def test_offset_and_keyset(spark, items):
    assert ids(page.offset_page(items, ["id"], 2, 2)) == [3, 4]
    assert ids(page.keyset_page(items, ["id"], 2, after=[3])) == [4, 5]
    got = page.fetch_page(items, ["id"], 5)
    assert len(got.rows) == 5 and got.next_after is None
    assert page.fetch_page(items, ["id"], 2).next_after == [2]
    rows, after = page.fetch_offset_page(items, ["id"], 0, 3)
    assert [r.id for r in rows] == [1, 2, 3] and after == 3
    rows, after = page.fetch_offset_page(items, ["id"], 3, 2)
    assert [r.id for r in rows] == [4, 5] and after is None


@pytest.fixture
def hundred(spark):
    # A third of the rows share the leading key.
    return spark.range(1, 1001).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("g"))


def test_all_pages(spark, hundred, tmp_path):
    pages = list(page.iterate_pages(hundred, ["g", "id"], 300))
    assert [len(p) for p in pages] == [300, 300, 300, 100]
    expect = sorted((r.g, r.id) for r in hundred.collect())
    assert [(r.g, r.id) for p in pages for r in p] == expect
    numbered = page.number_pages(hundred, ["g", "id"], str(tmp_path / "pages"), 10).orderBy("row_no").collect()
    assert [(r.g, r.id) for r in numbered] == expect
    assert [r.row_no for r in numbered] == list(range(1000)) and [r.page_no for r in numbered] == [i // 10 for i in range(1000)]


@pytest.mark.parametrize("offset", [0, 95, 334, 500, 995, 999, 1000, 2000])
def test_deep_offset(hundred, offset):
    expect = sorted((r.g, r.id) for r in hundred.collect())
    got = page.offset_page(hundred, ["g", "id"], offset, 7, shallow=20).collect()
    assert [(r.g, r.id) for r in got] == expect[offset : offset + 7]


def test_pages_with_null_keys(spark):
    rows = [(None if i % 3 else i // 30, None if i % 7 == 0 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, id int").withColumn("n", F.expr("uuid()")).cache()
    for keys in (["g", "id", "n"], ["id", "n"], ["id"]):
        order = [tuple(r)[: len(keys)] for r in df.select(*keys).orderBy(*keys).collect()]
        for offset in (0, 25, 37, 150, 290):
            got = page.offset_page(df, keys, offset, 7, shallow=20).select(*keys).collect()
            assert [tuple(r) for r in got] == order[offset : offset + 7]
    keys, order = ["g", "id", "n"], [tuple(r) for r in df.orderBy("g", "id", "n").collect()]
    assert [tuple(r) for p in page.iterate_pages(df, keys, 90) for r in p] == order
    df.unpersist()


def test_csv(spark, tmp_path):
    rows = [
        ("Hello, World", True, 1.0, dt.datetime(2024, 1, 15, 10, 30), b"AB"),
        ('Say "hello"', False, 12345678.5, None, None),
        ("two\nlines", None, 1e20, None, None),
        (" pad\t", None, 0.00001, None, None),
        (None, None, None, None, None),
        ("", None, -0.5, None, None),
    ]
    df = spark.createDataFrame(rows, "t string, b boolean, d double, ts timestamp_ntz, x binary").coalesce(1)
    export.write_csv(df, str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv").glob("part-*")
    assert file.read_text().split("\n", 1)[0] == "t,b,d,ts,x"
    assert file.read_text().split("\n", 1)[1] == (
        '"Hello, World",true,1,2024-01-15 10:30:00,QUI=\n"Say ""hello""",false,12345678.5,,\n"two\nlines",,1E+20,,\n'
        " pad\t,,1E-05,,\n,,,,\n,,-0.5,,\n"
    )
    export.write_csv(df.select("ts", "t").limit(1), str(tmp_path / "day"), header=False, timestamps="yyyy-MM-dd")
    (file,) = (tmp_path / "day").glob("part-*")
    assert file.read_text() == '2024-01-15,"Hello, World"\n'
    export.write_csv(df.select("t", "b"), str(tmp_path / "all"), quote_all=True)
    (file,) = (tmp_path / "all").glob("part-*")
    assert file.read_text().splitlines()[0] == '"t","b"' and '"Say ""hello""","false"' in file.read_text()
    assert '"",""' in file.read_text()
    same = [r.value for r in export.quoted_lines(df.select("t", "b")).collect()]
    assert file.read_text() == '"t","b"\n' + "".join(v + "\n" for v in same)


def test_tsv_and_json(spark, tmp_path):
    rows = [(1, "Alice", None, dt.datetime(2024, 1, 15)), (2, 'B"ob', b"AB", None)]
    df = spark.createDataFrame(rows, "id long, name string, x binary, at timestamp_ntz").coalesce(1)
    export.write_tsv(df, str(tmp_path / "tsv"))
    (file,) = (tmp_path / "tsv").glob("part-*")
    assert file.read_text() == 'id\tname\tx\tat\n1\tAlice\t\t2024-01-15 00:00:00\n2\tB"ob\tQUI=\t\n'
    export.write_tsv(spark.range(10).repartition(3), str(tmp_path / "parts"))
    texts = [f.read_text().splitlines() for f in (tmp_path / "parts").glob("part-*")]
    assert len(texts) == 3 and all(t[0] == "id" for t in texts) and sum(len(t) for t in texts) == 13
    expect = [
        {"id": 1, "name": "Alice", "x": None, "at": "2024-01-15 00:00:00"},
        {"id": 2, "name": 'B"ob', "x": "QUI=", "at": None},
    ]
    export.write_json(df, str(tmp_path / "json"))
    (file,) = (tmp_path / "json").glob("part-*")
    assert [json.loads(line) for line in file.read_text().splitlines()] == expect
    assert file.read_text().splitlines()[0].startswith('{"id":1,"name":"Alice","x":null')
    for pretty in (False, True):
        export.write_json_array(df, str(tmp_path / f"array{pretty}"), pretty=pretty)
        (file,) = (tmp_path / f"array{pretty}").glob("part-*")
        assert json.loads(file.read_text()) == expect
    export.write_json_array(df.filter("id > 100"), str(tmp_path / "none"))
    assert all(json.loads(f.read_text()) == [] for f in (tmp_path / "none").glob("part-*"))


def test_history(spark):
    def at(minute):
        return dt.datetime(2024, 1, 1, 0, minute)

    log = spark.createDataFrame(
        [("/A.db", "SELECT 1;", at(1)), ("/a.db", "SELECT 2;", at(2)), ("/a.db", "SELECT 3;", at(3)),
         ("/a.db", " SELECT 1; ", at(4)), ("/b.db", "select 1;", at(0)), ("/b.db", "  ", at(9))],
        "database_path string, sql string, executed_at timestamp_ntz",
    )
    kept = {(r.database_path, r.sql, r.rank) for r in history.retain(log, keep=2).collect()}
    assert kept == {("/a.db", "SELECT 1;", 1), ("/a.db", "SELECT 3;", 2), ("/b.db", "select 1;", 1)}
    assert [r.sql for r in history.search(log, "/A.DB", "select 1").collect()] == [" SELECT 1; ", "SELECT 1;"]
    assert history.search(log, "/a.db", " ").count() == 4
    files = spark.createDataFrame([("/first", at(1)), ("/Second", at(2)), ("/FIRST", at(3))], "path string, used_at timestamp_ntz")
    assert [r.path for r in history.recent(files).collect()] == ["/FIRST", "/Second"]


def test_history_with_a_hot_database(spark):
    log = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("db"), F.col("id") % 100)).alias("database_path"),
        F.concat(F.lit("q"), F.col("id") % 700).alias("sql"),
        F.timestamp_seconds("id").alias("executed_at"),
    )
    latest = {}
    for r in log.collect():
        key = (r.database_path, r.sql)
        latest[key] = max(latest.get(key, r.executed_at), r.executed_at)
    expect = set()
    for db in {k[0] for k in latest}:
        mine = sorted((at, sql) for (d, sql), at in latest.items() if d == db)[::-1][:20]
        expect |= {(db, sql, i + 1) for i, (at, sql) in enumerate(mine)}
    assert {(r.database_path, r.sql, r.rank) for r in history.retain(log, keep=20).collect()} == expect


def test_prefix_top(spark):
    entries = spark.createDataFrame(
        [("id", "primary key"), ("idx", "column"), ("IN", "keyword"), ("Items", "table"), ("x", "table")], "name string, kind string"
    )
    got = history.prefix_top(history.with_priority(entries), "I", 3).collect()
    assert [(r.name, r.priority) for r in got] == [("id", 200), ("Items", 100), ("idx", 100)]


def test_changes(spark, items):
    more = changes.insert(items, spark.createDataFrame([("Item 6", 6)], "name string, id long"))
    assert more.filter("id = 6").first()[:] == (6, "Item 6", None)
    new = spark.createDataFrame([(2, None), (3, 1.0), (99, 5.0)], "id long, value double")
    got = {r.id: r.value for r in changes.update(items, new, ["id"]).collect()}
    assert got == {1: 10.5, 2: None, 3: 1.0, 4: 40.75, 5: 50.0}
    assert ids(changes.delete(items, new, ["id"]).orderBy("id")) == [1, 4, 5]
    with pytest.raises(ValueError):
        changes.delete(items, new, [])
    with pytest.raises(ValueError):
        changes.update(items, new.withColumnRenamed("value", "nope"), ["id"])
    with pytest.raises(ValueError, match="several changes"):
        changes.update(items, new.union(new), ["id"])


def test_audits(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None), (3, None)], "k long, v string")
    assert {(r.column_name, r.nulls) for r in audit.null_counts(df).collect()} == {("k", 1), ("v", 2)}
    assert [r.column_name for r in audit.not_null_violations(df, ["v"]).collect()] == ["v"]
    assert {(r.k, r.n) for r in audit.primary_key_violations(df, ["k"]).collect()} == {(1, 2), (None, 1)}
    assert [r.k for r in audit.unique_violations(df, ["k"]).collect()] == [1]
    assert audit.unique_violations(df, ["v"]).count() == 0
    parent = spark.createDataFrame([(1,)], "id long")
    assert {(r.k, r.n) for r in audit.orphan_keys(df, ["k"], parent, ["id"]).collect()} == {(2, 1), (3, 1)}
    assert {r.k for r in audit.orphans(df, ["k"], parent, ["id"]).collect()} == {2, 3}
    rows = {r.column_name: r for r in audit.profile(df, exact=True).collect()}
    assert (rows["v"].rows, rows["v"].nulls, rows["v"].distincts, rows["v"].max_length) == (5, 2, 3, 1)
    assert {r.column_name: r.distincts for r in audit.profile(df).collect()} == {"k": 3, "v": 3}


def test_sorted_layout_spreads_a_hot_value(spark, tmp_path):
    df = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 100))
    layout.write_sorted(df, str(tmp_path / "s"), "k", partitions=9)
    stored = spark.read.parquet(str(tmp_path / "s")).withColumn("f", F.col("_metadata.file_name"))
    assert stored.count() == 3000
    per_file = stored.groupBy("f").agg(F.count("*").alias("n"), F.count_if(F.col("k") == 5).alias("hot")).collect()
    assert max(r.n for r in per_file) < 3000 / 9 * 2 and sum(r.hot > 0 for r in per_file) >= 3


def test_perf_items(spark):
    df = perf_items(spark, 1000)
    assert df.dtypes == [
        ("id", "bigint"), ("created_at", "timestamp_ntz"), ("category", "string"), ("score", "int"), ("payload", "string"),
    ]
    row = df.filter("id = 1000").first()
    assert row[1:] == (dt.datetime(2020, 1, 1, 0, 16, 40), "alpha", 0, "payload-1000-" + "x" * 64)
    assert perf_items(spark, 5).orderBy("id").collect()[4].category == "foxtrot"


TIDES = """-- PostgreSQL database dump
CREATE TABLE public.gauge (
    code text NOT NULL,
    height numeric(6,2)
);
CREATE TABLE public."Level" (
    seen timestamp without time zone,
    gauge text,
    cm integer
);
CREATE TABLE public.nothing (
    z integer
);
COPY public."Level" (seen, gauge, cm) FROM stdin;
2020-05-01 00:00:00\tA\t112
2020-05-01 00:10:00\tA
2020-05-01 00:20:00\tB\thigh
\\.
COPY public.gauge (code, height) FROM stdin;
A\t3.25
B\t\\N
\\.
CREATE UNIQUE INDEX gauge_code ON public.gauge USING btree (code);
CREATE INDEX level_cm ON public."Level" USING btree (cm DESC);
"""


def test_load(spark, write, tmp_path):
    path, dest = write("dump.sql", TIDES), str(tmp_path / "out")
    result = load.load(spark, path, dest)
    report = {r.table_name: r for r in result.report.collect()}
    assert set(report) == {"Level", "gauge", "nothing"}
    assert report["Level"][2:6] == (3, 2, 1, 1) and report["gauge"][2:6] == (2, 2, 0, 0)
    assert result.table("nothing").count() == 0 and result.targets["Level"].endswith("/level")
    assert sorted(r.gauge for r in result.table("Level").collect()) == ["A", "B"]
    assert {(r.table_name, r.reason, r.dropped) for r in load.load_rejects(spark, result).collect()} == {
        ("Level", "expected 3 fields, got 2", True), ("Level", "does not fit: cm", False),
    }
    assert result.totals().filter("table_name IS NULL").first().rows_loaded == 4
    assert [r.column_name for r in result.unique_columns.collect()] == ["code"]
    assert {r.name for r in result.indexes.collect()} == {"gauge_code", "level_cm"}
    assert result.fk_problems.count() == 0
    assert result.warnings == ["Level: 1 rows dropped, 1 rows with unreadable values"]
    with pytest.raises(ValueError, match="exists"):
        load.load(spark, path, dest)
    again = load.load(spark, path, dest, mode="overwrite", tables=["gauge"])
    assert again.report.count() == 1


def test_load_names(spark, write, tmp_path):
    text = 'CREATE TABLE "T" (\n    "A" integer\n);\nCREATE TABLE t (\n    a integer\n);\nCOPY t (a) FROM stdin;\n1\n\\.\n'
    path = write("dump.sql", text)
    with pytest.raises(ValueError, match="collision"):
        load.load(spark, path, str(tmp_path / "a"), fmt="pg_dump")
    kept = load.load(spark, path, str(tmp_path / "b"), fmt="pg_dump", identifier_case="preserve")
    assert kept.table("T").columns == ["A"] and kept.table("t").count() == 1
    with pytest.raises(ValueError):
        load.normalise("x", "upper")
    wide = write("wide.sql", "CREATE TABLE w (\n    a numeric(60,2)\n);\nCOPY w (a) FROM stdin;\n1.5\n\\.\n")
    result = load.load(spark, wide, str(tmp_path / "c"), fmt="pg_dump")
    assert result.warnings == ["w.a: DECIMAL(60,2) has no Spark type, kept as text"]
    assert result.table("w").first().a == "1.5"


def test_foreign_key_without_target_columns(spark):
    """It means the parent's primary key, whatever its name."""
    tables = {
        "p": spark.createDataFrame([(1,), (2,)], "code long"),
        "c": spark.createDataFrame([(10, 1), (11, 3), (12, None)], "id long, p_code long"),
    }
    columns = spark.createDataFrame([], "dump string, table_name string, column_name string, not_null boolean")
    layout = "dump string, table_name string, kind string, name string, columns array<string>, ref_table string, ref_columns array<string>"
    rules = [("d", "p", "pk", "k", ["code"], None, None), ("d", "c", "fk", "f", ["p_code"], "p", [])]
    found = audit.check_declared(tables, columns, spark.createDataFrame(rules, layout)).collect()
    assert sorted(tuple(r) for r in found) == [("c", "fk", "p_code", 1), ("p", "pk", "code", 0)]


def test_json_over_many_parts(spark, tmp_path):
    schema = "id int, `a \"b` double, f float, at timestamp, day date, raw binary, list array<int>, text string"
    when = dt.datetime(2024, 5, 6, 7, 8, 9)
    rows = [(i, i / 4, float(i), when, when.date(), b"\x00\xff", [i, None], 'x,"y"\n') for i in range(50)]
    rows += [(50, float("nan"), float("inf"), None, None, None, None, None), (51, 1e300, 1e-7, when, None, b"", [], "")]
    df = spark.createDataFrame(rows, schema).orderBy("id")
    manifest = export.write_json_parts(df, str(tmp_path / "out")).orderBy("part").collect()
    assert [m.part for m in manifest] == list(range(len(manifest)))
    files = [tmp_path / "out" / "rows" / m.file for m in manifest]
    assert [f.stat().st_size for f in files] == [m.bytes for m in manifest]
    joined = "".join(m.before + f.read_text() + m.after for m, f in zip(manifest, files))
    got = json.loads(joined)
    assert [g["id"] for g in got] == list(range(52))
    assert got[4] == {
        "id": 4, 'a "b': 1, "f": 4, "at": "2024-05-06 07:08:09", "day": "2024-05-06 00:00:00",
        "raw": "AP8=", "list": [4, None], "text": 'x,"y"\n',
    }
    assert '"a \\"b":1,' in joined and '"a \\"b":0.25,' in joined
    assert got[50] == dict.fromkeys(got[50]) | {"id": 50, 'a "b': "NaN", "f": "Infinity"}
    assert got[51]['a "b'] == 1e300 and got[51]["list"] == [] and got[51]["text"] == ""
    (empty,) = export.write_json_parts(df.filter("id > 100"), str(tmp_path / "none")).collect()
    assert empty.file is None and json.loads(empty.before + empty.after) == []
    # Parts without rows, between parts with rows, are left out.
    sparse = spark.range(0, 40, 1, 8).filter("id < 5 OR id > 34").select("id")
    parts = export.write_json_parts(sparse, str(tmp_path / "sparse")).orderBy("part").collect()
    text = "".join(m.before + (tmp_path / "sparse" / "rows" / m.file).read_text() + m.after for m in parts)
    assert [g["id"] for g in json.loads(text)] == [0, 1, 2, 3, 4, 35, 36, 37, 38, 39]


def test_history_by_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"{'Db' if i % 2 else 'db'}{i % 3}", f"select {i % 11}", start + dt.timedelta(minutes=i * 37 % 101), i) for i in range(300)]
    log = spark.createDataFrame(rows, "database_path string, sql string, executed_at timestamp, id int")
    expect = sorted(history.retain(log, keep=4, tie="id").collect())
    kept = history.Retained(str(tmp_path / "kept"), keep=4, tie="id")
    with pytest.raises(ValueError):
        kept.rows(spark)
    for n, part in enumerate((log.filter("id % 3 = 1"), log.filter("id % 3 = 0"), log.filter("id < 0"), log.filter("id % 3 = 2"))):
        kept.update(part, n)
    assert sorted(kept.rows(spark).collect()) == expect
    kept.update(log.filter("id % 3 = 2"), 3)  # the same batch again
    assert sorted(kept.rows(spark).collect()) == expect
    (tmp_path / "kept" / "000000000009").mkdir()  # a version whose write broke off
    assert sorted(kept.rows(spark).collect()) == expect
    kept.drop_versions(spark, 1)
    assert sorted(kept.rows(spark).collect()) == expect
    assert sum((f / "_SUCCESS").exists() for f in (tmp_path / "kept").iterdir()) == 1


def test_pages_inside_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(page, "HEAD", 10)
    rows = [(0, 1)] * 20 + [(1, i) for i in range(300)] + [(2, None)] * 200
    df = spark.createDataFrame(rows, "g int, id int").repartition(4)
    seen = [r for at in range(0, 520, 40) for r in page.offset_page(df, ["g"], at, 40, shallow=50).collect()]
    assert [r.g for r in seen] == sorted(r[0] for r in rows)
    assert sorted((r.g, r.id or 0) for r in seen) == sorted((a, b or 0) for a, b in rows)
    assert page.offset_page(df, ["g"], 520, 40, shallow=50).collect() == []


def test_staged_load_gives_every_row(spark, tmp_path):
    from dumpdeck.plans.sources import load_staged

    tables = {
        "region": "SELECT 1 AS r_regionkey, 'north' AS r_name",
        "nation": "SELECT 2 AS n_nationkey, 'N' AS n_name, 1 AS n_regionkey",
        "customer": "SELECT 3L AS c_custkey, 'a\tb' AS c_name, 2 AS c_nationkey, 0.5D AS c_acctbal, 'x' AS c_mktsegment",
        "supplier": "SELECT 4L AS s_suppkey, 'S' AS s_name, 2 AS s_nationkey, 1.5D AS s_acctbal",
        "orders": "SELECT id + 5 AS o_orderkey, 3L AS o_custkey, 'O' AS o_orderstatus, id / 4 AS o_totalprice, "
        "TIMESTAMP_NTZ '2020-02-29 01:02:03' AS o_orderdate, IF(id = 1, NULL, '2-HIGH') AS o_orderpriority FROM range(2)",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    found = load_staged(spark, str(tmp_path)).collect()
    rows = {(r.table_name, *(v for v in r[1:] if v is not None)) for r in found}
    assert len(found) == 6 and rows == {
        ("region", 1, "north"), ("nation", 2, "N", 1), ("customer", 3, "a\tb", 2, 0.5, "x"), ("supplier", 4, "S", 2, 1.5),
        ("orders", 5, 3, "O", 0.0, "2020-02-29 01:02:03", "2-HIGH"), ("orders", 6, 3, "O", 0.25, "2020-02-29 01:02:03"),
    }
