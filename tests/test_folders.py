"""MySQL Shell folders, SQLite files, archives and format detection."""

import gzip
import io
import json
import sqlite3
import tarfile
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from dumpdeck.functions.rows import REASON, accepted
from dumpdeck.operators.load import load, load_rejects
from dumpdeck.operators.audit import declared_fk_problems, name_collisions
from dumpdeck.sources.archive import content_root, unpack
from dumpdeck.sources.detect import detect_files, detect_folders
from dumpdeck.sources.mysqlshell import MysqlShellDump, read_mysqlshell
from dumpdeck.sources.open import open_dump, probe, skipped_indexes
from dumpdeck.sources.sqlite import SqliteDump, read_sqlite

USERS = "CREATE TABLE `users` (\n  `id` int(11) NOT NULL,\n  `name` varchar(255) NOT NULL,\n  `email` varchar(255),\n  PRIMARY KEY (`id`)\n);\n"


def shell_folder(root, schemas, files):
    root.mkdir()
    (root / "@.json").write_text(json.dumps({"schemas": schemas}))
    for name, content in files.items():
        data = content.encode() if isinstance(content, str) else json.dumps(content).encode()
        (root / name).write_bytes(zstandard.compress(data) if name.endswith(".zst") else data)
    return str(root)


def test_shell_dump(spark, tmp_path):
    meta = {
        "options": {"columns": ["id", "name", "email"], "primaryIndex": "PRIMARY", "fieldsTerminatedBy": "\t"},
        "extension": "tsv.zst",
        "chunking": True,
    }
    folder = shell_folder(
        tmp_path / "d",
        ["testdb"],
        {
            "testdb@users.json": meta,
            "testdb@users.sql": "-- MySQLShell dump\n/*!40101 SET NAMES utf8 */;\nDROP TABLE IF EXISTS `users`;\n" + USERS,
            "testdb@users@@0.tsv.zst": "1\ta\\tb\t\\N\n\n2\tpath\\\\to\tx@y\textra\n",
            "testdb@users@@1.tsv.zst": "3\tshort\n",
            "testdb@users@@10.tsv.zst": "4\tline1\\nline2\t\n",
            "testdb@users@@x.tsv.zst": "5\tz\tz\n",
            "testdb@usersplus.sql": "CREATE TABLE `usersplus` (\n  `a` int\n);\n",
            "testdb@whole.sql": "CREATE TABLE `whole` (\n  `a` int\n);\n",
            "testdb@whole.tsv.zst": "7\n8\n",
        },
    )
    d = MysqlShellDump(spark, folder)
    assert d.tables() == ["testdb.users", "testdb.usersplus", "testdb.whole"]
    assert {(r.table_name, r.n) for r in d.counts().collect()} == {
        ("testdb.users", 5), ("testdb.usersplus", 0), ("testdb.whole", 2),
    }
    assert sorted(r.a for r in read_mysqlshell(spark, folder, "whole").collect()) == [7, 8]
    chunks = d.chunk_lines("users").select("chunk").distinct().orderBy("chunk").collect()
    assert [r.chunk for r in chunks] == [0, 1, 10, 2**63 - 1]
    rows = read_mysqlshell(spark, folder, "users").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [
        (1, "a\tb", None), (2, "path\\to", "x@y"), (3, "short", None), (4, "line1\nline2", ""), (5, "z", "z"),
    ]


def test_shell_options_and_schemas(spark, tmp_path):
    other = {"options": {"columns": ["name", "id"], "fieldsTerminatedBy": "|", "fieldsEscapedBy": "^"}, "extension": "tsv"}
    folder = shell_folder(
        tmp_path / "d",
        ["one", "two"],
        {
            "one@users.json": {"options": {}},
            "one@users.sql": USERS,
            "one@users@@0.tsv.zst": "1\ta\tb\n",
            "two@users.json": other,
            "two@users.sql": USERS,
            "two@users@@0.tsv": "n^tm|7\n",
        },
    )
    d = MysqlShellDump(spark, folder)
    assert [tuple(r) for r in accepted(d.rows("one.users")).collect()] == [(1, "a", "b")]
    assert [tuple(r) for r in accepted(d.rows("two.users")).collect()] == [("n\tm", 7)]
    with pytest.raises(ValueError):
        d.rows("users")


def test_shell_encoded_names(spark, tmp_path):
    table = "CREATE TABLE `{}` (\n  `id` int,\n  `name` text\n);\n"
    folder = shell_folder(
        tmp_path / "d",
        ["s", "t u"],
        {
            "s@a%20b.json": {"options": {"columns": ["name", "id"]}},
            "s@a%20b.sql": table.format("a b"),
            "s@a%20b@@0.tsv.zst": "x\t1\n",
            "s@a%20b@@1.tsv.zst": "y\t2\n",
            "s@a.sql": table.format("a"),
            "s@a.tsv.zst": "3\tz\n",
            "t%20u@%40v%2Bw+.sql": table.format("@v+w+"),
            "t%20u@%40v%2Bw+@@0.tsv.zst": "4\tp%20q\n",
        },
    )
    d = MysqlShellDump(spark, folder)
    assert d.tables() == ["s.a", "s.a b", "t u.@v+w+"]
    assert {(r.table_name, r.n) for r in d.counts().collect()} == {("s.a", 1), ("s.a b", 2), ("t u.@v+w+", 1)}
    assert sorted(map(tuple, accepted(d.rows("s.a b")).select("id", "name").collect())) == [(1, "x"), (2, "y")]
    assert [tuple(r) for r in accepted(d.rows("s.a")).collect()] == [(3, "z")]
    assert [tuple(r) for r in accepted(d.rows("t u.@v+w+")).collect()] == [(4, "p%20q")]


def test_shell_column_lists(spark, tmp_path):
    files = {}
    for name, columns in {"case": ["NAME", "Id"], "unknown": ["name", "nr"]}.items():
        files |= {
            f"s@{name}.json": {"options": {"columns": columns}},
            f"s@{name}.sql": f"CREATE TABLE `{name}` (\n  `id` varchar(9),\n  `name` varchar(9)\n);\n",
            f"s@{name}@@0.tsv.zst": "x\t1\n",
        }
    d = MysqlShellDump(spark, shell_folder(tmp_path / "d", ["s"], files))
    assert [(r.id, r.name) for r in accepted(d.rows("case")).collect()] == [("1", "x")]
    with pytest.raises(ValueError, match="nr"):
        d.rows("unknown")


def test_shell_without_metadata(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a@b.json").write_text("{}")
    with pytest.raises(FileNotFoundError):
        MysqlShellDump(spark, str(tmp_path / "x"))


def sqlite_file(path, *statements):
    db = sqlite3.connect(path)
    for s in statements:
        db.execute(s)
    db.commit()
    db.close()
    return str(path)


def test_sqlite(spark, tmp_path):
    path = sqlite_file(
        tmp_path / "a.db",
        "CREATE TABLE p (k INTEGER PRIMARY KEY)",
        "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, ok BOOLEAN, v FLOAT, d DECIMAL(10,2), b BLOB, u UUID UNIQUE,"
        " p INTEGER REFERENCES p(k))",
        "CREATE INDEX one ON t (name)",
        "CREATE UNIQUE INDEX two ON t (name, v)",
        "CREATE INDEX expr ON t (lower(name))",
        "INSERT INTO t VALUES (1, 'a', 1, 0.1, 1.5, x'4142', 'u1', 1)",
        "INSERT INTO t VALUES (2, '', 0, NULL, '2.25', 'text', 'u2', NULL)",
        "INSERT INTO t VALUES (900000, 'c', 7, 'seven', NULL, NULL, NULL, NULL)",
    )
    d = SqliteDump(spark, path, rows_per_partition=100_000)
    assert d.tables() == ["p", "t"]
    cols = {r.column_name: r for r in d.columns.filter("table_name = 't'").collect()}
    assert [cols[c].type for c in ("id", "name", "ok", "v", "d", "b", "u")] == [
        "INT64", "TEXT", "BOOL", "FLOAT64", "DECIMAL(10,2)", "BLOB", "UUID",
    ]
    assert cols["id"].is_pk and cols["name"].not_null and cols["u"].is_unique
    assert {(r.name, r.reason) for r in skipped_indexes(d.constraints).collect()} == {
        ("two", "composite unique key"), ("expr", "expression index"),
    }
    rows = d.rows("t").orderBy("id").collect()
    assert [tuple(r)[:7] for r in rows] == [
        (1, "a", True, 0.1, rows[0].d, bytearray(b"AB"), "u1"),
        (2, "", False, None, rows[1].d, bytearray(b"text"), "u2"),
        (900000, "c", None, None, None, None, None),
    ]
    assert str(rows[0].d) == "1.50" and rows[2][REASON] == "does not fit: ok,v"
    assert {(r.table_name, r.n) for r in d.counts().collect()} == {("p", 0), ("t", 3)}


def test_sqlite_without_rowid_and_many_files(spark, tmp_path):
    for i in range(3):
        rows = ", ".join(f"({i}, {j}, 'v{j}')" for j in range(25))
        sqlite_file(
            tmp_path / f"{i}.db",
            "CREATE TABLE t (f INTEGER, k INTEGER, v TEXT, PRIMARY KEY (f, k)) WITHOUT ROWID",
            f"INSERT INTO t VALUES {rows}",
        )
    rows = read_sqlite(spark, str(tmp_path / "*.db"), "t", rows_per_partition=10)
    assert rows.agg(F.count("*"), F.count_distinct("f", "k"), F.sum("k")).first()[:] == (75, 75, 900)


def test_sqlite_columns_named_like_row_ids(spark, tmp_path):
    path = sqlite_file(
        tmp_path / "r.db",
        "CREATE TABLE one (RowId INTEGER, v TEXT)",
        "INSERT INTO one VALUES (5, 'a'), (NULL, 'b'), (6, 'c')",
        "CREATE TABLE two (rowid TEXT, _rowid_ TEXT, v TEXT)",
        "INSERT INTO two VALUES ('x', NULL, 'a'), (NULL, 'y', 'b'), (NULL, NULL, 'c')",
        "CREATE TABLE three (rowid TEXT, _rowid_ TEXT, oid TEXT)",
        "INSERT INTO three VALUES (NULL, NULL, 'a'), (NULL, NULL, 'b'), ('1', '1', 'c')",
        "CREATE TABLE keyed (rowid INTEGER, k INTEGER PRIMARY KEY) WITHOUT ROWID",
        "INSERT INTO keyed VALUES (NULL, 1), (NULL, 2), (7, 3)",
    )
    read = lambda t, c: sorted(str(r[c]) for r in read_sqlite(spark, path, t, rows_per_partition=2).collect())
    assert read("one", "v") == read("two", "v") == read("three", "oid") == ["a", "b", "c"]
    assert read("keyed", "k") == ["1", "2", "3"] and read("one", "RowId") == ["5", "6", "None"]


def test_sqlite_collisions_and_fk_problems(spark, tmp_path):
    path = sqlite_file(
        tmp_path / "c.db",
        "CREATE TABLE t (a INTEGER REFERENCES x(id) REFERENCES y(id), b INTEGER REFERENCES gone(id))",
        "CREATE TABLE x (id INTEGER PRIMARY KEY)",
        "CREATE TABLE y (id INTEGER PRIMARY KEY)",
    )
    d = SqliteDump(spark, path)
    assert {(r.problem, r.detail) for r in declared_fk_problems(d.columns, d.constraints).collect()} == {
        ("several targets", "a"), ("missing table", "b -> gone"),
    }
    columns = spark.createDataFrame(
        [("d", "Users", 0, "Name"), ("d", "Users", 1, "name"), ("d", "users", 0, "id")],
        "dump string, table_name string, pos int, column_name string",
    )
    assert {(r.kind, r.name) for r in name_collisions(columns).collect()} == {("table", "users"), ("column", "name")}
    assert name_collisions(columns, "preserve").count() == 0
    with pytest.raises(ValueError):
        name_collisions(columns, "upper")


def test_load_of_folders(spark, tmp_path):
    shell = shell_folder(
        tmp_path / "shell",
        ["db"],
        {"db@users.json": {"options": {}}, "db@users.sql": USERS, "db@users@@0.tsv.zst": "1\ta\tb\nx\tc\t\\N\n"},
    )
    result = load(spark, shell, str(tmp_path / "a"))
    assert result.report.first()[2:6] == (2, 2, 0, 1)
    assert {tuple(r) for r in result.table("db.users").collect()} == {(1, "a", "b"), (None, "c", None)}
    assert [r.raw for r in load_rejects(spark, result).collect()] == ["x\tc\t\\N"]
    db = sqlite_file(
        tmp_path / "x.db",
        "CREATE TABLE T (Id INTEGER PRIMARY KEY, Ok BOOL)",
        "INSERT INTO T VALUES (1, 1), (2, 9)",
        "CREATE TABLE empty (a TEXT)",
    )
    result = load(spark, db, str(tmp_path / "b"), rich=True)
    assert {tuple(r) for r in result.table("T").collect()} == {(1, True), (2, None)}
    assert result.table("T").columns == ["id", "ok"] and result.table("empty").count() == 0
    assert [(r.table_name, r.reason) for r in load_rejects(spark, result).collect()] == [("T", "does not fit: Ok")]


def make_tar(path, members):
    with tarfile.open(path, "w:gz") as t:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))


def make_zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


def test_archives(spark, tmp_path):
    src, dest = tmp_path / "src", tmp_path / "dest"
    src.mkdir()
    make_zip(src / "one.zip", {"dump.sql": "a"})
    make_zip(src / "folder.zip", {"d/x.sql": "b", "d/y.sql": "c"})
    make_zip(src / "loose.zip", {"x.sql": "b", "d/y.sql": "c"})
    make_tar(src / "t.tar.gz", {"d/x.sql": "b"})
    make_tar(src / "flat.tgz", {"x.sql": "b", "y.sql": "c"})
    (src / "plain.sql").write_text("z")
    members = unpack(spark, str(src), str(dest), tasks=2)
    assert members.count() == 8 and members.agg(F.sum("n_bytes")).first()[0] == 8
    roots = {r.archive.rsplit("/", 1)[1]: r.root.split("/dest/")[1].split("/", 1)[1:] for r in content_root(members).collect()}
    assert roots == {"one.zip": ["dump.sql"], "folder.zip": ["d"], "loose.zip": [], "t.tar.gz": ["d"], "flat.tgz": []}
    texts = spark.read.text([r.path for r in members.collect()])
    assert sorted(r.value for r in texts.collect()) == sorted("abcbcbbc")


def test_archive_member_paths_are_checked(spark, tmp_path):
    (tmp_path / "src").mkdir()
    make_zip(tmp_path / "src" / "bad.zip", {"../out.sql": "x"})
    with pytest.raises(Exception, match="leaves the folder"):
        unpack(spark, str(tmp_path / "src"), str(tmp_path / "dest"), tasks=1)
    assert not (tmp_path / "out.sql").exists()


def test_detect(spark, tmp_path, write):
    heads = {
        "pg1.sql": "--\n-- PostgreSQL database dump\n",
        "pg2.sql": "\\restrict x\n",
        "pg3.sql": "\n  SET statement_timeout = 0;\n",
        "pg4.sql": "SELECT pg_catalog.set_config('search_path', '', false);\n",
        "my1.sql": "-- MySQL dump 10.13\r\n",
        "my2.sql": "-- mariadb dump\n",
        "my3.sql": "x /*!40101 SET NAMES utf8 */;\n",
        "my4.sql": "-- Server version 8\n",
        "no1.sql": "SELECT 1;\n",
        "no2.sql": "\n" * 40 + "-- MySQL dump\n",
    }
    for name, text in heads.items():
        write(f"in/{name}", text)
    sqlite_file(tmp_path / "in" / "x.db", "CREATE TABLE t (a)")
    (tmp_path / "in" / "z.sql.gz").write_bytes(gzip.compress(b"-- MySQL dump\n"))
    (tmp_path / "in" / "z.sql.zst").write_bytes(zstandard.compress(b"-- MySQL dump\n"))
    (tmp_path / "in" / "no3.gz").write_bytes(b"-- MySQL dump\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in detect_files(spark, str(tmp_path / "in")).collect()}
    names = {"pg": "pg_dump", "my": "mysqldump", "no": "unknown", "x.": "sqlite", "z.": "mysqldump"}
    assert {k: r.format for k, r in got.items()} == {k: names[k[:2]] for k in got}
    assert got["my1.sql"].crlf and not got["my2.sql"].crlf


def test_detect_folders(spark, tmp_path, write):
    write("in/shell/@.json", "{}")
    write("in/lone/a.sql", "-- MySQL dump\n")
    write("in/chunks/a@b@@0.tsv.zst", "x")
    write("in/other/readme.txt", "x")
    got = {r.folder.rsplit("/", 1)[1]: r.format for r in detect_folders(spark, str(tmp_path / "in")).collect()}
    assert got == {"shell": "mysqlshell", "lone": "mysqldump", "chunks": "mysqlshell", "other": "unknown"}
    assert probe(spark, str(tmp_path / "in" / "lone")) == "mysqldump"
    assert probe(spark, str(tmp_path / "in" / "shell")) == "mysqlshell"
    with pytest.raises(ValueError):
        open_dump(spark, str(tmp_path / "in" / "other"))


def _tables(names, rows=2):
    return "-- MySQL dump\n" + "".join(
        f"CREATE TABLE `{n}` (\n  `k` int,\n  `v` text,\n  KEY `by_k` (`k` DESC)\n);\n"
        + "INSERT INTO `{}` VALUES {};\n".format(n, ",".join(f"({i},'{n}{i}')" for i in range(rows)))
        for n in names
    )


def test_load_is_the_same_for_any_number_of_tables(spark, write, tmp_path):
    names = ["T", "t", "01", "1", "größe"]
    path = write("names.sql", _tables(names))
    for part in (names[:1], names[:4], names):
        dest = str(tmp_path / f"lake{len(part)}")
        result = load(spark, path, dest, identifier_case="preserve", tables=part)
        for n in part:
            assert sorted(map(tuple, result.table(n).collect())) == [(i, f"{n}{i}") for i in range(2)]


def test_sorted_report_counts_once(spark, write, tmp_path):
    text = _tables(["a"], 500).replace("(3,'a3')", "(3,'a3',9)")
    result = load(spark, write("a.sql", text), str(tmp_path / "lake"), sort_by_index=True)
    assert [r[2:6] for r in map(tuple, result.report.collect())] == [(500, 499, 1, 0)]
    again = load(spark, write("b.sql", _tables(["a"], 5)), str(tmp_path / "lake"), mode="overwrite")
    assert load_rejects(spark, again).count() == 0


def test_used_place_is_left_alone(spark, write, tmp_path):
    dest = str(tmp_path / "lake")
    load(spark, write("b.sql", _tables(["b"])), dest)
    with pytest.raises(ValueError):
        load(spark, write("ab.sql", _tables(["a", "b"])), dest)
    assert not (tmp_path / "lake" / "a").exists()
