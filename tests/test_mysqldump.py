import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dumpdeck import encode
from dumpdeck.functions.rows import accepted, rejects
from dumpdeck.sources.mysqldump import MysqlDump, read_mysqldump
from dumpdeck.sources.open import open_dump, skipped_indexes

FULL = r"""-- MariaDB dump 10.19  Distrib 10.11.6-MariaDB
-- Server version	10.11.6-MariaDB

/*!40014 SET @OLD_UNIQUE_CHECKS=@@UNIQUE_CHECKS */;
CREATE DATABASE quakes;
USE quakes;
DROP TABLE IF EXISTS `reading`;
CREATE TABLE `reading` (
  `taken` datetime(3) NOT NULL,
  `probe` varchar(12) NOT NULL,
  `depth` double DEFAULT NULL,
  `note` mediumtext,
  `flags` set('x','y,z') DEFAULT 'x',
  PRIMARY KEY (`probe`,`taken`),
  KEY `deep` (`depth` DESC),
  KEY `both` (`note`(8),`flags`)
) ENGINE=Aria;
LOCK TABLES `reading` WRITE;
INSERT INTO `reading` VALUES ('2023-02-06 01:17:34.250','tk-4',-17.9,'M7,8; felt (far)','x'),('2023-02-06 10:24:49.000','tk-5',NULL,'it\'s\n"late"',NULL);
UNLOCK TABLES;
DROP TABLE IF EXISTS `probe`;
CREATE TABLE `probe` (
  `serial` smallint unsigned NOT NULL AUTO_INCREMENT,
  `tag` varchar(12) NOT NULL,
  `live` bit(1) DEFAULT b'1',
  `cost` decimal(6,3),
  UNIQUE KEY `by_tag` (`tag`),
  KEY `cheap` (`cost`),
  PRIMARY KEY (`serial`),
  CONSTRAINT `seen` FOREIGN KEY (`tag`) REFERENCES `reading` (`probe`) ON DELETE CASCADE
);
INSERT INTO `probe` (`cost`,`tag`,`serial`) VALUES (12.500,'tk-4',31),
(0.125,'tk-5',32);
INSERT INTO probe (serial, tag) VALUES (33,'o''k');
"""


def test_full_dump(spark, write):
    d = MysqlDump(spark, write("full.sql", FULL))
    assert d.tables() == ["probe", "reading"]
    cols = {(r.table_name, r.column_name): r for r in d.columns.collect()}
    assert cols["probe", "cost"].type == "DECIMAL(6,3)" and cols["reading", "note"].type == "TEXT"
    assert cols["probe", "serial"].auto_increment and cols["probe", "serial"].is_pk
    assert cols["probe", "tag"].is_unique and not cols["reading", "note"].is_unique
    assert [cols["reading", c].is_pk for c in ("taken", "probe", "depth")] == [True, True, False]
    rules = {(r.kind, r.name, tuple(r.columns), r.ref_table) for r in d.constraints.collect()}
    assert ("fk", "seen", ("tag",), "reading") in rules and ("index", "deep", ("depth",), None) in rules
    assert ("index", "both", ("note", "flags"), None) in rules
    assert [r.name for r in skipped_indexes(d.constraints).collect()] == ["both"]
    assert {(r.table_name, r.n) for r in d.counts().collect()} == {("reading", 2), ("probe", 3)}
    rows = accepted(d.rows("reading").select("probe", "depth", "note", "flags", "_dump", "_raw", "_reason", "_dropped"))
    assert sorted(map(tuple, rows.collect())) == [
        ("tk-4", -17.9, "M7,8; felt (far)", "x"), ("tk-5", None, "it's\n\"late\"", None),
    ]
    probes = sorted((r.serial, r.tag, r.cost) for r in accepted(d.rows("probe")).collect())
    assert probes == [(31, "tk-4", Decimal("12.500")), (32, "tk-5", Decimal("0.125")), (33, "o'k", None)]


def load_all(d):
    return {t: sorted((tuple(r) for r in accepted(d.rows(t)).collect()), key=str) for t in d.tables()}


T1 = "CREATE TABLE `t` (\n  `a` int,\n  `b` text\n);\n"


def test_mixed_line_ends(spark, write, tmp_path):
    write("mix/1.sql", "-- MySQL dump\n" + T1 + "INSERT INTO `t` VALUES (1,'x'),(2,'y');\nINSERT INTO `t` VALUES (3,'z');\n")
    two = "-- MySQL dump\n" + T1 + "INSERT INTO `t` VALUES (4,'x');\nINSERT INTO `t` VALUES (5,'cr\\r\\n');\n"
    write("mix/2.sql", two.replace("\n", "\r\n"))
    for d in (open_dump(spark, str(tmp_path / "mix")), MysqlDump(spark, str(tmp_path / "mix"))):
        assert [r[0] for r in load_all(d)["t"]] == [1, 2, 3, 4, 5]
        assert {(r.table_name, r.n) for r in d.counts().collect()} == {("t", 5)}


@pytest.mark.parametrize("mark", [";;", "//", "$$"])
def test_routine_bodies_are_not_data(spark, write, mark):
    body = (
        f"DELIMITER {mark}\n/*!50003 CREATE*/ /*!50017 DEFINER=`root`@`%`*/ /*!50003 TRIGGER `tr` AFTER INSERT ON `t`\n"
        f"FOR EACH ROW BEGIN\n  INSERT INTO `log` VALUES (1,'phantom');\nINSERT INTO `log` VALUES (2,'phantom');\nEND */{mark}\n"
        "DELIMITER ;\n"
    )
    text = (
        "CREATE TABLE `log` (\n  `a` int,\n  `b` text\n);\n" + T1 + "INSERT INTO `log` VALUES (8,'before');\n"
        + body + "INSERT INTO `log` VALUES (9,'real');\n" + body + "INSERT INTO `t` VALUES (7,'DELIMITER x');\n"
    )
    for end in ("\n", "\r\n"):
        d = MysqlDump(spark, write(f"tr{len(end)}.sql", text.replace("\n", end)))
        assert load_all(d) == {"log": [(8, "before"), (9, "real")], "t": [(7, "DELIMITER x")]}
        assert {(r.table_name, r.n) for r in d.counts().collect()} == {("log", 2), ("t", 1)}


def test_cut_statements_are_rejoined(spark, write):
    text = (
        T1 + "INSERT INTO `t` VALUES (1,'a;\nb'),(2,'c'),(3,'d;\n;\n\n e\\\\');\nINSERT INTO `t` VALUES (4,'f');\n"
        "INSERT INTO `t` VALUES (5,'-- g;\n-- h;\nSET i');\nINSERT INTO `t` VALUES (6,'never ends;\n"
    )
    rows = MysqlDump(spark, write("cut.sql", text)).rows("t")
    assert sorted(map(tuple, accepted(rows).collect())) == [
        (1, "a;\nb"), (2, "c"), (3, "d;\n;\n\n e\\"), (4, "f"), (5, "-- g;\n-- h;\nSET i"),
    ]
    assert [r.reason for r in rejects(rows, "t").collect()] == ["unterminated statement"]


def test_names_of_any_characters(spark, write):
    names = ["größe", "order-items", "a b", "T", "t", "01", "1", "tick``s", "x.y", "(p)"]
    text = "".join(
        f"CREATE TABLE `{n}` (\n  `k-{i}` int,\n  `wért` text\n);\nINSERT INTO `{n}` (`wért`,`k-{i}`) VALUES ('v',{i});\n"
        for i, n in enumerate(names)
    )
    d = MysqlDump(spark, write("names.sql", text))
    assert load_all(d) == {n.replace("``", "`"): [(i, "v")] for i, n in enumerate(names)}
    assert {r.table_name: r.n for r in d.counts().collect()} == {n.replace("``", "`"): 1 for n in names}


VALUES = [
    ("(1,2,3)", [("1", "2", "3")]),
    ("('hello','world','')", [("hello", "world", "")]),
    ("(NULL,null,'NULL')", [(None, None, "NULL")]),
    ("(1,'text',3.14)", [("1", "text", "3.14")]),
    (r"('path\\to\\file','line1\nline2','\0')", [("path\\to\\file", "line1\nline2", "\0")]),
    ("(1, 'a' ,-2),( 2,'b',1e3)", [("1", "a", "-2"), ("2", "b", "1e3")]),
    (r"('a\'),(\'b','(','))')", [("a'),('b", "(", "))")]),
]


@pytest.mark.parametrize("values,expect", VALUES)
def test_values(spark, write, values, expect):
    text = f"CREATE TABLE `t` (\n  `a` text,\n  `b` text,\n  `c` text\n);\nINSERT INTO `t` VALUES {values};\n"
    got = read_mysqldump(spark, write("t.sql", text), "t").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expect, key=str)


def test_rejects(spark, write):
    text = (
        "CREATE TABLE `t` (\n  `a` int,\n  `b` text\n);\n"
        "INSERT INTO `t` VALUES (1,'x'),(2),('q','y'),(3,'z',4);\n"
        "INSERT INTO `t` (`a`) VALUES (8),(9,9);\n"
        "INSERT INTO `t` VALUES (5,'ok'),(6,'no end;\n"
    )
    rows = MysqlDump(spark, write("t.sql", text)).rows("t")
    assert {tuple(r) for r in accepted(rows).collect()} == {(1, "x"), (None, "y"), (8, None), (5, "ok")}
    got = {(r.reason, r.dropped) for r in rejects(rows, "t").collect()}
    assert got == {
        ("expected 2 fields, got 1", True),
        ("expected 2 fields, got 3", True),
        ("expected 2 fields, got 0", True),
        ("does not fit: a", False),
        ("unterminated statement", True),
    }


def test_unsigned(spark, write):
    text = "CREATE TABLE `t` (\n  `a` bigint(20) unsigned\n);\nINSERT INTO `t` VALUES (18446744073709551615);\n"
    path = write("t.sql", text)
    assert read_mysqldump(spark, path, "t").first().a is None
    assert read_mysqldump(spark, path, "t", unsigned=True).first().a == Decimal(2**64 - 1)


def test_crlf_and_staging(spark, write, tmp_path):
    path = write("crlf.sql", FULL.replace("\n", "\r\n"))
    d = open_dump(spark, path)
    staged = str(tmp_path / "staged")
    d.stage(staged)
    for rows in (d.rows("probe"), d.rows("probe", staged=staged), d.rows("probe", spread=3)):
        assert sorted(r.serial for r in accepted(rows).collect()) == [31, 32, 33]


def test_long_statement(spark, write):
    groups = ",".join(f"({i},'{'e' * 20}\\'{i}')" for i in range(50_000))
    text = f"CREATE TABLE `t` (\n  `a` int,\n  `b` text\n);\nINSERT INTO `t` VALUES {groups};\n"
    rows = read_mysqldump(spark, write("t.sql", text), "t")
    assert rows.agg(F.count("*"), F.sum("a"), F.max(F.length("b"))).first()[:] == (50_000, 49_999 * 25_000, 26)


def test_long_string(spark, write):
    text = "CREATE TABLE `t` (\n  `a` text\n);\nINSERT INTO `t` VALUES ('" + "\\n''" * 20_000 + "');\n"
    assert read_mysqldump(spark, write("t.sql", text), "t").first().a == "\n'" * 20_000


def test_long_comments_and_enums(spark, write):
    text = (
        "-- note\n\n/* more */\n" * 20_000
        + "CREATE TABLE `t` (\n  `a` enum("
        + ",".join(f"'v{i})'" for i in range(20_000))
        + ") NOT NULL,\n  `b` int\n);\n"
        + "-- note\n" * 20_000
        + "INSERT INTO `t` VALUES ('v1)',2);\n"
    )
    assert [tuple(r) for r in read_mysqldump(spark, write("t.sql", text), "t").collect()] == [("v1)", 2)]


def test_round_trip_of_random_text(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice("\\'\"\n\r\t\0;(),`-/* aé") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t if i % 11 else None) for i, t in enumerate(texts)], "id long, t string")
    path = encode.write_mysqldump({"r": df}, str(tmp_path / "d"))
    got = {r.id: r.t for r in read_mysqldump(spark, path, "r").collect()}
    assert got == {i: t if i % 11 else None for i, t in enumerate(texts)}


def test_statements_in_strings_and_comments(spark, write):
    """Text that looks like statements, in a string, a comment, and in a string that a comment mark opens."""
    text = (
        T1 + "/* a;\nINSERT INTO `t` VALUES (90,'no');\nit's; */\nINSERT INTO `t` VALUES (1,'x;\n"
        "INSERT INTO `t` VALUES (91,\\'no\\');\nINSERT INTO `t` VALUES (92,5);\n/* y');\n"
        "-- don't;\nINSERT INTO `t` VALUES (2,'/* z');\nINSERT INTO `t` VALUES (3,'a \\\\');\n/* never */;\n"
        "INSERT INTO `t` VALUES (4,'q');\n/* open;\nINSERT INTO `t` VALUES (93,'no');\n"
    )
    for size in (None, "64", "150"):
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            d = MysqlDump(spark, write("odd.sql", text))
            first = "x;\nINSERT INTO `t` VALUES (91,'no');\nINSERT INTO `t` VALUES (92,5);\n/* y"
            assert load_all(d)["t"] == [(1, first), (2, "/* z"), (3, "a \\"), (4, "q")]
            d.close()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_routines_over_splits(spark, write):
    """Small splits: bodies, comments and strings go on over several of them."""
    body = "DELIMITER ;;\nCREATE TRIGGER x BEGIN\n" + "INSERT INTO `t` VALUES (9,'no');\n" * 40 + "END ;;\nDELIMITER ;\n"
    text = T1 + "".join(f"INSERT INTO `t` VALUES ({i},'a');\n" * 3 + body for i in range(5)) + "INSERT INTO `t` VALUES (7,'z');\n"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        d = MysqlDump(spark, write("many.sql", text))
        assert load_all(d)["t"] == [(i, "a") for i in range(5) for _ in range(3)] + [(7, "z")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
