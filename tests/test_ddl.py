"""Declared schemas from many statements."""

import random

from dumpdeck.sources import ddl

TABLE = (
    "CREATE TABLE `t{0}` (\n  `id` int(11) NOT NULL AUTO_INCREMENT,\n  `owner` decimal({0},2) unsigned DEFAULT NULL,\n"
    "  `live` tinyint(1),\n  PRIMARY KEY (`id`),\n  UNIQUE KEY `u` (`live`),\n  KEY `k` (`owner`,`live`),\n"
    "  CONSTRAINT `f` FOREIGN KEY (`owner`) REFERENCES `db`.`people` (`pid`)\n) ENGINE=InnoDB"
)


def test_mysql_statements_are_dealt_out_and_read_once(spark):
    texts = [("a", TABLE.format(n)) for n in range(10, 30)] + [("a", "DROP TABLE `t1`"), ("a", None)]
    columns, constraints = ddl.mysql_schema(spark.createDataFrame(texts, "dump string, statement string").coalesce(1))
    found = {(r.table_name, r.pos, r.column_name, r.type, r.not_null, r.is_pk, r.is_unique, r.auto_increment) for r in columns.collect()}
    assert len(found) == 60 and {x for x in found if x[0] == "t12"} == {
        ("t12", 0, "id", "INT64", True, True, False, True),
        ("t12", 1, "owner", "DECIMAL(12,2)", False, False, False, False),
        ("t12", 2, "live", "BOOL", False, False, True, False),
    }
    rules = {(r.kind, r.name, tuple(r.columns), r.ref_table, r.ref_columns and tuple(r.ref_columns)) for r in constraints.filter("table_name = 't29'").collect()}
    assert constraints.count() == 80 and rules == {
        ("pk", "PRIMARY", ("id",), None, None), ("unique", "u", ("live",), None, None),
        ("index", "k", ("owner", "live"), None, None), ("fk", "f", ("owner",), "people", ("pid",)),
    }
    # Each text is matched once, however many columns and filters read the parts.
    plan = columns._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("PRECISION)?") == 1 and "RepartitionByExpression" in plan


def test_heads_cross_chunks_and_splits(spark, monkeypatch):
    monkeypatch.setattr(ddl, "CHUNK", 3)
    draw = random.Random(5)
    texts = ["CREATE TABLE a (", "ALTER TABLE ONLY b", ");", "    id bigint,", "    ADD CONSTRAINT x", "-- said", None]
    lines, heads = [], {}
    for dump in ("x", "y", None):
        head = None
        for block in (0, 50, 90):
            for pos in range(block, block + draw.choice([1, 7, 30])):
                value = draw.choices(texts, [1, 1, 1, 9, 9, 9, 1])[0]
                lines.append((dump, block, pos, value))
                head = value if value in texts[:3] else head
                heads[dump, pos] = head
    draw.shuffle(lines)
    found = ddl._with_head(spark.createDataFrame(lines, "dump string, block long, pos long, value string"))
    assert {(r.dump, r.pos): r.head for r in found.collect()} == heads and found.count() == len(lines)
