import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpdeck.functions import escapes, sqltext
from dumpdeck.functions.types import Field, mysql_logical, pg_logical, spark_type, sqlite_logical, typed


def apply(spark, values, fn):
    """Column function over a list of texts, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "i long, c string")
    return [r.v for r in df.select("i", fn(F.col("c")).alias("v")).orderBy("i").collect()]


PG = {
    "INT64": ["integer", "bigint", "smallint", "serial", "int4", "int8", "int2", "bigserial", "smallserial"],
    "BOOL": ["boolean", "bool", "BOOLEAN"],
    "FLOAT64": ["real", "float4", "double precision", "float8"],
    "DECIMAL(10,2)": ["numeric(10,2)"],
    "DECIMAL(18,4)": ["decimal(18,4)"],
    "TEXT": [
        "numeric", "character varying(255)", "varchar(100)", "text", "char(1)", "character(10)", "bpchar", "date",
        "timestamp without time zone", "timestamp with time zone", "timestamptz", "json", "jsonb", "text[]", "integer[]", "unknown",
    ],
    "UUID": ["uuid"],
    "BLOB": ["bytea"],
}
MYSQL = {
    "INT64": ["int(11)", "bigint(20)", "smallint", "mediumint", "tinyint(4)", "int unsigned", "bit(1)", "int(10) unsigned zerofill"],
    "BOOL": ["tinyint(1)"],
    "FLOAT64": ["float", "double", "real", "double precision"],
    "DECIMAL(10,2)": ["decimal(10,2)"],
    "DECIMAL(18,6)": ["decimal"],
    "TEXT": ["varchar(255)", "char(2)", "text", "mediumtext", "longtext", "date", "datetime", "timestamp", "time", "year", "enum('a','b')", "set('x')", "json"],
    "BLOB": ["blob", "mediumblob", "longblob", "binary(16)", "varbinary(255)"],
}
SQLITE = {
    "INT64": ["INTEGER", "INT", "BIGINT", "SMALLINT", "TINYINT", "POINT"],
    "FLOAT64": ["REAL", "FLOAT", "DOUBLE", "DOUBLE PRECISION"],
    "TEXT": ["TEXT", "VARCHAR(255)", "CHAR(10)", "CLOB", "", "WHATEVER"],
    "BLOB": ["BLOB"],
    "BOOL": ["BOOLEAN", "BOOL"],
    "UUID": ["UUID"],
    "DECIMAL(10,2)": ["DECIMAL(10,2)"],
    "DECIMAL(18,4)": ["NUMERIC(18,4)"],
    "DECIMAL(18,6)": ["DECIMAL", "NUMERIC"],
}


@pytest.mark.parametrize("table,fn", [(PG, pg_logical), (MYSQL, mysql_logical), (SQLITE, sqlite_logical)])
def test_type_maps(spark, table, fn):
    pairs = [(src, logical) for logical, names in table.items() for src in names]
    got = apply(spark, [p[0] for p in pairs], fn)
    assert got == [p[1] for p in pairs]


def test_spark_types():
    assert spark_type(Field("a", "DECIMAL(10,2)")) == T.DecimalType(10, 2)
    assert spark_type(Field("a", "DECIMAL(60,2)")) == T.StringType()
    assert spark_type(Field("a", "INT64", "bigint(20) unsigned"), unsigned=True) == T.DecimalType(20, 0)
    assert spark_type(Field("a", "TEXT", "date"), rich=True) == T.DateType()
    assert spark_type(Field("a", "TEXT", "date")) == T.StringType()


def typed_values(spark, values, logical, dialect):
    field = Field("c", logical)
    return apply(spark, values, lambda c: typed(c, field, dialect, spark_type(field)))


def test_typed_values(spark):
    assert typed_values(spark, ["t", "true", "1", "f", "TRUE", None], "BOOL", "pg") == [True, True, True, False, False, None]
    assert typed_values(spark, ["1", "true", "TRUE", "t", "0"], "BOOL", "mysql") == [True, True, True, False, False]
    assert typed_values(spark, ["12", "-3", "x", "9223372036854775808", "1.5"], "INT64", "pg") == [12, -3, None, None, None]
    assert typed_values(spark, ["1.5", "1e3", "1.5d", "2F", "x"], "FLOAT64", "pg") == [1.5, 1000.0, None, None, None]
    assert typed_values(spark, ["\\x4142", "raw"], "BLOB", "pg") == [bytearray(b"AB"), bytearray(b"raw")]
    good = "A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11"
    assert typed_values(spark, [good, "no"], "UUID", "pg") == [good.lower(), None]


def scan(text: str, table: dict, other: str) -> str:
    """Left-to-right unescape; ``other`` says what an unknown pair becomes."""
    out, i = "", 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            nxt = text[i + 1]
            if nxt in table:
                out += table[nxt]
                i += 2
                continue
            if other == "drop":
                out += nxt
                i += 2
                continue
        out += text[i]
        i += 1
    return out


def noise(n: int, alphabet: str) -> list[str]:
    rng = random.Random(7)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_copy_unescape(spark):
    texts = noise(2000, "\\\\\\nrtxab\n")
    table = {"\\": "\\", "n": "\n", "r": "\r", "t": "\t"}
    assert apply(spark, texts, escapes.copy_unescape) == [scan(t, table, "keep") for t in texts]


def test_tsv_unescape(spark):
    texts = noise(2000, "\\\\\\nrt0xa")
    table = {"\\": "\\", "n": "\n", "r": "\r", "t": "\t", "0": "\0"}
    assert apply(spark, texts, escapes.tsv_unescape) == [scan(t, table, "keep") for t in texts]
    assert apply(spark, ["a\\tb"], lambda c: escapes.tsv_unescape(c, "")) == ["a\\tb"]
    assert apply(spark, ["a^tb^^t\\t"], lambda c: escapes.tsv_unescape(c, "^")) == ["a\tb^\t\\t"]


def test_mysql_unescape(spark):
    # Between quotes a quote is only found escaped or doubled.
    texts = [t.replace("'", "''") for t in noise(2000, "\\\\nrt0%x\n")]
    texts = [t if (len(t) - len(t.rstrip("\\"))) % 2 == 0 else t + "\\" for t in texts]
    table = {"\\": "\\", "n": "\n", "r": "\r", "t": "\t", "0": "\0"}
    assert apply(spark, texts, escapes.mysql_unescape) == [scan(t, table, "drop") for t in texts]
    assert apply(spark, ["it\\'s", "it''s", "a\\\\''b", "\\Z"], escapes.mysql_unescape) == ["it's", "it's", "a\\'b", "Z"]


def test_escape_round_trips(spark):
    texts = noise(500, "\\\\'\n\r\tx\0")
    for there, back in [
        (escapes.copy_escape, escapes.copy_unescape),
        (escapes.tsv_escape, escapes.tsv_unescape),
        (escapes.mysql_escape, escapes.mysql_unescape),
    ]:
        assert apply(spark, texts, lambda c: back(there(c))) == texts


def test_names(spark):
    forms = ["public.users", '"public"."Users"', "`a b`", ' "x" ', "plain", "other.t"]
    assert apply(spark, forms, escapes.bare_name) == ["users", "Users", "a b", "x", "plain", "other.t"]
    assert apply(spark, ['"a", b,, `c`'], escapes.name_list) == [["a", "b", "c"]]


def split_by_hand(text: str) -> list[str]:
    parts, now, i = [], "", 0
    while i < len(text):
        two = text[i : i + 2]
        if text[i] == ";":
            parts.append(now)
            now, i = "", i + 1
            continue
        if text[i] == "'":
            end = i + 1
            while end < len(text):
                if text[end] == "'":
                    if text[end + 1 : end + 2] == "'":
                        end += 2
                        continue
                    break
                end += 1
            end = min(end + 1, len(text))
        elif text[i] == '"':
            found = text.find('"', i + 1)
            end = len(text) if found < 0 else found + 1
        elif two == "--":
            found = text.find("\n", i)
            end = len(text) if found < 0 else found
        elif two == "/*":
            found = text.find("*/", i + 2)
            end = len(text) if found < 0 else found + 2
        else:
            end = i + 1
        now += text[i:end]
        i = end
    parts.append(now)
    return [p.strip() for p in parts if p.strip()]


def test_statement_split(spark):
    texts = ["SELECT ';not a delimiter' AS value; SELECT 2;", "", " ; ;", *noise(3000, ";;'\"-*/\na ")]
    assert apply(spark, texts, sqltext.statements) == [split_by_hand(t) for t in texts]


def test_aliases(spark):
    log = spark.createDataFrame(
        [
            (1, "SELECT * FROM Artists a JOIN Albums al ON a.ArtistId = al.ArtistId"),
            (2, 'select 1 from "Big" AS b left join T where x'),
            (3, "select 1 from one x join two X on 1 = 1"),
            (4, "select 1"),
        ],
        "id int, sql string",
    )
    got = {(r.id, r.alias, r.table_name) for r in sqltext.table_aliases(log).collect()}
    assert got == {(1, "a", "Artists"), (1, "al", "Albums"), (2, "b", "Big"), (3, "X", "two")}


def test_format(spark):
    got = apply(spark, ["select a from t  inner join u on 1=1 where x and y", "  ", "group   by a"], sqltext.format_sql)
    assert got == ["SELECT a \nFROM t \nINNER \nJOIN u on 1=1 \nWHERE x \n  AND y", "", "GROUP BY a"]


def test_plan_timing(spark):
    plans = ["Planning Time: 0.123 ms\nExecution Time: 4.5 ms", "execution time = 9.75 ms", "planning  time 3ms", "none", None]
    assert apply(spark, plans, sqltext.planning_time) == [0.123, None, 3.0, None, None]
    assert apply(spark, plans, sqltext.execution_time) == [4.5, 9.75, None, None, None]


def test_occurrences(spark):
    texts = ["users Users USERS", "aaaa", "a.b a+b", "", None]
    assert apply(spark, texts, lambda c: sqltext.occurrences(c, "users")) == [3, 0, 0, 0, 0]
    assert apply(spark, texts, lambda c: sqltext.occurrences(c, "aa")) == [0, 2, 0, 0, 0]
    assert apply(spark, texts, lambda c: sqltext.occurrences(c, "A.B")) == [0, 0, 1, 0, 0]
    assert apply(spark, texts, lambda c: sqltext.occurrences(c, "")) == [0] * 5
    assert apply(spark, ["x\\Ey", "x"], lambda c: sqltext.occurrences(c, "\\E")) == [1, 0]


def test_predicates(spark):
    texts = ["select 1 ORDER  BY 1", "select 'order by'", "-- limit 1\nselect 1", "select credit_limit", "x limit 1"]
    assert apply(spark, texts, sqltext.has_order_by) == [True, False, False, False, False]
    assert apply(spark, texts, sqltext.has_limit) == [False, False, False, False, True]


def test_total_time(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (None, 2.0, None), (1.0, 2.0, None)], "d double, f double, b double")
    assert [r.t for r in df.select(sqltext.total_time(F.col("d"), F.col("f"), F.col("b")).alias("t")).collect()] == [6.0, 2.0, 3.0]
