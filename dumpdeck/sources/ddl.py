"""Declared schema of a dump as DataFrames, from its DDL text.

``columns``: ``(dump, table_name, pos, column_name, src_type, type, not_null, is_pk, is_unique,
auto_increment)``. ``constraints``: ``(dump, table_name, kind, name, columns, ref_table,
ref_columns)`` with kind ``pk``, ``unique``, ``index`` or ``fk``. Both are metadata: their size
follows the number of declared columns, not the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dumpdeck.functions import tokens
from dumpdeck.functions.escapes import bare_name, name_list
from dumpdeck.functions.types import Field, mysql_logical, pg_logical

# One identifier, and one with an optional schema in front.
NAME = r'(?:"[^"]+"|\w+)'
QUALIFIED = rf"((?:{NAME}\.)?{NAME})"

PG_CREATE = rf"(?i)^\s*CREATE\s+(?:UNLOGGED\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{QUALIFIED}\s*\("
PG_COLUMN = r'^\s*("[^"]+"|[^\s"(]+)\s+(\S.*?),?\s*$'
PG_TYPE = (
    r"(?i)^((?:[^\s(]++|\([^)]*+\))++"
    r"(?:\s+(?:VARYING|PRECISION|WITHOUT\s+TIME\s+ZONE|WITH\s+TIME\s+ZONE)(?:\([^)]*\))?(?:\[\])*)?)"
)
PG_TABLE_RULE = r"(?i)^\s*(?:CONSTRAINT\s|PRIMARY\s+KEY|UNIQUE\s*\(|CHECK\s*\(|FOREIGN\s+KEY|EXCLUDE\s)"
# A name in backticks, where two stand for one, or a bare word.
MYSQL_NAME = r"(?:`(?:[^`]|``)+`|[^\s`(),.;]+)"
MYSQL_CREATE = (
    rf"(?is)\A\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:{MYSQL_NAME}\s*\.\s*)?({MYSQL_NAME})\s*\((.*)\z"
)
MYSQL_COLUMN = r"^(`(?:[^`]|``)+`)\s+(.+)$"
MYSQL_TYPE = (
    r"(?i)^((?:[^\s(]+)(?:\s+PRECISION)?(?:\s*\((?:[^)']++|'(?:[^']++|'')*+')*+\))?"
    r"(?:\s+(?:UNSIGNED|SIGNED|ZEROFILL))*)"
)
# Lines of a split are looked at in chunks of this many, with one row per chunk across them.
CHUNK = 1 << 16
MYSQL_KEY = r"(?i)^(PRIMARY|UNIQUE|KEY|INDEX)\s*(?:KEY\s*)?(?:`([^`]+)`\s*)?\(((?:[^()]++|\(\d+\))++)\)"


def mysql_name(name: Column) -> Column:
    """A name without its backticks."""
    return F.replace(F.regexp_replace(name, r"(?s)\A`(.*)`\z", "$1"), F.lit("``"), F.lit("`"))


def index_columns(listed: Column) -> Column:
    """Columns of an index without order, null placement, collation, operator class or prefix length."""
    plain = r"""^\s*("[^"]+"|`[^`]+`|\w+)(?:\s*\(\d+\))?(?:\s+[\w."]+)*\s*$"""
    parts = F.transform(F.split(listed, ","), lambda x: F.when(x.rlike(plain), F.regexp_extract(x, plain, 1)).otherwise(x))
    return F.filter(F.transform(parts, bare_name), lambda x: x != "")


def _flag_keys(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Mark primary key columns (also NOT NULL) and columns that are unique on their own."""
    keys = (
        constraints.filter(F.col("kind").isin("pk", "unique"))
        .filter((F.col("kind") == "pk") | (F.size("columns") == 1))
        .select("dump", "table_name", F.explode("columns").alias("key_name"), "kind")
        .withColumn("key_name", F.lower("key_name"))
        .groupBy("dump", "table_name", "key_name")
        .agg(
            F.bool_or(F.col("kind") == "pk").alias("is_pk"),
            F.bool_or(F.col("kind") == "unique").alias("is_unique"),
        )
    )
    # Both sides follow the number of declared columns; sizes guessed from compressed files would broadcast millions.
    out = columns.withColumn("key_name", F.lower("column_name")).join(
        keys.hint("merge"), ["dump", "table_name", "key_name"], "left"
    )
    is_pk = F.coalesce("is_pk", F.lit(False))
    return out.select(
        "dump",
        "table_name",
        "pos",
        "column_name",
        "src_type",
        "type",
        (F.col("not_null") | is_pk).alias("not_null"),
        is_pk.alias("is_pk"),
        F.coalesce("is_unique", F.lit(False)).alias("is_unique"),
        "auto_increment",
    )


def pg_schema(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns and constraints from ``lines(dump, block, pos, value)`` outside COPY data."""
    constraints = pg_constraints(lines)
    return _flag_keys(pg_columns(lines), constraints), constraints


def _starts() -> Column:
    value = F.col("value")
    return value.rlike(r"(?i)^\s*(CREATE|ALTER)\s") | value.rlike(r"^\s*\)")


def _with_head(lines: DataFrame) -> DataFrame:
    """Each line with the statement start it follows.

    Windows stand over chunks of a split; a chunk whose first lines follow no start of their own takes the last one of
    the chunks before it.
    """
    chunk = ["dump", "block", "chunk"]
    started = tokens.computed(
        lines.withColumn("chunk", F.floor(F.col("pos") / CHUNK)), *lines.columns, "chunk",
        F.when(_starts(), F.col("value")).alias("start"),
    )
    order = Window.partitionBy(*chunk).orderBy("pos")
    own = started.withColumn("head", F.last("start", True).over(order))
    before = Window.partitionBy("dump").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        own.withColumns({"opens": F.first("head").over(order), "next": F.lead("pos").over(order)})
        .filter("next IS NULL")
        .withColumn("carried", F.last("head", True).over(before))
        .filter("carried IS NOT NULL AND opens IS NULL")
        .select(*(F.col(c).alias(f"c_{c}") for c in chunk), "carried")
    )
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in chunk]
    return own.join(carried, same, "left").select(*lines.columns, F.coalesce("head", "carried").alias("head"))


def pg_columns(lines: DataFrame) -> DataFrame:
    """Columns without key flags."""
    starts, value = _starts(), F.col("value")
    body = _with_head(lines).filter(
        F.col("head").rlike(PG_CREATE)
        & ~starts
        & ~value.rlike(PG_TABLE_RULE)
        & ~value.rlike(r"^\s*--")
        & value.rlike(PG_COLUMN)
    )
    named = tokens.computed(
        body, "dump", "block", F.col("pos").alias("line"),
        bare_name(F.regexp_extract("head", PG_CREATE, 1)).alias("table_name"),
        bare_name(F.regexp_extract("value", PG_COLUMN, 1)).alias("column_name"),
        F.regexp_extract("value", PG_COLUMN, 2).alias("rest"),
    )
    split = tokens.computed(named, *named.columns, F.regexp_extract("rest", PG_TYPE, 1).alias("src_type"))
    src_type = F.col("src_type")
    return tokens.computed(
        split,
        "dump",
        "table_name",
        "block",
        "line",
        "column_name",
        "src_type",
        pg_logical(src_type).alias("type"),
        F.contains(F.upper(F.substr("rest", F.length(src_type) + 1)), F.lit("NOT NULL")).alias("not_null"),
        F.lit(False).alias("auto_increment"),
    ).withColumn(
        "pos",
        F.row_number().over(Window.partitionBy("dump", "table_name").orderBy("block", "line")) - 1,
    )


def pg_constraints(lines: DataFrame) -> DataFrame:
    # A constraint may stand on the line after its ALTER TABLE.
    statement = F.when(_starts(), F.col("value")).otherwise(F.concat_ws(" ", "head", "value"))
    spoken = statement.rlike(r"(?i)\sCONSTRAINT\s|\sINDEX\s")
    stated = tokens.computed(_with_head(lines).filter(spoken), "dump", tokens.tokens(statement).alias("stream"))
    rules = tokens.bound(
        F.struct("stream", tokens.lexemes(F.col("stream")).alias("lex")),
        lambda s: F.coalesce(_added(s["stream"], s["lex"]), _index(s["stream"], s["lex"])),
    )
    return stated.select("dump", F.inline(_stated(rules)))


def _stated(*rules: Column) -> Column:
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def _rule(table: Column, kind: Column, name: Column, columns: Column, ref_table: Column, ref_columns: Column) -> Column:
    names = ["table_name", "kind", "name", "columns", "ref_table", "ref_columns"]
    return F.struct(*(c.alias(n) for c, n in zip((table, kind, name, columns, ref_table, ref_columns), names)))


def _qualified(lex: Column, at: Column) -> tuple[Column, Column]:
    """A name that may have a schema in front, and the place after it."""
    dotted = tokens.is_at(lex, at + 1, ".")
    first = tokens.text_at(lex, at)
    name = F.when(dotted, F.concat_ws(".", first, tokens.text_at(lex, at + 2))).otherwise(first)
    return name, at + F.when(dotted, 3).otherwise(1)


def _key(lex: Column, at: Column) -> tuple[Column, Column]:
    """Kind of the key whose words begin at a place, and the place of its column list."""
    kind = (
        F.when(tokens.is_at(lex, at, "PRIMARY", "KEY"), "pk")
        .when(tokens.is_at(lex, at, "UNIQUE"), "unique")
        .when(tokens.is_at(lex, at, "FOREIGN", "KEY"), "fk")
    )
    return kind, at + F.when(kind == "unique", 1).otherwise(2)


def _listed(stream: Column, lex: Column, opened: Column) -> Column:
    """The text in the parentheses that open at a place."""
    return tokens.bound(opened, lambda at: tokens.between(stream, lex, at, tokens.closing(lex, at)))


def _references(stream: Column, lex: Column) -> Column:
    """``(table, listed)``: table and column list after REFERENCES; the list may be missing."""

    def read(at: Column) -> Column:
        table, opened = _qualified(lex, at)
        listed = tokens.bound(opened, lambda o: F.when(tokens.is_at(lex, o, "("), _listed(stream, lex, o)))
        return F.struct(table.alias("table"), listed.alias("listed"))

    return tokens.bound(tokens.place(lex, "REFERENCES") + 1, read)


def _added(stream: Column, lex: Column) -> Column:
    """The key that an ALTER TABLE ... ADD CONSTRAINT statement adds."""
    first = F.when(tokens.is_at(lex, 2, "ONLY"), 3).otherwise(2)
    table, _ = _qualified(lex, first)

    def keyed(at: Column) -> Column:
        kind, opened = _key(lex, at + 3)
        return tokens.bound(F.struct(kind.alias("kind"), opened.alias("opened"), at.alias("at")), read)

    def read(s: Column) -> Column:
        ok = s["kind"].isNotNull() & tokens.is_at(lex, s["opened"], "(")
        target = F.when(s["kind"] == "fk", _references(stream, lex))
        return F.when(ok, tokens.bound(target, lambda to: rule(s, to)))

    def rule(s: Column, to: Column) -> Column:
        is_fk = s["kind"] == "fk"
        made = _rule(
            bare_name(table), s["kind"], bare_name(tokens.text_at(lex, s["at"] + 2)),
            name_list(_listed(stream, lex, s["opened"])), F.when(is_fk, bare_name(to["table"])), F.when(is_fk, name_list(to["listed"])),
        )
        return F.when(~is_fk | to["listed"].isNotNull(), made)

    found = tokens.bound(tokens.place(lex, "ADD", "CONSTRAINT"), keyed)
    return F.when(tokens.is_at(lex, 0, "ALTER", "TABLE"), found)


def _index(stream: Column, lex: Column) -> Column:
    """The index that a CREATE INDEX statement makes."""
    unique = tokens.is_at(lex, 1, "UNIQUE")

    def named(at: Column) -> Column:
        table, after = _qualified(lex, at + F.when(tokens.is_at(lex, at + 3, "ONLY"), 4).otherwise(3))
        placed = tokens.bound(F.struct(table.alias("table"), after.alias("after"), at.alias("at")), read)
        return F.when(tokens.is_at(lex, at, "INDEX") & tokens.is_at(lex, at + 2, "ON"), placed)

    def read(s: Column) -> Column:
        opened = s["after"] + F.when(tokens.is_at(lex, s["after"], "USING"), 2).otherwise(0)
        rule = _rule(
            bare_name(s["table"]), F.when(unique, "unique").otherwise("index"), bare_name(tokens.text_at(lex, s["at"] + 1)),
            index_columns(_listed(stream, lex, opened)), F.lit(None).cast("string"), F.lit(None).cast("array<string>"),
        )
        return F.when(tokens.is_at(lex, opened, "("), rule)

    return F.when(tokens.is_at(lex, 0, "CREATE"), tokens.bound(F.when(unique, 2).otherwise(1), named))


def mysql_schema(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns and constraints from ``statements(dump, statement)``, one CREATE TABLE each."""
    constraints = mysql_constraints(statements)
    return _flag_keys(mysql_columns(statements), constraints), constraints


def _items(statements: DataFrame) -> DataFrame:
    """The lines of each CREATE TABLE body; a statement of another kind has none."""
    # Few files hold many statements: dealt out, they are parsed by as many tasks as there are.
    body = tokens.computed(
        statements.select("dump", "statement").repartition(F.xxhash64("dump", "statement")),
        "dump",
        mysql_name(F.regexp_extract("statement", MYSQL_CREATE, 1)).alias("table_name"),
        F.regexp_extract("statement", MYSQL_CREATE, 2).alias("body"),
    )
    lines = F.transform(F.split("body", r"\r?\n"), lambda x: F.regexp_replace(F.trim(x), r",\s*$", ""))
    return body.select("dump", "table_name", F.posexplode(lines).alias("line", "item")).filter(F.col("item") != "")


def mysql_columns(statements: DataFrame) -> DataFrame:
    """Columns without key flags."""
    named = tokens.computed(
        _items(statements).filter(F.col("item").rlike(MYSQL_COLUMN)), "dump", "table_name", "line",
        mysql_name(F.regexp_extract("item", MYSQL_COLUMN, 1)).alias("column_name"),
        F.regexp_extract("item", MYSQL_COLUMN, 2).alias("rest"),
    )
    split = tokens.computed(
        named, *named.columns, F.trim(F.regexp_extract("rest", MYSQL_TYPE, 1)).alias("src_type"), F.upper("rest").alias("upper")
    )
    return tokens.computed(
        split,
        "dump",
        "table_name",
        "line",
        "column_name",
        "src_type",
        mysql_logical(F.col("src_type")).alias("type"),
        F.contains("upper", F.lit("NOT NULL")).alias("not_null"),
        F.contains("upper", F.lit("AUTO_INCREMENT")).alias("auto_increment"),
    ).withColumn("pos", F.row_number().over(Window.partitionBy("dump", "table_name").orderBy("line")) - 1)


def mysql_constraints(statements: DataFrame) -> DataFrame:
    item = F.col("item")
    is_key, is_fk = item.rlike(MYSQL_KEY), item.rlike(r"(?i)\A\s*CONSTRAINT\s")

    def key(s: Column) -> Column:
        return _rule(
            F.col("table_name"),
            F.when(s["kind"] == "PRIMARY", "pk").when(s["kind"] == "UNIQUE", "unique").otherwise("index"),
            F.when(s["name"] != "", s["name"]).otherwise(F.lit("PRIMARY")), index_columns(s["columns"]),
            F.lit(None).cast("string"), F.lit(None).cast("array<string>"),
        )

    parts = F.struct(
        F.upper(F.regexp_extract("item", MYSQL_KEY, 1)).alias("kind"), F.regexp_extract("item", MYSQL_KEY, 2).alias("name"),
        F.regexp_extract("item", MYSQL_KEY, 3).alias("columns"),
    )
    lexed = tokens.bound(
        tokens.tokens(item, mysql=True), lambda t: F.struct(t.alias("stream"), tokens.lexemes(t).alias("lex"))
    )
    fk = tokens.bound(lexed, lambda s: _constraint(F.col("table_name"), s["stream"], s["lex"]))
    rule = F.when(is_key, tokens.bound(parts, key)).when(is_fk, fk)
    return _items(statements).select("dump", F.inline(_stated(rule)))


def _constraint(table: Column, stream: Column, lex: Column) -> Column:
    """The foreign key of one CONSTRAINT item of a CREATE TABLE."""
    kind, opened = _key(lex, F.lit(2))

    def rule(to: Column) -> Column:
        last = F.element_at(F.split(to["table"], r"\.(?=[^`]*(?:`[^`]*`[^`]*)*$)"), -1)
        made = _rule(
            table, kind, mysql_name(tokens.text_at(lex, 1)), name_list(_listed(stream, lex, opened)),
            mysql_name(last), name_list(to["listed"]),
        )
        return F.when(to["listed"].isNotNull(), made)

    return F.when((kind == "fk") & tokens.is_at(lex, opened, "("), tokens.bound(_references(stream, lex), rule))


def all_fields(columns: DataFrame) -> dict[str, list[Field]]:
    """Declared fields of every table, in order: one row per table reaches the driver.

    Dumps of several servers may declare the same table; the first dump by name wins.
    """
    entry = F.struct("pos", "column_name", "type", "src_type")
    per_dump = columns.groupBy("table_name", "dump").agg(F.array_sort(F.collect_set(entry)).alias("fields"))
    rows = per_dump.groupBy("table_name").agg(F.min_by("fields", "dump").alias("fields")).collect()
    return {r.table_name: [Field(c.column_name, c.type, c.src_type) for c in r.fields] for r in rows}


def empty_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "dump string, block long, pos long, value string")
