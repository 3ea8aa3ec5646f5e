"""``mysqldump`` files: one statement per record, INSERT row groups as tables.

The dump tool writes every statement on its own and caps its length, and escapes newlines
inside strings, so ``;`` + line end separates statements and splits stay independent. Two things need the
order of records: bodies of triggers and routines, between DELIMITER lines, are not data; and other
writers leave line ends in strings and comments, which cuts a statement.

A record is a function from the lexer state it starts in to the one it ends in (see ``STATES``). Complete
INSERTs, nearly all of a dump, change no state; the functions of the other records are composed
per split, a scan over one row per split of a file gives the state each split starts in, and the states inside
a split follow from that. Nothing is ordered, or gathered, by file. Where no record leaves the plain state, as in
dumps without routines, the functions alone settle that and nothing else runs. A string or comment that
never ends swallows the rest of its file, as it would for the server, and is one reject.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dumpdeck.functions.escapes import mysql_unescape, name_list
from dumpdeck.functions.rows import accepted, part_key, typed_rows
from dumpdeck.functions.types import Field
from dumpdeck.session import pin_splits, shared_folder
from dumpdeck.sources import ddl
from dumpdeck.sources.detect import detect_files

LEADING = r"\A(?:\s++|--[^\n]*+(?:\n|\z)|/\*(?!!)(?s:.*?)\*/)++"
INTO = rf"\AINSERT\s+(?:IGNORE\s+)?INTO\s+(?:{ddl.MYSQL_NAME}\s*\.\s*)?({ddl.MYSQL_NAME})"
INSERT = rf"(?is){INTO}\s*(?:\(((?:[^()`]++|`[^`]*+`)*+)\)\s*)?VALUES\s*(.*)\z"
TARGET = rf"(?i){INTO}"
ROW_GROUP = r"(?s)\((?:[^'()]++|'(?:[^'\\]++|\\.|'')*+')*+\)"
TOKEN = r"(?s)(?:_binary\s+)?'(?:[^'\\]++|\\.|'')*+'|[^,'()\s][^,']*+"
STATES = "PSCD"  # plain, in a string, in a comment, between DELIMITER lines
SAME = STATES
INSIDE = r"(?:[^'\\]++|\\.|''|\\\z)*+"
DELIMITER = r"(?im)^[ \t]*DELIMITER(?:[ \t][^\r\n]*+|(?=\r?$))"
# Whatever hides quotes and comment marks from what follows, up to its end or the record's.
LEX = (
    rf"(?s)'{INSIDE}(?:'|\z)|`[^`]*+(?:`|\z)|--(?=\s|\z)[^\n]*+|\#[^\n]*+|/\*.*?(?:\*/|\z)"
    r"|(?im:^[ \t]*DELIMITER(?:[ \t][^\r\n]*+|(?=\r?$)))"
)
MARKS = r"--|\#|[*]/|/[*]|(?i:delimiter)"
# Records of one split are looked up in blocks of this many.
BLOCK = 256
# Openings of statements and lines that carry no table data.
SKIPPED = ["LOCK TABLES", "UNLOCK TABLES", "DROP TABLE", "SET ", "USE ", "CREATE DATABASE", "--", "/*!"]


def skippable(text: Column) -> Column:
    """True for statements that neither declare nor fill a table."""
    return F.substring(text, 1, 256).rlike(r"(?i)^\s*(" + "|".join("\\Q" + s + "\\E" for s in SKIPPED) + ")")


def _opens(statement: Column, pattern: str) -> Column:
    """Test how a statement begins, without running the pattern over all of it.

    Openings fit in 512 characters: names have 64 at most.
    """
    return F.substring(statement, 1, 512).rlike(pattern)


def _target() -> Column:
    """Table an INSERT statement fills."""
    return ddl.mysql_name(F.regexp_extract(F.substring("statement", 1, 512), TARGET, 1))


def _open_string(text: Column) -> Column:
    """1 where the text ends inside a string, else 0: an odd number of quotes that aren't escaped."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit("\\'"), F.lit(""))
    return F.pmod(F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit("'"), F.lit(""))), F.lit(2))


def read_records(spark: SparkSession, path: str | list[str], crlf: bool | None = None) -> DataFrame:
    """``(dump, split, nth, value, end)``: text between statement ends, in the line ends of each file.

    The first line end of a file tells which it has; where all files agree they are read as given,
    else by name.
    """
    pin_splits(spark)

    def read(where, end: str) -> DataFrame:
        return spark.read.option("lineSep", end).text(where).select(
            F.col("_metadata.file_path").alias("dump"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("nth"),
            "value",
            F.lit(end).alias("end"),
        )

    ends = {True: ";\r\n", False: ";\n"}
    if crlf is not None:
        return read(path, ends[crlf])
    files = [detect_files(spark, one) for one in ([path] if isinstance(path, str) else path)]
    kinds = {r.crlf for f in files for r in f.select("crlf").distinct().collect()}
    if len(kinds) < 2:
        return read(path, ends[next(iter(kinds), False)])
    # Only a mixed folder is read by file name; Spark holds the list of files on the driver anyway.
    parts = []
    for kind in (False, True):
        names = [r.path for f in files for r in f.filter(F.col("crlf") == kind).select("path").collect()]
        parts.append(read(names, ends[kind]))
    return parts[0].unionByName(parts[1])


def read_statements(spark: SparkSession, path: str | list[str], crlf: bool | None = None) -> DataFrame:
    """``(dump, split, nth, end, statement, raw)`` without leading comments; raw is the record as it is."""
    return read_records(spark, path, crlf).select(
        "dump", "split", "nth", "end", bare_statement(F.col("value")).alias("statement"), F.col("value").alias("raw")
    )


def bare_statement(value: Column) -> Column:
    # Nearly all of the text is INSERTs that follow another statement directly.
    text = F.when(value.startswith("INSERT"), value).otherwise(F.regexp_replace(value, LEADING, ""))
    return F.rtrim(text, F.lit("; \t\r\n"))


def _is_insert() -> Column:
    return _opens(F.col("statement"), r"(?i)\AINSERT\s")


def steady() -> Column:
    """True for records that leave every state as it is: complete INSERTs that end no comment and no routine."""
    tail = F.upper(F.substring("raw", -16, 16))
    return (
        _is_insert()
        & (_open_string(F.col("raw")) == 0)
        & ~F.contains("raw", F.lit("*/"))
        & ~F.contains(tail, F.lit("DELIMITER"))
    )


def _last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def _delimits(line: Column) -> Column:
    """Whether a DELIMITER line sets another mark than ``;``, which the record's end takes from the line."""
    return F.trim(F.regexp_extract(line, r"(?i)DELIMITER([^\r\n]*)", 1)) != ""


def _lexed(text: Column) -> Column:
    """State at the end of a text that starts plain."""
    tokens = F.regexp_extract_all(text, F.lit(LEX), F.lit(0))
    last, line = _last(tokens), _last(F.filter(tokens, lambda t: t.rlike(r"(?i)\A[ \t]*DELIMITER")))
    unclosed = last.startswith("/*") & (~last.endswith("*/") | (F.length(last) < 4))
    return (
        F.when(line.isNotNull() & _delimits(line), "D")
        .when(last.startswith("'") & ~last.rlike(rf"(?s)\A'{INSIDE}'\z"), "S")
        .when(unclosed, "C")
        .otherwise("P")
    )


def transitions(raw: Column) -> Column:
    """The states a record ends in, one letter for each of ``STATES`` that it may start in."""
    inside = F.regexp_extract(raw, rf"(?s)\A{INSIDE}", 0)
    string = F.when(F.length(inside) == F.length(raw), "S").otherwise(_lexed(F.substr(raw, F.length(inside) + 2)))
    ends = F.instr(raw, "*/")
    comment = F.when(ends == 0, "C").otherwise(_lexed(F.substr(raw, ends + 2)))
    line = _last(F.regexp_extract_all(raw, F.lit(DELIMITER), F.lit(0)))
    body = F.when(line.isNull() | _delimits(line), "D").otherwise("P")
    # Without marks only the number of quotes matters.
    turned = F.when(_open_string(raw) == 1, "SPCD").otherwise(SAME)
    return F.when(raw.rlike(MARKS), F.concat(_lexed(raw), string, comment, body)).otherwise(turned)


def _then(first: Column, second: Column) -> Column:
    """Composition of two functions; or the state after one."""
    return F.call_function("translate", first, F.lit(STATES), second)


def _entries(table: pa.Table) -> pa.Table:
    """State in which each split of a file starts, one row per split."""
    table = table.sort_by("split")
    state, found = "P", []
    for fn in table["fn"].to_pylist():
        found.append(state)
        state = fn[STATES.index(state)]
    return table.select(["dump", "split", "low", "high"]).append_column("entry", pa.array(found, pa.string()))


def _states(table: pa.Table) -> pa.Table:
    """State in which each record of a split starts."""
    table = table.sort_by("nth")
    state, found = table["entry"][0].as_py(), []
    for fn in table["fn"].to_pylist():
        found.append(state)
        state = fn[STATES.index(state)]
    return table.select(["dump", "split", "nth", "fn"]).append_column("state", pa.array(found, pa.string()))


def _written(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Lexed:
    """States of the records of a dump, from the functions of those that may change it."""

    def __init__(self, records: DataFrame, others: DataFrame):
        keys = ["dump", "split"]
        narrow = others.select(*keys, "nth", "fn")
        steps = F.transform(F.array_sort(F.collect_list(F.struct("nth", "fn"))), lambda s: s["fn"])
        composed = narrow.groupBy(*keys).agg(F.aggregate(steps, F.lit(SAME), _then).alias("fn"))
        bounds = records.groupBy(*keys).agg(F.min("nth").alias("low"), F.max("nth").alias("high"))
        splits = bounds.join(composed, keys, "left").withColumn("fn", F.coalesce("fn", F.lit(SAME)))
        entries = splits.groupBy("dump").applyInArrow(
            _entries, "dump string, split long, low long, high long, entry string"
        )
        # Small tables, written: later plans start from them instead of repeating how they came about.
        self._entries = _written(entries, "lexer-splits")
        started = narrow.join(self._entries.select(*keys, "entry"), keys).groupBy(*keys)
        states = started.applyInArrow(_states, "dump string, split long, nth long, fn string, state string")
        # A record that starts plain begins a statement; those that do not go on with the last one begun.
        begun = F.when(F.col("state") == "P", F.struct("split", "nth"))
        own = Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
        states = states.withColumns({"own": F.last(begun, True).over(own), "after": _then(F.col("state"), F.col("fn"))})
        self.states = _written(states.drop("fn"), "lexer-records")
        last = self.states.groupBy(*keys).agg(F.max("own").alias("own"))
        earlier = Window.partitionBy("dump").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        self._carried = (
            self._entries.join(last, keys, "left")
            .select(*keys, "entry", "low", "high", F.last("own", True).over(earlier).alias("carried"))
        )

    def headed(self) -> DataFrame:
        """``(dump, split, nth, state, after, head)``: the place where a record's statement begins."""
        carried = self._carried.select("dump", "split", "carried")
        return self.states.join(carried, ["dump", "split"]).select(
            "dump", "split", "nth", "state", "after", F.coalesce("own", "carried").alias("head")
        )

    def stretches(self) -> DataFrame:
        """``(dump, split, block, low, high, in_state, head)``: records between others that do not start plain.

        Cut at blocks of records, so that a record meets the few stretches of its block only.
        """
        order = Window.partitionBy("dump", "split").orderBy("nth")
        bounds = self._carried.select("dump", "split", "high")
        between = self.headed().join(bounds, ["dump", "split"]).select(
            "dump", "split", (F.col("nth") + 1).alias("low"),
            F.coalesce(F.lead("nth").over(order) - 1, F.col("high")).alias("high"),
            F.col("after").alias("in_state"), "head",
        )
        first = self.states.groupBy("dump", "split").agg(F.min("nth").alias("first"))
        before = self._carried.join(first, ["dump", "split"], "left").select(
            "dump", "split", "low", F.coalesce(F.col("first") - 1, F.col("high")).alias("high"),
            F.col("entry").alias("in_state"), F.col("carried").alias("head"),
        )
        both = between.unionByName(before).filter("in_state <> 'P' AND low <= high")
        block = F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK)))
        return _written(both.withColumn("block", block), "lexer-stretches")


def _blocked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("nth") / BLOCK))


def _within(how: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def join(rows: DataFrame, stretches: DataFrame) -> DataFrame:
        s = stretches.select(
            F.col("dump").alias("in_dump"), F.col("split").alias("in_split"), F.col("block").alias("in_block"),
            "low", "high", "in_state", "head",
        )
        same = (F.col("dump") == F.col("in_dump")) & (F.col("split") == F.col("in_split")) & (F.col("block") == F.col("in_block"))
        return _blocked(rows).join(s, same & F.col("nth").between(F.col("low"), F.col("high")), how)

    return join


def rejoined(others: DataFrame, inside: DataFrame | None, headed: DataFrame) -> DataFrame:
    """``(dump, statement)`` of the records that are not steady, and of whole statements that were cut.

    ``inside`` has the steady records within strings and comments, with their ``head``.
    """
    keys = ["dump", "split", "nth"]
    parts = others.join(headed, keys)
    alone = parts.filter("state = 'P' AND after = 'P'").select("dump", "statement")
    opened = parts.filter("after IN ('S', 'C') OR state IN ('S', 'C')")
    columns = ["dump", "split", "nth", "end", "raw", "head"]
    ends = opened.select(*columns, (F.col("after") == "P").alias("ends"))
    whole = ends.unionByName(inside.select(*columns, F.lit(False).alias("ends"))) if inside else ends
    # A statement that never ends is its first record alone: the rest of the file is not gathered.
    ended = whole.groupBy("dump", "head").agg(F.bool_or("ends").alias("ended"))
    first = F.struct("split", "nth") == F.col("head")
    kept = whole.join(ended, ["dump", "head"]).filter(F.col("ended") | first)
    grouped = kept.groupBy("dump", "head").agg(
        F.array_sort(F.collect_list(F.struct("split", "nth", "raw"))).alias("parts"), F.first("end").alias("end")
    )
    text = F.array_join(F.transform("parts", lambda r: r["raw"]), "\0;")
    joined = F.replace(text, F.lit("\0;"), F.col("end"))
    return alone.unionByName(grouped.select("dump", bare_statement(joined).alias("statement")))


def row_groups(statements: DataFrame, fields: list[Field] | None = None) -> DataFrame:
    """``(dump, table_name, raw, tokens, broken)``: one row per ``(...)`` of the INSERTs.

    Tokens stand in the order of ``fields`` where the INSERT lists its columns. What follows the last
    whole group of a statement that ends inside a string is unusable and gives one more row with
    ``broken`` set.
    """
    body = F.col("body")
    listed = F.transform(name_list(F.regexp_extract("statement", INSERT, 2)), lambda c: F.lower(F.trim(c)))
    wanted = F.array(*[F.lit(f.name.lower()) for f in fields or []]).cast("array<string>")
    parsed = (
        statements.filter(_is_insert())
        .select(
            "dump",
            _target().alias("table_name"),
            listed.alias("listed"),
            F.regexp_extract("statement", INSERT, 3).alias("body"),
        )
        .filter(F.col("table_name") != "")
        .select(
            "dump",
            "table_name",
            F.size("listed").alias("n_listed"),
            # Place of each field in the list of the INSERT, from 0; missing ones give null.
            F.transform(wanted, lambda c: F.nullif(F.array_position("listed", c), F.lit(0)) - 1).alias("places"),
            F.regexp_extract_all("body", F.lit(ROW_GROUP), F.lit(0)).alias("groups"),
            F.when(_open_string(body) == 1, F.substring_index("body", "(", -1)).alias("cut"),
        )
    )

    def row(group: Column) -> Column:
        inner = F.substr(group, F.lit(2), F.length(group) - 2)
        return F.struct(group.alias("raw"), F.regexp_extract_all(inner, F.lit(TOKEN), F.lit(0)).alias("found"))

    def placed(r: Column) -> Column:
        found = r["found"]
        by_place = F.transform("places", lambda p: F.get(found, p.cast("int")))
        listed_right = F.when(F.size(found) == F.col("n_listed"), by_place).otherwise(F.array().cast("array<string>"))
        tokens = F.when(F.col("n_listed") == 0, found).otherwise(listed_right)
        return F.struct(r["raw"].alias("raw"), tokens.alias("tokens"), F.lit(False).alias("broken"))

    # Tokens are cut inside the generated rows, so later filters on them do not cut them again.
    good = F.transform(F.transform("groups", row), placed)
    unusable = F.struct(
        F.col("cut").alias("raw"), F.array().cast("array<string>").alias("tokens"), F.lit(True).alias("broken")
    )
    items = F.when(F.col("cut").isNull(), good).otherwise(F.concat(good, F.array(unusable)))
    return parsed.select("dump", "table_name", F.inline(items))


def literal_text(token: Column, escaped: bool = True) -> Column:
    """Value of one INSERT token as text: NULL, quoted string or bare literal."""
    bare = F.trim(token)
    if not escaped:
        return F.when(F.upper(bare) != "NULL", F.btrim(bare, F.lit("'")))
    start = F.when(token.startswith("_binary"), F.instr(token, "'")).otherwise(1)
    inside = F.substr(token, start + 1, F.length(token) - start - 1)
    return F.when(token.endswith("'"), mysql_unescape(inside)).when(F.upper(bare) != "NULL", bare)


class MysqlDump:
    """One or many mysqldump files under ``path``."""

    dialect = "mysql"

    def __init__(self, spark: SparkSession, path: str | list[str], crlf: bool | None = None):
        self.spark = spark
        records = read_statements(spark, path, crlf)
        # Everything but complete INSERTs, found in one scan however many tables are asked for.
        others = records.filter(~steady()).withColumn("fn", transitions(F.col("raw")))
        self._others = others.repartition("dump", "split").persist()
        self._cached = [self._others]
        inserts = records.filter(steady())
        if self._others.filter(~F.col("fn").startswith("P")).isEmpty():
            rest = self._others.select("dump", "statement")
        else:
            lexed = Lexed(read_records(spark, path, crlf), self._others)
            stretches, headed, inside = lexed.stretches(), lexed.headed(), None
            if not stretches.isEmpty():  # INSERTs stand in strings, comments or routines
                inside = _within("inner")(inserts, stretches.filter("in_state IN ('S', 'C')"))
                inserts = _within("left_anti")(inserts, stretches)
            rest = rejoined(self._others, inside, headed).persist()
            self._cached.append(rest)
        self.statements = inserts.select("dump", "statement").unionByName(rest.filter(_is_insert()))
        self._creates = rest.filter(_opens(F.col("statement"), r"(?i)\ACREATE\s") & ~skippable(F.col("statement")))

    @cached_property
    def columns(self) -> DataFrame:
        return ddl.mysql_schema(self._creates)[0]

    @cached_property
    def constraints(self) -> DataFrame:
        return ddl.mysql_constraints(self._creates)

    def close(self) -> None:
        for cached in self._cached:
            cached.unpersist()

    @cached_property
    def fields(self) -> dict[str, list[Field]]:
        return ddl.all_fields(ddl.mysql_columns(self._creates))

    def tables(self) -> list[str]:
        return sorted(self.fields)

    def counts(self) -> DataFrame:
        declared = ddl.mysql_columns(self._creates).select("table_name").distinct()
        inserts = self.statements
        groups = F.regexp_count(F.regexp_extract("statement", INSERT, 3), F.lit(ROW_GROUP))
        counted = inserts.groupBy(_target().alias("table_name")).agg(F.sum(groups).alias("n"))
        return declared.join(counted, "table_name", "left").select(
            "table_name", F.coalesce("n", F.lit(0)).alias("n")
        )

    def stage(self, folder: str) -> None:
        """Write the INSERT statements once, split by table, for many reads."""
        named = self.statements.withColumn("into_table", _target()).filter("into_table <> ''")
        named.withColumn("part", part_key(F.col("into_table"))).write.mode("overwrite").partitionBy("part").parquet(folder)

    def rows(
        self, table: str, staged: str | None = None, spread: int | None = None, **options
    ) -> DataFrame:
        """Typed rows with bookkeeping columns (see ``functions.rows``).

        ``spread`` deals the statements out to that many partitions first, for compressed files
        that one task has to read.
        """
        fields = self.fields.get(table)
        if not fields:
            raise ValueError(f"table {table} is not declared in the dump")
        if staged:
            source = self.spark.read.parquet(staged).filter((F.col("part") == part_key(F.lit(table))) & (F.col("into_table") == table))
        else:
            source = self.statements.filter(_target() == table)
        if spread:
            source = source.repartition(spread)
        return typed_rows(row_groups(source, fields), fields, "mysql", literal_text, **options)


def read_mysqldump(
    spark: SparkSession, path: str | list[str], table: str, crlf: bool | None = None, **options
) -> DataFrame:
    """Rows of one table from its INSERT statements."""
    dump = MysqlDump(spark, path, crlf)
    rows = accepted(dump.rows(table, **options))
    dump.close()
    return rows

