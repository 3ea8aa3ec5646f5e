"""Plain ``pg_dump`` files: COPY blocks as tables.

A line belongs to a table when it lies between the COPY header and the ``\\.`` line of its
file, so lines carry an order key ``(dump, block, pos)``: file, start of the text split, and
running number inside it. A first pass finds headers and end markers and resolves them with
windows over one split at a time, plus one row per split across the file. What reaches the
driver are table and column names. Reading a table is then a filter on key ranges.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dumpdeck.functions import tokens
from dumpdeck.functions.escapes import bare_name, copy_unescape, name_list, split_fields
from dumpdeck.functions.rows import accepted, part_key, typed_rows
from dumpdeck.functions.types import Field
from dumpdeck.session import pin_splits, shared_folder
from dumpdeck.sources import ddl

END = "\\."
# Lines that may carry DDL: statement starts, indented bodies, closing parentheses. Data lines
# whose first field is empty start with a tab and mostly hold another one, so they are left out.
MAYBE_DDL = r"(?i)^( +\S|\s+[^\s][^\t]*$|\)|CREATE\s|ALTER\s)"
FIRST_CHARS = [" ", "\t", "\f", "\v", "C", "c", "A", "a", ")", "\\"]

# Lines of a split are met with the COPY blocks of their part of it, of this many lines.
PART = 256
# More blocks than these are sorted and merged with the lines: judged by their compressed file they would be broadcast.
BROADCAST_BLOCKS = 100_000


def copy_header(line: Column) -> Column:
    """``(table_name, header)`` of a line that opens COPY data, else null."""

    def read(s: Column) -> Column:
        lex = s["lex"]
        return tokens.bound(tokens.place(lex, "("), lambda opened: tokens.bound(tokens.closing(lex, opened), lambda c: named(s, opened, c)))

    def named(s: Column, opened: Column, closed: Column) -> Column:
        stream, lex = s["stream"], s["lex"]
        dotted = tokens.is_at(lex, opened - 2, ".")
        last = tokens.text_at(lex, opened - 1)
        name = F.when(dotted, F.concat_ws(".", tokens.text_at(lex, opened - 3), last)).otherwise(last)
        ok = tokens.is_at(lex, 0, "COPY") & (opened == F.when(dotted, 4).otherwise(2))
        header = name_list(tokens.between(stream, lex, opened, closed))
        return F.when(
            ok & tokens.is_at(lex, closed + 1, "FROM", "STDIN", ";"),
            F.struct(bare_name(name).alias("table_name"), header.alias("header")),
        )

    def lexed(stream: Column) -> Column:
        return tokens.bound(F.struct(stream.alias("stream"), tokens.lexemes(stream).alias("lex")), read)

    return F.when(line.rlike(r"(?i)\A\s*COPY\s.*STDIN"), tokens.bound(tokens.tokens(line), lexed))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(dump, block, pos, value, length, size)`` for every line; the key follows the order in the file.

    ``length`` is that of the split and ``size`` that of the file.

    Both passes must use this plan unchanged: the key depends on the splits.
    """
    pin_splits(spark)
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("dump"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
        F.col("_metadata.file_block_length").alias("length"),
        F.col("_metadata.file_size").alias("size"),
    )


def _candidates(lines: DataFrame) -> DataFrame:
    """The few lines that may be headers (kind H), end markers (T) or DDL."""
    kind = F.when(F.col("value") == END, "T").when(F.col("copy").isNotNull(), "H")
    # The first character settles most data lines without running a pattern over them.
    first = lines.filter(F.substring("value", 1, 1).isin(FIRST_CHARS))
    return (
        tokens.computed(first, *lines.columns, copy_header(F.col("value")).alias("copy"))
        .withColumn("kind", kind)
        .filter(F.col("kind").isNotNull() | F.col("value").rlike(MAYBE_DDL))
        .withColumn("chunk", F.floor(F.col("pos") / ddl.CHUNK))
    )


def _resolve(found: DataFrame) -> DataFrame:
    """Add ``inside``: the line stands within COPY data.

    After a header everything is data until the end marker, also lines that look like headers. Windows stand over chunks
    of a split; only one row per chunk is looked at across the file.
    """
    chunk = ["dump", "block", "chunk"]
    order = Window.partitionBy(*chunk).orderBy("pos")
    marked = found.withColumn("previous", F.last("kind", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # What a chunk starts inside of: the last marker of the chunks before it.
    across = Window.partitionBy("dump").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    entry = (
        marked.withColumn("next", F.lead("pos").over(order))
        .filter("next IS NULL")
        .select(*chunk, F.last(F.coalesce("kind", "previous"), True).over(across).alias("entry_kind"))
    )
    state = F.coalesce("previous", "entry_kind", F.lit("T"))
    resolved = marked.join(entry, chunk).withColumn("inside", state == "H")
    return resolved.drop("previous", "entry_kind")


class PgDump:
    """One or many plain dumps under ``path`` (gz, bz2 and zst are read in place)."""

    dialect = "pg"

    def __init__(self, spark: SparkSession, path: str | list[str]):
        self.spark = spark
        self.lines = read_lines(spark, path)
        # One scan of the text serves headers, end markers and DDL. Dealt out by chunks of a split, the
        # lines found leave the many partitions of the scan and stand as the windows need them.
        self._found = _candidates(self.lines).repartition("dump", "block", "chunk").persist()
        self._marks = _resolve(self._found).persist()
        self._ddl = self._marks.filter(~F.col("inside") & F.col("kind").isNull()).select(
            "dump", "block", "pos", "value"
        )
        # Block metadata is written: tables read from it, and none needs the cached lines any more.
        folder = shared_folder(spark, "copy-blocks")
        found = self._find_blocks()
        found.write.parquet(folder)
        self.blocks = spark.read.schema(found.schema).parquet(folder)

    @cached_property
    def columns(self) -> DataFrame:
        return ddl.pg_schema(self._ddl)[0]

    @cached_property
    def constraints(self) -> DataFrame:
        return ddl.pg_constraints(self._ddl)

    def close(self) -> None:
        for cached in (self._marks, self._found):
            cached.unpersist()

    def _find_blocks(self) -> DataFrame:
        """One row per COPY block: table, header columns and key range of its data lines."""
        real = self._marks.filter(
            ((F.col("kind") == "H") & ~F.col("inside")) | ((F.col("kind") == "T") & F.col("inside"))
        )
        chunk = ["dump", "block", "chunk"]
        order = Window.partitionBy(*chunk).orderBy("pos")
        ends = real.withColumns({"end": F.lead("pos").over(order), "before": F.lag("pos").over(order)})
        # A block that its chunk leaves open ends at the first marker of the next chunk that has any.
        across = Window.partitionBy("dump").orderBy("block", "chunk")
        later = ends.filter("before IS NULL").select(
            *chunk, F.lead("block").over(across).alias("later_block"), F.lead("pos").over(across).alias("later_pos")
        )
        closed = F.col("end").isNotNull()
        return (
            ends.filter("kind = 'H'")
            .join(later, chunk)
            .select(
                F.col("dump").alias("in_dump"),
                "copy.table_name",
                "copy.header",
                "length",
                "size",
                F.col("block").alias("start_block"),
                F.col("pos").alias("start_pos"),
                F.when(closed, F.col("block")).otherwise(F.col("later_block")).alias("end_block"),
                F.when(closed, F.col("end")).otherwise(F.col("later_pos")).alias("end_pos"),
            )
        )

    @cached_property
    def _n_blocks(self) -> int:
        return self.blocks.count()

    @cached_property
    def fields(self) -> dict[str, list[Field]]:
        return ddl.all_fields(ddl.pg_columns(self._ddl))

    @cached_property
    def headers(self) -> dict[str, list[list[str]]]:
        """Distinct column orders of each table's COPY blocks."""
        out: dict[str, list[list[str]]] = {}
        for r in self.blocks.select("table_name", "header").distinct().orderBy("table_name", "header").collect():
            out.setdefault(r.table_name, []).append(r.header)
        return out

    def _within(self, blocks: DataFrame) -> DataFrame:
        """Data lines of the given blocks, with table name and header.

        A block is clipped to the splits it covers: all splits of a file but the last have one length. In a split, at
        most one block comes in from the split before and one goes on into the next; they are met by
        ``(dump, split)`` and broadcast, as they are two per split. Blocks within a split are met by parts of it, so a
        line is held against the few blocks of its part; many blocks are sorted and merged with the lines.
        """
        last = F.when(F.col("start_block") + F.col("length") >= F.col("size"), F.col("start_block")).otherwise(
            F.floor((F.col("size") - 1) / F.col("length")) * F.col("length")
        )
        splits = F.sequence("start_block", F.coalesce("end_block", F.greatest(last, "start_block")), F.greatest("length", F.lit(1)))
        clipped = blocks.withColumn("split", F.explode(splits)).select(
            "in_dump", "split", "table_name", "header",
            F.when(F.col("split") == F.col("start_block"), F.col("start_pos")).alias("low"),
            F.when(F.col("split") == F.col("end_block"), F.col("end_pos")).alias("high"),
        )
        whole = "low IS NOT NULL AND high IS NOT NULL"
        going = clipped.filter(f"NOT ({whole})").select(
            F.col("in_dump").alias("g_dump"), F.col("split").alias("g_split"), F.col("low").alias("g_low"),
            F.col("high").alias("g_high"), F.struct("table_name", "header").alias("going"),
        )
        parts = F.sequence(F.floor(F.col("low") / PART), F.floor(F.col("high") / PART))
        inner = clipped.filter(whole).withColumn("part", F.explode(parts)).drop("split").withColumnRenamed("in_dump", "i_dump")
        inner = inner.select("i_dump", "part", "low", "high", F.struct("table_name", "header").alias("inner"))
        if self._n_blocks > BROADCAST_BLOCKS:
            inner = inner.hint("merge")
        pos = F.col("pos")
        goes = (F.col("g_low").isNull() | (pos > F.col("g_low"))) & (F.col("g_high").isNull() | (pos < F.col("g_high")))
        met = (
            self.lines.select("dump", "block", "pos", "value")
            .join(F.broadcast(going), (F.col("dump") == F.col("g_dump")) & (F.col("block") == F.col("g_split")) & goes, "left")
            .join(
                inner,
                (F.col("dump") == F.col("i_dump")) & (F.floor(pos / PART) == F.col("part")) & (pos > F.col("low")) & (pos < F.col("high")),
                "left",
            )
        )
        found = met.select("dump", "value", F.coalesce("inner", "going").alias("_in")).filter("_in IS NOT NULL")
        return found.select("dump", "value", "_in.table_name", "_in.header")

    def tables(self) -> list[str]:
        """Declared tables; COPY blocks without a CREATE TABLE are skipped."""
        return sorted(self.fields)

    def counts(self) -> DataFrame:
        """``(table_name, n)``: data lines per declared table, 0 where there are none."""
        declared = ddl.pg_columns(self._ddl).select("table_name").distinct()
        counted = self._within(self.blocks).groupBy("table_name").count()
        return declared.join(counted, "table_name", "left").select(
            "table_name", F.coalesce("count", F.lit(0)).alias("n")
        )

    def stage(self, folder: str) -> None:
        """Write the raw lines of all tables once, split by table and header, for many reads."""
        self._within(self.blocks).select(
            "dump", "value", "table_name", "header", part_key(F.col("table_name"), F.to_json("header")).alias("part")
        ).write.mode("overwrite").partitionBy("part").parquet(folder)

    def rows(
        self, table: str, staged: str | None = None, spread: int | None = None, **options
    ) -> DataFrame:
        """Typed rows with bookkeeping columns (see ``functions.rows``).

        ``spread`` deals the raw lines out to that many partitions first, for compressed files
        that one task has to read.
        """
        declared = {f.name.lower(): f for f in self.fields.get(table, [])}
        blocks = self.blocks.filter(F.col("table_name") == table)
        if not declared:
            raise ValueError(f"table {table} is not declared in the dump")
        parts = []
        # One plan per distinct column order; dumps of one schema share it.
        for header in self.headers.get(table, []):
            fields = [Field(h, *_kind(declared.get(h.lower()))) for h in header]
            if staged:
                names = F.array(*map(F.lit, header))
                raw = self.spark.read.parquet(staged).filter(
                    (F.col("part") == part_key(F.lit(table), F.to_json(names)))
                    & (F.col("table_name") == table)
                    & (F.col("header") == names)
                )
            else:
                raw = self._within(blocks.filter(F.col("header") == F.array(*map(F.lit, header))))
            if spread:
                raw = raw.select("dump", "value").repartition(spread)
            records = raw.select("dump", F.col("value").alias("raw"), split_fields(F.col("value")).alias("tokens"))
            parts.append(typed_rows(records, fields, "pg", copy_text, **options))
        if not parts:
            records = ddl.empty_lines(self.spark).select(
                "dump", F.col("value").alias("raw"), split_fields(F.col("value")).alias("tokens")
            )
            parts.append(typed_rows(records, list(declared.values()), "pg", copy_text, **options))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _kind(field: Field | None) -> tuple[str, str]:
    return (field.type, field.src_type) if field else ("TEXT", "")


def copy_text(token: Column, escaped: bool = True) -> Column:
    return F.when(token != "\\N", copy_unescape(token) if escaped else token)


def read_pgdump(spark: SparkSession, path: str | list[str], table: str, **options) -> DataFrame:
    """Rows of one table from its COPY blocks."""
    dump = PgDump(spark, path)
    rows = accepted(dump.rows(table, **options))
    dump.close()
    return rows
