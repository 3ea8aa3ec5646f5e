"""Indexes that are written once and looked up often: log search by trigrams, names by prefix.

A search index is the log in sorted parts, each cut into blocks of rows, and the blocks in which each trigram
of the lower-cased text occurs. A term can only be in blocks that hold all its trigrams; the rows of these are
read and checked, so results equal ``history.search``.

A prefix dictionary is the distinct (name, priority) pairs in order of the lower-cased name, front-coded in
blocks. Each block tells its first and last key, its best priority and the least name that has it, so a top-k
lookup decodes k blocks at most, besides the two that the prefix cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dumpdeck.operators import history

GRAM = 3
# Rows of the log, and names of the dictionary, per block.
ROWS, NAMES = 64, 128
PART, BLOCK, DATABASE = "_ix_part", "_ix_block", "_ix_database"


def _blocks(sorted_rows: DataFrame, size: int) -> DataFrame:
    """Number the partitions, and the blocks of ``size`` rows inside each."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_rows.withColumns({PART: F.spark_partition_id(), BLOCK: F.floor(row / size).cast("int")})


def _grams(signs: str) -> Column:
    """Distinct trigrams of an array of code points. It must be a column: an expression is run for every element."""
    return F.array_distinct(
        F.filter(
            F.transform(signs, lambda c, i: F.concat(c, F.get(signs, i + 1), F.get(signs, i + 2))),
            lambda g: g.isNotNull(),
        )
    )


def write_search_index(log: DataFrame, path: str, parts: int) -> None:
    """Write ``log(database_path, sql, executed_at, …)`` and its trigram postings to ``path``.

    Rows are ordered by database and time; a hash of the text divides rows of the same instant. Rows without a
    database are left out, as no search can find them. ``parts`` bounds the list of folders a lookup names.
    """
    order = [F.col(DATABASE), F.col("executed_at"), F.xxhash64("sql")]
    keyed = log.withColumn(DATABASE, F.lower("database_path")).filter(F.col(DATABASE).isNotNull())
    rows = keyed.repartitionByRange(parts, *order)
    numbered = _blocks(rows.sortWithinPartitions(*order), ROWS)
    numbered.write.partitionBy(PART).parquet(f"{path}/rows")
    # An empty log has no folder that tells its columns.
    numbered.limit(0).write.parquet(f"{path}/columns")
    # Postings come from the written rows, so both agree whatever is run again.
    written = _rows(log.sparkSession, path)
    signs = written.select(F.split(F.lower("sql"), "").alias("signs"), PART, BLOCK)
    postings = signs.select(F.explode(_grams("signs")).alias("gram"), PART, BLOCK).distinct()
    postings.sortWithinPartitions("gram", PART, BLOCK).write.parquet(f"{path}/postings")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def search_index(spark: SparkSession, path: str, database: str | None = None, term: str | None = None) -> DataFrame:
    """``history.search`` over a written index; without a database, over all of them.

    Rows lie by database, so files of others are skipped by their statistics. Terms of one or two characters have no trigram and are looked for in all rows.
    """
    rows = _rows(spark, path)
    wanted = term.lower() if term and term.strip() else ""
    grams = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
    if grams:
        holding = spark.read.parquet(f"{path}/postings").filter(F.col("gram").isin(grams))
        blocks = holding.groupBy(PART, BLOCK).count().filter(F.col("count") == len(grams)).select(PART, BLOCK)
        named = [r[0] for r in blocks.select(PART).distinct().collect()]
        rows = rows.filter(F.col(PART).isin(named)).join(blocks, [PART, BLOCK], "left_semi")
    if database is not None:
        rows = rows.filter(F.col(DATABASE) == database.lower())
    found = history.containing(rows.drop(PART, BLOCK, DATABASE), term)
    return found.orderBy(F.desc("executed_at"))


def write_dictionary(catalog: DataFrame, path: str, parts: int) -> None:
    """Write ``catalog(name, priority)`` as front-coded blocks; null names are left out.

    Entries that repeat are counted first, so no name is more than one row per priority.
    """
    entries = catalog.filter(F.col("name").isNotNull()).groupBy("name", "priority").agg(F.count("*").alias("times"))
    order = [F.lower("name"), F.col("name"), F.col("priority")]
    numbered = _blocks(entries.repartitionByRange(parts, *order).sortWithinPartitions(*order), NAMES)
    before = F.lag("name").over(Window.partitionBy(PART, BLOCK).orderBy(*order))
    differs = F.zip_with(
        F.split(F.coalesce(before, F.lit("")), ""), F.split("name", ""), lambda a, b: ~a.eqNullSafe(b)
    )
    differing = F.array_position(differs, True)
    shared = F.when(before.isNull(), 0).when(differing > 0, differing - 1).otherwise(F.length("name")).cast("int")
    coded = numbered.withColumn("key", F.lower("name")).withColumn("shared", shared)
    entry = F.struct(
        "key", "name", "priority", "times", "shared", F.expr("substring(name, shared + 1)").alias("rest")
    )
    inside = coded.groupBy(PART, BLOCK).agg(
        F.array_sort(F.collect_list(entry), _in_order).alias("all"), F.max("priority").alias("best")
    )
    best = F.filter("all", lambda e: e["priority"].eqNullSafe(F.col("best")))
    rows = inside.select(
        F.get("all", F.lit(0))["key"].alias("first_key"),
        F.element_at("all", -1)["key"].alias("last_key"),
        "best",
        F.array_min(F.transform(best, lambda e: e["name"])).alias("least"),
        F.transform(
            "all",
            lambda e: F.struct(
                e["shared"].alias("shared"),
                e["rest"].alias("rest"),
                e["priority"].alias("priority"),
                e["times"].alias("times"),
            ),
        ).alias("entries"),
    )
    rows.sortWithinPartitions("first_key").write.parquet(path)


def _in_order(a: Column, b: Column) -> Column:
    """Order of entries: key, name, priority with nulls first."""
    same = F.lit(0)
    for field in ("priority", "name", "key"):
        x, y = a[field], b[field]
        less = (x.isNull() & y.isNotNull()) | F.coalesce(x < y, F.lit(False))
        same = F.when(x.eqNullSafe(y), same).when(less, -1).otherwise(1)
    return same


def _overlapping(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Blocks that may hold names with the prefix; ``whole`` marks those with no others."""
    key = prefix.lower()
    begins = F.col("first_key").startswith(key)
    blocks = spark.read.parquet(path).filter((F.col("last_key") >= key) & ((F.col("first_key") < key) | begins))
    return blocks.withColumn("whole", begins & F.col("last_key").startswith(key))


def _decoded(blocks: DataFrame, prefix: str, most: int | None = None) -> DataFrame:
    """The names with a prefix in some blocks, each as often as the catalog has it, ``most`` times at most."""
    start = F.struct(
        F.lit("").alias("name"), F.array().cast("array<struct<name:string,entry:int>>").alias("names")
    )

    def step(done: Column, e: Column) -> Column:
        name = F.concat(F.substring(done["name"], F.lit(1), e["shared"]), e["rest"])
        place = F.size(done["names"])
        found = F.struct(name.alias("name"), place.alias("entry"))
        return F.struct(name.alias("name"), F.concat(done["names"], F.array(found)).alias("names"))

    names = F.aggregate("entries", start, step, lambda done: done["names"])
    rows = blocks.select("entries", F.explode(names).alias("of")).select(
        "of.name", F.get("entries", F.col("of.entry")).alias("e")
    )
    times = F.col("e.times") if most is None else F.least("e.times", F.lit(most))
    rows = rows.select("name", F.col("e.priority").alias("priority"), times.cast("int").alias("times"))
    found = history.starts_with(rows, prefix)
    return found.select("name", "priority", F.explode(F.expr("sequence(1, times)"))).drop("col")


def dictionary_names(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """All names with a prefix (any case), as ``history.starts_with`` gives them."""
    return _decoded(_overlapping(spark, path, prefix), prefix)


def dictionary_top(spark: SparkSession, path: str, prefix: str, keep: int = 100) -> DataFrame:
    """``history.prefix_top`` over a written dictionary.

    Each whole block has an entry of its best priority and least name. After ``keep`` blocks in that order
    there are ``keep`` entries that no entry of a later block can precede.
    """
    blocks = _overlapping(spark, path, prefix)
    first = blocks.filter("whole").orderBy(F.desc("best"), "least").limit(keep)
    some = first.unionByName(blocks.filter("NOT whole"))
    return _decoded(some, prefix, keep).orderBy(F.desc("priority"), "name").limit(keep)
