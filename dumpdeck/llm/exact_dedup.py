"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash.

Two texts are equal when they agree after white space is deleted. A narrow first pass keeps only the
length and a hash of the first ``prefix`` characters of the normalised text; rows alone in their
(length, prefix) class are unique and go no further. Only rows of the remaining classes are grouped by
the SHA-256 of their whole normalised text.

Everything is aggregation: rows are pre-aggregated before each shuffle, so a group that holds a third
of all rows is combined on the map side, and the join of group results back to rows is a sort-merge
join that adaptive execution splits when a key is hot.

Edge cases: a null text is an empty text, and all empty texts form one group. A null ``doc_id`` sorts
after all others. Rows repeated with one id and one text count towards ``group_size``, and only the
first of them can stay. An empty table gives an empty result. Extra columns are ignored by
``exact_groups`` and kept by ``drop_copies``; names of helper columns start with ``_dd_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpdeck.llm.common import SPACE, cut, whole

PREFIX = 256


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(whole(text), f"{SPACE}+", "")


def narrow(docs: DataFrame, prefix: int, digest: bool) -> DataFrame:
    """One narrow row per document: id, lengths, prefix hash and, if asked for, the full hash."""
    base = docs.select("doc_id", F.length(whole("text")).alias("_dd_points"), normalised().alias("_dd_norm"))
    columns = [
        F.col("doc_id"),
        F.col("_dd_points"),
        F.length("_dd_norm").alias("_dd_length"),
        F.xxhash64(F.substring("_dd_norm", 1, prefix)).alias("_dd_prefix"),
    ]
    if digest:
        columns.append(F.sha2("_dd_norm", 256).alias("text_sha256"))
    return base.select(*columns)


def _shared(rows: DataFrame) -> DataFrame:
    """The (length, prefix) classes of more than one row; lengths that occur once go first."""
    sizes = rows.groupBy("_dd_length").agg(F.count("*").alias("_dd_n")).filter("_dd_n > 1").select("_dd_length")
    pairs = rows.join(sizes, "_dd_length", "left_semi").groupBy("_dd_length", "_dd_prefix").agg(F.count("*").alias("_dd_n"))
    return pairs.filter("_dd_n > 1").select("_dd_length", "_dd_prefix")


def _resolve(rows: DataFrame) -> DataFrame:
    """keep_id, group_size and kept for rows with a full hash; repeated rows are counted, not spread."""
    counted = rows.groupBy("text_sha256", "doc_id", "_dd_points").agg(F.count("*").alias("_dd_copies"))
    order = F.struct(-F.col("_dd_points"), F.col("doc_id").isNull(), F.col("doc_id"))
    groups = counted.groupBy("text_sha256").agg(
        F.sum("_dd_copies").alias("group_size"), F.min(order).alias("_dd_first")
    )
    groups = groups.select(
        "text_sha256",
        "group_size",
        F.col("_dd_first.doc_id").alias("keep_id"),
        (-F.col("_dd_first.col1")).alias("_dd_most"),
    )
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_dd_points") == F.col("_dd_most"))
    return (
        counted.join(groups, "text_sha256")
        .withColumn("_dd_nth", F.explode(F.sequence(F.lit(1).cast("long"), "_dd_copies")))
        .select("doc_id", "keep_id", "group_size", (first & (F.col("_dd_nth") == 1)).alias("kept"), "text_sha256")
    )


def exact_groups(docs: DataFrame, prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    The row of a group with the most code points, then the smallest id, stays. With ``digest_all`` the
    hash is a column of the result for unique rows as well, so it is computed in the first pass, and
    refinement spares only the grouping; else unique rows get a null hash and the second pass reads
    the content of surviving classes alone.
    """
    rows = narrow(docs, prefix, digest_all)
    classes = ["_dd_length", "_dd_prefix"]
    if digest_all:
        rows = cut(rows)
    shared = cut(_shared(rows))
    alone = rows.join(shared, classes, "left_anti")
    if not digest_all:
        # The second pass: whole texts, for the classes that are left only.
        alone = alone.withColumn("text_sha256", F.lit(None).cast("string"))
        rows = narrow(docs, prefix, True)
    unique = alone.select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    return unique.unionByName(_resolve(rows.join(shared, classes, "left_semi")))


def drop_copies(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Only rows of shared (length, prefix) classes get a full hash; a row goes if it meets a lost one by id, lengths
    and prefix hash, and then by its full hash, which is computed for such meetings alone.
    """
    classes = ["_dd_length", "_dd_prefix"]
    shared = cut(_shared(narrow(docs, prefix, False)))
    digests = narrow(docs, prefix, True).join(shared, classes, "left_semi")
    counted = cut(digests.groupBy("text_sha256", "doc_id", "_dd_points", *classes).agg(F.count("*").alias("_dd_copies")))
    order = F.struct(-F.col("_dd_points"), F.col("doc_id").isNull(), F.col("doc_id"))
    best = counted.groupBy("text_sha256").agg(F.min(order).alias("_dd_first"))
    lost = counted.join(best, "text_sha256").filter(
        ~(F.col("doc_id").eqNullSafe(F.col("_dd_first.doc_id")) & (-F.col("_dd_points") == F.col("_dd_first.col1")))
    )
    key = F.xxhash64("doc_id", "_dd_points", *classes).alias("_dd_key")
    extra = docs.withColumns({"_dd_points": F.length(whole("text")), "_dd_norm": normalised()})
    extra = extra.withColumns(
        {"_dd_length": F.length("_dd_norm"), "_dd_prefix": F.xxhash64(F.substring("_dd_norm", 1, prefix))}
    ).drop("_dd_norm")
    extra = extra.withColumn("_dd_key", key)

    def meets(rows: DataFrame) -> DataFrame:
        return rows.select(key.alias("_dd_k"), F.col("text_sha256").alias("_dd_hash"))

    # array_contains keeps the full hash out of the join's keys, where all rows would have to compute it
    same = (F.col("_dd_key") == F.col("_dd_k")) & F.array_contains(F.array("_dd_hash"), F.sha2(normalised(), 256))
    kept = extra.join(meets(lost), same, "left_anti")
    repeated = cut(meets(counted.filter("_dd_copies > 1")))
    if repeated.isEmpty():  # no row is there twice with its id: spare the second shuffle
        return kept.select(*docs.columns)
    once = kept.join(repeated, same, "left_anti")
    many = kept.join(repeated, same, "left_semi").withColumn("_dd_hash", F.sha2(normalised(), 256))
    return once.select(*docs.columns).unionByName(many.dropDuplicates(["_dd_key", "_dd_hash"]).select(*docs.columns))


ORACLE = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), r AS (
    SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM r
"""
