"""How filters interact: what each removes in every order, from one walk over the subsets of filters.

A document's mask has one bit per filter that it fails. Counts per (part, mask) are all that the answer depends
on. ``walk`` visits the 32 sets of active filters in Gray-code order, so each step toggles one filter: it adds to or
takes from the active-failure counter of every mask cell with that bit, and cells whose counter leaves or
reaches zero leave or rejoin the survivors. The 32 survivor states are stored; what a filter removes at a step of
an order is the difference of two of them.

Filters A to D depend on the text alone. E, the copy of a smaller id's text, takes the least id per text hash
(pre-aggregated before the shuffle), joined back on hash and id together, so a text that a third of the rows share is
no hot key.

Edge cases: null texts are empty, and empty texts are copies of each other; a null source is the part ''. A null
``doc_id`` is no smaller id and has none below it, so it does not fail E; rows repeated with one id and text are
counted each, and none is a copy of the other. A document has a label if any label row of its id says so. Extra
columns are ignored. An empty table gives no parts and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpdeck.llm.common import cut, whole

FILTERS = "ABCDE"
MEASURES = ["n", "good", "toxic"]
STEP = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: str | Column = "text") -> Column:
    """The mask bits of A to D: few words, few distinct words, many capitals, code signs."""
    # White space of every kind becomes a blank: then words are what lies between blanks.
    words = F.array_remove(F.split(F.translate(whole(text), "\t\n\x0b\x0c\r", " " * 5), " "), "")
    bare = F.regexp_count(whole(text), F.lit("[A-Z]"))
    checks = F.struct(
        words.alias("words"), bare.alias("capitals"), F.length(whole(text)).alias("points"),
        whole(text).rlike(r"[#$%&*|]").alias("signs"),
    )

    def mask(c: Column) -> Column:
        n, distinct = F.size(c["words"]).cast("long"), F.size(F.array_distinct(c["words"])).cast("long")
        fails = [n < 50, 100 * distinct < 65 * n, 100 * c["capitals"].cast("long") > 5 * c["points"], c["signs"]]
        return sum((f.cast("int") * 2**i for i, f in enumerate(fails)), F.lit(0))

    return F.transform(F.array(checks), mask)[0]


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n: rows that agree in all of these and in id and text are one."""
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        failures().alias("mask"),
        F.unhex(F.sha2(whole("text"), 256)).alias("hash"),
    )
    rows = cut(rows.groupBy("hash", "doc_id", "part", "mask").agg(F.count("*").alias("n")))
    first = rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL")
    first = first.withColumn("first", F.lit(True))
    said = labels.groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("long").alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("long").alias("toxic"),
    )
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return (
        rows.join(first, ["hash", "doc_id"], "left")
        .join(said, "doc_id", "left")
        .select(
            "part", (F.col("mask") + copy.cast("int") * 16).alias("mask"), "n",
            (F.coalesce("good", F.lit(0)) * F.col("n")).alias("good"),
            (F.coalesce("toxic", F.lit(0)) * F.col("n")).alias("toxic"),
        )
    )


def cells(rows: DataFrame) -> DataFrame:
    """part, cells: at most 32 of (mask, n, good, toxic) per part."""
    sums = rows.groupBy("part", "mask").agg(*(F.sum(m).alias(m) for m in MEASURES))
    return sums.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))


def walk(counts: np.ndarray, filters: int = 5) -> np.ndarray:
    """Survivors (parts, sets, measures) for every set of active filters, from counts (parts, masks, measures)."""
    masks = np.arange(1 << filters)
    failing = np.zeros(1 << filters, np.int64)  # active filters that a mask cell fails
    alive = counts.sum(axis=1)
    states = np.empty_like(counts)
    states[:, 0] = alive
    active = 0
    for step in range(1, 1 << filters):
        gray = step ^ (step >> 1)
        bit = active ^ gray
        hit = masks & bit > 0
        if gray & bit:
            alive = alive - counts[:, hit & (failing == 0)].sum(axis=1)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            alive = alive + counts[:, hit & (failing == 0)].sum(axis=1)
        active = gray
        states[:, active] = alive
    return states


def steps(parts: list[str], counts: np.ndarray) -> pa.RecordBatch:
    """All orders and steps of some parts."""
    states = walk(counts)
    masks = np.arange(32)
    orders = ["".join(o) for o in permutations(FILTERS)]
    bits = np.array([[1 << FILTERS.index(f) for f in o] for o in orders])  # (120, 5)
    after = np.cumsum(bits, axis=1)
    before = after - bits
    lost = states[:, before] - states[:, after]  # (parts, 120, 5, measures)
    fails = np.stack([counts[:, masks & (1 << f) > 0, 0].sum(axis=1) for f in range(5)], axis=1)
    which = np.log2(bits).astype(int)
    shapley = np.stack([lost[:, which == f, 0].sum(axis=1) for f in range(5)], axis=1)
    columns = [
        states[:, after, 0], lost[..., 0], fails[:, which] - lost[..., 0], counts[:, bits, 0],
        lost[..., 1], lost[..., 2], shapley[:, which],
    ]
    names = [f.split()[0] for f in STEP.split(", ")]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.array(parts, object), bits.size), pa.string()),
            pa.array(np.tile(np.repeat(np.array(orders, object), 5), len(parts)), pa.string()),
            pa.array(np.tile(np.arange(1, 6, dtype=np.int32), 120 * len(parts))),
            *(pa.array(c.reshape(-1).astype(np.int64)) for c in columns),
        ],
        names,
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of filters and step, with what the step's filter removes and would have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                counts = np.zeros((len(rows), 32, 3), np.int64)
                for i, row in enumerate(rows):
                    for c in row["cells"]:
                        counts[i, c["mask"]] = [c[m] for m in MEASURES]
                yield steps([r["part"] for r in rows], counts)

    return cells(masked(docs, labels)).mapInArrow(run, STEP)


ORACLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), l AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), m AS (
    SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
           (len(w) < 50)::INT
           + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
           + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT
           + 8 * regexp_matches(t, '[#$%&*|]')::INT
           + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS mask
    FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), c AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), f AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a, f b, f c, f d, f e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (
    SELECT filter_order, step::INT AS step, bits[step] AS bit,
           coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier, list_sum(bits[1:step])::INT AS upto
    FROM o, range(1, 6) r(step)
), r AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN mask & upto = 0 THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
"""
