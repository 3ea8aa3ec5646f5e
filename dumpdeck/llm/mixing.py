"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

* ``targets``: words to take per source; weights cycle over the sources in code point order, no source
  gives more than ``repeats`` times its size, and the excess is shared again by weight.
* ``schedule``: N slots, N a power of two. Slot k has the van der Corput point rev(k) / N, and the
  cumulative target shares cut [0, N) into one interval per source; slot k belongs to the source whose
  interval holds rev(k). rev is its own inverse, so slots are made by running through the intervals,
  without a join. A source's slots are ranked by k.
* ``blocks``: documents of a source in a shuffled order (by a seeded hash), ``repeats`` times over, are
  one stream of words; its first ``target`` words are cut into as many equal blocks as the source has slots.
* ``mix``: slot of rank r takes block r.

A hot source is spread: running sums and ranks are made in chunks of bounded size, with a small prefix
sum over chunks; slots and blocks join on (source, rank).

Edge cases: texts without words have size 0 and are never taken; a null source is a source of its own
and sorts last; repeated rows are documents of their own; a source whose target is below one word gets
nothing. An empty table gives an empty result. Results depend on ``seed`` and the data alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dumpdeck.llm.common import cut, word_count

WEIGHTS = (5, 2, 1)
SHARE, REPEATS, BLOCK, CHUNK, SEED = 1.5, 2, 256, 4_096, 20_260


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words of every row."""
    return docs.select("doc_id", "source", word_count("text").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Per source: src (its rank), source, rows, source_size and target, one row each.

    Water-filling: with sources ordered by cap / weight, the level that the remaining budget reaches if
    all before are full peaks at the first source that isn't; the peak is the level of all the others.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = (
        per.withColumn("src", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(cycle, F.col("src") % len(weights)))
        .withColumn("cap", (repeats * F.col("source_size")).cast("double"))
        .withColumn("budget", share * F.sum("source_size").over(everything))
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = (F.col("budget") - spent) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least("cap", F.col("level") * F.col("weight"))
    return per.select("src", "source", "rows", "source_size", target.alias("target"))


def plan(per: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """The sources that give something, each with its interval [low, high) of points; and log2 of the slots.

    Every source has one slot at least; the others follow the cumulative shares.
    """
    live = per.filter("target >= 1").withColumn("take", F.floor("target").cast("long"))
    n, total = live.agg(F.count("*"), F.coalesce(F.sum("take"), F.lit(0))).first()
    bits = 0
    while 2**bits < max(2 * n, total / block):
        bits += 1
    order = Window.orderBy("src")
    share = F.sum("take").over(order.rowsBetween(Window.unboundedPreceding, 0)) / float(max(total, 1))
    live = (
        live.withColumn("nth", F.row_number().over(order))
        .withColumn("high", (F.col("nth") + F.round(share * (2**bits - n))).cast("long"))
        .withColumn("low", F.lag("high", 1, 0).over(order).cast("long"))
    )
    return live.select("src", "take", "low", "high", (F.col("high") - F.col("low")).alias("slots")), bits


def _reversed(point: Column, bits: int) -> Column:
    if not bits:
        return F.lit(0).cast("long")
    return F.conv(F.reverse(F.lpad(F.bin(point), bits, "0")), 2, 10).cast("long")


def schedule(intervals: DataFrame, bits: int, chunk: int = CHUNK) -> DataFrame:
    """slot, src, rank: each source's slots ranked from 0 in the order of the schedule."""
    first = intervals.select(
        "src", "high", F.explode(F.sequence("low", F.col("high") - 1, F.lit(chunk).cast("long"))).alias("from")
    )
    dealt = first.repartition("src", "from")
    points = dealt.select(
        "src", F.explode(F.sequence("from", F.least("high", F.col("from") + chunk) - 1)).alias("point")
    )
    slots = points.select("src", _reversed(F.col("point"), bits).alias("slot"))
    slots = slots.withColumn("part", F.floor(F.col("slot") / chunk))
    counts = slots.groupBy("src", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("src", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("src", "part").orderBy("slot")
    ranked = slots.withColumn("nth", F.row_number().over(inside) - 1)
    return ranked.hint("merge").join(counts, ["src", "part"]).select("slot", "src", (F.col("before") + F.col("nth")).alias("rank"))


def streams(sizes: DataFrame, per: DataFrame, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """doc_id, src, size, source_size, target and ``start``: the row's place in its source's shuffled stream."""
    rows = sizes.join(per.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.drop("_source").withColumn("mixed", F.xxhash64(F.lit(seed), "doc_id", "size"))
    rows = rows.withColumn("part", F.pmod(F.shiftright("mixed", 20), F.ceil(F.col("rows") / chunk)))
    sums = rows.groupBy("src", "part").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("src", "part").orderBy("mixed", "doc_id", "size")
    own = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("own", own).join(sums, ["src", "part"])
    return rows.select(
        "doc_id", "src", "source", "size", "source_size", "target", (F.col("before") + F.col("own")).alias("start")
    )


def blocks(placed: DataFrame, intervals: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """src, rank, start, pass, from_word, to_word: the pieces of documents that make up each block."""
    def edge(rank: Column) -> Column:
        return F.floor(rank * F.col("step")).cast("long")

    def holding(word: Column) -> Column:
        """The last block that starts at ``word`` or before it."""
        guess = F.greatest(F.lit(0).cast("long"), F.floor(word / F.col("step")).cast("long") - 1)
        return guess + F.when(edge(guess + 2) <= word, 2).when(edge(guess + 1) <= word, 1).otherwise(0)

    rows = placed.filter("size > 0").join(intervals, "src")
    rows = rows.withColumn("step", F.col("take") / F.col("slots"))
    rows = rows.withColumn("pass", F.explode(F.array(*(F.lit(i) for i in range(repeats)))))
    rows = rows.withColumn("at", F.col("start") + F.col("pass") * F.col("source_size")).filter("at < take")
    rows = rows.withColumn("end", F.least(F.col("at") + F.col("size"), "take"))
    rank = F.explode(F.sequence(holding(F.col("at")), F.least(F.col("slots") - 1, holding(F.col("end") - 1))))
    pieces = rows.withColumn("rank", rank)
    after = F.when(F.col("rank") == F.col("slots") - 1, F.col("take")).otherwise(edge(F.col("rank") + 1))
    pieces = pieces.withColumn("from_word", F.greatest("at", edge(F.col("rank"))) - F.col("at"))
    pieces = pieces.withColumn("to_word", F.least("end", after) - F.col("at"))
    return pieces.filter("to_word > from_word").select("src", "rank", "doc_id", "start", "pass", "from_word", "to_word")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, **how) -> tuple[DataFrame, DataFrame]:
    """What the mix takes, and all documents with their places.

    Taken: slot, src, rank, doc_id, start, pass, from_word, to_word: read in the order of ``slot``, it is
    the mixed stream, in words of documents.
    """
    sizes = cut(sized(docs))
    per = cut(targets(sizes, **how))
    intervals, bits = plan(per, block)
    intervals = cut(intervals)
    placed = cut(streams(sizes, per, seed=seed))
    pieces = blocks(placed, intervals, how.get("repeats", REPEATS))
    taken = schedule(intervals, bits).hint("merge").join(pieces, ["src", "rank"])
    return taken, placed


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target and taken, the words that the mix takes of it."""
    taken, placed = mix(docs, **how)
    used = taken.groupBy("src", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    rows = placed.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
    used = used.withColumnRenamed("start", "at")
    return rows.join(used, ["src", "at"], "left").select(
        "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix has them: a row for each pass that takes half of its words or more, whole.

    A document taken twice is there twice; one that isn't taken, or has no words, is not. Only the document
    at the end of each source's share is rounded.
    """
    taken, placed = mix(docs, **how)
    share = taken.groupBy("src", "start", "pass").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n"))
    whole = share.join(placed.filter("size > 0"), ["src", "start"]).filter("2 * n >= size")
    # One row per distinct (id, source, size): how often the mix has it, and how many rows look like that.
    key = ["_m_id", "_m_source", "_m_size"]
    renamed = {"doc_id": "_m_id", "source": "_m_source", "size": "_m_size"}
    times = whole.groupBy("doc_id", "source", "size", "start").agg(F.count("*").cast("int").alias("_m_times"))
    place = Window.partitionBy("doc_id", "source", "size").orderBy(F.col("_m_times").desc(), "start")
    times = times.withColumn("_m_nth", F.row_number().over(place)).withColumnsRenamed(renamed)
    keyed = docs.withColumns({"_m_id": F.col("doc_id"), "_m_source": F.col("source"), "_m_size": word_count("text")})
    keyed = keyed.withColumn("_m_row", F.xxhash64("text"))
    same = placed.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).filter("n > 1")
    twins = F.xxhash64(*(F.struct(F.col(c).isNull(), F.col(c)) for c in key)).alias("_m_key")
    same = cut(same.withColumnsRenamed(renamed).select(twins))
    times = times.select(twins, "_m_times", "_m_nth")
    keyed = keyed.withColumn("_m_key", twins)
    if same.isEmpty():
        numbered = keyed.withColumn("_m_nth", F.lit(1))
    else:
        once = keyed.join(same, "_m_key", "left_anti").withColumn("_m_nth", F.lit(1))
        order = Window.partitionBy("_m_key").orderBy("_m_row")
        many = keyed.join(same, "_m_key", "left_semi").withColumn("_m_nth", F.row_number().over(order))
        numbered = once.unionByName(many)
    found = numbered.join(times, ["_m_key", "_m_nth"])
    return found.withColumn("_m_copy", F.explode(F.sequence(F.lit(1), "_m_times"))).select(*docs.columns)
