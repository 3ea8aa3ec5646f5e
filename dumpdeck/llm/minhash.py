"""Near-duplicates: minima of universal hashes, banding, verification, and components.

1. ``sketch``: per document the number of its distinct shingles, a 128-bit key of the whole set, and
   ``bands * rows`` minima of universal hashes.
2. Documents with equal sets are one class, kept by its least id: copies are linked without pairs.
3. Classes that agree in all rows of a band share a bucket. In each bucket all others are compared with
   its least id first (a star, not pairs), and verified links are merged into components.
4. Buckets that then still hold several components are compared in tiles of about ``tile`` classes, across
   components only, by sizes and signatures inside the task. Candidates leave it if they are at most two
   a row; they are confirmed and merged.
5. Pairs of tiles that had more get the full shingle sets and are settled inside the task
   (``joined_in_tiles``), which returns only the links that join components.
6. Every link is tested on full shingle sets. Components come from alternating stars.

A pair of similarity 0.8 misses all of 28 bands of 4 rows with probability (1 - 0.8**4)**28 = 4e-7; nothing is
capped. The time of steps 4 and 5 is the square of a bucket only where a bucket of different, unlinked texts is
large; rows grow with n * n / tile there, and results with n.

Edge cases: null texts and texts without words have no shingles, are linked with nothing and stay. A
row without an id is linked with nothing and stays, its component is null. Rows that share an id are one
node. Repeated rows get equal results. An empty table gives an empty result. Extra columns stay in
``drop_near_copies``; helper columns start with ``_n_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpdeck.llm.common import cut
from dumpdeck.llm.components import components
from dumpdeck.llm.shingles import Powers, mix, shingle_sets

WORDS, PERCENT, BANDS, ROWS, SEED, TILE, MEMBERS = 5, 80, 28, 4, 1, 1024, 64
SHINGLES = 1 << 20
LISTED = 100_000

SKETCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("k1", T.LongType()),
        T.StructField("k2", T.LongType()),
        T.StructField("signature", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
NEAR = T.StructType(
    [
        *PAIR.fields,
        T.StructField("bucket", T.LongType()),
        T.StructField("i", T.IntegerType()),
        T.StructField("j", T.IntegerType()),
    ]
)
NEAR_KEY = (pa.int64(), pa.int32(), pa.int32())


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sketch(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, set key (k1, k2), signature and band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, n = Powers(), bands * rows
        draw = np.random.Generator(np.random.PCG64(seed))
        factor = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

        def minima(sets: list[np.ndarray]) -> np.ndarray:
            out = np.zeros((len(sets), n), np.uint32)
            full = [i for i, s in enumerate(sets) if len(s)]
            at = 0
            while at < len(full):
                stop, size = at, 0
                while stop < len(full) and (stop == at or size + len(sets[full[stop]]) < 32_768):
                    size += len(sets[full[stop]])
                    stop += 1
                part = full[at:stop]
                x = np.concatenate([sets[i] for i in part])
                begins = np.cumsum([0] + [len(sets[i]) for i in part[:-1]])
                for h in range(n):
                    out[part, h] = np.minimum.reduceat((x * factor[h] + shift[h]) >> np.uint64(32), begins)
                at = stop
            return out

        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                piece = batch.slice(low, 1024)
                sets = list(shingle_sets(_column(piece, "text").to_pylist(), words, powers))
                sig = minima(sets)
                groups = sig.reshape(len(sets), bands, rows).astype(np.uint64)
                key = np.broadcast_to(salt, (len(sets), bands))
                for r in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + groups[:, :, r])
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = [
                    np.array([np.add.reduce(f(s)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                    for f in (mix, lambda s: mix(s ^ np.uint64(0x5851F42D4C957F2D)))
                ]
                lists = [k if m else [] for k, m in zip(key.view(np.int64).tolist(), sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        _column(piece, "doc_id").cast(pa.int64()), pa.array(sizes), pa.array(keys[0]), pa.array(keys[1]),
                        pa.array([row.tobytes() for row in sig], pa.binary()), pa.array(lists, pa.list_(pa.int64())),
                    ],
                    names=SKETCH.names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def _least_alike(percent: int, n: int) -> int:
    """Fewest equal minima at which a pair is taken further: five standard deviations below the threshold."""
    p = percent / 100
    return max(1, int(n * p - 5 * (n * p * (1 - p)) ** 0.5))


def alike(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ``least`` places or more."""
    sig = classes.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    other = classes.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (
                    np.frombuffer(b"".join(_column(batch, c).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                    for c in ("sa", "sb")
                )
                kept = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([_column(batch, c).filter(kept) for c in "ab"], names=["a", "b"])

    return pairs.join(sig, "a").join(other, "b").select("a", "b", "sa", "sb").mapInArrow(run, PAIR)


def confirm(pairs: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT, members: int = MEMBERS) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    The text of b comes first in each group, then those it is compared with, as a sorted stream; a
    text with many partners is in several groups. Rows that share an id are one node: an id with several
    texts is linked if one of them is.
    """
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    dealt = pairs.join(counts, "b").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / members)).alias("part")
    )
    text = texts.select("doc_id", "text")
    heads = dealt.select("b", "part").distinct().withColumn("id", F.col("b"))
    rows = dealt.select("b", "part", F.col("a").alias("id")).unionByName(heads)
    rows = rows.join(text, F.col("id") == F.col("doc_id")).select(
        "b", "part", (F.col("id") != F.col("b")).alias("member"), "id", "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, now, heads_ = Powers(), None, []
        for batch in batches:
            columns = [_column(batch, c).to_pylist() for c in ("b", "part", "member", "id")]
            sets = shingle_sets(_column(batch, "text").to_pylist(), words, powers)
            found: list[tuple[int, int]] = []
            for b, part, member, id_, own in zip(*columns, sets, strict=True):
                if now != (b, part):
                    now, heads_ = (b, part), []
                if not member:
                    heads_.append(own)
                    continue
                for head in heads_:
                    same = len(np.intersect1d(head, own, assume_unique=True))
                    if 100 * same >= percent * (len(head) + len(own) - same):
                        found.append((id_, b))
                        break
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

    return rows.repartition("b", "part").sortWithinPartitions("b", "part", "member", "id").mapInArrow(run, PAIR)


def tiled(buckets: DataFrame, tile: int = TILE, shingles: int = SHINGLES) -> DataFrame:
    """Rows of buckets, once for each pair of tiles (i, j) they take part in.

    ``buckets``: bucket, band, rep, component, size. A tile holds about ``tile`` classes and ``shingles``
    shingles; most buckets are one tile. The component with most rows in a bucket is not compared with itself.
    """
    parts = buckets.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("m"))
    most = F.max(F.struct("n", F.col("component").alias("c")))
    whole = parts.groupBy("bucket").agg(most.alias("top"), F.sum("n").alias("n"), F.sum("m").alias("m"))

    def tiles(n: str, m: str) -> str:
        return f"CAST(greatest(ceil({n} / {tile}), ceil({m} / {shingles}), 1) AS INT)"

    top = parts.join(whole.select("bucket", F.col("top.c").alias("component")), ["bucket", "component"])
    whole = whole.join(top.select("bucket", F.col("n").alias("tn"), F.col("m").alias("tm")), "bucket").select(
        "bucket", F.col("top.c").alias("main"), F.expr(tiles("(n - tn)", "(m - tm)")).alias("others"),
        F.expr(tiles("tn", "tm")).alias("mains"),
    )
    dealt = buckets.join(whole, "bucket").withColumn("is_main", F.col("component") == F.col("main"))
    slot = F.xxhash64("rep", F.lit(7))
    own = F.when(F.col("is_main"), F.col("others") + F.pmod(slot, "mains")).otherwise(F.pmod(slot, "others"))
    last = F.when(F.col("is_main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    dealt = dealt.withColumn("tile", own.cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select(
        "bucket", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"),
        "band", "tile", "rep", "component", "size",
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each (bucket, i, j) of a sorted stream."""
    now: tuple | None = None
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            key = row["bucket"], row["i"], row["j"]
            if key != now:
                if len(held) > 1:
                    yield now, held
                now, held = key, []
            held.append(row)
    if len(held) > 1:
        yield now, held


class _Tile:
    """The rows of a pair of tiles, and which of them may be links by size and signature.

    A pair of classes is looked at in the first band in which it agrees only.
    """

    def __init__(self, key: tuple, held: list[dict], least: int, percent: int, rows: int):
        self.sig = np.frombuffer(b"".join(r["signature"] for r in held), np.uint32).reshape(len(held), -1)
        self.comp, self.tile, self.rep, self.size = (
            np.array([r[c] for r in held], np.int64) for c in ("component", "tile", "rep", "size")
        )
        self.inside, self.band = key[1] == key[2], held[0]["band"]
        self.least, self.percent, self.rows = least, percent, rows

    def near(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The later rows that row n may be linked with, and in how many minima they agree."""
        rest = slice(n + 1, None)
        fits = self.comp[rest] != self.comp[n]
        if not self.inside:
            fits &= self.tile[rest] != self.tile[n]
        low, high = np.minimum(self.size[rest], self.size[n]), np.maximum(self.size[rest], self.size[n])
        near = np.flatnonzero(fits & (100 * low >= self.percent * high)) + n + 1
        same = self.sig[near] == self.sig[n]
        agree = same.sum(axis=1)
        first = same.reshape(len(near), -1, self.rows).all(axis=2).argmax(axis=1) if len(near) else agree
        kept = (agree >= self.least) & (first == self.band)
        return near[kept], agree[kept]


def across(dealt: DataFrame, least: int, percent: int = PERCENT, rows: int = ROWS) -> DataFrame:
    """Pairs of different components within a pair of tiles that may be links: a, b, bucket, i, j.

    All of them while they are at most twice the rows; if there are more, one row without a and b. ``dealt``: the
    rows of ``tiled`` with their signatures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _groups(batches):
            tile = _Tile(key, held, least, percent, rows)
            count, every = 0, []
            for n in range(len(held) - 1):
                near, _ = tile.near(n)
                count += len(near)
                if count > 2 * len(held):
                    break
                every.append(np.stack([np.full(len(near), n), near]))
            if not count:
                continue
            if count > 2 * len(held):
                ends = pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())
            else:
                x, y = tile.rep[np.concatenate(every, axis=1)]
                ends = pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))
            where = [pa.array([k] * len(ends[0]), t) for k, t in zip(key, NEAR_KEY, strict=True)]
            yield pa.RecordBatch.from_arrays([*ends, *where], names=NEAR.names)

    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, NEAR)


def joined_in_tiles(
    dealt: DataFrame, texts: DataFrame, least: int, words: int = WORDS, percent: int = PERCENT, rows: int = ROWS
) -> DataFrame:
    """Links (a, b) that join the components of each pair of tiles, found on full shingle sets in the task.

    Every pair that may be a link is tested unless its ends are joined by then: at most one link a row leaves.
    """
    text = texts.select("doc_id", "text")
    rows_ = dealt.join(text, F.col("rep") == F.col("doc_id")).drop("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()

        def with_sets() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [s.tobytes() for s in shingle_sets(_column(batch, "text").to_pylist(), words, powers)]
                names = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(_column(batch, n) for n in names), pa.array(sets, pa.large_binary())], names=[*names, "set"]
                )

        for key, held in _groups(with_sets()):
            tile = _Tile(key, held, least, percent, rows)
            sets = [np.frombuffer(r.pop("set"), np.uint64) for r in held]
            found: list[tuple[int, int]] = []
            for n in range(len(held) - 1):
                near, agree = tile.near(n)
                for m in near[np.argsort(-agree, kind="stable")]:
                    if tile.comp[m] == tile.comp[n]:
                        continue
                    same = len(np.intersect1d(sets[n], sets[m], assume_unique=True))
                    if 100 * same >= percent * (len(sets[n]) + len(sets[m]) - same):
                        found.append((int(max(tile.rep[n], tile.rep[m])), int(min(tile.rep[n], tile.rep[m]))))
                        tile.comp[tile.comp == tile.comp[m]] = tile.comp[n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
            )

    return rows_.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep").mapInArrow(run, PAIR)


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components of ``known`` (node, component) joined by further links (a, b) between their nodes."""
    ends = []
    for c in "ab":
        end = known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        links = links.join(end, c, "left")
        ends.append(F.coalesce(f"c{c}", c).alias(c))
    above = cut(components(links.select(*ends)))
    above = above.select(F.col("node").alias("component"), F.col("component").alias("top"))
    joined = known.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    lone = above.join(known.select("component"), "component", "left_anti")
    return cut(joined.unionByName(lone.select(F.col("component").alias("node"), F.col("top").alias("component"))))


def _open(buckets: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the buckets that are still in several components, with their component."""
    rows = buckets.join(known.withColumnRenamed("node", "rep"), "rep", "left")
    rows = rows.withColumn("component", F.coalesce("component", "rep"))
    split = rows.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    return rows.join(split.select("bucket"), "bucket", "left_semi")


def near_groups(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    sketches = cut(sketch(docs, words, bands, rows))
    key = ["n_shingles", "k1", "k2"]
    live = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(
        live.groupBy(*key).agg(
            F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("bands").alias("bands")
        )
    )
    least = _least_alike(percent, bands * rows)
    members = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    members = members.select(F.xxhash64("band", "key").alias("bucket"), "band", "rep")
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).filter("n > 1")
    buckets = cut(members.hint("merge").join(shared, "bucket"))

    pairs = buckets.filter("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    involved = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(involved, "doc_id", "left_semi")
    texts = cut(texts.dropDuplicates(["doc_id", "h"]))
    near = cut(alike(pairs, classes, least))
    links = confirm(near, texts, words, percent).unionByName(_shared_ids(live, classes))
    known = cut(components(links))

    # What the stars may have missed: buckets of three or more that are still in several components.
    left = _open(buckets.filter("n > 2").select("bucket", "band", "rep"), known)
    left = left.join(classes.select("rep", F.col("n_shingles").alias("size")), "rep")
    dealt = cut(tiled(left))
    signatures = classes.select("rep", "signature")
    more = cut(across(dealt.join(signatures, "rep"), least, percent, rows))
    few = more.filter("a IS NOT NULL").select("a", "b").distinct().join(near, ["a", "b"], "left_anti")
    links = cut(confirm(few, texts, words, percent))
    if not links.isEmpty():
        known = merged(known, links)
    # Pairs of tiles with more candidates are settled whole, where they are still in several components.
    rest = more.filter("a IS NULL").select("bucket", "i", "j")
    if not rest.isEmpty():
        again = dealt.join(F.broadcast(rest) if rest.count() < LISTED else rest, ["bucket", "i", "j"], "left_semi")
        again = again.drop("component").join(known.withColumnRenamed("node", "rep"), "rep", "left")
        again = again.withColumn("component", F.coalesce("component", "rep")).join(signatures, "rep")
        links = cut(joined_in_tiles(again, texts, least, words, percent, rows))
        if not links.isEmpty():
            known = merged(known, links)

    found = classes.select(*key, "rep").join(known.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select(*(F.col(c).alias(f"_n_{c}") for c in key), F.coalesce("component", "rep").alias("component"))
    same = [F.col(c) == F.col(f"_n_{c}") for c in key]
    result = sketches.select("doc_id", *key).join(found, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return result.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def _shared_ids(live: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    ids = live.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    rows = live.join(ids, "doc_id", "left_semi").join(classes.select("n_shingles", "k1", "k2", "rep"), ["n_shingles", "k1", "k2"])
    return rows.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, **how) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group, with their columns as they were."""
    lost = near_groups(docs, words, percent, **how).filter(~F.col("kept")).select(F.col("doc_id").alias("_n_id"))
    return docs.join(lost.distinct(), F.col("doc_id") == F.col("_n_id"), "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [hash(w)]
        ELSE list_transform(range(1, len(w) - 2), lambda i: hash(w[i:i + 3])) END) AS h
    FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
t AS (SELECT s.* FROM s SEMI JOIN shared USING (h)),
links AS (
    SELECT x.a, x.b FROM (
        SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS same
        FROM t p JOIN t q ON p.h = q.h AND p.doc_id <> q.doc_id GROUP BY 1, 2
    ) x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
    WHERE 100 * same >= 80 * (na.n + nb.n - same)
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""
