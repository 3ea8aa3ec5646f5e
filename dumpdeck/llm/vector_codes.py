"""Codes for vectors: product quantisation over integer components, on Hilbert-sorted flat blocks.

Each vector is cut into equal parts, and each part gets the index of the nearest entry in a codebook of its
position. Rows are gathered into chunks of about ``ROOM`` components, as they come. For every position a chunk
holds its parts sorted along a Hilbert curve in one flat array, cut into blocks of ``BLOCK`` parts, with the box
(least and largest value per component) and the component sums of each block. Chunks are written once and read by
every round; rows never move.

A round compares boxes with entries first: an entry whose least distance to a box is above the smallest largest
distance of all entries can be nearest to nothing in the block. A block with one entry left takes part with its stored
sums; else a small integer kernel compares its parts with the short list. Ties go to the lower index, which is why
equal bounds stay listed. Tasks emit sums and counts per entry (positions times entries rows each); Spark adds
them, and only the codebook, whose size is fixed, reaches the driver.

Everything is exact: components are whole numbers, kept in the narrowest type that holds a chunk's; where squares
might leave 64 bits, a block is computed with Python's integers, and sums travel as 40-bit limbs.

Edge cases: rows with a null vector, or null or non-finite components, are dropped (256 times a component must be
finite too). A null ``vec_id`` comes after all others; rows with equal ids are taken in the order of their components.
Fewer rows than entries make a smaller codebook. The dimension is that of the first kept row; rows of any other
dimension take no part and get a null code and error. An error above the largest long counts as that. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpdeck.llm.common import checkpoint_folder, cut

PARTS, ENTRIES, ROUNDS, BLOCK, ROOM = 16, 64, 2, 256, 1 << 20
#: Components up to this have exact squared distances in 64 bits; longer limbs than 40 bits might overflow in sums.
NARROW, LIMB, LIMBS = 1 << 26, 40, 5
LARGEST = 2**63 - 1

CHUNK = pa.schema(
    [
        ("vec_id", pa.list_(pa.int64())), ("label", pa.list_(pa.string())), ("kind", pa.string()), ("dim", pa.int32()),
        ("order", pa.binary()), ("flat", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("sums", pa.list_(pa.binary())),
    ]
)
CHUNKS = (
    "vec_id array<long>, label array<string>, kind string, dim int, order binary, flat binary, low binary,"
    " high binary, sums array<binary>"
)
CODES = "vec_id long, label string, code string, error long"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (n, d) with coordinates of ``bits`` bits; d * bits is at most 63.

    By Skilling's transform: exchanges and inversions per bit turn coordinates into the transposed index.
    """
    x = points.T.astype(np.int64).copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        high, low = 1 << b, (1 << b) - 1
        for i in range(d):
            invert = x[i] & high > 0
            swap = np.where(invert, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(invert, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] >> b & 1 > 0, (1 << b) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = index << 1 | x[i] >> b & 1
    return index


def _curve(part: np.ndarray) -> np.ndarray:
    """Order of one position's parts along the curve, over the box of the chunk; many components get one bit each."""
    d = min(part.shape[1], 60)
    bits = max(1, min(10, 60 // d))
    points = part[:, :d].astype(float)
    low, high = points.min(axis=0), points.max(axis=0)
    scaled = (points - low) / np.where(high > low, high - low, 1) * ((1 << bits) - 1)
    return np.argsort(hilbert(scaled.astype(np.int64), bits), kind="stable")


def _integers(values: np.ndarray, exact: bool) -> np.ndarray:
    """Whole numbers held as floats, as 64-bit integers or, if ``exact``, as Python's."""
    if not exact:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.reshape(-1).tolist()], object).reshape(values.shape)


def _limbs(number: int) -> list[int]:
    found = []
    for _ in range(LIMBS - 1):
        found.append(number & (1 << LIMB) - 1)
        number >>= LIMB
    return [*found, number]


def _whole(limbs: list[int]) -> int:
    return sum(v << (LIMB * i) for i, v in enumerate(limbs))


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and ``v``: whole components as doubles, which hold them exactly."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.transform("embedding", lambda x: x.cast("double") * 256).alias("embedding"),
    ).filter("embedding IS NOT NULL")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # Beyond 2^52 a double is whole already, and floor() would leave the range of a long.
    scaled = F.transform("embedding", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return rows.filter(finite).select("vec_id", "label", scaled.alias("v"))


def chunked(rows: DataFrame, dim: int, parts: int = PARTS, block: int = BLOCK, room: int = ROOM) -> DataFrame:
    """Chunks of rows of one dimension, written and read back."""
    spark, width = rows.sparkSession, dim // parts
    most = max(block, room // max(dim, 1))

    def chunk(ids: pa.Array, labels: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        top = np.abs(values).max(initial=0)
        kind = "i2" if top < 1 << 15 else "i4" if top < 1 << 31 else "f8"
        edges = np.arange(0, n, block)
        order, flat, low, high, sums = [], [], [], [], []
        for p in range(parts):
            part = values[:, p * width : (p + 1) * width]
            by = _curve(part) if width else np.arange(n)
            part = part[by]
            order.append(by.astype(np.int32))
            flat.append(part)
            low.append(np.minimum.reduceat(part, edges, axis=0))
            high.append(np.maximum.reduceat(part, edges, axis=0))
            exact = _integers(part, top >= NARROW)
            total = np.add.reduceat(exact, edges, axis=0)
            sums.append(total.tolist() if top >= NARROW else total)
        packed = [repr(s).encode() for s in sums] if top >= NARROW else [s.astype(np.int64).tobytes() for s in sums]
        row = [
            [ids.to_pylist()], [labels.to_pylist()], [kind], [dim], [np.stack(order).tobytes()],
            [np.stack(flat).astype(kind).tobytes()], [np.stack(low).astype(kind).tobytes()],
            [np.stack(high).astype(kind).tobytes()], [packed],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, CHUNK)], schema=CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def full() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, labels, vectors = (c.combine_chunks() for c in table.columns)
            return chunk(ids, labels, vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))

        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, most - size)
                held.append(piece)
                batch, size = batch.slice(piece.num_rows), size + piece.num_rows
                if size == most:
                    yield full()
                    held, size = [], 0
        if size:
            yield full()

    path = f"{checkpoint_folder(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    rows.filter(F.size("v") == dim).mapInArrow(run, CHUNKS).write.parquet(path)
    return spark.read.schema(CHUNKS).parquet(path)


class Chunk:
    """One row of ``chunked``: arrays of all positions."""

    def __init__(self, batch: pa.RecordBatch, at: int, parts: int, block: int):
        def get(name: str):
            return batch.column(batch.schema.get_field_index(name))[at]

        self.ids, self.labels = get("vec_id").values, get("label").values
        self.n, self.width, kind = len(self.ids), get("dim").as_py() // parts, get("kind").as_py()

        def array(name: str, kind: str, *shape: int) -> np.ndarray:
            return np.frombuffer(get(name).as_buffer(), kind).reshape(shape)

        self.edges = np.append(np.arange(0, self.n, block), self.n)
        blocks = len(self.edges) - 1
        self.order = array("order", "i4", parts, self.n)
        flat = array("flat", kind, parts, self.n, self.width)
        self.wide = bool(flat.size) and float(np.abs(flat.astype(float)).max()) >= NARROW
        self.low, self.high = (
            _integers(array(c, kind, parts, blocks, self.width), self.wide) for c in ("low", "high")
        )
        self.flat = _integers(flat, self.wide)
        self.packed = get("sums")

    def sums(self, p: int) -> np.ndarray:
        """Component sums of the blocks of a position."""
        data = self.packed[p].as_py()
        if not self.wide:
            return np.frombuffer(data, np.int64).reshape(-1, self.width)
        rows = data.decode().strip("[]").split("], [")
        return np.array([[int(v) for v in r.split(",") if v.strip()] for r in rows], object)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries may be nearest to something in each box: booleans (boxes, entries)."""
    under = low[:, None, :] - book[None]
    over = book[None] - high[:, None, :]
    outside = np.maximum(np.maximum(under, over), 0)
    across = np.maximum(-under, -over)
    least, most = (outside * outside).sum(axis=2), (across * across).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the first of equals, and the squared distance."""
    away = points[:, None, :] - entries[None]
    squares = (away * away).sum(axis=2)
    best = squares.argmin(axis=1)
    return best, squares[np.arange(len(points)), best]


def _book(books: list[list[list[int]]], p: int, wide: bool) -> np.ndarray:
    return np.array(books[p], object if wide else np.int64).reshape(len(books[p]), -1)


def _wide(books: list[list[list[int]]]) -> bool:
    return any(abs(c) >= NARROW for b in books for e in b for c in e)


def round_sums(chunks: DataFrame, books: list, block: int = BLOCK) -> DataFrame:
    """p, entry, n and s0, s1, ...: counts, and sums in limbs, of the parts nearest to each entry."""
    parts, entries = len(books), len(books[0])
    width = len(books[0][0])
    far = _wide(books)
    names = [f"s{i}" for i in range(width * LIMBS)]
    schema = pa.schema([("p", pa.int32()), ("entry", pa.int32()), ("n", pa.int64())] + [(c, pa.int64()) for c in names])

    def add(chunk: Chunk, p: int, counts: np.ndarray, sums: np.ndarray) -> None:
        wide = chunk.wide or far
        book = _book(books, p, wide)
        points = chunk.flat[p].astype(object) if wide else chunk.flat[p]
        listed = shortlists(chunk.low[p], chunk.high[p], book)
        stored = chunk.sums(p)
        for b, (at, end) in enumerate(zip(chunk.edges, chunk.edges[1:])):
            short = np.flatnonzero(listed[b])
            if len(short) == 1:
                counts[p, short[0]] += end - at
                sums[p, short[0]] += stored[b]
                continue
            found = short[nearest(points[at:end], book[short])[0]]
            counts[p] += np.bincount(found, minlength=entries)
            order = np.argsort(found, kind="stable")
            used, heads = np.unique(found[order], return_index=True)
            sums[p, used] += np.add.reduceat(points[at:end][order], heads, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), object)
        for batch in batches:
            for at in range(batch.num_rows):
                chunk = Chunk(batch, at, parts, block)
                for p in range(parts):
                    add(chunk, p, counts, sums)
        rows = [
            [p, e, int(counts[p, e]), *(v for c in sums[p, e] for v in _limbs(int(c)))]
            for p, e in zip(*map(np.ndarray.tolist, np.nonzero(counts)))
        ]
        columns = list(zip(*rows)) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    text = ", ".join(["p int", "entry int", "n long"] + [f"{c} long" for c in names])
    found = chunks.mapInArrow(run, text)
    return found.groupBy("p", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[list[list[int]]]:
    """The parts of the rows with the smallest ids: a codebook per position; empty without rows."""
    order = [F.col("vec_id").asc_nulls_last(), F.size("v"), "v"]
    first = [r.v for r in rows.select("vec_id", "v").orderBy(*order).limit(1).collect()]
    if not first:
        return []
    dim = len(first[0])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    found = rows.filter(F.size("v") == dim).select("vec_id", "v").orderBy(*order).limit(entries).collect()
    width = dim // parts
    return [[[int(x) for x in r.v[p * width : (p + 1) * width]] for r in found] for p in range(parts)]


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """The chunks and the codebooks after all rounds; no chunks where there are no rows."""
    books = first_books(rows, parts, entries)
    if not books:
        return None, books
    dim = len(books[0][0]) * parts
    chunks = chunked(rows, dim, parts)
    width = dim // parts
    for _ in range(rounds if dim else 0):
        for r in round_sums(chunks, books).collect():  # parts x entries rows
            limbs = [r[f"s{i}"] for i in range(width * LIMBS)]
            books[r.p][r.entry] = [_whole(limbs[i * LIMBS : (i + 1) * LIMBS]) // r.n for i in range(width)]
    return chunks, books


def assign(chunks: DataFrame, books: list, block: int = BLOCK) -> DataFrame:
    """vec_id, label, code and error of every row of the chunks."""
    far, parts = _wide(books), len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                chunk = Chunk(batch, at, parts, block)
                codes = np.zeros((chunk.n, parts), np.uint8)
                errors = np.zeros(chunk.n, object if chunk.wide or far else np.int64)
                for p in range(parts):
                    book = _book(books, p, chunk.wide or far)
                    listed = shortlists(chunk.low[p], chunk.high[p], book)
                    for b, (a, z) in enumerate(zip(chunk.edges, chunk.edges[1:])):
                        short = np.flatnonzero(listed[b])
                        points = chunk.flat[p, a:z]
                        best, squares = nearest(points.astype(book.dtype), book[short])
                        codes[chunk.order[p, a:z], p] = short[best]
                        errors[chunk.order[p, a:z]] += squares
                text = codes.tobytes().hex()
                size = 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [
                        chunk.ids, chunk.labels, pa.array([text[i : i + size] for i in range(0, len(text), size)], pa.string()),
                        pa.array([min(int(e), LARGEST) for e in errors], pa.int64()),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return chunks.mapInArrow(run, CODES)


def spelled(books: list[list[list[int]]]) -> str:
    return ",".join(str(c) for book in books for entry in book for c in entry)


def label_errors(codes: DataFrame, small: int = 100_000, salts: int = 32) -> DataFrame:
    """``codes`` with ``label_error``, the errors of each label added up.

    Sums of few labels are broadcast after they were counted; many are joined on the label and a salt, so a
    label that a third of the rows carry is spread.
    """
    codes = codes.withColumn("_label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = cut(codes.groupBy("_label").agg(F.least(total, F.lit(LARGEST)).cast("long").alias("label_error")))
    if sums.count() <= small:
        return codes.join(F.broadcast(sums), "_label").drop("_label")
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    codes = codes.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    return codes.join(salted, ["_label", "_salt"]).drop("_label", "_salt")


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[list[list[int]]]]:
    """vec_id, code, error and label_error per kept row; and the codebooks, by part, entry and component."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hexadecimal digits: 1 to 256 entries")
    rows = kept(vectors)
    chunks, books = train(rows, parts, entries, rounds)
    none = {"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")}
    if chunks is None:
        codes = rows.select("vec_id", "label").withColumns(none)
    else:
        others = rows.filter(F.size("v") != len(books[0][0]) * parts).select("vec_id", "label")
        codes = assign(chunks, books).unionByName(others.withColumns(none))
    return label_errors(cut(codes)).drop("label"), books


def digests(vectors: DataFrame) -> DataFrame:
    codes, books = compress(vectors)
    return codes.withColumn("codebooks_sha256", F.lit(hashlib.sha256(spelled(books).encode()).hexdigest()))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by brute force: every part against every entry."""
    text = f"""
WITH k AS (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), x AS MATERIALIZED (
    SELECT r, vec_id, label, (i - 1) // w AS p, (i - 1) % w AS j, floor(256 * v[i]::DOUBLE)::BIGINT AS c
    FROM (SELECT *, len(v) // {parts} AS w, unnest(range(1, len(v) + 1)) AS i FROM k)
), b0 AS (SELECT p, r - 1 AS e, j, c FROM x WHERE r <= {entries})"""
    for n in range(rounds + 1):
        text += f"""
, d{n} AS MATERIALIZED (
    SELECT r, p, min({{'d': d, 'e': e}}) AS best FROM (
        SELECT x.r, x.p, b.e, sum((x.c - b.c) * (x.c - b.c))::BIGINT AS d
        FROM x JOIN b{n} b ON x.p = b.p AND x.j = b.j GROUP BY x.r, x.p, b.e
    ) GROUP BY r, p
)"""
        if n < rounds:
            text += f"""
, b{n + 1} AS MATERIALIZED (
    SELECT b.p, b.e, b.j, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN (
        SELECT x.p, d.best.e AS e, x.j, floor(sum(x.c)::DOUBLE / count(*))::BIGINT AS c
        FROM x JOIN d{n} d ON x.r = d.r AND x.p = d.p GROUP BY ALL
    ) m ON b.p = m.p AND b.e = m.e AND b.j = m.j
)"""
    return text + f"""
, f AS (
    SELECT k.vec_id, k.label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
    FROM d{rounds} JOIN k USING (r) GROUP BY k.r, k.vec_id, k.label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256
FROM f
"""


ORACLE = _oracle()
