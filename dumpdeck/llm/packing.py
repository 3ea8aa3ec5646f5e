"""Mixture-controlled packing: deficit round-robin over source queues fills windows to target token shares.

Documents of one source form a queue of tokens. Each window of ``size`` tokens gives every source a quantum, its
target share of the window; a source's deficit is what it was promised and has not got. A turn serves the whole
part of each deficit, tokens still free go one by one to the largest deficits, and what is left is carried to
the next window. Without ``targets`` a source's share is its share of all tokens, so every window has the mix of
the table and all queues end together. With ``targets``, a source whose queue ends leaves the round and the others
share its room by weight; sources without a weight follow last.

1. ``tokenised`` encodes each text once, and writes ids with their place in the queue of (source, task); two bytes
   each where the vocabulary allows.
2. ``queued`` turns sums per (source, task) into places in the whole queue of a source.
3. ``dealt`` cuts queues into chunks of about ``chunk`` tokens over all sources. Where a chunk of a source begins
   is a rounded multiple of its share; the rounding is the deficit that is carried from chunk to chunk, so
   chunks need nothing from each other and may be any number of tasks.
4. ``_rounds`` runs the round-robin of one chunk over its queues. A chunk starts inside the window that the
   one before left unfinished.

Sequences are windows; the last tokens of all, fewer than ``size``, form sequences of falling powers of two,
so nothing is padded. ``sequences`` joins the pieces of each.

Tokens are those of the ``tokenizers`` library. Texts of letters and signs that every Unicode version classes
alike, and without very long runs, are encoded by ``tiktoken`` with the same vocabulary, four times as fast and
to the same ids; all others go through ``tokenizers``.

Edge cases: null and empty texts are one token, the end. A null source is a queue of its own. Ids may be null or
repeated, each row is a document. A long document spans as many windows as it takes. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dumpdeck.llm.common import checkpoint_folder

SIZE, CHUNK, LETTERS, NAMED = 1024, 1 << 20, 1 << 20, 1000
#: Characters outside these ranges, or such long runs, are left to ``tokenizers``.
OTHER = re.compile("[^\t\n\r -~\xa1-ɏ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥]")
LONG = re.compile(r"\S{400}|\s{400}")
#: A place where a text may be cut: no pre-token goes from a letter into the blank after it.
BREAK = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")

TOKENS = "doc_id long, queue string, task int, nth long, n long, ids binary"
PIECE = pa.schema(
    [
        ("doc_id", pa.int64()), ("queue", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
    ]
)
PIECES = (
    "doc_id long, queue string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)


class Tokens:
    """A tokenizer file, and the same vocabulary as ranks, sent to executors once."""

    def __init__(self, spark: SparkSession, path: str, ranks: str | None = None, pattern: str | None = None):
        with open(path, encoding="utf-8") as file:
            held = {"file": file.read()}
        if ranks:
            with open(ranks, "rb") as file:
                held |= {"ranks": file.read(), "pattern": pattern}
        vocabulary = json.loads(held["file"])["model"]["vocab"]
        #: Bytes per id between the stages.
        self.width = 2 if len(vocabulary) < 1 << 16 else 4
        self.sent = spark.sparkContext.broadcast(held)

    def encoder(self) -> Encoder:
        held = self.sent.value
        if "encoder" not in held:
            held["encoder"] = Encoder(held["file"], held.get("ranks"), held.get("pattern"))
        return held["encoder"]


class Encoder:
    """Texts to ids, without special tokens: their spellings in a text are ordinary text."""

    def __init__(self, file: str, ranks: bytes | None, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(file)
        self.slow.encode_special_tokens = True
        self.fast = None
        if ranks:
            import tiktoken

            pairs = map(bytes.split, ranks.splitlines())
            table = {base64.b64decode(token): int(rank) for token, rank in pairs}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast and not OTHER.search(text) and not _long_runs(text):
            return np.frombuffer(array("I", self.fast.encode_ordinary(text)), np.uint32)
        parts = self.slow.encode_batch_fast(list(_cut(text)), add_special_tokens=False)
        return np.concatenate([np.array(p.ids, "<u4") for p in parts])


def _long_runs(text: str, step: int = 200) -> bool:
    """Whether ``LONG`` is found: such a run covers one of the text's blocks, without a blank or with nothing else."""
    for at in range(0, len(text) - step + 1, step):
        block = text[at : at + step]
        if " " not in block or block.isspace():
            return bool(LONG.search(text))
    return False


def _cut(text: str, room: int = LETTERS) -> Iterator[str]:
    at = 0
    while len(text) - at > room:
        found = BREAK.search(text, at + room)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def tokenised(docs: DataFrame, tokens: Tokens, end: int = 0) -> DataFrame:
    """doc_id, queue, task, nth (tokens of the queue before it in its task), n and ids, read back from a table."""
    spark = docs.sparkSession
    schema = pa.schema(
        [("doc_id", pa.int64()), ("queue", pa.string()), ("task", pa.int32()), ("nth", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), {}
        encode, kind = tokens.encoder().encode, f"<u{tokens.width}"
        last = np.array([end], "<u4")
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                names, places, sizes, ids, letters, first = [], [], [], [], 0, at
                while at < batch.num_rows and letters < LETTERS:
                    text = batch.column(2)[at].as_py() or ""
                    queue = batch.column(1)[at].as_py()
                    found = np.concatenate([encode(text), last]) if text else last
                    names.append(queue)
                    places.append(before.get(queue, 0))
                    sizes.append(len(found))
                    ids.append(found.astype(kind).tobytes())
                    before[queue] = places[-1] + len(found)
                    letters += len(text) + 16
                    at += 1
                columns = [batch.column(0).slice(first, at - first), names, [task] * len(ids), places, sizes, ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    # A mark before the name keeps a null source apart from an empty one.
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), "text")
    path = f"{checkpoint_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    rows.mapInArrow(run, TOKENS).write.parquet(path)
    return spark.read.schema(TOKENS).parquet(path)


def queued(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per (queue, task) where its tokens start in the whole queue; and per queue its tokens."""
    sums = tokens.groupBy("queue", "task").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("queue", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return starts, sums.groupBy("queue").agg(F.sum("n").alias("total"))


def phases(totals: DataFrame, targets: dict[str | None, float] | None, chunk: int) -> DataFrame:
    """queue, low, high, chunks, first: the part of each queue that is dealt between two ends of queues.

    Within a phase all shares stay the same. Without targets there is one; with them, one for each source that has a
    weight (at most ``NAMED``), and a last one for all others.
    """
    def chunks(n: int) -> int:
        return max(1, round(n / chunk))

    if targets is None:
        n = totals.agg(F.sum("total")).first()[0] or 0
        return totals.select(
            "queue", F.lit(0).cast("long").alias("low"), F.col("total").alias("high"),
            F.lit(chunks(n)).cast("long").alias("chunks"), F.lit(0).cast("long").alias("first"),
        )
    if len(targets) > NAMED:
        raise ValueError(f"more than {NAMED} targets")
    weights = {"" if s is None else f"={s}": float(w) for s, w in targets.items() if w > 0}
    named = {r.queue: r.total for r in totals.filter(F.col("queue").isin(list(weights))).collect()}
    rows, done, first = [], dict.fromkeys(named, 0), 0
    for ends in sorted(named, key=lambda q: (named[q] / weights[q], q)):
        live = [q for q in named if done[q] < named[q]]
        upto = {
            q: named[q] if q == ends else max(done[q], min(named[q], int(named[ends] / weights[ends] * weights[q])))
            for q in live
        }
        k = chunks(sum(upto[q] - done[q] for q in live))
        rows += [(q, done[q], upto[q], k, first) for q in live if upto[q] > done[q]]
        first, done = first + k, done | upto
    spark = totals.sparkSession
    held = spark.createDataFrame(rows, "queue string, low long, high long, chunks long, first long")
    rest = totals.filter(~F.col("queue").isin(list(weights)))
    return held.unionByName(phases(rest, None, chunk).withColumn("first", F.lit(first).cast("long")))


def _stored(df: DataFrame) -> DataFrame:
    """A small table, written: Spark knows its size when it plans a join, so large sides stay where they are if it may."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/packing-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(tokens: DataFrame, parts: DataFrame, width: int = 4) -> DataFrame:
    """Documents cut where chunks of their queue begin: one row per (document, chunk) with its ids.

    The chunk c of a queue of n tokens begins at floor(n * c / chunks + phase), phase in (0, 1) by the queue's name.
    """
    n, k, h = F.col("high") - F.col("low"), F.col("chunks"), F.lit(1024).cast("long")
    phase = F.pmod(F.xxhash64("queue"), F.lit(1023)) + 1

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    def edge(c: Column) -> Column:
        return div(n, k) * c + div(h * F.pmod(n, k) * c + phase * k, h * k)

    def holding(i: Column) -> Column:
        guess = F.ceil((i + 1 - phase / h) * k / n).cast("long") - 1
        low = F.greatest(guess - 1, F.lit(0).cast("long"))
        return low + (edge(low + 1) <= i).cast("long") + (edge(low + 2) <= i).cast("long")

    rows = tokens.join(parts, ["queue", "task"])
    at = F.col("before") + F.col("nth")
    rows = rows.withColumn("_from", F.greatest(at, "low") - F.col("low"))
    rows = rows.withColumn("_to", F.least(at + F.col("n"), "high") - F.col("low")).filter("_to > _from")
    rows = rows.withColumn("_at", at - F.col("low"))
    last, end = k - 1, F.col("_to") - 1
    chunks = F.sequence(F.least(holding(F.col("_from")), last), F.least(holding(end), last))
    # A queue with fewer tokens than there are chunks has one token in some of them and none in most.
    single = F.transform(F.sequence("_from", end), lambda i: F.least(holding(i), last))
    rows = rows.withColumn("_c", F.explode(F.when(n >= k, chunks).otherwise(single)))
    c = F.col("_c")
    low = F.greatest("_from", F.when(c == 0, F.lit(0).cast("long")).otherwise(edge(c)))
    high = F.least("_to", F.when(c == last, n).otherwise(edge(c + 1)))
    start, length = low - F.col("_at"), high - low
    carried = F.pmod(h * F.pmod(n, k) * c + phase * k, h * k) / (h * k) - phase / h
    return rows.filter(high > low).select(
        (F.col("first") + c).alias("chunk"), "queue", low.alias("place"), "doc_id", start.alias("start"),
        length.alias("length"), F.col("n").alias("doc_tokens"), (n / k).alias("share"), carried.alias("carried"),
        F.substring("ids", (width * start + 1).cast("int"), (width * length).cast("int")).alias("ids"),
    )


def _positions(slices: DataFrame, block: int = 65_536) -> DataFrame:
    """chunk, begin: the tokens of all chunks before it. Sums of blocks of chunks first, so no task sees all chunks."""
    sums = slices.groupBy("chunk").agg(F.sum("length").alias("n")).withColumn("block", F.floor(F.col("chunk") / block))
    blocks = sums.groupBy("block").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return sums.join(blocks, "block").select("chunk", (F.col("base") + F.col("own")).alias("begin"))


def _edges(begin: int, end: int, total: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per sequence that [begin, end) meets: its number, where it starts, and where it ends."""
    full = total // size
    ids = np.arange(begin // size, min(full, -(-end // size)))
    low, high = ids * size, (ids + 1) * size
    at, number, rest = full * size, full, []
    for bit in reversed(range(size.bit_length())):
        if (total - full * size) >> bit & 1:
            if at < end and at + (1 << bit) > begin:
                rest.append((number, at, at + (1 << bit)))
            at, number = at + (1 << bit), number + 1
    more = np.array(rest, np.int64).reshape(-1, 3).T
    return tuple(np.concatenate([a, b]).astype(np.int64) for a, b in zip((ids, low, high), more))


def rounds(budget: np.ndarray, rooms: np.ndarray, share: np.ndarray, deficit: np.ndarray):
    """Deficit round-robin: per window the sources served, in the order of the ring, and their tokens.

    ``budget`` is what each queue holds, ``rooms`` what each window takes (their sums are equal), ``share`` the
    target proportions and ``deficit`` what is carried in.
    """
    left, deficit, share = budget.copy(), deficit.copy(), share / share.sum()
    for turn, room in enumerate(rooms):
        deficit += share * room
        take = np.clip(np.floor(deficit), 0, left).astype(np.int64)
        spare = int(room - take.sum())
        while spare:
            step = 1 if spare > 0 else -1
            open_ = np.flatnonzero(left > take if step > 0 else take > 0)
            order = open_[np.argsort(-step * (deficit - take)[open_], kind="stable")][: abs(spare)]
            take[order] += step
            spare -= step * len(order)
        left -= take
        deficit -= take
        served = np.flatnonzero(take)
        served = np.roll(served, -int(np.searchsorted(served, turn % len(take))))
        yield served, take[served]


def _rounds(total: int, size: int, width: int = 4):
    def run(table: pa.Table) -> pa.Table:
        stored_ids = table["ids"].to_pylist()
        table = table.drop_columns("ids").combine_chunks()
        names = table["queue"].combine_chunks().dictionary_encode()
        rank = np.argsort(np.argsort(np.array(names.dictionary.to_pylist(), object)))
        queue = rank[names.indices.to_numpy(zero_copy_only=False)]
        order = np.lexsort((table["place"].to_numpy(), queue))
        table, queue = table.take(order), queue[order]
        length = table["length"].to_numpy()
        begin = int(table["begin"][0].as_py())
        numbers, low, high = _edges(begin, begin + int(length.sum()), total, size)
        rooms = np.minimum(high, begin + length.sum()) - np.maximum(low, begin)
        heads = np.flatnonzero(np.diff(queue, prepend=-1))
        budget = np.add.reduceat(length, heads)
        share, carried = table["share"].to_numpy()[heads], table["carried"].to_numpy()[heads]

        # Tokens lie in the order of queues; each serving takes the next ones of its queue.
        found = [
            (np.full(len(s), w), s, t, np.cumsum(t) - t)
            for w, (s, t) in enumerate(rounds(budget, rooms, share, carried))
        ]
        window, source, take, inside = (np.concatenate(c) for c in zip(*found))
        by_queue = np.lexsort((window, source))
        window, take, inside = window[by_queue], take[by_queue], inside[by_queue]
        served, stored = np.cumsum(take) - take, np.cumsum(length) - length
        bounds = np.append(np.union1d(served, stored), length.sum())
        at, size_ = bounds[:-1], np.diff(bounds)
        slot = np.searchsorted(served, at, "right") - 1
        row = np.searchsorted(stored, at, "right") - 1
        base = np.maximum(low, begin) - low
        offset = base[window[slot]] + inside[slot] + at - served[slot]
        joined = b"".join([stored_ids[i] for i in order])
        joined = np.frombuffer(joined, f"<u{width}").astype("<u4")
        if len(joined) != bounds[-1]:
            raise ValueError("ids do not match their lengths")
        ids = pa.Array.from_buffers(
            pa.binary(), len(at), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(joined)]
        )
        held = table.take(row)
        return pa.table(
            [
                held["doc_id"], held["queue"], held["start"].to_numpy() + at - stored[row], size_,
                held["doc_tokens"], numbers[window[slot]], offset, ids,
            ],
            schema=PIECE,
        )

    return run


def pack(
    docs: DataFrame, tokens: Tokens, size: int = SIZE, targets: dict[str | None, float] | None = None,
    end: int = 0, chunk: int = CHUNK,
) -> DataFrame:
    """Pieces: doc_id, queue, start, length, doc_tokens, sequence_id, offset and ids (little-endian, 32 bits)."""
    if size < 1 or size & (size - 1):
        raise ValueError("the size of a sequence is a power of two")
    ids = tokenised(docs, tokens, end)
    starts, totals = queued(ids)
    starts, totals = _stored(starts), _stored(totals)
    total = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    shares = phases(totals, targets, chunk)
    parts = _stored(starts.join(shares, "queue"))
    slices = dealt(ids, parts, tokens.width)
    # The places of chunks need no ids; this reads the narrow columns alone.
    narrow = dealt(ids.withColumn("ids", F.lit(b"")), parts)
    placed = slices.join(_stored(_positions(narrow)), "chunk")
    return placed.groupBy("chunk").applyInArrow(_rounds(total, size, tokens.width), PIECES)


def sequences(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """sequence_id, n_tokens, padding and ids: the pieces of each sequence joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    whole = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    return joined.select(
        "sequence_id", "n_tokens", F.when(whole, F.lit(0)).otherwise(size - F.col("n_tokens")).alias("padding"),
        ids.alias("ids"),
    )


def digests(docs: DataFrame, tokens: Tokens) -> DataFrame:
    """The pieces with a checksum of their ids instead of the ids."""
    return pack(docs, tokens).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
