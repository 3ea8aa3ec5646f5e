"""Removal of long repeated byte strings, by merged Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts somewhere else, in any text.

1. ``anchored``: every window of ``length`` bytes has an anchor, the string of ``gram`` bytes in it with the least hash.
   Neighbouring windows with one anchor are a run. Equal windows have equal anchors at equal offsets, so
   only runs whose anchor is met again can hold a repeated window. A run is known by its anchor and a hash of
   all its bytes.
2. Runs met twice byte for byte repeat as a whole. Runs met once whose anchor has other runs are
   open: one copy of each run of such an anchor is cut out of its text (``segments``).
3. Segments are bundled by anchor, about ``bundle`` bytes to a task. In each bundle, shards get their transforms,
   which are merged by interleave refinement (``bwt``); blocks with a common prefix of ``length`` bytes give the
   repeated windows. Anchors with more than ``many`` segments are spread over tasks by the hash of each
   window instead, however many there are.
4. Windows go back to their texts, which are cut (``remove``).

Everything is exact but for collisions of 64-bit hashes (of runs with one anchor, and of windows).

Edge cases: null texts are empty; texts shorter than ``length`` bytes keep all; matches don't cross texts; rows
repeated with one id and text match each other, and are cut alike; ids may be null. Texts of any length are
read whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpdeck.llm.bwt import repeated_windows
from dumpdeck.llm.common import cut, row_key
from dumpdeck.llm.shingles import Powers, mix, prefix_sums

LENGTH, GRAM, BUNDLE, MANY = 400, 128, 1_000_000, 20_000
PART, PLACE = 1 << 23, (1 << 24) - 1

RUNS = "rid long, at long, n int, anchor long, run long"
SEGMENTS = "anchor long, run long, n int, bytes binary"
WINDOWS = "anchor long, run long, low int, high int"


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in text.split(", "))])


def least_in_windows(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbouring values, from running minima of blocks."""
    n = len(values) - size + 1
    padded = np.full(-(-len(values) // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, size)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[size - 1 : size - 1 + n])


def anchors(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of windows of ``size`` hashes with one anchor begin, and the places of their anchors.

    An anchor is the leftmost of the least hashes, by their upper 40 bits; so equal windows that overlap are in
    different runs. Long arrays are done in parts, since a place has 24 bits.
    """
    firsts, places = [], []
    n = len(hashes) - size + 1
    for low in range(0, n, PART):
        part = hashes[low : min(low + PART, n) + size - 1]
        marked = (part & ~np.uint64(PLACE)) | np.arange(len(part), dtype=np.uint64)
        place = (least_in_windows(marked, size) & np.uint64(PLACE)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        firsts.append(first + low)
        places.append(place[first] + low)
    return np.concatenate(firsts), np.concatenate(places)


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of windows with one anchor: text (rid), first window, number of windows, anchor, hash of its bytes."""
    schema = _schema(RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                if len(data) < length:
                    continue
                sums = prefix_sums(data, powers)
                down = powers(len(data) + 1)[1]
                hashes = mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
                first, place = anchors(hashes, length - gram + 1)
                size = np.diff(np.append(first, len(data) - length + 1))
                whole = (sums[first + size - 1 + length] - sums[first]) * down[first] + size.astype(np.uint64)
                columns = (np.full(len(first), rid), first, size, hashes[place].view(np.int64), mix(whole).view(np.int64))
                for held, column in zip(out, columns, strict=True):
                    held.append(column)
            if out[0]:
                arrays = [pa.array(np.concatenate(c), t) for c, t in zip(out, schema.types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.select(row_key().alias("rid"), "text").mapInArrow(run, RUNS)


def segments(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the runs in ``wanted`` (rid, at, n, anchor, run), cut out of their texts."""
    schema = _schema(SEGMENTS)
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("at", "n", "anchor", "run")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(low, 256).to_pylist():
                    data = row["text"].encode()
                    for r in row["runs"]:
                        bytes_ = data[r["at"] : r["at"] + r["n"] - 1 + length]
                        out.append({"anchor": r["anchor"], "run": r["run"], "n": r["n"], "bytes": bytes_})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    keyed = docs.select(row_key().alias("rid"), "text")
    return keyed.join(lists, "rid").dropDuplicates(["rid"]).select("text", "runs").mapInArrow(run, SEGMENTS)


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def merged(parts: DataFrame, length: int, bundle: int) -> DataFrame:
    """Repeated windows of segments, as ranges within their runs, by merged transforms of each bundle."""
    total = parts.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    schema = _schema(WINDOWS)

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["anchor", "run", "n", "bytes"]).to_pylist()
        found = repeated_windows([(r["bytes"], r["n"]) for r in rows], length)
        out = []
        for r, flags in zip(rows, found, strict=True):
            for low, high in zip(*_ranges(flags), strict=True):
                out.append({"anchor": r["anchor"], "run": r["run"], "low": int(low), "high": int(high)})
        return pa.Table.from_pylist(out, schema)

    bundles = max(1, -(-total // bundle))
    dealt = parts.withColumn("bundle", F.pmod(F.xxhash64("anchor"), F.lit(bundles)))
    return dealt.groupBy("bundle").applyInArrow(run, WINDOWS)


def hashed(parts: DataFrame, length: int) -> DataFrame:
    """The same for segments of very common anchors, whose windows are counted by hash, each in its own place."""
    schema = _schema("anchor long, run long, low int, window long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["bytes"], np.uint8)
                sums, n = prefix_sums(data, powers), row["n"]
                down = powers(len(data) + 1)[1]
                window = mix((sums[length : length + n] - sums[:n]) * down[:n])
                columns = [np.full(n, row["anchor"]), np.full(n, row["run"]), np.arange(n), window.view(np.int64)]
                arrays = [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    windows = parts.mapInArrow(run, "anchor long, run long, low int, window long")
    often = windows.groupBy("anchor", "window").agg(F.count("*").alias("times")).filter("times > 1")
    found = windows.join(often, ["anchor", "window"], "left_semi")
    return found.select("anchor", "run", "low", (F.col("low") + 1).alias("high"))


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bundle: int = BUNDLE, many: int = MANY) -> DataFrame:
    """rid, low, high: ranges of window starts, in bytes, whose windows occur elsewhere too."""
    runs = cut(anchored(docs, length, gram))
    again = runs.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor")
    runs = cut(runs.hint("merge").join(again, "anchor"))
    place = F.struct("rid", "at", "n")
    kinds = cut(runs.groupBy("anchor", "run").agg(F.count("*").alias("times"), F.min(place).alias("place")))
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("runs"), F.min("times").alias("least"))
    open_ = kinds.join(anchors.filter("runs > 1 AND least = 1"), "anchor").select(
        "anchor", "run", "place.*", (F.col("runs") > many).alias("common")
    )
    parts = cut(segments(docs, open_, length).join(open_.select("anchor", "run", "common"), ["anchor", "run"]))
    windows = merged(parts.filter("NOT common"), length, bundle).unionByName(hashed(parts.filter("common"), length))
    whole = kinds.filter("times > 1").select(
        "anchor", "run", F.lit(0).alias("low"), F.col("place.n").alias("high")
    )
    windows = cut(windows.join(whole, ["anchor", "run"], "left_anti").unionByName(whole))
    return runs.join(windows, ["anchor", "run"]).select(
        "rid", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high")
    )


CUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end")]))),
        T.StructField("kept", T.BinaryType()),
    ]
)


def remove(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of bytes) and kept (the bytes left) of every row."""
    ranges = repeated(docs, length, **how)
    lists = ranges.groupBy("rid").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(low, 256).to_pylist():
                    data, spans = (row["text"] or "").encode(), []
                    for start, high in sorted((r["low"], r["high"]) for r in row["ranges"] or ()):
                        end = high - 1 + length
                        if spans and start <= spans[-1]["end"]:
                            spans[-1]["end"] = max(end, spans[-1]["end"])
                        else:
                            spans.append({"start": start, "end": end})
                    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append({"doc_id": row["doc_id"], "n_bytes": len(data), "spans": spans, "kept": kept})
                yield pa.RecordBatch.from_pylist(out, schema)

    keyed = docs.select("doc_id", "text", row_key().alias("rid"))
    return keyed.join(lists, "rid", "left").select("doc_id", "text", "ranges").mapInArrow(run, CUT)


def digests(docs: DataFrame, **how) -> DataFrame:
    found = remove(docs.select(F.col("doc_id").cast("long"), "text"), **how)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
