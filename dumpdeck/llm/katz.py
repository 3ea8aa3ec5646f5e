"""Language-model scores: Katz back-off over word bigrams, with Good-Turing discounts.

    P(w | v) = d(c(v, w)) c(v, w) / c(v)   if the training texts have v w, else  alpha(v) P(w)
    P(w)     = d(c(w)) c(w) / N            if they have w, else the mass that is left for unknown words

d is the Good-Turing discount for counts up to ``LARGE`` and 1 - ``LEAST`` above, so that something is left
after every word; alpha(v) makes the probabilities after v sum to
one exactly: alpha(v) = (1 - sum of P(w | v) over seen v w) / (1 - sum of P(w) over the same w). An end token follows
each text and is the context of the first word of the next one.

The corpus is cut into chunks of about ``ROOM`` bytes, each one row with its vocabulary and token ids. Counts,
tables and weights are partitioned by hash: a chunk sends its distinct words and word pairs to their owners
once, as sorted arrays; owners add up the counts of all chunks and answer in the same order.

1. ``chunked``: texts to chunks of token ids, written to the shared folder.
2. ``requests`` / ``_count``: totals per word and word pair; the first chunk of each trained pair is told so.
3. ``_evaluate``: log probabilities of seen pairs per text; each trained pair adds to its context's sums in
   one chunk; tokens to back off are sent with them to the owner of their context.
4. ``_weigh``: sums per context give alpha, and the back-off weights of each text are added up.

A word that is everywhere costs one entry per chunk. Nothing but totals (N, V, counts of counts) reaches
the driver.

Edge cases: a null text is empty and consists of its end; ids may be null or repeated, each row is a text of
its own (a null id counts as the empty text for the split). Texts are scored whole. With no training text
at all every token is unknown. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import binascii
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpdeck.llm.common import cut
from dumpdeck.llm.shingles import mix

ROOM, ENTRIES, LARGE, FOLDS, LEAST = 24_000_000, 2_000_000, 5, 10, 1e-3
END = b" "

CHUNK = "g long, docs binary, known binary, held binary, sizes binary, vocab binary, tokens binary, n long, trained long"
REQUEST = "kind int, bucket long, g long, keys binary, x binary, y binary, z binary"
ANSWER = "kind int, bucket long, g long, x binary, y binary, stats array<long>"
SCORE = "g long, i int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def pack(a: np.ndarray) -> bytes:
    """An array of fixed-width numbers, byte planes apart and compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _schema(text: str) -> pa.Schema:
    kinds = {
        "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(),
        "array<long>": pa.list_(pa.int64()),
    }
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in text.split(", "))])


def chunked(docs: DataFrame, room: int = ROOM, folds: int = FOLDS) -> DataFrame:
    """Rows of ``docs`` as chunks; a chunk's vocabulary is sorted by hash and its tokens count in it."""
    schema = _schema(CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        hash_ = xxhash.xxh3_64_intdigest

        def fresh():
            ids: defaultdict = defaultdict()
            ids.default_factory = ids.__len__
            ids[END]
            return ids, [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            nonlocal number
            number += 1
            names = np.fromiter((hash_(w) for w in ids), np.uint64, len(ids))
            order = np.argsort(names)
            place = np.empty(len(ids), np.uint32)
            place[order] = np.arange(len(ids), dtype=np.uint32)
            tokens = place[np.concatenate(parts)]
            sizes = np.array([len(p) for p in parts], np.int64)
            held_ = np.array(held)
            row = {
                "g": number, "docs": pack(np.array(names_, np.int64)), "known": pack(np.array(known)), "held": pack(held_),
                "sizes": pack(sizes), "vocab": pack_keys(names[order]), "tokens": pack(tokens), "n": len(tokens),
                "trained": int(sizes[~held_].sum()),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        ids, parts, names_, known, held, size = fresh()
        for batch in batches:
            for at in range(batch.num_rows):
                doc, text = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                data = (text or "").encode().lower()
                parts.append(np.array([ids[w] for w in data.split()] + [0], np.uint32))
                names_.append(doc or 0)
                known.append(doc is not None)
                held.append(binascii.crc32(b"" if doc is None else str(doc).encode()) % folds == 0)
                size += len(data)
                if size >= room:
                    yield chunk()
                    ids, parts, names_, known, held, size = fresh()
        if parts:
            yield chunk()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CHUNK)


class Chunk:
    """A chunk's arrays, its distinct word pairs and their hash keys."""

    def __init__(self, row: dict):
        self.g = row["g"]
        self.held, self.sizes = unpack(row["held"], np.bool_), unpack(row["sizes"], np.int64)
        self.vocab, self.tokens = unpack_keys(row["vocab"]), unpack(row["tokens"], np.uint32)
        trained = np.repeat(~self.held, self.sizes)
        end = self.tokens[-1]
        before = np.concatenate([[end], self.tokens[:-1]]).astype(np.uint64)
        pairs, self.at = np.unique(before << np.uint64(32) | self.tokens, return_inverse=True)
        self.first, self.second = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.words = np.bincount(self.tokens[trained], minlength=len(self.vocab))
        self.pairs = np.bincount(self.at[trained], minlength=len(pairs))
        keys = mix(mix(self.vocab[self.first]) * np.uint64(0x9E3779B97F4A7C15) + self.vocab[self.second])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets, equal parts of the range of keys, begin and end in sorted keys."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def requests(chunks: DataFrame, buckets: int) -> DataFrame:
    """A chunk's counts of words (kind 0) and pairs (kind 1), by the bucket of their owner."""
    schema = _schema(REQUEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                out = []
                for kind, keys, counts in ((0, c.vocab, c.words), (1, c.keys, c.pairs[c.order])):
                    cuts = _cuts(keys, buckets)
                    for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
                        if j > i:
                            part = {"kind": kind, "bucket": b, "g": c.g, "keys": pack_keys(keys[i:j])}
                            out.append(part | {"x": pack(counts[i:j])})
                yield pa.RecordBatch.from_pylist(out, schema)

    return chunks.mapInArrow(run, REQUEST)


def _count(table: pa.Table) -> pa.Table:
    """Totals in the order of each request, who is first with a trained key, and counts of counts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["g"])
    keys = [unpack_keys(r["keys"]) for r in rows]
    counts = np.concatenate([unpack(r["x"], np.int64) for r in rows])
    distinct, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    totals = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    mine = np.zeros(len(at), bool)
    mine[first] = totals > 0
    of = np.bincount(np.minimum(totals, LARGE + 2), minlength=LARGE + 3)
    stats = [int(of[1:].sum()), *map(int, of[1 : LARGE + 2])]
    out, low = [], 0
    for n, (r, k) in enumerate(zip(rows, keys, strict=True)):
        span = slice(low, low + len(k))
        low += len(k)
        row = {"kind": r["kind"], "bucket": r["bucket"], "g": r["g"], "x": pack(totals[at[span]]), "y": pack(mine[span])}
        out.append(row | {"stats": [0 if n else s for s in stats]})
    return pa.Table.from_pylist(out, _schema(ANSWER))


def discounts(counts: list[int]) -> list[float]:
    """Good-Turing discounts by count, 0 to LARGE, from how many items have each count from 1 to LARGE + 1.

    Where counts of counts are too few to give a ratio between 0.05 and 0.95, the nearer of these is taken.
    """
    n = [0, *counts]
    cut_off = (LARGE + 1) * n[LARGE + 1] / n[1] if n[1] else 0.0
    found = [1.0]
    for r in range(1, LARGE + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 1.0
        d = (ratio - cut_off) / (1 - cut_off) if cut_off < 1 else ratio
        found.append(min(0.95, max(0.05, d)))
    return found


class Totals:
    """Trained tokens, distinct trained words, and the discounts of both orders; counts above LARGE lose LEAST."""

    def __init__(self, tokens: int, words: list[int], pairs: list[int]):
        self.n, self.v = tokens, words[0]
        self.first, self.second = [*discounts(words[1:]), 1 - LEAST], [*discounts(pairs[1:]), 1 - LEAST]
        few = [r * k for r, k in enumerate(words[1 : LARGE + 1], 1)]
        lost = sum(k * (1 - d) for k, d in zip(few, self.first[1:])) + LEAST * (tokens - sum(few))
        self.unknown = lost / tokens if tokens else 1.0

    def word(self, counts: np.ndarray) -> np.ndarray:
        d = np.array(self.first)[np.minimum(counts, LARGE + 1)]
        return np.where(counts > 0, d * counts / max(self.n, 1), self.unknown)

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return np.array(self.second)[np.minimum(counts, LARGE + 1)] * counts

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.n + 0.1 * (self.v + 1)))


def _evaluate(totals: Totals, buckets: int):
    """A chunk with the answers to it: scores without back-off weights (kind 2), and what the owners of its
    contexts need (kind 3): their sums over the pairs this chunk answers for, and which texts back off where."""
    schema = _schema(REQUEST)

    def run(_, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        c = Chunk(row)
        by_kind: dict[int, list[dict]] = {0: [], 1: []}
        for r in sorted(answers.to_pylist(), key=lambda r: r["bucket"]):
            by_kind[r["kind"]].append(r)
        words = np.concatenate([unpack(r["x"], np.int64) for r in by_kind[0]])
        pairs, mine = np.empty(len(c.keys), np.int64), np.empty(len(c.keys), bool)
        pairs[c.order] = np.concatenate([unpack(r["x"], np.int64) for r in by_kind[1]])
        mine[c.order] = np.concatenate([unpack(r["y"], np.bool_) for r in by_kind[1]])
        word, context = totals.word(words), words[c.first]
        kept = totals.discounted(pairs) / np.maximum(context, 1)
        value = np.log10(np.where(pairs > 0, kept, word[c.second]))
        begins = np.concatenate([[0], np.cumsum(c.sizes)[:-1]])
        scores = np.add.reduceat(value[c.at], begins)
        bases = np.add.reduceat(totals.base(words)[c.tokens], begins)
        known = np.add.reduceat((words > 0)[c.tokens].astype(np.int64), begins)
        flags = unpack(row["known"], np.bool_) + 2 * c.held.astype(np.int64)
        texts = [scores.view(np.int64), bases.view(np.int64), known, unpack(row["docs"], np.int64), flags, c.sizes]
        out = [{"kind": 2, "bucket": c.g, "g": c.g, "keys": pack(np.concatenate(texts))}]
        n = len(c.vocab)
        mass = np.bincount(c.first[mine], weights=kept[mine], minlength=n)
        lower = np.bincount(c.first[mine], weights=word[c.second[mine]], minlength=n)
        backed = ((context > 0) & (pairs == 0))[c.at]
        doc = np.repeat(np.arange(len(c.sizes)), c.sizes)[backed]
        asked, times = np.unique(c.first[c.at][backed] << 32 | doc, return_counts=True)
        cuts = _cuts(c.vocab, buckets)
        for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if j > i:
                low, high = np.searchsorted(asked >> 32, [i, j])
                part = asked[low:high]
                need = np.concatenate([(part >> 32) - i, part & 0xFFFFFFFF, times[low:high]])
                answer = {"kind": 3, "bucket": b, "g": c.g, "keys": pack_keys(c.vocab[i:j]), "x": pack(mass[i:j])}
                out.append(answer | {"y": pack(lower[i:j]), "z": pack(need)})
        return pa.Table.from_pylist(out, schema)

    return run


def _weigh(table: pa.Table) -> pa.Table:
    """Scores of texts as they are; and for texts that back off, the weights of the contexts owned here."""
    out = []
    rows = table.to_pylist()
    for r in (r for r in rows if r["kind"] == 2):
        scores, bases, known, docs, flags, sizes = unpack(r["keys"], np.int64).reshape(6, -1)
        columns = (docs, flags, sizes, known, bases.view(np.float64), scores.view(np.float64))
        for i, (doc, flag, size, few, base, score) in enumerate(zip(*(x.tolist() for x in columns), strict=True)):
            text = {"g": r["g"], "i": i, "doc_id": doc if flag & 1 else None, "held_out": flag >= 2, "n_tokens": size}
            out.append(text | {"n_known": few, "base_score": base, "score": score})
    asked = sorted((r for r in rows if r["kind"] == 3), key=lambda r: r["g"])
    if asked:
        keys = [unpack_keys(r["keys"]) for r in asked]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        mass, lower = (
            np.bincount(at, weights=np.concatenate([unpack(r[c], np.float64) for r in asked]), minlength=len(distinct))
            for c in "xy"
        )
        weight = np.log10((1 - mass) / (1 - lower))
        low = 0
        for r, k in zip(asked, keys, strict=True):
            own = at[low : low + len(k)]
            low += len(k)
            context, doc, times = unpack(r["z"], np.int64).reshape(3, -1)
            sums = np.bincount(doc, weights=weight[own[context]] * times)
            out += [{"g": r["g"], "i": i, "score": float(sums[i])} for i in np.unique(doc).tolist()]
    return pa.Table.from_pylist(out, _schema(SCORE))


def score(docs: DataFrame, room: int = ROOM, entries: int = ENTRIES, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Texts whose CRC-32 of the id, as text, is a multiple of ``folds`` are held out; the model learns from the others.
    """
    chunks = cut(chunked(docs, room, folds))
    n, trained = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    buckets = max(1, math.ceil(n / entries))
    answers = cut(requests(chunks, buckets).groupBy("kind", "bucket").applyInArrow(_count, ANSWER))
    of = [F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(LARGE + 2)]
    stats = {r["kind"]: [int(r[f"s{i}"]) for i in range(LARGE + 2)] for r in answers.groupBy("kind").agg(*of).collect()}
    totals = Totals(trained, *(stats.get(k, [0] * (LARGE + 2)) for k in (0, 1)))
    evaluated = chunks.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_evaluate(totals, buckets), REQUEST)
    parts = evaluated.groupBy("kind", "bucket").applyInArrow(_weigh, SCORE)
    same = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    scored = parts.groupBy("g", "i").agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in same), F.sum("score").alias("score")
    )
    return scored.select(*same[:4], F.lit(trained).cast("long").alias("train_tokens"), "base_score", "score")
