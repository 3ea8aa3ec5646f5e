"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 state machine.

A text is cut by the pre-token pattern; each match is encoded by itself. The merges define a
nondeterministic transducer over bytes whose states are (last token, trie node of the token being
read): on a byte it moves down the trie, and where a token ends that may follow the last one, it may
also start afresh. A token b may follow a when merging a + b would never join across their border,
which is read off the merge trees of both (``may_follow``). For every prefix of the input exactly one path
ends in a token. Subset construction happens on demand, byte by byte; each subset keeps the tokens its
paths have not agreed on yet, and what all of them agree on is emitted: after bounded lookahead, since no
path can be longer than the longest token.

Subsets are numbered and their moves kept for the first ``DEEP`` bytes of a pre-token, where most of
them agree; further bytes move a subset without keeping it. The caches are bounded and only save time.

Edge cases: a null text is an empty text and has no tokens; texts are encoded whole, whatever their
length; ids outside the vocabulary are an error; repeated rows are encoded alike; extra columns stay.
Ids that decode to broken UTF-8 give U+FFFD where ``bytes.decode`` would.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATES, PAIRS, MEMO, DEEP, NEVER = 60_000, 400_000, 300_000, 4, 1 << 60
ROWS = 256


class Transducer:
    """Ranks to token ids, one pre-token at a time."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.limit = ranks, states
        self.tokens = {rank: token for token, rank in ranks.items()}
        trie: list[dict[int, int]] = [{}]
        ends = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                at = trie[node]
                node = at.get(byte) or at.setdefault(byte, len(trie))
                if node == len(trie):
                    trie.append({})
                    ends.append(-1)
            ends[node] = rank
        # By node and byte: the next node (0 if no token goes on from there) and the token that ends there (or -1).
        self.down = [{byte: (n if trie[n] else 0, ends[n]) for byte, n in at.items()} for at in trie]
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.restart()

    def restart(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.subsets: list[frozenset] = []
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.tails: list[tuple[int, ...]] = []
        self._number(frozenset({(-1, 0, ())}))

    def _number(self, subset: frozenset) -> int:
        n = self.numbers.setdefault(subset, len(self.subsets))
        if n == len(self.subsets):
            self.subsets.append(subset)
            self.moves.append({})
            self.tails.append(next((rest for _, node, rest in subset if node == 0), ()))
        return n

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge makes a token, when its bytes are merged by rank."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                raise ValueError(f"token {token!r} can't be made by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int, int]]:
        """Parts at one edge of a token, whole token first: bytes, rank it appears at, rank it is merged at."""
        found = self.edges.get((token, right))
        if found is None:
            found, part, until = [], self.tokens[token], NEVER
            while True:
                born = self.ranks[part] if len(part) > 1 else -1
                found.append((part, born, until))
                if len(part) == 1:
                    break
                part, until = self._halves(part)[right], born
            self.edges[token, right] = found
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """No merge crosses the border of a + b: none has its turn while both of its parts are there."""
        known = True
        for left, born_left, until_left in self._edge(a, True):
            for right, born_right, until_right in self._edge(b, False):
                rank = self.ranks.get(left + right)
                if rank is None or max(born_left, born_right) >= min(until_left, until_right):
                    continue
                # Of equal ranks the leftmost goes first: inside a before the border, the border before inside b.
                if rank < until_left and rank <= until_right:
                    known = False
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = known
        return known

    def _step(self, paths: list, byte: int) -> list:
        """All paths one byte on."""
        down, pairs, out = self.down, self.pairs, []
        for last, node, rest in paths:
            hit = down[node].get(byte)
            if hit is None:
                continue
            child, token = hit
            if child:
                out.append((last, child, rest))
            if token >= 0:
                if last >= 0:
                    fits = pairs.get(last << 32 | token)
                    if fits is None:
                        fits = self.may_follow(last, token)
                    if not fits:
                        continue
                out.append((token, 0, (*rest, token)))
        return out

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        paths = self._step(self.subsets[state], byte)
        first = min(paths, key=lambda p: len(p[2]))[2]
        same = len(first)
        for _, _, rest in paths:
            while rest[:same] != first[:same]:
                same -= 1
        step = self._number(frozenset((last, node, rest[same:]) for last, node, rest in paths)), first[:same]
        self.moves[state][byte] = step
        return step

    def encode(self, piece: bytes) -> list[int]:
        if len(self.subsets) > self.limit:
            self.restart()
        state, out, moves = 0, [], self.moves
        for byte in piece[:DEEP]:
            state, emitted = moves[state].get(byte) or self._move(state, byte)
            if emitted:
                out += emitted
        if len(piece) <= DEEP:
            out += self.tails[state]
            return out
        paths = list(self.subsets[state])
        for byte in piece[DEEP:]:
            paths = self._step(paths, byte)
            if len(paths) == 1:  # all agree: nothing is open
                last, node, rest = paths[0]
                out += rest
                paths = [(last, node, ())]
            elif len(paths[0][2]) > 64:  # a long pre-token: emit what all paths share
                rests = [p[2] for p in paths]
                same = next((i for i, t in enumerate(zip(*rests)) if len(set(t)) > 1), min(map(len, rests)))
                out += rests[0][:same]
                paths = [(last, node, rest[same:]) for last, node, rest in paths]
        for _, node, rest in paths:
            if node == 0:
                out += rest
        return out


class Utf8Stream:
    """Turns chunks of bytes into text; a character cut by a chunk's end waits for the next chunk."""

    def __init__(self):
        self.held = b""

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
            if need > back and (back == 1 or self._second(byte, data[1 - back])):
                cut -= back
            break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _second(lead: int, byte: int) -> bool:
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
        return low <= byte <= high

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


class Codec:
    """Texts to ids and back, with a memo of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        self.transducer = Transducer(ranks)
        self.cut = regex.compile(pattern).findall
        self.memo: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.limit = memo
        self.bytes = [self.transducer.tokens[i] for i in range(len(ranks))]
        self.sizes = np.array([len(b) for b in self.bytes])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.spelling = np.frombuffer(b"".join(self.bytes), np.uint8)

    def encode(self, text: str) -> list[int]:
        memo = self.memo
        if len(memo) > self.limit:
            self.older, self.memo = memo, {}
            memo = self.memo
        pieces = self.cut(text)
        found = list(map(memo.get, pieces))
        if None in found:
            for n, ids in enumerate(found):
                if ids is None:
                    piece = pieces[n]
                    ids = memo.get(piece) or self.older.get(piece) or self.transducer.encode(piece.encode())
                    if len(piece) < 64:
                        memo[piece] = ids
                    found[n] = ids
        return list(chain.from_iterable(found))

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, gathered from all tokens' bytes."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[ids] - ends + sizes, sizes)
        return self.spelling[at].tobytes()

    def decode(self, ids: np.ndarray | list[int], chunk: int = 65_536) -> str:
        """Text of tokens, ``chunk`` tokens at a time."""
        stream, ids = Utf8Stream(), np.asarray(ids, np.int64)
        out = [stream.feed(self.spelled(ids[k : k + chunk])) for k in range(0, len(ids), chunk)]
        return "".join(out) + stream.finish()


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank per line; a fixed vocabulary, read by the driver."""
    if "://" in path:
        data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    else:
        with open(path, "rb") as file:
            data = file.read()
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Vocabulary:
    """Ranks and pattern, sent to executors once; each Python worker compiles them once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.sent = spark.sparkContext.broadcast({"ranks": read_ranks(spark, path), "pattern": pattern})

    def codec(self) -> Codec:
        held = self.sent.value
        if "codec" not in held:
            held["codec"] = Codec(held["ranks"], held["pattern"])
        return held["codec"]


def _spread(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids`` instead of ``text``: the token ids of the whole text. A column ``ids`` is replaced."""
    others = [c for c in docs.columns if c not in (text, ids)]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in _spread(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = pa.array([codec.encode(t) if t else [] for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in others] + [found], [*others, ids]
            )

    return docs.select(*others, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the column ``text``: what the ids decode to."""
    others = [c for c in encoded.columns if c != text]
    schema = T.StructType([encoded.schema[c] for c in others] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in _spread(batches):
            lists = batch.column(batch.schema.get_field_index(ids))
            flat, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            found = pa.array([codec.decode(flat[a:b]) for a, b in zip(edges, edges[1:])], pa.string())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, found], [*others, text])

    return encoded.select(*others).mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and of the text decoded from them."""
    back = decode(encode(docs.select("doc_id", "text"), vocabulary), vocabulary)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
