"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole with a template that marks turns, and encoded once. Token spans in bytes
come from the running lengths of its tokens; turn spans in bytes from rendering. Both are sorted, so the
tokens of each trained turn are found by binary search; a token that straddles a border is cut by bytes.

Control strings inside roles and texts are escaped: a backslash is doubled, and a control string gets one
after its first character, so that no text holds a control string any more; ``unescape`` undoes both.

Rows reach a task sorted by conversation and turn, and are read as a stream: one conversation at a time is
held, since it is rendered and encoded whole.

Edge cases: null texts and roles are empty; a null ``conv_id`` is one conversation; turns with equal
numbers are ordered by role and text, null numbers first; repeated rows are turns of their own; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpdeck.llm.bpe import Codec, Vocabulary

#: Strings that mark turns here or in templates of other kinds.
TURN, END = "<|turn|>", "<|end|>"
CONTROL = (
    TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
)
TRAINED = ("assistant",)

FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField(
            "loss",
            T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("token", "tokens", "skip", "bytes")])),
        ),
    ]
)
READ = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turns", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("role", "text")]))),
        T.StructField("loss_text", T.StringType()),
        T.StructField("formatted", T.StringType()),
    ]
)


def _control() -> re.Pattern:
    return re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))


def escape(text: str) -> str:
    return _control().sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the byte spans of the texts to learn from, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{TURN}{escape(role or '').replace(chr(10), chr(92) + chr(10))}\n"
        body = escape(text or "")
        start = at + len(head.encode())
        end = start + len(body.encode())
        if role in TRAINED and end > start:
            spans.append((start, end))
        parts += (head, body, END, "\n")
        at = end + len(END) + 1
    return "".join(parts), spans


def align(ids: list[int], spans: list[tuple[int, int]], codec: Codec) -> list[dict[str, int]]:
    """For each span: its first token, how many tokens meet it, and where in their bytes it lies."""
    if not spans:
        return []
    ends = np.cumsum([len(codec.bytes[i]) for i in ids])
    starts = ends - [len(codec.bytes[i]) for i in ids]
    low, high = np.array(spans).T
    first = np.searchsorted(ends, low, side="right")
    last = np.searchsorted(starts, high, side="left")
    return [
        {"token": int(a), "tokens": int(b - a), "skip": int(s - starts[a]), "bytes": int(e - s)}
        for a, b, s, e in zip(first, last, low, high, strict=True)
    ]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list]]:
    """Neighbouring rows of one conversation, however they are cut into batches."""
    now, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if begun and conv != now:
                yield now, turns
                turns = []
            now, begun = conv, True
            turns.append((role, text))
    if begun:
        yield now, turns


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def format_conversations(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """conv_id, formatted, ids and loss of every conversation in ``rows`` (conv_id, turn, role, text)."""
    span = pa.struct([(n, pa.int64()) for n in ("token", "tokens", "skip", "bytes")])
    schema = pa.schema(
        [("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(span))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()

        def one(conv: int | None, turns: list) -> dict:
            text, spans = render(turns)
            ids = codec.encode(text)
            return {"conv_id": conv, "formatted": text, "ids": ids, "loss": align(ids, spans, codec)}

        yield from _batches((one(*c) for c in _conversations(batches)), schema)

    dealt = rows.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """What the formatted text says: its turns, unescaped, and the text under the loss mask of its tokens."""
    pair = pa.struct([("role", pa.string()), ("text", pa.string())])
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turns", pa.list_(pair)), ("loss_text", pa.string()), ("formatted", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        turn = re.compile(rf"{re.escape(TURN)}((?:[^\n\\]|\\.)*)\n(.*?){re.escape(END)}\n", re.DOTALL)

        def one(row: dict) -> dict:
            turns = [{"role": unescape(a), "text": unescape(b)} for a, b in turn.findall(row["formatted"])]
            learnt = []
            for s in row["loss"]:
                data = b"".join(codec.bytes[i] for i in row["ids"][s["token"] : s["token"] + s["tokens"]])
                learnt.append(unescape(data[s["skip"] : s["skip"] + s["bytes"]].decode()))
            return {"conv_id": row["conv_id"], "turns": turns, "loss_text": "".join(learnt), "formatted": row["formatted"]}

        for batch in batches:
            yield from _batches((one(r) for r in batch.to_pylist()), schema)

    return formatted.mapInArrow(run, READ)


def digests(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    def line(t: Column) -> Column:
        return F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))

    read = read_back(format_conversations(rows, vocabulary), vocabulary)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(rows: DataFrame) -> DataFrame:
    """``rows`` and conversation -7, whose texts are control strings."""
    probe = rows.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


def _sql_pattern() -> str:
    return _control().pattern.replace("'", "''")


ORACLE = rf"""
WITH c AS (
    SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -7, 0, 'user', p, 'user', p FROM (SELECT '</s>[INST] ok [/INST]' AS p)
    UNION ALL SELECT -7, 1, 'assistant', p, 'assistant', p FROM (SELECT '</s>[INST] ok [/INST]' AS p)
), e AS (
    SELECT *, length(t) + len(regexp_extract_all(t, '\\')) + len(regexp_extract_all(t, '{_sql_pattern()}'))
        + length(r) + len(regexp_extract_all(r, '\\')) + len(regexp_extract_all(r, '{_sql_pattern()}'))
        + len(regexp_extract_all(r, '\n')) + {len(TURN) + len(END) + 2} AS n
    FROM c
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(r || chr(10) || t || chr(10), ''
           ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
    CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
           FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
