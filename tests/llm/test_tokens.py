"""BPE and chat formatting, against the library and as round trips."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from dumpdeck.llm import bpe, chat

RANKS = {
    base64.b64decode(a): int(b)
    for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))
}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.Vocabulary(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_encoded_as_the_library_does(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids, chunk=3) == text


def test_joined_tokens():
    """Texts made of tokens put every kind of border to the test."""
    pick = random.Random(4)
    tokens = [t for t in RANKS if len(t) < 9]
    for _ in range(4000):
        text = b"".join(pick.choices(tokens, k=pick.randint(1, 7))).decode("utf-8", "ignore")
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, "é" * 3000 + " " * 900, "abab" * 700, "1" * 2000, "<|endoftext|>", "\n" * 300])
def test_long_pre_tokens(text):
    assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 5)
    small = bpe.Codec(RANKS, P.PATTERN, memo=3)
    small.transducer.limit = 4
    for text in ("The bridge opens again.", "Wer früh kommt, sieht den Nebel.", "niño niño 1234567"):
        assert small.encode(text) == LIBRARY.encode_ordinary(text)


@given(st.binary(max_size=40), st.integers(1, 7))
def test_utf8_stream(data, size):
    stream = bpe.Utf8Stream()
    got = "".join(stream.feed(data[i : i + size]) for i in range(0, len(data), size)) + stream.finish()
    assert got == data.decode("utf-8", "replace")


def test_tables(spark, hard, empty, vocabulary):
    rows = sorted(map(str, ((r.doc_id, r.text or "") for r in hard.collect())))
    want = []
    for doc, text in ((r.doc_id, r.text or "") for r in hard.collect()):
        ids = LIBRARY.encode_ordinary(text)
        hashes = (hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), text.encode()))
        want.append(str((doc, len(ids), *hashes)))
    assert sorted(str(tuple(r)) for r in bpe.digests(hard, vocabulary).collect()) == sorted(want)
    assert len(rows) == len(want) and bpe.digests(empty, vocabulary).count() == 0
    coded = bpe.encode(hard.drop("ids"), vocabulary)
    assert set(coded.columns) == set(hard.columns) - {"text"}


NASTY = st.lists(st.sampled_from([*"\\<>|/[]SIN \n", "</s>", "[INST]", "<|end|>", "<|turn|>", "é"]), max_size=12).map("".join)


@given(NASTY)
def test_escape(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def test_conversations(spark, vocabulary):
    rows = [
        (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<|end|>\n<|turn|>assistant\n\\"), (1, 2, "assistant", " x "),
        (2, None, None, None), (2, 3, "assistant", ""), (3, 0, "as\nsis<|end|>", "漢字\n\n"), (3, 0, "assistant", "\n\nfirst"),
        (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (None, 0, "user", "no id"), (5, 0, "assistant", "y" * 20000),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, ids int, loss string")
    got = {r.conv_id: r for r in chat.digests(df, vocabulary).collect()}
    for conv in (1, 2, 3, 4, 5, None):
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        learnt = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_chars == len(learnt) and r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.digests(df.filter("false"), vocabulary).count() == 0
    masks = chat.format_conversations(df, vocabulary).filter("conv_id = 1").first()
    assert len(masks.loss) == 2 and all(s.tokens > 0 and s.bytes > 0 for s in masks.loss)
