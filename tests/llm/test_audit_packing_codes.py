"""Filter audit, packing and vector codes against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dumpdeck.llm import filter_audit, packing, vector_codes

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{k}") for k in ("json", "tiktoken"))


@pytest.fixture(scope="module")
def tokens(spark):
    return packing.Tokens(spark, JSON, RANKS, public_tokenizers.PATTERN)


# Filter audit -----------------------------------------------------------------


def fails(row, ids):
    text = row.text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    smaller = row.doc_id is not None and any(i is not None and i < row.doc_id for i in ids[text])
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": smaller,
    }


def audited(rows, good, toxic):
    ids = collections.defaultdict(list)
    for r in rows:
        ids[r.text or ""].append(r.doc_id)
    failing = [(r, fails(r, ids)) for r in rows]
    want = {}
    for part in {r.source or "" for r in rows}:
        mine = [(r, f) for r, f in failing if (r.source or "") == part]
        removed_by = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                out = [r for r, f in left if f[name]]
                left = [(r, f) for r, f in left if not f[name]]
                removed_by[name] += len(out)
                want[part, "".join(order), step] = [
                    len(left), len(out), sum(f[name] for _, f in mine) - len(out),
                    sum(f[name] and sum(f.values()) == 1 for _, f in mine),
                    sum(r.doc_id in good for r in out), sum(r.doc_id in toxic for r in out),
                ]
        for (p, order, step), row in want.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return want


def test_filter_audit(spark, hard, empty):
    said = [(1, 1, 0), (1, 0, 0), (2, None, 1), (8, 1, 1), (13, 0, None), (None, 1, 1), (16, 1, 0), (105, 1, 0)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int").withColumnRenamed("x", "text")
    got = {tuple(r)[:3]: list(r)[3:] for r in filter_audit.audit(hard, labels).collect()}
    assert got == audited(hard.collect(), {1, 8, 16, 105}, {2, 8})
    assert filter_audit.audit(empty, labels).count() == 0
    assert filter_audit.audit(hard, labels.filter("false")).count() == len(got)


def test_walk_is_inclusion():
    counts = np.random.default_rng(3).integers(0, 9, (4, 32, 3))
    states = filter_audit.walk(counts)
    for subset in range(32):
        left = [m for m in range(32) if not m & subset]
        assert (states[:, subset] == counts[:, left].sum(axis=1)).all()


# Packing ----------------------------------------------------------------------


def encoded(text):
    held = Tokenizer.from_file(JSON)
    held.encode_special_tokens = True
    return held.encode(text or "", add_special_tokens=False).ids


def check_pieces(rows, docs, size):
    """Each document whole, each sequence gapless; padding only as the tail allows: none."""
    parts = collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        parts[r.sequence_id].append((r.offset, r.length))
    want = collections.Counter((d, tuple([*encoded(t), 0])) for d, t in docs)
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
    got = collections.Counter()
    for (doc, n), pieces in by_doc.items():
        copies = sum(v for (d, t), v in want.items() if d == doc and len(t) == n)
        if copies == 1:
            pieces.sort(key=lambda r: r.start)
            assert [p.start for p in pieces] == list(itertools.accumulate((p.length for p in pieces), initial=0))[:-1]
            got[doc, tuple(np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist())] += 1
        else:
            assert sum(p.length for p in pieces) == n * copies
    assert all(got[k] == v for k, v in want.items() if sum(w for (d, t), w in want.items() if d == k[0] and len(t) == len(k[1])) == 1)
    lengths = {}
    for number, found in parts.items():
        found.sort()
        assert [o for o, _ in found] == list(itertools.accumulate((n for _, n in found), initial=0))[:-1]
        lengths[number] = sum(n for _, n in found)
    assert sorted(lengths) == list(range(len(lengths)))
    total = sum(lengths.values())
    assert [lengths[i] for i in range(total // size)] == [size] * (total // size)
    tail = [lengths[i] for i in range(total // size, len(lengths))]
    assert tail == sorted(set(tail), reverse=True) and all(n & (n - 1) == 0 for n in tail)
    return lengths


@pytest.mark.parametrize("chunk", [100, 5000, 1 << 20])
def test_pack(spark, hard, tokens, chunk):
    docs = [(r.doc_id, r.text) for r in hard.collect()]
    rows = packing.pack(hard.repartition(3), tokens, size=64, chunk=chunk).collect()
    lengths = check_pieces(rows, docs, 64)
    # Every full window holds each source in proportion, within two tokens of what was carried in and out.
    total, queues = sum(lengths.values()), collections.Counter()
    windows = collections.defaultdict(collections.Counter)
    for r in rows:
        queues[r.queue] += r.length
        windows[r.sequence_id][r.queue] += r.length
    for number, n in lengths.items():
        if n == 64:
            for queue, all_ in queues.items():
                assert abs(windows[number][queue] - 64 * all_ / total) < 4


def test_pack_targets(spark, hard, tokens):
    docs = [(r.doc_id, r.text) for r in hard.collect()]
    rows = packing.pack(hard, tokens, size=64, targets={"a": 1, "b": 3, "none": 2}, chunk=2000).collect()
    check_pieces(rows, docs, 64)
    first = collections.Counter()
    for r in rows:
        if r.sequence_id < 10:
            first[r.queue] += r.length
    assert set(first) == {"=a", "=b"} and abs(first["=b"] - 480) < 4


def test_pack_edges(spark, empty, tokens):
    assert packing.pack(empty, tokens).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")
    (r,) = packing.digests(one, tokens).collect()
    assert (r.length, r.doc_tokens, r.sequence_id, r.offset) == (1, 1, 0, 0) and r.ids_crc32 == zlib.crc32(bytes(4))
    (s,) = packing.sequences(packing.pack(one, tokens)).collect()
    assert (s.n_tokens, s.padding, bytes(s.ids)) == (1, 0, bytes(4))
    with pytest.raises(ValueError):
        packing.pack(one, tokens, size=1000)


def test_many_small_queues(spark, tokens):
    rows = [(i, "ab " * (i % 7), f"s{i % 90}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, tokens, size=16, chunk=32).collect()
    check_pieces(got, [r[:2] for r in rows], 16)
    joined = packing.sequences(packing.pack(docs, tokens, size=16, chunk=32), 16).collect()
    assert all(s.padding == 0 and len(s.ids) == 4 * s.n_tokens for s in joined)


def test_encoder():
    with open(JSON, encoding="utf-8") as file, open(RANKS, "rb") as ranks:
        held = packing.Encoder(file.read(), ranks.read(), public_tokenizers.PATTERN)

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(), st.text(alphabet="aé ßX1'²\n\t,.—«\xa0漢カ́ \x85😀s"), st.from_regex(r"\A[ -~\n]{0,80}\Z")))
    def same(text):
        assert held.encode(text).tolist() == encoded(text)

    same()
    for text in ("x" * 3000 + " y", " " * 3000 + "y", "<|endoftext|> a", "one two " * 40):
        assert held.encode(text).tolist() == encoded(text)
    pieces = list(packing._cut("word other " * 100 + "😀", room=50))
    assert "".join(pieces) == "word other " * 100 + "😀" and len(pieces) > 5
    assert [i for p in pieces for i in encoded(p)] == encoded("".join(pieces))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=12), st.integers(1, 64), st.data())
def test_rounds(budget, room, data):
    total = sum(budget)
    rooms = [room] * (total // room) + ([total % room] if total % room else [])
    carried = [data.draw(st.floats(-0.9, 0.9)) for _ in budget]
    left = np.array(budget)
    for (served, take), size in zip(
        packing.rounds(left, np.array(rooms), np.array(budget, float), np.array(carried)), rooms
    ):
        assert take.sum() == size and (take > 0).all()
        left[served] -= take
    assert not left.any()


# Vector codes -----------------------------------------------------------------


def coded(rows, parts, entries, rounds):
    """By the definition, in Python's integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    w = len(whole[0]) // parts
    cut = [[v[p * w : p * w + w] for v in whole] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def assign(p):
        away = [[sum((a - b) ** 2 for a, b in zip(v, e)) for e in books[p]] for v in cut[p]]
        return [(a.index(min(a)), min(a)) for a in away]

    for _ in range(rounds):
        for p in range(parts):
            near = [e for e, _ in assign(p)]
            for e in range(len(books[p])):
                mine = [v for v, n in zip(cut[p], near) if n == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [assign(p) for p in range(parts)]
    codes = ["".join(f"{found[p][i][0]:02x}" for p in range(parts)) for i in range(len(rows))]
    errors = [sum(found[p][i][1] for p in range(parts)) for i in range(len(rows))]
    labels = collections.Counter()
    for r, e in zip(rows, errors):
        labels[r[2]] += e
    return [(r[0], c, e, labels[r[2]]) for r, c, e in zip(rows, codes, errors)], books


SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def vectors(scale, n=400, dim=12, seed=2):
    pick = random.Random(seed)
    near = [[pick.gauss(0, scale) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        v = [float(np.float32(x + pick.gauss(0, scale / 9))) for x in pick.choice(near)]
        rows.append((i if i % 17 else i // 2, v, i % 3 or None))
    rows += [rows[5], rows[5], (None, rows[9][1], 1), (700, None, 1), (701, rows[3][1][:-1] + [None], 2)]
    rows += [(702, rows[3][1][:-1] + [float("nan")], 2), (703, rows[3][1][:-1] + [float("-inf")], None)]
    return rows


@pytest.mark.parametrize("scale", [0.2, 300.0, 1e6, 1e30])
def test_codes(spark, scale):
    rows = vectors(scale, 120 if scale > 1e4 else 400)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    want, books = coded(rows, 4, 16, 2)
    codes, got = vector_codes.compress(docs, parts=4, entries=16, rounds=2)
    assert got == books
    top = vector_codes.LARGEST
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(tuple, codes.collect()), key=key) == sorted(
        ((d, c, min(e, top), min(s, top)) for d, c, e, s in want), key=key
    ) or scale == 1e30 and sorted(r.code for r in codes.collect()) == sorted(r[1] for r in want)


def test_codes_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    codes, books = vector_codes.compress(none)
    assert codes.count() == 0 and books == []
    few = spark.createDataFrame([(3, [0.1] * 16, 1, "x", 1), (1, [-0.1] * 16, None, "x", 1), (9, [1.0], 1, "x", 1)], SCHEMA)
    got = {r.vec_id: r for r in vector_codes.digests(few).collect()}
    assert got[1].code == "00" * 16 and got[3].code == "01" * 16 and got[9].code is None and got[9].error is None
    text = ",".join(["-26,25"] * 16)
    assert got[1].codebooks_sha256 == hashlib.sha256(text.encode()).hexdigest()
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 17, 1, "x", 1)], SCHEMA))


def test_many_labels(spark):
    rows = [(i, "aa", i, str(i // 2)) for i in range(40)] + [(99, "aa", 5, None)]
    codes = spark.createDataFrame([(i, lab, c, e) for i, c, e, lab in rows], vector_codes.CODES)
    few, many = (sorted(map(tuple, vector_codes.label_errors(codes, small).collect()), key=str) for small in (10**5, 1))
    assert few == many and len(few) == 41


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_shortlists(data):
    cells = st.lists(st.lists(st.integers(-30, 30), min_size=3, max_size=3), min_size=1, max_size=20)
    points, book = np.array(data.draw(cells)), np.array(data.draw(cells))
    listed = vector_codes.shortlists(points.min(axis=0)[None], points.max(axis=0)[None], book)[0]
    short = np.flatnonzero(listed)
    best, squares = vector_codes.nearest(points, book)
    found, same = vector_codes.nearest(points, book[short])
    assert (short[found] == best).all() and (same == squares).all()


def test_hilbert():
    """Every cell once, neighbours on the curve are neighbours in space."""
    for d, bits in ((2, 3), (3, 2), (4, 2), (5, 1)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        place = vector_codes.hilbert(grid, bits)
        assert sorted(place) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1)
        assert (steps == 1).all()
