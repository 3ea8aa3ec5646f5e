"""Exact and near duplicates, and repeated strings, against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dumpdeck.llm import bwt, components, exact_dedup, minhash, repeats
from tests.llm.conftest import prose

SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def lower(text):
    return text.encode().lower().decode()


def test_exact_groups(hard):
    groups = collections.defaultdict(list)
    for doc, text in texts(hard):
        groups[text.translate(SPACE)].append((-len(text), doc is None, doc or 0, doc))
    want = collections.Counter()
    for norm, members in groups.items():
        members.sort()
        for n, m in enumerate(members):
            digest = hashlib.sha256(norm.encode()).hexdigest()
            want[m[3], members[0][3], len(members), n == 0, digest] += 1
    got = collections.Counter(tuple(r) for r in exact_dedup.exact_groups(hard, digest_all=True).collect())
    assert got == want
    lazy = exact_dedup.exact_groups(hard).drop("text_sha256")
    assert collections.Counter(map(tuple, lazy.collect())) == collections.Counter(
        {k[:4]: sum(v for x, v in want.items() if x[:4] == k[:4]) for k in want}
    )
    kept = exact_dedup.drop_copies(hard)
    assert kept.columns == hard.columns and kept.count() == len(groups)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(m[0][3]) for m in groups.values())


def test_copies_of_one_id_with_equal_starts(spark):
    """Rows of one id whose texts differ after the prefix only, with copies of one of them and repeated rows."""
    head = "a" * 300
    rows = [(1, head + "x"), (1, head + "y"), (2, head + "y"), (0, head + "x"), (3, head + "z"), (3, head + "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id, r.text[-1]) for r in exact_dedup.drop_copies(df).collect())
    assert kept == [(0, "x"), (1, "y"), (3, "z")]


def shingles(text, k):
    w = [x for x in lower(text).replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(rows, k):
    sets = {d: shingles(t, k) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_groups(hard):
    rows = texts(hard)
    got = minhash.near_groups(hard, words=4).collect()
    assert len(got) == len(rows)
    want = near(rows, 4)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = minhash.drop_near_copies(hard)
    assert kept.columns == hard.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {d for d, (_, c) in near(rows, 5).items() if d == c}


def test_near_groups_without_a_centre(spark):
    """A large bucket of texts that aren't all linked: chains, and strangers with a shared passage."""
    pick = random.Random(9)
    rows, now = [], prose(pick, 100).split()
    for i in range(60):  # each is like the one before, the first isn't like the last
        rows.append((i * 7 % 60, " ".join(now)))
        now = list(now)
        now[i * 3 % 100] = f"new{i}"
    passage = prose(pick, 60)
    rows += [(100 + i, passage + " " + prose(pick, 60)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(df, words=4).collect()}
    assert got == near(rows, 4)


def test_tiles_find_pairs_across(spark):
    pick = np.random.Generator(np.random.PCG64(1))
    sig = pick.integers(0, 3, (40, 8), dtype=np.uint32)
    rows, want = [], []
    for a in range(40):
        for band in range(4):
            bucket = band * 100 + int(sig[a, 2 * band]) * 10 + int(sig[a, 2 * band + 1])
            rows.append((bucket, band, a, a // 4, 80 + a, bytes(sig[a].tobytes())))
        for b in range(a):
            agree = any((sig[a] == sig[b])[2 * n : 2 * n + 2].all() for n in range(4))
            if agree and a // 4 != b // 4 and (sig[a] == sig[b]).sum() >= 4 and 80 * (80 + a) <= 100 * (80 + b):
                want.append((a, b))
    df = spark.createDataFrame(rows, "bucket long, band int, rep long, component long, size long, signature binary")
    dealt = minhash.tiled(df.drop("signature"), tile=3).join(df.select("rep", "signature").distinct(), "rep")
    got = minhash.across(dealt, 4, rows=2).collect()
    pairs = {(r.a, r.b) for r in got if r.a is not None}
    open_ = {(r.bucket, r.i, r.j) for r in got if r.a is None}
    held = collections.defaultdict(set)
    for r in dealt.collect():
        held[r.bucket, r.i, r.j].add(r.rep)
    rest = {p for p in want if any(set(p) <= held[k] for k in open_)}
    assert pairs <= set(want) <= pairs | rest


def test_rows_out_of_a_bucket_stay_linear(spark):
    """Texts that are all alike, none of them linked: candidates and links grow with the texts."""
    pick = random.Random(4)
    base, rows = prose(pick, 300).split(), []
    for i in range(240):
        own = list(base)
        for at in pick.sample(range(300), 14):
            own[at] = f"w{i}x{at}"
        rows.append((i, " ".join(own)))
    for i in range(0, 240, 20):  # and a few that are
        rows.append((1000 + i, rows[i][1] + " tail"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}

    def tap(name):
        fn = getattr(minhash, name)

        def run(*args, **how):
            out = minhash.cut(fn(*args, **how))
            seen[name] = max(seen.get(name, 0), out.count())
            return out

        return run

    with pytest.MonkeyPatch.context() as patch:
        for name in ("across", "joined_in_tiles"):
            patch.setattr(minhash, name, tap(name))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(df, words=4).collect()}
    assert got == near(rows, 4)
    assert seen["across"] <= 2 * 28 * len(rows) and seen["joined_in_tiles"] <= 28 * len(rows)


@pytest.mark.parametrize("turn", [1, -1])
def test_one_id_with_two_texts(spark, turn):
    """A link of any text of an id is a link of the id, in any order of rows."""
    pick = random.Random(6)
    first, second = prose(pick, 90), prose(pick, 90)
    rows = [(5, first), (5, second), (9, first + " tail"), (11, second + " tail"), (12, prose(pick, 90))][::turn]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in minhash.near_groups(df, words=4).collect()}
    assert got == {5: 5, 9: 5, 11: 5, 12: 12}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (7, 3), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20, 25: 20}
    assert components.components(df.filter("false")).count() == 0


def removed(rows, length):
    times = collections.Counter()
    for _, t in rows:
        b = t.encode()
        times.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = collections.Counter()
    for d, t in rows:
        b, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("how", [{}, {"many": 0}, {"bundle": 300}])
def test_repeats(hard, how):
    rows = texts(hard)
    got = collections.Counter(tuple(r) for r in repeats.digests(hard, length=40, gram=12, **how).collect())
    assert got == removed(rows, 40)


def test_repeats_at_full_length(hard):
    assert collections.Counter(map(tuple, repeats.digests(hard).collect())) == removed(texts(hard), 400)


def test_merged_transforms():
    pick = random.Random(3)
    for _ in range(150):
        length = pick.choice([3, 5, 8, 13, 17, 40])
        base = bytes(pick.choice(b"abc") for _ in range(80))
        segments = []
        for _ in range(pick.randint(1, 9)):
            at = pick.randint(0, 60)
            text = base[at : at + pick.randint(1, 70)] + bytes(pick.choice(b"abcd") for _ in range(pick.randint(0, 10)))
            if len(text) >= length:
                segments.append((text, len(text) - length + 1))
        times = collections.Counter(t[i : i + length] for t, n in segments for i in range(n))
        for (t, n), found in zip(segments, bwt.repeated_windows(segments, length)):
            assert found.tolist() == [times[t[i : i + length]] > 1 for i in range(n)]


def test_empty_tables(empty):
    assert exact_dedup.exact_groups(empty, digest_all=True).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    assert minhash.near_groups(empty).count() == 0
    assert minhash.drop_near_copies(empty).count() == 0
    assert repeats.digests(empty).count() == 0


def test_hot_group(spark):
    """A third of all rows are one text, and a third are near copies of another."""
    pick = random.Random(2)
    hot, base = prose(pick, 80), prose(pick, 80).split()
    rows = [(i, hot) for i in range(0, 600, 3)]
    for i in range(1, 600, 3):
        own = list(base)
        own[pick.randrange(80)] = f"v{i}"
        rows.append((i, " ".join(own)))
    rows += [(i, prose(pick, 40)) for i in range(2, 600, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_groups(df, words=4).filter(F.col("kept")).count()
    assert got == 1 + len({c for d, (_, c) in near([r for r in rows if r[0] % 3], 4).items()})


def test_links_that_no_leader_has(spark):
    """In a bucket led by a stranger, two texts that are like each other only are still linked."""
    pick = random.Random(21)
    rows = []
    for f in range(30):
        body = prose(pick, 120).split()
        stranger = body[:80] + prose(pick, 60).split()
        other = list(body)
        other[-1] = "other"
        rows += [(10 * f, " ".join(stranger)), (10 * f + 1, " ".join(body)), (10 * f + 2, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_groups(df, words=4, bands=1, rows=1).collect()}
    assert all(got[10 * f] == 10 * f and got[10 * f + 1] == 10 * f + 1 for f in range(30))
    linked = sum(got[10 * f + 2] == 10 * f + 1 for f in range(30))
    assert linked >= 25 and all(got[10 * f + 2] in (10 * f + 1, 10 * f + 2) for f in range(30))
