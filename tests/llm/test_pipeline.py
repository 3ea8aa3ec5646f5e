"""The whole pipeline against a plain Python version of its stages."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import tiktoken
import tiktoken.load
import xxhash

import corpus_pipeline
from dumpdeck.llm import mixing, quality
from tests.llm.conftest import prose

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPLIT.split(text or "") if w]


def documents():
    """Clean texts, symbol junk, short and repetitive texts, copies with other white space, near copies."""
    pick = random.Random(11)
    rows = []
    for i in range(150):
        text = prose(pick, 60 + i % 50)
        rows.append((i, text + ("." if i % 4 else "!"), "en" if i % 5 else "de", ["a", "a", "b", None][i % 4]))
    for i in range(150, 165):
        rows.append((i, " ".join(w + "#$%"[i % 3] * 4 for w in prose(pick, 80).split()), "en", "a"))
    rows += [(170, prose(pick, 20), "en", "a"), (171, "again and again " * 40, "en", "b"), (172, None, None, None), (173, "", "en", "b")]
    for i in range(180, 200):
        rows.append((i, rows[i - 180][1].replace(" ", "  " if i % 2 else "\n"), rows[i - 180][2], rows[i - 180][3]))
    for i in range(200, 220):
        near = rows[i - 170][1].split(" ")
        near[3] = "changed"
        rows.append((i, " ".join(near).upper() if i % 2 else " ".join(near), rows[i - 170][2], "b"))
    rows.append(rows[40])
    return rows


def features(text):
    w = words(text)
    places = collections.defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    repeated = {i + j for found in places.values() if len(found) > 1 for i in found for j in range(3)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    n = len(w) + 20
    vector = [3 * math.log((sum(map(len, w)) + 100.0) / n)]
    for pattern in (r"[#*$%&|<>]", r"[!-/:-@\[-`{-~]", r"[A-Z]"):
        vector.append(math.log1p(10 * len(re.findall(pattern, text or "")) / n))
    vector.append(math.log1p(10 * (len(lines) - len(set(lines))) / (len(lines) + 5)))
    vector.append(math.log1p(10 * len(repeated) / n))
    return len(w) < 50 or 100 * len(repeated) > 50 * len(w), vector


def at_share(values, share):
    return np.sort(values)[max(0, math.ceil(share * len(values)) - 1)]


def good(rows):
    """Rows within the cutoff of the minimum covariance determinant estimate of their language and source."""
    judged = [(r, *features(r[1])) for r in rows]
    groups = collections.defaultdict(list)
    for r, failed, vector in judged:
        if not failed:
            groups[r[2], r[3]].append((r, vector))
    x = {g: np.array([v for _, v in found]) for g, found in groups.items()}
    scale = quality._consistency(quality.CORE)

    def nearest(distances):
        return {g: x[g][d <= at_share(d, quality.CORE)] for g, d in distances.items()}

    def estimated(near):
        pool = np.concatenate(list(near.values()))
        mean, out = pool.mean(0), {}
        pooled = pool.T @ pool / len(pool) - np.outer(mean, mean)
        for g, v in near.items():
            total, k = v.sum(0), len(v)
            own = v.T @ v - np.outer(total, total) / k
            cov = scale * (own + quality.PRIOR * pooled) / (k + quality.PRIOR) + quality.FLOOR**2 * np.eye(quality.P)
            left = x[g] - (total + 5 * mean) / (k + 5)
            out[g] = (left @ np.linalg.inv(cov) * left).sum(1)
        return out

    start = {}
    for g, v in x.items():
        low, middle, high = (np.array([at_share(c, p) for c in v.T]) for p in (0.25, 0.5, 0.75))
        start[g] = (((v - middle) / np.maximum((high - low) / 1.349, quality.FLOOR)) ** 2).sum(1)
    near = nearest(start)
    for _ in range(quality.STEPS):
        near = nearest(estimated(near))
    distances = estimated(near)
    return [r for g, found in groups.items() for (r, _), d in zip(found, distances[g]) if d <= quality.CUTOFF]


def without_copies(rows):
    best = {}
    for r in rows:
        key = SPLIT.sub("", r[1])
        best[key] = min(best.get(key, r), r, key=lambda x: (-len(x[1]), x[0]))
    return list(best.values())


def without_near_copies(rows):
    sets = []
    for r in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for r, g in zip(rows, group):
        least[g] = min(least.get(g, r), r)
    return list(least.values())


def shuffled(doc_id, size):
    h = xxhash.xxh64_intdigest(mixing.SEED.to_bytes(4, "little"), 42)
    for v in (doc_id, size):
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), h)
    return h - (h >> 63 << 64), doc_id


def mixed(rows):
    """How often each row is taken: streams of shuffled documents, cut at the targets."""
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    sources = sorted(by_source, key=lambda s: (s is None, s))
    size = {s: sum(len(words(r[1])) for r in by_source[s]) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    left, target, budget = set(sources), {}, mixing.SHARE * sum(size.values())
    while left:
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if 2 * size[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in left}
            break
        target |= {s: 2 * size[s] for s in full}
        budget -= sum(2 * size[s] for s in full)
        left -= full
    out = []
    for s in sources:
        at = 0
        for r in 2 * sorted(by_source[s], key=lambda r: shuffled(r[0], len(words(r[1])))):
            n = len(words(r[1]))
            if 2 * (min(at + n, int(target[s])) - at) >= n:
                out.append(r)
            at += n
    return out


def test_run_against_plain_python(spark, tmp_path):
    rows = documents()
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept = good(rows)
    assert not {r[0] for r in kept} & {*range(150, 165), 170, 171, 172, 173} and len(kept) > 180
    single = without_copies(kept)
    apart = without_near_copies(single)
    assert len(kept) > len(single) > len(apart) > 140
    ranks = tiktoken.load.load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    codec = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expect = collections.Counter()
    for doc_id, text, lang, source in mixed(apart):
        ids = codec.encode_ordinary(text)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expect[doc_id, lang, source, tuple(ids), len(ids), digest, hashlib.sha256(text.encode()).hexdigest()] += 1
    got = collections.Counter(
        (r.doc_id, r.lang, r.source, tuple(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256)
        for r in corpus_pipeline.run(spark, str(tmp_path)).collect()
    )
    assert got == expect
