"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement, in numpy.

Symbols are grams of ``g`` bytes, so that the transform of a shard holds for each suffix, in sorted order, the
gram before it, and one step of refinement compares g bytes. A shard's suffixes are sorted once, by
themselves. The merge only reads the transforms: an interleave of all suffixes by their first k bytes,
sorted stably by the grams before them and mapped by each shard's LF function, is the interleave of the
suffixes g bytes earlier by their first k + g bytes. Borders between blocks of equal prefixes are kept on the
way: they are the common prefixes. Blocks of one suffix are left out, since what precedes a unique string is unique.
"""

from __future__ import annotations

import numpy as np

WIDE = 1 << 16


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    values, rank = np.unique(keys, return_inverse=True)
    return rank.reshape(-1), len(values)


def grams(texts: list[np.ndarray], length: int) -> tuple[int, list[np.ndarray]]:
    """The longest gram of 1, 2, 3, 4, 6 or 8 bytes with at most 65,536 values in circular texts; ranks in order."""
    cuts = np.cumsum([len(t) for t in texts])[:-1]

    def shifted(parts: list[np.ndarray], by: int) -> np.ndarray:
        return np.concatenate([np.roll(p, -by) for p in parts]).astype(np.int64)

    best, kept = 1, {1: [t.astype(np.int64) for t in texts]}
    for size, a, b in ((2, 1, 1), (4, 2, 2), (3, 2, 1), (8, 4, 4), (6, 4, 2)):
        if a not in kept or b not in kept or size > length or (size == 3 and 4 in kept) or (size == 6 and 8 in kept):
            continue
        rank, n = _dense(np.concatenate(kept[a]) << 32 | shifted(kept[b], a))
        if n <= WIDE:
            kept[size] = np.split(rank, cuts)
            best = max(best, size)
    return best, kept[best]


def suffix_order(rank: np.ndarray, g: int, length: int) -> np.ndarray:
    """Suffixes of a circular text sorted by their first ``length`` bytes or more, from ranks of its grams."""
    h = g
    rank = rank.astype(np.int64)
    while h < length:
        rank, n = _dense(rank << 32 | np.roll(rank, -h))
        h *= 2
        if n == len(rank):
            break
    return np.argsort(rank, kind="stable")


class Shard:
    """A circular text's suffix order, its transform in grams, and the map to the suffix a gram earlier."""

    def __init__(self, text: np.ndarray, rank: np.ndarray, g: int, length: int):
        self.order = suffix_order(rank, g, length)
        self.transform = rank[(self.order - g) % len(text)].astype(np.uint16)
        row = np.empty(len(text), np.int64)
        row[self.order] = np.arange(len(text))
        # Not by sorting the transform: suffixes equal in the bytes compared could swap places.
        self.earlier = row[(self.order - g) % len(text)]


def repeated_blocks(
    texts: list[np.ndarray], wanted: list[np.ndarray], length: int
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per text, wanted starts of suffixes whose first ``length`` bytes begin at another wanted start too, with the
    number of their block.

    Texts are circular here. Each step moves a suffix g bytes back, so a suffix is followed only if it ends at a
    wanted start; the others could part no block of wanted ones.
    """
    if not sum(map(len, texts)):
        return [], []
    g, ranks = grams(texts, length)
    shards = [Shard(t, r, g, length) for t, r in zip(texts, ranks, strict=True)]
    base = np.cumsum([0] + [len(t) for t in texts])
    transform = np.concatenate([s.transform for s in shards])
    earlier = np.concatenate([s.earlier + b for s, b in zip(shards, base[:-1], strict=True)])
    # The interleave by the first bytes, as many as steps of g bytes leave over.
    steps, rest = divmod(length, g)
    start = np.zeros(len(transform), np.int64)
    for i in range(rest):
        start = start << 8 | np.concatenate([t[(s.order + i) % len(t)] for t, s in zip(texts, shards, strict=True)])
    ends = [w[(s.order - steps * g) % len(w)] for w, s in zip(wanted, shards, strict=True)]
    merged = np.flatnonzero(np.concatenate(ends))
    merged = merged[np.argsort(start[merged], kind="stable")]
    start = start[merged]
    block = np.concatenate([[0], np.cumsum(start[1:] != start[:-1])]).astype(np.int32)
    for _ in range(steps):
        symbol = transform[merged]
        order = np.argsort(symbol, kind="stable")
        symbol, block = symbol[order], block[order]
        border = np.ones(len(order) + 1, bool)
        border[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        merged = earlier[merged[order]]
        alone = border[1:] & border[:-1]
        block = np.cumsum(border[:-1], dtype=np.int32)
        if alone.any():
            merged, block = merged[~alone], block[~alone]
        if not len(merged):
            break
    positions = np.concatenate([s.order for s in shards])
    which = np.searchsorted(base, merged, side="right") - 1
    starts = positions[merged]
    return (
        [starts[which == i] for i in range(len(texts))],
        [block[which == i] for i in range(len(texts))],
    )


def repeated_windows(segments: list[tuple[bytes, int]], length: int, shards: int = 4) -> list[np.ndarray]:
    """Per segment (its bytes, and how many windows of ``length`` bytes it holds), which windows occur in another place."""
    counts = np.array([n for _, n in segments], np.int64)
    base = np.concatenate([[0], np.cumsum(counts)])  # windows of all segments, one after the other
    groups = [np.arange(i, len(segments), shards) for i in range(min(shards, len(segments)))]
    texts, wanted, origins = [], [], []
    for group in groups:
        texts.append(np.frombuffer(b"".join(segments[i][0] for i in group), np.uint8))
        sizes = np.array([len(segments[i][0]) for i in group])
        origins.append(np.concatenate([[0], np.cumsum(sizes)]))
        at = np.arange(len(texts[-1])) - np.repeat(origins[-1][:-1], sizes)
        wanted.append(at < np.repeat(counts[group], sizes))
    found = np.zeros(base[-1], bool)
    starts, blocks = repeated_blocks(texts, wanted, length)
    for group, origin, start in zip(groups, origins, starts):
        nth = np.searchsorted(origin, start, side="right") - 1
        found[base[group[nth]] + start - origin[nth]] = True
    return np.split(found, base[1:-1])
