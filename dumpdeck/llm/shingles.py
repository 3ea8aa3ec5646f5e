"""Word shingles of many texts at once, as sorted sets of 64-bit hashes, in numpy.

Texts are joined into one array of bytes. Hashes of words are differences of prefix sums of a polynomial
in an odd random base modulo 2**64, shifted to a common power and mixed; a shingle's hash combines those of
its words in order. Two different shingles share a hash with a probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
ROOM = 4_000_000
SPACES = (9, 10, 11, 12, 13, 32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, ROOM + 1)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


def prefix_sums(data: np.ndarray, powers: Powers) -> np.ndarray:
    """sums[i]: the polynomial of the first i bytes."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def words(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and their hashes."""
    white = np.zeros(256, bool)
    white[list(SPACES)] = True
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~white[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    sums = prefix_sums(data, powers)
    _, down = powers(len(data) + 1)
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def together(texts: list[str | None], room: int = ROOM) -> Iterator[list[bytes]]:
    """The texts in order, lower-cased (A-Z), in runs of about ``room`` bytes; longer texts alone."""
    held, size = [], 0
    for text in texts:
        data = (text or "").encode().lower()
        if held and size + len(data) > room:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield held


def shingle_sets(texts: list[str | None], k: int, powers: Powers) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; of all its words if it has fewer."""
    factors = [np.uint64(pow(BASE, 3 + 2 * i, 1 << 64)) for i in range(k)]
    for run in together(texts):
        data = np.frombuffer(b"\n".join(run), np.uint8)
        begins = np.cumsum([0] + [len(t) + 1 for t in run])
        starts, hashes = words(data, powers)
        first = np.searchsorted(starts, begins)
        if len(hashes) >= k:
            joined = np.zeros(len(hashes) - k + 1, np.uint64)
            for i, factor in enumerate(factors):
                joined += hashes[i : len(hashes) - k + 1 + i] * factor
            joined = mix(joined)
        for d in range(len(run)):
            low, high = first[d], first[d + 1]
            if high - low >= k:
                yield np.unique(joined[low : high - k + 1])
            elif high > low:
                n = int(high - low)
                short = np.add.reduce(hashes[low:high] * np.array(factors[:n])) + np.uint64(n)
                yield mix(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
