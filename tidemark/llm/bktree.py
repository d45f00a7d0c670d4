"""Shingle hashes, SimHash fingerprints and BK-trees."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
#: Byte to eight one-byte counters, one for each bit.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()



def shingles(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of the text's shingles in their order, repeats included; a shorter text is one shingle, a blank one has none."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    n, joined, digest = len(parts), b" ".join(parts), xxhash.xxh64_intdigest
    if n < words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - words] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash: bit i is 1 if it is set in over half of the hashes; 0 without any."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 255 * 256):
        lanes = _LANES[hashes[at : at + 255 * 256].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        counts += sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int) -> int:
    return majority(shingles(text, words))


class BKTree:
    """Integers under Hamming distance; children keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> int:
        """Place the value; returns its index."""
        values, children, at = self.values, self.children, 0
        if values:
            while True:
                d = (values[at] ^ value).bit_count()
                below = children[at].get(d)
                if below is None:
                    children[at][d] = len(values)
                    break
                at = below
        values.append(value)
        children.append({})
        return len(values) - 1

    def search(self, value: int, radius: int) -> list[int]:
        """Indexes of all values within the radius."""
        values, children, found = self.values, self.children, []
        stack = [0] if values else []
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            low, high = d - radius, d + radius
            stack += [c for e, c in children[at].items() if low <= e <= high]
        return found
