"""A table of vocabulary pieces that numpy can probe for all substrings of many words at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FACTOR = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
FILTER_BITS = 20


def piece_hash(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of the code points in the last axis."""
    h = np.zeros(codes.shape[:-1], dtype=np.uint64)
    for i in range(codes.shape[-1]):
        h = h * FACTOR + codes[..., i].astype(np.uint64) + np.uint64(1)
    return h


class PieceTable:
    """Sorted hashes of the pieces with their ids; a bitmap turns most misses away before the sorted keys are probed."""

    def __init__(self, pieces: list[tuple[str, int]]):
        pairs = [(int(piece_hash(code_points(p)[None, :])[0]), i) for p, i in pieces]
        if len({h for h, _ in pairs}) != len(pairs):
            raise ValueError("two pieces share a hash")
        pairs.sort()
        self.keys = np.array([h for h, _ in pairs], dtype=np.uint64)
        self.ids = np.array([i for _, i in pairs], dtype=np.int32)
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.seen[self.slot(self.keys)] = True

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h * SPREAD) >> np.uint64(64 - FILTER_BITS)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashes, -1 where none."""
        out = np.full(h.shape, -1, dtype=np.int32)
        maybe = self.seen[self.slot(h)]
        if len(self.keys) and maybe.any():
            probed = h[maybe]
            at = np.minimum(np.searchsorted(self.keys, probed), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == probed, self.ids[at], -1)
        return out

    def matches(self, codes: np.ndarray) -> np.ndarray:
        """For words of one length, as an array (words, length): ids by (word, start, piece length - 1)."""
        n, length = codes.shape
        most = min(self.longest, length)
        out = np.full((n, length, most), -1, dtype=np.int32)
        wide = codes.astype(np.uint64) + np.uint64(1)
        h = np.zeros((n, length), dtype=np.uint64)
        for size in range(1, most + 1):
            h = h[:, : length - size + 1] * FACTOR + wide[:, size - 1 :]
            out[:, : length - size + 1, size - 1] = self.find(h)
        return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def by_length(words: np.ndarray, cells: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length together: (their places, their code points); at most `cells` letters, or one word, at once."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    bounds = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, bounds):
        if len(group) and (length := int(lengths[group[0]])):
            step = max(1, cells // length)
            for start in range(0, len(group), step):
                part = group[start : start + step]
                yield part, code_points("".join(words[part])).reshape(len(part), length)
