"""Longest common blocks of text pairs, for the similarity ratio: all pairs of a batch together, in numpy.

A pair is one open range of two texts. As long as a range may have a block of more than `SHORT` characters, its longest is
found by halving, all ranges of a round at once, and the ranges left and right of it stay open. The others are taken apart
length by length, from the longest down: at each length one pass from the left finds all blocks of all ranges, since a
range left of the first such block has none. Places that cannot begin a block of a length are left out before.
Of equally long blocks the first in `actual` counts, then the first in `expected`. A window is known by a rolling hash;
every block found is compared as text, and a pair in which two windows only share their hash is scored by `difflib`.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Characters of one call, of both sides together; a longer pair is taken alone.
SLICE = 1 << 18
#: Characters of the blocks that are found length by length, and lengths at which places that begin none are told first.
SHORT = 64
STEPS = (4, 6, 8, 12, 16, 24, 32, 48, SHORT)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Hashes:
    """Rolling hashes modulo 2 ** 64 of windows of a text: sums of codes by inverse powers, scaled to the window's place."""

    def __init__(self, codes: np.ndarray):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * ODD
        mixed ^= mixed >> np.uint64(29)
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * ODD * _powers(len(codes), inverse), dtype=np.uint64)])
        self.scale = _powers(len(codes) + 1, ODD)

    def windows(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.scale[at]


def _places(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places in the ranges at which a window of the range's `size` fits, and the range of each."""
    n = np.maximum(high - low - size + 1, 0)
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - n), n), owner


def _maybe(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which keys may be among the others: all that are, and a few that are not."""
    shift = np.uint64(64 - min(24, max(16, len(others).bit_length() + 3)))
    seen = np.zeros(1 << 64 - int(shift), bool)
    seen[((others * ODD) >> shift).view(np.int64)] = True
    return seen[((keys * ODD) >> shift).view(np.int64)]


class _Ranges:
    """Open ranges [alo, ahi) x [blo, bhi) of the two concatenated texts; keys carry the range, the hash and the side."""

    def __init__(self, a: _Hashes, b: _Hashes, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray):
        self.a, self.b, self.alo, self.ahi, self.blo, self.bhi = a, b, alo, ahi, blo, bhi
        self.bits = np.uint64(max(1, int(len(alo) - 1).bit_length()))

    def key(self, hashes: _Hashes, at: np.ndarray, size: np.ndarray | int, owner: np.ndarray) -> np.ndarray:
        hashed = hashes.windows(at, size) >> (self.bits + np.uint64(1)) << np.uint64(1)
        return owner.astype(np.uint64) << (np.uint64(64) - self.bits) | hashed

    def keys(self, hashes: _Hashes, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        at, owner = _places(low, high, size)
        return at, owner, self.key(hashes, at, size[owner], owner)

    def shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sorted keys that both sides have."""
        left = left[_maybe(left, right)]
        both = np.sort(np.concatenate([left, right[_maybe(right, left)] | np.uint64(1)]))
        return both[:-1][(both[1:] ^ both[:-1]) == 1]

    def longest(self, most: np.ndarray) -> np.ndarray:
        """The length of the longest block of each range, 0 if it has none of more than `SHORT` characters."""
        low, high = np.zeros(len(self.alo), np.int64), np.where(most > SHORT, most, 0)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            tried = np.where(low == 0, SHORT + 1, (low + high + 1) // 2)
            middle = np.where(open_, tried, len(self.a.sums) + len(self.b.sums))
            left = self.keys(self.a, self.alo, self.ahi, middle)[2]
            right = self.keys(self.b, self.blo, self.bhi, middle)[2]
            met = np.zeros(len(low), bool)
            met[(self.shared(left, right) >> (np.uint64(64) - self.bits)).astype(np.int64)] = True
            high = np.where(open_ & ~met, np.where(low == 0, 0, middle - 1), high)
            low = np.where(open_ & met, middle, low)

    def first(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first block of each range's `size` (1 at least) begins on both sides."""
        at, owner, left = self.keys(self.a, self.alo, self.ahi, size)
        bt, b_owner, right = self.keys(self.b, self.blo, self.bhi, size)
        common = self.shared(left, right)
        hit = np.flatnonzero(common[np.minimum(np.searchsorted(common, left), len(common) - 1)] == left)
        ranges, first = np.unique(owner[hit], return_index=True)
        chosen = left[hit[first]]
        same = np.flatnonzero(right == chosen[b_owner])
        assert len(ranges) == len(size)
        return at[hit[first]], bt[same[np.unique(b_owner[same], return_index=True)[1]]]

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place of both texts how long a block can be that begins there, `SHORT` at most: never too low."""
        out = [np.zeros(len(h.sums) - 1, np.uint8) for h in (self.a, self.b)]
        one = np.ones(len(self.alo), np.int64)
        (at, owner), (bt, b_owner) = _places(self.alo, self.ahi, one), _places(self.blo, self.bhi, one)
        for size, after in zip((1, *STEPS), (*STEPS, SHORT + 1), strict=True):
            if size > 1:
                fits, b_fits = at + size <= self.ahi[owner], bt + size <= self.bhi[b_owner]
                at, owner, bt, b_owner = at[fits], owner[fits], bt[b_fits], b_owner[b_fits]
                left, right = self.key(self.a, at, size, owner), self.key(self.b, bt, size, b_owner)
                met = _maybe(left, right)
                b_met = _maybe(right, left[met])
                at, owner, bt, b_owner = at[met], owner[met], bt[b_met], b_owner[b_met]
            out[0][at] = out[1][bt] = after - 1
        return out[0], out[1]

    def blocks(self, size: int, a_most: np.ndarray, b_most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where blocks of `size` begin on both sides, if no range has a longer one: the first of each range, then the
        first of what is right of it, and so on. Ranges stand in the order of the texts."""
        sides = []
        for hashes, most, low, high in ((self.a, a_most, self.alo, self.ahi), (self.b, b_most, self.blo, self.bhi)):
            at = np.flatnonzero(most >= size)
            owner = np.searchsorted(low, at, "right") - 1
            end = np.where(owner < 0, 0, high[owner])
            most[at[at >= end]] = 0  # in no open range any more
            fits = at + size <= end
            at, owner = at[fits], owner[fits]
            sides.append((at, self.key(hashes, at, size, owner)))
        (at, left), (bt, right) = sides
        met = _maybe(left, right)
        at, left = at[met], left[met]
        met = _maybe(right, left)
        bt, right = bt[met], right[met]
        common = self.shared(left, right)
        if not len(common):
            return common.astype(np.int64), common.astype(np.int64)
        group, b_group = (np.minimum(np.searchsorted(common, keys), len(common) - 1) for keys in (left, right))
        met, b_met = common[group] == left, common[b_group] == right
        at, group, bt, b_group = at[met], group[met], bt[b_met], b_group[b_met]
        order = np.argsort(b_group, kind="stable")
        begins = np.searchsorted(b_group[order], np.arange(len(common) + 1)).tolist()
        places, found, a_free, b_free = bt[order].tolist(), [], 0, 0
        for i, g in zip(at.tolist(), group.tolist(), strict=True):
            low, high = begins[g], begins[g + 1]
            if i < a_free or places[high - 1] < b_free:
                continue
            j = places[low] if places[low] >= b_free else places[bisect_left(places, b_free, low, high)]
            found.append((i, j))
            a_free, b_free = i + size, j + size
        i, j = np.array(found, np.int64).T
        return i, j


def matched(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Characters in common blocks of each pair (actual, expected), as the recursive longest-block rule counts them."""
    total = np.zeros(len(pairs), np.int64)
    a_codes, b_codes = _codes([a for a, _ in pairs]), _codes([b for _, b in pairs])
    a, b = _Hashes(a_codes), _Hashes(b_codes)
    ahi, bhi = np.cumsum([len(x) for x, _ in pairs]), np.cumsum([len(y) for _, y in pairs])
    alo, blo = np.append(0, ahi[:-1]), np.append(0, bhi[:-1])
    begins, most = alo, np.minimum(ahi - alo, bhi - blo)
    collided = np.zeros(len(pairs), bool)

    def count(i: np.ndarray, j: np.ndarray, size: np.ndarray) -> None:
        owner = np.searchsorted(begins, i, "right") - 1
        within = _places(np.zeros_like(size), size, np.ones_like(size))
        differs = a_codes[i[within[1]] + within[0]] != b_codes[j[within[1]] + within[0]]
        collided[owner[within[1][differs]]] = True
        np.add.at(total, owner, size)

    some = most > 0
    alo, ahi, blo, bhi, most = (x[some] for x in (alo, ahi, blo, bhi, most))
    short = []
    while len(alo):
        size = _Ranges(a, b, alo, ahi, blo, bhi).longest(most)
        short.append([x[size == 0] for x in (alo, ahi, blo, bhi)])
        some = size > 0
        alo, ahi, blo, bhi, size = (x[some] for x in (alo, ahi, blo, bhi, size))
        if not len(alo):
            break
        i, j = _Ranges(a, b, alo, ahi, blo, bhi).first(size)
        count(i, j, size)
        alo, ahi = np.concatenate([alo, i + size]), np.concatenate([i, ahi])
        blo, bhi = np.concatenate([blo, j + size]), np.concatenate([j, bhi])
        most = np.minimum(np.tile(size, 2), np.minimum(ahi - alo, bhi - blo))
        open_ = (most > 0) & ~collided[np.searchsorted(begins, alo, "right") - 1]
        alo, ahi, blo, bhi, most = (x[open_] for x in (alo, ahi, blo, bhi, most))
    if short:
        alo, ahi, blo, bhi = (np.sort(np.concatenate(x)) for x in zip(*short, strict=True))
    bounds = _Ranges(a, b, alo, ahi, blo, bhi).bounds()
    for length in range(max((int(x.max(initial=0)) for x in bounds)), 0, -1):
        if not len(alo):
            break
        i, j = _Ranges(a, b, alo, ahi, blo, bhi).blocks(length, *bounds)
        if not len(i):
            continue
        count(i, j, np.full(len(i), length))
        # Ranges stand in one order in both texts, so that sorted begins and ends still belong together.
        alo, ahi = np.sort(np.concatenate([alo, i + length])), np.sort(np.concatenate([ahi, i]))
        blo, bhi = np.sort(np.concatenate([blo, j + length])), np.sort(np.concatenate([bhi, j]))
        open_ = (alo < ahi) & (blo < bhi)
        alo, ahi, blo, bhi = (x[open_] for x in (alo, ahi, blo, bhi))
    for k in np.flatnonzero(collided):
        total[k] = sum(m.size for m in difflib.SequenceMatcher(None, *pairs[k], autojunk=False).get_matching_blocks())
    return total


def ratios(actual: list[str | None], expected: list[str | None]) -> list[float | None]:
    """Twice the matched characters over all characters; 1 if both are empty, null if either text is null."""
    out: list[float | None] = [None] * len(actual)
    hard: list[int] = []
    first: dict[tuple[str | None, str | None], int] = {}
    again = [first.setdefault(pair, k) for k, pair in enumerate(zip(actual, expected, strict=True))]
    for k, (a, b) in enumerate(zip(actual, expected, strict=True)):
        if again[k] != k:
            continue  # the same pair stands before
        if a is None or b is None:
            continue
        if a == b or not a or not b:
            out[k] = float(a == b)
        elif a in b or b in a:
            # The shorter text as a whole is the longest block.
            out[k] = 2 * min(len(a), len(b)) / (len(a) + len(b))
        else:
            hard.append(k)
    while hard:
        part, size = [], 0
        while hard and (not part or size < SLICE):
            part.append(hard.pop())
            size += len(actual[part[-1]]) + len(expected[part[-1]])
        for k, m in zip(part, matched([(actual[k], expected[k]) for k in part]).tolist(), strict=True):
            out[k] = 2.0 * m / (len(actual[k]) + len(expected[k]))
    return [out[k] for k in again]
