"""Two-stage suffix sorting of many short byte strings at once, and their repeated starts."""

from __future__ import annotations

import numpy as np

#: Symbols of 9 bits, so that byte 0 differs from the end of a string; seven to a key.
BITS, STEP = 9, 7


def joined(strings: list[bytes]) -> np.ndarray:
    """The strings as symbols 1 to 256, each followed by the separator 0, after one leading separator."""
    data = np.frombuffer(b"\0" + b"\0".join(strings) + b"\0", dtype=np.uint8).astype(np.int16) + 1
    data[0] = 0
    data[np.cumsum([len(s) + 1 for s in strings])] = 0
    return data


def keys_of(symbols: np.ndarray) -> np.ndarray:
    """At each position the next seven symbols as one number."""
    padded = np.concatenate([symbols, np.zeros(STEP, dtype=symbols.dtype)]).astype(np.int64)
    key = np.zeros(len(symbols), dtype=np.int64)
    for k in range(STEP):
        key = (key << BITS) | padded[k : k + len(symbols)]
    return key


def left_of(symbols: np.ndarray) -> np.ndarray:
    """How many symbols stand before the next separator."""
    ends = np.flatnonzero(symbols == 0).astype(np.int32)
    return np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(symbols), dtype=np.int32)


def smaller_than_next(symbols: np.ndarray) -> np.ndarray:
    """Is the suffix smaller than its successor? Equal symbols follow the end of their run."""
    change = np.flatnonzero(symbols[1:] != symbols[:-1])
    rises = np.append(symbols[change + 1] > symbols[change], False)
    return np.repeat(rises, np.diff(np.append(change, len(symbols) - 1), prepend=-1))


def sorted_directly(at: np.ndarray, keys: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their first `depth` symbols; only those still tied are looked at again."""
    at = at[np.argsort(keys[at], kind="stable")]
    place = np.arange(len(at))
    value = keys[at]
    group = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]])) if len(at) else place
    out = at.copy()
    seen = STEP
    while len(place) and seen < depth:
        size = np.bincount(group, minlength=int(group[-1]) + 1)
        tied = (size[group] > 1) & (left[out[place]] >= seen)
        place, group = place[tied], group[tied]
        if not len(place):
            break
        own = out[place]
        value = keys[np.minimum(own + seen, len(keys) - 1)]
        # Groups that go on alike, as long repeats do, need no sort in this round.
        uneven = np.zeros(int(group[-1]) + 1, dtype=bool)
        uneven[group[1:][(value[1:] != value[:-1]) & (group[1:] == group[:-1])]] = True
        some = np.flatnonzero(uneven[group])
        if len(some):
            order = some[np.lexsort((value[some], group[some]))]
            value[some] = value[order]
            out[place[some]] = own[order]
        fresh = np.concatenate([[0], (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
        group = np.cumsum(fresh)
        seen += STEP
    return out


def suffix_order(symbols: np.ndarray, keys: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes but the separators, ordered by their first `depth` symbols.

    Those smaller than their successors are sorted directly. A scan over the buckets of first symbols, from the smallest,
    places the others: each entry puts its predecessor, if that is not smaller than it, at the next free place of the
    predecessor's bucket.
    """
    rising = smaller_than_next(symbols) & (symbols > 0)
    direct = sorted_directly(np.flatnonzero(rising), keys, left, depth)
    first = symbols[direct]
    edges = np.searchsorted(first, np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    done: list[np.ndarray] = []

    def place(entries: np.ndarray, bucket: int) -> np.ndarray:
        """Hand the predecessors of some entries, in order, to their buckets; returns those of this bucket."""
        before = entries[entries > 0] - 1
        before = before[(symbols[before] > 0) & ~rising[before]]
        symbol = symbols[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        kinds, starts = np.unique(symbol, return_index=True)
        same = before[:0]
        for kind, group in zip(kinds.tolist(), np.split(before, starts[1:]), strict=False):
            if kind == bucket:
                same = group
            else:
                waiting[kind].append(group)
        return same

    place(np.flatnonzero(symbols == 0), 0)
    for bucket in range(1, 257):
        queue = np.concatenate(waiting[bucket]) if waiting[bucket] else np.zeros(0, np.int64)
        waiting[bucket] = []
        while len(queue):
            done.append(queue)
            queue = place(queue, bucket)
        own = direct[edges[bucket] : edges[bucket + 1]]
        if len(own):
            done.append(own)
            place(own, bucket)
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def common_prefixes(order: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, to `depth`; all must have that many symbols left."""
    out = np.zeros(len(order), dtype=np.int32)
    alive = np.arange(1, len(order))
    seen = 0
    while len(alive) and seen < depth:
        differ = keys[order[alive] + seen] ^ keys[order[alive - 1] + seen]
        equal = differ == 0
        lead = (STEP * BITS - np.frexp(differ[~equal].astype(np.float64))[1]) // BITS
        out[alive[~equal]] = np.minimum(seen + np.maximum(lead, 0), depth)
        alive = alive[equal]
        seen += STEP
    out[alive] = depth
    return out


def repeated_starts(strings: list[bytes], length: int) -> np.ndarray:
    """For the symbols of joined(strings): does a substring of `length` start here that also starts elsewhere?"""
    symbols = joined(strings)
    flags = np.zeros(len(symbols), dtype=bool)
    keys, left = keys_of(symbols), left_of(symbols)
    order = suffix_order(symbols, keys, left, length)
    order = order[left[order] >= length]
    same = common_prefixes(order, keys, length) >= length
    flags[order[same]] = True
    flags[order[:-1][same[1:]]] = True
    return flags
