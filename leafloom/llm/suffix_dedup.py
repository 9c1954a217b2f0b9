"""Operator 1, suffix-array dedup on bytes.

A byte is removed if a 200-byte string that covers it also starts anywhere else. No task can sort
the suffixes of everything, so starts are dealt out by content: each 200-byte string has one
smallest 32-gram (by hash, leftmost), and equal strings have it at the same place. Consecutive
starts with the same smallest 32-gram form a segment; it carries the bytes of all their strings.
Segments are dealt by the 32-gram. Those whose 32-gram occurs once hold nothing repeated. Of the
others, equal segments are merged with a mark, and a two-stage suffix sort with adjacent common
prefixes (suffix_sort.py) finds the repeated starts among the distinct ones.

A 32-gram with very many occurrences, such as that of a common line, is split: there, starts are
dealt by their smallest and largest 32-gram together, which equal strings also share. Both can lie
in one common passage, so with still more occurrences each start is dealt by the 128-bit hash of its
200 bytes, which is all that is sent of it; equal hashes are counted, not sorted. So what is sorted
under one key is at most ALONE segments of 368 bytes.

A split names only the parts that it holds something of, so its rows and steps are bounded by its own
bytes, whatever the number of parts.

Cases. Null, empty and short texts: nothing removed. Matches never cross rows. Rows that share a
doc_id are different texts, and are dealt by id and text. Null doc_id: as any other. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import sections, table
from leafloom.llm.suffix_sort import repeated_starts

GRAM = 32
FACTOR = 0x9E3779B97F4A7C15
#: Occurrences of a 32-gram beyond which starts are dealt by two 32-grams.
HOT = 4096
#: Occurrences of a 32-gram beyond which each start is dealt by the hash of its whole string.
ALONE = 16_384
COUNTED = "part int, split int, keys binary, counts binary"
SEGMENTS = "part int, split int, keys binary, windows binary, lengths binary, many binary, content binary"
ANSWER = "split int, part int, stage int, bits binary"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32-gram at each position, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    size = 1
    while size < GRAM:
        h = h[: len(h) - size] * np.uint64(pow(FACTOR, size, 1 << 64)) + h[size:]
        size *= 2
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    least = values
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - size : width - size + len(values) - width + 1])


class Texts:
    """The bytes of a split's documents with their segments."""

    def __init__(self, pdf: pd.DataFrame, parts: int, length: int):
        self.parts, self.length = parts, length
        self.texts = [(t or "").encode() for t in pdf["text"]]
        self.sizes = np.fromiter(map(len, self.texts), dtype=np.int64, count=len(self.texts))
        self.ends = np.cumsum(self.sizes)
        self.content = b"".join(self.texts)
        data = np.frombuffer(self.content, dtype=np.uint8)
        n = len(data) - length + 1
        at, self.first, self.last = (np.zeros(0, np.int64) for _ in range(3))
        self.low = self.pair = np.zeros(0, np.uint64)
        if n <= 0:
            return
        grams = gram_hashes(data)
        width = length - GRAM + 1
        bits = np.uint64(max(1, len(data).bit_length()))
        place = np.arange(len(grams), dtype=np.uint64)
        own = (np.uint64(1) << bits) - np.uint64(1)
        lowest = (sliding_least((grams >> bits << bits) | place, width) & own).astype(np.int32)
        highest = (sliding_least((~grams >> bits << bits) | place, width) & own).astype(np.int32)
        del place
        inside = np.zeros(n, dtype=bool)
        for end, size in zip(self.ends.tolist(), self.sizes.tolist(), strict=True):
            if size >= length:
                inside[end - size : end - length + 1] = True
        at = np.flatnonzero(inside)
        if not len(at):
            return
        self.at, self.lowest, self.highest, self.grams = at, lowest[at], highest[at], grams
        low = self.lowest
        fresh = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)]))
        self.first = at[fresh]
        self.last = at[np.concatenate([fresh[1:] - 1, [len(at) - 1]])]
        # Smallest hashes are small numbers: an odd factor spreads them over the parts again.
        self.low = grams[low[fresh]] * np.uint64(FACTOR)

    def part_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)

    def counted(self, split: int) -> pd.DataFrame:
        kinds, counts = np.unique(self.low, return_counts=True)
        parts, edges = sections(self.part_of(kinds))
        rows = [
            (p, split, kinds[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes())
            for p, a, b in zip(parts.tolist(), edges, edges[1:], strict=False)
        ]
        return pd.DataFrame(rows, columns=["part", "split", "keys", "counts"])

    def starts_of(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `at` of all starts of some segments, and how many each has."""
        sizes = self.last[segments] - self.first[segments] + 1
        begin = np.searchsorted(self.at, self.first[segments])
        return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())), sizes

    def repeated_segments(self, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First start, last start and key of the segments whose 32-gram occurs twice; hot ones cut by the largest one.

        Last, the single starts of those that are dealt by their whole string.
        """
        kinds, where = np.unique(self.low, return_inverse=True)
        parts, edges = sections(self.part_of(kinds))
        class_of = np.zeros(len(kinds), dtype=np.uint8)
        own = answers[answers["stage"] == 1]
        for p, told in zip(np.searchsorted(parts, own["part"].to_numpy(dtype=np.int64)).tolist(), own["bits"], strict=True):
            class_of[edges[p] : edges[p + 1]] = np.frombuffer(told, dtype=np.uint8)
        kept = class_of[where]
        plain = kept == 1
        first, last, key = [self.first[plain]], [self.last[plain]], [self.low[plain]]
        if (kept == 2).any():
            hot = np.flatnonzero(kept == 2)
            index, sizes = self.starts_of(hot)
            owner, high = np.repeat(hot, sizes), self.highest[index]
            fresh = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (high[1:] != high[:-1])]))
            first.append(self.at[index[fresh]])
            last.append(self.at[index[np.concatenate([fresh[1:] - 1, [len(index) - 1]])]])
            key.append(self.low[owner[fresh]] * np.uint64(FACTOR) + self.grams[high[fresh]])
        alone = self.at[self.starts_of(np.flatnonzero(kept == 3))[0]]
        return np.concatenate(first), np.concatenate(last), np.concatenate(key), alone

    def distinct(self, answers: pd.DataFrame):
        """The repeated segments: per occurrence its place among the distinct ones; those by part, content and key.

        The numbers must not depend on the order of the rows: a shuffle that is read twice can give them in two orders.
        """
        first, last, key, alone = self.repeated_segments(answers)
        digests = [
            xxhash.xxh3_128_digest(self.content[a : b + self.length]) + k
            for a, b, k in zip(first.tolist(), last.tolist(), map(np.uint64.tobytes, key), strict=True)
        ]
        segments = len(digests)
        hashes = [xxhash.xxh3_128_digest(self.content[a : a + self.length]) for a in alone.tolist()]
        digests += [h + h[:8] for h in hashes]
        first, last = np.concatenate([first, alone]), np.concatenate([last, alone])
        key = np.concatenate([key, np.frombuffer(b"".join(hashes), dtype=np.uint64)[::2]])
        where, kinds = pd.factorize(np.array([*digests, None], dtype=object)[:-1])
        n = len(kinds)
        shown = np.zeros(n, dtype=np.int64)
        shown[where[::-1]] = np.arange(len(where))[::-1]
        many = np.bincount(where, minlength=n) > 1
        words = np.frombuffer(b"".join(kinds), dtype=np.uint64).reshape(n, 3)
        order = np.lexsort((words[:, 2], words[:, 1], words[:, 0], self.part_of(key[shown])))
        rank = np.zeros(n, dtype=np.int64)
        rank[order] = np.arange(n)
        sent = [kinds[i][:16] if shown[i] >= segments else None for i in order.tolist()]
        return first, last, rank[where] if n else where, first[shown][order], last[shown][order], key[shown][order], many[order], sent

    def segments(self, split: int, answers: pd.DataFrame) -> pd.DataFrame:
        _, _, _, first, last, key, many, sent = self.distinct(answers)
        parts, edges = sections(self.part_of(key))
        rows = []
        for p, a, b in zip(parts.tolist(), edges.tolist(), edges[1:].tolist(), strict=False):
            windows = (last[a:b] - first[a:b] + 1).astype(np.uint32)
            contents = [h or self.content[x : y + self.length] for x, y, h in zip(first[a:b].tolist(), last[a:b].tolist(), sent[a:b], strict=True)]
            content, lengths = b"".join(contents), np.fromiter(map(len, contents), dtype=np.uint32, count=b - a)
            rows.append((p, split, key[a:b].tobytes(), windows.tobytes(), lengths.tobytes(), many[a:b].astype(np.uint8).tobytes(), content))
        return pd.DataFrame(rows, columns=["part", "split", "keys", "windows", "lengths", "many", "content"])

    def removed(self, answers: pd.DataFrame) -> np.ndarray:
        """For every byte: is it covered by a repeated string?"""
        first, last, where, own_first, own_last, key, _, _ = self.distinct(answers)
        windows = own_last - own_first + 1
        flags = np.zeros(int(windows.sum()), dtype=bool)
        offset = np.concatenate([[0], np.cumsum(windows)])
        parts, edges = sections(self.part_of(key))
        own = answers[answers["stage"] == 2]
        for p, bits in zip(np.searchsorted(parts, own["part"].to_numpy(dtype=np.int64)).tolist(), own["bits"], strict=True):
            a, b = offset[edges[p]], offset[edges[p + 1]]
            flags[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a).astype(bool)
        sizes = last - first + 1
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        gone = (np.repeat(first, sizes) + step)[flags[np.repeat(offset[where], sizes) + step]] if len(sizes) else step
        cover = np.zeros(len(self.content) + self.length + 1, dtype=np.int32)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + self.length, -1)
        return np.cumsum(cover)[: len(self.content)] > 0


def classes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each 32-gram asked about: 0, it occurs once; 1, repeated; 2, hot; 3, dealt by whole strings."""
    blobs = [np.frombuffer(b, dtype=np.uint64) for b in pdf["keys"]]
    _, where = np.unique(np.concatenate(blobs), return_inverse=True)
    total = np.bincount(where, weights=np.frombuffer(b"".join(pdf["counts"]), dtype=np.uint32))
    told = ((total > 1).astype(np.uint8) + (total > HOT) + (total > ALONE))[where].astype(np.uint8)
    parts = np.split(told, np.cumsum([len(b) for b in blobs])[:-1])
    return pd.DataFrame({"split": pdf["split"], "part": pdf["part"], "stage": 1, "bits": [p.tobytes() for p in parts]})


def sorted_segments(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Repeated starts of all segments of a part: one suffix sort over its distinct contents.

    Hashes of single strings are shorter than `length`: equal ones are counted, and they take no part in the sort.
    """
    contents: list[bytes] = []
    windows = [np.frombuffer(b, dtype=np.uint32).astype(np.int64) for b in pdf["windows"]]
    for content, lengths in zip(pdf["content"], pdf["lengths"], strict=True):
        ends = np.cumsum(np.frombuffer(lengths, dtype=np.uint32).astype(np.int64)).tolist()
        contents += [content[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    where, kinds = pd.factorize(np.array([*contents, None], dtype=object)[:-1])
    del contents
    many = np.bincount(where, minlength=len(kinds)) > 1
    many[where[np.frombuffer(b"".join(pdf["many"]), dtype=np.uint8) > 0]] = True
    kinds = [k if len(k) >= length else b"" for k in kinds]
    flags = repeated_starts(kinds, length)
    begin = 1 + np.concatenate([[0], np.cumsum([len(k) + 1 for k in kinds])])
    told, i = [], 0
    for sizes in windows:
        own = where[i : i + len(sizes)]
        i += len(sizes)
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        told.append(np.packbits(flags[np.repeat(begin[own], sizes) + step] | np.repeat(many[own], sizes)).tobytes())
    return pd.DataFrame({"split": pdf["split"], "part": pdf["part"], "stage": 2, "bits": told})


def without_repeats(
    docs: DataFrame, length: int = 200, split_bytes: int = 3 << 19, part_bytes: int = 4 << 20, texts: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row and, with `texts`, `kept`: the bytes that stay."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    splits, parts = max(1, math.ceil(total / split_bytes)), max(1, math.ceil(total / part_bytes))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(splits)).cast("int").alias("split"), F.col("doc_id").cast("string").alias("doc_id"), "text")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return Texts(pdf, parts, length).counted(int(key[0]))

    def cut(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return Texts(pdf, parts, length).segments(int(key[0]), answers)

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        return sorted_segments(pdf, length)

    def remove(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own = Texts(pdf, parts, length)
        gone = own.removed(answers)
        rows = []
        for text, end, size in zip(own.texts, own.ends.tolist(), own.sizes.tolist(), strict=True):
            flags = gone[end - size : end]
            spans = int(flags[:1].sum() + (flags[1:] & ~flags[:-1]).sum())
            kept = np.frombuffer(text, dtype=np.uint8)[~flags].tobytes() if spans else text
            rows.append((size, int(flags.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
        return out if texts else out.drop(columns="kept")

    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    grouped = dealt.groupBy("split")
    first = grouped.applyInPandas(count, COUNTED).groupBy("part").applyInPandas(classes, ANSWER)
    second = grouped.cogroup(first.groupBy("split")).applyInPandas(cut, SEGMENTS).groupBy("part").applyInPandas(sort, ANSWER)
    out = grouped.cogroup(first.unionByName(second).groupBy("split")).applyInPandas(remove, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
