"""Operator 2, substring dedup on words by difference-cover anchors.

A window of 13 words is removed if its words also start in a document with a smaller doc_id. Runs
of 7 words are hashed only at word positions that lie, modulo 7, in a difference cover. Wherever
two equal windows stand, some offset below 7 brings both to cover positions, so they share an
anchor at the same place inside. Anchors that two documents share are extended to the whole
windows around them, whose hashes then tell the smallest document.

Documents are dealt into splits of bounded text. A split asks, for each range of hashes that it holds
any of, about its distinct hashes in one packed row, and gets one bit each: numpy sorts, Spark
shuffles. A hash that a third of all documents hold is asked once a split. The documents are shuffled
once; the three passes reuse that exchange. Anchors only choose candidates and are compared by 64
bits; windows are equal if two independent 64-bit hashes of their words are.

Cases. Null, empty and short texts: nothing removed. A null doc_id counts as larger than all, the
largest long included. Rows that share a doc_id are one document for "smaller", and each is returned;
they are dealt by id and text, so rows of a null or repeated id do not meet in one task. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import sections, table
from leafloom.llm.minhash_dedup import mixed, word_hashes

WINDOW, PERIOD = 13, 7
COVER = np.array([True, True, False, True, False, False, False])
ANCHOR = WINDOW - PERIOD + 1
POWERS = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15, dtype=np.uint64))
OTHER_POWERS = np.cumprod(np.full(WINDOW, 0xC2B2AE3D27D4EB4F, dtype=np.uint64))
LAST = (1 << 63) - 1
ASKED = "part int, split int, hashes binary, others binary, docs binary, named binary"
ANSWER = "split int, part int, stage int, bits binary"


def run_hashes(words: np.ndarray, length: int, powers: np.ndarray = POWERS) -> np.ndarray:
    """Hash of the run of `length` words at each position (fewer positions than words)."""
    n = max(0, len(words) - length + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        out += words[k : k + n] * powers[k]
    return mixed(out)


class Split:
    """The words of a split's documents, one document after the other."""

    def __init__(self, pdf: pd.DataFrame, parts: int):
        self.parts = parts
        self.named = pdf["doc_id"].notna().to_numpy()
        self.ids = pdf["doc_id"].fillna("0").to_numpy(dtype=object).astype(np.int64)
        self.words, self.others, self.sizes = word_hashes(pdf["text"].tolist(), lower=False)
        starts = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.words)) - starts[self.row]
        self.left = self.sizes[self.row] - self.place

    def part_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(COVER[self.place % PERIOD] & (self.left >= ANCHOR))
        return at, run_hashes(self.words, ANCHOR)[at] if len(at) else np.zeros(0, np.uint64)

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and the two hashes of the windows that hold a shared anchor."""
        seen = np.concatenate([[0], np.cumsum(shared)])
        at = np.flatnonzero(self.left >= WINDOW)
        at = at[seen[at + PERIOD] > seen[at]]
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return at, run_hashes(self.words, WINDOW)[at], run_hashes(self.others, WINDOW, OTHER_POWERS)[at]

    def several(self, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, which of them two documents here hold, and the place of each hash among them."""
        kinds, where = np.unique(hashes, return_inverse=True)
        low, high = np.full(len(kinds), len(self.sizes), dtype=np.int64), np.full(len(kinds), -1, dtype=np.int64)
        np.minimum.at(low, where, self.row[at])
        np.maximum.at(high, where, self.row[at])
        return kinds, low < high, where

    def smallest(self, at: np.ndarray, hashes: np.ndarray, others: np.ndarray):
        """Distinct pairs of hashes, their smallest document here, if any is not null, and the place of each window."""
        kinds, more, where = distinct_pairs(hashes, others)
        low = np.full(len(kinds), LAST, dtype=np.int64)
        rows = self.row[at]
        named = self.named[rows]
        np.minimum.at(low, where[named], self.ids[rows[named]])
        has = np.bincount(where[named], minlength=len(kinds)) > 0
        return kinds, more, low, has, where

    def asked(self, split: int, kinds: np.ndarray, more=None, low=None, has=None) -> pd.DataFrame:
        parts, edges = sections(self.part_of(kinds))
        cut = lambda v, a, b: v[a:b].tobytes() if v is not None else None
        rows = [(p, split, *(cut(v, a, b) for v in (kinds, more, low, has))) for p, a, b in zip(parts.tolist(), edges, edges[1:], strict=False)]
        return pd.DataFrame(rows, columns=["part", "split", "hashes", "others", "docs", "named"])

    def shared(self, answers: pd.DataFrame) -> np.ndarray:
        """For every word position: an anchor that stands in two rows starts there."""
        at, hashes = self.anchors()
        kinds, twice, where = self.several(at, hashes)
        told = bits_of(answers, 1, len(kinds), self.part_of(kinds))
        flags = np.zeros(len(self.words), dtype=np.int64)
        flags[at] = (twice | told)[where] if len(at) else 0
        return flags


def distinct_pairs(hashes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order of their first and second value, and the place of each pair among them."""
    order = np.lexsort((others, hashes))
    h, o = hashes[order], others[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    where = np.empty(len(order), dtype=np.int64)
    where[order] = np.cumsum(fresh) - 1
    return h[fresh], o[fresh], where


def bits_of(answers: pd.DataFrame, stage: int, n: int, part: np.ndarray) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    kinds, edges = sections(part)
    own = answers[answers["stage"] == stage]
    for at, bits in zip(np.searchsorted(kinds, own["part"].to_numpy(dtype=np.int64)).tolist(), own["bits"], strict=True):
        out[edges[at] : edges[at + 1]] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=edges[at + 1] - edges[at]).astype(bool)
    return out


def in_other_splits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each asked hash: do two splits hold it?"""
    _, where, counts = np.unique(joined_blobs(pdf["hashes"], np.uint64), return_inverse=True, return_counts=True)
    return replies(pdf, 1, (counts > 1)[where])


def in_smaller_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each asked window: has another split a smaller document with it? If the asker's are all null: any that is not?"""
    kinds, _, where = distinct_pairs(joined_blobs(pdf["hashes"], np.uint64), joined_blobs(pdf["others"], np.uint64))
    docs, named = joined_blobs(pdf["docs"], np.int64), joined_blobs(pdf["named"], bool)
    low = np.full(len(kinds), LAST, dtype=np.int64)
    np.minimum.at(low, where, docs)
    has = np.bincount(where, weights=named, minlength=len(kinds)) > 0
    return replies(pdf, 2, np.where(named, low[where] < docs, has[where]))


def joined_blobs(blobs: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=kind)


def replies(pdf: pd.DataFrame, stage: int, told: np.ndarray) -> pd.DataFrame:
    bits = np.split(told, np.cumsum([len(b) // 8 for b in pdf["hashes"]])[:-1])
    packed = [np.packbits(b).tobytes() for b in bits]
    return pd.DataFrame({"split": pdf["split"], "part": pdf["part"], "stage": stage, "bits": packed})


def without_repeats(docs: DataFrame, split_bytes: int = 8 << 20, part_bytes: int = 24 << 20, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each document and, with `texts`, `kept`: what stays, joined by spaces."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    splits, parts = max(1, math.ceil(total / split_bytes)), max(1, math.ceil(total / part_bytes))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(splits)).cast("int").alias("split"), F.col("doc_id").cast("string").alias("doc_id"), "text")

    def ask_anchors(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = Split(pdf, parts)
        return own.asked(int(key[0]), np.unique(own.anchors()[1]))

    def ask_windows(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own = Split(pdf, parts)
        return own.asked(int(key[0]), *own.smallest(*own.windows(own.shared(answers)))[:4])

    def remove(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own = Split(pdf, parts)
        at, hashes, others = own.windows(own.shared(answers))
        kinds, _, low, has, where = own.smallest(at, hashes, others)
        told = bits_of(answers, 2, len(kinds), own.part_of(kinds))
        row = own.row[at]
        gone = at[told[where] | np.where(own.named[row], own.ids[row] > low[where], has[where])] if len(at) else at
        cover = np.zeros(len(own.words) + WINDOW + 1, dtype=np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + WINDOW, -1)
        keep = np.cumsum(cover)[: len(own.words)] == 0
        removed = np.bincount(own.row[~keep], minlength=len(own.sizes))
        ends = np.cumsum(own.sizes)
        kept = []
        for i, text in enumerate(pdf["text"]):
            words = (text or "").encode().split()
            if removed[i]:
                words = [w for w, k in zip(words, keep[ends[i] - own.sizes[i] : ends[i]].tolist(), strict=True) if k]
            kept.append(b" ".join(words))
        out = {"doc_id": pdf["doc_id"], "n_words": own.sizes, "n_removed": removed, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
        return pd.DataFrame(out | ({"kept": [k.decode() for k in kept]} if texts else {}))

    grouped = dealt.groupBy("split")
    first = grouped.applyInPandas(ask_anchors, ASKED).groupBy("part").applyInPandas(in_other_splits, ANSWER)
    second = grouped.cogroup(first.groupBy("split")).applyInPandas(ask_windows, ASKED).groupBy("part").applyInPandas(in_smaller_document, ANSWER)
    schema = "doc_id string, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    out = grouped.cogroup(first.unionByName(second).groupBy("split")).applyInPandas(remove, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS low FROM x GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM x JOIN m USING (s) WHERE doc_id > low),
k AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
o AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN k USING (doc_id)),
r AS (SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed, coalesce((SELECT string_agg(t.v, ' ' ORDER BY t.i) FROM (SELECT unnest(w) AS v, generate_subscripts(w, 1) AS i) t WHERE NOT list_contains(gone, t.i)), '') AS kept FROM o)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM r
"""
