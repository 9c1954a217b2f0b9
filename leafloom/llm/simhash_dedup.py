"""Operator 11, SimHash near-deduplication: fingerprints in Arrow batches, links by pigeonhole blocks, verified.

Documents with the same fingerprint form a class, which takes part once. Fingerprints are cut into bits + 1 blocks: two
that differ in at most `bits` bits have a block in common, so they are joined on (block, its value) and each pair that
meets is checked. A block value with more than `most` fingerprints is refined: its fingerprints agree there, so their
differences lie in the other bits, and these are cut into bits + 1 blocks again. That repeats until every group is
small, which it must become, as a group that has all but log2(most) bits in common cannot have more members. So no
pair is lost and no group grows with the data, whatever the share of documents that are alike.

Pairs are never sent out: a small group is searched where it lies, outward from one member at a time, and gives one
link a member to the smallest it reaches there. Components of these links are found by stars (components.py).

Cases. Null, empty or wordless texts have fingerprint zero, linked like any other. Repeated rows of a doc_id are one
document with several fingerprints: each row is returned, and they share a component. Rows without doc_id link too;
their component is the smallest doc_id reachable, null if none has one. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import Scratch, salted_join, slices, small_batches, table
from leafloom.llm.components import components

SEED = 42
WIDTH = 64
#: Members of a group that is searched in one place; larger ones are refined.
MOST = 2048
#: Texts of one call of the hashing kernel, in bytes; a longer text is taken alone.
KERNEL_BYTES = 1 << 21


def shingle_hashes(text: bytes, length: int) -> list[int]:
    """XXH64 of the shingles of a text, repeats included; bytes.split parts at space and the controls 9 to 13."""
    words = text.lower().split()
    if len(words) <= length:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return [xxhash.xxh64_intdigest(b" ".join(words[i : i + length]), SEED) for i in range(len(words) - length + 1)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """The signed 64-bit fingerprints of lists of hashes: a bit is set if over half of a list have it."""
    prints = np.zeros(len(hashes), np.int64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.array([x for h in hashes for x in h], ">u8")
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.cumsum(sizes[some]) - sizes[some]
        set_ = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > sizes[some][:, None]
        prints[some] = np.packbits(set_, axis=1).view(">i8").ravel()
    return prints


def fingerprints(docs: DataFrame, length: int = 3) -> DataFrame:
    """(doc_id, print long) of every row."""
    small_batches(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            parts = [majority([shingle_hashes(t, length) for t in texts[rows]]) for rows in slices(np.array([len(t) for t in texts]), KERNEL_BYTES)]
            prints = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, "doc_id long, print long")


def refinements(masks: list[int], blocks: int) -> list[list[int]]:
    """For each mask of bits held in common, the masks of the next level: each adds one of `blocks` parts of the other bits."""
    out = []
    for mask in masks:
        free = [b for b in range(WIDTH) if not mask >> b & 1]
        bounds = [len(free) * k // blocks for k in range(blocks + 1)]
        out.append([mask | sum(1 << b for b in free[i:j]) for i, j in zip(bounds, bounds[1:])])
    return out


def signed(mask: int) -> int:
    return mask - (1 << WIDTH) if mask >> (WIDTH - 1) else mask


def posted(rows: DataFrame, masks: list[list[int]], path: Column) -> DataFrame:
    """(print, key): every fingerprint under its value in each block of the masks at its `path`."""
    table_of = F.array(*[F.array(*[F.lit(signed(m)) for m in own]) for own in masks])
    blocks = len(masks[0])
    keys = rows.select("print", path.alias("path"), F.posexplode(F.element_at(table_of, (path + 1).cast("int"))).alias("k", "mask"))
    return keys.select("print", F.struct((F.col("path") * blocks + F.col("k")).alias("path"), F.col("print").bitwiseAND(F.col("mask")).alias("value")).alias("key"))


def near_links(prints: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """(member, smallest member that it reaches) of the distinct fingerprints of a group, those alone left out."""
    left = np.unique(prints).view(np.uint64)
    while len(left) > 1:
        reached, border, left = [left[:1]], left[:1], left[1:]
        while len(border) and len(left):
            near = np.bitwise_count(left ^ border[0]) <= bits
            border = np.concatenate([border[1:], left[near]])
            reached.append(left[near])
            left = left[~near]
        found = np.concatenate(reached).view(np.int64)
        if len(found) > 1:
            least = int(found.min())
            yield from ((int(x), least) for x in found if x != least)


def print_links(prints: DataFrame, bits: int, most: int, scratch: Scratch) -> list[DataFrame]:
    """(a, b) of fingerprints: one table a level of refinement, whose links together join all within `bits` bits."""
    if most < 1 << 4:
        raise ValueError("groups of fewer than 16 members need not become small")
    spark = prints.sparkSession

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [pair for group in batch.column("prints") for pair in near_links(group.values.to_numpy(), bits)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    masks = refinements([0], bits + 1)
    rows = posted(prints, masks, F.lit(0))
    found = []
    while True:
        large = scratch.written(rows.groupBy("key").count().where(F.col("count") > most).select("key", F.lit(True).alias("large")), "large")
        some = not large.isEmpty()
        marked = scratch.written(salted_join(rows, large, "key", "print", "left"), "posted") if some else rows
        small = marked.where("large is null") if some else rows
        groups = small.groupBy("key").agg(F.collect_list("print").alias("prints")).where(F.size("prints") > 1).select("prints")
        small_batches(spark)
        found.append(scratch.written(groups.mapInArrow(search, "a long, b long").distinct(), "links"))
        if not some:
            return found
        masks = refinements([m for own in masks for m in own], bits + 1)
        rows = posted(marked.where("large"), masks, F.col("key.path"))


def deduplicated(docs: DataFrame, length: int = 3, bits: int = 3, most: int = MOST) -> DataFrame:
    """(doc_id, print, component_id) of every row: component_id is the smallest doc_id reachable over links."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.written(fingerprints(docs, length), "prints")
    classes = scratch.written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    # Rows of one doc_id with several fingerprints, each linked to the smallest of them.
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("b"), F.max("print").alias("other")).where("b < other")
    own = salted_join(prints, several, "doc_id", "print").select(F.col("print").alias("a"), "b").where("a <> b").distinct()
    links = scratch.written(own, "links")
    for level in print_links(classes.select("print"), bits, most, scratch):
        links = links.union(level)
    named = classes.join(components(links, scratch).withColumnRenamed("id", "print"), "print", "left")
    named = scratch.written(named.select("print", "least", F.coalesce("component", "print").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = scratch.written(salted_join(named, smallest, "component", "print").select("print", "component_id"), "classes")
    scratch.drop(prints, of_class)
    return salted_join(prints, of_class, "print", "doc_id").select("doc_id", "print", "component_id")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
