"""Operator 10, approximate nearest neighbours by a hash-prefix forest.

Each tree has its own hash strings: 62 bits, the sides on which a centred vector lies of the tree's random hyperplanes,
orthogonal as far as the dimension goes. A tree is a sorted array of all strings. A query descends in every tree to its
longest matching prefix with another row; then the trees ascend together, one bit at a time and tree after tree, until
enough rows share a prefix. Those rows are compared exactly, on the original vectors in double precision.

Arrays are dealt into ranges by the first bits of the strings, at most `RANGE_BITS` of them, and large ranges into equal
shares; only strings and ids go through the forest. What a query finds in a tree goes to the blocks of the vectors in
pieces, so neither the candidates of a query nor the queries of a block meet in one group: queries too are dealt,
`QUERY_ROWS` to a group. A query's vector goes only to the blocks in which it found rows, and a block only to the groups
that ask it. Of equal vectors only the rows with the smallest `k + 1` ids enter the arrays: no other copy can be among
the nearest k (the engine keeps as many of each vector before it shuffles, so a hot vector is no hot task).

Enough rows: `density * n ** growth` of the n rows of that length, repeated finds counted and the query's own rows not,
and some tree must hold `k`. On vectors that lie evenly on a sphere, near rows are hardly nearer than others, and a
recall of 0.9 needs that many. A query that is short of them under the bits that number the ranges (one at least)
ascends to the root: it is compared with all rows, block by block.

Cases. Vectors that are null, empty, zero, or hold null or non-finite components take no part.
Vectors of different lengths are never compared. Equal distances: the smaller id. Repeated ids:
rows of the query's own id are no candidates, and of several query vectors of one id the smallest
asks. Null ids take no part. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.common import Scratch, bounded_sample, small_batches, table

TREES, BITS = 128, 62
#: First bits of a string that may number its range: fewer than queries share with the rows they find.
RANGE_BITS = 6
#: Strings of a range, rows of a block, and queries that meet a block in one group.
RANGE_ROWS, BLOCK_ROWS, QUERY_ROWS = 200_000, 20_000, 1000
#: Rows that the centre of the vectors is taken from.
SAMPLE = 5000


def usable(df: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & F.col("vec_id").isNotNull() & sound & F.exists(v, lambda x: x != 0))


def hyperplanes(tree: int, dim: int) -> np.ndarray:
    """(dim, BITS): as many random rotations as give so many columns."""
    draws = np.random.default_rng([tree, dim]).standard_normal((-(-BITS // dim), dim, dim))
    return np.concatenate([np.linalg.qr(d)[0] for d in draws], axis=1)[:, :BITS].astype(np.float32)


def strings(vectors: np.ndarray, centre: np.ndarray, trees: int) -> np.ndarray:
    """(rows, trees): the strings as numbers, the first bit highest."""
    moved = (vectors - centre).astype(np.float32)
    weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return np.stack([((moved @ hyperplanes(tree, vectors.shape[1])) > 0) @ weights for tree in range(trees)], axis=1)


def coded(df: DataFrame, centres: dict[int, list[float]], trees: int) -> DataFrame:
    """(vec_id, dim, tree, code): a row for each tree."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["embedding"].map(len)):
                vectors = np.array(part["embedding"].tolist(), dtype=np.float64)
                code = strings(vectors, np.array(centres.get(dim, [0.0] * dim)), trees)
                ids, tree = np.repeat(part["vec_id"].to_numpy(), trees), np.tile(np.arange(trees), len(part))
                yield pd.DataFrame({"vec_id": ids, "dim": dim, "tree": tree, "code": code.ravel()})

    return df.select("vec_id", "embedding").mapInPandas(rows, "vec_id long, dim int, tree int, code long")


def prefix_ranges(arrays: np.ndarray, codes: np.ndarray, bits: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in the sorted array of what shares that many bits with each string."""
    step = np.int64(1) << (BITS - np.asarray(bits, dtype=np.int64))
    low = codes // step * step
    return np.searchsorted(arrays, low), np.searchsorted(arrays, low + step)


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common prefix of each pair of strings."""
    return BITS - np.array([int(x).bit_length() for x in a ^ b], dtype=np.int64)


def shared_counts(fewest_bits: int):
    """Of each query of a share of a tree: how many other rows share `fewest_bits` bits, one more, and so on to its longest
    match."""

    def counts_of(key: tuple, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        arrays, codes = np.sort(index["code"].to_numpy()), asked["code"].to_numpy()
        levels = np.arange(fewest_bits, BITS + 1)
        own = asked.assign(row=np.arange(len(asked))).merge(index[["vec_id", "code"]], on="vec_id", suffixes=("", "_own"))
        own_bits = shared_bits(own["code"].to_numpy(), own["code_own"].to_numpy())
        columns = []
        for level in levels:
            low, high = prefix_ranges(arrays, codes, level)
            count = high - low
            np.subtract.at(count, own["row"].to_numpy()[own_bits >= level], 1)
            if not count.any():
                break
            columns.append(count)
        counts = [np.trim_zeros(c, "b") for c in np.stack(columns, axis=1)] if columns else [np.zeros(0, np.int64)] * len(codes)
        return pd.DataFrame({"query_id": asked["vec_id"].to_numpy(), "dim": int(key[0]), "tree": int(key[1]), "counts": pd.Series(counts, dtype=object)})

    return counts_of


def ascended(density: float, growth: float, k: int, fewest_bits: int):
    """Rows (query_id, tree, bits): the bits that a query shares in each tree when all have ascended far enough; a null
    tree for one that ascends to the root."""

    def levels_of(counts: np.ndarray, enough: float) -> np.ndarray | None:
        """The level (column) of each tree (row) of `counts`, of which the last column is zero; None for the root."""
        n, deepest = len(counts), counts.shape[1] - 1
        # Ascents in their order: from the longest match to the shortest, and at each length the trees in turn.
        gain = (counts[:, :-1] - counts[:, 1:])[:, ::-1].T.ravel()
        fullest = np.maximum.accumulate(counts[:, :-1][:, ::-1].T.ravel())
        done = np.flatnonzero((np.cumsum(gain) >= enough) & (fullest >= k))
        if not len(done):
            return None
        turn, last = divmod(int(done[0]), n)
        return np.where(np.arange(n) <= last, deepest - 1 - turn, deepest - turn)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for query, n, per_tree in zip(pdf["query_id"], pdf["rows"], pdf["per_tree"], strict=True):
                per_tree = sorted(per_tree, key=lambda t: t["tree"])
                counts = np.zeros((len(per_tree), max(len(t["counts"]) for t in per_tree) + 1), np.int64)
                for row, t in zip(counts, per_tree, strict=True):
                    row[: len(t["counts"])] = t["counts"]
                level = levels_of(counts, density * n**growth)
                if level is None:
                    out.append((query, None, 0))
                else:
                    some = counts[np.arange(len(counts)), level] > 0
                    out += [(query, t["tree"], fewest_bits + int(s)) for t, s, c in zip(per_tree, level, some, strict=True) if c]
            yield pd.DataFrame(out, columns=["query_id", "tree", "bits"]).astype({"tree": "Int32"})

    return rows


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, trees: int = TREES, density: float = 2.1, growth: float = 0.83) -> DataFrame:
    """(query_id, rank, vec_id, score) of `queries` (vec_id, embedding) among the rows of `df` with another id."""
    small_batches(df.sparkSession, 2000)
    scratch = Scratch(df.sparkSession)
    rows = usable(df.select("vec_id", "embedding"), "embedding")
    asked = usable(queries.select("vec_id", "embedding"), "embedding").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = rows.count()
    of_length = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("rows"))
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    index = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    sample = bounded_sample(rows, "vec_id", SAMPLE).toPandas()["embedding"]
    centres = {d: np.array(v.tolist(), dtype=np.float64).mean(axis=0).tolist() for d, v in sample.groupby(sample.map(len))} if len(sample) else {}
    range_bits = min(RANGE_BITS, max(0, math.ceil(math.log2(max(n, 1) / RANGE_ROWS))))
    shares = max(1, math.ceil(n / (RANGE_ROWS << range_bits)))
    fewest_bits = max(1, range_bits)
    of_range = F.shiftright("code", BITS - range_bits).cast("int").alias("range")
    arrays = coded(index, centres, trees).select("dim", "tree", of_range, F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int").alias("salt"), "vec_id", "code")
    probes = coded(asked, centres, trees).select("dim", "tree", of_range, F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("salt"), "vec_id", "code")
    keys = ["dim", "tree", "range", "salt"]
    counted = arrays.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(shared_counts(fewest_bits), "query_id long, dim int, tree int, counts array<long>")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    # One row for each share of a tree; a query has `trees` of them in all, once the shares are added.
    zero = F.expr("cast(array() as array<bigint>)")
    summed = counted.groupBy("query_id", "dim", "tree").agg(F.aggregate(F.collect_list("counts"), zero, add).alias("counts"))
    per_tree = summed.groupBy("query_id", "dim").agg(F.collect_list(F.struct("tree", "counts")).alias("per_tree"))
    per_tree = per_tree.join(F.broadcast(of_length), "dim")  # a row for each length of vector
    levels = scratch.written(per_tree.select("query_id", "rows", "per_tree").mapInPandas(ascended(density, growth, k, fewest_bits), "query_id long, tree int, bits int"), "levels")
    blocks, groups = max(1, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(asked.count() / QUERY_ROWS))

    def gathered(key: tuple, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """(query_id, block, ids): what each query finds in a share of a tree, by block of the vectors."""
        order = np.argsort(index["code"].to_numpy(), kind="stable")
        arrays, ids = index["code"].to_numpy()[order], index["vec_id"].to_numpy()[order]
        low, high = prefix_ranges(arrays, asked["code"].to_numpy(), asked["bits"].to_numpy()) if len(asked) else ([], [])
        block = ids % blocks
        found = []
        for query, a, b in zip(asked["vec_id"].tolist(), low, high, strict=True):
            by = np.argsort(block[a:b], kind="stable")
            kinds, first = np.unique(block[a:b][by], return_index=True)
            found += [(query, int(p), part.tobytes()) for p, part in zip(kinds, np.split(ids[a:b][by], first[1:]), strict=True)]
        return pd.DataFrame(found, columns=["query_id", "block", "ids"])

    def compared(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The nearest k of each query in a block. Queries come with one row that holds their vector; those without ids
        are compared with the whole block."""
        order = np.argsort(vectors["vec_id"].to_numpy(), kind="stable")
        ids = vectors["vec_id"].to_numpy()[order]
        lengths = vectors["embedding"].map(len).to_numpy()[order] if len(vectors) else np.zeros(0)
        tables = {d: np.array(vectors["embedding"].iloc[order[lengths == d]].tolist(), dtype=np.float64) for d in np.unique(lengths)}
        place = np.zeros(len(ids), dtype=np.int64)
        for d in tables:
            place[lengths == d] = np.arange(int((lengths == d).sum()))
        out = []
        for query, own in asked.groupby("query_id"):
            vector = own["query"].dropna()
            if not len(vector) or not len(ids):
                continue
            parts, vector = own["ids"].dropna().tolist(), np.asarray(vector.iloc[0], dtype=np.float64)
            if own["root"].any():
                at = np.arange(len(ids))
            elif parts:
                some = np.unique(np.frombuffer(b"".join(parts), dtype=np.int64))
                at = np.flatnonzero(np.isin(ids, some, assume_unique=False))
            else:
                continue
            at = at[(ids[at] != query) & (lengths[at] == len(vector))]
            if len(at):
                gap = tables[len(vector)][place[at]] - vector
                score = np.sqrt((gap * gap).sum(axis=1))
                best = np.lexsort((ids[at], score))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    told = probes.join(levels.where("tree is not null").withColumnRenamed("query_id", "vec_id"), ["vec_id", "tree"])
    found = arrays.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(gathered, "query_id long, block long, ids binary")
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group")
    found = scratch.written(found.select("block", group, "query_id", "ids"), "found")
    no_ids, no_vector = F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("array<double>").alias("query")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    at_root = levels.where("tree is null").select("query_id", every).select("block", group, "query_id", F.lit(True).alias("root"))
    asks = found.select("block", "group", "query_id", F.lit(False).alias("root")).distinct().unionByName(at_root)
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query"))
    own = asks.join(own, "query_id").select("block", "group", "query_id", "query", no_ids, "root")
    found = found.select("block", "group", "query_id", no_vector, "ids", F.lit(False).alias("root"))
    # A row a block, with the groups that ask it.
    askers = asks.groupBy("block").agg(F.collect_set("group").alias("askers"))
    vectors = index.withColumn("block", F.pmod("vec_id", F.lit(blocks)).cast("long")).join(askers, "block")
    vectors = vectors.select("block", F.explode("askers").alias("group"), "vec_id", "embedding")
    best = vectors.groupBy("block", "group").cogroup(found.unionByName(own).groupBy("block", "group"))
    best = best.applyInPandas(compared, "query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
