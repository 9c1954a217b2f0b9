"""Operator 13, vector codes: each part of a vector is replaced by the number of its nearest codebook entry.

All arithmetic is on integers (256 to the unit, rounded down), so codes and codebooks are the same whatever the order
and place of the work. The codebooks (parts x entries x components) have a fixed size and are broadcast. A task takes
its Arrow batches one by one: distances of all rows to all entries come from |c|^2 - 2 x.c by exact integer matrix
products, and the first smallest wins. A task sends one row for each component of each entry it used, whatever the
number of its rows; these sums are merged by a grouped shuffle, once a round.

Cases. Rows whose vector is null or has null or non-finite components go, as do those not of the length of the first
kept vector: that of the smallest vec_id (least vector) among lengths above 0 that the parts divide. Without such a row the result is
empty. Entries start from the smallest distinct vec_ids (least vector of each; nulls never), fewer if there are fewer.
Repeated and null vec_ids are coded row by row. Integers saturate at 2 ** 62; error and label_error at 2 ** 63 - 1;
beyond 2 ** 29 a batch is done in Python integers. Null labels are one label. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import Scratch, received, salted_join, shipped, table

UNIT = 256
LARGEST = 1 << 62
LONG = (1 << 63) - 1


def usable(vector: str, parts: int) -> Column:
    """Not null, of a length that the parts divide, all components finite."""
    fits = (F.size(vector) > 0) & (F.size(vector) % parts == 0)
    return F.col(vector).isNotNull() & fits & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def whole(vectors: pa.Array) -> np.ndarray:
    """(rows, length) integers of the vectors of a batch."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(UNIT * x), -float(LARGEST), float(LARGEST))
    return x.astype(np.int64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0), np.int64)


def largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) numbers of the nearest entries, and each row's squared distances summed over the parts."""
    parts, _, width = books.shape
    if width * (largest(x) + largest(books)) ** 2 * parts >= LARGEST:
        x, books = x.astype(object), books.astype(object)
    codes = np.zeros((len(x), parts), np.int64)
    error = np.zeros(len(x), x.dtype)
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width]
        far = (books[p] * books[p]).sum(axis=1)[None, :] - 2 * (own @ books[p].T)
        codes[:, p] = far.argmin(axis=1)
        error += far[np.arange(len(x)), codes[:, p]] + (own * own).sum(axis=1)
    return codes, error


def in_chunks(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def partial_sums(parcel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task's rows add to each entry: (part, entry, position, n, total), in exact integers of any size."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = received(parcel)
        parts, entries, width = books.shape
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, object)
        for batch in in_chunks(batches):
            x = whole(batch.column("vector"))
            codes, _ = assigned(x, books)
            exact = object if largest(x) * len(x) >= LARGEST else np.int64
            for p in range(parts):
                add = np.zeros((entries, width), exact)
                np.add.at(add, codes[:, p], x[:, p * width : (p + 1) * width].astype(exact))
                total[p] += add
                n[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        if len(part):
            position = np.tile(np.arange(width), len(part))
            added = pa.array([Decimal(int(v)) for v in total[part, entry].ravel()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part, width), pa.int32()), pa.array(np.repeat(entry, width), pa.int32()), pa.array(position, pa.int32()),
                 pa.array(np.repeat(n[part, entry], width), pa.int64()), added],
                names=["part", "entry", "position", "n", "total"],
            )

    return sums


def smallest(entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The integer vectors of the `entries` smallest distinct ids of a task's rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in in_chunks(batches):
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            bound = max(best) if len(best) == entries else LONG
            x = whole(batch.column("vector"))
            chosen = np.flatnonzero(ids <= bound)
            for i in chosen[np.argsort(ids[chosen], kind="stable")].tolist():
                key, value = int(ids[i]), tuple(x[i].tolist())
                if key in best or len(best) < entries or key < max(best):
                    best[key] = min(value, best.get(key, value))
                elif key > max(best):
                    break
                if len(best) > entries:
                    del best[max(best)]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([list(v) for v in best.values()], pa.list_(pa.int64()))], names=["vec_id", "x"])

    return rows


def kept_vectors(df: DataFrame, parts: int) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    rows = df.select(F.col("vec_id").cast("long"), "label", F.col("embedding").alias("vector")).where(usable("vector", parts))
    first = rows.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", "vector")).alias("row")).select(F.size("row.vector").alias("n")).first()
    return rows.where(F.size("vector") == (first["n"] or 0))


def fit(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """Codebooks (parts, entries, components) of `kept_vectors`; the driver holds them and nothing else."""
    ids = rows.where("vec_id is not null").select("vec_id", "vector").mapInArrow(smallest(entries), "vec_id long, x array<long>")
    start = ids.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").limit(entries).collect()
    if not start:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["x"] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(partial_sums(shipped(rows.sparkSession, books)), "part int, entry int, position int, n long, total decimal(38,0)")
        merged = sums.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for r in merged.collect():
            books[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["n"]
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of `kept_vectors`; code has two hex digits a part (entries number 256 at most)."""
    label = rows.schema["label"].dataType.simpleString()
    if books.shape[1] > 256:
        raise ValueError("two hex digits number 256 entries at most")
    parcel = shipped(rows.sparkSession, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = received(parcel)
        for batch in in_chunks(batches):
            codes, error = assigned(whole(batch.column("vector")), books)
            digits = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            error = error if error.dtype == np.int64 else np.array([min(e, LONG) for e in error], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(digits, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(code, f"vec_id long, label {label}, code string, error long")


def fingerprint(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of the rows of (vec_id, embedding, label) that take part."""
    scratch = Scratch(df.sparkSession)
    rows = kept_vectors(df, parts)
    books = fit(rows, parts, entries, rounds)
    # Null labels are one key; a label's rows are summed where they are, then the sums are joined to salted rows.
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")
    coded = scratch.written(encoded(rows, books).select("*", key), "codes")
    sums = coded.groupBy("key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    sums = sums.select("key", F.least("sum", F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return salted_join(coded, sums, "key", "vec_id").drop("key").withColumn("codebooks_sha256", F.lit(fingerprint(books)))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round(k: int) -> str:
    """SQL of one round: `book{k}` from the parts and `book{k-1}`."""
    return f"""
near{k} AS (
  SELECT c.vec_id, c.p, c.x, b.e FROM cell c JOIN book{k - 1} b USING (p)
  QUALIFY row_number() OVER (PARTITION BY c.vec_id, c.p ORDER BY list_sum(list_transform(list_zip(c.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e) = 1
), mean{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM near{k}, (SELECT unnest(range(1, w + 1)) AS i FROM size) GROUP BY p, e, i) GROUP BY p, e
), book{k} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k - 1} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e
)"""


OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), size AS (
  SELECT len(v) // 16 AS w FROM kept ORDER BY vec_id LIMIT 1
), cell AS (
  SELECT vec_id, p, v[p * w + 1:(p + 1) * w] AS x FROM kept, size, (SELECT unnest(range(16)) AS p)
), book0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cell
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
), {_round(1)}, {_round(2)}, final AS (
  SELECT c.vec_id, c.p, b.e, list_sum(list_transform(list_zip(c.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cell c JOIN book2 b USING (p)
  QUALIFY row_number() OVER (PARTITION BY c.vec_id, c.p ORDER BY d, b.e) = 1
), coded AS (
  SELECT vec_id, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM final GROUP BY vec_id
)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c[i] AS VARCHAR), ',' ORDER BY p, e, i)) FROM book2, (SELECT unnest(range(1, w + 1)) AS i FROM size)) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
