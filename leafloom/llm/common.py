"""Small helpers that the training-data operators share."""

from __future__ import annotations

import pickle
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the word-level operators: everything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, a temporary one serves a local master; a cluster refuses."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """The tables that one call writes to the shared folder; `drop` deletes those that its result does not read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[str, DataFrame]] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Cut the lineage: write `df` as a table and read it back."""
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((path, table))
        return table

    def drop(self, *kept: DataFrame) -> None:
        gone = [path for path, table in self.tables if not any(table is k for k in kept)]
        for path in gone:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.tables = [(path, table) for path, table in self.tables if path not in gone]


def written(df: DataFrame, name: str) -> DataFrame:
    """A table that outlives the call, as its result is read lazily."""
    return Scratch(df.sparkSession).written(df, name)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def salted_join(many: DataFrame, few: DataFrame, key: str, row: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join on `key`, of which `few` has each value once: rows of a hot key are dealt over `salts` tasks by their `row`."""
    salt = unused(many, "salt")
    dealt = many.withColumn(salt, F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    spread = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread, [key, salt], how).drop(salt)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Python tasks get whole texts in batches of `rows`, so that a batch of long ones fits beside the JVM.

    Results are lazy, so the setting stays in the session; it is only ever lowered.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send `rows` rows at a time to Python: for rows that hold whole blocks of texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def unbroadcast(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside join by shuffle only: sides that grow with the documents are sent to no driver, however small Spark
    takes them for. It reads the size of a table off its compressed files and does not see that an explode makes more rows."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(name, None) for name in names]
    for name in names:
        spark.conf.set(name, "-1")
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the decimal text of a key, modulo; the fold of a row. A null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(df: DataFrame, key: str, cap: int, seed: int = 17) -> DataFrame:
    """About `cap` rows (all, if there are fewer), chosen by a hash of the key: for fitting only."""
    n = df.count()
    if n <= cap:
        return df
    unit = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return df.where(unit < cap / n)


def slices(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive ranges of rows of `limit` bytes each at most, or of one larger row."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield slice(start, len(sizes))


def text_slices(pdf: pd.DataFrame, limit: int = 1 << 21, column: str = "text") -> Iterator[pd.DataFrame]:
    sizes = pdf[column].map(lambda t: len(t) if t is not None else 0).to_numpy(dtype=np.int64)
    for part in slices(sizes, limit):
        yield pdf.iloc[part]


def sections(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur in a sorted array and the bounds of their runs."""
    kinds, first = np.unique(part, return_index=True)
    return kinds, np.append(first, len(part))


def feature(text: str, bits: int) -> int:
    return zlib.crc32(text.encode()) & ((1 << bits) - 1)


def shipped(spark: SparkSession, model: object) -> Broadcast:
    """A model of bounded size for the tasks, pickled with its class; read it with `received`."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(parcel: Broadcast) -> object:
    return pickle.loads(parcel.value)
