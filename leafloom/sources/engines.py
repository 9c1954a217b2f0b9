"""Slots for recognition engines: none is bundled. A registry says which can run here, and a cache fills only what it lacks.

An engine is a function of a column of contents and one of suffixes. `per_file` makes one of a plain function of one
file: a file that it fails on becomes a row with the error, not a failed job. `existing` reads a text column instead,
for tables that were transcribed elsewhere.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.sources.tables import absent

RESULT = "struct<text:string,error:string>"
CACHE = "file string, text string, error string, engine string"


@dataclass(frozen=True)
class Engine:
    name: str
    transcribe: Callable[[Column, Column], Column]
    suffixes: tuple[str, ...]
    single_page: bool = False
    #: Python modules that must be importable, the extra that brings them, and why it is withdrawn, if it is.
    requires: tuple[str, ...] = ()
    extra: str = ""
    withdrawn: str = ""

    def lacking(self) -> list[str]:
        return [m for m in self.requires if importlib.util.find_spec(m) is None]


def existing(name: str, column: str, suffixes: tuple[str, ...]) -> Engine:
    return Engine(name, lambda content, suffix: F.col(column), suffixes)


def per_file(name: str, function: Callable[..., str], suffixes: tuple[str, ...], single_page: bool = False, **settings) -> Engine:
    """An engine of function(content, suffix, **settings) -> text."""

    def batch(contents: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        call = partial(function, **settings)
        for content, suffix in contents:
            rows = []
            for c, s in zip(content, suffix, strict=True):
                try:
                    rows.append((call(c, s), None))
                except Exception as e:  # a file an engine fails on is data
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["text", "error"])

    return Engine(name, F.pandas_udf(batch, RESULT, F.PandasUDFType.SCALAR_ITER), suffixes, single_page)


class UnknownEngine(ValueError):
    pass


class MissingEngine(RuntimeError):
    pass


class WithdrawnEngine(MissingEngine):
    pass


@dataclass
class Registry:
    """Engines by name, in the order in which they were added: their order in ties and in tables."""

    engines: dict[str, Engine] = field(default_factory=dict)

    def add(self, engine: Engine) -> Engine:
        if engine.name in self.engines:
            raise ValueError(f"engine {engine.name} is there already")
        self.engines[engine.name] = engine
        return engine

    def wrapper(self, name: str, of: str, transcribe: Callable[[Column, Column], Column]) -> Engine:
        """The same engine under another name, with other settings: it needs and reads what that one does."""
        return self.add(replace(self.named(of), name=name, transcribe=transcribe))

    def named(self, name: str) -> Engine:
        if name not in self.engines:
            raise UnknownEngine(f"no engine {name!r}; known: {', '.join(self.engines)}")
        return self.engines[name]

    def get(self, name: str) -> Engine:
        """An engine that can run here; otherwise an error that says what is to be done."""
        engine = self.named(name)
        if reason := self.unavailable(name):
            raise (WithdrawnEngine if engine.withdrawn else MissingEngine)(f"engine {name!r}: {reason}")
        return engine

    def unavailable(self, name: str) -> str | None:
        engine = self.named(name)
        lacking = engine.lacking()
        if not lacking:
            return None
        return engine.withdrawn or f"needs {', '.join(lacking)}" + (f"; install the extra {engine.extra!r}" if engine.extra else "")

    def available(self) -> list[str]:
        return [n for n in self.engines if self.unavailable(n) is None]

    def capabilities(self, spark: SparkSession) -> DataFrame:
        """(engine, engine_ord, suffixes, single_page, available, error): a row an engine."""
        rows = [(n, i, list(e.suffixes), e.single_page, self.unavailable(n) is None, self.unavailable(n)) for i, (n, e) in enumerate(self.engines.items())]
        return spark.createDataFrame(rows, "engine string, engine_ord int, suffixes array<string>, single_page boolean, available boolean, error string")

    def ordered(self, rows: DataFrame, column: str = "engine") -> DataFrame:
        """Rows in the registry's order, engines it does not know last, by name."""
        place = F.array_position(F.array(*map(F.lit, self.engines)), F.col(column))
        return rows.orderBy(F.when(place > 0, place).otherwise(len(self.engines) + 1), column)


def _own(files: DataFrame, engine: Engine) -> DataFrame:
    own = files.where(F.col("suffix").isin(list(engine.suffixes)))
    return own.where("pages <= 1") if engine.single_page else own


def missing(files: DataFrame, engines: list[Engine], cache: DataFrame) -> DataFrame:
    """(file, engine) pairs that no cached transcript covers."""
    wanted = [files.where(F.col("suffix").isin(list(e.suffixes))).select("file", F.lit(e.name).alias("engine")) for e in engines]
    return reduce(DataFrame.unionByName, wanted).join(cache, ["file", "engine"], "left_anti")


def transcribed(files: DataFrame, engines: list[Engine]) -> DataFrame:
    """Candidates (file, engine_ord, engine, text) of every engine that reads the file's suffix; null text where it failed."""
    parts = []
    for i, e in enumerate(engines):
        rows = _own(files, e).select("file", F.lit(i).alias("engine_ord"), F.lit(e.name).alias("engine"), e.transcribe(F.col("content"), F.col("suffix")).alias("text"))
        parts.append(rows.withColumn("text", F.col("text.text")) if rows.schema["text"].dataType.typeName() == "struct" else rows)
    return reduce(DataFrame.unionByName, parts)


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text, error, engine) so far; none without a cache."""
    return spark.createDataFrame([], CACHE) if absent(spark, folder) else spark.read.schema(CACHE).parquet(folder)


def fill(files: DataFrame, engines: list[Engine], folder: str, again: bool = False) -> int:
    """Run the engines on the files whose (file, engine) pair the cache lacks, and append the results; how many there were.

    A failure is stored as a row with its error and not tried again, unless `again`, which replaces it.
    """
    spark, count = files.sparkSession, 0
    for e in engines:
        have = cached(spark, folder).where(F.col("engine") == e.name)
        old = have.where("error is not null").select("file") if again else None
        done = (have.where("error is null") if again else have).select("file")
        todo = _own(files, e).join(done, "file", "left_anti")
        n = todo.count()
        if not n:
            continue
        result = todo.select(F.col("file").cast("string").alias("file"), e.transcribe(F.col("content"), F.col("suffix")).alias("r"))
        is_struct = result.schema["r"].dataType.typeName() == "struct"
        rows = result.select("file", *(["r.text", "r.error"] if is_struct else [F.col("r").alias("text"), F.lit(None).cast("string").alias("error")]), F.lit(e.name).alias("engine"))
        if old is not None and not old.isEmpty():
            # The partition of this engine is written anew from its good rows and the new ones; the good rows are read
            # before, so they go to a table of their own first.
            keep = have.where("error is null").unionByName(rows)
            side = f"{folder.rstrip('/')}-{e.name}"
            keep.write.mode("overwrite").parquet(side)
            rows = spark.read.schema(keep.schema).parquet(side)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("engine").parquet(folder)
        else:
            rows.write.mode("append").partitionBy("engine").parquet(folder)
        count += n
    return count
