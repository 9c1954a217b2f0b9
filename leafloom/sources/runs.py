"""Results kept by run: one partition a run, written whole or not at all, read as the latest or two beside each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.sources.tables import absent


def run_id(timestamp: str, commit: str, slug: str | None = None) -> str:
    """A name that sorts by time."""
    return "_".join([timestamp, commit, *([slug.replace("-", "_")] if slug else [])])


def keep(table: DataFrame, folder: str, run: str) -> None:
    """Write the rows of one run; writing it again replaces its own rows and no others."""
    if "run_id" in table.columns:
        raise ValueError("the table has a run_id of its own")
    rows = table.withColumn("run_id", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(folder)


def kept(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All runs, with run_id; none if nothing was kept yet."""
    full = f"{schema}, run_id string"
    return spark.createDataFrame([], full) if absent(spark, folder) else spark.read.schema(full).parquet(folder)


def latest(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of its latest run: an engine that the last run left out keeps its earlier scores."""
    own = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*own), "run_id").alias("s")).select(*keys, "s.*")


def compared(runs: DataFrame, before: str | Column, after: str | Column, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, <metric>_before, <metric>_after, <metric>_change, state) of two runs; state: kept, added, gone."""
    side = lambda run, name: runs.where(F.col("run_id") == run).select(*keys, *[F.col(m).alias(f"{m}_{name}") for m in metrics], F.lit(True).alias(name))
    both = side(before, "before").join(side(after, "after"), keys, "full")
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "gone").otherwise("kept")
    change = lambda m: (F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_change")
    return both.select(*keys, *reduce(lambda a, m: [*a, f"{m}_before", f"{m}_after", change(m)], metrics, []), state.alias("state"))
