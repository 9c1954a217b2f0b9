"""Published views of stored results: which rows are shown, each cell's text, and which cells are the best of their row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions.outputs import printed

MEAN, AVERAGE = "mean", "Average"


def _known(value: str, allowed: tuple[str, ...], what: str) -> None:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")


def best_of(metric: Column, over: list[str]) -> Column:
    """Equal to the highest of its group: ties are all marked."""
    return F.coalesce(metric == F.max(metric).over(Window.partitionBy(*over)), F.lit(False))


def register_summary(scores: DataFrame) -> DataFrame:
    """(engine, chr, wrd, best_chr, best_wrd, registers) of (register, engine, chr, wrd): an engine a row, its means to three
    places, the highest recall first. Refused without a `mean` row. The registers are counted, not written down."""
    n = scores.where(F.col("register") != MEAN).agg(F.count_distinct("register").alias("registers"))
    means = scores.where(F.col("register") == MEAN)
    if means.isEmpty():
        raise ValueError("no mean row")
    top = means.agg(F.max("chr").alias("top_chr"), F.max("wrd").alias("top_wrd"))
    shown = means.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(n))  # one row each
    three = lambda c: printed(F.col(c), 3).alias(c)
    shown = shown.orderBy(F.desc("wrd"), "engine")
    return shown.select("engine", three("chr"), three("wrd"), (F.col("chr") == F.col("top_chr")).alias("best_chr"), (F.col("wrd") == F.col("top_wrd")).alias("best_wrd"), "registers")


def register_cells(scores: DataFrame, metric: str = "wrd") -> DataFrame:
    """(register, engine, cell, is_best): every register and the mean row in one metric; the mean row's best is marked too,
    as its cells are of the same kind."""
    _known(metric, ("wrd", "chr"), "metric")
    return scores.select("register", "engine", printed(F.col(metric), 3).alias("cell"), best_of(F.col(metric), ["register"]).alias("is_best"))


def benchmark_cells(scores: DataFrame, not_local: list[str], metric: str = "score") -> DataFrame:
    """(label, backend, cell, is_best) of (fixture, backend, chr, wrd, sec), with Average rows: similarity and recall to two
    places, or seconds to one.

    The best is marked by similarity, among local backends, on fixtures only; never beside seconds, where it would be read
    as the fastest. The Average row holds total seconds, and is called so there.
    """
    _known(metric, ("score", "sec"), "metric")
    average = F.col("fixture") == AVERAGE
    if metric == "sec":
        label = F.when(average, "Total seconds").otherwise(F.col("fixture"))
        return scores.select(label.alias("label"), "backend", F.when(F.col("sec").isNull(), "—").otherwise(printed(F.col("sec"), 1)).alias("cell"), F.lit(False).alias("is_best"))
    local = F.when(~F.col("backend").isin(not_local), F.col("chr"))
    cell = F.when(F.col("chr").isNull(), "N/A").otherwise(F.concat_ws("/", printed(F.col("chr"), 2), printed(F.col("wrd"), 2)))
    return scores.select(F.col("fixture").alias("label"), "backend", cell.alias("cell"), (~average & best_of(local, ["fixture"])).alias("is_best"))


def reading_order_cells(rows: DataFrame, metric: str = "chr", backend: str | None = None) -> DataFrame:
    """(row, strategy, cell, is_best) of (fixture, backend, layout, strategy, chr, wrd): the multi-column means of every
    backend, or all rows of one. Refused if the backend has none."""
    _known(metric, ("chr", "wrd"), "metric")
    if backend is None:
        shown = rows.where((F.col("fixture") == MEAN) & (F.col("layout") == "multi-column")).withColumn("row", F.col("backend"))
    else:
        label = F.when(F.col("fixture") == MEAN, F.concat(F.lit("mean, "), F.col("layout"))).otherwise(F.col("fixture"))
        shown = rows.where(F.col("backend") == backend).withColumn("row", label)
        if shown.isEmpty():
            raise ValueError(f"no rows for backend {backend!r}")
    return shown.select("row", "strategy", printed(F.col(metric), 3).alias("cell"), best_of(F.col(metric), ["row"]).alias("is_best"))
