"""Run logs: summaries, totals and elapsed times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backend_seconds(events: DataFrame) -> DataFrame:
    """n, floor of the mean and median seconds by backend."""
    return events.groupBy("backend").agg(F.count("*").alias("n"), F.floor(F.avg("seconds")).alias("mean_seconds"), F.median("seconds").alias("median_seconds"))


def slowest_first(summary: DataFrame) -> DataFrame:
    """The rows of `backend_seconds` by their mean, the slowest backend first."""
    return summary.orderBy(F.desc("mean_seconds"), "backend")


def run_totals(events: DataFrame) -> DataFrame:
    """files, processed, triaged (refused files among them) and errors by run."""
    return (
        events.groupBy("run")
        .agg(F.count("*").alias("files"), F.count_if(F.col("outcome").isin("triaged", "refused")).alias("triaged"), F.count_if(F.col("outcome") == "error").alias("errors"))
        .withColumn("processed", F.col("files") - F.col("triaged") - F.col("errors"))
    )


def elapsed(events: DataFrame) -> DataFrame:
    """Seconds since the previous event of the same run and file; null for the first."""
    along = Window.partitionBy("run", "file").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp")
    return events.withColumn("elapsed", F.unix_micros(at) / 1e6 - F.unix_micros(F.lag(at).over(along)) / 1e6)


def json_lines(events: DataFrame) -> DataFrame:
    """One JSON object a line, null fields dropped, 0 and empty kept."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))
