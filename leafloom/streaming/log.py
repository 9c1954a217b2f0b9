"""Live views over a growing JSON-lines log, and idempotent appends of finished files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafloom.sources.tables import LOG


def stream(spark: SparkSession, folder: str, schema: str = LOG, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)


def live_backend_seconds(events: DataFrame) -> DataFrame:
    """Count and total seconds by backend; state is one row a backend."""
    return events.where("event = 'backend_finish'").groupBy("backend").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))


def windowed_seconds(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An addition of ours: seconds by backend and time window, late events up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "backend").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))


def into_manifest(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished files; a batch that is repeated replaces its own partition, so no file is written twice."""

    def write(batch: DataFrame, epoch: int) -> None:
        done = batch.where("event = 'file_finish'").dropDuplicates(["run", "file"]).select("run", "file", "outcome", "backend", "score")
        done.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
