"""The batch: admission, routing, gate, formats and manifest rows of all files in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from leafloom.functions import outputs, rules
from leafloom.operators import route


def processed(files: DataFrame, scored: DataFrame, formats: str | None = None) -> DataFrame:
    """A row for each of `files` (file, path, width, height, pages) from scored candidates: engine, quality, quality_gate,
    status, outputs, location, note. Refused files are not routed; files without a candidate are errors."""
    checked = files.withColumn("note", rules.refused_reason(F.col("width"), F.col("height"), F.col("pages")))
    won = route.routed(scored.join(checked.where("note is null").select("file"), "file", "left_semi"))
    rows = checked.join(won.select("file", "engine", "quality", "quality_gate"), "file", "left")
    rows = rows.withColumn("status", outputs.status(F.col("note"), F.col("engine"), F.col("quality_gate")))
    names = F.transform(outputs.formats(F.lit(formats)), lambda f: outputs.output_name(F.col("path"), f))
    done = F.when(F.col("status") == "processed", names).otherwise(F.expr("cast(array() as array<string>)"))
    note = F.when(F.col("status") == "error", "no engine read the file").otherwise(F.col("note"))
    return rows.select(
        "file", "status", "engine", "quality", F.coalesce("quality_gate", F.lit("skipped")).alias("quality_gate"),
        done.alias("outputs"), outputs.location(F.col("status")).alias("location"), note.alias("note"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """(status, files, outputs) of a batch."""
    return rows.groupBy("status").agg(F.count("*").alias("files"), F.sum(F.size("outputs")).alias("outputs"))


def outcome(status: Column) -> Column:
    """How the log calls a status."""
    return F.when(status == "triage", "triaged").otherwise(status)


def log_rows(rows: DataFrame, run: str, at: Column | None = None) -> DataFrame:
    """(ts, run, event, file, backend, outcome, reason, score, outputs): two events for each row of `processed`, from the
    same row: its start, and its finish with what became of it. Refused files have no engine, so no score."""
    none = lambda kind: F.lit(None).cast(kind)
    event = lambda name, *fields: F.struct(F.lit(name).alias("event"), *[v.alias(n) for n, v in zip(("outcome", "reason", "score", "outputs"), fields, strict=True)])
    start = event("file_start", none("string"), none("string"), none("double"), none("array<string>"))
    done = F.when(F.size("outputs") > 0, F.col("outputs"))
    finish = event("file_finish", outcome(F.col("status")), F.col("note"), F.col("quality"), done)
    stamp = F.current_timestamp() if at is None else at
    each = rows.select(stamp.alias("ts"), F.lit(run).alias("run"), F.col("file").cast("string").alias("file"), F.col("engine").alias("backend"), F.explode(F.array(start, finish)).alias("e"))
    return each.select("ts", "run", "e.event", "file", "backend", "e.outcome", "e.reason", "e.score", "e.outputs")


def write_run(rows: DataFrame, folder: str, run: str) -> dict[str, int]:
    """Write the rows of `processed` as one run: file rows, the manifest, and the log with its start and finish of the run.

    The totals are observed while the file rows are written; nothing is read or routed again for them. A run that is
    written again replaces its own file rows; manifest and log are append-only, as they are records of what was done.
    """
    from leafloom.sources import runs, tables

    seen = Observation(f"run-{run}")
    is_ = lambda *status: F.count_if(F.col("status").isin(*status))
    counts = [F.count("*").alias("files"), is_("processed").alias("processed"), is_("triage", "refused").alias("triaged"), is_("error").alias("errors")]
    runs.keep(rows.observe(seen, *counts), f"{folder}/files", run)
    totals = {k: int(v) for k, v in seen.get.items()}
    spark = rows.sparkSession
    stored = spark.read.schema(f"{_ddl(rows)}, run_id string").parquet(f"{folder}/files").where(F.col("run_id") == run)
    own = stored.select(F.col("file").cast("string").alias("file"), "status", "engine", "quality", "quality_gate", "outputs", "location", "note", F.lit(run).alias("run"))
    tables.append_manifest(own, f"{folder}/manifest")
    ends = spark.createDataFrame([(run, "run_start", None), (run, "run_finish", totals)], "run string, event string, totals map<string,bigint>")
    ends = ends.select(F.current_timestamp().alias("ts"), "run", "event", *[F.try_element_at("totals", F.lit(k)).alias(k) for k in totals])
    log = log_rows(stored, run).unionByName(ends, allowMissingColumns=True)
    log.write.mode("append").json(f"{folder}/log")
    return totals


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
