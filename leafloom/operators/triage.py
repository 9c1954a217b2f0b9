"""The triage queue: records of files held back, their view, and files without a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.functions.outputs import printed


def records(candidates: DataFrame) -> DataFrame:
    """(file, best, candidates) of held files: `best` is the first candidate of highest raw score; with their texts, if given."""
    own = F.struct("engine_ord", "engine", "score", *(["text"] if "text" in candidates.columns else []))
    held = candidates.groupBy("file").agg(F.sort_array(F.collect_list(own)).alias("candidates"))
    best = F.array_min(F.transform("candidates", lambda c: F.struct((-c["score"]).alias("s"), c["engine_ord"].alias("o"), c["engine"].alias("engine"))))
    return held.withColumn("b", best).select("file", F.struct(F.col("b.engine").alias("engine"), (-F.col("b.s")).alias("score")).alias("best"), "candidates")


def refused(files: DataFrame, reason: str) -> DataFrame:
    """Records without candidates."""
    return files.select("file", F.lit(reason).alias("reason"), F.lit(0).alias("n_candidates"))


def manifest_text(held: DataFrame) -> DataFrame:
    """A line for each candidate: engine, score, excerpt."""
    line = lambda c: F.concat_ws(" | ", c["engine"], printed(c["score"], 4), T.excerpt(c["text"]))
    return held.select("file", F.array_join(F.transform("candidates", line), "\n").alias("body"))


def queue(records: DataFrame, manifests: DataFrame) -> DataFrame:
    """All records, and manifests that have no record, by stem."""
    only = manifests.join(records, "stem", "left_anti").select("stem", F.lit("no record").alias("reason"))
    return records.select("stem", "reason").unionByName(only).orderBy("stem")


def shown_score() -> Column:
    return F.when(F.col("best_score").isNull(), "–").otherwise(printed(F.col("best_score"), 4))


def described(items: DataFrame, folder: str) -> DataFrame:
    """(place, line): the queue (stem, file, best_engine, best_score, reason) as a table for the terminal, by stem; one line
    if it is empty. The width of the first column is that of the longest file name."""
    score = shown_score()
    known = items.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("file")), F.lit(0)).alias("width"))
    row = F.concat_ws("  ", F.rpad("file", F.col("width"), F.lit(" ")), F.lpad(score, 7, " "), F.rpad(F.coalesce("best_engine", F.lit("–")), 14, " "), F.coalesce("reason", F.lit("")))
    lines = items.crossJoin(F.broadcast(known)).select(F.lit(4).alias("part"), "stem", row.alias("line"))  # one row of facts
    title = F.when(F.col("n") == 0, F.format_string(f"The triage queue is empty ({folder}).")).otherwise(F.concat(F.col("n").cast("string"), F.lit(f" item(s) in {folder}")))
    rule = lambda n: F.repeat(F.lit("-"), n)
    names = F.concat_ws("  ", F.rpad(F.lit("File"), F.col("width"), F.lit(" ")), F.lit("   Best"), F.rpad(F.lit("Engine"), 14, " "), F.lit("Reason held"))
    dashes = F.concat_ws("  ", F.repeat(F.lit("-"), F.col("width").cast("int")), rule(7), rule(14), rule(11))
    head = F.when(F.col("n") == 0, F.array(title)).otherwise(F.array(title, F.lit(""), names, dashes))
    head = known.select(F.posexplode(head).alias("part", "line")).select("part", F.lit(None).cast(items.schema["stem"].dataType).alias("stem"), "line")
    return head.unionByName(lines).orderBy("part", "stem").select("part", "stem", "line")


def html_rows(items: DataFrame) -> DataFrame:
    """(stem, row): one table row of the queue page for each item (stem, file, best_engine, best_score, reason, held_at,
    n_candidates), by stem, all text escaped."""
    cell = lambda c: F.concat(F.lit("<td>"), T.html_escaped(F.coalesce(c, F.lit("–"))), F.lit("</td>"))
    number = lambda c: F.concat(F.lit('<td class="num">'), F.coalesce(c, F.lit("–")), F.lit("</td>"))
    file = F.concat(F.lit("<td><code>"), T.html_escaped(F.col("file")), F.lit("</code></td>"))
    held = F.when(F.col("held_at") != "", F.col("held_at"))
    cells = [file, number(shown_score()), cell(F.col("best_engine")), cell(F.col("reason")), cell(held), number(F.col("n_candidates").cast("string"))]
    return items.select("stem", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("row")).orderBy("stem")
