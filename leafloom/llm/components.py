"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, component) of every id in `links` (a, b); component is the smallest id reachable.

    The neighbours of an id are never gathered: each step is an aggregate and a join. The driver sees one count and
    one checksum a round. Rounds go on until the edges repeat: stars only ever move to smaller ids, so they do.
    """
    written = (scratch or Scratch(links.sparkSession)).written
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    last = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or state[0] == 0:
            break
        last = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        edges = written(small.where("u <> v").distinct(), "edges")
    ids = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return ids.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct().join(ids.select("id"), "id", "left_anti"))
