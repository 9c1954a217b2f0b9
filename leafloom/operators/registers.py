"""Comparing engines over registers of pages without letting missing pages flatter one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def engine_means(pages: DataFrame) -> DataFrame:
    """(register, engine, chr, wrd, pages) over the pages that did not fail."""
    return (
        pages.where("chr is not null")
        .groupBy("register", "engine")
        .agg(F.avg("chr").alias("chr"), F.avg("wrd").alias("wrd"), F.sort_array(F.collect_set("page")).alias("pages"))
    )


def complete_engines(pages: DataFrame) -> DataFrame:
    """Engines that have, in every register, each page that any engine has there (relational division)."""
    read = pages.where("chr is not null").select("engine", "register", "page").distinct()
    wanted = read.select("register", "page").distinct().agg(F.count("*").alias("all"))
    have = read.groupBy("engine").agg(F.count("*").alias("n"))
    return have.join(F.broadcast(wanted), F.col("n") == F.col("all")).select("engine")


def comparison(pages: DataFrame, ours: str) -> DataFrame:
    """Means by register of the complete engines, and a `mean` row: the mean of the registers, not of the pages."""
    kept = engine_means(pages).join(F.broadcast(complete_engines(pages)), "engine").drop("pages")
    overall = kept.groupBy("engine").agg(F.avg("chr").alias("chr"), F.avg("wrd").alias("wrd")).withColumn("register", F.lit("mean"))
    return kept.unionByName(overall).withColumn("is_ours", F.col("engine") == ours)


def leaders(scores: DataFrame, metric: str, order: list[str] | None = None) -> DataFrame:
    """The engine with the highest metric by register. Ties: the first in the engines' `order`, those it lacks last; by
    name without one."""
    place = F.array_position(F.array(*map(F.lit, order or [""])), F.col("engine"))
    tie = F.struct(F.when(place > 0, place).otherwise(len(order or []) + 1).alias("p"), "engine")
    best = scores.groupBy("register").agg(F.min(F.struct((-F.col(metric)).alias("m"), tie.alias("t"))).alias("b"))
    return best.select("register", F.col("b.t.engine").alias("leader"), (-F.col("b.m")).alias("best"))
