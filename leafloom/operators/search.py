"""Ranking of index entries for a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(entries: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """The best entries (ord, title, section, url, text): each term scores 10 in the title, else 4 in the section, else
    1 in the text; an entry that lacks a term is out. Ties: index order. The limit is the feature."""
    terms = query.strip().lower().split()
    if not terms:
        return entries.limit(0).withColumn("score", F.lit(0))
    has = lambda c, t: F.lower(F.col(c)).contains(t)
    each = [F.when(has("title", t), 10).when(has("section", t), 4).when(has("text", t), 1).otherwise(0) for t in terms]
    scored = entries.withColumn("score", sum(each[1:], each[0]))
    for part in each:
        scored = scored.where(part > 0)
    return scored.select("ord", "title", "url", "score").orderBy(F.desc("score"), "ord").limit(limit)


def index(pages: DataFrame) -> DataFrame:
    """(entry): the search index as JSON objects, of the pages (title, section, url, text, private) that are not private."""
    public = pages.where(~F.coalesce(F.col("private"), F.lit(False)))
    return public.select(F.to_json(F.struct("title", "section", "url", "text")).alias("entry"))


def advisories(records: DataFrame, base: str) -> DataFrame:
    """(date, slug, record): each record (date, slug, fields) as JSON with the url of its page added, the newest first."""
    merged = F.map_concat("fields", F.create_map(F.lit("url"), F.concat(F.lit(base), F.col("slug"), F.lit("/"))))
    return records.select("date", "slug", F.to_json(merged).alias("record")).orderBy(F.desc("date"), "slug")
