"""Inputs derived from the star-schema and document tables, once as DataFrames and once as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.operators.route import dealt


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table that is read in fewer parts than there are cores, dealt over the cores; larger tables as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


ENGINES = ["full", "half", "lower", "garbled", "reversed"]


def candidates(docs: DataFrame, key: str = "doc_id", also: list[str] | None = None, spread_out: bool = True) -> DataFrame:
    """(file, engine_ord, engine, text): five transcripts of every document, with other columns of it. Without
    `spread_out`: the documents are dealt already."""
    t = F.col("text")
    texts = [
        t,
        F.left(t, F.floor(F.length(t) / 2).cast("int")),
        F.lower(t),
        F.translate(t, "eao", "c0q"),
        F.when(F.col(key) % 7 == 0, "").otherwise(F.reverse(t)),
    ]
    each = F.array(*[F.struct(F.lit(i).alias("engine_ord"), F.lit(ENGINES[i]).alias("engine"), x.alias("text")) for i, x in enumerate(texts)])
    return (spread(docs, key) if spread_out else docs).select(F.col(key).alias("file"), *(also or []), F.explode(each).alias("c")).select("file", *(also or []), "c.*")


def candidates_sql(source: str = "documents", key: str = "doc_id") -> str:
    texts = ["text", "left(text, length(text) // 2)", "lower(text)", "translate(text, 'eao', 'c0q')", f"CASE WHEN {key} % 7 = 0 THEN '' ELSE reverse(text) END"]
    return " UNION ALL ".join(f"SELECT {key} AS file, {i} AS engine_ord, '{ENGINES[i]}' AS engine, {x} AS text FROM {source}" for i, x in enumerate(texts))


LEXICON_SQL = "SELECT word, count(*) AS n FROM (SELECT unnest(list_transform(list_filter(regexp_extract_all(text, '[a-zA-Z]+'), lambda w: length(w) >= 2), lambda w: lower(w))) AS word FROM documents) GROUP BY word"

WS_SQL = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS_SQL}'), lambda w: w <> '')"


def normalise_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(translate(lower({x}), '։․', ':.'), 'եւ', 'և'), '{WS_SQL}', ' ', 'g'))"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS_SQL}', ''), '{WS_SQL}$', '')"


def telemetry(events: DataFrame) -> DataFrame:
    """backend_finish events: run (a day), backend, file, seconds, outcome."""
    return events.select(
        F.date_format("ts", "yyyyMMdd").alias("run"),
        F.col("event_type").alias("backend"),
        F.col("user_id").alias("file"),
        F.col("event_id"),
        F.col("ts"),
        F.col("value").alias("seconds"),
        F.when(F.col("event_id") % 11 == 0, "error").when(F.col("event_id") % 5 == 0, "triaged").when(F.col("event_id") % 17 == 0, "refused").otherwise("processed").alias("outcome"),
    )


TELEMETRY_SQL = (
    "SELECT strftime(ts, '%Y%m%d') AS run, event_type AS backend, user_id AS file, event_id, ts, value AS seconds, "
    "CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'triaged' WHEN event_id % 17 = 0 THEN 'refused' ELSE 'processed' END AS outcome FROM events"
)

# The grid of settings.
CONTRASTS, PSMS = [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0], [1, 3, 4, 6, 11, 12]


#: Parts whose cells one task makes.
SWEPT = 10_000


def sweep(part: DataFrame, also: list[str] | None = None) -> DataFrame:
    """(fixture, contrast, psm, char_sim, word_recall, seconds, stddev, dark_pct): 42 cells a part, and other columns of it.

    The parts are dealt by their key first: 42 cells of each row are many for a table that is few bytes, and the cells of
    a part then stay together.
    """
    also = also or []
    part = dealt(part.select("p_partkey", "p_size", "p_retailprice", *also), "p_partkey", SWEPT)
    grid = F.explode(F.array(*[F.struct(F.lit(c).alias("contrast"), F.lit(p).alias("psm")) for c in CONTRASTS for p in PSMS]))
    cells = part.select(F.col("p_partkey").alias("fixture"), "p_size", "p_retailprice", *also, grid.alias("g")).select("fixture", "p_size", "p_retailprice", *also, "g.*")
    k = (F.col("fixture") * 31 + F.col("psm") * 17 + F.col("contrast") * 10 * 7) % 101
    return cells.select(
        "fixture", "contrast", "psm", (k / 100).alias("char_sim"), (((k * 3) % 97) / 100).alias("word_recall"), (k / 10).alias("seconds"),
        (F.col("p_retailprice") / 20).alias("stddev"), F.col("p_size").cast("double").alias("dark_pct"), *also,
    )


SWEEP_SQL = (
    "SELECT fixture, contrast, psm, k / 100 AS char_sim, ((k * 3) % 97) / 100 AS word_recall, k / 10 AS seconds, stddev, dark_pct FROM ("
    "SELECT p_partkey AS fixture, contrast, psm, CAST((p_partkey * 31 + psm * 17 + contrast * 10 * 7) % 101 AS DOUBLE) AS k, p_retailprice / 20 AS stddev, CAST(p_size AS DOUBLE) AS dark_pct "
    "FROM part, (SELECT CAST(unnest([1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0]) AS DOUBLE) AS contrast), (SELECT unnest([1, 3, 4, 6, 11, 12]) AS psm))"
)


def engine_pages(orders: DataFrame) -> DataFrame:
    """(register, engine, page, chr, wrd): scores of pages, some failed (null)."""
    o = orders.select(
        F.col("o_orderpriority").alias("register"), F.col("o_orderstatus").alias("engine"), (F.col("o_custkey") % 20).alias("page"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice") % 100 / 100).alias("chr"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice") % 37 / 37).alias("wrd"),
    )
    return o.where(~((F.col("engine") == "P") & (F.col("page") == 7)))


ENGINE_PAGES_SQL = (
    "SELECT * FROM (SELECT o_orderpriority AS register, o_orderstatus AS engine, o_custkey % 20 AS page, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice % 100 / 100 END AS chr, "
    "CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice % 37 / 37 END AS wrd FROM orders) WHERE NOT (engine = 'P' AND page = 7)"
)
