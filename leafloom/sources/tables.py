"""Readers and writers: typed CSV, wide benchmarks, span caches, split manifests, triage folders, logs, manifests."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.functions.outputs import printed
from leafloom.operators import evaluate

# The columns of stored tables.
SWEEP = "fixture string, contrast double, psm int, char_sim double, word_recall double, seconds double"
ROUTER = "fixture string, backend string, combined_score double, word_count int, char_sim double"
FEATURES = "fixture string, stddev double, dark_pct double, interior_gutters int, width int, height int"
BASELINE = "backend string, page string, char_sim double, word_recall double"
SPAN_CACHE = "pages map<string, array<struct<text:string, bbox:array<double>, confidence:double>>>"
LOG = (
    "ts timestamp, run string, event string, file string, path string, suffix string, bytes long, pages long, backend string, "
    "seconds double, score double, chars long, words long, ok boolean, error string, outcome string, reason string, outputs array<string>"
)
RECORD = (
    "file string, stem string, reason string, held_at string, backend string, best struct<engine:string, score:double>, "
    "candidates array<struct<backend:string, score:double, transcript:string>>, version string"
)
# The columns of the manifest, in order.
MANIFEST = ["file", "status", "backend", "engine", "quality", "quality_gate", "transcript", "outputs", "location", "note", "run", "finished_at", "version"]
# Which suffixes each engine reads.
RASTER = [".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp"]
PDF_READERS = ["tesseract", "tesseract-auto", "paddle-vl", "marker", "claude", "claude-haiku", "auto-local"]
RASTER_READERS = ["vision", "easyocr", "easyocr-hy", "paddle"]


def scan(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """(path, content, suffix, stem) of the files whose lower-case suffix is listed; read lazily, content only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.withColumn("suffix", T.suffix(F.col("path"))).withColumn("stem", T.stem(F.col("path")))
    return named.where(F.col("suffix").isin(suffixes)).orderBy("path")


def unread(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """Files (path) that a run would leave out; hidden ones are not named."""
    return files.where(~T.suffix(F.col("path")).isin(suffixes) & ~F.startswith(T.file_name(F.col("path")), F.lit(".")))


def engine_suffixes(spark: SparkSession) -> DataFrame:
    rows = [(e, s) for e in PDF_READERS for s in [*RASTER, ".pdf"]] + [(e, s) for e in RASTER_READERS for s in RASTER]
    return spark.createDataFrame(rows, "engine string, suffix string")


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("enforceSchema", "false").csv(path, header=True)


def wide_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of a wide table; the engines come from the header."""
    return evaluate.long(spark.read.csv(path, header=True, nullValue="N/A"))


def baselines(spark: SparkSession, pattern: str) -> DataFrame:
    return typed_csv(spark, pattern, BASELINE).where("char_sim is not null and word_recall is not null")


def span_cache(spark: SparkSession, path: str) -> DataFrame:
    """(page, ord, text, l, t, r, b, confidence 0 to 100)."""
    pages = spark.read.schema(SPAN_CACHE).json(path, multiLine=True).select(F.explode("pages").alias("page", "spans"))
    spans = pages.select("page", F.posexplode("spans").alias("ord", "s"))
    box = [F.try_element_at("s.bbox", F.lit(i + 1)).alias(n) for i, n in enumerate("ltrb")]
    return spans.select("page", F.col("ord").cast("long").alias("ord"), "s.text", *box, (F.col("s.confidence") * 100).alias("confidence"))


def split_manifest(spark: SparkSession, content: str) -> DataFrame:
    """(split, role, stem) of a small TOML text: tables with `fit` and `held_out` lists, and top-level stem lists."""
    rows = []
    for name, value in tomllib.loads(content).items():
        entries = value.items() if isinstance(value, dict) else [(name, value)]
        rows += [(name, role, stem) for role, stems in entries if isinstance(stems, list) for stem in stems]
    return spark.createDataFrame(rows, "split string, role string, stem string")


def absent(spark: SparkSession, path: str) -> bool:
    """No file or folder of that name, in whatever store Spark reads it from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def triage_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a triage folder, as they are; none if there is no folder. For its items see folders.Triage."""
    if absent(spark, folder):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).option("pathGlobFilter", "*.json").json(folder, multiLine=True)


def log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def manifest_rows(rows: DataFrame) -> DataFrame:
    """The fixed columns as text: quality to four places, outputs joined by `;`. Unknown columns are refused."""
    unknown = set(rows.columns) - set(MANIFEST)
    if unknown:
        raise ValueError(f"not columns of the manifest: {sorted(unknown)}")
    shown = {"quality": F.when(F.col("quality").isNotNull(), printed(F.col("quality").cast("double"), 4)) if "quality" in rows.columns else None, "outputs": F.array_join("outputs", ";") if "outputs" in rows.columns else None}
    return rows.select(*[F.coalesce((shown[c] if c in shown else F.col(c)).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in MANIFEST])


def append_manifest(rows: DataFrame, path: str) -> None:
    """Append; refused before anything runs if the stored header differs."""
    spark = rows.sparkSession
    try:
        header = spark.read.csv(path, header=True).columns
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        header = MANIFEST
    if header != MANIFEST:
        raise ValueError(f"the stored manifest has other columns: {header}")
    manifest_rows(rows).write.mode("append").csv(path, header=True)


def bench_csv(long_scores: DataFrame, backends: list[str], path: str) -> None:
    """The wide benchmark with its Average row, as text cells."""
    table = evaluate.wide(long_scores, backends)
    means = [(F.sum if c.endswith("_sec") else F.avg)(c).alias(c) for c in table.columns if c != "fixture"]
    average = table.agg(*means).withColumn("fixture", F.lit("Average"))
    evaluate.rendered(table.unionByName(average)).coalesce(1).write.mode("overwrite").csv(path, header=True)


def pages_as_markdown(df: DataFrame, folder: str) -> None:
    """One row a document (stem, text), partitioned by stem so that each lands in a folder of its own."""
    df.select("stem", T.markdown_page(F.col("stem"), F.col("text")).alias("value")).write.mode("overwrite").partitionBy("stem").text(folder)
