"""Operator 9, benchmark decontamination, in DataFrame functions only.

Size-partitioned MinHash containment search, in the form for small sets inside large ones: items are
sketched, and a document is asked which minima of a sketch it holds, as the equal coordinates of two
signatures tell nothing where one set is a hundredth of the other. Items are partitioned by the size
class of their shingle sets (powers of two). A class fixes the length of its sketches, the smallest
shingle hashes of an item, and with it how many of them a document has to hold: of n shingles at most
n - ceil(t * n) may be missing, so a sketch of that many and `extra` more has `extra` hits at least.
No item is lost. Larger classes ask for more hits. What meets is verified by the exact containment
of shingle sets.

Documents probe with every shingle. Up to `broadcast_rows` the sketch rows are sent to every executor;
beyond that a blocked Bloom filter of bounded size turns most shingles away, and the rest are joined by
shuffle, a hot shingle over several tasks.

Cases. Null or wordless texts have no shingle and match nothing. Fewer words than the shingle
length: the whole sequence is the one shingle. Repeated items: each is reported. Rows that share
a doc_id: one pair, with the best containment. Rows of null doc_id: told apart by their texts, each
text reported once with a null id, and all its rows removed by `clean`. Items of null item_id take
no part in pairs but clean like the others. Extra columns of either table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import bloom
from leafloom.llm.common import let, table, unused, written

#: Words are runs of letters and digits of the lower-case text.
BREAK = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def run_at(w: Column, i: Column, length: int) -> Column:
    """The words from i on, joined. Element by element: slice() would copy the whole array each time."""
    return F.concat_ws(" ", *[w[i + k] for k in range(length)])


def shingles(tokens: Column, length: int) -> Column:
    """Distinct runs of `length` words; all words as one run, if there are fewer."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        found = F.transform(F.sequence(F.lit(0), n - length), lambda i: run_at(w, i, length))
        whole = F.array(F.array_join(w, " "))
        return F.when(n >= length, F.array_distinct(found)).when(n > 0, whole).otherwise(F.expr("cast(array() as array<string>)"))

    return let(tokens, runs)


def size_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def sketched_items(items: DataFrame, length: int, threshold: float) -> DataFrame:
    """(item, item_id, shingles, n_item, size_class, sketch, hits): an item's sketch and how many of it a text must hold."""
    sets = items.select("item_id", shingles(words(F.col("text")), length).alias("shingles")).where(F.size("shingles") > 0)
    sets = sets.withColumn("n_item", F.size("shingles")).withColumn("size_class", size_class(F.col("n_item")))
    missing = lambda n: n - F.ceil(F.lit(threshold) * n - 1e-9)
    extra = F.greatest(F.lit(1), F.col("size_class"))
    longest = (missing(F.pow(F.lit(2.0), F.col("size_class") + 1) - 1) + extra).cast("int")
    hashes = F.array_sort(F.transform("shingles", lambda s: F.xxhash64(s)))
    sketched = sets.withColumn("sketch", F.slice(hashes, F.lit(1), longest))
    # An item is named by its content, so that equal items are probed and verified once.
    item = F.xxhash64(F.array_sort("shingles")).alias("item")
    return sketched.select(item, "*", (F.size("sketch") - missing(F.col("n_item"))).cast("int").alias("hits"))


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, text): rows of null doc_id are named by their text."""
    doc_key = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).otherwise("")
    return docs.select(F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("doc_id"), doc_key.alias("doc_key"), "text")


def probes(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, doc_key, n_runs, h): the hash of every shingle."""
    tokens = docs.select("doc_id", "doc_key", words(F.col("text")).alias("w"))
    run = F.when(F.size("w") >= length, run_at(F.col("w"), F.col("i"), length)).otherwise(F.array_join("w", " "))
    n_runs = F.greatest(F.size("w") - length + 1, F.lit(1))
    each = tokens.select("doc_id", "doc_key", "w", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), n_runs - 1))).alias("i"))
    return each.select("doc_id", "doc_key", n_runs.alias("n_runs"), F.xxhash64(run).alias("h"))


def matches(docs: DataFrame, items: DataFrame, threshold: float, length: int, broadcast_rows: int, salts: int = 16) -> DataFrame:
    """(doc_id, doc_key, item, n_item, n_shared) of documents as `named` and distinct sketched items."""
    sketch = items.select("item", "n_item", "hits", F.explode("sketch").alias("h"))
    asked = probes(docs, length)
    if sketch.count() <= broadcast_rows:
        met = asked.join(F.broadcast(sketch), "h")
    else:
        asked = bloom.passed(asked, sketch.select("h"), "h")
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "doc_key"), F.lit(salts)).cast("int"))
        met = asked.join(sketch.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["h", "salt"])
    met = met.where(F.col("n_runs") >= F.ceil(threshold * F.col("n_item") - 1e-9))
    met = met.select("doc_id", "doc_key", "item", "hits", "h").distinct()
    pairs = met.groupBy("doc_id", "doc_key", "item").agg(F.count("*").alias("n"), F.max("hits").alias("hits")).where("n >= hits")
    pairs = written(pairs.select("doc_id", "doc_key", "item"), "contained")  # read twice: else the documents are probed twice
    wanted = pairs.join(items.select("item", "shingles", "n_item"), "item")
    sets = docs.join(pairs.select("doc_id", "doc_key").distinct(), ["doc_id", "doc_key"])
    sets = sets.select("doc_id", "doc_key", shingles(words(F.col("text")), length).alias("held"))
    shared = wanted.join(sets, ["doc_id", "doc_key"])
    shared = shared.select("doc_id", "doc_key", "item", "n_item", F.size(F.array_intersect("shingles", "held")).alias("n_shared"))
    exact = shared.where(F.col("n_shared") >= F.ceil(threshold * F.col("n_item") - 1e-9))
    return exact.groupBy("doc_id", "doc_key", "item").agg(F.max("n_shared").cast("long").alias("n_shared"), F.max("n_item").cast("long").alias("n_item"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, length: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of each item whose shingles a document holds to at least `threshold`."""
    sketched = sketched_items(items, length, threshold)
    found = matches(named(docs), sketched.dropDuplicates(["item"]), threshold, length, broadcast_rows)
    out = found.join(sketched.where("item_id is not null").select("item", "item_id").distinct(), "item")
    return out.select(F.when(F.col("doc_key") == "", F.col("doc_id")).alias("doc_id"), "item_id", "n_shared", "n_item")


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, length: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """The documents that hold no item, with their columns; of null doc_id, those whose text holds none."""
    sketched = sketched_items(items, length, threshold).dropDuplicates(["item"])
    gone = matches(named(docs), sketched, threshold, length, broadcast_rows).select("doc_id", "doc_key").distinct()
    own, key = unused(docs, "own_id"), unused(docs, "own_key")
    kept = docs.withColumn(own, F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)))
    kept = kept.withColumn(key, F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).otherwise(""))
    gone = gone.select(F.col("doc_id").alias(own), F.col("doc_key").alias(key))
    return kept.join(gone, [own, key], "left_anti").select(*docs.columns)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM b WHERE len(w) > 0),
bn AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment
FROM hit JOIN bn USING (item_id) WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
"""
