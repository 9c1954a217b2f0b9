"""Scoring and routing: which engine's transcript of a file is kept, and whether it is good enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType

from leafloom.functions import rules
from leafloom.functions import text as T
from leafloom.operators import lookup

#: A vocabulary larger than this is joined by shuffle instead of being sent to every executor.
BROADCAST_WORDS = 2_000_000


def sized(df: DataFrame, most: int = BROADCAST_WORDS) -> DataFrame:
    """Mark for broadcast if it has at most `most` rows; counted first."""
    return F.broadcast(df) if df.count() <= most else df


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows dealt by a key over as many parts as leave each about `rows` of them, however few files or bytes they come
    from: what a task holds does not grow with the table. What is made of a row later stays beside its key."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)


#: Files whose texts are looked up together, and characters of them where their length is asked for.
BLOCK_FILES, BLOCK_CHARS = 1000, 1 << 23


def in_blocks(rows: DataFrame, key: str, each: int = BLOCK_FILES, text: str | None = None) -> tuple[DataFrame, int]:
    """Rows with a `block`, dealt by it, and the number of blocks: about `each` of them share one, and of their column `text`
    about BLOCK_CHARS characters at most."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # a join by block and word stays in the block
    count, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0)) if text else F.lit(0)).first()
    n = max(spark.sparkContext.defaultParallelism, -(-count // each), -(-chars // BLOCK_CHARS))
    return rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartition(n, "block"), n


def met_in_blocks(facts: DataFrame, table: DataFrame, keys: list[str], blocks: int, asked: Column | None = None) -> DataFrame:
    """`facts`, dealt by their `block`, with the columns of `table` (one row a key), null where it has none or they do not ask.

    Facts stay where they are, in their order. What leaves a block is each of its keys once, what comes back the rows found.
    """
    wanted = facts if asked is None else facts.where(asked)
    told = wanted.select("block", *keys).dropna().distinct().join(table, keys)
    return facts.join(told.repartition(blocks, "block").hint("shuffle_hash"), ["block", *keys], "left")


def with_counts(words: DataFrame, lexicon: DataFrame, total: int, size: int, most: int = BROADCAST_WORDS) -> DataFrame:
    """Add `n`, how often the lexicon has the `word`, null if never.

    A lexicon of more than `most` words is joined in two: its frequent words, of which there can be no more than `most`,
    are broadcast, as they are the hot keys; the rest meets the rare words by shuffle.
    """
    if size <= most:
        return words.join(F.broadcast(lexicon), "word", "left")
    bound = total / most
    known = words.join(F.broadcast(lexicon.where(F.col("n") > bound)), "word", "left")
    rare = known.where("n is null").drop("n").join(lexicon.where(F.col("n") <= bound), "word", "left")
    return known.where("n is not null").unionByName(rare)


def quality_scores(candidates: DataFrame, lexicon: DataFrame, most_tokens: int = 1024, perplexities: DataFrame | None = None, blocks: int | None = None, most: int = BROADCAST_WORDS) -> DataFrame:
    """(file, engine_ord, engine, words, english, n_tokens, n_unknown, coverage, perplexity, score) of candidates (file, engine_ord, engine, text).

    Coverage: a repeated unknown word costs once. Perplexity: an add-one unigram model of the lexicon stands in for a
    neural scorer; the first `most_tokens` tokens, as those are all such a scorer reads, and 1000 below five tokens.
    A scorer's `perplexities` (file, engine_ord, perplexity; scorer.py) take its place.
    Score: coverage / log1p(perplexity), 0 for blank texts.

    `blocks`: that candidates are dealt by their column `block` already, in so many parts.

    A text becomes numbers in numpy, beside the other texts of its block; what leaves a block is each code of its tokens once, and
    what comes back those that the lexicon has (lookup.py). Their logarithms are added exactly: texts of the same tokens have the
    same score. A lexicon (word, n), or (code, n) as `lookup.lexicon` makes it, is broadcast if it has at most `most` rows.
    """
    lexicon = (lexicon if "code" in lexicon.columns else lookup.coded(lexicon)).persist()  # two numbers a word: counted here and looked up below
    total, size = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if blocks is None:
        candidates, blocks = in_blocks(candidates, "file", BLOCK_FILES * 5, "text")
    log_p = lambda n: F.log((n + 1) / float(total + size + 1)).alias("log_p")
    known = lexicon.where("code is not null").select("code", log_p(F.col("n")))
    unseen = lexicon.sparkSession.range(1).select(log_p(F.lit(0))).first()[0]
    asked = candidates.select("block", "text").mapInArrow(lookup.asked, "block int, code long")
    told = asked.join(F.broadcast(known) if size <= most else known, "code").repartition(blocks, "block")
    facts = candidates.select("block", "file", "engine_ord", "engine", "text")
    schema = facts.drop("block", "text").schema.add("words", IntegerType()).add("english", BooleanType()).add("n_tokens", IntegerType())
    schema = schema.add("n_unknown", LongType()).add("mean_log", DoubleType())
    sums = facts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lookup.summed(unseen, most_tokens), schema)
    n = F.col("n_tokens")
    coverage = F.when(n == 0, 0.0).otherwise((n - F.col("n_unknown")) / n)
    perplexity = F.when(n < 5, 1000.0).otherwise(F.exp(-F.col("mean_log")))
    out = sums.withColumn("coverage", coverage)
    out = out.withColumn("perplexity", perplexity) if perplexities is None else out.join(perplexities.select("file", "engine_ord", "perplexity"), ["file", "engine_ord"], "left")
    score = F.when(F.col("words") == 0, 0.0).otherwise(F.col("coverage") / F.log1p("perplexity"))
    return out.select("file", "engine_ord", "engine", "words", "english", "n_tokens", "n_unknown", "coverage", "perplexity", score.alias("score"))


def eligible(engines: DataFrame, files: DataFrame, gpu: bool = False, opted_in: tuple[str, ...] = ()) -> DataFrame:
    """(file, engine, engine_ord) pairs: the suffix is readable, heavy engines only with a GPU, some only when asked for."""
    able = engines.where((~F.col("needs_gpu") | F.lit(gpu)) & (~F.col("opt_in") | F.col("engine").isin(list(opted_in))))
    return files.join(F.broadcast(able), F.array_contains(able["suffixes"], files["suffix"])).select("file", "engine", "engine_ord")


def effective(candidates: DataFrame, weight: float | Column = rules.SCORE_WEIGHT) -> DataFrame:
    """Add the effective score: the raw score weighed with the length against the longest candidate of the file."""
    most = candidates.groupBy("file").agg(F.greatest(F.max("words"), F.lit(1)).alias("max_words"))
    return candidates.join(most, "file").withColumn("effective", rules.effective_score(F.col("score"), F.col("words"), F.col("max_words"), weight))


def routed(candidates: DataFrame, asked: bool = True) -> DataFrame:
    """One row a file: the engine with the highest effective score (ties: the first), gated on its raw score.

    Candidates are as `quality_scores` leaves them, or have a text instead of `english`.

    One aggregate gathers the few candidates of a file; the winner comes from that array, without a second shuffle.
    """
    english = F.col("english") if "english" in candidates.columns else T.scores_english_text(F.col("text"))
    row = F.struct("engine_ord", "engine", "words", "score", english.alias("english"))
    each = candidates.groupBy("file").agg(F.collect_list(row).alias("c"), F.greatest(F.max("words"), F.lit(1)).alias("m"))
    ranked = F.transform(
        "c", lambda c: F.struct((-rules.effective_score(c["score"], c["words"], F.col("m"))).alias("e"), c["engine_ord"].alias("o"), c.alias("c"))
    )
    best = each.select("file", F.array_min(ranked).alias("b")).select("file", (-F.col("b.e")).alias("effective"), "b.c.*")
    verdict = rules.gate(F.col("score"), F.col("english"), asked)
    return best.withColumn("quality_gate", verdict).select(
        "file", "engine", "words", F.round("effective", 6).alias("effective"),
        F.when(F.col("quality_gate") == "skipped", None).otherwise(F.round("score", 6)).alias("quality"), "quality_gate",
        F.when(F.col("quality_gate") == "failed", "triage").otherwise("processed").alias("status"),
    )


def surviving(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates whose engine succeeded, and the files of which none did."""
    failed = candidates.groupBy("file").agg(F.count_if("ok").alias("n")).where("n = 0").select("file")
    return candidates.where("ok"), failed


def best_marked(scores: DataFrame, group: str, metric: str, excluded: list[str]) -> DataFrame:
    """Add is_best: every engine that ties for the best of its group, some engines left out."""
    top = scores.where(~F.col("engine").isin(excluded)).groupBy(group).agg(F.max(metric).alias("top"))
    marked = scores.join(top, group, "left")
    return marked.withColumn("is_best", F.coalesce((F.col(metric) == F.col("top")) & ~F.col("engine").isin(excluded), F.lit(False))).drop("top")
