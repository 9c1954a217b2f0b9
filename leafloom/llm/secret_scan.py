"""Operator 7, secret scans, in DataFrame functions only.

Three fixed patterns give base spans. Two character Markov models, one of random strings and one
of ordinary identifiers, are counted from labelled samples; long tokens whose log-likelihood
ratio per character passes a threshold are added as `markov` spans. Random samples are digests in
several alphabets, beside the values of base spans; ordinary ones are names, constants, paths and
versions made of the words of documents. The threshold is the ratio that all but one in a thousand
of the ordinary samples that the models were not counted from stay below.

Cases. Null text: no span, and the hash of the empty text. Repeated rows: each is scanned. Ties
in position: the order of KINDS. Extra columns: `scan` keeps all, and its own column `spans`
replaces one of that name; `redact` touches text and n_chars only. Empty sample of either class: no markov span. Cost in one text is quadratic only in the number of its matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import bounded_sample, table, unused

# The kinds in their order, their patterns, and lower-case texts one of which any assignment holds.
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def pattern_spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches; those whose `group` is shorter than `least` are dropped.

    What lies between the matches comes from split(), so starts are running sums of lengths in code points.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), values.alias("value"))
    begin = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["value"].alias("value"))
        keep = part["hit"].isNotNull() & (F.length(part["value"]) >= least)
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    spans = F.aggregate(parts, begin, step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def base_spans(text: Column) -> Column:
    """The spans of the three fixed patterns, by start and then kind."""
    none = F.expr(f"cast(array() as {SPAN})")
    lowered = F.lower(text)
    holds = lowered.contains(ASSIGN_WORDS[0])
    for word in ASSIGN_WORDS[1:]:
        holds = holds | lowered.contains(word)
    return F.array_sort(
        F.concat(
            F.when(holds, pattern_spans(text, ASSIGN, 0, group=2, least=6)).otherwise(none),
            F.when(text.contains("AKIA"), pattern_spans(text, ACCESS, 1)).otherwise(none),
            F.when(text.rlike(HEX), pattern_spans(text, HEX, 2)).otherwise(none),
        )
    )


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """(value, kind): digests of the numbers below n, 20 to 43 characters, in five alphabets."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    forms = {"base62": F.translate(base64, "+/=", "aZ0"), "base64": base64, "base64url": F.translate(base64, "+/", "-_"), "hex": digest, "HEX": F.upper(digest)}
    of = F.array(*[F.struct(F.substring(v, F.lit(1), (F.col("id") % 24 + 20).cast("int")).alias("value"), F.lit(k).alias("kind")) for k, v in forms.items()])
    return spark.range(n).select(F.inline(of))


def identifiers(texts: DataFrame) -> DataFrame:
    """(value, kind): every three words of a text as a name, a constant, a path or a version, by turns."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w.rlike("^[A-Za-z]{2,12}$"))

    def name(w: Column, i: Column) -> Column:
        a, b, c = (F.get(w, (i * 3 + k).cast("int")) for k in range(3))
        number = F.pmod(F.xxhash64(a, b, c), F.lit(100_000)).cast("string")
        forms = [
            ("snake", F.concat_ws("_", a, b, c)), ("numbered", F.concat_ws("_", a, b, c, number)), ("camel", F.concat(F.lower(a), F.initcap(b), F.initcap(c), F.substring(number, 1, 2))),
            ("constant", F.upper(F.concat_ws("_", a, b, c, number))), ("path", F.concat(F.lit("/"), F.concat_ws("/", a, b, c, number))),
            ("version", F.concat(F.concat_ws("-", a, b, c), F.lit("-"), F.substring(number, 1, 1), F.lit("_"), F.substring(number, 2, 2))),
        ]
        return F.get(F.array(*[F.struct(v.alias("value"), F.lit(k).alias("kind")) for k, v in forms]), F.pmod(F.xxhash64(a, b, c, i), F.lit(len(forms))).cast("int"))

    made = lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / 3).cast("int") - 1), lambda i: name(w, i))
    each = texts.select(words.alias("w")).where(F.size("w") >= 3)
    return each.select(F.inline(made(F.col("w"))))


def labelled_samples(docs: DataFrame, cap: int = 20_000) -> DataFrame:
    """(value, kind, label): random strings (1) are digests and the values of base spans of about `cap` documents; ordinary
    identifiers (0) are made of these documents' words."""
    texts = bounded_sample(docs.select("doc_id", "text").where(F.col("text").isNotNull()), "doc_id", cap)
    found = texts.select(F.explode(base_spans(F.col("text"))).alias("s")).select(F.col("s.value").alias("value"), F.lit("found").alias("kind"))
    randoms = random_strings(docs.sparkSession, 2_000).unionByName(found).withColumn("label", F.lit(1))
    return randoms.unionByName(identifiers(texts).withColumn("label", F.lit(0))).where(F.col("value").rlike(r"^[A-Za-z0-9+/_=-]{2,}$"))


def held_out() -> Column:
    """Samples from which the threshold is taken, not the models; equal ones are on one side."""
    return F.pmod(F.xxhash64("value"), F.lit(5)) == 0


def fitted(docs: DataFrame, cap: int = 20_000, false_alarms: float = 0.001) -> tuple[list[float], float]:
    """The models as log ratios, and the threshold: that quantile of the held-out ordinary samples, 0 at least."""
    samples = labelled_samples(docs, cap)
    model = fit_markov(samples.where(~held_out()))
    ordinary = samples.where(held_out() & (F.col("label") == 0) & (F.length("value") >= 20))
    bound = ordinary.agg(F.percentile_approx(log_ratio(F.col("value"), model), 1 - false_alarms, 100_000)).first()[0]
    return model, max(bound or 0.0, 0.0)


def quality(samples: DataFrame, model: list[float], threshold: float) -> DataFrame:
    """(kind, label, samples, called): how many of the held-out samples of 20 characters or more are called random."""
    rows = samples.where(held_out() & (F.length("value") >= 20))
    called = F.count_if(log_ratio(F.col("value"), model) > threshold)
    return rows.groupBy("kind", "label").agg(F.count("*").alias("samples"), called.alias("called"))


def fit_markov(samples: DataFrame, smoothing: float = 0.5, backoff: float = 5.0) -> list[float]:
    """Log ratio of the transition probabilities, row by row of the alphabet; all 0 if a class has no sample.

    Transitions from characters that a class has seldom seen back off to how often it has the next character at all.

    Only the counts of character pairs, bounded by the alphabet, reach the driver.
    """
    size = len(ALPHABET)
    pairs = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))
    counted = (
        samples.where(F.length("value") >= 2)
        .select("label", F.explode(pairs).alias("pair"))
        .where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$"))
        .groupBy("label", "pair")
        .count()
        .collect()
    )
    counts = {label: [[0.0] * size for _ in range(size)] for label in (0, 1)}
    seen = set()
    for label, pair, n in counted:
        counts[label][ALPHABET.index(pair[0])][ALPHABET.index(pair[1])] += n
        seen.add(label)
    if seen != {0, 1}:
        return [0.0] * (size * size)
    logs = {}
    for label, rows in counts.items():
        single = [sum(row[b] for row in rows) + smoothing for b in range(size)]
        total = sum(single)
        logs[label] = [math.log((row[b] + backoff * single[b] / total) / (sum(row) + backoff)) for row in rows for b in range(size)]
    return [x - y for x, y in zip(logs[1], logs[0], strict=True)]


def log_ratio(value: Column, model: list[float]) -> Column:
    """Mean log ratio of a token's transitions."""
    size = len(ALPHABET)
    weights = F.lit(model)
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1)))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(value) - 1),
        F.lit(0.0),
        lambda acc, i: acc + F.element_at(weights, (place(i) - 1) * size + place(i + 1)),
    )
    return total / (F.length(value) - 1)


def all_spans(docs: DataFrame, model: list[float], threshold: float, text: str, spans: str) -> DataFrame:
    """Add the spans under a name of the caller's choice."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.expr(f"cast(array() as {SPAN})")
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    tokens = F.when(body.rlike(CANDIDATE), pattern_spans(body, CANDIDATE, 3)).otherwise(none)
    base, long = unused(docs, "base"), unused(docs, "long")
    first = docs.withColumn(base, base_spans(body)).withColumn(long, tokens)
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter(long, lambda s: mixed(s["value"]) & free(s) & (log_ratio(s["value"], model) > threshold))
    every = F.when(F.size(long) > 0, F.array_sort(F.concat(base, added))).otherwise(F.col(base))
    return first.withColumn(spans, every).drop(*{base, long} - {spans})


def scan(docs: DataFrame, model: list[float], threshold: float = 1.0, text: str = "text") -> DataFrame:
    """Add `spans`: the base spans and, from the models, long tokens with a digit and a letter that touch none of them."""
    return all_spans(docs, model, threshold, text, "spans")


def redact(docs: DataFrame, model: list[float], threshold: float = 1.0, mask: str = "[SECRET]") -> DataFrame:
    """Replace every span of the text by `mask`; the value alone in an assignment is not told from its key. Columns stay."""
    spans = unused(docs, "secret_spans")
    found = all_spans(docs, model, threshold, "text", spans)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        start, end = F.greatest(span["start"], acc["at"]), F.greatest(span["end"], acc["at"])
        kept = F.substring(F.col("text"), acc["at"] + 1, start - acc["at"])
        return F.struct(end.alias("at"), F.concat(acc["out"], kept, F.when(span["end"] > acc["at"], mask).otherwise("")).alias("out"))

    masked = F.aggregate(
        spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    )
    out = found.withColumn("text", F.when(F.size(spans) > 0, masked).otherwise(F.col("text"))).drop(spans)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, *fitted(docs))
    names = F.array(*map(F.lit, KINDS))
    told = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(told(F.filter("spans", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
