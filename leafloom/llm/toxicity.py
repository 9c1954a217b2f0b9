"""Operator 8, toxicity: a counterfactual-regularised linear classifier.

Features are the distinct words of a text and the first letters of longer words, hashed to a fixed
number of weights. A logistic loss is fitted to labelled texts and to counterfactual copies of them,
which have their text's label, and the squared difference between the score of a copy and of its text
is penalised, so that naming a group alone does not move a score. Copies are made in two ways: a term
of a group that a text names is swapped for another of its kind, and into every text two terms, chosen
by a hash of the text, are put.

The fit reads a bounded sample of labelled rows (`cap`, chosen by a hash of doc_id). Features are
chosen before anything reaches the driver: those of at least `least` texts whose log odds between
the classes lie `strength` standard errors from 0, and all identity terms that occur. Only those
features of a text are sent to it. Scoring reads all texts whole, in tasks.

Cases. Null or empty texts hold no feature: the score of the bias alone. Rows whose label is null
are not learnt from; texts with the same features and label count once. No labelled row, or one class
only: a constant score from the smoothed share of toxic rows. Of the columns only `score` is touched:
it replaces a namesake; other columns stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import Scratch, bounded_sample, feature, remainder, small_batches, table, text_slices

BITS = 20
PREFIX = 5
TOKEN = re.compile(r"\w+")

# Identity terms, one line a kind; a term is swapped for the next of its line.
IDENTITY_TERMS = [
    "women men girls boys mothers fathers",
    "woman man girl boy mother father",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "gay straight lesbian bisexual transgender",
    "black white asian latino african european american arab",
    "immigrants refugees natives foreigners citizens",
    "disabled blind deaf old young",
    "femmes hommes filles musulmans chrétiens juifs immigrés",
    "frauen männer muslime christen juden ausländer",
    "mujeres hombres musulmanes cristianos judíos inmigrantes",
]
SWAP = {w: line[(i + 1) % len(line)] for line in map(str.split, IDENTITY_TERMS) for i, w in enumerate(line)}


def hashed(word: str) -> list[int]:
    out = [feature("w " + word, BITS)]
    if len(word) > PREFIX:
        out.append(feature("p " + word[:PREFIX], BITS))
    return out


def features_of(words: set[str]) -> set[int]:
    return {f for w in words for f in hashed(w)}


def copies_of(text: str, words: set[str]) -> list[set[int]]:
    """Features of the counterfactual copies of a text."""
    out = []
    if words & SWAP.keys():
        out.append(features_of({SWAP.get(w, w) for w in words}))
    terms = list(SWAP)
    for k in range(2):
        out.append(features_of(words | {terms[feature(f"{k} {text}", 30) % len(terms)]}))
    return out


def training_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(y, own, features, copies): `own` tells equal sets of features."""
    for pdf in batches:
        rows = []
        for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
            words = set(TOKEN.findall((text or "").lower()))
            own = sorted(features_of(words))
            key = hashlib.sha256(np.array(own, dtype=np.int64).tobytes()).digest()
            rows.append((int(y), key, own, [sorted(c) for c in copies_of(text or "", words)]))
        yield pd.DataFrame(rows, columns=["y", "own", "features", "copies"])


def kept_features(told: frozenset[int]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [[f for f in x if f in told] for x in pdf["features"]]
            copies = [[[f for f in c if f in told] for c in x] for x in pdf["copies"]]
            yield pd.DataFrame({"y": pdf["y"], "features": own, "copies": copies})

    return rows


def telling_features(rows: DataFrame, least: int = 4, strength: float = 3.0) -> frozenset[int]:
    """Features of `least` texts and `strength` standard errors, and the identity terms."""
    n, toxic_rows = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = rows.select("y", F.explode("features").alias("f")).groupBy("f").agg((F.sum("y") + 0.5).alias("toxic"), (F.sum(1 - F.col("y")) + 0.5).alias("clean"))
    odds = F.log(F.col("toxic") * float(n - toxic_rows + 1)) - F.log(F.col("clean") * float(toxic_rows + 1))
    error = F.sqrt(1 / F.col("toxic") + 1 / F.col("clean"))
    told = counts.where((F.col("toxic") + F.col("clean") - 1 >= least) & (F.abs(odds) >= strength * error))
    return frozenset(r[0] for r in told.select("f").collect()) | frozenset(f for w in SWAP for f in hashed(w))


def fit(rows: pd.DataFrame, ridge: float = 1e-4, counterfactual: float = 5.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps (Adam) on loss + counterfactual penalty + ridge.

    `rows`: y, features, copies (lists of features of the copies), of distinct texts.
    """
    y = rows["y"].to_numpy(dtype=np.float64) if len(rows) else np.zeros(0)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        return weights, bias
    of = np.concatenate([np.arange(len(y)), np.repeat(np.arange(len(y)), [len(c) for c in rows["copies"]])])
    lists = [*rows["features"], *(c for copies in rows["copies"] for c in copies)]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    used, col = np.unique(np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]), return_inverse=True)
    # A text and its copies have the weight of one text together, so that naming a group tells nothing of the label.
    times = np.bincount(of)[of]
    balance = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))[of] / times
    copy = np.arange(len(lists)) >= len(y)
    w, m, v = (np.zeros(len(used)) for _ in range(3))
    m0 = v0 = 0.0
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=len(lists))
        error = balance * (1 / (1 + np.exp(-np.clip(z + bias, -30, 30))) - y[of])
        change = np.where(copy, z - z[of], 0.0)
        back = change - np.bincount(of, weights=change, minlength=len(y))[of] * ~copy
        grad = np.bincount(col, weights=(error / len(y) + counterfactual * back / max(1, copy.sum()))[row], minlength=len(used)) + ridge * w
        g0 = error.sum() / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        m0, v0 = 0.9 * m0 + 0.1 * g0, 0.999 * v0 + 0.001 * g0 * g0
        rate = 0.05 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        bias -= rate * m0 / (np.sqrt(v0) + 1e-8)
    weights[used] = w
    return weights, float(bias)


def chosen_rows(docs: DataFrame, labels: DataFrame, cap: int) -> pd.DataFrame:
    """The rows of `fit`, of about `cap` labelled documents."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    chosen = bounded_sample(labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull()), "doc_id", cap)
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic")
    rows = texts.mapInPandas(training_rows, "y int, own binary, features array<int>, copies array<array<int>>")
    rows = scratch.written(rows.dropDuplicates(["y", "own"]), "training")
    kept = rows.mapInPandas(kept_features(telling_features(rows)), "y int, features array<int>, copies array<array<int>>").toPandas()
    scratch.drop()
    return kept


def train(docs: DataFrame, labels: DataFrame, cap: int = 8_000, counterfactual: float = 5.0) -> tuple[np.ndarray, float]:
    return fit(chosen_rows(docs, labels, cap), counterfactual=counterfactual)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", score: str = "score") -> DataFrame:
    """Add `score`, 0 to 1. The weights, 4 MB, are broadcast."""
    small_batches(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, bias = weights.value
        for series in batches:
            parts = [score_slice(part["text"], w, bias) for part in text_slices(pd.DataFrame({"text": series}))]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(score, of(F.col(text)))


def score_slice(texts: pd.Series, w: np.ndarray, bias: float) -> np.ndarray:
    """Scores of some texts: each distinct word is hashed once, each distinct feature of a text counts once."""
    found = [TOKEN.findall((t or "").lower()) for t in texts]
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    codes, words = pd.factorize(np.array([x for f in found for x in f], dtype=object))
    doc = np.repeat(np.arange(len(found)), sizes)
    per_word = [hashed(x) for x in words]
    first = np.fromiter((p[0] for p in per_word), dtype=np.int64, count=len(words))
    second = np.fromiter((p[1] if len(p) > 1 else -1 for p in per_word), dtype=np.int64, count=len(words))
    both = np.concatenate([(doc << BITS) | first[codes], ((doc << BITS) | second[codes])[second[codes] >= 0]]) if len(codes) else np.zeros(0, np.int64)
    once = np.unique(both)
    z = bias + np.bincount(once >> BITS, weights=w[once & ((1 << BITS) - 1)], minlength=len(found))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    out = scored(docs, train(docs, labels))
    return out.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
