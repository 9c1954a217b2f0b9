"""Operator 4, language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. The probability of
a word is the sum, over all its segmentations, of the products of piece probabilities; a forward
pass over equal-length words yields it. A text scores the sum of the log probabilities of its
words, and its posterior under a uniform prior is the answer.

Piece probabilities come from expectation maximisation over the words of a bounded sample of
labelled texts a language (`cap`). Only counts of distinct words of that sample reach the driver.

Words are runs of letters (Unicode category L), of any length, in the fit as in scoring.

Cases. Null texts and texts without a letter: `und`, score 0. Ties: the first language by name.
No labelled text: `und` for all, score 0. Null labels are not learnt from. Repeated rows: each is
judged. Extra columns stay; lang_pred and score replace namesakes in `identified`, and no column is
touched by `known_language`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import received, remainder, shipped, small_batches, table, text_slices, unused
from leafloom.llm.pieces import PieceTable, by_length

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
RUNS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Stands for the probability of a character without a piece, alike in all languages.
LONE = 1e-7
#: Forward values are kept near 1 by this factor a character.
SCALE = 64.0
#: Words of more letters are counted with logarithms, as their forward and backward values could leave the range of doubles.
PLAIN_LETTERS = 40


def letter_words(text: str) -> list[str]:
    """Runs of letters; the pattern also takes numerals such as a superscript two, which are cut out here."""
    found = RUNS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def vocabulary_pieces(path: str = VOCABULARY) -> list[str]:
    """The lower-case letter pieces, word starts written as a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [model.id_to_piece(i).replace("▁", " ") for i in range(model.get_piece_size())]
    return sorted({t for t in texts if re.fullmatch(r" ?[^\W\d_]*", t) and t and t == t.lower()})


class Unigrams:
    """`probability`: (pieces + 1, languages); the last row, which id -1 finds, is 0."""

    def __init__(self, pieces: list[str], languages: list[str], probability: np.ndarray):
        self.pieces, self.languages = pieces, languages
        self.table = PieceTable([(p, i) for i, p in enumerate(pieces)])
        lengths = np.array([len(p) for p in pieces])
        scaled = probability * SCALE ** lengths[:, None]
        self.scaled = np.vstack([scaled, np.zeros(len(languages))])

    def steps(self, codes: np.ndarray, ids: np.ndarray, every: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Forward values (words, positions, languages); the last is scaled by exp(log), anew at `every` position."""
        n, length = codes.shape
        most, k = ids.shape[2], len(self.languages)
        alpha = np.zeros((n, length + 1, k))
        log = np.zeros((n, k))
        alpha[:, 0] = 1.0
        for end in range(1, length + 1):
            sizes = np.arange(1, min(most, end) + 1)
            here = ids[:, end - sizes, sizes - 1]
            p = self.scaled[here]
            p[:, 0][here[:, 0] < 0] = LONE * SCALE
            alpha[:, end] = np.einsum("nsk,nsk->nk", p, alpha[:, end - sizes])
            if end % every == 0:
                top = np.maximum(alpha[:, max(0, end - most + 1) : end + 1].max(axis=1), 1e-300)
                alpha[:, max(0, end - most + 1) : end + 1] /= top[:, None, :]
                log += np.log(top)
        return alpha, log

    def word_scores(self, words: np.ndarray) -> np.ndarray:
        """Log probability of each word (already with its leading space) in each language."""
        out = np.zeros((len(words), len(self.languages)))
        for part, codes in by_length(words, 1 << 16):
            alpha, log = self.steps(codes, self.table.matches(codes))
            out[part] = np.log(np.maximum(alpha[:, -1], 1e-300)) + log - codes.shape[1] * np.log(SCALE)
        return out

    def text_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probabilities (texts, languages) and the number of words."""
        found = [letter_words(t.lower()) for t in texts]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        codes, words = pd.factorize(np.array([" " + w for f in found for w in f], dtype=object))
        scores = self.word_scores(words)
        doc = np.repeat(np.arange(len(found)), sizes)
        total = np.stack(
            [np.bincount(doc, weights=scores[codes, j], minlength=len(found)) for j in range(len(self.languages))], axis=1
        )
        return total, sizes


def long_word_counts(model: Unigrams, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """As `expected_counts`, for long words of one length: forward and backward sums of logarithms."""
    n, length, most = ids.shape
    log = np.log(np.maximum(model.scaled, 1e-300))
    log[-1] = -np.inf

    def step(here: np.ndarray) -> np.ndarray:
        p = log[here]
        p[:, 0][here[:, 0] < 0] = np.log(LONE * SCALE)
        return p

    ahead, behind = (np.full((n, length + 1, len(model.languages)), -np.inf) for _ in range(2))
    ahead[:, 0] = behind[:, length] = 0.0
    for end in range(1, length + 1):
        sizes = np.arange(1, min(most, end) + 1)
        ahead[:, end] = np.logaddexp.reduce(step(ids[:, end - sizes, sizes - 1]) + ahead[:, end - sizes], axis=1)
    for start in range(length - 1, -1, -1):
        sizes = np.arange(1, min(most, length - start) + 1)
        behind[:, start] = np.logaddexp.reduce(step(ids[:, start, sizes - 1]) + behind[:, start + sizes], axis=1)
    out = np.zeros((len(model.pieces) + 1, len(model.languages)))
    for size in range(1, most + 1):
        here = ids[:, : length - size + 1, size - 1]
        word, start = np.nonzero(here >= 0)
        found = here[word, start]
        value = weights[word] * np.exp(log[found] + ahead[word, start] + behind[word, start + size] - ahead[word, length])
        for j in range(out.shape[1]):
            out[:, j] += np.bincount(found, weights=value[:, j], minlength=len(out))
    return out


def expected_counts(model: Unigrams, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected piece counts of the words (weights: words x languages) under the model."""
    out = np.zeros((len(model.pieces) + 1, len(model.languages)))
    for part, codes in by_length(words, 1 << 15):
        n, length = codes.shape
        ids = model.table.matches(codes)
        if length > PLAIN_LETTERS:
            out += long_word_counts(model, ids, weights[part])
            continue
        most = ids.shape[2]
        alpha, _ = model.steps(codes, ids, PLAIN_LETTERS + 1)
        beta = np.zeros_like(alpha)
        beta[:, length] = 1.0
        for start in range(length - 1, -1, -1):
            sizes = np.arange(1, min(most, length - start) + 1)
            here = ids[:, start, sizes - 1]
            p = model.scaled[here]
            p[:, 0][here[:, 0] < 0] = LONE * SCALE
            beta[:, start] = np.einsum("nsk,nsk->nk", p, beta[:, start + sizes])
        share = weights[part] / np.maximum(alpha[:, length], 1e-300)
        for size in range(1, most + 1):
            here = ids[:, : length - size + 1, size - 1]
            word, start = np.nonzero(here >= 0)
            found = here[word, start]
            value = model.scaled[found] * alpha[word, start] * beta[word, start + size] * share[word]
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(found, weights=value[:, j], minlength=len(out))
    return out[:-1]


def fit(counts: pd.DataFrame, pieces: list[str], rounds: int = 2, smoothing: float = 0.02) -> Unigrams:
    """Expectation maximisation on (lang, word, n). Pieces that no word of the sample holds share the smoothing."""
    languages = sorted(counts["lang"].unique())
    at, words = pd.factorize((" " + counts["word"]).to_numpy(dtype=object))
    weights = np.zeros((len(words), len(languages)))
    np.add.at(weights, (at, np.searchsorted(languages, counts["lang"])), counts["n"].to_numpy(dtype=np.float64))
    probability = np.full((len(pieces), len(languages)), 1.0 / max(1, len(pieces)))
    for _ in range(rounds):
        expected = expected_counts(Unigrams(pieces, languages, probability), words, weights) + smoothing
        probability = expected / expected.sum(axis=0)
    return Unigrams(pieces, languages, probability)


def sample_words(docs: DataFrame, cap: int) -> DataFrame:
    """(lang, word, n) of about `cap` labelled texts a language, chosen by a hash of doc_id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    unit = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    if sizes:
        share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(cap / n))])
        known = known.where(unit < F.element_at(share, F.col("lang")))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pd.DataFrame({"lang": pdf["lang"], "word": pdf["text"].map(lambda t: letter_words(t.lower()))}).explode("word")
            yield rows.dropna().groupby(["lang", "word"], as_index=False).size().rename(columns={"size": "n"})

    parts = known.select("lang", "text").mapInPandas(split, "lang string, word string, n long")
    small_batches(docs.sparkSession)
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, cap: int = 250, path: str = VOCABULARY) -> Unigrams | None:
    counts = sample_words(docs, cap).toPandas().sort_values(["lang", "word"])
    return fit(counts, vocabulary_pieces(path)) if len(counts) else None


def judged(docs: DataFrame, model: Unigrams | None, text: str = "text") -> Column:
    """A struct (lang, score) of the text."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    small_batches(docs.sparkSession)
    parcel = shipped(docs.sparkSession, model)

    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        unigrams = received(parcel)
        names = np.array([*unigrams.languages, UNKNOWN], dtype=object)
        for series in batches:
            parts = []
            for part in text_slices(pd.DataFrame({"text": series})):
                total, sizes = unigrams.text_scores([t if t is not None else "" for t in part["text"]])
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                none = sizes == 0
                parts.append(pd.DataFrame({"lang": names[np.where(none, -1, best)], "score": np.where(none, 0.0, share)}))
            yield pd.concat(parts) if parts else pd.DataFrame({"lang": [], "score": []})

    return judge(F.col(text))


def identified(docs: DataFrame, model: Unigrams | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score."""
    name = unused(docs, "judged")
    found = docs.withColumn(name, judged(docs, model, text))
    return found.withColumn("lang_pred", F.col(f"{name}.lang")).withColumn("score", F.col(f"{name}.score")).drop(name)


def known_language(
    docs: DataFrame, model: Unigrams | None, keep: list[str] | None = None, least: float = 0.5, sure: float = 0.99
) -> DataFrame:
    """The rows written in one of the languages `keep` (all that the model knows, if not given). Columns stay.

    A row goes if its text has no letter, if no language reaches a score of `least`, if the answer is not in `keep`, or if
    the row's own `lang` is one that the model knows and the text is surely (`sure`) in another.
    """
    name = unused(docs, "judged")
    known = model.languages if model is not None else []
    said, score = F.col(f"{name}.lang"), F.col(f"{name}.score")
    wanted = said.isin(list(known if keep is None else keep)) & (score >= least)
    if "lang" in docs.columns:
        own = F.col("lang")
        wanted &= ~F.coalesce(own.isin(list(known)) & (own != said) & (score >= sure), F.lit(False))
    return docs.withColumn(name, judged(docs, model)).where(wanted).select(*docs.columns)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(remainder("doc_id", 4) != 2))
    return identified(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )
