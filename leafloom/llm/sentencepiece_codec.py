"""Operator 6, SentencePiece encoding and decoding by batched numpy Viterbi.

The vocabulary file is public and is read on the driver; its pieces, a bounded number, travel to
the tasks. A text, after one leading space, is cut where a space follows something else: no
piece reaches across. Distinct words of equal length advance together: hashes of their substrings
probe the sorted piece keys, the best score of each position is a vectorised maximum, and
backpointers are kept. The segmentation of a word is the one of highest total piece score; ties go
to the longer last piece. Characters without a piece become the pieces of their UTF-8 bytes.

Cases. Null text: null ids, and null decoded. Empty text: the ids of one space, and empty decoded.
Any text decodes to itself, U+2581 included (it becomes bytes, as it would else read as a space).
Repeated rows are encoded alike; extra columns stay, and the result column replaces its namesake.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import received, shipped, small_batches, table, text_slices, unused
from leafloom.llm.pieces import PieceTable, by_length

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORDS = re.compile(r" *[^ ]+| +")
#: What a character costs that has no piece, below the lowest score of the vocabulary.
UNKNOWN = 10.0


class Codec:
    """Pieces with scores, spaces written as spaces."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int], size: int):
        self.table = PieceTable([(p, i) for p, i, _ in pieces])
        self.scores = np.full(size + 1, -np.inf)
        self.text = [b""] * size
        for p, i, score in pieces:
            self.scores[i], self.text[i] = score, p.encode()
        for value, i in enumerate(byte_ids):
            self.text[i] = bytes([value])
        self.byte_ids = np.array(byte_ids, dtype=np.int32)
        self.unknown = min((s for _, _, s in pieces), default=0.0) - UNKNOWN

    def best_paths(self, codes: np.ndarray) -> list[list[tuple[int, int]]]:
        """For words of one length, the (start, id) of their pieces; id -1: the bytes of a character."""
        n, length = codes.shape
        ids = self.table.matches(codes)
        most = ids.shape[2]
        best = np.zeros((n, length + 1))
        back = np.zeros((n, length + 1), dtype=np.int32)
        row = np.arange(n)
        for end in range(1, length + 1):
            sizes = np.arange(min(most, end), 0, -1)
            here = ids[:, end - sizes, sizes - 1]
            score = self.scores[here]
            score[:, -1] = np.where(here[:, -1] >= 0, score[:, -1], self.unknown)
            score += best[:, end - sizes]
            pick = score.argmax(axis=1)
            best[:, end] = score[row, pick]
            back[:, end] = sizes[pick]
        end = np.full(n, length)
        steps = []
        while (live := end > 0).any():
            start = np.where(live, end - back[row, end], 0)
            used = np.where(live, ids[row, start, np.maximum(end - start, 1) - 1], -2)
            steps.append((start, used))
            end = start
        starts = np.stack([s for s, _ in steps[::-1]], axis=1)
        pieces = np.stack([u for _, u in steps[::-1]], axis=1)
        return starts, pieces

    def encode_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        counts = np.zeros(len(words), dtype=np.int64)
        parts, places = [], []
        for part, codes in by_length(words):
            starts, pieces = self.best_paths(codes)
            word, step = np.nonzero(pieces != -2)
            found = pieces[word, step]
            lone = found == -1
            if lone.any():
                chars = codes[word[lone], starts[word, step][lone]]
                spelled = [chr(c).encode() for c in chars]
                repeat = np.ones(len(found), dtype=np.int64)
                repeat[lone] = [len(b) for b in spelled]
                word = np.repeat(word, repeat)
                found = np.repeat(found, repeat)
                found[found == -1] = self.byte_ids[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
            counts[part] = np.bincount(word, minlength=len(part))
            parts.append(found)
            places.append(part[word])
        if not parts:
            return np.zeros(0, np.int32), counts
        ids, place = np.concatenate(parts), np.concatenate(places)
        return ids[np.argsort(place, kind="stable")], counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = [WORDS.findall(" " + t) for t in texts]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        codes, words = pd.factorize(np.array([w for f in found for w in f], dtype=object))
        ids, counts = self.encode_words(words)
        begin = np.cumsum(counts) - counts
        n = counts[codes]
        shift = np.repeat(begin[codes] - (np.cumsum(n) - n), n)
        flat = ids[shift + np.arange(int(n.sum()))]
        per_text = np.bincount(np.repeat(np.arange(len(found)), sizes), weights=n, minlength=len(found)).astype(np.int64)
        return np.split(flat, np.cumsum(per_text)[:-1]) if len(found) else []

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def load(path: str = VOCABULARY) -> Codec:
    """Read a SentencePiece model with byte pieces on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = set(byte_ids)
    pieces = []
    for i in range(size):
        if i in special or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ")
        if " " in piece.lstrip(" "):
            raise ValueError("a piece reaches across words")
        pieces.append((piece, i, model.get_score(i)))
    return Codec(pieces, byte_ids, size)


def encoded(docs: DataFrame, codec: Codec, text: str = "text", ids: str = "ids", back: str | None = None) -> DataFrame:
    """Add the ids; with `back`, also what these ids decode to, in the same pass."""
    small_batches(docs.sparkSession)
    parcel = shipped(docs.sparkSession, codec)

    @F.pandas_udf("ids array<int>, back string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = received(parcel)
        for series in batches:
            rows: list = []
            for part in text_slices(pd.DataFrame({"text": series}), 1 << 20):
                found = tool.encode([t if t is not None else "" for t in part["text"]])
                rows += [r if t is not None else None for r, t in zip(found, part["text"], strict=True)]
            told = [tool.decode(r) if back and r is not None else None for r in rows]
            yield pd.DataFrame({"ids": pd.Series(rows, dtype=object), "back": pd.Series(told, dtype=object)})

    name = unused(docs, "coded")
    found = docs.withColumn(name, encode(F.col(text))).withColumn(ids, F.col(f"{name}.ids"))
    return (found.withColumn(back, F.col(f"{name}.back")) if back else found).drop(name)


def decoded(df: DataFrame, codec: Codec, ids: str = "ids", text: str = "decoded") -> DataFrame:
    small_batches(df.sparkSession)
    parcel = shipped(df.sparkSession, codec)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = received(parcel)
        for series in batches:
            yield pd.Series([tool.decode(x) if x is not None else None for x in series], dtype=object)

    return df.withColumn(text, decode(F.col(ids)))


def op6_sentencepiece(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    codec = load(vocabulary)
    both = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), codec, back="decoded")
    return both.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("text_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
