"""Dictionary tokens as numbers, and texts scored by what a lexicon has of theirs: whole batches of texts in numpy.

A token (two or more ASCII letters in a run, in either case) of at most `EXACT` letters is its letters, five bits each; a longer
one is a hash of 62 bits, of which two of 10 million words share one with a chance of about 1e-5. Tokens never become rows: what
leaves a part of the texts is each of its codes once, and what comes back is a row for each that the lexicon has.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Letters that fit in a code; bytes of texts that are taken at once; codes that a task gathers before it sends them on.
EXACT, SLICE, HELD = 12, 1 << 22, 1 << 21

LETTERS = np.zeros(256, np.uint8)
LETTERS[97:123] = LETTERS[65:91] = np.arange(1, 27)
ODD = np.uint64(0x9E3779B97F4A7C15)


def token_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the tokens of texts, UTF-8 bytes between `offsets`, one text after the other, and where each text's begin."""
    letters = LETTERS[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = letters > 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(letters))]
    begins[cuts], ends[cuts - 1] = inside[cuts], inside[cuts - 1]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    start, size = start[size > 1], size[size > 1]
    # The longest first, so that those of which a letter is left stand together.
    order = np.argsort(-size, kind="stable")
    at, sizes = start[order], size[order]
    codes = np.zeros(len(at), np.uint64)
    k, long = 0, int(np.searchsorted(-sizes, -EXACT))
    while m := int(np.searchsorted(-sizes, -k)):
        own = codes[:m]
        own = own << np.uint64(5) if k < EXACT else (own ^ (own >> np.uint64(29))) * ODD
        codes[:m] = own + letters[at[:m] + k]
        k += 1
    hashed = codes[:long] ^ (codes[:long] >> np.uint64(31))
    codes[:long] = (hashed * ODD) >> np.uint64(2) | np.uint64(1 << 62)
    out = np.empty(len(at), np.int64)
    out[order] = codes.view(np.int64)
    return out, np.searchsorted(start, offsets)


#: White space beyond ASCII in UTF-8 (as in `text.WS`): first byte, and the bytes after it.
WIDE_SPACES = {0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80"], 0xE2: [bytes([0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)] + [b"\x81\x9f"], 0xE3: [b"\x80\x80"]}
SPACES = np.zeros(256, bool)
SPACES[[*range(9, 14), *range(0x1C, 0x21)]] = True


@cache
def _is_letter() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the words between white space (`text.word_count`), and whether at least half of its letters are ASCII ones
    (`text.scores_english_text`)."""
    own, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    space = SPACES[own]
    for first, others in WIDE_SPACES.items():
        at = np.flatnonzero(own == first)
        for rest in others:
            # UTF-8 is whole, so that the bytes after a first one are of its text.
            met = at[np.logical_and.reduce([own[np.minimum(at + 1 + i, len(own) - 1)] == b for i, b in enumerate(rest)])] if len(at) else at
            for i in range(len(rest) + 1):
                space[met + i] = True
    begins = ~space
    begins[1:] &= space[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(own))]
    begins[cuts] = ~space[cuts]
    words = np.diff(np.searchsorted(np.flatnonzero(begins), offsets))
    count = lambda what: np.diff(np.append(0, np.cumsum(what))[offsets])
    latin, length = count(LETTERS[own] > 0), count(own & 0xC0 != 0x80)
    english = latin * 2 >= length
    for i in np.flatnonzero(~english).tolist():
        points = np.frombuffer(own[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)
        english[i] = np.count_nonzero(_is_letter()[points]) <= latin[i] * 2
    return words, english


def raw(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; a null has none."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def parts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts, of about SLICE bytes or one text."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, "right")) - 1)
        yield low, high
        low = high


def sliced(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, codes, bounds) of the ranges of texts."""
    data, offsets = raw(texts)
    for low, high in parts(offsets):
        yield low, high, *token_codes(data, offsets[low : high + 1])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n) of batches (text): how often each code occurs, in parts that are yet to be added up."""
    held = pd.Series(dtype=np.int64)
    for batch in batches:
        for _, _, codes, _ in sliced(batch.column(0)):
            own = pd.Series(codes).value_counts(sort=False)
            held = own if not len(held) else held.add(own, fill_value=0).astype(np.int64)
            if len(held) > HELD:
                yield _table(code=held.index.to_numpy(np.int64), n=held.to_numpy(np.int64))
                held = held[:0]
    yield _table(code=held.index.to_numpy(np.int64), n=held.to_numpy(np.int64))


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def lexicon(texts: DataFrame) -> DataFrame:
    """(code, n) of the tokens of all texts of the column `text`: it grows with the corpus."""
    return texts.select("text").mapInArrow(counted, "code long, n long").groupBy("code").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")


def coded(words: DataFrame) -> DataFrame:
    """(code, n) of a lexicon (word, n); the code of what is no lower-case token, which no text holds, is null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            tokens = [w if w is not None and len(w) > 1 and w.isascii() and w.isalpha() and w.islower() else "" for w in found]
            codes = np.zeros(len(tokens), np.int64)
            data, offsets = raw(pa.array(tokens, pa.string()))
            some = np.diff(offsets) > 0
            codes[some] = token_codes(data, offsets)[0]
            yield pa.RecordBatch.from_arrays([pa.array(codes, mask=~some), batch.column(1)], ["code", "n"])

    return words.select("word", words["n"].cast("long").alias("n")).mapInArrow(rows, "code long, n long")


def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, code) of batches (block, text): each code of a block, seldom twice."""
    held: dict[int, list[np.ndarray]] = {}
    size = 0

    def emptied() -> Iterator[pa.RecordBatch]:
        for block, parts in held.items():
            codes = pd.unique(np.concatenate(parts))
            yield _table(block=np.full(len(codes), block, np.int32), code=codes)
        held.clear()

    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        for low, high, codes, bounds in sliced(batch.column(1)):
            own = np.repeat(blocks[low:high], np.diff(bounds))
            for block in np.unique(blocks[low:high]).tolist():
                held.setdefault(block, []).append(pd.unique(codes[own == block]))
        size = sum(len(p) for parts in held.values() for p in parts)
        if size > HELD:
            for block, parts in held.items():
                held[block] = [pd.unique(np.concatenate(parts))]
            if sum(len(parts[0]) for parts in held.values()) > HELD // 2:
                yield from emptied()
    yield from emptied()


def summed(unseen: float, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block's texts (..., text) and what the lexicon has of them (code, log_p): `words`, `english`, the number of tokens, that
    of different ones which it does not have, and the mean logarithm of the first `most`, `unseen` for those it does not have.

    Integers are added, as in `rules.exact_mean`, so that texts of the same tokens have the same mean.
    """
    bits = 62 - most.bit_length()

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        known, first = np.unique(right.column("code").to_numpy(), return_index=True)
        scaled = np.append(right.column("log_p").to_numpy()[first], unseen) * 2.0**20
        whole = np.floor(scaled)
        rest = np.floor((scaled - whole) * 2.0**bits).astype(np.int64)
        whole = whole.astype(np.int64)
        texts = left.column("text")
        data, offsets = raw(texts)
        words, english = np.zeros(len(texts), np.int32), np.zeros(len(texts), bool)
        n, n_unknown, means = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int64), np.full(len(texts), np.nan)
        for low, high in parts(offsets):
            words[low:high], english[low:high] = measures(data, offsets[low : high + 1])
            codes, bounds = token_codes(data, offsets[low : high + 1])
            kind, kinds = pd.factorize(codes)
            place = np.searchsorted(known, kinds)
            met = known[np.minimum(place, len(known) - 1)] == kinds if len(known) else np.zeros(len(kinds), bool)
            place = np.where(met, place, len(known))
            n[low:high] = tokens = np.diff(bounds)
            missed = ~met[kind]
            owner = np.repeat(np.arange(high - low), tokens)[missed]
            different = pd.unique(owner * max(1, len(kinds)) + kind[missed])
            n_unknown[low:high] = np.bincount(different // max(1, len(kinds)), minlength=high - low)
            place = place[kind]
            read = np.minimum(tokens, most)
            sums = [np.append(0, np.cumsum(part[place])) for part in (whole, rest)]
            a, b = (s[bounds[:-1] + read] - s[bounds[:-1]] for s in sums)
            some = read > 0
            means[low:high][some] = (a[some] + b[some] * 2.0**-bits) / (read[some] * 2.0**20)
        absent = texts.is_null().to_numpy()
        out = left.drop_columns(["block", "text"])
        told = {"words": pa.array(words, mask=absent), "english": pa.array(english, mask=absent), "n_tokens": pa.array(n, mask=absent), "n_unknown": pa.array(n_unknown)}
        for name, column in {**told, "mean_log": pa.array(means, mask=np.isnan(means))}.items():
            out = out.append_column(name, column)
        return out

    return rows
