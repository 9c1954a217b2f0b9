"""Text functions of transcripts, as Columns; one Arrow function where Spark has no equivalent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from leafloom.functions.blocks import ratios

# White space as Python's str.isspace has it, letters that need folding, dashes that break words.
WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
#: Runs of white space that are not one plain space: what has to be replaced.
ODD_WS = r"(?: {2,}+| ?[\s\x{1c}-\x{1f}\x{85}\p{Z}&&[^ ]])[\s\x{1c}-\x{1f}\x{85}\p{Z}]*+"
FULL_STOP, DOT_LEADER, EW_PAIR, EW_LIGATURE = "։", "․", "եւ", "և"
DASHES = "-–—֊"
SKIPPED_BLOCKS = ["image", "figure", "seal", "chart", "formula_number"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once; inside a lambda, an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^" + WS, ""), WS + "$", "")


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(text, WS), "")


def normalise(text: Column) -> Column:
    """Lower case, two marks and a letter pair folded, white space runs as one space, ends trimmed."""
    folded = F.lower(text)
    for raw, plain in ((FULL_STOP, ":"), (DOT_LEADER, "."), (EW_PAIR, EW_LIGATURE)):
        folded = F.replace(folded, F.lit(raw), F.lit(plain))
    return F.trim(F.regexp_replace(folded, ODD_WS, " "))


def normal_tokens(text: Column) -> Column:
    """Words of a normalised text: single spaces stand between them."""
    return F.array_remove(F.split(normalise(text), " "), "")


def is_word(token: Column) -> Column:
    return token.rlike(r"[\p{L}\p{N}]")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def char_count(text: Column) -> Column:
    return F.char_length(text)


@F.pandas_udf(DoubleType())
def character_similarity(actual: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two normalised texts (actual, expected); the order matters. Null if either is."""
    for left, right in actual:
        yield pd.Series(ratios(left.tolist(), right.tolist()), dtype="float64")


@F.pandas_udf(StructType([StructField("chr", DoubleType()), StructField("wrd", DoubleType())]))
def scores_of(texts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Similarity and word recall in one pass over (actual, expected, wanted): two normalised texts, and the words to be met
    with single spaces between them. Null where a text is."""
    for actual, expected, wanted in texts:
        left, right, asked = actual.tolist(), expected.tolist(), wanted.tolist()
        met = [None if a is None or w is None else recall_in(a, w) for a, w in zip(left, asked, strict=True)]
        yield pd.DataFrame({"chr": pd.Series(ratios(left, right), dtype="float64"), "wrd": pd.Series(met, dtype="float64")})


def recall_in(actual: str, wanted: str) -> float:
    """Share of the wanted words that are among the words of `actual`, each occurrence counted; 1 if none is wanted."""
    if not wanted:
        return 1.0
    have, asked = set(actual.split(" ")), wanted.split(" ")
    return sum(map(have.__contains__, asked)) / len(asked)


def wanted_text(expected: Column) -> Column:
    return F.array_join(wanted_words(expected), " ")


def wanted_words(expected: Column) -> Column:
    """The expected words in order, each occurrence."""
    return F.filter(normal_tokens(expected), is_word)


def recall_of(actual: Column, wanted: Column) -> Column:
    """Share of `wanted` words that are among the actual tokens; 1 if none is wanted.

    The words stand sorted with the tokens, each token before its equals, so that one pass counts what is met.
    """
    have = F.transform(F.array_distinct(normal_tokens(actual)), lambda w: F.struct(w.alias("w"), F.lit(0).alias("k")))
    asked = F.transform(wanted, lambda w: F.struct(w.alias("w"), F.lit(1).alias("k")))
    begin = F.struct(F.lit("").alias("seen"), F.lit(0).alias("met"))

    def step(acc: Column, x: Column) -> Column:
        met = acc["met"] + F.when((x["k"] == 1) & (x["w"] == acc["seen"]), 1).otherwise(0)
        return F.struct(F.when(x["k"] == 0, x["w"]).otherwise(acc["seen"]).alias("seen"), met.alias("met"))

    met = F.aggregate(F.sort_array(F.concat(have, asked)), begin, step, lambda acc: acc["met"])
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(met / F.size(wanted))


def word_recall(actual: Column, expected: Column) -> Column:
    """Share of the expected words, each occurrence counted, that are among the actual tokens; 1 if none is expected."""
    return let(F.struct(actual.alias("actual"), wanted_words(expected).alias("wanted")), lambda v: recall_of(v["actual"], v["wanted"]))


def scores_english_text(text: Column) -> Column:
    """At least half of the letters are ASCII letters; true without letters.

    Where half of all characters are ASCII letters, half of the letters are, and they need not be told apart.
    """

    def share(latin: Column) -> Column:
        letters = F.length(F.regexp_replace(text, r"[^\p{L}]++", ""))
        return F.when(latin * 2 >= F.length(text), F.lit(True)).otherwise(letters <= latin * 2)

    return let(F.length(F.regexp_replace(text, "[^A-Za-z]++", "")), share)


def dictionary_tokens(text: Column) -> Column:
    """Lower-case runs of two or more ASCII letters."""
    ascii_ = F.lower(F.regexp_replace(text, "[^a-zA-Z]++", " "))
    return F.filter(F.split(ascii_, " "), lambda w: F.length(w) >= 2)


def joined_pages(texts: Column) -> Column:
    """Stripped pages without the blank ones, a blank line between them."""
    return F.array_join(F.filter(F.transform(texts, strip), lambda t: t != ""), "\n\n")


def excerpt(text: Column, length: int = 500) -> Column:
    return F.replace(F.substring(strip(text), 1, length), F.lit("\n"), F.lit(" "))


def dehyphenated(lines: Column) -> Column:
    """Join a line that ends in letter and dash to a next one that starts with a letter, without the dash; may chain."""
    text = F.array_join(F.transform(lines, lambda t: F.regexp_replace(t, WS + "$", "")), "\n")
    return F.split(F.regexp_replace(text, rf"(?<=\p{{L}})[{DASHES}]\n(?=\p{{L}})", ""), "\n")


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, empty without one; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def relative(path: Column, workspace: str) -> Column:
    cut = F.substring(path, F.lit(len(workspace) + 1), F.length(path))
    return F.when(F.startswith(path, F.lit(workspace)), cut).otherwise(path)


def block_text(blocks: Column) -> Column:
    """Stripped text of labelled blocks, without pictures and their like, one a line."""
    kept = F.filter(blocks, lambda b: ~b["label"].isin(SKIPPED_BLOCKS))
    return F.array_join(F.transform(kept, lambda b: strip(b["text"])), "\n")


def search_tokens(query: Column) -> Column:
    return tokens(F.lower(query))


def price(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float, discount: float = 1.0) -> Column:
    return (tokens_in / 1e6 * rate_in + tokens_out / 1e6 * rate_out) * discount


def markdown_page(name: Column, text: Column) -> Column:
    return F.concat(F.lit("# "), name, F.lit("\n\n"), strip(text), F.lit("\n"))


def cp1252_encodable(text: Column) -> Column:
    """Only characters that the PDF base fonts can show."""
    extra = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
    return ~text.rlike(rf"[^\x{{00}}-\x{{7f}}\x{{a0}}-\x{{ff}}{extra}]")
