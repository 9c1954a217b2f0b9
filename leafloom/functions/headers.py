"""What a file really is: format, size and claim checked from its first bytes, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafloom.functions import rules
from leafloom.functions.text import let

# First bytes of each format, in hex; the suffixes that may name it; JPEG frame markers; TIFF size tags.
SIGNATURES = {"jpeg": ["FFD8FF"], "png": ["89504E470D0A1A0A"], "tiff": ["49492A00", "4D4D002A"], "pdf": ["255044462D"]}
SUFFIXES = {"jpeg": [".jpg", ".jpeg"], "png": [".png"], "tiff": [".tif", ".tiff"], "pdf": [".pdf"]}
FRAMES = [f"FFC{d}" for d in "01235679ABDEF"]
WIDTH_TAG, HEIGHT_TAG = 256, 257
#: JPEG segments and TIFF entries that are looked through.
MOST_SEGMENTS, MOST_ENTRIES = 64, 64
#: Bytes of a file that are enough to decide, for all but pictures with very long notes before their first frame.
HEAD = 1 << 16


def _hex(content: Column, at: Column | int, length: int) -> Column:
    return F.hex(F.substring(content, at, length))


def _number(content: Column, at: Column | int, data: Column, length: int) -> Column:
    there = F.length(content) >= (F.lit(at) if isinstance(at, int) else at) + (length - 1)
    return F.when(there, F.conv(F.hex(data), 16, 10).cast("long"))


def _big(content: Column, at: Column | int, length: int) -> Column:
    """Unsigned, highest byte first; null beyond the end. `at` counts from 1."""
    return _number(content, at, F.substring(content, at, length), length)


def _little(content: Column, at: Column | int, length: int) -> Column:
    return _number(content, at, F.concat(*[F.substring(content, at + i, 1) for i in reversed(range(length))]), length)


def real_format(content: Column) -> Column:
    """jpeg, png, tiff or pdf by the first bytes, else null."""
    first = _hex(content, 1, 8)
    out = F.lit(None).cast("string")
    for name, signatures in SIGNATURES.items():
        for s in signatures:
            out = F.when(F.startswith(first, F.lit(s)), name).otherwise(out)
    return out


def _none() -> Column:
    return F.lit(None).cast("struct<width:bigint,height:bigint>")


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.alias("width"), height.alias("height"))


def _jpeg_size(content: Column) -> Column:
    """The first frame header's; segments before it are skipped by their length, fill bytes one by one. Nothing more is read
    once it is found or the bytes end."""
    begin = F.struct(F.lit(3).cast("long").alias("at"), _none().alias("size"))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"].cast("int")
        marker = _hex(content, at, 2)
        frame = _size(_big(content, at + 7, 2), _big(content, at + 5, 2))
        skip = F.when(marker == "FFFF", F.lit(1).cast("long")).otherwise(2 + F.coalesce(_big(content, at + 2, 2), F.lit(HEAD)))
        further = F.struct(F.least(acc["at"] + skip, F.lit(1 << 30)).cast("long").alias("at"), _none().alias("size"))
        found = F.struct(acc["at"].alias("at"), frame.alias("size"))
        ended = acc["size"].isNotNull() | (acc["at"] > F.length(content))
        return F.when(ended, acc).when(marker.isin(FRAMES), found).otherwise(further)

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_SEGMENTS)), begin, step, lambda acc: acc["size"])


def _tiff_size(content: Column) -> Column:
    """The first page's tags, as 16 or 32 bits, in the file's byte order."""

    def ordered(number, order: str) -> Column:
        short = lambda n: F.lit(n.to_bytes(2, order))

        def of(base: Column) -> Column:
            count = F.coalesce(F.least(number(content, base, 2), F.lit(MOST_ENTRIES)), F.lit(0))
            places = F.transform(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.expr("cast(array() as array<bigint>)")), lambda i: (base + 2 + 12 * i).cast("int"))
            value = lambda at: F.when(F.substring(content, at + 2, 2) == short(3), number(content, at + 8, 2)).otherwise(number(content, at + 8, 4))
            tag = lambda t: F.get(F.transform(F.filter(places, lambda at: F.substring(content, at, 2) == short(t)), value), 0)
            return _size(tag(WIDTH_TAG), tag(HEIGHT_TAG))

        return let(F.least(number(content, 5, 4) + 1, F.lit(1 << 30)).cast("int"), of)

    return F.when(_hex(content, 1, 2) == "4949", ordered(_little, "little")).otherwise(ordered(_big, "big"))


def real_size(content: Column) -> Column:
    """struct(width, height) from the header; null for PDFs and other files, fields null where the header ends too soon."""
    kind = real_format(content)
    png = _size(_big(content, 17, 4), _big(content, 21, 4))
    return F.when(kind == "png", png).when(kind == "jpeg", _jpeg_size(content)).when(kind == "tiff", _tiff_size(content)).otherwise(_none())


def refused(content: Column, suffix: Column, pages: Column, size: Column | None = None) -> Column:
    """Why a file is not admitted, from its own bytes; null if it is. `size`: its `real_size`, where a column has it."""
    if size is None:
        return let(real_size(content), lambda known: refused(content, suffix, pages, known))
    kind = real_format(content)
    named = F.lit(None).cast("string")
    for name, endings in SUFFIXES.items():
        named = F.when(F.lower(suffix).isin(endings), name).otherwise(named)
    reason = (
        F.when(kind.isNull(), "not a JPEG, PNG, TIFF or PDF file")
        .when(named.isNull() | (named != kind), F.concat(F.lit("named "), F.coalesce(F.lower(suffix), F.lit("")), F.lit(" but is "), kind))
        .when((kind != "pdf") & (size["width"].isNull() | size["height"].isNull() | (size["width"] == 0) | (size["height"] == 0)), "no size in its header")
    )
    return F.coalesce(reason, rules.refused_reason(F.coalesce(size["width"], F.lit(0)), F.coalesce(size["height"], F.lit(0)), pages))
