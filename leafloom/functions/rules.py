"""Scoring rules, bands, gates and geometry of single rows, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quality floor, weight of length, bands (value below this bound, setting), preferred psm order.
QUALITY_FLOOR = 0.10
SCORE_WEIGHT = 0.8
PSM_ORDER = [3, 6, 12, 11, 4, 1]
CI_CHAR, CI_WORD, EPSILON = 0.30, 0.80, 1e-9
PLAIN_CONTRAST = 2.0
CONTRAST_BANDS = [(34.0, 2.0), (40.0, 2.5), (46.0, 2.0), (67.0, 3.0), (float("inf"), 2.0)]
PSM_BANDS = [(10.0, 12), (49.0, 3), (69.2, 6), (float("inf"), 3)]
# Thresholds and words of the orientation check, by script where they differ.
PAPER_MIN, MIN_BLOCKS = 96, 8
MARGINS = {"latin": 0.05, "armenian": 0.02}
TOO_FEW = {"latin": "too few clear lines of writing to tell which way is up", "armenian": "too few letters to tell which way is up"}


def effective_score(score: Column, words: Column, most: Column, weight: float | Column = SCORE_WEIGHT) -> Column:
    """The score, of which 1 - weight depends on the share of the longest candidate's words."""
    share = F.greatest(F.least(words / most, F.lit(1.0)), F.lit(0.0))
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return F.when(most <= 0, score).otherwise(score * (w + (1 - w) * share))


def exact_mean(value: Column, terms: int) -> Column:
    """Aggregate: the mean of at most `terms` doubles below 2 ** 20 in size, the same in whatever order and parts they are added.

    `avg` of equal doubles depends on that, so that equal texts may not tie. Here integers are added, which are exact: 20 bits
    of the fraction with the whole number, the other bits apart, down to 2 ** -70 for 1,024 terms.
    """
    bits = 62 - terms.bit_length()
    scaled = value * 2.0**20
    rest = F.floor((scaled - F.floor(scaled)) * 2.0**bits)
    return (F.sum(F.floor(scaled)) + F.sum(rest) * 2.0**-bits) / F.nullif(F.count(value) * 2.0**20, F.lit(0.0))


def power_score(score: Column, words: Column, power: Column) -> Column:
    return score * F.pow(words, power)


def band(value: Column, bands: list[tuple[float, float]]) -> Column:
    """The setting of the first band whose bound exceeds the value (bounds are exclusive)."""
    bounds = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.lit(v).alias("setting")) for b, v in bands])
    first = F.element_at(F.filter(bounds, lambda b: value < b["bound"]), 1)
    return F.when(value.isNull(), None).otherwise(first["setting"])


def suggest(stddev: Column, dark_pct: Column) -> Column:
    """Struct (contrast, psm) by the published band families."""
    return F.struct(band(stddev, CONTRAST_BANDS).cast("double").alias("contrast"), band(dark_pct, PSM_BANDS).cast("int").alias("psm"))


def gate(score: Column, english: Column, asked: bool = True) -> Column:
    """off, skipped (the scorer reads no such script), passed or failed: on the raw score, strictly below the floor."""
    if not asked:
        return F.lit("off")
    return F.when(~english, "skipped").when(score < QUALITY_FLOOR, "failed").otherwise("passed")


def extent(points: Column) -> Column:
    """Bounding box of an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("l"), F.array_min(ys).alias("t"), F.array_max(xs).alias("r"), F.array_max(ys).alias("b"))


def flipped_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box in shares from the bottom left, in pixels from the top left."""
    return F.struct(
        (x * width).alias("l"), ((1 - y - h) * height).alias("t"), ((x + w) * width).alias("r"), ((1 - y) * height).alias("b")
    )


def trimmed(low: Column, high: Column, inset: Column) -> Column:
    """Both ends moved in; their middle twice, if they would cross."""
    a, b, mid = low + inset, high - inset, (low + high) / 2
    return F.struct(F.when(a > b, mid).otherwise(a).alias("low"), F.when(a > b, mid).otherwise(b).alias("high"))


def edge_between(low: Column, high: Column) -> Column:
    """The middle, rounded half to even as coarsely as keeps it above `low` and not above `high`."""
    mid = (low + high) / 2
    rounded = [F.bround(mid, k) for k in range(5)]
    return F.coalesce(*[F.when((low < c) & (c <= high), c) for c in rounded], mid)


def engine_spans(texts: Column, scores: Column, polygons: Column) -> Column:
    """Spans (text, confidence 0 to 100, polygon) of an engine's lists, blank texts left out. Scores come from 0 to 1;
    polygons are attached only if there is one for each text, as otherwise nobody knows which belongs to which."""
    whole = F.size(polygons) == F.size(texts)
    span = lambda t, i: F.struct(t.alias("text"), (F.get(scores, i) * 100).alias("confidence"), F.when(whole, F.get(polygons, i)).alias("polygon"))
    return F.filter(F.transform(texts, span), lambda s: F.trim(s["text"]) != "")


def detector_input(suffix: Column, faint: Column) -> Column:
    """What a detector is handed: the path, or PNG bytes of a TIFF or of a faint page, which is stretched first."""
    return F.when(faint | F.lower(suffix).isin(".tif", ".tiff"), "png").otherwise("path")


def plausible_points(pixels: Column, dpi: Column) -> Column:
    """Page size in points; a missing or implausible resolution counts as 300."""
    sound = F.when(F.coalesce(dpi, F.lit(300.0)) < 50, F.lit(300.0)).otherwise(F.coalesce(dpi, F.lit(300.0)))
    return pixels / sound * 72


def sideways(votes: Column, blocks: Column) -> Column:
    """Enough blocks voted, and clearly for lines that run down the page."""
    return (blocks >= MIN_BLOCKS) & (votes <= -1)


def orientation(median: Column, votes: Column, blocks: Column, up: Column, script: str = "latin") -> Column:
    """How to turn a page upright from its measures: struct (turn, unsure).

    turn: clockwise degrees, 0 if unsure; a page whose lines run down is turned by 90 before its share of upright
    letters `up` was measured, and by 180 more if that says upside down. unsure: why it is left as it is, else null.
    Checks in their order: too dark, too little text, no clear line direction, no share, a share too near a half.
    """
    margin = MARGINS[script]
    near = F.format_string("cannot tell which way is up: %.2f is too near a half", up)
    unsure = (
        F.when(median < PAPER_MIN, "too dark to be a page of text")
        .when(blocks < MIN_BLOCKS, "no text to read")
        .when(F.abs(votes) < 1, "the lines run neither clearly across nor clearly down")
        .when(up.isNull(), TOO_FEW[script])
        .when((up < 0.5 + margin) & (up > 0.5 - margin), near)
    )
    quarter = F.when(votes < 0, 90).otherwise(0)
    turn = F.when(unsure.isNotNull(), 0).when(up >= 0.5 + margin, quarter).otherwise((quarter + 180) % 360)
    return F.struct(turn.cast("int").alias("turn"), unsure.alias("unsure"))


def orientation_text(turn: Column, unsure: Column) -> Column:
    """One line for a person."""
    return (
        F.when(unsure.isNotNull(), F.concat(F.lit("orientation unsure ("), unsure, F.lit("); read as it is")))
        .when(turn != 0, F.concat(F.lit("turned "), turn.cast("string"), F.lit("° clockwise to read")))
        .otherwise("upright")
    )


def refused_reason(width: Column, height: Column, pages: Column) -> Column:
    """Why an input is too large to admit; null if it is not."""
    return (
        F.when(width * height > 89_478_485, "too many pixels")
        .when(F.greatest(width, height) > 30_000, "side too long")
        .when(pages > 500, "too many pages")
    )


def psm_rank(psm: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, PSM_ORDER)), psm)
    return F.when(place == 0, len(PSM_ORDER)).otherwise(place - 1).cast("int")


def tie_break(char_sim: Column, psm: Column, contrast: Column) -> Column:
    """The smallest of these is the best cell of a grid."""
    return F.struct((-char_sim).alias("s"), psm_rank(psm).alias("p"), F.abs(contrast - PLAIN_CONTRAST).alias("c"))
