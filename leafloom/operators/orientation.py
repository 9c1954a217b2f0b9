"""Page orientation from pixels: which way the lines run, and on which side of them ink stands out.

Pixels are rows (image, x, y, v), v being ink from 0 to 255. They become profiles by partial aggregates, and a profile
(a few thousand numbers) is one array whose lines are found by array functions inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions.text import let
from leafloom.operators import imagestat

# Blocks a side; strips, fewest lines; least ink of a peak, rows between peaks, rows of a line's side, and
# how deep a valley is against its peak.
GRID, STRIPS, MIN_LINES = 12, 8, 5
LEAST_PEAK, APART, NARROW, WIDE, DEEP = 0.01, 6, 3, 80, 0.5


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def _sized(pixels: DataFrame) -> DataFrame:
    """Pixels with their picture's width and height. Sizes are looked up by hash: pixels are neither sorted nor, if they are
    dealt by picture, moved."""
    return pixels.join(sizes(pixels).hint("shuffle_hash"), "image")


def turned(pixels: DataFrame, degrees: DataFrame) -> DataFrame:
    """Pixels of (image, turn) pictures turned clockwise by a multiple of 90 degrees; a picture without a turn stays. Its turn is
    looked up beside its size, so that a row that names it again makes no more pixels."""
    turn = F.pmod(F.coalesce(F.min("turn"), F.lit(0)), F.lit(360)).alias("turn")
    told = sizes(pixels).join(degrees.hint("shuffle_hash"), "image", "left").groupBy("image", "width", "height").agg(turn)
    own = pixels.join(told.hint("shuffle_hash"), "image")
    right, below = F.col("width") - 1 - F.col("x"), F.col("height") - 1 - F.col("y")
    x = F.when(F.col("turn") == 90, below).when(F.col("turn") == 180, right).when(F.col("turn") == 270, F.col("y")).otherwise(F.col("x"))
    y = F.when(F.col("turn") == 90, F.col("x")).when(F.col("turn") == 180, below).when(F.col("turn") == 270, right).otherwise(F.col("y"))
    return own.select("image", x.alias("x"), y.alias("y"), "v")


FULL = 255


def level(mean: Column) -> Column:
    """A mean as a whole level, as a profile of 8-bit pixels holds it: sums of levels are exact, and so are ties."""
    return F.floor(mean + 0.5)


def blocks(pixels: DataFrame, grid: int = GRID) -> DataFrame:
    """(image, block, var_row, var_col, mean, peak) of a grid of equal blocks, pixels beyond the last whole one left out.

    One pass sums the pixels of each row and of each column of a block; a second takes both profiles' variances.
    """
    own = _sized(pixels).withColumns({"bw": F.floor(F.col("width") / grid), "bh": F.floor(F.col("height") / grid)})
    own = own.where((F.col("x") < grid * F.col("bw")) & (F.col("y") < grid * F.col("bh")))
    own = own.select("image", (F.floor(F.col("y") / F.col("bh")) * grid + F.floor(F.col("x") / F.col("bw"))).alias("block"), "x", "y", "v")
    either = F.explode(F.array(F.struct(F.lit(True).alias("across"), F.col("y").alias("at")), F.struct(F.lit(False).alias("across"), F.col("x").alias("at"))))
    lines = own.select("image", "block", "v", either.alias("l")).groupBy("image", "block", "l.across", "l.at").agg(level(F.avg("v")).alias("v"))
    row, col = F.when(F.col("across"), F.col("v")), F.when(~F.col("across"), F.col("v"))
    variance = lambda c, name: (F.var_pop(c) / (FULL * FULL)).alias(name)
    return lines.groupBy("image", "block").agg(variance(row, "var_row"), variance(col, "var_col"), (F.avg(row) / FULL).alias("mean"), (F.max("v") / FULL).alias("peak"))


def line_direction(pixels: DataFrame) -> DataFrame:
    """(image, vote, blocks): above 0 lines run across, below 0 down; a variance under 1e-12 is none."""
    none = lambda c: F.when(F.col(c) < 1e-12, 0.0).otherwise(F.col(c)).alias(c)
    return imagestat.block_vote(blocks(pixels).select("image", none("var_row"), none("var_col"), "mean", "peak"))


def smoothed(rows: Column) -> Column:
    """Means of three neighbours, of two at the ends."""
    near = lambda i: F.coalesce(F.get(rows, i), F.lit(0.0))
    return F.transform(rows, lambda v, i: (near(i - 1) + v + near(i + 1)) / (F.lit(3) - (i == 0).cast("int") - (i == F.size(rows) - 1).cast("int")))


def _last(places: Column) -> Column:
    return F.get(places, F.size(places) - 1)


def _without_last(places: Column) -> Column:
    return F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0)))


def _cut(values: Column, low: Column, high: Column) -> Column:
    """values[low..high], both ends included."""
    return F.slice(values, low + 1, F.greatest(high - low + 1, F.lit(0)))


def peaks(sm: Column) -> Column:
    """Places of maxima, the higher of two that are too near each other; maxima without a dip below half the lower of them
    between them are one line, of which the highest stands."""
    empty = F.expr("cast(array() as array<int>)")
    inner = F.when(F.size(sm) >= 5, F.sequence(F.lit(2), F.size(sm) - 3)).otherwise(empty)
    tops = F.filter(inner, lambda y: (F.get(sm, y) > F.get(sm, y - 1)) & (F.get(sm, y) >= F.get(sm, y + 1)) & (F.get(sm, y) > LEAST_PEAK))

    def higher(kept: Column, y: Column) -> Column:
        return F.when(F.get(sm, y) > F.get(sm, _last(kept)), F.concat(_without_last(kept), F.array(y))).otherwise(kept)

    def thin(kept: Column, y: Column) -> Column:
        return F.when((F.size(kept) > 0) & (y - _last(kept) < APART), higher(kept, y)).otherwise(F.concat(kept, F.array(y)))

    def merge(kept: Column, y: Column) -> Column:
        dip = F.array_min(_cut(sm, _last(kept), y))
        one = (F.size(kept) > 0) & (dip > DEEP * F.least(F.get(sm, _last(kept)), F.get(sm, y)))
        return F.when(F.coalesce(one, F.lit(False)), higher(kept, y)).otherwise(F.concat(kept, F.array(y)))

    return F.aggregate(F.aggregate(tops, empty, thin), empty, merge)


def valley(sm: Column, low: Column, high: Column) -> Column:
    """The middle of the lowest places between two, so that neither side is favoured."""
    places = lambda floor: F.filter(F.sequence(low, high), lambda y: F.get(sm, y) <= floor + 1e-9)
    return let(F.array_min(_cut(sm, low, high)), lambda floor: let(places(floor), lambda p: F.get(p, F.floor(F.size(p) / 2).cast("int"))))


def text_lines(rows: Column) -> Column:
    """struct(sm, candidates, lines): the smoothed profile, how many lines have sides of a plausible width, and those
    (a, p, b) of them whose peak is at least twice as high as the valleys beside it. Null for a null profile."""

    def line(sm: Column, all_: Column, p: Column, k: Column) -> Column:
        low = F.coalesce(F.get(all_, k - 1), F.greatest(p - WIDE, F.lit(0)))
        high = F.coalesce(F.get(all_, k + 1), F.least(p + WIDE, F.size(sm) - 1))
        return F.struct(valley(sm, low, p).alias("a"), p.alias("p"), valley(sm, p, high).alias("b"))

    wide = lambda n: (n >= NARROW) & (n <= WIDE)
    plausible = lambda ls: F.filter(ls, lambda x: wide(x["p"] - x["a"]) & wide(x["b"] - x["p"]))
    formed = lambda sm, ls: F.filter(ls, lambda x: F.greatest(F.get(sm, x["a"]), F.get(sm, x["b"])) <= DEEP * F.get(sm, x["p"]))

    def found(sm: Column) -> Column:
        every = let(peaks(sm), lambda all_: F.transform(all_, lambda p, k: line(sm, all_, p, k)))
        return let(plausible(every), lambda ls: F.struct(sm.alias("sm"), F.size(ls).alias("candidates"), formed(sm, ls).alias("lines")))

    return let(let(rows, smoothed), found)


def shares_above(found: Column) -> Column:
    """Of each line's ink farther out than where its peak has fallen to half, the share above; lines without such ink are left out."""
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    def sides(sm: Column, x: Column) -> Column:
        half = DEEP * F.get(sm, x["p"])
        low = lambda a, b: F.filter(F.sequence(a, b), lambda y: F.get(sm, y) < half)
        top = F.coalesce(F.array_max(low(x["a"], x["p"])), x["a"])
        bottom = F.coalesce(F.array_min(low(x["p"], x["b"])), x["b"])
        return F.struct(total(_cut(sm, x["a"], top - 1)).alias("above"), total(_cut(sm, bottom + 1, x["b"])).alias("below"))

    each = F.transform(found["lines"], lambda x: sides(found["sm"], x))
    return F.transform(F.filter(each, lambda s: s["above"] + s["below"] > 0), lambda s: s["above"] / (s["above"] + s["below"]))


def strip_profiles(pixels: DataFrame, strips: int = STRIPS) -> DataFrame:
    """(image, strip, rows): the mean ink of each row of each vertical strip, from the top; columns beyond the last whole
    strip are left out, and rows without a pixel are bare."""
    own = _sized(pixels).withColumn("sw", F.floor(F.col("width") / strips)).where(F.col("x") < strips * F.col("sw"))
    means = own.groupBy("image", F.floor(F.col("x") / F.col("sw")).alias("strip"), "height", "y").agg((level(F.avg("v")) / FULL).alias("v"))
    each = means.groupBy("image", "strip", "height").agg(F.sort_array(F.collect_list(F.struct(F.col("y").cast("int").alias("y"), "v"))).alias("at"))
    bare = lambda n: F.array_repeat(F.lit(0.0), n)
    before = lambda i: F.coalesce(F.get("at", i - 1)["y"], F.lit(-1))
    filled = F.flatten(F.transform("at", lambda r, i: F.concat(bare(r["y"] - before(i) - 1), F.array(r["v"]))))
    rows = F.concat(filled, bare(F.col("height").cast("int") - 1 - F.element_at("at", -1)["y"]))
    return each.select("image", "strip", rows.alias("rows"))


def up_shares(profiles: DataFrame) -> DataFrame:
    """(image, share, found, seen): the median share of outer ink above the lines of all strips; null with fewer than
    MIN_LINES lines, or if most candidates were rejected: what was measured is then not a page of text."""
    lines = profiles.select("image", text_lines(F.col("rows")).alias("f"))
    each = lines.select("image", F.col("f.candidates").alias("seen"), let(F.col("f"), shares_above).alias("shares"))
    sums = each.groupBy("image").agg(F.sum("seen").alias("seen"), F.flatten(F.collect_list("shares")).alias("s"))
    found = F.size("s")
    middle = let(F.sort_array("s"), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)
    share = F.when((found >= MIN_LINES) & (found >= F.col("seen") / 2), middle)
    return sums.select("image", share.alias("share"), found.cast("long").alias("found"), "seen")
