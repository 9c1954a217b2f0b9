"""Image measures over histograms and profiles held as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions.outputs import rounded


def histogram_quantile(levels: DataFrame, share: float) -> DataFrame:
    """(image, level): the smallest level at which the cumulative count reaches the share; 255 without pixels."""
    along = Window.partitionBy("image").orderBy("level")
    total = levels.groupBy("image").agg(F.sum("n").alias("total"))
    running = levels.withColumn("running", F.sum("n").over(along)).join(total, "image")
    reached = F.when((F.col("total") > 0) & (F.col("running") >= share * F.col("total")), F.col("level"))
    return running.groupBy("image").agg(F.coalesce(F.min(reached), F.lit(255)).alias("level"))


def grey_statistics(levels: DataFrame) -> DataFrame:
    """(image, stddev, dark_pct) from a histogram (image, level, n)."""
    n, level = F.col("n"), F.col("level").cast("double")
    sums = levels.groupBy("image").agg(
        F.sum(n).alias("n"), F.sum(n * level).alias("s"), F.sum(n * level * level).alias("q"), F.sum(F.when(level < 128, n).otherwise(0)).alias("dark")
    )
    mean = F.col("s") / F.col("n")
    return sums.select("image", F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("stddev"), (100 * (F.col("dark") / F.col("n"))).alias("dark_pct"))


def interior_gutters(profile: DataFrame, width_share: float = 0.02) -> DataFrame:
    """(image, gutters): long runs of paper columns (image, x, value) that have ink on both sides."""
    own = Window.partitionBy("image")
    bounds = {"low": F.min("value").over(own), "high": F.max("value").over(own), "width": F.count("*").over(own)}
    marked = profile.withColumns(bounds).withColumn("paper", F.col("value") > (F.col("low") + F.col("high")) / 2)
    along, alike = Window.partitionBy("image").orderBy("x"), Window.partitionBy("image", "paper").orderBy("x")
    island = F.row_number().over(along) - F.row_number().over(alike)
    runs = marked.withColumn("island", island).groupBy("image", "paper", "island").agg(
        F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.first("width").alias("width"), F.first("low").alias("low"), F.first("high").alias("high")
    )
    found = runs.withColumns({"first_ink": F.min(F.when(~F.col("paper"), F.col("a"))).over(own), "last_ink": F.max(F.when(~F.col("paper"), F.col("b"))).over(own)})
    least = F.greatest(F.lit(1), F.floor(F.col("width") * width_share))
    counted = F.col("paper") & (F.col("n") >= least) & (F.col("a") > F.col("first_ink")) & (F.col("b") < F.col("last_ink")) & (F.col("high") - F.col("low") >= 8)
    return found.groupBy("image").agg(F.count_if(counted).alias("gutters"))


def features(levels: DataFrame, profile: DataFrame, sizes: DataFrame) -> DataFrame:
    """(fixture, stddev, dark_pct, interior_gutters, width, height): the feature table of all images of `sizes` (image,
    width, height), sorted; stddev and dark_pct to four places. Images without a histogram or profile have nulls."""
    grey = grey_statistics(levels).select("image", rounded(F.col("stddev"), 4).alias("stddev"), rounded(F.col("dark_pct"), 4).alias("dark_pct"))
    gutters = interior_gutters(profile).withColumnRenamed("gutters", "interior_gutters")
    rows = sizes.join(grey, "image", "left").join(gutters, "image", "left")
    return rows.select(F.col("image").alias("fixture"), "stddev", "dark_pct", "interior_gutters", "width", "height").orderBy("fixture")


def moving_average(profile: DataFrame, width: int) -> DataFrame:
    """Centred mean, over fewer values at the edges."""
    half = width // 2
    along = Window.partitionBy("image").orderBy("x").rowsBetween(-half, half)
    return profile.withColumn("smooth", F.avg("value").over(along))


def block_vote(blocks: DataFrame) -> DataFrame:
    """(image, vote, blocks): median log ratio of row to column variance of the blocks with a plausible share of ink.

    A block without variance has no direction and is left out; an image without any block left has vote 0 of 0 blocks.
    """
    plausible = (F.col("mean") >= 0.005) & (F.col("mean") <= 0.5) & (F.col("peak") <= 8 * F.col("mean")) & (F.col("var_row") + F.col("var_col") > 0)
    vote = F.when(plausible, F.log((F.col("var_row") + 1e-9) / (F.col("var_col") + 1e-9)))
    return blocks.groupBy("image").agg(F.coalesce(F.median(vote), F.lit(0.0)).alias("vote"), F.count(vote).alias("blocks"))


def lifted(levels: DataFrame) -> DataFrame:
    """(image, lift): ink is faint and paper clearly lighter, so contrast should be stretched."""
    ink, paper = histogram_quantile(levels, 0.001), histogram_quantile(levels, 0.6).withColumnRenamed("level", "paper")
    return ink.join(paper, "image").select("image", ((F.col("level") > 45) & (F.col("paper") >= F.col("level") + 30)).alias("lift"))
