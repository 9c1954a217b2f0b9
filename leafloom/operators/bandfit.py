"""Joint fit of two families of bands: contrast by stddev and page mode by dark_pct, under one total cost.

The families do not separate, as a cell's cost depends on both settings. Every way to give the places along dark_pct a
mode in a few runs has a number; `spark.range` deals the numbers out, a task decodes its own and prices all of a batch
at once: for each, the best contrast bands follow from one dynamic program over the places along stddev. Neither ways
nor prices pass through the driver, which sees one winner a fold. Leaving each fixture out in turn is a fold more.

A fit is over the fixtures of a corpus, a dozen or so: their costs (fixtures x cells) go to the tasks as one array,
refused beyond MOST_FIXTURES.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.operators.calibrate import edge

MOST_FIXTURES = 1000
#: Features closer than this cannot be cut apart.
SAME = 1e-12
#: A cost is two whole numbers that add by fixture: violations and regret (in 1e-9), then mode rank and distance (in 1e-6).
VIOLATION, RANK = 1 << 42, 1 << 40
FAR = 1 << 61
#: Ways that are priced together.
BLOCK = 2048


@dataclass(frozen=True)
class Problem:
    names: list[str]
    stddev: np.ndarray
    dark_pct: np.ndarray
    contrasts: list[float]
    psms: list[int]
    main: np.ndarray  # (fixture, contrast, psm)
    minor: np.ndarray
    most_contrasts: int
    most_psms: int

    def fold(self, k: int) -> Fold:
        """The fold that leaves fixture k out; of fold -1, none is."""
        return Fold(self, np.flatnonzero(np.arange(len(self.names)) != k))

    def ways(self, k: int) -> int:
        return number_of_ways(len(self.fold(k).dark_ends), len(self.psms), self.most_psms)


def places(values: np.ndarray) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The place of each value, those that cannot be cut apart sharing one, and the (least, largest) value of each place."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    fresh = np.concatenate([[False], np.diff(ranked) > SAME]) if len(values) else np.zeros(0, bool)
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(fresh)
    ends = [(float(part[0]), float(part[-1])) for part in np.split(ranked, np.flatnonzero(fresh))] if len(values) else []
    return place, ends


class Fold:
    """The fixtures of one fit, by their places along both features."""

    def __init__(self, problem: Problem, kept: np.ndarray):
        self.problem, self.kept = problem, kept
        self.light, self.light_ends = places(problem.stddev[kept])
        self.dark, self.dark_ends = places(problem.dark_pct[kept])

    def prefixes(self, psm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, contrast, way) costs of all fixtures before a place, if each took that contrast; psm: (way, dark place)."""
        out = []
        for cost in (self.problem.main, self.problem.minor):
            each = np.zeros((len(self.light_ends) + 1, len(self.problem.contrasts), len(psm)), np.int64)
            for f, light, dark in zip(self.kept, self.light, self.dark, strict=True):
                each[light + 1] += cost[f][:, psm[:, dark]]
            out.append(np.cumsum(each, axis=0))
        return out[0], out[1]

    def solved(self, psm: np.ndarray, trace: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
        """The least cost of each way, and the contrast runs (start place, contrast number) of the first one if asked for.

        best[j]: the cheapest banding of the places before j in a given number of runs. For each contrast of the last
        run, the cheapest start is kept while j goes on. Ties: fewer runs, then the earlier start, then the first contrast.
        """
        main, minor = self.prefixes(psm)
        n, n_contrasts, n_ways = main.shape[0] - 1, main.shape[1], main.shape[2]
        best = (np.full((n + 1, n_ways), FAR), np.zeros((n + 1, n_ways), np.int64))
        best[0][0] = 0
        least, back, runs_of = (np.full(n_ways, FAR), np.zeros(n_ways, np.int64)), [], np.zeros(n_ways, np.int64)
        for runs in range(1, min(self.problem.most_contrasts, n) + 1):
            low = [np.full((n_contrasts, n_ways), FAR), np.zeros((n_contrasts, n_ways), np.int64)]
            begin = np.zeros((n_contrasts, n_ways), np.int64)
            now = (np.full((n + 1, n_ways), FAR), np.zeros((n + 1, n_ways), np.int64))
            steps = np.zeros((n + 1, 2, n_ways), np.int64)
            for j in range(1, n + 1):
                a, b = best[0][j - 1] - main[j - 1], best[1][j - 1] - minor[j - 1]
                better = ((a < low[0]) | ((a == low[0]) & (b < low[1]))) & (best[0][j - 1] < FAR)
                low = [np.where(better, a, low[0]), np.where(better, b, low[1])]
                begin = np.where(better, j - 1, begin)
                for c in range(n_contrasts):
                    a, b = np.where(low[0][c] < FAR, low[0][c] + main[j][c], FAR), low[1][c] + minor[j][c]
                    same = (a == now[0][j]) & (b == now[1][j])
                    better = (a < now[0][j]) | ((a == now[0][j]) & (b < now[1][j])) | (same & (begin[c] < steps[j, 0]))
                    now[0][j], now[1][j] = np.where(better, a, now[0][j]), np.where(better, b, now[1][j])
                    steps[j] = np.where(better, [begin[c], np.full(n_ways, c)], steps[j])
            back.append(steps if trace else None)
            better = (now[0][n] < least[0]) | ((now[0][n] == least[0]) & (now[1][n] < least[1]))
            least = (np.where(better, now[0][n], least[0]), np.where(better, now[1][n], least[1]))
            runs_of = np.where(better, runs, runs_of)
            best = now
        found: list[tuple[int, int]] = []
        if trace:
            j = n
            for runs in range(int(runs_of[0]), 0, -1):
                start, c = back[runs - 1][j, :, 0]
                found.insert(0, (int(start), int(c)))
                j = int(start)
        return least[0], least[1], found


def number_of_ways(groups: int, values: int, most: int) -> int:
    """How many ways there are to give ordered places values in at most `most` runs, neighbours of which differ."""
    return sum(math.comb(groups - 1, runs - 1) * values * (values - 1) ** (runs - 1) for runs in range(1, min(most, groups) + 1))


def decoded(numbers: np.ndarray, groups: int, values: int, most: int) -> np.ndarray:
    """(number, place) of value numbers: the ways of `number_of_ways`, by runs, then by where they begin, then by values."""
    out = np.zeros((len(numbers), groups), np.int64)
    left, open_ = numbers.astype(np.int64), np.ones(len(numbers), bool)
    for runs in range(1, min(most, groups) + 1):
        of_cuts = values * (values - 1) ** (runs - 1)
        n = math.comb(groups - 1, runs - 1) * of_cuts
        mine = np.flatnonzero(open_ & (left < n))
        open_ &= left >= n
        if len(mine):
            rank, digits = np.divmod(left[mine], of_cuts)
            # The places at which runs begin, in ascending order: the first is the largest whose lower ones are passed.
            cut = np.zeros(len(mine), np.int64)
            run_of = np.zeros((len(mine), groups), np.int64)
            for k in range(runs - 1):
                at_most = np.concatenate([[0], np.cumsum([math.comb(groups - 1 - c, runs - 2 - k) for c in range(1, groups)])])
                next_ = np.searchsorted(at_most, rank + at_most[cut], "right")
                rank = rank + at_most[cut] - at_most[next_ - 1]
                cut = next_
                run_of += np.arange(groups)[None, :] >= cut[:, None]
            value = np.empty((len(mine), runs), np.int64)
            for k in range(runs):
                digit, digits = np.divmod(digits, (values - 1) ** (runs - 1 - k))
                value[:, k] = digit if k == 0 else digit + (digit >= value[:, k - 1])
            out[mine] = np.take_along_axis(value, run_of, axis=1)
        left = left - np.where(open_, n, 0)
    return out


def problem(cells: DataFrame, features: DataFrame, most_contrasts: int, most_psms: int) -> Problem:
    """From cells (fixture, contrast, psm, cost), as `calibrate.cell_costs` leaves them, and (fixture, stddev, dark_pct)."""
    names = [(r["fixture"], r["stddev"], r["dark_pct"]) for r in features.orderBy("fixture").limit(MOST_FIXTURES + 1).collect()]
    if len(names) > MOST_FIXTURES:
        raise ValueError(f"more than {MOST_FIXTURES} fixtures")
    rows = cells.select("fixture", "contrast", "psm", "cost.*").toPandas()
    contrasts, psms = sorted(rows["contrast"].unique()), sorted(rows["psm"].unique())
    if len(rows) != len(names) * len(contrasts) * len(psms):
        raise ValueError("every fixture needs every cell once")
    at = {name: i for i, (name, _, _) in enumerate(names)}
    place = (rows["fixture"].map(at).to_numpy(np.int64), np.searchsorted(contrasts, rows["contrast"]), np.searchsorted(psms, rows["psm"]))
    main, minor = (np.zeros((len(names), len(contrasts), len(psms)), np.int64) for _ in range(2))
    main[place] = rows["violations"].astype(np.int64) * VIOLATION + (rows["regret"] * 1e9).round().astype(np.int64)
    minor[place] = rows["psm_rank"].astype(np.int64) * RANK + (rows["distance"] * 1e6).round().astype(np.int64)
    stddev, dark = (np.array([n[k] for n in names], float) for k in (1, 2))
    return Problem([str(n[0]) for n in names], stddev, dark, [float(c) for c in contrasts], [int(p) for p in psms], main, minor, most_contrasts, most_psms)


def fitted(cells: DataFrame, features: DataFrame, most_contrasts: int = 5, most_psms: int = 4, leave_out: bool = False) -> DataFrame:
    """(fold, violations, regret, setting, idx, upper, value): the bands that cost least together, of all fixtures (fold
    null) and, if asked for, of those that are left when one is left out (fold: its name). No fixtures give no rows."""
    own = problem(cells, features, most_contrasts, most_psms)
    folds = ([-1] if own.names else []) + (list(range(len(own.names))) if leave_out and len(own.names) > 1 else [])
    starts = np.cumsum([0] + [own.ways(k) for k in folds])
    spark = cells.sparkSession
    parcel = spark.sparkContext.broadcast(own)

    def priced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            numbers = pdf["id"].to_numpy()
            part = np.searchsorted(starts, numbers, "right") - 1
            for k in np.unique(part):
                fold, mine = parcel.value.fold(folds[k]), numbers[part == k] - starts[k]
                for at in range(0, len(mine), BLOCK):
                    some = mine[at : at + BLOCK]
                    main, minor, _ = fold.solved(decoded(some, len(fold.dark_ends), len(own.psms), most_psms))
                    first = np.lexsort((some, minor, main))[0]
                    yield pd.DataFrame({"k": [folds[k]], "main": [main[first]], "minor": [minor[first]], "way": [some[first]]})

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, main, way in zip(pdf["k"], pdf["main"], pdf["way"], strict=True):
                p, fold = parcel.value, parcel.value.fold(k)
                psm = decoded(np.array([way]), len(fold.dark_ends), len(p.psms), most_psms)
                _, _, light = fold.solved(psm, trace=True)
                dark = [(i, int(psm[0, i])) for i in range(psm.shape[1]) if i == 0 or psm[0, i] != psm[0, i - 1]]
                light = [run for i, run in enumerate(light) if i == 0 or run[1] != light[i - 1][1]]
                for setting, runs, ends, values in (("contrast", light, fold.light_ends, p.contrasts), ("psm", dark, fold.dark_ends, p.psms)):
                    uppers = [edge(ends[at - 1][1], ends[at][0]) for at, _ in runs[1:]] + [math.inf]
                    yield pd.DataFrame({
                        "fold": [p.names[k] if k >= 0 else None] * len(runs), "violations": int(main) // VIOLATION, "regret": int(main) % VIOLATION / 1e9,
                        "setting": setting, "idx": range(len(runs)), "upper": uppers, "value": [float(values[v]) for _, v in runs],
                    })

    ids = spark.range(0, int(starts[-1]), 1, max(1, min(spark.sparkContext.defaultParallelism * 4, int(starts[-1]) // BLOCK + 1)))
    best = ids.mapInPandas(priced, "k int, main long, minor long, way long").groupBy("k").agg(F.min(F.struct("main", "minor", "way")).alias("b"))
    return best.select("k", "b.main", "b.way").mapInPandas(banded, "fold string, violations long, regret double, setting string, idx int, upper double, value double")


def applied(bands: DataFrame, features: DataFrame) -> DataFrame:
    """(fold, fixture, contrast, psm): what the bands of each fold give each fixture; a bound itself lies in the next band."""
    both = bands.join(features, F.when(F.col("setting") == "contrast", F.col("stddev")).otherwise(F.col("dark_pct")) < F.col("upper"))
    pick = lambda s: F.min_by("value", F.when(F.col("setting") == s, F.col("upper")))
    return both.groupBy("fold", "fixture").agg(pick("contrast").alias("contrast"), pick("psm").cast("int").alias("psm"))


def leave_one_out(cells: DataFrame, features: DataFrame, most_contrasts: int = 5, most_psms: int = 4) -> DataFrame:
    """(fixture, contrast, psm, regret, in_sample, loo_mean, gap): each fixture under the bands fitted without it.

    in_sample: its regret under the bands of all; gap: the mean regret when left out less the mean in-sample one.
    """
    bands = fitted(cells, features, most_contrasts, most_psms, leave_out=True).persist()  # a few rows a fixture, read twice
    named = features.withColumn("fixture", F.col("fixture").cast("string"))
    scores = cells.select(F.col("fixture").cast("string").alias("fixture"), "contrast", "psm", F.col("cost.regret").alias("regret"))
    held = applied(bands.where("fold is not null"), named).where("fold = fixture").join(scores, ["fixture", "contrast", "psm"])
    inside = applied(bands.where("fold is null"), named).join(scores, ["fixture", "contrast", "psm"]).select("fixture", F.col("regret").alias("in_sample"))
    rows = held.select("fixture", "contrast", "psm", "regret").join(inside, "fixture")
    means = rows.agg(F.avg("regret").alias("loo_mean"), (F.avg("regret") - F.avg("in_sample")).alias("gap"))
    return rows.crossJoin(F.broadcast(means))  # one row of means
