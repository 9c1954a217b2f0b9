"""Configuration grids, regret, routing rules and the exact fit of setting bands."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.functions import outputs, rules


def best_cells(sweep: DataFrame) -> DataFrame:
    """The best cell of each fixture by the tie-break key."""
    key = rules.tie_break(F.col("char_sim"), F.col("psm"), F.col("contrast"))
    best = sweep.groupBy("fixture").agg(F.min_by(F.struct("contrast", "psm", "char_sim"), key).alias("b"))
    return best.select("fixture", "b.*")


def grid_reference(sweep: DataFrame) -> DataFrame:
    """(fixture, best, plain, floor): the ceiling, the default cell's score, and what a fit must reach."""
    plain = F.max(F.when((F.col("contrast") == rules.PLAIN_CONTRAST) & (F.col("psm") == 3), F.col("char_sim")))
    out = sweep.groupBy("fixture").agg(F.max("char_sim").alias("best"), plain.alias("plain"))
    return out.withColumn("floor", F.greatest("plain", F.lit(rules.CI_CHAR)))


def cell_costs(sweep: DataFrame) -> DataFrame:
    """The cost of each cell as a struct that compares field by field: violations, regret, psm rank, contrast distance."""
    # By hash and never by broadcast: cells are made of few bytes, so that their number is not seen in a plan.
    cells = sweep.join(grid_reference(sweep).hint("shuffle_hash"), "fixture")
    low = lambda c, bound: (F.col(c) < bound - rules.EPSILON).cast("int")
    violations = low("char_sim", F.col("plain")) + low("char_sim", F.lit(rules.CI_CHAR)) + low("word_recall", F.lit(rules.CI_WORD))
    cost = F.struct(
        violations.alias("violations"), (F.col("best") - F.col("char_sim")).alias("regret"),
        rules.psm_rank(F.col("psm")).alias("psm_rank"), F.abs(F.col("contrast") - rules.PLAIN_CONTRAST).alias("distance"),
    )
    return cells.withColumn("cost", cost)


def rule_family(spark: SparkSession) -> DataFrame:
    """(rule_ord, kind, parameter): linear weights 1.0 to 0.0, then powers."""
    rows = [("weight", round(1 - 0.1 * i, 1)) for i in range(11)] + [("power", p) for p in (0.5, 1.0, 2.0, 3.0)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rule_ord int, kind string, parameter double")


def rule_choices(candidates: DataFrame, family: DataFrame) -> DataFrame:
    """(rule_ord, kind, parameter, file, engine, regret): what each rule picks, against the best char_sim of the file."""
    each = candidates.groupBy("file").agg(
        F.collect_list(F.struct("engine_ord", "engine", "score", "words", "char_sim")).alias("c"), F.greatest(F.max("words"), F.lit(1)).alias("m")
    )
    tried = each.crossJoin(F.broadcast(family))  # a fixed set of rules beside each file
    value = lambda c: F.when(F.col("kind") == "weight", rules.effective_score(c["score"], c["words"], F.col("m"), F.col("parameter"))).otherwise(
        rules.power_score(c["score"], c["words"], F.col("parameter"))
    )
    ranked = F.transform("c", lambda c: F.struct((-F.round(value(c), 9)).alias("v"), c["engine_ord"].alias("o"), c.alias("c")))
    picked = tried.withColumn("b", F.array_min(ranked)["c"]).withColumn("best", F.array_max(F.transform("c", lambda c: c["char_sim"])))
    return picked.select("rule_ord", "kind", "parameter", "file", F.size("c").alias("n"), F.col("b.engine").alias("engine"), (F.col("best") - F.col("b.char_sim")).alias("regret"))


def rule_regrets(choices: DataFrame) -> DataFrame:
    """Mean regret of each rule over the files with two candidates or more, the recommended rule first."""
    mean = choices.where("n >= 2").groupBy("rule_ord", "kind", "parameter").agg(F.avg("regret").alias("regret"), F.count("*").alias("files"))
    distance = F.when(F.col("kind") == "weight", F.abs(F.col("parameter") - 0.5)).otherwise(10.0)
    return mean.withColumn("distance", distance).orderBy(F.round("regret", 6), "distance", "rule_ord")


def band_rows(bands: DataFrame) -> DataFrame:
    """Add `lower`, the previous upper bound or 0, to (setting, idx, upper, value)."""
    order = Window.partitionBy("setting").orderBy("idx")
    bound = F.when(F.col("upper") == float("inf"), "unbounded").otherwise(outputs.printed(F.col("upper"), 4))
    return bands.withColumn("lower", F.lag("upper", 1, 0.0).over(order)).withColumn("shown", bound)


def contiguous_runs(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, run, value, first, last, n): runs of equal values along an ordering."""
    along = Window.partitionBy(group).orderBy(order)
    change = F.coalesce((F.lag(value).over(along) != F.col(value)).cast("int"), F.lit(0))
    marked = df.withColumn("__change", change).withColumn("run", F.sum("__change").over(along))
    return marked.groupBy(group, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def drifted(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows in which a committed band table and a derived one differ: empty if they agree."""
    return stored.exceptAll(derived).withColumn("side", F.lit("stored")).unionByName(derived.exceptAll(stored).withColumn("side", F.lit("derived")))


def best_partition(costs: list[dict], most: int) -> tuple[tuple, list]:
    """The cheapest step function over ordered groups: costs[i][value] is a tuple that adds by field. Exact, by prefixes."""
    n, values = len(costs), list(costs[0])
    add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
    zero = tuple(0 for _ in next(iter(costs[0].values())))
    best = {(0, 0, None): (zero, [])}
    for end in range(1, n + 1):
        for runs in range(1, min(most, end) + 1):
            for value in values:
                total, found = zero, None
                for start in range(end - 1, -1, -1):
                    total = add(costs[start][value], total)
                    for (at, r, before), (cost, path) in best.items():
                        if at == start and r == runs - 1 and before != value:
                            option = (add(cost, total), path + [value] * (end - start))
                            if found is None or option[0] < found[0]:
                                found = option
                if found:
                    best[(end, runs, value)] = found
    return min((v for (at, _, _), v in best.items() if at == n), key=lambda x: x[0])


def fitted_bands(fixtures: list[dict], values: list, most: int) -> tuple[tuple, list[tuple[float, object]]]:
    """Bands (bound, value) of one feature: fixtures hold `feature` and `cost` by value; equal features stay together.

    The fit is over a handful of fixtures by design, so it runs on the driver.
    """
    groups = tied(fixtures, "feature")
    costs = [{v: tuple(map(sum, zip(*[f["cost"][v] for f in g], strict=True))) for v in values} for g in groups]
    cost, chosen = best_partition(costs, most)
    return cost, banded([g[0]["feature"] for g in groups], chosen)


def tied(fixtures: list[dict], feature: str) -> list[list[dict]]:
    """Fixtures by ascending feature, those with equal ones together."""
    return [list(g) for _, g in itertools.groupby(sorted(fixtures, key=lambda f: f[feature]), key=lambda f: f[feature])]


def banded(features: list[float], chosen: list) -> list[tuple[float, object]]:
    """Bands (bound, value) of the values chosen along ascending features."""
    ends = [i for i in range(len(chosen)) if i + 1 == len(chosen) or chosen[i + 1] != chosen[i]]
    return [(math.inf if i + 1 == len(chosen) else edge(features[i], features[i + 1]), chosen[i]) for i in ends]


def band_value(bands: list[tuple[float, object]], feature: float) -> object:
    return next(v for upper, v in bands if feature < upper)


def edge(low: float, high: float) -> float:
    mid = (low + high) / 2
    return next((c for c in (round(mid, k) for k in range(5)) if low < c <= high), mid)


def leave_one_out(fixtures: list[dict], values: list, most: int) -> list[tuple[str, object]]:
    """(fixture, value chosen by the bands fitted on the others)."""
    out = []
    for held in fixtures:
        _, bands = fitted_bands([f for f in fixtures if f is not held], values, most)
        out.append((held["fixture"], band_value(bands, held["feature"])))
    return out
