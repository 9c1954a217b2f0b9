"""Studies over scored transcripts: all engines against ground truth, serialisations of pages, checks of a fit, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators import evaluate, layout


def scored_pairs(transcripts: DataFrame, expected: DataFrame) -> DataFrame:
    """(fixture, backend, chr, wrd, sec) of transcripts (fixture, backend, text, sec) that have an expected text (fixture,
    expected); null scores where the transcript is null: such an engine failed there, and averages skip it."""
    pairs = transcripts.join(expected, "fixture")
    return pairs.select("fixture", "backend", _scores().alias("s"), "sec").select("fixture", "backend", "s.*", "sec")


def _scores() -> Column:
    """struct(chr, wrd) of the columns text and expected."""
    text, expected = F.col("text"), F.col("expected")
    return T.scores_of(T.normalise(text), T.normalise(expected), T.wanted_text(expected))


def evaluated(transcripts: DataFrame, expected: DataFrame, backends: list[str]) -> DataFrame:
    """The wide table of all engines with its Average row."""
    return with_average(evaluate.wide(scored_pairs(transcripts, expected), backends))


def with_average(table: DataFrame) -> DataFrame:
    """A wide table and its Average row: means of scores, total seconds."""
    means = [(F.sum if c.endswith("_sec") else F.avg)(c).alias(c) for c in table.columns if c != "fixture"]
    average = table.agg(*means).select(F.lit("Average").alias("fixture"), *table.columns[1:])
    return table.withColumn("fixture", F.col("fixture").cast("string")).unionByName(average)


def averages(table: DataFrame) -> DataFrame:
    """Means by backend recomputed from the detail rows of a wide table; a backend without values is left out."""
    return evaluate.backend_summary(evaluate.long(table)).where("chr is not null")


def serialisations(spans: DataFrame) -> DataFrame:
    """(page, strategy, text): the spans in the engine's order, in lines across the page, and in reading order.

    All three are made in the row of the page; pages in rows (page, spans) are not shuffled.
    """
    return layout.told(spans, ["engine", "linesort", "column"])


def serialisation_scores(spans: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(page, strategy, chr, wrd) of every serialisation against (page, expected), or the pages' own column `expected`;
    a column `layout` of the pages stays."""
    return _told_scores(spans, expected, ["engine", "linesort", "column"])


def _told_scores(spans: DataFrame, expected: DataFrame | None, ways: list[str]) -> DataFrame:
    """(page, strategy, chr, wrd) of pages told in these ways, beside `layout` or `register` of the pages. What is expected is
    prepared once a page."""
    pages = layout.paged(spans)
    pages = pages if expected is None else pages.join(expected, "page")
    own = [c for c in ("page", "layout", "register") if c in pages.columns]
    pages = pages.select(*own, "spans", T.normalise(F.col("expected")).alias("expected"), T.wanted_text(F.col("expected")).alias("wanted"))
    scores = T.scores_of(T.normalise(F.col("text")), F.col("expected"), F.col("wanted"))
    return layout.told(pages, ways).select(*own, "strategy", scores.alias("s")).select(*own, "strategy", "s.*")


def reading_order_study(spans: DataFrame, expected: DataFrame | None = None, layouts: DataFrame | None = None) -> DataFrame:
    """(backend, layout, fixture, chr, wrd): every serialisation of every page of (page, layout) and, for each serialisation
    and layout, a `mean` row. Refused if a page's recall differs between serialisations, as then an order lost words."""
    scores = serialisation_scores(spans, expected).persist()  # a few numbers a page, which are checked and then read
    odd = uneven(scores).limit(5).collect()
    if odd:
        raise ValueError(f"serialisations of one page with different words: {odd}")
    rows = (scores if layouts is None else scores.join(layouts, "page")).select(F.col("strategy").alias("backend"), "layout", F.col("page").alias("fixture"), "chr", "wrd")
    return evaluate.with_group_means(rows).drop("is_mean")


def uneven(scores: DataFrame) -> DataFrame:
    """Pages whose recall differs between serialisations: must be empty, as an order loses no word."""
    return scores.groupBy("page").agg(F.min(F.round("wrd", 9)).alias("low"), F.max(F.round("wrd", 9)).alias("high")).where("low < high")


def shipped_text(spans: DataFrame) -> DataFrame:
    """The lines of the reading order, one below the other, words that a line break parts rejoined."""
    return layout.told(spans, ["shipped"]).select("page", "text")


#: Ways to make a text of a page's spans (layout.WAYS), by the name they are compared under.
STRATEGIES = {"detector": "engine", "lines": "linesort", "gutter": "gutter", "xy-cut": "column", "shipped": "shipped"}


def layout_comparison(spans: DataFrame, expected: DataFrame | None = None, registers: DataFrame | None = None, strategies: dict[str, str] = STRATEGIES) -> DataFrame:
    """(register, strategy, chr, wrd, pages) of spans against (page, expected), pages by (page, register), or the pages' own
    columns of these names; and rows of the register `MEAN OVER REGISTERS`, in which a register counts once, however many pages
    it has. All texts of a page are made and scored in its row."""
    pages = layout.paged(spans)
    pages = pages if registers is None else pages.join(registers, "page")
    names = {way: name for name, way in strategies.items()}
    scores = _told_scores(pages, expected, list(names))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("strategy"))
    means = scores.groupBy("register", named.alias("strategy")).agg(F.avg("chr").alias("chr"), F.avg("wrd").alias("wrd"), F.count("*").alias("pages"))
    overall = means.groupBy("strategy").agg(F.avg("chr").alias("chr"), F.avg("wrd").alias("wrd"), F.sum("pages").alias("pages"))
    return means.unionByName(overall.withColumn("register", F.lit("MEAN OVER REGISTERS")))


def layout_of(stem, multi_column: list[str]):
    """Column: whether a page is listed as one of several columns."""
    return F.when(stem.isin(multi_column), "multi-column").otherwise("single-column")


def span_counts(spans: DataFrame, group: str) -> DataFrame:
    """(group, pages, spans) of an evaluation set."""
    return spans.groupBy(group).agg(F.count_distinct("page").alias("pages"), F.count("*").alias("spans"))


def nearest_above(spans: DataFrame) -> DataFrame:
    """(page, ord, gap): from each box to the nearest one above it that shares some of its width; null without one."""
    own = spans.where("l is not null").select("page", "ord", "l", "t", "r")
    other = spans.where("l is not null").select("page", F.col("ord").alias("o"), F.col("l").alias("ol"), F.col("r").alias("or"), F.col("b").alias("ob"))
    above = own.join(other, "page").where("o <> ord and ob <= t and ol < r and `or` > l")
    gaps = above.groupBy("page", "ord").agg(F.min(F.col("t") - F.col("ob")).alias("gap"))
    return own.select("page", "ord").join(gaps, ["page", "ord"], "left")


def zipped(left: DataFrame, right: DataFrame, doc: str, place: str) -> DataFrame:
    """Join by document and place; refused if a document has places on one side only."""
    both = left.join(right, [doc, place], "full")
    odd = left.select(doc, place).exceptAll(right.select(doc, place)).unionByName(right.select(doc, place).exceptAll(left.select(doc, place)))
    if not odd.isEmpty():
        raise ValueError(f"not one to one: {odd.limit(5).collect()}")
    return both


def with_labels(scores: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Add the display label of a key from (key, label), the key itself where none is listed."""
    return scores.join(F.broadcast(labels), key, "left").withColumn("label", F.coalesce("label", F.col(key)))  # a row a key, listed by hand


def missing_cells(sweep: DataFrame, fixtures: DataFrame, grid: DataFrame) -> DataFrame:
    """(fixture, contrast, psm) that a sweep lacks: must be empty before a fit. What a fixture has stands in one row of it."""
    cell = F.struct("contrast", "psm")
    have = sweep.groupBy("fixture").agg(F.collect_set(cell).alias("have")).hint("shuffle_hash")
    both = fixtures.join(have, "fixture", "left").crossJoin(F.broadcast(grid.agg(F.collect_list(cell).alias("grid"))))  # one row of a fixed grid
    lacks = F.filter("grid", lambda g: ~F.coalesce(F.array_contains("have", g), F.lit(False)))
    return both.select("fixture", F.explode(lacks).alias("g")).select("fixture", "g.*")


def fit_means(chosen: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: means of the default cell, the chosen one and the best, and how many fixtures regress or miss the floor.

    `chosen`: (fixture, char_sim); `reference`: as `grid_reference`.
    """
    both = chosen.join(reference, "fixture")
    return both.agg(
        F.avg("plain").alias("plain"), F.avg("char_sim").alias("fitted"), F.avg("best").alias("oracle"),
        F.count_if(F.col("char_sim") < F.col("plain") - 1e-9).alias("regressions"),
        F.count_if(F.col("char_sim") < F.col("floor") - 1e-9).alias("unmet"), F.count("*").alias("fixtures"),
    )


def writable(means: DataFrame) -> DataFrame:
    """The row of `fit_means`; refused while a fixture misses its floor."""
    unmet = means.first()["unmet"]
    if unmet:
        raise ValueError(f"{unmet} fixtures miss their floor: the bands are not written")
    return means


def register_table(scores: DataFrame, engines: list[str], ours: str) -> DataFrame:
    """(register, `<engine>_chr`, `<engine>_wrd`): our engine's columns first, then by name; registers by our recall, the best
    first, the mean row last."""
    names = sorted(engines, key=lambda e: (e != ours, e))
    table = scores.groupBy("register").pivot("engine", names).agg(F.max("chr").alias("chr"), F.max("wrd").alias("wrd"))
    return table.orderBy(F.col("register") == "mean", F.desc(f"{ours}_wrd"), "register")
