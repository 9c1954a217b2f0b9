"""Reading order of positioned text spans (page, ord, text, l, t, r, b); boxes may be null.

Line grouping and the single-gutter baseline are DataFrame expressions over the array of a page's
spans; gutters are tried in numpy for a batch of pages. The recursive cut is one grouped pandas function: a page is small, pages are many.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from leafloom.functions import text as T

# Least share of a side or a margin, depth of cuts, fewest spans to cut; share and number of boxes that may
# cross a gutter; of the median height, what is trimmed from a box and how far a divider reaches; column widths; line grid.
ROOM, DEPTH, FEWEST = 0.15, 6, 4
CROSS_SHARE, CROSS_FREE = 0.05, 3
TRIM, REACH = 0.25, 2.0
WIDTH_SHARE, WIDTH_RATIO = 0.2, 0.5
GRID_LOW, GRID_HIGH = 0.5, 1.5


def line_tolerance(spans: DataFrame, share: float = 0.5) -> DataFrame:
    """(page, tolerance): half the median height of the placed spans that have a height."""
    height = F.col("b") - F.col("t")
    return spans.groupBy("page").agg(F.coalesce(share * F.median(F.when(height > 0, height)), F.lit(0.0)).alias("tolerance"))


def grouped_lines(spans: DataFrame) -> DataFrame:
    """(page, ord, line) of spans (page, ord, baseline, left, tolerance): a span farther than the tolerance from the
    first span of the line starts a new one, so slow drift splits too."""
    row = F.struct("baseline", "left", "ord")
    pages = spans.groupBy("page").agg(F.sort_array(F.collect_list(row)).alias("s"), F.first("tolerance").alias("tolerance"))
    begin = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("line"), F.expr("cast(array() as array<struct<ord:bigint,line:int>>)").alias("out"))

    def step(acc, s):
        fresh = acc["anchor"].isNull() | (F.abs(s["baseline"] - acc["anchor"]) > F.col("tolerance"))
        line = F.when(fresh, acc["line"] + 1).otherwise(acc["line"])
        own = F.struct(s["ord"].cast("long").alias("ord"), line.alias("line"))
        return F.struct(F.when(fresh, s["baseline"]).otherwise(acc["anchor"]).alias("anchor"), line.alias("line"), F.concat(acc["out"], F.array(own)).alias("out"))

    return pages.select("page", F.explode(F.aggregate("s", begin, step, lambda acc: acc["out"])).alias("o")).select("page", "o.*")


def bands_of_ink(spans: DataFrame) -> DataFrame:
    """(page, band, top, bottom): unions of overlapping vertical extents, by a running maximum of bottoms."""
    along = Window.partitionBy("page").orderBy("t", "ord")
    before = F.max("b").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("t") > before).cast("int"), F.lit(1))
    marked = spans.where("t is not null").withColumn("fresh", fresh).withColumn("band", F.sum("fresh").over(along))
    return marked.groupBy("page", "band").agg(F.min("t").alias("top"), F.max("b").alias("bottom"), F.count("*").alias("n"))


def gutters(spans: DataFrame, steps: int = 80) -> DataFrame:
    """(page, gutter): of 81 positions over the middle 40 % of the width, the one that fewest boxes cross (first wins);
    null with fewer than four placed spans, too many crossings, or a side that is too thin.

    One grouping brings a page's boxes together; the positions are tried for all pages of an Arrow batch at once.
    """
    side = lambda c: F.when(F.col("l").isNotNull(), F.col(c).cast("double"))
    boxes = F.collect_list(F.when(F.col("l").isNotNull(), F.struct(side("l").alias("l"), side("r").alias("r"))))
    pages = spans.groupBy("page").agg(boxes.alias("s")).select("page", F.transform("s", lambda s: s["l"]).alias("l"), F.transform("s", lambda s: s["r"]).alias("r"))

    def tried(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _gutters(batch.column(1), batch.column(2), steps)], ["page", "gutter"])

    return pages.mapInArrow(tried, StructType([spans.schema["page"], StructField("gutter", DoubleType())]))


def _gutters(left: pa.ListArray, right: pa.ListArray, steps: int) -> pa.Array:
    """The gutter of each page from its boxes' left and right sides."""
    ends = np.cumsum(left.value_lengths().to_numpy(zero_copy_only=False))
    n = np.diff(ends, prepend=0)
    own = np.flatnonzero(n >= FEWEST)
    out = np.full(len(n), np.nan)
    if len(own):
        kept = np.repeat(n >= FEWEST, n)
        l, r = (x.flatten().to_numpy(zero_copy_only=False)[kept] for x in (left, right))  # noqa: E741
        n = n[own]
        begin = np.cumsum(n) - n
        low, high = np.fmin.reduceat(l, begin), np.fmax.reduceat(r, begin)
        first, last = low + 0.3 * (high - low), low + 0.7 * (high - low)
        count = lambda boxes: np.add.reduceat(boxes.astype(np.int64), begin)
        fewest, x = np.full(len(n), np.iinfo(np.int64).max), first
        for i in range(steps + 1):
            # In this order of operations: a box that ends on a place crosses it or not by the last bit.
            at = first + (last - first) * i / steps
            each = np.repeat(at, n)
            crossings = count((l < each) & (r > each))
            better = crossings < fewest
            fewest, x = np.where(better, crossings, fewest), np.where(better, at, x)
        each = np.repeat(x, n)
        thin = np.minimum(count(r <= each), count(l >= each)) < ROOM * n
        sound = (high > low) & (fewest <= np.maximum(float(CROSS_FREE), n * CROSS_SHARE)) & ~thin
        out[own[sound]] = x[sound]
    return pa.array(out, from_pandas=True)


def median_height(t: np.ndarray, b: np.ndarray) -> float:
    heights = (b - t)[b > t]
    return float(np.median(heights)) if len(heights) else 0.0


class Cutter:
    """The recursive cut of one page: every span gets exactly one place. Spans are numbers; l, t, r, b are NaN without a box."""

    def __init__(self, l, t, r, b):
        self.l, self.t, self.r, self.b = l, t, r, b
        self.placed = ~np.isnan(l)
        self.height = median_height(t[self.placed], b[self.placed])

    def regions(self, own: np.ndarray, depth: int = 0) -> list[np.ndarray]:
        """Bands first, then columns, so that a heading is read above the columns that it introduces."""
        boxes = own[self.placed[own]]
        if depth < DEPTH and len(boxes) >= FEWEST:
            parts = self.bands(own, boxes) or self.columns(own, boxes)
            if parts:
                return [x for part, whole in parts for x in ([part] if whole else self.regions(part, depth + 1))]
        return [own] if len(own) else []

    def bands(self, own: np.ndarray, boxes: np.ndarray) -> list | None:
        """Above and below the widest gap that no box occupies and that stands out from the other gaps and the type size."""
        order = boxes[np.argsort(self.t[boxes], kind="stable")]
        reach = np.maximum.accumulate(self.b[order])[:-1]
        gap = self.t[order][1:] - reach
        if not (gap > 0).any():
            return None
        middle = reach + gap / 2
        least = max(median_height(self.t[boxes], self.b[boxes]), 3 * float(np.median(gap[gap > 0])))
        above = (self.b[boxes][None, :] <= middle[:, None]).sum(axis=1)
        fits = (gap > least) & (np.minimum(above, len(boxes) - above) >= ROOM * len(boxes))
        if not fits.any():
            return None
        y = middle[np.argmax(np.where(fits, gap, -np.inf))]
        up = self.b[own] <= y  # false without a box
        return [(own[up], False), (own[~up], False)]

    def trimmed(self, boxes: np.ndarray, by: float) -> tuple[np.ndarray, np.ndarray]:
        low, high, mid = self.l[boxes] + by, self.r[boxes] - by, (self.l[boxes] + self.r[boxes]) / 2
        crossed = low >= high
        return np.where(crossed, mid, low), np.where(crossed, mid, high)

    def gutter(self, boxes: np.ndarray, low: np.ndarray, high: np.ndarray) -> float | None:
        """The clearest place (fewest boxes across, then widest, then leftmost) that leaves columns on both sides."""
        left, width = self.l[boxes].min(), self.r[boxes].max() - self.l[boxes].min()
        if width <= 0:
            return None
        first, last = left + ROOM * width, left + (1 - ROOM) * width
        edges = np.concatenate([low, high])
        edges = np.unique(np.concatenate([[first, last], edges[(edges > first) & (edges < last)]]))
        x, room = (edges[1:] + edges[:-1]) / 2, np.diff(edges)
        across = ((low < x[:, None]) & (high > x[:, None])).sum(axis=1)
        for i in np.lexsort((x, -room, across)):
            if across[i] > max(CROSS_FREE, CROSS_SHARE * len(boxes)):
                return None
            sides = [(high <= x[i]), (low >= x[i])]
            if min(side.sum() for side in sides) < ROOM * len(boxes):
                continue
            thin, thick = sorted(high[side].max() - low[side].min() for side in sides)
            if thin >= WIDTH_SHARE * width or thin >= WIDTH_RATIO * thick:
                return float(x[i])
        return None

    def line_gap(self, boxes: np.ndarray) -> float | None:
        """The median gap from a box to the nearest one above it that shares some of its width."""
        l, t, r, b = (v[boxes] for v in (self.l, self.t, self.r, self.b))
        gap = t[:, None] - b[None, :]
        over = (gap >= 0) & (l[None, :] < r[:, None]) & (r[None, :] > l[:, None])
        np.fill_diagonal(over, False)
        nearest = np.where(over, gap, np.inf).min(axis=1)
        return float(np.median(nearest[np.isfinite(nearest)])) if np.isfinite(nearest).any() else None

    def divides(self, i: int, boxes: np.ndarray, x: float, line_gap: float | None) -> bool:
        """A box across the gutter stands for itself: nothing beside it on its line, and not set on the lines of both columns."""
        others = boxes[boxes != i]
        l, t, r, b = (v[others] for v in (self.l, self.t, self.r, self.b))
        shared = np.minimum(self.b[i], b) - np.maximum(self.t[i], t)
        beside = (l >= self.r[i]) | (r <= self.l[i])
        if (beside & (shared >= 0.5 * np.minimum(self.b[i] - self.t[i], b - t))).any():
            return False
        if line_gap is None:
            return True
        for low, high in ((self.l[i], x), (x, self.r[i])):
            near = (l < high) & (r > low)
            for gap in ((self.t[i] - b)[near], (t - self.b[i])[near]):
                gap = gap[gap >= 0]
                if not len(gap) or not GRID_LOW * line_gap <= gap.min() <= GRID_HIGH * line_gap:
                    return True
        return False

    def columns(self, own: np.ndarray, boxes: np.ndarray) -> list | None:
        """Left and right of a gutter; or what is above, on and below the topmost divider across it."""
        height = median_height(self.t[boxes], self.b[boxes])
        low, high = self.trimmed(boxes, TRIM * height)
        x = self.gutter(boxes, low, high)
        if x is None:
            return None
        line_gap = self.line_gap(boxes)
        far = (low < x) & (high > x) & (np.minimum(x - low, high - x) >= REACH * height)
        found = [i for i in boxes[far].tolist() if self.divides(i, boxes, x, line_gap)]
        if found:
            divider = min(found, key=lambda i: self.b[i])
            rest = own[own != divider]
            above = self.b[rest] <= self.b[divider]
            return [(rest[above], False), (np.array([divider]), True), (rest[~above], False)]
        left = (high <= x) | ((low < x) & ((low + high) / 2 < x))
        return [(np.concatenate([own[~self.placed[own]], boxes[left]]), False), (boxes[~left], False)]


def lines_of(region: np.ndarray, baseline: np.ndarray, left: np.ndarray, tolerance: float) -> list[list[int]]:
    lines: list[list[int]] = []
    for i in sorted(region.tolist(), key=lambda i: (baseline[i], left[i])):
        if lines and abs(baseline[i] - baseline[lines[-1][0]]) <= tolerance:
            lines[-1].append(i)
        else:
            lines.append([i])
    return [sorted(line, key=lambda i: left[i]) for line in lines]


def ordered_page(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("ord", ignore_index=True)
    l, t, r, b = (pdf[c].to_numpy(dtype=np.float64) for c in ("l", "t", "r", "b"))
    cutter = Cutter(l, t, r, b)
    baseline, left = np.nan_to_num(b), np.nan_to_num(l)
    rows = []
    for region, own in enumerate(cutter.regions(np.arange(len(pdf)))):
        for line, members in enumerate(lines_of(own, baseline, left, 0.5 * cutter.height)):
            rows += [(i, region, line) for i in members]
    out = pdf.iloc[[i for i, _, _ in rows]][["page", "ord", "text"]].copy()
    out["region"], out["line"], out["pos"] = [x for _, x, _ in rows], [x for _, _, x in rows], range(len(rows))
    return out


def paged(spans: DataFrame) -> DataFrame:
    """(page, spans): a page's spans (ord, text, l, t, r, b) in one row, by their order; such rows stay as they are."""
    if "spans" in spans.columns:
        return spans
    return spans.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("ord", "text", "l", "t", "r", "b"))).alias("spans"))


def unpaged(spans: DataFrame) -> DataFrame:
    """A row a span again, of pages in rows."""
    return spans.select("page", F.inline("spans")) if "spans" in spans.columns else spans


#: Forms whose order a task remembers: pages that are boxed alike, of which corpora have many, are cut once.
FORMS = 4096


def ordered_boxes(boxes: np.ndarray) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
    """(span, region, line) in reading order, and the lines across the whole page, of the boxes (l, t, r, b) of one page."""
    l, t, r, b = boxes
    cutter = Cutter(l, t, r, b)
    baseline, left, tolerance = np.nan_to_num(b), np.nan_to_num(l), 0.5 * cutter.height
    everything = np.arange(len(l))
    order = [(i, region, line) for region, own in enumerate(cutter.regions(everything)) for line, members in enumerate(lines_of(own, baseline, left, tolerance)) for i in members]
    return order, lines_of(everything, baseline, left, tolerance)


def with_orders(pages: DataFrame) -> DataFrame:
    """Pages (page, spans, ...) with `o`: (i, region, line) of the spans in reading order, `lines`: the spans of each line
    across the page, and `read`: those of each line in reading order."""
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields)

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for pdf in batches:
            found = []
            for spans in pdf["spans"]:
                boxes = np.array([[s[c] for s in spans] for c in "ltrb"], dtype=np.float64)
                key = boxes.tobytes()
                if key not in known:
                    if len(known) >= FORMS:
                        known.clear()
                    order, lines = ordered_boxes(boxes)
                    read = [[i for i, _, _ in run] for _, run in itertools.groupby(order, lambda x: x[1:])]
                    known[key] = [{"i": i, "region": x, "line": y} for i, x, y in order], lines, read
                found.append(known[key])
            yield pdf.assign(o=[x[0] for x in found], lines=[x[1] for x in found], read=[x[2] for x in found])

    return pages.mapInPandas(ordered, f"{own}, o array<struct<i:int,region:int,line:int>>, lines array<array<int>>, read array<array<int>>")


def gutter_lines(boxes: np.ndarray) -> list[list[int]]:
    """The lines of one page by the single-gutter baseline (see `single_gutter_order`), as the spans of each."""
    l, t, r, b = boxes
    heights = (b - t)[b > t]
    tolerance = 0.5 * float(np.median(heights)) if len(heights) else 0.0
    baseline, left = np.nan_to_num(b), np.nan_to_num(l)
    line, anchor, n = np.zeros(len(l), np.int64), None, 0
    for i in np.lexsort((left, baseline)).tolist():
        if anchor is None or abs(baseline[i] - anchor) > tolerance:
            anchor, n = baseline[i], n + 1
        line[i] = n
    placed = ~np.isnan(l)
    x = _gutters(pa.array([l[placed]]), pa.array([r[placed]]), 80)[0].as_py()
    block = side = np.zeros(len(l), np.int64)
    if x is not None:
        divider = (l < x) & (r > x)
        at = np.where(np.isnan(b), -np.inf, b)
        block = np.searchsorted(np.sort(at[divider]), at, "right") - divider
        side = np.where(divider, 2, np.where((l + r) / 2 < x, 0, 1))
    order = np.lexsort((left, line, side, block))
    return [list(own) for _, own in itertools.groupby(order.tolist(), lambda i: (block[i], side[i], line[i]))]


#: The texts that a page's spans make: in the engine's order, in lines across the page, in reading order, by the single gutter,
#: and in the lines of the reading order with words that a line break parts rejoined.
WAYS = ["engine", "linesort", "column", "gutter", "shipped"]


#: Pages of a batch that are told together.
PART = 500


@lru_cache(FORMS)
def form(n: int, boxes: bytes, gutter: bool) -> tuple[list[int], list[list[int]], list[list[int]], list[list[int]]]:
    """Of a page of `n` boxes: its spans in reading order, the lines across it, those of the reading order, and those by the single
    gutter. Pages of one form are cut once in a Python worker, however many tasks it runs."""
    sides = np.frombuffer(boxes).reshape(4, n)
    order, lines = ordered_boxes(sides)
    read = [[i for i, _, _ in run] for _, run in itertools.groupby(order, lambda x: x[1:])]
    return [i for i, _, _ in order], lines, read, gutter_lines(sides) if gutter else []


def told(spans: DataFrame, ways: list[str]) -> DataFrame:
    """(strategy, text) of each page in each of the WAYS, beside the pages' other columns (page, spans, ...).

    All are made in the row of the page, of whole batches of pages; pages that are boxed alike are cut once.
    """
    pages = paged(spans)
    own = [f for f in pages.schema.fields if f.name != "spans"]
    fields = [StructField("strategy", StringType()), StructField("text", StringType()), StructField("rows", ArrayType(StringType()))]

    def texts(words: list[str | None], known: tuple) -> Iterator[tuple[str | None, list[str] | None]]:
        order, lines, read, gutter = known
        line = (lambda own: " ".join([words[i] for i in own])) if None not in words else (lambda own: " ".join([words[i] for i in own if words[i] is not None]))
        for way in ways:
            if way == "shipped":
                yield None, [line(own) for own in read]
            elif way == "column":
                yield line(order), None
            elif way == "engine":
                yield "\n".join(w for w in words if w is not None), None
            else:
                yield "\n".join([line(own) for own in (lines if way == "linesort" else gutter)]), None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch is taken in parts, so that few words are Python objects at a time.
        for batch in (b.slice(low, PART) for b in batches for low in range(0, b.num_rows, PART)):
            spans = batch.column(batch.schema.get_field_index("spans"))
            flat = spans.flatten()
            words = flat.field("text").to_pylist()
            boxes = np.stack([flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "ltrb"])
            found, low = [], 0
            for n in spans.value_lengths().to_pylist():
                page = np.ascontiguousarray(boxes[:, low : low + n])
                found += texts(words[low : low + n], form(n, page.tobytes(), "gutter" in ways))
                low += n
            at = pa.array(np.repeat(np.arange(len(spans)), len(ways)))
            columns = [batch.column(batch.schema.get_field_index(f.name)).take(at) for f in own]
            made = [pa.array(ways * len(spans), pa.string()), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns + made, [f.name for f in (*own, *fields)])

    out = pages.mapInArrow(rows, StructType([*own, *fields]))
    text = F.coalesce("text", F.array_join(T.dehyphenated(F.col("rows")), "\n"))
    return out.select(*[f.name for f in own], "strategy", text.alias("text"))


def reading_order(spans: DataFrame) -> DataFrame:
    """(page, ord, text, region, line, pos): the order of every span of every page by the recursive cut."""
    placed = with_orders(paged(spans)).select("page", "spans", F.posexplode("o").alias("pos", "o"))
    span = F.get("spans", F.col("o.i"))
    return placed.select("page", span["ord"].alias("ord"), span["text"].alias("text"), "o.region", "o.line", "pos")


def page_texts(order: DataFrame) -> DataFrame:
    """(page, lines): words of a line joined by a space, lines in order."""
    lines = order.groupBy("page", "region", "line").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("w"))
    lines = lines.select("page", F.col("w")[0]["pos"].alias("at"), F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("line"))
    return lines.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("lines"))


def page_transcripts(order: DataFrame) -> DataFrame:
    """(page, text): the lines of a page, one below the other, words that a line break parts rejoined."""
    return page_texts(order).select("page", F.array_join(T.dehyphenated(F.col("lines")), "\n").alias("text"))


def single_gutter_order(spans: DataFrame) -> DataFrame:
    """(page, region, line, pos, text): the frozen baseline as an order: block by block, left, right, then the divider, in
    lines within each side. Positions number the spans of a line; region and line sort a page."""
    placed = spans.withColumns({"baseline": F.coalesce("b", F.lit(0.0)), "left": F.coalesce("l", F.lit(0.0))})
    lines = grouped_lines(placed.select("page", "ord", "baseline", "left").join(line_tolerance(spans), "page"))
    own = single_gutter_blocks(spans).join(lines, ["page", "ord"]).join(placed.select("page", "ord", "left", "text"), ["page", "ord"])
    pos = F.row_number().over(Window.partitionBy("page", "block", "side", "line").orderBy("left", "ord"))
    return own.select("page", F.struct("block", "side").alias("region"), "line", pos.alias("pos"), "text")


def single_gutter_blocks(spans: DataFrame) -> DataFrame:
    """(page, ord, block, side): the frozen baseline, in which spans across the gutter split both columns. Block: how
    many dividers stand above; side: 0 left, 1 right, 2 the divider itself."""
    found = spans.join(gutters(spans), "page")
    divider = (F.col("l") < F.col("gutter")) & (F.col("r") > F.col("gutter"))
    along = Window.partitionBy("page").orderBy("b").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    above = F.sum(F.coalesce(divider, F.lit(False)).cast("int")).over(along) - F.coalesce(divider, F.lit(False)).cast("int")
    side = F.when(divider, 2).when((F.col("l") + F.col("r")) / 2 < F.col("gutter"), 0).otherwise(1)
    return found.select("page", "ord", above.cast("long").alias("block"), F.when(F.col("gutter").isNull(), 0).otherwise(side).alias("side"))
