"""Operator 12, fill-in-middle: texts cut at two unit bounds and put in another order, for infilling models.

A unit is a run of letters A-Z, a-z or any other single code point. One numpy kernel serves all rows of an Arrow
batch at once, on its UTF-8 bytes: a table gives each byte's class; a byte starts a unit unless it continues a code
point or a run of letters, or always where a document starts; the running count of starts less that at the document's
start numbers the units; a search in the running count finds the bytes of both cuts of every row. The pieces of all
outputs are then gathered by one index.

Cases. A null text counts as empty; empty texts stay plain, as do those that hold a sentinel. A null doc_id is drawn
from the empty text. Repeated rows of a doc_id get the same draws, each row is returned. Extra columns are not read.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import slices, small_batches, table

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), np.uint8)
ANY_SENTINEL = "<[PSM]>"

CONTINUES, LETTER, OTHER = 0, 1, 2
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[0x80:0xC0] = CONTINUES
CLASSES[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER

#: Bytes of text that one call of the kernel takes; a longer text is taken alone.
KERNEL_BYTES = 1 << 21

RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first digits of the SHA-256 of `1:` and its id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def sentinel_rows(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rows (by the end of each) whose bytes hold a sentinel."""
    held = np.zeros(len(ends), bool)
    if len(data) > 2:
        opens = np.flatnonzero((data[:-2] == SENTINELS[0]) & (data[2:] == SENTINELS[2]) & np.isin(data[1:-1], SENTINELS[1::3]))
        rows = np.searchsorted(ends, opens, "right")
        held[rows[opens + 3 <= ends[rows]]] = True
    return held


def gathered(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of `source` at `starts`, one after the other."""
    ends = np.cumsum(sizes)
    index = np.arange(ends[-1] if len(ends) else 0)
    return source[index + np.repeat(starts - (ends - sizes), sizes)]


def cut(data: np.ndarray, bounds: np.ndarray, h: np.ndarray, plain_percent: int, spm_percent: int) -> tuple[np.ndarray, ...]:
    """(units, form, prefix and middle code points, output bytes, output bounds) of the rows that `bounds` part `data` into.

    `h` has the four draws of each row; form is 0 plain, 1 prefix first, 2 suffix first.
    """
    first, last = bounds[:-1], bounds[1:]
    kind = CLASSES[data]
    starts = kind != CONTINUES
    starts[1:] &= (kind[1:] != LETTER) | (kind[:-1] != LETTER)
    starts[first[first < last]] = True
    units = np.concatenate([[0], np.cumsum(starts)])
    points = np.concatenate([[0], np.cumsum(kind != CONTINUES)])
    n = units[last] - units[first]

    wanted = np.sort(h[:2] % (n + 1), axis=0) + units[first]
    one, two = np.searchsorted(units[1:], wanted + 1)
    one, two = np.minimum(one, last), np.minimum(two, last)

    plain = (n == 0) | (h[2] % 100 >= 100 - plain_percent) | sentinel_rows(data, last)
    form = np.where(plain, 0, np.where(h[3] % 100 < spm_percent, 2, 1))

    # Six pieces a row: three sentinels of the tail of `source`, each before its part of the text.
    mark = len(data) + np.array([0, 3, 6])
    texts = {"P": (first, one - first), "S": (two, last - two), "M": (one, two - one)}
    at, size = np.zeros((len(n), 6), np.int64), np.zeros((len(n), 6), np.int64)
    for rows, order in ((form == 1, "PSM"), (form == 2, "SPM")):
        for k, part in enumerate(order):
            begin, length = texts[part]
            at[rows, 2 * k], size[rows, 2 * k] = mark["PSM".index(part)], 3
            at[rows, 2 * k + 1], size[rows, 2 * k + 1] = begin[rows], length[rows]
    at[plain, 0], size[plain, 0] = first[plain], (last - first)[plain]
    output = gathered(np.concatenate([data, SENTINELS]), at.ravel(), size.ravel())
    return n, form, points[one] - points[first], points[two] - points[one], output, np.concatenate([[0], np.cumsum(size.sum(axis=1))])


def transformed(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text in its new order, or plain for a share of them.

    Of the texts that are cut, `spm_percent` in 100 have the suffix first. One pass over the rows, nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    forms = np.array(["plain", "psm", "spm"], object)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            _, offsets, values = texts.buffers()
            bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
            h = np.array([batch.column(f"h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)])
            for rows in slices(np.diff(bounds), KERNEL_BYTES):
                own = bounds[rows.start : rows.stop + 1]
                n, form, prefix, middle, output, ends = cut(data[own[0] : own[-1]], own - own[0], h[:, rows], plain_percent, spm_percent)
                outputs = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(output)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(rows.start, rows.stop - rows.start), pa.array(n, pa.int64()), pa.array(forms[form], pa.string()),
                     pa.array(prefix, pa.int64(), mask=form == 0), pa.array(middle, pa.int64(), mask=form == 0), outputs.cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text", *draws(F.col("doc_id"))).mapInArrow(kernel, RESULT)


def restored(output: Column, form: Column) -> Column:
    """The exact text that `output` was made from: no text that is cut holds a sentinel, nor can one arise at a cut."""
    part = F.split(output, ANY_SENTINEL, -1)
    forward = F.concat(part.getItem(1), part.getItem(3), part.getItem(2))
    return F.when(form == "psm", forward).when(form == "spm", F.concat(part.getItem(2), part.getItem(3), part.getItem(1))).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = transformed(table(spark, sf_dir, "documents"))
    digests = [F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
               F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256")]
    return cuts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit
  FROM documents
), drawn AS (
  SELECT *, len(unit) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(unit) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(unit) + 1) AS c2,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS c3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS c4
  FROM cut
), parts AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c3 >= 90 THEN 'plain'
              WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(unit[1:least(c1, c2)], '') AS prefix,
         array_to_string(unit[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(unit[greatest(c1, c2) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
