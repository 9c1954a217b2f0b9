"""Names and contents of output files, and the states a file of a batch ends in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafloom.functions import text as T

# Extension of each format, other names of formats, the format if none is asked for.
EXTENSIONS = {"markdown": ".md", "text": ".txt", "pdf": ".pdf"}
ALIASES = {"md": "markdown", "txt": "text", "plaintext": "text", "plain": "text"}
DEFAULT_FORMAT = "markdown"


def rounded(value: Column, places: int) -> Column:
    """A double at a number of places: scaled, rounded half away from zero, scaled back. Spark's own `round` takes the
    shortest decimal of the double instead, which falls the other way at some ties."""
    return F.round(value * 10.0**places) / 10.0**places


def printed(value: Column, places: int) -> Column:
    """A double as C's `printf` writes it: rounded by its exact binary value, exact ties to the even digit. Java rounds its
    shortest decimal, ties up.

    The number is split in two halves of 26 bits, whose products with a power of ten are exact.
    """
    scale, size = 10.0**places, F.abs(value)
    whole = F.floor(size * scale).cast("double")
    high = size * 134217729.0 - (size * 134217729.0 - size)
    over = (high * scale - (whole + 0.5)) + (size - high) * scale
    up = F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1.0).otherwise(0.0)
    text = lambda v: F.format_string(f"%.{places}f", v)
    return F.when(size * scale < 2.0**52, text(F.signum(value) * (whole + up) / scale)).otherwise(text(value))


def formats(asked: Column) -> Column:
    """Formats of a comma-separated wish, in the order of their first mention, once each; null if one is unknown."""
    names = F.array_remove(F.transform(F.split(F.coalesce(asked, F.lit("")), ","), lambda p: T.strip(F.lower(p))), "")
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    names = F.transform(names, lambda p: F.coalesce(F.try_element_at(aliases, p), p))
    known = F.array(*map(F.lit, EXTENSIONS))
    chosen = F.when(F.size(names) == 0, F.array(F.lit(DEFAULT_FORMAT))).otherwise(F.array_distinct(names))
    return F.when(F.size(F.array_except(chosen, known)) == 0, chosen)


def extension(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), name)


def output_name(path: Column, name: Column) -> Column:
    """Stem and extension; `.searchable` in between where the source has that extension itself."""
    ext = extension(name)
    return F.concat(T.stem(path), F.when(T.suffix(path) == ext, F.lit(".searchable")).otherwise(F.lit("")), ext)


def plain_text(text: Column) -> Column:
    return F.concat(T.strip(text), F.lit("\n"))


def missing_characters(text: Column, encodable: str, limit: int = 12) -> Column:
    """The first characters, sorted, that stand outside a class of a regular expression; `...` if there are more."""
    bad = F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(f"[^{encodable}]"), F.lit(0))))
    shown = F.array_join(F.slice(bad, 1, limit), "")
    return F.concat(shown, F.when(F.size(bad) > limit, F.lit("...")).otherwise(F.lit("")))


def location(status: Column) -> Column:
    """Where a file stands after its run: state is a column, nothing is moved."""
    return F.when(status == "processed", "processed").when(status.isin("triage", "refused"), "triage").otherwise("scans")


def status(refused: Column, engine: Column, quality_gate: Column) -> Column:
    """refused at admission, error if no engine read the file, triage below the floor, else processed."""
    return (
        F.when(refused.isNotNull(), "refused").when(engine.isNull(), "error").when(quality_gate == "failed", "triage").otherwise("processed")
    )
