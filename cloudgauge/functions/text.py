"""Column expressions for labels, free text and small categorical rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything Python's str.split() treats as white space.
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def normalize_label(col: Column | str) -> Column:
    """Trim, lower-case and collapse white space."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.trim(F.regexp_replace(c, _SPACE, " ")))


def to_number(col: Column | str) -> Column:
    """String to double; null for whatever is not a number (NaN too).

    Spark's cast also takes hex floats and the suffixes "d" and "f"; these are no numbers
    here. Digit groups joined by underscores are.
    """
    c = F.col(col) if isinstance(col, str) else col
    plain = F.trim(F.when(c.contains("_"), F.regexp_replace(c, r"(?<=\d)_(?=\d)", "")).otherwise(c))
    value = plain.try_cast("double")
    low = F.lower(plain)
    odd = low.endswith("d") | (low.endswith("f") & ~low.endswith("inf")) | low.contains("x")
    return F.when(~F.isnan(value) & ~odd, value)


def extract_first_number(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_extract(c, r"\d+\.?\d*", 0), F.lit("")).try_cast("double")


def classify_context(col: Column | str) -> Column:
    """`guitar` by substring, `mix_stimulus` for letters followed by one digit."""
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    return (
        F.when(c.contains("guitar"), "guitar")
        .when(c.rlike(r"\A[a-z]+[0-9]\z"), "mix_stimulus")
    )


def bucket_experience(years: Column | str, novice_max: float = 2.0, experienced_min: float = 5.0) -> Column:
    """Two groups with a deliberate gap between them; `unparsed` for null."""
    y = F.col(years) if isinstance(years, str) else years
    return (
        F.when(y.isNull(), "unparsed")
        .when(y <= novice_max, "novice")
        .when(y >= experienced_min, "experienced")
        .otherwise("gap")
    )


def is_suspicious(label: Column | str) -> Column:
    """No letter at all, or at most two characters."""
    c = F.col(label) if isinstance(label, str) else label
    return (~c.rlike(r"\p{L}")) | (F.length(c) <= 2)


def build_cell_id(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def digest8(text: Column | str) -> Column:
    """First eight hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 8)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out
