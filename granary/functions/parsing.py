"""Text to typed values as built-in expressions: strip, numbers and ISO-like timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of a nanosecond timestamp, which the canonical schema promises to fit.
FIRST_DAY, LAST_DAY = "1677-09-22", "2262-04-11"

_SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"
_DECIMAL = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def strip(text: Column) -> Column:
    """Without the Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def to_double(text: Column) -> Column:
    """The number that a stripped text spells, null if none.

    Decimal and exponent forms, single underscores between digits, inf and nan in any case; no
    type suffixes, no digits beyond ASCII.
    """
    plain = F.regexp_replace(F.regexp_replace(text, "_", ""), r"(?i)^[+-]nan$", "nan")
    return F.when(text.rlike(_SPECIAL) | text.rlike(_DECIMAL), plain.try_cast("double"))


def has_zone(text: Column) -> Column:
    """Whether a stripped timestamp names a zone: Z or an offset behind a time."""
    return text.rlike(r"(?i)[T ]\d{1,2}(:?\d{2}){0,2}([.,]\d+)?\s*(Z|UTC|GMT|[+-]\d{2}(:?\d{2})?)$")


def dashed(text: Column) -> Column:
    """Compact and otherwise separated forms rewritten to yyyy-mm-dd[ hh:mm[:ss]]."""
    for pattern, new in (
        (r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3"),
        (r"^(\d{4})([/. ])(\d{1,2})\2(\d{1,2})(?=$|[T ])", "$1-$3-$4"),
        (r"([T ])(\d{2})(\d{2})(\d{2})(\.\d+)?$", "$1$2:$3:$4$5"),
        (r"(\d[T ])(\d{2})(\d{2})$", "$1$2:$3"),
    ):
        text = F.regexp_replace(text, pattern, new)
    return text


def checked_day(plain: Column, found: Column, zoned: Column) -> Column:
    """Midnight of `found`, the timestamp that dashed text `plain` casts to; null if it names a zone,
    has no four-digit year or lies outside the bounds."""
    inside = (found >= F.lit(FIRST_DAY).cast("timestamp_ntz")) & (found < F.lit("2262-04-12").cast("timestamp_ntz"))
    return F.when(plain.rlike(r"^\d{4}(-|$)") & ~zoned & inside, F.date_trunc("day", found).cast("timestamp_ntz"))


def to_day(text: Column) -> Column:
    """Midnight of the day that a stripped timestamp text names, without zone; null if none."""
    plain = dashed(text)
    return checked_day(plain, plain.try_cast("timestamp_ntz"), has_zone(text))


def whole_number(value: Column) -> Column:
    """Whether a double is a finite whole number."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))) & (value == F.floor(value).cast("double"))
