"""Scalar expressions shared by the operators.

All of them hold under ANSI mode: bad input gives null and never an error.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points of a title by tournament category.
CATEGORY_POINTS = {"Grand Slam": 100, "Masters 1000": 50, "ATP 500": 25}
IMPORTANT_CATEGORIES = tuple(CATEGORY_POINTS)

# Drawing style of a match edge by match type (color, pen width).
EDGE_STYLES = {"F": ("#D32F2F", 3), "S": ("#F57C00", 2)}
OTHER_EDGE_STYLE = ("#388E3C", 1)

AMOUNT_FORM = r"^(\d+\.?\d*|\.\d+)$"
NUMBER_FORM = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?|nan)[df]?\s*$"

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_from_text(c: ColumnOrName, pattern: str = "yyyy.MM.dd") -> Column:
    return F.try_to_date(_col(c), pattern)


def full_name(*parts: ColumnOrName) -> Column:
    """Name parts joined by a blank; absent parts leave no trace."""
    return F.trim(F.concat_ws(" ", *[_col(p) for p in parts]))


def composite_key(*parts: ColumnOrName, separator: str = "_") -> Column:
    return F.concat_ws(separator, *[_col(p) for p in parts])


def default_when_null(c: ColumnOrName, data_type: str, default) -> Column:
    """Cast, with a default for null input only: text that fails to cast stays null."""
    c = _col(c)
    return F.when(c.isNull(), F.lit(default).cast(data_type)).otherwise(c.try_cast(data_type))


def amount_from_text(c: ColumnOrName) -> Column:
    """Number in a money text: everything but digits and dots is dropped, the sign too."""
    digits = F.regexp_replace(_col(c).cast("string"), "[^0-9.]", "")
    # Told apart by its form first: a failed cast costs an exception for every row.
    read = F.transform(F.array(digits), lambda d: F.when(d.rlike(AMOUNT_FORM), d.try_cast("double")))
    return F.get(read, 0)


def number_from_text(c: ColumnOrName) -> Column:
    """Number that a text spells, else null.

    A failed cast to double costs an exception for every row, so text that cannot
    be a number is told apart by its form first.
    """
    c = _col(c)
    return F.when(c.rlike(NUMBER_FORM), c.try_cast("double"))


def ratio_or_zero(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    n, d = _col(numerator), _col(denominator)
    return F.when(d > 0, n.cast("double") / d).otherwise(F.lit(0.0))


def positive_flag(c: ColumnOrName) -> Column:
    return F.when(_col(c) > 0, 1.0).otherwise(0.0)


def within(c: ColumnOrName, low: float, high: float) -> Column:
    return _col(c).between(low, high)


def has_text(c: ColumnOrName) -> Column:
    c = _col(c)
    return c.isNotNull() & (c != "")


def is_missing(c: ColumnOrName) -> Column:
    """Null or, seen as text, empty; works for a column of any type."""
    c = _col(c)
    return c.isNull() | (c.cast("string") == "")


def same_text(c: ColumnOrName, wanted: str) -> Column:
    """Case-blind equality; blanks around the wanted text do not count."""
    return F.lower(_col(c)) == wanted.strip().lower()


def points_by_category(
    c: ColumnOrName, points: Mapping[str, int] = CATEGORY_POINTS
) -> Column:
    c = _col(c)
    cases = F.lit(0)
    for category, value in points.items():
        cases = F.when(c == category, value).otherwise(cases)
    return cases


def edge_label(match_type: ColumnOrName, points: ColumnOrName) -> Column:
    return F.format_string("%s (%d pts)", _col(match_type), _col(points))


def edge_color(match_type: ColumnOrName) -> Column:
    return _edge_style(match_type, 0)


def edge_pen_width(match_type: ColumnOrName) -> Column:
    return _edge_style(match_type, 1)


def _edge_style(match_type: ColumnOrName, part: int) -> Column:
    c = _col(match_type)
    cases = F.lit(OTHER_EDGE_STYLE[part])
    for kind, style in EDGE_STYLES.items():
        cases = F.when(c == kind, F.lit(style[part])).otherwise(cases)
    return cases


def percent_error(predicted: ColumnOrName, actual: ColumnOrName) -> Column:
    p, a = _col(predicted), _col(actual)
    return F.abs(F.try_divide(p - a, a) * 100)


def key_bucket(key: ColumnOrName, buckets: int = 100, offset: int = 1) -> Column:
    """Bucket of a key from eight hex digits of its MD5, starting at digit ``offset``.

    The bucket depends on the key alone, so a split made with it stays the same
    for any partitioning, any re-run of a task and any engine.
    """
    digits = F.substring(F.md5(_col(key).cast("string")), offset, 8)
    return (F.conv(digits, 16, 10).cast("bigint") % buckets).cast("int")
