"""Small Column helpers shared by the operators."""
from pyspark.sql import Column, functions as F


def steps(value: Column, table, otherwise) -> Column:
    """Points of the first ``(threshold, points)`` with ``value >= threshold``."""
    out = None
    for threshold, points in table:
        out = (F if out is None else out).when(value >= threshold, _lit(points))
    return out.otherwise(_lit(otherwise))


def upto(value: Column, table, otherwise) -> Column:
    """Points of the first ``(limit, points)`` with ``value <= limit``."""
    out = None
    for limit, points in table:
        out = (F if out is None else out).when(value <= limit, _lit(points))
    return out.otherwise(_lit(otherwise))


def below(value: Column, table, otherwise) -> Column:
    """Points of the first ``(limit, points)`` with ``value < limit``."""
    out = None
    for limit, points in table:
        out = (F if out is None else out).when(value < limit, _lit(points))
    return out.otherwise(_lit(otherwise))


def _lit(x):
    return x if isinstance(x, Column) else F.lit(x)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def first_word_hit(text: Column, words, otherwise=None) -> Column:
    """Value of the first ``(word, value)`` contained in the text, in list order."""
    out = None
    for word, value in words:
        out = (F if out is None else out).when(text.contains(word), _lit(value))
    return out if otherwise is None else out.otherwise(_lit(otherwise))


def words(items) -> Column:
    return F.array(*[F.lit(w) for w in items])


def present(number: Column) -> Column:
    """Zero counts as missing."""
    return F.nullif(number, F.lit(0))


def text(col: Column) -> Column:
    """The empty string counts as missing."""
    return F.nullif(col, F.lit(""))


def compact(*items: Column) -> Column:
    """Array of the non-null items in order."""
    return F.array_compact(F.array(*items))


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)


def discount(price: Column, market: Column) -> Column:
    return (market - price) / market * 100


def thousands(col: Column) -> Column:
    return F.format_number(col, 0)


def seq(low: Column, high: Column) -> Column:
    """Integers low..high, or an empty array when low > high."""
    return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))


def fixed0(col: Column) -> Column:
    """Whole-number text without grouping, rounded half-even on the exact value."""
    return F.replace(F.format_number(col, 0), F.lit(","), F.lit(""))


def fixed1(col: Column) -> Column:
    """One-decimal text without grouping, rounded half-even on the exact value."""
    return F.replace(F.format_number(col, 1), F.lit(","), F.lit(""))


def round2(col: Column) -> Column:
    """Two decimals; floating noise is removed first so that ties always round up."""
    return F.round(F.round(col, 9), 2)
