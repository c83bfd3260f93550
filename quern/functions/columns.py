"""Column expressions shared by the operators; all built-in, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = " \t\n\r\f\v"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def stripped(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def like_any(keyword: str, *cols: str) -> Column:
    """Case-insensitive LIKE on any column; ``%`` and ``_`` in the keyword stay wildcards."""
    return any_of([F.coalesce(F.ilike(F.col(c), F.lit(f"%{keyword}%")), F.lit(False)) for c in cols])


def contains_any(text: str, *cols: str) -> Column:
    """Plain case-insensitive search; no wildcards."""
    return any_of([F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False)) for c in cols])


def iso_text(col: Column) -> Column:
    """ISO date and time; a fraction is shown only when there is one."""
    seconds = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(col, "SSSSSS")
    return F.when(fraction == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), fraction))


def number_text(col: Column, dtype: T.DataType) -> Column:
    """A number as plain text: no trailing ``.0`` and no exponent."""
    if not is_double(dtype):
        return col.cast("string")
    text = col.cast("string")
    plain = F.regexp_replace(text, r"\.0$", "")
    return F.when(F.contains(text, F.lit("E")), _without_exponent(text)).otherwise(plain)


def _without_exponent(text: Column) -> Column:
    """``-1.25E-7`` as ``-0.000000125``: the same digits, with the point moved."""
    sign = F.regexp_extract(text, r"^(-?)", 1)
    whole = F.regexp_extract(text, r"^-?(\d+)", 1)
    fraction = F.regexp_replace(F.regexp_extract(text, r"\.(\d+)E", 1), r"0+$", "")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int")
    digits = F.concat(whole, fraction)
    point = F.length(whole) + power
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    large = F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits)))
    inside = F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1))
    return F.concat(sign, F.when(point <= 0, small).when(point >= F.length(digits), large).otherwise(inside))


def cell_text(col: Column, dtype: T.DataType) -> Column:
    """What a reader sees in a cell: NULL reads as ``null``, times as ISO text."""
    if isinstance(dtype, T.NumericType):
        text = number_text(col, dtype)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = iso_text(col)
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(col)
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit("null"))


def is_double(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def scaled_hundredths(col: Column) -> Column:
    """200 times the absolute value as a double, and the error of that product."""
    x = F.abs(col.cast("double"))
    scaled, spread = x * F.lit(200.0), x * F.lit(134217729.0)
    high = spread - (spread - x)
    error = (high * F.lit(200.0) - scaled) + (x - high) * F.lit(200.0)
    return F.struct(scaled.alias("value"), error.alias("error"))


def two_decimals(col: Column, scaled: Column | None = None) -> Column:
    """A double with two decimals, rounded by its exact binary value, halves up.

    1.005 is stored a little below 1.005 and gives 1.00: at a half the error of
    the scaled product decides.
    """
    parts = scaled_hundredths(col) if scaled is None else scaled
    value, error = parts["value"], parts["error"]
    half = F.when(F.abs(value) < 2.0**62, F.floor(value / F.lit(2.0))).otherwise(F.lit(0)).cast("long")
    rest = value - half.cast("double") * F.lit(2.0)
    hundredths = half + F.when((rest > 1.0) | ((rest == 1.0) & (error >= 0.0)), F.lit(1)).otherwise(F.lit(0))
    # a decimal of scale 2 made from the whole number prints both digits
    text = (hundredths.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(22,2)").cast("string")
    return F.when(col < 0, F.concat(F.lit("-"), text)).otherwise(text)


def display_text(col: Column, dtype: T.DataType, scaled: Column | None = None) -> Column:
    """Table cell: ``-`` for NULL, whole numbers as they are, other numbers with two decimals."""
    if is_double(dtype):
        value = col.cast("double")
        # from 2^53 on every double is whole; NaN and infinities have no decimals
        whole = F.isnan(value) | (F.abs(value) >= 2.0**53)
        text = F.when(whole, number_text(value, T.DoubleType())).otherwise(
            F.when(value == F.floor(value), number_text(value, T.DoubleType())).otherwise(two_decimals(value, scaled))
        )
    elif isinstance(dtype, T.DecimalType):
        text = F.when(col == F.floor(col), F.floor(col).cast("string")).otherwise(
            F.round(col, 2).cast("decimal(38,2)").cast("string")
        )
    else:
        text = cell_text(col, dtype)
    return F.when(col.isNull(), F.lit("-")).otherwise(text)


def mask_middle(col: Column) -> Column:
    """Keep the first three and last four characters; shorter texts are hidden entirely."""
    length = F.char_length(col)
    shown = F.concat(F.left(col, F.lit(3)), F.repeat(F.lit("*"), length - 7), F.right(col, F.lit(4)))
    return F.when(length < 8, F.repeat(F.lit("*"), length)).otherwise(shown)


def rate(part: Column, whole: Column) -> Column:
    """A share, 0 when there is nothing to share."""
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def money(col: Column) -> Column:
    """Exact money for sums: the same digits on every run and partitioning."""
    return col.cast("decimal(18,2)")
