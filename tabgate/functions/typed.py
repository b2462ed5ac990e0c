"""Text read as numbers, dates and booleans, with nulls where the text does not parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabgate.functions.text import strip

INTEGER_SHAPE = r"^[+-]?\d+(_\d+)*$"
NUMBER_SHAPE = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
NOT_FINITE_SHAPE = r"^[+-]?(inf|infinity|nan)$"
# The list of accepted date layouts is a parameter of the checks; this is only the default.
DATE_LAYOUTS = ("yyyy-M-d", "M/d/yyyy")
# Accepted spellings of a boolean.
TRUE_WORDS = ("yes", "true")
FALSE_WORDS = ("no", "false")


def as_integer(value: Column) -> Column:
    """Decimal with up to 38 digits; longer integers are matched by shape only (see is_integer)."""
    text = strip(value)
    return F.when(is_integer(value), F.replace(text, F.lit("_"), F.lit("")).try_cast("decimal(38,0)"))


def integer_text(value: Column) -> Column:
    """The integer as text without sign +, underscores and leading zeros, however long it is."""
    return integer_in(strip(value))


def integer_in(text: Column) -> Column:
    """integer_text of a text that has been stripped."""
    plain = F.replace(text, F.lit("_"), F.lit(""))
    digits = F.regexp_replace(plain, r"^[+-]?0*(?=\d)", "")
    return F.when(
        text.rlike(INTEGER_SHAPE), F.concat(F.when(plain.startswith("-") & (digits != "0"), "-").otherwise(""), digits))


def number_text(number: Column) -> Column:
    """The shortest decimal text of a double, without a fraction of zero; very large, very small and not finite
    numbers as 1e30, 1.5e-7, inf, -inf and nan."""
    size, text = F.abs(number), F.lower(number.cast("string"))
    wide = number.try_cast("decimal(38,10)").cast("string")
    return (
        F.when(F.isnan(number), F.lit("nan"))
        .when(size == float("inf"), F.when(number > 0, "inf").otherwise("-inf"))
        .when(number == 0, F.lit("0"))
        .when((size >= 1e-3) & (size < 1e7), F.regexp_replace(text, r"\.0$", ""))
        .when((size >= 1e7) & (size < 1e16), F.regexp_replace(wide, r"\.?0+$", ""))
        .otherwise(F.regexp_replace(text, r"\.0e", "e"))
    )


def is_integer(value: Column) -> Column:
    return strip(value).rlike(INTEGER_SHAPE)


def as_number(value: Column) -> Column:
    return number_in(strip(value))


def number_in(text: Column) -> Column:
    """as_number of a text that has been stripped."""
    plain = F.replace(text, F.lit("_"), F.lit(""))
    low = F.lower(plain)
    odd = (
        F.when(low.endswith("nan"), F.lit(float("nan")))
        .when(low.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    return F.when(text.rlike(NUMBER_SHAPE), plain.try_cast("double")).when(
        low.rlike(NOT_FINITE_SHAPE), odd
    )


def as_moment(value: Column, layouts: tuple[str, ...] = DATE_LAYOUTS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(layout)) for layout in layouts])


def as_flag(value: Column) -> Column:
    """'true' / 'false' text, or null when the value is no boolean word."""
    low = F.lower(value)
    return F.when(low.isin(*TRUE_WORDS), F.lit("true")).when(low.isin(*FALSE_WORDS), F.lit("false"))
