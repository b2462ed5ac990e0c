"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
DELETE_MARK = "<delete>"


def strip(value: Column) -> Column:
    """Most values begin and end with a visible ASCII character; only the others are searched for spaces, which takes far
    longer than to look at both ends."""
    bare = (value >= "!") & (value < "\x7f") & F.substring(value, -1, 1).between("!", "~")
    return F.when(bare, value).otherwise(F.btrim(value, F.lit(SPACES)))


def is_blank(value: Column) -> Column:
    """Null or nothing but white space."""
    return F.coalesce(strip(value) == "", F.lit(True))


def split_plain(value: Column, delimiter: Column) -> Column:
    """Split on a literal delimiter."""
    return F.split(value, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")))


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def size_text(size: Column) -> Column:
    """Bytes as text, in steps of 1024 with two decimals and no padding zeros beyond the first."""
    # Unit names.
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")])
    step = F.lit(0)
    for power in range(1, 7):
        step = F.when(size >= 1024**power, F.lit(power)).otherwise(step)
    scaled = F.round((size / F.pow(F.lit(1024.0), step)).cast("decimal(38,10)"), 2).cast("decimal(38,2)")
    plain = F.regexp_replace(scaled.cast("string"), "0$", "")
    return F.when(size == 0, F.lit("0B")).otherwise(F.concat(plain, F.lit(" "), F.get(units, step)))
