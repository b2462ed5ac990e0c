"""Turning check conditions into issue rows without a shuffle."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgate.messages import CATALOG

ISSUE_KEYS = ("submission_id", "record_id", "node_type", "node_id")


class Fault(NamedTuple):
    """A check: when it fails, and its issue struct, which is null when it doesn't."""

    when: Column
    issue: Column


def text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def prefix() -> Column:
    """[file: line n], the opening of every record-level message."""
    return F.format_string("[%s: line %s]", F.col("file_name"), F.col("line_number"))


def fault(code: str, when: Column, prop, value, *args, description: Column | None = None) -> Fault:
    """One issue struct where the condition holds, else null."""
    title, severity, template = CATALOG[code]
    if description is None:
        shown = [F.coalesce(text(a).cast("string"), F.lit("None")) for a in args]
        description = F.format_string(template, *shown) if shown else F.lit(template)
    issue = F.when(
        when,
        F.struct(
            F.lit(code).alias("code"),
            F.lit(severity).alias("severity"),
            F.lit(title).alias("title"),
            text(prop).cast("string").alias("offending_property"),
            text(value).cast("string").alias("offending_value"),
            description.alias("description"),
        ),
    )
    return Fault(when, issue)


def any_of(faults: list[Fault]) -> Column:
    return reduce(or_, [F.coalesce(f.when, F.lit(False)) for f in faults])


def first_of(*faults: Fault) -> Fault:
    """Checks that end at the first hit."""
    return Fault(any_of(list(faults)), F.coalesce(*[f.issue for f in faults]))


def emit(df: DataFrame, faults: list[Fault], keep: tuple[str, ...] = ISSUE_KEYS) -> DataFrame:
    """Issue rows of all faults that fired, one row each; the row's key columns are kept.

    Most rows have none. Conditions alone are compiled and take a fraction of the time that lists of issues do, which are
    made for the other rows only. Of a list that is a mere column the planner would filter by its size first, making it twice.
    """
    hits = F.when(any_of(faults), F.filter(F.array(*[f.issue for f in faults]), lambda f: f.isNotNull()))
    return df.withColumn("_hits", hits).select(*keep, F.inline(F.coalesce("_hits", F.array())))


def selected(faults: dict[str, Fault], codes) -> list[Fault]:
    return [one for name, one in faults.items() if codes is None or name.split(".")[0] in codes]
