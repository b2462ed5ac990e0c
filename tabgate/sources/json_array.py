"""Objects of large JSON arrays, read in splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabgate.session import stage

SPLIT = ["path", "block"]


def _strings_removed(value: Column) -> Column:
    """What stands outside of strings, of a text without escapes; a string may be left open."""
    return F.regexp_replace(value, r'"[^"]*+("|\z)', "")


def _count(value: Column, letter: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(letter), F.lit("")))


def pieces(spark: SparkSession, *paths: str) -> DataFrame:
    """Texts between closing braces, with what each does to a reader that enters it outside (0) or inside (1) a string.

    ``flips``: 1 if the reader leaves it in the other state. ``depth_0``, ``depth_1``: the change of the depth of
    objects, the brace that ends the piece included; that brace counts only outside of strings. An escape never spans
    two pieces, as no escape names a brace.
    """
    text = spark.read.option("lineSep", "}").text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    bare = text.withColumn("_bare", F.regexp_replace("value", r"(?s)\\.", ""))
    flips = bare.withColumn("flips", F.pmod(_count(F.col("_bare"), '"'), F.lit(2)))
    return flips.withColumns({
        "depth_0": _count(_strings_removed(F.col("_bare")), "{") - (1 - F.col("flips")),
        "depth_1": _count(_strings_removed(F.concat(F.lit('"'), "_bare")), "{") - F.col("flips"),
    }).drop("_bare")


def _before(value: Column, *keys: str, order: str) -> Column:
    rows = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(rows), F.lit(0))


def objects(spark: SparkSession, *paths: str) -> DataFrame:
    """path, position (from 0 in its file) and text of each outermost object of JSON arrays.

    A split of a file doesn't know whether it begins inside a string, or how deep. So changes of state and depth are
    summed inside each split for both cases, the sums of splits (a few rows a file) are added up over the file, which
    tells how each split begins, and the pieces of an object meet by its number. The texts are scanned once and stored;
    nothing larger than a split or an object meets in one task. Line breaks may stand anywhere. Entries that aren't
    objects (null, numbers, texts) are skipped; an empty file or array has none. In a
    file that breaks off, an object that lacks more than its last brace isn't returned. Several objects without an array around them, one to a line, are read alike.
    """
    odd = F.pmod(_before(F.col("flips"), *SPLIT, order="seq"), F.lit(2))
    found = pieces(spark, *paths).withColumn("_odd", odd)
    if_outside = F.when(F.col("_odd") == 0, F.col("depth_0")).otherwise(F.col("depth_1"))
    if_inside = F.when(F.col("_odd") == 0, F.col("depth_1")).otherwise(F.col("depth_0"))
    through = Window.partitionBy(*SPLIT).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    states = stage(
        found.withColumns({
            "_0": if_outside, "_1": if_inside, "_inside": F.pmod(F.col("_odd") + F.col("flips"), F.lit(2)),
        }).withColumns({"_after_0": F.sum("_0").over(through), "_after_1": F.sum("_1").over(through)})
        .select(*SPLIT, "seq", "value", "flips", "_0", "_1", "_inside", "_after_0", "_after_1"),
        "array-pieces",
    )
    splits = states.groupBy(*SPLIT).agg(F.sum("flips").alias("flips"), F.sum("_0").alias("_0"), F.sum("_1").alias("_1"))
    begun = splits.withColumn("_open", F.pmod(_before(F.col("flips"), "path", order="block"), F.lit(2)))
    own = F.when(F.col("_open") == 0, F.col("_0")).otherwise(F.col("_1"))
    begun = begun.select(*SPLIT, "_open", _before(own, "path", order="block").alias("_depth"))
    outside = F.col("_inside") == F.col("_open")
    depth = F.col("_depth") + F.when(F.col("_open") == 0, F.col("_after_0")).otherwise(F.col("_after_1"))
    ended = states.join(begun, SPLIT).withColumn("_ends", (outside & (depth == 0)).cast("long"))
    numbered = ended.select(*SPLIT, "seq", "value", "_ends", _before(F.col("_ends"), *SPLIT, order="seq").alias("_nth"))
    totals = ended.groupBy(*SPLIT).agg(F.sum("_ends").alias("_n"))
    offsets = totals.select(*SPLIT, _before(F.col("_n"), "path", order="block").alias("_first"))
    placed = numbered.join(offsets, SPLIT).withColumn("position", F.col("_first") + F.col("_nth"))
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "value")))
    whole = placed.groupBy("path", "position").agg(F.max("_ends").alias("_ends"), parts.alias("_parts")).filter("_ends = 1")
    joined = F.concat(F.array_join(F.transform("_parts", lambda p: p["value"]), "}"), F.lit("}"))
    return whole.select("path", "position", _from_first_brace(joined).alias("text"))


def _from_first_brace(text: Column) -> Column:
    """The object without what stands before it: commas, brackets, and entries that aren't objects (strings may hold braces)."""
    return F.regexp_replace(text, r'\A(?:[^"{]|"(?:[^"\\]|\\.)*+")*+', "")


def read_objects(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """The objects as columns of ``schema``, with path and position."""
    return objects(spark, *paths).select("path", "position", F.from_json("text", schema).alias("_o")).select("path", "position", "_o.*")
