"""Tab-separated metadata files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabgate.functions.text import strip

# A quoted cell (quotes doubled inside) with whatever follows it, or a plain cell. The quantifiers
# are possessive, so long cells cost no stack.
CELL = '\t("(?:[^"]++|"")*+"[^\t]*|[^\t]*)'
QUOTED = '^"((?:[^"]++|"")*+)"([^\t]*)$'


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines with the path, the split they came from and their place in the scan."""
    return with_place(spark.read.text(list(paths)))


def with_place(text: DataFrame) -> DataFrame:
    return text.select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def numbered(lines: DataFrame) -> DataFrame:
    """A1 line numbers, from 1.

    No file goes through one task: lines are counted per split, the counts are added up per file
    (a file has few splits), and each line adds its place within its split.
    """
    placed = lines.withColumn("_seq", F.monotonically_increasing_id())
    splits = placed.groupBy("path", "block").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return placed.join(offsets, ["path", "block"]).select(
        *[c for c in lines.columns if c != "block"],
        (F.col("_before") + F.col("_seq") - F.col("_first") + 1).cast("int").alias("line_number"),
    )


def raw_cells(value: Column) -> Column:
    """Cells of a line as written, quotes resolved."""
    clean = F.regexp_replace(value, "^\ufeff", "")
    pieces = F.regexp_extract_all(F.concat(F.lit("\t"), clean), F.lit(CELL), F.lit(1))

    def unquote(piece: Column) -> Column:
        inner = F.replace(F.regexp_extract(piece, QUOTED, 1), F.lit('""'), F.lit('"'))
        return F.when(piece.rlike(QUOTED), F.concat(inner, F.regexp_extract(piece, QUOTED, 2))).otherwise(piece)

    return F.transform(pieces, unquote)


def cells(value: Column) -> Column:
    """Trimmed cells. Only an empty cell is null; one of spaces is an empty text."""
    return F.transform(raw_cells(value), lambda c: F.when(c != "", strip(c)))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with ``cells``; lines without any character do not count as rows."""
    return lines.filter(F.length("value") > 0).withColumn("cells", cells(F.col("value")))


def unreadable(
    parsed_lines: DataFrame, expected: DataFrame, stored: DataFrame | None = None, keys: tuple[str, ...] = ("file_name",)
) -> DataFrame:
    """(keys, line_number, kind) of files that cannot be read.

    ``expected``: the files that batches name; ``stored``: those that are there, by default those
    with any line (a file may be empty, then only the listing tells). ``keys`` stand for a file,
    e.g. its batch and name. Missing files, the first line that is not UTF-8, and the first line
    with more cells than the header.
    """
    key = list(keys)
    present = (parsed_lines if stored is None else stored).select(*key).distinct()
    missing = expected.select(*key).join(present, key, "left_anti").select(
        *key, F.lit(None).cast("int").alias("line_number"), F.lit("file not found").alias("kind")
    )
    coded = parsed_lines.filter(~F.is_valid_utf8("value")).groupBy(*key).agg(
        F.min("line_number").alias("line_number")
    ).withColumn("kind", F.lit("non UTF-8 character(s) found"))
    widths = parsed_lines.withColumn("width", F.size("cells"))
    head = widths.groupBy(*key).agg(F.min_by("width", "line_number").alias("expected_width"))
    wide = (
        widths.join(head, key).filter(F.col("width") > F.col("expected_width"))
        .groupBy(*key, "expected_width")
        .agg(F.min(F.struct("line_number", "width")).alias("first"))
        .select(
            *key, F.col("first.line_number").alias("line_number"),
            F.format_string("Expected %s fields saw %s", "expected_width", "first.width").alias("kind"),
        )
    )
    return missing.unionByName(coded).unionByName(wide)
