"""Physical lines of dump files: plain, gzip and bzip2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BOMS
from ..session import broadcast_within, pin_split_plan, stage

# Columns every line source provides. ``block`` is an offset that orders the pieces of a
# file, ``row`` counts the lines of a piece upwards by one from any start, and the lines of
# one piece lie together and in order within one partition.
LINE_COLUMNS = ("file", "block", "row", "value")


def bom_bytes(value: Column) -> Column:
    """Length of the byte-order mark a line starts with, 0 for none."""
    raw = value.cast("binary")
    length = F.lit(0)
    for mark in reversed(BOMS):
        length = F.when(F.startswith(raw, F.lit(bytearray(mark))), len(mark)).otherwise(length)
    return length


def read_lines(spark: SparkSession, paths: str | list[str], charset: str | None = None) -> DataFrame:
    """Lines of all files under ``paths``; they end at LF only, a final LF is optional.

    Plain and bzip2 files are split, gzip files are one task each (compress big dumps with
    bzip2, or into many gzip files). ``charset`` decodes single-byte dumps such as latin1.
    """
    pin_split_plan(spark)
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths)
    value = F.col("value")
    if charset:
        value = F.decode(value.cast("binary"), charset)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        value.alias("value"),
    )


# Statements and records are bucketed for windows along a file: a bucket lies in one block
# (bytes) and holds what starts on at most this many lines (rows, for unsplit gzip).
BUCKET_LINES = 1 << 17


def line_blocks(lines: DataFrame) -> DataFrame:
    """One staged row per block: its number, first line, first byte and size.

    Counting is a partial aggregate; only one row per block is shuffled.
    """
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("file", "block").agg(
        F.count("*").alias("lines"), F.min("row").alias("first_row"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
    )
    return stage(counts.select(
        "file", "block", "lines", "bytes", "first_row",
        (F.row_number().over(Window.partitionBy("file").orderBy("block")) - 1).cast("long").alias("block_no"),
        (F.coalesce(F.sum("lines").over(along), F.lit(0)) + 1).alias("first_line"),
        F.coalesce(F.sum("bytes").over(along), F.lit(0)).alias("start_byte"),
    ), "line-blocks")


def number_lines(lines: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Add ``line_no`` (from 1 along each file) and ``bucket``, without moving the text."""
    blocks = line_blocks(lines) if blocks is None else blocks
    base = blocks.select("file", "block", "block_no", "first_line", "first_row", "start_byte")
    base, small = broadcast_within(base)
    at = F.col("row") - F.col("first_row")
    out = lines.join(base, ["file", "block"]).select(
        "file", "block", "row", (F.col("first_line") + at).alias("line_no"),
        (F.shiftleft("block_no", 20) + F.floor(at / BUCKET_LINES)).alias("bucket"), "start_byte", "value",
    )
    # A shuffle join loses the order of the lines, which readers of whole blocks need.
    return out if small else out.sortWithinPartitions("file", "block", "row")
