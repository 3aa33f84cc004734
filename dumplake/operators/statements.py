"""Statements from dump lines, size guards, tails and line slices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TAIL_KEYWORDS, trim
from ..session import stage
from .inserts import with_insert_columns
from .scan import Scan, ScanOptions, scan

# A statement over this many bytes is handed on in ordered parts, so that rows stay bounded.
ROW_BYTES = 64 * 1024**2

# Error messages.
OVER_BYTES = "Query exceeds maximum memory limit (%d bytes)"
OVER_LINES = "Query exceeds maximum line count (%d lines)"
UNCLOSED = "End of file reached with unclosed string. The dump file may be corrupted or truncated."


@dataclass(frozen=True)
class Split:
    """``statements`` in file order by ``pos``; ``files`` has one quality row per file."""

    statements: DataFrame
    files: DataFrame
    scan: Scan


def _grouped_borders(borders: DataFrame, row_bytes: int) -> DataFrame:
    """Border pieces with the number of their statement and of its part (0: it fits one row).

    There are a few such pieces per block. The windows that find which belong together run
    over their keys only.
    """
    order = Window.partitionBy("file").orderBy("first_line")
    before = F.sum(F.col("closed").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    upto = F.sum("raw_bytes").over(Window.partitionBy("file", "grp").orderBy("first_line"))
    keys = borders.select("file", "first_line", "raw_bytes", "closed", F.coalesce(before, F.lit(0)).alias("grp"))
    whole = keys.groupBy("file", "grp").agg(
        (F.sum("raw_bytes") <= row_bytes).alias("fits"), F.max("closed").alias("ends"), F.min("first_line").alias("stmt"))
    parts = keys.withColumn("upto", upto).join(whole, ["file", "grp"]).select(
        "file", "first_line", "grp", "ends", "stmt",
        F.when(F.col("fits"), 0).otherwise(F.floor((F.col("upto") - F.col("raw_bytes")) / row_bytes) + 1).cast("int").alias("part"))
    return borders.join(parts, ["file", "first_line"])


def _joined_borders(grouped: DataFrame) -> DataFrame:
    """Statements from border pieces, in parts where one row would be too long."""
    parts = F.array_sort(F.collect_list(F.struct("first_line", "text")))
    return (
        grouped.groupBy("file", "grp", "part").agg(
            F.min("bucket").alias("bucket"), F.min("first_line").alias("_first"), F.max("last_line").alias("last_line"),
            F.sum("n_lines").alias("n_lines"), F.sum("n_counted").alias("n_counted"), F.sum("raw_bytes").alias("raw_bytes"),
            F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"),
            F.max_by("delimiter", "last_line").alias("delimiter"), F.max("ends").alias("closed"), F.min("stmt").alias("stmt"),
        ).drop("grp").withColumnRenamed("_first", "first_line")
    )


def _without_delimiter(text: Column, delimiter: Column) -> Column:
    body = trim(text)
    cut = F.when(
        body.endswith(delimiter), F.substring(body, F.lit(1), F.length(body) - F.length(delimiter))
    ).otherwise(body)
    return trim(cut)


def _like_sql(text: Column) -> Column:
    return text.rlike(rf"(?i)^(?:{'|'.join(TAIL_KEYWORDS)}|/\*|--)")


_RAW = ("file", "bucket", "first_line", "last_line", "n_lines", "n_counted", "raw_bytes", "delimiter", "closed")


def _finished(pieces: DataFrame) -> DataFrame:
    """Text without its delimiter, and everything derived from the text, computed once."""
    text = F.when(F.col("part") == 0, _without_delimiter(F.col("text"), F.col("delimiter"))).otherwise(F.col("text"))
    clean = pieces.withColumn("text", text).withColumns({
        "n_bytes": F.octet_length("text").cast("long"),
        "keyword": F.upper(F.regexp_extract("text", r"^([A-Za-z]*+)", 1)),
        "blank": F.col("text").isin("", "0"), "like_sql": F.col("closed") | (F.col("part") > 0) | _like_sql(F.col("text")),
    })
    return with_insert_columns(clean)


def _guard(max_lines: int | None, max_bytes: int | None) -> Column:
    """The message of a statement over a limit that the caller gave."""
    error = F.lit(None).cast("string")
    if max_lines is not None:
        error = F.when(F.col("n_counted") > max_lines, F.format_string(OVER_LINES, F.lit(max_lines))).otherwise(error)
    if max_bytes is not None:
        error = F.when(F.col("raw_bytes") > max_bytes, F.format_string(OVER_BYTES, F.lit(max_bytes))).otherwise(error)
    return error


def split_statements(
    lines: DataFrame,
    options: ScanOptions | None = None,
    max_lines: int | None = None,
    max_bytes: int | None = None,
    row_bytes: int = ROW_BYTES,
) -> Split:
    """Cut lines into statements.

    A statement ends at a line that ends outside a string with the delimiter in force. A size
    limit given here labels the statements over it in ``error`` and changes nothing else.
    A statement over ``row_bytes`` comes as raw parts: rows with ``part`` from 1 on, in the
    order of ``pos``, whose texts joined by line feeds are the statement with its delimiter. ``stmt`` is its first line.
    Pieces are staged once, with the few border pieces in a partition of their own, so
    joining borders reads nothing else.
    """
    scanned = scan(lines, options or ScanOptions())
    cut = scanned.pieces()
    piece = F.when(F.col("border"), F.col("text"))
    pieces = stage(_finished(cut.withColumns({"piece": piece, "part": F.lit(0), "stmt": F.col("first_line")})), "pieces", partition_by=("border",))
    borders = pieces.filter("border").select(*_RAW, F.col("piece").alias("text"))
    joined = stage(_finished(_joined_borders(_grouped_borders(borders, row_bytes))), "borders")
    whole = pieces.filter("not border").drop("border", "piece").unionByName(joined)
    of_insert = [F.when(F.col("part") == 0, F.col(c)).alias(c) for c in ("table", "prefix", "values_at", "n_sets", "vbytes", "is_ignore")]
    statements = whole.filter("part > 0 or not blank").select(
        "file", "bucket", F.col("first_line").alias("pos"), "first_line", "last_line",
        F.col("n_lines").cast("int").alias("n_lines"), "text", "n_bytes", "keyword", "part", "stmt",
        (~F.col("closed")).alias("is_tail"), "like_sql", _guard(max_lines, max_bytes).alias("error"),
        F.when(F.col("part") == 0, F.col("kind")).otherwise("other").alias("kind"), *of_insert,
    )
    return Split(statements, scanned.files(), scanned)


def accepted(statements: DataFrame, dialect: str = "import") -> DataFrame:
    """The statements that are executed, labelled ones included.

    Import: the tail of a file only if it starts like SQL. Cli: all.
    """
    kept = statements if dialect == "cli" else statements.filter("not is_tail or like_sql")
    return kept.drop("error", "like_sql")


def quality(split: Split) -> DataFrame:
    """Per file: lines, statements, size errors, undelimited tail, unclosed string."""
    counts = split.statements.groupBy("file").agg(
        F.count_if(F.col("error").isNull()).alias("n_statements"),
        F.count("error").alias("n_errors"), F.max("is_tail").alias("has_tail"),
    )
    message = F.when(F.col("unclosed_string"), F.lit(UNCLOSED))
    return split.files.join(counts, "file", "left").select(
        "file", "n_lines", F.coalesce("n_statements", F.lit(0)).alias("n_statements"),
        F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
        F.coalesce("has_tail", F.lit(False)).alias("has_tail"), "end_state", message.alias("problem"),
    )
