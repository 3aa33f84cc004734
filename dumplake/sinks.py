"""Sinks: ordered dump text, tables, databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import trim


def dump_text(text: Column, safe_delimiters: bool = False) -> Column:
    """A statement as it is written: trimmed and closed by a semicolon.

    ``safe_delimiters`` puts DELIMITER lines around a statement that holds a line ending in
    a semicolon, so that procedures read back whole.
    """
    bare = trim(text)
    closed = F.when(bare.endswith(";"), bare).otherwise(F.concat(bare, F.lit(";")))
    if not safe_delimiters:
        return closed
    mark = F.when(bare.contains("$$"), F.lit("//")).otherwise(F.lit("$$"))
    wrapped = F.concat(F.lit("DELIMITER "), mark, F.lit("\n"), bare, mark, F.lit("\nDELIMITER ;"))
    return F.when(bare.rlike(r";[ \t\r]*\n"), wrapped).otherwise(closed)


def check_target(spark: SparkSession, path: str, force: bool) -> None:
    """Refuse an existing output before any work is done."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not force and target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileExistsError(f"output {path} already exists; pass force=True to overwrite it")


def write_dump(output: DataFrame, path: str, compression: str = "none", force: bool = False,
               safe_delimiters: bool = False, per_file: bool = False) -> None:
    """Write statements in file order as part files whose names keep the order.

    Refuses an existing path unless ``force``. Readers see no partial result: Spark commits
    the part files of finished tasks and marks success at the end. ``per_file`` writes one
    folder per input file.
    """
    rows = output.select("file", "pos", dump_text(F.col("text"), safe_delimiters).alias("value"))
    rows = rows.filter("value not in (';', '0;')").orderBy("file", "pos")
    writer = rows.select("file", "value") if per_file else rows.select("value")
    out = writer.write.mode("overwrite" if force else "errorifexists").option("compression", compression)
    (out.partitionBy("file") if per_file else out).option("lineSep", "\n").text(path)


def save_table(rows: DataFrame, name: str, empty_first: bool = False, fmt: str = "parquet") -> None:
    """Store loaded rows in a table; ``empty_first`` replaces what it held, once."""
    rows.write.mode("overwrite" if empty_first else "append").format(fmt).saveAsTable(name)


def write_database(rows: DataFrame, url: str, table: str, batch_rows: int = 2000, empty_first: bool = False,
                   properties: dict[str, str] | None = None) -> None:
    """Load rows into a database over JDBC, ``batch_rows`` per round trip and commit per task."""
    options = {"rewriteBatchedStatements": "true", **(properties or {})}
    writer = rows.write.mode("overwrite" if empty_first else "append").option("batchsize", batch_rows)
    writer.option("truncate", "true").jdbc(url, table, properties=options)
