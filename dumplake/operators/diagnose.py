"""What a load error says, and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The error forms that name a table, and the shown length of a statement.
TABLE_ERROR = r"(?i)Table\s+['`]?([^'`\s]+)['`]?\s+(already exists|doesn't exist)"
SHOWN_BYTES = 500

ACTIONS = {
    ("already exists", True): "drop table and restart",
    ("already exists", False): "drop table by hand or use another file",
    ("doesn't exist", True): "restart from the beginning",
    ("doesn't exist", False): "create table by hand before the load",
}


def parse_errors(failed: DataFrame, error: str = "error") -> DataFrame:
    """Add the table an error names (without database) and its kind."""
    named = F.regexp_extract(error, TABLE_ERROR, 1)
    return failed.withColumns({
        "table_name": F.when(named != "", named),
        "error_kind": F.when(named != "", F.lower(F.regexp_extract(error, TABLE_ERROR, 2))),
    })


def advise(failed: DataFrame, created: DataFrame) -> DataFrame:
    """Failed loads with the action their error calls for.

    ``created`` (file, table_name) is distinct by ``created_tables``; Spark broadcasts it if
    it is small, else both sides meet by (file, table).
    """
    parsed = parse_errors(failed)
    have = created.select(
        F.col("file").alias("filename"), F.lower("table_name").alias("_t"), F.lit(True).alias("_has")).distinct()
    joined = parsed.withColumn("_t", F.lower("table_name")).join(have, ["filename", "_t"], "left").drop("_t")
    has = F.coalesce("_has", F.lit(False))
    action = F.lit(None).cast("string")
    for (kind, created_there), text in ACTIONS.items():
        action = F.when((F.col("error_kind") == kind) & (has == created_there), text).otherwise(action)
    return joined.withColumns({"has_create_table": has, "action": action}).drop("_has")


def error_message(line: Column, statement: Column, error: Column) -> Column:
    """The message of a failed statement, the statement cut to 500 bytes."""
    head = F.concat(F.substring(statement.cast("binary"), F.lit(1), F.lit(SHOWN_BYTES)).cast("string"), F.lit("..."))
    shown = F.when(F.octet_length(statement) > SHOWN_BYTES, head).otherwise(statement)
    return F.concat(F.lit("SQL Error at line "), line.cast("string"), F.lit(":\nQuery: "), shown, F.lit("\nMySQL Error: "), error)
