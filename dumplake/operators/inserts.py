"""INSERT analysis: table, prefix and values text of simple INSERT statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_of, rtrim, trim

# Characters cut from the end of a values text.
VALUES_TAIL = " \t\n\r;"

# The table is the first word after INTO, else after IGNORE, else after INSERT, each at its
# first occurrence in the prefix. The usual form is tried first.
_NAME = r"(`?\w++`?(?:\.`?\w++`?)?)"
USUAL = rf"(?i)^INSERT\s++(?:IGNORE\s++)?INTO[ \t\n\r\x00\x0B]*+{_NAME}"
_LEAD = (
    r"(?:(?=.*INTO)(?>.*?INTO)|(?!.*INTO)(?:(?=.*IGNORE)(?>.*?IGNORE)|(?!.*IGNORE)INSERT))"
)
TABLE = rf"(?is)^{_LEAD}[ \t\n\r\x00\x0B]*+{_NAME}"


def _holds(text: Column, upper: Column, word: str) -> Column:
    """Whether ``word`` occurs in any case; the upper-cased text rules most rows out."""
    return upper.contains(word) & text.rlike(f"(?i){word}")


def with_insert_columns(df: DataFrame) -> DataFrame:
    """Add kind, table, prefix, values_at, n_sets, vbytes and is_ignore to rows with a trimmed ``text``.

    kind: 'insert_single' (can be batched), 'insert_extended' (two or more value sets by
    ``),(``) or 'other'. INSERT with ON DUPLICATE or SELECT counts as other. ``values_at``
    is where the values start, so that the text is stored once; ``vbytes`` is their length.
    """
    kept, q = df.columns, F.col("text")
    up = F.upper(q)
    simple = q.rlike("(?i)^INSERT") & ~_holds(q, up, "ON DUPLICATE") & ~_holds(q, up, " SELECT ")
    df = df.withColumn("_head", F.when(simple, F.regexp_extract(q, r"(?is)^(?>.*?VALUES)", 0)))
    head = F.col("_head")
    df = df.withColumn("_at", F.when(head != "", _locate_from(q, F.length(head) + 1)))
    df = df.withColumn("_values", values_from(q, F.col("_at"))).withColumn(
        "_prefix", F.concat(rtrim(F.substring(head, F.lit(1), F.length(head) - 6)), F.lit(" VALUES")))
    df = df.withColumn("_usual", F.regexp_extract("_prefix", USUAL, 1))
    df = df.withColumn("_table", F.when(F.col("_usual") != "", F.col("_usual")).otherwise(F.regexp_extract("_prefix", TABLE, 1)))
    df = df.withColumn("_ok", F.col("_values").endswith(")") & (F.col("_table") != ""))
    values = F.col("_values")
    ok, sets = F.col("_ok"), F.when(values.contains("),("), count_of(values, "),(") + 1).otherwise(1)
    df = df.withColumn("n_sets", F.when(ok, sets))
    kind = F.when(F.col("n_sets") == 1, "insert_single").when(ok, "insert_extended").otherwise("other")
    return df.select(
        *kept, kind.alias("kind"), F.when(ok, F.lower("_table")).alias("table"),
        F.when(ok, F.col("_prefix")).alias("prefix"), F.when(ok, F.col("_at")).alias("values_at"), "n_sets",
        F.when(ok, F.octet_length("_values")).alias("vbytes"),
        F.when(ok, F.col("_prefix").rlike(r"(?i)^INSERT\s+IGNORE\b")).alias("is_ignore"),
    )


def _locate_from(text: Column, start: Column) -> Column:
    """Position of the first '(' at or after ``start``, null if there is none."""
    found = F.locate("(", F.substring(text, start, F.length(text)))
    return F.when(found > 0, start + found - 1)


def values_from(text: Column, at: Column) -> Column:
    return F.rtrim(F.substring(text, at, F.length(text)), F.lit(VALUES_TAIL))


def insert_values(statements: DataFrame) -> DataFrame:
    """Replace ``values_at`` by the ``values`` text itself."""
    return statements.withColumn("values", values_from(F.col("text"), F.col("values_at"))).drop("values_at")


def analyse_inserts(statements: DataFrame) -> DataFrame:
    """Statement rows (with a ``text``) with their INSERT parts as columns."""
    if "values_at" in statements.columns:
        return insert_values(statements)
    return insert_values(with_insert_columns(statements.withColumn("text", trim(F.col("text")))))


def statement_counts(inserts: DataFrame) -> DataFrame:
    """Dry run: statements per file, keyword and kind; nothing is executed."""
    return inserts.groupBy("file", "keyword", "kind").agg(
        F.count("*").alias("n_statements"), F.sum("n_lines").alias("n_lines"), F.sum("n_bytes").alias("n_bytes")
    )
