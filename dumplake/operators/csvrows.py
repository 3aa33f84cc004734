"""CSV lines to records, INSERT text and typed rows. Each physical line is one record."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import add_slashes
from ..functions.text import trim
from ..sources.lines import bom_bytes, number_lines
from .load import _typed

# Fixed value: characters a target table's name may have.
TABLE_NAME = r"[A-Za-z0-9_$]+"


@dataclass(frozen=True)
class CsvOptions:
    delimiter: str = ","
    enclosure: str = '"'
    add_quotes: bool = True
    add_slashes: bool = True


def _class(char: str) -> str:
    return re.escape(char)


def parse_fields(line: Column, options: CsvOptions = CsvOptions()) -> Column:
    """The fields of a line as an array of strings; an empty field is ''.

    A field may be enclosed after leading blanks; a doubled enclosure stands for one, a
    backslash keeps the next character from closing and stays in the text, and what
    follows the closing enclosure up to the delimiter is kept as it is.
    """
    d, e = _class(options.delimiter), _class(options.enclosure)
    inside = rf"(?:[^{e}\\]++|\\.?+|{e}{e})*+"
    blank = rf"(?:(?!{d})\s)*+"
    whole = F.concat(F.lit(options.delimiter), F.regexp_replace(line, r"[\r\n]+\z", ""))
    pattern = rf"(?s)\G{d}((?:{blank}{e}{inside}(?:{e}|\z))?+[^{d}]*+)"
    enclosed = rf"(?s)^{blank}{e}({inside})(?:{e}|\z)(.*)$"

    def value(raw: Column) -> Column:
        body = F.regexp_extract(raw, enclosed, 1)
        rest = F.regexp_extract(raw, enclosed, 2)
        single = F.replace(body, F.lit(options.enclosure * 2), F.lit(options.enclosure))
        return F.when(raw.rlike(enclosed), F.concat(single, rest)).otherwise(raw)

    raw = F.regexp_extract_all(whole, F.lit(pattern), F.lit(1))
    return F.when(line.contains(options.enclosure), F.transform(raw, value)).otherwise(raw)


def csv_records(lines: DataFrame, options: CsvOptions = CsvOptions()) -> DataFrame:
    """Records of CSV lines, without blank and ``#`` lines; a header is a record like any other."""
    raw = F.col("value").cast("binary")
    bom = F.when(F.col("block") == 0, bom_bytes(F.col("value"))).otherwise(0)
    bare = F.when(bom > 0, F.substring(raw, bom + 1, F.octet_length("value")).cast("string")).otherwise(F.col("value"))
    numbered = number_lines(lines.withColumn("value", bare))
    text = trim(F.col("value"))
    return numbered.filter((text != "") & ~text.startswith("#")).select(
        "file", "bucket", "line_no", parse_fields(F.col("value"), options).alias("fields"))


def valid_table_name(name: Column) -> Column:
    return name.rlike(rf"^{TABLE_NAME}$") & (name != "0")


def check_table_name(table: str) -> str:
    if not table:
        raise ValueError("no target table for the CSV file is configured")
    if not re.fullmatch(TABLE_NAME, table) or table == "0":
        raise ValueError(f"Invalid table name: {table}")
    return table


def csv_inserts(records: DataFrame, table: str, options: CsvOptions = CsvOptions()) -> DataFrame:
    """One INSERT statement per record, as statement rows for the INSERT operators."""
    check_table_name(table)
    slashed = (lambda f: add_slashes(f)) if options.add_slashes else (lambda f: f)
    item = (lambda f: F.concat(F.lit("'"), slashed(f), F.lit("'"))) if options.add_quotes else slashed
    values = F.array_join(F.transform("fields", item), ",")
    text = F.concat(F.lit(f"INSERT INTO `{table}` VALUES ("), values, F.lit(")"))
    return records.select(
        "file", "bucket", F.col("line_no").alias("pos"), F.col("line_no").alias("first_line"),
        F.col("line_no").alias("last_line"), F.lit(1).alias("n_lines"), text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.lit("INSERT").alias("keyword"), F.lit(False).alias("is_tail"),
    )


def csv_rows(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Records as typed rows, by position; missing fields are null."""
    return records.select(*[
        _typed(F.try_element_at("fields", F.lit(k + 1)), field.dataType).alias(field.name)
        for k, field in enumerate(schema.fields)
    ])
