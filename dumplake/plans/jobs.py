"""Whole jobs: dump to optimised dump, dump to tables, CSV to table, dry run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import BatchOptions, assign_batches, batch_stats, bucket_runs, file_sizes, gather
from ..operators.csvrows import CsvOptions, csv_inserts, csv_records, csv_rows
from ..operators.inserts import analyse_inserts, statement_counts, with_insert_columns
from ..operators.load import (
    insert_tuples, list_tuples, rejects, resolve_keys, storable, table_schema, table_schemas, text_schemas, typed_rows, value_lists)
from ..operators.scan import ScanOptions
from ..operators.statements import Split, accepted, split_statements
from ..snapshots import Snapshot, publish
from ..sinks import check_target, save_table, write_dump
from ..sources.lines import read_lines
from ..session import stage


@dataclass(frozen=True)
class Optimised:
    """Output statements and the statistics of their making."""

    output: DataFrame
    batched: DataFrame
    per_file: DataFrame
    split: Split | None
    options: BatchOptions

    def statistics(self) -> DataFrame:
        """Per file: lines read, statements written, rows batched, ratio, output bytes."""
        written = self.output.groupBy("file").agg(
            F.count("*").alias("queries_written"),
            F.sum(F.col("n_bytes") + F.when(F.col("text").endswith(";"), 1).otherwise(2)).alias("output_size"),
        )
        stats = batch_stats(self.output, self.per_file, self.options).select(
            "file", F.col("rows_batched").alias("inserts_batched"),
            F.col("queries_executed").alias("batched_queries_executed"), "reduction_ratio", "extended_insert_count",
        )
        joined = written.join(stats, "file")
        if self.split is None:
            return joined
        return self.split.files.select("file", F.col("n_lines").alias("lines_processed")).join(joined, "file")


def batch_statements(statements: DataFrame, options: BatchOptions = BatchOptions(), split: Split | None = None) -> Optimised:
    if "values_at" not in statements.columns:
        statements = stage(with_insert_columns(statements), "inserts")
    inserts = analyse_inserts(statements)
    buckets = bucket_runs(inserts)
    per_file = file_sizes(inserts, options, buckets)
    batched = assign_batches(inserts, options, buckets, per_file)
    return Optimised(gather(batched), batched, per_file, split, options)


def optimise(lines: DataFrame, options: BatchOptions = BatchOptions(), scan_options: ScanOptions = ScanOptions("cli")) -> Optimised:
    """Merge runs of single-row INSERTs of dump lines; everything else keeps its place."""
    split = split_statements(lines, scan_options)
    return batch_statements(accepted(split.statements, scan_options.dialect), options, split)


def optimise_files(spark: SparkSession, source: str, target: str, preset: str = "conservative", force: bool = False,
                   compression: str = "none", safe_delimiters: bool = False, charset: str | None = None) -> DataFrame:
    """Read dump files, write the optimised dump, return the statistics per file."""
    check_target(spark, target, force)
    done = optimise(read_lines(spark, source, charset), BatchOptions.preset(preset))
    output = stage(done.output, "optimised")
    write_dump(output, target, compression, force, safe_delimiters)
    return Optimised(output, done.batched, done.per_file, done.split, done.options).statistics()


def _may_meet(statements: DataFrame) -> bool:
    """Whether a statement may meet the key of an earlier row, by the staged columns of the split alone."""
    if not {"keyword", "kind", "is_ignore"} <= set(statements.columns):
        return True
    return not statements.filter("keyword = 'REPLACE' OR is_ignore OR keyword = 'INSERT' AND kind = 'other'").isEmpty()


def load_table(split: Split, table: str, dialect: str = "import") -> DataFrame:
    """Rows of one table of a dump, typed by its own CREATE TABLE, in the state the dump leaves them."""
    statements = accepted(split.statements, dialect)
    schema, key = table_schema(statements, table)
    tuples = insert_tuples(statements).filter(F.col("table") == table.lower())
    return _stored(tuples, schema, key if key and _may_meet(statements) else [], once=True)


def _stored(tuples: DataFrame, schema, key: list[str], once: bool = False) -> DataFrame:
    """Typed rows of one table; keys only matter if a statement may meet an earlier row.

    Keys are resolved from several reads of the rows; ``once`` stages them first, for tuples that are not staged themselves.
    """
    tuples = tuples.filter(storable(schema))
    if not key:
        return typed_rows(tuples, schema)
    rows = typed_rows(tuples, schema, keep=("file", "pos", "item", "mode"))
    rows = stage(rows, "keyed-rows") if once else rows
    return resolve_keys(rows, key).select(*[f.name for f in schema.fields])


@dataclass(frozen=True)
class Loaded:
    """A frame per table of a dump, and what could not be stored as it stands."""

    tables: dict[str, DataFrame]
    rejects: DataFrame


def load_dump(split: Split, dialect: str = "import") -> Loaded:
    """All tables of a dump, typed by their CREATE TABLE, and the reject table. Tables that the dump fills but does not create are text.

    The value tuples are read from the statements once and staged by table.
    """
    statements = accepted(split.statements, dialect)
    labelled = split.statements if dialect == "cli" else split.statements.filter("not is_tail or like_sql")
    lists = stage(value_lists(labelled), "lists", partition_by=("table",))
    schemas = table_schemas(statements)
    schemas |= text_schemas(lists, list(schemas))
    meet = _may_meet(statements)
    tables = {name: _stored(list_tuples(lists.filter(F.col("table") == name)), schema, key if meet else []) for name, (schema, key) in schemas.items()}
    return Loaded(tables, rejects(labelled, {name: schema for name, (schema, _) in schemas.items()}, lists))


# Fixed value: the name under which the rejects of a load are published.
REJECTS = "#rejects"


def publish_dump(loaded: Loaded, base: str, mode: str = "new") -> Snapshot:
    """Store all tables of a loaded dump and its rejects under ``base``; readers see none of them, or all.

    ``new`` refuses tables that are there already, ``replace`` replaces them, ``append`` adds to them (see ``snapshots.publish``);
    the rejects are always those of the last load. Read them back by ``snapshots.published``.
    """
    if REJECTS in loaded.tables:
        raise ValueError(f"the dump has a table of the name {REJECTS}")
    return publish(loaded.tables | {REJECTS: loaded.rejects}, base, mode, replacing=(REJECTS,))


def load_csv(lines: DataFrame, schema, table: str, options: CsvOptions = CsvOptions(), empty_first: bool = False) -> None:
    """CSV lines into a table, which is emptied at most once, before the load."""
    save_table(csv_rows(csv_records(lines, options), schema), table, empty_first)


def csv_dump(lines: DataFrame, table: str, options: CsvOptions = CsvOptions(), batches: BatchOptions = BatchOptions()) -> Optimised:
    """CSV lines as a dump of multi-row INSERTs."""
    return batch_statements(csv_inserts(csv_records(lines, options), table, options), batches)


def dry_run(lines: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Count what a load would execute, by keyword and kind, and execute nothing."""
    split = split_statements(lines, options)
    return statement_counts(accepted(split.statements, options.dialect))
