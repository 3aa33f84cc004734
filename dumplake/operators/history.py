"""The history of loads: entries listed newest first, their summary, and a versioned folder that keeps them.

Every change of the folder is one new version (see ``snapshots``), so writers at the same time lose no entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.format import format_bytes, format_duration
from ..snapshots import Snapshot, Table, change, current, delete_path, names_in, write_part

# Fixed value: entries listed by default.
LIST = 20
# Parts of a history on disk beyond which an append writes them as one.
FOLD = 64
_NAME = "history"

SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("filename", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("queries_executed", T.LongType()),
    T.StructField("lines_processed", T.LongType()), T.StructField("bytes_processed", T.LongType()),
    T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType()),
    T.StructField("duration", T.DoubleType()),
])


def _start(spark: SparkSession, path: str) -> Snapshot:
    """A history without versions: the files of its folder, or the file itself, are its parts."""
    base = path.rstrip("/")
    files = [n for n in names_in(spark, base) if not n.startswith(("_", ".")) and n != "data"]
    return Snapshot(base, 0, {_NAME: Table(tuple(files), SCHEMA, "json")})


def _opened(spark: SparkSession, path: str) -> Snapshot:
    now = current(spark, path)
    return now if now.version else _start(spark, path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """History entries under ``path`` as they are now: versioned, or a plain folder of JSON lines; a missing or broken one is empty."""
    return _opened(spark, path).read(spark, _NAME).filter("id is not null")


def read_history_array(spark: SparkSession, path: str) -> DataFrame:
    """History kept as one JSON array per file."""
    rows = spark.read.option("multiLine", "true").option("mode", "DROPMALFORMED").schema(SCHEMA).json(path)
    return rows.filter("id is not null")


def entries(loads: DataFrame) -> DataFrame:
    """Entries as shown: duration rounded, size and duration as text."""
    return loads.withColumns({
        "size_formatted": format_bytes(F.col("bytes_processed")),
        "duration_formatted": format_duration(F.col("duration")),
        "duration": F.round("duration", 2),
    })


def newest(history: DataFrame, limit: int = LIST) -> DataFrame:
    """The newest entries; Spark keeps the top ``limit`` per task and never sorts the rest."""
    return history.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def retain(history: DataFrame, keep: int) -> DataFrame:
    return newest(history, keep)


def summary(history: DataFrame) -> DataFrame:
    """One row: counts, totals, mean duration and the last import; zeros if there are none."""
    total = F.coalesce(F.sum("bytes_processed"), F.lit(0)).cast("long")
    return history.agg(
        F.count("*").alias("total_imports"),
        F.count_if(F.col("success")).alias("successful_imports"),
        F.count_if(~F.col("success")).alias("failed_imports"),
        F.coalesce(F.sum("queries_executed"), F.lit(0)).cast("long").alias("total_queries"),
        total.alias("total_bytes"), format_bytes(total).alias("total_bytes_formatted"),
        F.coalesce(F.round(F.avg("duration"), 2), F.lit(0.0)).alias("avg_duration"),
        F.max_by("id", F.struct("ts", "id")).alias("last_import"),
    )


def without(history: DataFrame, entry_id: str) -> DataFrame:
    return history.filter(F.col("id") != entry_id)


def _change(spark: SparkSession, path: str, step) -> None:
    """Change the parts of a history in one step, again if another writer was first."""

    def tables(now: Snapshot, write) -> dict[str, Table] | None:
        parts = step(now, now.tables[_NAME].parts, write)
        return None if parts is None else {_NAME: Table(tuple(parts), SCHEMA, "json")}

    change(spark, path, tables, start=lambda: _start(spark, path), fmt="json")


def append_history(loads: DataFrame, path: str, keep: int | None = None) -> None:
    """Add entries; with ``keep`` only the newest so many stay, by the same change.

    Entries are written once, however often the change starts anew. Beyond ``FOLD`` parts all are written as one.
    """
    spark = loads.sparkSession
    base = path.rstrip("/")
    part = write_part(loads.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA.fields]), base, "json")
    whole: list[bool] = []

    def step(now: Snapshot, parts, write):
        parts = (*parts, part)
        whole[:] = [keep is None and len(parts) <= FOLD]
        if whole[0]:
            return parts
        rows = now.read(spark, _NAME, parts).filter("id is not null")
        return [write(rows if keep is None else retain(rows, keep))]

    shown = False
    try:
        _change(spark, base, step)
        shown = whole[0]
    finally:
        if not shown:
            delete_path(spark, f"{base}/{part}")


def delete_entry(spark: SparkSession, path: str, entry_id: str) -> bool:
    """Remove an entry; says whether it was there. Only parts that hold it are written anew."""
    found: list[str] = []

    def step(now: Snapshot, parts, write):
        files = now.read(spark, _NAME, parts).select("id", F.col("_metadata.file_path").alias("file")) if parts else None
        names = [] if files is None else [r.file for r in files.filter(F.col("id") == entry_id).select("file").distinct().collect()]
        found[:] = [p for p in parts if any(f"/{p}/" in n or n.endswith(f"/{p}") for n in names)]
        if not found:
            return None
        return [*(p for p in parts if p not in found), write(without(now.read(spark, _NAME, tuple(found)), entry_id))]

    _change(spark, path, step)
    return bool(found)


def trim_history(spark: SparkSession, path: str, keep: int) -> None:
    """Keep the newest entries only."""
    _change(spark, path, lambda now, parts, write: [write(retain(now.read(spark, _NAME, parts).filter("id is not null"), keep))] if parts else None)


def clear_history(spark: SparkSession, path: str) -> None:
    _change(spark, path, lambda now, parts, write: [])
