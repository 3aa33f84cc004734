"""The catalogue of dump files: names, sizes, types; new arrivals; clean names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions taken, and the labels and compression they stand for.
EXTENSIONS = ("sql", "gz", "bz2", "csv")
TYPES = {"sql": "SQL", "gz": "GZip", "bz2": "BZ2", "csv": "CSV"}
COMPRESSION = {"gz": "gzip", "gzip": "gzip", "bz2": "bz2"}

# Fixed value: files above this size count as large.
LARGE_BYTES = 104_857_600


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def _mapped(key: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def describe_files(files: DataFrame) -> DataFrame:
    """Add name, ext, type, compression and is_large to rows of (path, size, ...)."""
    name = F.substring_index("path", "/", -1)
    ext = extension(name)
    return files.withColumns({
        "name": name, "ext": ext, "type": _mapped(ext, TYPES, "Unknown"),
        "compression": _mapped(ext, COMPRESSION, "none"), "is_large": F.col("size") > LARGE_BYTES,
    })


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Dump files under ``path`` with their metadata; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return allowed_files(describe_files(files))


def allowed_files(files: DataFrame) -> DataFrame:
    """Files with an allowed extension, by name without regard to case."""
    return files.filter(F.col("ext").isin(*EXTENSIONS)).orderBy(F.lower("name"), "name")


def new_arrivals(files: DataFrame, known: DataFrame, on: str = "name") -> DataFrame:
    """Files of a listing that a former listing did not have."""
    return files.join(known.select(on), on, "left_anti")


def clean_name(name: Column, default: str = "upload.sql") -> Column:
    """A file name safe to store: no path, letters, digits, ``-_.`` only, at most 255 bytes."""
    base = F.regexp_extract(F.regexp_replace(name, r"/+$", ""), r"([^/]*)$", 1)
    text = F.regexp_replace(F.regexp_replace(base, " ", "_"), r"[^\p{L}\p{N}\-_.]", "")
    text = F.regexp_replace(text, r"\.{2,}", ".")
    ext = extension(text)
    room = F.greatest(F.lit(1), 254 - F.octet_length(ext))
    stem = F.regexp_extract(text, r"(?s)^(.*)\.", 1)
    stem_bytes = F.substring(stem.cast("binary"), F.lit(1), room).cast("string")
    short_ext = F.substring(ext.cast("binary"), F.lit(1), F.lit(253)).cast("string")
    cut = F.when(ext != "", F.concat(stem_bytes, F.lit("."), short_ext)).otherwise(
        F.substring(text.cast("binary"), F.lit(1), F.lit(255)).cast("string"))
    fitted = F.when(F.octet_length(text) > 255, cut).otherwise(text)
    return F.when(fitted.isin("", "0", "."), default).otherwise(fitted)
