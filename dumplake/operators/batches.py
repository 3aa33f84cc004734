"""Runs of single-row INSERTs gathered into multi-row INSERTs, in statement order.

Windows never run along a whole file: a file is a sequence of buckets (see the scan), each
window stays inside one, and what crosses buckets is carried by one row per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_within, stage
from .windows import number_rows

# The two presets, (rows per batch, bytes per batch), and commit frequency.
PRESETS = {"conservative": (2000, 16_777_216), "aggressive": (5000, 33_554_432)}
COMMIT_EVERY = {"conservative": 1, "aggressive": 3}

# Fixed value: rows whose mean size sets the effective batch size.
SAMPLE_ROWS = 100

# Rows per task group of the exact byte-cap walk (keys and lengths only).
WALK_ROWS = 100_000


@dataclass(frozen=True)
class BatchOptions:
    batch_size: int = 2000
    max_bytes: int = 16_777_216

    @staticmethod
    def preset(name: str) -> "BatchOptions":
        return BatchOptions(*PRESETS[name])


def _key() -> Column:
    """The prefix of a single-row INSERT; null for any other statement."""
    return F.when(F.col("kind") == "insert_single", F.col("prefix"))


def bucket_runs(inserts: DataFrame) -> DataFrame:
    """One staged row per bucket: counts, longest row, first and last prefix, last opening.

    Reads the narrow columns only. Whether the first row of a bucket opens a run depends on
    the bucket before it; every other opening is local.
    """
    inside = Window.partitionBy("file", "bucket").orderBy("pos")
    narrow = inserts.select("file", "bucket", "pos", _key().alias("key"), "vbytes").withColumns({
        "at": F.row_number().over(inside), "before": F.lag("key").over(inside)})
    opens = (F.col("at") > 1) & F.col("key").isNotNull() & ~F.col("before").eqNullSafe(F.col("key"))
    single = F.col("key").isNotNull()
    return stage(narrow.groupBy("file", "bucket").agg(
        F.count("*").alias("n"), F.count("key").alias("n_single"),
        F.max(F.when(single, F.col("vbytes"))).alias("longest"),
        F.min_by("key", "at").alias("first_key"), F.max_by("key", "at").alias("last_key"),
        F.max(F.when(opens, F.col("at"))).alias("last_open"),
    ), "bucket-runs")


def _carry(buckets: DataFrame) -> DataFrame:
    """What each bucket needs from those before it."""
    along = Window.partitionBy("file").orderBy("bucket")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    df = buckets.withColumns({
        "base": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
        "singles_before": F.coalesce(F.sum("n_single").over(earlier), F.lit(0)),
        "continues": F.col("first_key").isNotNull() & F.coalesce(F.lag("last_key").over(along) == F.col("first_key"), F.lit(False)),
    })
    opening = F.when(F.col("first_key").isNotNull() & ~F.col("continues"), F.col("base") + 1)
    df = df.withColumn("latest", F.coalesce(F.col("base") + F.col("last_open"), opening))
    return df.withColumn("carried", F.last("latest", ignorenulls=True).over(earlier))


def sample_sizes(inserts: DataFrame, options: BatchOptions, buckets: DataFrame | None = None) -> DataFrame:
    """Per file, the effective batch size after each of the first 100 single-row INSERTs.

    Only buckets that can hold one of the first 100 are looked at.
    """
    carry = _carry(bucket_runs(inserts) if buckets is None else buckets)
    near = carry.filter((F.col("singles_before") < SAMPLE_ROWS) & (F.col("n_single") > 0)).select("file", "bucket", "singles_before")
    single = inserts.filter("kind = 'insert_single'").select("file", "bucket", "pos", "vbytes").join(near, ["file", "bucket"])
    inside = F.row_number().over(Window.partitionBy("file", "bucket").orderBy("pos"))
    # The limit on the plain row number is applied in every task before the shuffle.
    head = single.withColumn("at", inside).filter(F.col("at") <= SAMPLE_ROWS)
    first = head.withColumn("k", F.col("singles_before") + F.col("at")).filter(F.col("k") <= SAMPLE_ROWS)
    order = Window.partitionBy("file").orderBy("k")
    mean = F.round(F.sum("vbytes").over(order) / F.col("k")).cast("long")
    by_bytes = F.floor(F.lit(options.max_bytes) / (mean + 2))
    size = F.greatest(F.lit(1), F.least(F.lit(options.batch_size), by_bytes)).cast("int")
    return first.select("file", "pos", "k", mean.alias("avg_row_size"), size.alias("size"))


def file_sizes(inserts: DataFrame, options: BatchOptions, buckets: DataFrame) -> DataFrame:
    """One staged row per file: final effective size, and whether counting alone decides its batches."""
    final = sample_sizes(inserts, options, buckets).groupBy("file").agg(
        F.max_by("size", "k").alias("eff"), F.max_by("avg_row_size", "k").cast("int").alias("avg_row_size"),
        (F.min("size") == F.max("size")).alias("steady"),
        F.map_from_entries(F.collect_list(F.struct("pos", "size"))).alias("early"),
    )
    longest = buckets.groupBy("file").agg(F.max("longest").alias("longest"))
    fits = F.col("eff").cast("long") * (F.col("longest") + 2) <= options.max_bytes
    return stage(final.join(longest, "file").select(
        "file", "eff", "avg_row_size", (F.col("steady") & fits).alias("by_count"),
        F.when(~(F.col("steady") & fits), F.col("early")).alias("early"),
    ), "file-sizes")


def assign_runs(inserts: DataFrame, buckets: DataFrame | None = None, per_file: DataFrame | None = None) -> DataFrame:
    """Add ``row_no`` (dense along the file) and ``run_start``: the row number at which the
    stretch of single-row INSERTs with one prefix began (null for other statements).

    The rows are shuffled once, by bucket; what they need from elsewhere, ``per_file``
    columns included, is joined from one row per bucket. Each row keeps either its values
    or its text.
    """
    buckets = bucket_runs(inserts) if buckets is None else buckets
    carry = _carry(buckets).select("file", "bucket", "base", "continues", "carried")
    if per_file is not None:
        carry = carry.join(per_file.drop("avg_row_size", "early"), "file", "left")
    if per_file is None:
        carry, _ = broadcast_within(carry)
    single = F.col("kind") == "insert_single"
    df = inserts.withColumns({
        "_key": _key(), "vbytes": F.when(single, F.col("vbytes")),
        "values": F.when(single, F.col("values")), "text": F.when(~single, F.col("text")),
    }).join(carry, ["file", "bucket"])
    inside = Window.partitionBy("file", "bucket").orderBy("pos")
    df = df.withColumns({"_at": F.row_number().over(inside), "_before": F.lag("_key").over(inside)})
    df = df.withColumn("row_no", F.col("base") + F.col("_at"))
    first = F.when(F.col("continues"), F.col("carried")).otherwise(F.col("row_no"))
    start = F.when(F.col("_at") == 1, first).when(~F.col("_before").eqNullSafe(F.col("_key")), F.col("row_no"))
    start = F.when(F.col("_key").isNotNull(), start)
    run = F.last(start, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("run_start", F.when(F.col("_key").isNotNull(), run)).drop(
        "_key", "_at", "_before", "base", "continues", "carried")


def _walk_to(size: np.ndarray, vbytes: np.ndarray, steady_size: int, max_bytes: int) -> np.ndarray:
    """For each row, the row that opens the next batch if a batch opens here (len = beyond)."""
    n = len(vbytes)
    total = np.concatenate([[0], np.cumsum(vbytes + 2)])
    by_bytes = np.maximum(np.searchsorted(total, total[:-1] + max_bytes, side="right") - 1, np.arange(n) + 1)
    by_count = np.minimum(np.arange(n) + steady_size, n)
    unsteady = np.flatnonzero(size != steady_size)
    if len(unsteady):
        for i in range(min(n, int(unsteady[-1]) + 1)):
            ahead = np.arange(i + 1, min(n, i + int(size.max()) + 1))
            hit = np.flatnonzero(ahead - i >= size[ahead])
            by_count[i] = ahead[hit[0]] if len(hit) else n
    return np.minimum(by_bytes, by_count)


def _sized(rows: DataFrame, per_file: DataFrame) -> DataFrame:
    """Add the batch ``size`` in force at each row; the few that differ from the final one are joined by place, not carried by every row."""
    early, _ = broadcast_within(per_file.filter("early is not null").select("file", F.explode("early").alias("pos", "_size")))
    return rows.join(early, ["file", "pos"], "left").withColumn("size", F.coalesce("_size", "eff")).drop("_size")


_EXITS = "file string, run_start long, chunk long, exits array<int>"
_OPENS = "file string, run_start long, chunk long, entry int"
_STARTS = "file string, row_no long, batch_start long"


def _chunk_frame(pdf: pd.DataFrame, chunk: int, max_bytes: int):
    pdf = pdf.sort_values("row_no", ignore_index=True)
    own = int((pdf["home"] == chunk).sum())
    eff = int(pdf["eff"].iloc[0])
    to = _walk_to(pdf["size"].to_numpy(), pdf["vbytes"].to_numpy().astype(np.int64), eff, max_bytes)
    return pdf, own, to


def _byte_capped(rows: DataFrame, options: BatchOptions) -> DataFrame:
    """Exact batches where the byte cap or a moving batch size can decide.

    The next opening is a function of the row a batch opens at, so a run is cut in chunks:
    each chunk (with the first rows of the next one) tells for every row that can open its
    first batch where the next chunk's first batch opens; one row per chunk is then walked
    along the run, and every chunk is walked again from its true opening. Only keys and
    lengths are moved.
    """
    most = options.batch_size
    keyed = rows.select(
        "file", "run_start", "row_no", "vbytes", "eff", "size", "home", ((F.col("row_no") - F.col("run_start")) % WALK_ROWS).alias("_in"),
    )
    reach = F.when((F.col("home") > 0) & (F.col("_in") <= most), F.array(F.col("home"), F.col("home") - 1))
    spread = keyed.select(
        "file", "run_start", F.explode(F.coalesce(reach, F.array("home"))).alias("chunk"),
        "home", "row_no", "vbytes", "eff", "size",
    )
    groups = spread.groupBy("file", "run_start", "chunk")

    def exits(key, pdf):
        pdf, own, to = _chunk_frame(pdf, key[2], options.max_bytes)
        out = np.where(to >= own, to - own, -1)
        for i in range(own - 1, -1, -1):
            if out[i] < 0:
                out[i] = out[to[i]]
        return pd.DataFrame({"file": [key[0]], "run_start": [key[1]], "chunk": [key[2]],
                             "exits": [out[: min(own, most + 1)].astype(np.int32)]})

    def openings(frames):
        run, entry = None, 0
        for frame in frames:
            got = []
            for file, run_start, chunk, table in frame.itertuples(index=False):
                if (file, run_start) != run:
                    run, entry = (file, run_start), 0
                got.append((file, run_start, chunk, entry))
                entry = int(table[entry]) if entry < len(table) else 0
            yield pd.DataFrame(got, columns=["file", "run_start", "chunk", "entry"])

    def starts(key, pdf):
        entry = int(pdf["entry"].iloc[0])
        pdf, own, to = _chunk_frame(pdf, key[2], options.max_bytes)
        row_no = pdf["row_no"].to_numpy()
        opened, at = [], entry
        while at < own:
            opened.append(at)
            at = int(to[at])
        opened = np.array(opened, dtype=np.int64)
        last = min(len(pdf), at)
        owner = np.searchsorted(opened, np.arange(entry, last), side="right") - 1
        if not len(opened):
            last, owner = entry, owner[:0]
        return pd.DataFrame({"file": pd.Series([key[0]] * (last - entry), dtype=str), "row_no": row_no[entry:last],
                             "batch_start": row_no[opened[owner]]})

    tables = groups.applyInPandas(exits, _EXITS)
    in_order = tables.repartition("file", "run_start").sortWithinPartitions("file", "run_start", "chunk")
    opens = in_order.mapInPandas(openings, _OPENS)
    again = spread.join(opens, ["file", "run_start", "chunk"]).groupBy("file", "run_start", "chunk")
    return again.applyInPandas(starts, _STARTS)


def assign_batches(inserts: DataFrame, options: BatchOptions = BatchOptions(), buckets: DataFrame | None = None,
                   per_file: DataFrame | None = None) -> DataFrame:
    """Add ``batch_start``: the row number of the first statement of each row's output."""
    if options.batch_size <= 0:
        plain = inserts.withColumn("kind", F.lit("other"))
        return assign_runs(plain).withColumn("batch_start", F.col("row_no"))
    buckets = bucket_runs(inserts) if buckets is None else buckets
    per_file = file_sizes(inserts, options, buckets) if per_file is None else per_file
    df = assign_runs(inserts, buckets, per_file)
    by_count = F.expr("run_start + (row_no - run_start) div eff * eff")
    df = df.withColumn("batch_start", F.when(F.col("run_start").isNull(), F.col("row_no")).when(F.col("by_count"), by_count))
    if per_file.filter("not by_count").isEmpty():
        return df.drop("eff", "by_count")
    tight = _sized(df.filter("run_start is not null and not by_count").drop("text", "values", "prefix"), per_file)
    runs = tight.groupBy("file", "run_start").agg(
        F.count("*").alias("_n"), F.sum(F.col("vbytes") + 2).alias("_bytes"),
        F.min("size").alias("_least"),
    )
    one_batch = (F.col("_n") <= F.col("_least")) & (F.col("_bytes") <= options.max_bytes)
    # A run may be most of the table, so its rows meet what is known of it chunk by chunk.
    chunks = runs.filter(~one_batch).select(
        "file", "run_start", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / WALK_ROWS))).alias("home"))
    home = F.floor((F.col("row_no") - F.col("run_start")) / WALK_ROWS)
    long = tight.withColumn("home", home).join(chunks, ["file", "run_start", "home"])
    walked = _byte_capped(long, options)
    merged = df.join(walked.withColumnRenamed("batch_start", "_walked"), ["file", "row_no"], "left")
    return merged.withColumn("batch_start", F.coalesce("batch_start", "_walked", "run_start")).drop(
        "_walked", "eff", "by_count"
    )


def gather(batched: DataFrame) -> DataFrame:
    """The output statements in file order: batches joined, all others passed through.

    A group is one batch, so it is bounded by the row and byte caps.
    """
    single = F.col("run_start").isNotNull()
    row = F.struct("row_no", "values")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(single, row))), lambda r: r["values"]), ", ")
    grouped = batched.groupBy("file", "batch_start").agg(
        F.min("pos").alias("pos"), F.min("bucket").alias("bucket"), F.first("table").alias("table"),
        F.first("prefix").alias("prefix"), F.first("kind").alias("kind"),
        F.count("*").alias("n_rows"), F.sum("vbytes").alias("value_bytes"), joined.alias("_joined"),
        F.first(F.when(~single, F.col("text"))).alias("_text"),
    )
    is_batch = F.col("_text").isNull()
    text = F.when(is_batch, F.concat("prefix", F.lit(" "), "_joined", F.lit(";"))).otherwise(F.col("_text"))
    return grouped.select(
        "file", "batch_start", "pos", "bucket", "table", F.when(is_batch, F.col("prefix")).alias("prefix"), "kind",
        F.when(is_batch, F.col("n_rows")).alias("n_rows"), is_batch.alias("is_batch"), "value_bytes",
        text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"),
    )


def commit_groups(output: DataFrame, every: int = 1) -> DataFrame:
    """Number the output along each file and group every ``every`` statements to a commit."""
    numbered = number_rows(output, name="out_id")
    return numbered.withColumn("commit_group", F.floor((F.col("out_id") - 1) / every))


def batch_stats(output: DataFrame, per_file: DataFrame, options: BatchOptions = BatchOptions()) -> DataFrame:
    """Per file: rows and statements before and after, ratio, efficiency, mean row size.

    ``per_file`` comes from ``file_sizes``.
    """
    counts = output.groupBy("file").agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows_batched"), F.count_if("is_batch").alias("queries_executed"),
        F.coalesce(F.sum("value_bytes"), F.lit(0)).alias("bytes_processed"),
        F.count_if(F.col("kind") == "insert_extended").alias("extended_insert_count"),
    )
    sizes = per_file.select("file", "avg_row_size", "eff")
    rows, queries = F.col("rows_batched"), F.col("queries_executed")
    ratio = F.when(queries > 0, F.round(rows / queries, 1)).otherwise(0.0)
    gain = F.when(rows > 0, F.round(F.least(F.lit(0.99), 1 - queries / rows), 3)).otherwise(0.0)
    return counts.join(sizes, "file", "left").select(
        "file", F.lit(options.batch_size).alias("batch_size"), F.lit(options.max_bytes).cast("long").alias("max_batch_bytes"),
        "rows_batched", "queries_executed", "bytes_processed", ratio.alias("reduction_ratio"),
        gain.alias("batch_efficiency"), F.coalesce("avg_row_size", F.lit(0)).alias("avg_row_size"),
        F.coalesce("eff", F.lit(options.batch_size)).alias("effective_batch_size"), "extended_insert_count",
    )
