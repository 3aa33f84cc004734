"""Slices of N lines that never end inside a string."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lines per task group; only line numbers and one flag per line are moved.
CHUNK_LINES = 500_000


def _walk(ok: np.ndarray, need: int, length: int):
    """Slice ends in a chunk when ``need`` lines are still missing; and what is then missing."""
    places = np.flatnonzero(ok)
    ends, at = [], max(need - 1, 0)
    while True:
        k = np.searchsorted(places, at)
        if k == len(places):
            break
        ends.append(int(places[k]))
        at = ends[-1] + length
    done = ends[-1] + 1 if ends else 0
    return ends, max(0, (length if ends else need) - (len(ok) - done))


def line_sessions(lines: DataFrame, length: int, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Number the slices: each takes ``length`` lines, more while the last ends in a string.

    Where a slice starts depends on all before it, but a chunk of lines only needs to know
    how many lines the open slice still lacks. Each chunk tells, for every such number, how
    many slices end in it and what is lacking after it; these tables are walked along each
    file, one row per chunk, and the chunks are then cut from their true start.
    """
    keyed = lines.select(
        "file", "line_no", (F.col("end_state") == "").alias("ok"),
        F.floor((F.col("line_no") - 1) / chunk_lines).alias("chunk"),
    )
    groups = keyed.groupBy("file", "chunk")

    def tables(key, pdf):
        ok = pdf.sort_values("line_no")["ok"].to_numpy()
        n, places = len(ok), np.flatnonzero(ok)
        follow = np.searchsorted(places, np.arange(n))
        lack, count = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        lack[n] = length
        for start in range(n - 1, -1, -1):
            at = start + length - 1
            k = follow[at] if at < n else len(places)
            if k == len(places):
                lack[start] = max(0, length - (n - start))
            else:
                end = places[k] + 1
                lack[start], count[start] = lack[end], count[end] + 1
        out_lack, out_count = [], []
        for need in range(length + 1):
            at = max(need - 1, 0)
            k = follow[at] if at < n else len(places)
            if k == len(places):
                out_lack.append(max(0, need - n))
                out_count.append(0)
            else:
                end = places[k] + 1
                out_lack.append(int(lack[end]))
                out_count.append(int(count[end]) + 1)
        return pd.DataFrame({"file": [key[0]], "chunk": [key[1]], "lack": [out_lack], "ended": [out_count]})

    def along(frames):
        file, need, done = None, length, 0
        for frame in frames:
            out = []
            for name, chunk, lack, ended in frame.itertuples(index=False):
                if name != file:
                    file, need, done = name, length, 0
                out.append((name, chunk, need, done))
                need, done = int(lack[need]), done + int(ended[need])
            yield pd.DataFrame(out, columns=["file", "chunk", "need", "done"])

    def cut(key, pdf):
        pdf = pdf.sort_values("line_no")
        ends, _ = _walk(pdf["ok"].to_numpy(), int(pdf["need"].iloc[0]), length)
        number = int(pdf["done"].iloc[0]) + np.searchsorted(np.array(ends, dtype=np.int64), np.arange(len(pdf))) + 1
        grouped = pdf.assign(session=number).groupby("session")["line_no"].agg(["min", "max"]).reset_index()
        return pd.DataFrame({"file": key[0], "session": grouped["session"], "first_line": grouped["min"], "last_line": grouped["max"]})

    summary = groups.applyInPandas(tables, "file string, chunk long, lack array<int>, ended array<int>")
    starts = summary.repartition("file").sortWithinPartitions("file", "chunk").mapInPandas(
        along, "file string, chunk long, need int, done long")
    pieces = keyed.join(starts, ["file", "chunk"]).groupBy("file", "chunk").applyInPandas(
        cut, "file string, session long, first_line long, last_line long")
    merged = pieces.groupBy("file", "session").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))
    return merged.withColumn("n_lines", F.col("last_line") - F.col("first_line") + 1)
