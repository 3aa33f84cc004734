"""Progress, speed and adaptation signals over a log of load slices.

A log row is (import_id, run_id, seq, ts, file_size, lines, queries, bytes, memory_pct,
finished, is_gzip), with an integer ``seq`` that is unique within an import. An import may
be most of the log, so windows run in stretches of it (see ``windows``), and what is one
value per import or run is aggregated and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import along, running_max

# Samples kept, and the thresholds of the signals.
HISTORY = 5
FREEZE_PCT = 5.0


def _pct(part: Column, whole: Column) -> Column:
    """Percent to two digits, rounded on the exact quotient: 0.56895 gives 56.9, not 56.89."""
    return F.least(F.lit(100.0), F.round(part * 10000 / whole) / 100)


def progress(log: DataFrame) -> DataFrame:
    """This run, done, to go and total for lines, queries and bytes, with frozen estimates.

    Totals are estimated from the bytes per line so far and frozen at the first row with
    5 % done; a finished row has exact totals; a gzip file has no sizes.
    """
    size, bytes_, lines, queries = F.col("file_size"), F.col("bytes"), F.col("lines"), F.col("queries")
    sized = ~F.col("is_gzip") & (size > 0)
    guess = sized & (bytes_ > 0) & ~F.col("finished")
    line_est = F.when(guess, F.ceil(size / (bytes_ / F.greatest(F.lit(1), lines)))).cast("long")
    query_est = F.when(guess & (queries > 0), F.ceil(size / (bytes_ / queries))).cast("long")
    freezing = guess & (bytes_ / size * 100 >= FREEZE_PCT)

    rows = log.withColumns({"_sized": sized, "_le": line_est, "_qe": query_est})
    frozen = rows.filter(freezing).groupBy("import_id").agg(
        F.min("seq").alias("_since"), F.min_by("_le", "seq").alias("_lf"), F.min_by("_qe", "seq").alias("_qf"))
    starts = log.groupBy("import_id", "run_id").agg(
        *[F.min_by(c, "seq").alias(f"_{c}_0") for c in ("lines", "queries", "bytes")])
    rows = rows.join(starts, ["import_id", "run_id"]).join(frozen, "import_id", "left")
    held = F.col("_since") <= F.col("seq")
    df = rows.select(
        "import_id", "run_id", "seq", "finished", "is_gzip", "file_size", "lines", "queries", "bytes",
        *[(F.col(c) - F.col(f"_{c}_0")).alias(f"{c}_this") for c in ("lines", "queries", "bytes")],
        "_sized", "_le", "_qe", F.when(held, F.col("_lf")).alias("_lf"), F.when(held, F.col("_qf")).alias("_qf"),
    )
    done = F.col("finished")
    lines_total = F.when(done, lines).when(F.col("_le").isNotNull(), F.coalesce("_lf", "_le"))
    queries_total = F.when(done, queries).when(F.col("_le").isNotNull(), F.coalesce("_qf", "_qe"))
    bytes_total = F.when(done, bytes_).when(~F.col("is_gzip"), size)
    bytes_togo = F.when(done, 0).when(~F.col("is_gzip"), F.greatest(F.lit(0), size - bytes_))
    pct_done = F.when(F.col("_sized"), F.when(done, 100.0).otherwise(_pct(bytes_, size)))
    df = df.withColumns({
        "lines_total": lines_total, "queries_total": queries_total, "bytes_total": bytes_total,
        "bytes_togo": bytes_togo, "pct_done": pct_done,
    })
    scaled = {}
    for unit, factor in (("kb", 1024), ("mb", 1048576)):
        for name, source in (("this", "bytes_this"), ("done", "bytes"), ("togo", "bytes_togo"), ("total", "bytes_total")):
            scaled[f"{unit}_{name}"] = F.round(F.col(source) / factor, 2)
    return df.select(
        "import_id", "run_id", "seq", "finished", "is_gzip",
        "lines_this", F.col("lines").alias("lines_done"), F.greatest(F.lit(0), F.col("lines_total") - F.col("lines")).alias("lines_togo"), "lines_total",
        "queries_this", F.col("queries").alias("queries_done"), F.greatest(F.lit(0), F.col("queries_total") - F.col("queries")).alias("queries_togo"), "queries_total",
        "bytes_this", F.col("bytes").alias("bytes_done"), "bytes_togo", "bytes_total",
        *[c.alias(n) for n, c in scaled.items()],
        F.when(F.col("_sized"), _pct(F.col("bytes_this"), size)).alias("pct_this"), "pct_done",
        F.when(F.col("_sized"), F.when(done, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(100 - F.col("pct_done"), 2)))).alias("pct_togo"),
        F.col("_lf").isNotNull().alias("estimates_frozen"),
    ).withColumns({
        "lines_togo": F.when(F.col("lines_total").isNotNull(), F.col("lines_togo")),
        "queries_togo": F.when(F.col("queries_total").isNotNull(), F.col("queries_togo")),
    })


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def with_speed(log: DataFrame) -> DataFrame:
    """Lines per second of each slice, and over the whole import so far; 0 without time."""
    log = log.withColumn("_time", _seconds(F.col("ts")))
    starts = log.groupBy("import_id").agg(F.min_by("lines", "seq").alias("_l0"), F.min_by("_time", "seq").alias("_t0"))
    timed = along(log, "import_id", "seq", 1, lambda w: {
        "_dl": F.col("lines") - F.lag("lines").over(w), "_dt": F.col("_time") - F.lag("_time").over(w)})
    all_time = F.col("_time") - F.col("_t0")
    return timed.join(starts, "import_id").withColumns({
        "speed_lps": F.when(F.col("_dt") > 0, F.col("_dl") / F.col("_dt")).otherwise(0.0),
        "speed_overall": F.when(all_time > 0, (F.col("lines") - F.col("_l0")) / all_time).otherwise(0.0),
    }).drop("_time", "_l0", "_t0", "_dl", "_dt")


def adaptation(samples: DataFrame, speed: str = "speed_lps", memory: str = "memory_pct") -> DataFrame:
    """Rolling speed statistics of the last five samples, the signal they give, and the trend."""
    s = F.col(speed)

    def rolling(order):
        frame = order.rowsBetween(-(HISTORY - 1), 0)
        n = F.count(s).over(frame)
        first, second = F.first(s).over(frame), F.nth_value(s, 2).over(frame)
        return {
            "n_samples": n, "avg_speed": F.avg(s).over(frame), "avg_memory": F.avg(memory).over(frame),
            "speed_variance": F.when(n >= 2, F.var_samp(s).over(frame)).otherwise(0.0),
            "_recent": (s + F.lag(s, 1).over(order)) / 2, "_earlier": (first + second) / 2,
        }

    df = along(samples, "import_id", "seq", HISTORY - 1, rolling)
    n, mean, mem = F.col("n_samples"), F.col("avg_speed"), F.col("avg_memory")
    rising = (mem < 30) & (F.col("speed_variance") < 0.1 * mean * mean)
    slower = (n >= 4) & (F.col("_earlier") > 0) & (F.col("_recent") < F.col("_earlier") * 0.7)
    reason = (
        F.when(n < 3, "collecting_samples").when(rising, "ram_underutilized").when(mem > 70, "memory_pressure")
        .when(slower, "speed_degradation").otherwise("optimal")
    )
    ratio = F.col("_recent") / F.col("_earlier")
    trend = (
        F.when(n < 3, "calculating").when(F.col("_earlier") == 0, "stable")
        .when(ratio > 1.1, "increasing").when(ratio < 0.9, "decreasing").otherwise("stable")
    )
    df = df.withColumns({"reason": reason, "trend": trend})
    action = F.when(F.col("reason") == "ram_underutilized", "increase").when(
        F.col("reason").isin("memory_pressure", "speed_degradation"), "decrease").otherwise("stable")
    return df.withColumn("action", action).drop("_recent", "_earlier")


def eta(progress_rows: DataFrame, elapsed: str = "elapsed", pct: str = "pct_done") -> DataFrame:
    """Seconds left at the mean rate so far, averaged over the last five estimates.

    Rows without an estimate (nothing done yet, or no sizes) have none and add none.
    """
    p, t = F.col(pct), F.col(elapsed)
    known = (p > 0) & (t > 0)
    usable = progress_rows.filter(known).withColumn("eta_now", (100 - p) / (p / t))
    smooth = along(usable, "import_id", "seq", HISTORY - 1, lambda w: {
        "eta_seconds": F.avg("eta_now").over(w.rowsBetween(-(HISTORY - 1), 0))})
    rest = progress_rows.filter(~F.coalesce(known, F.lit(False)))
    return smooth.unionByName(rest, allowMissingColumns=True)


def monotone(df: DataFrame, *columns: str) -> DataFrame:
    """Shown values: never below an earlier value of the same import."""
    return running_max(df, "import_id", "seq", {f"shown_{c}": F.coalesce(F.col(c), F.lit(0)) for c in columns})


def memory_pressure(usage: Column, limit: Column) -> Column:
    """Struct of ratio, percentage, action and factor for a memory reading."""
    ratio = F.when(limit > 0, usage / limit).otherwise(0.0)
    action = F.when(ratio > 0.8, "decrease").when(ratio < 0.5, "increase")
    factor = F.when(ratio > 0.8, 0.8).when(ratio < 0.5, 1.2)
    reason = F.when(ratio > 0.8, "memory_high").when(ratio < 0.5, "memory_low")
    return F.struct(ratio.alias("ratio"), F.floor(ratio * 100).cast("int").alias("percentage"),
                    action.alias("action"), factor.alias("factor"), reason.alias("reason"))
