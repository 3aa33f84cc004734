import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dumplake.functions.format import UNITS, format_bytes, format_clock, format_duration
from dumplake.operators import progress as p
from dumplake.operators import windows


def log_of(spark, rows):
    names = "import_id long, run_id long, seq long, ts timestamp_ntz, file_size long, lines long, queries long, bytes long, memory_pct int, finished boolean, is_gzip boolean"
    return spark.createDataFrame(rows, names)


def test_estimates_freeze_at_five_percent(spark):
    import datetime as d
    t = d.datetime(2024, 1, 1)
    rows = [(1, 0, 0, t, 1000, 1, 1, 20, 10, False, False), (1, 0, 1, t, 1000, 6, 2, 60, 10, False, False), (1, 0, 2, t, 1000, 50, 3, 500, 10, False, False),
            (1, 1, 3, t, 1000, 90, 4, 1000, 10, True, False), (2, 0, 0, t, 1000, 6, 2, 60, 10, False, True)]
    got = {(r.import_id, r.seq): r for r in p.progress(log_of(spark, rows)).collect()}
    assert [got[1, i].lines_total for i in range(4)] == [50, 100, 100, 90]
    assert [got[1, i].estimates_frozen for i in range(4)] == [False, True, True, True]
    assert got[1, 2].lines_this == 49 and got[1, 3].lines_this == 0
    assert (got[1, 2].pct_done, got[1, 2].pct_togo, got[1, 3].pct_done) == (50.0, 50.0, 100.0)
    gz = got[2, 0]
    assert (gz.lines_total, gz.pct_done, gz.bytes_togo, gz.bytes_total) == (None, None, None, None)


@pytest.mark.parametrize("stretch", [4, 7, 1000])
def test_windows_in_stretches_match_plain_windows(spark, stretch):
    rng = random.Random(stretch)
    rows = sorted({(rng.choice([1, 1, 1, 2]), rng.randint(0, 300)) for _ in range(200)})
    df = spark.createDataFrame([(a, s, rng.random()) for a, s in rows], "import_id long, seq long, v double")
    plain = Window.partitionBy("import_id").orderBy("seq")
    want = df.withColumns({"m": F.avg("v").over(plain.rowsBetween(-3, 0)), "top": F.max("v").over(plain), "no": F.row_number().over(plain)})
    got = windows.along(df, "import_id", "seq", 3, lambda w: {"m": F.avg("v").over(w.rowsBetween(-3, 0))}, stretch)
    got = windows.running_max(got, "import_id", "seq", {"top": F.col("v")}, stretch)
    got = windows.number_rows(got.withColumn("b", F.floor(F.col("seq") / stretch)), "b", "seq", "no", "import_id").drop("b")
    key = ["import_id", "seq"]
    a, b = (x.orderBy(*key).collect() for x in (want, got.select(want.columns)))
    assert [(r.import_id, r.seq, round(r.m, 9), r.top, r.no) for r in a] == [(r.import_id, r.seq, round(r.m, 9), r.top, r.no) for r in b]


def test_signals(spark):
    def run(speeds, memory):
        df = spark.createDataFrame([(1, i, float(s), m) for i, (s, m) in enumerate(zip(speeds, memory))], "import_id long, seq long, speed_lps double, memory_pct int")
        return p.adaptation(df).orderBy("seq").collect()

    assert [r.reason for r in run([10, 10, 10], [5] * 3)] == ["collecting_samples"] * 2 + ["ram_underutilized"]
    assert run([10, 90, 10, 90], [80] * 4)[-1].reason == "memory_pressure"
    last = run([100, 100, 50, 50], [50] * 4)[-1]
    assert (last.reason, last.action, last.trend) == ("speed_degradation", "decrease", "decreasing")
    assert last.speed_variance == pytest.approx(statistics.variance([100, 100, 50, 50]))
    assert run([10, 10, 20, 20], [50] * 4)[-1].trend == "increasing"


def test_eta_and_monotone(spark):
    df = spark.createDataFrame([(1, i, float(10 * i), 10.0 * i) for i in range(5)], "import_id long, seq long, pct_done double, elapsed double")
    rows = p.eta(df).orderBy("seq").collect()
    assert [r.eta_seconds for r in rows] == [None, 90.0, 85.0, 80.0, 75.0]
    shown = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 3, None), (1, 4, 9)], "import_id long, seq long, x long")
    assert [r.shown_x for r in p.monotone(shown, "x").orderBy("seq").collect()] == [5, 5, 5, 9]


@pytest.mark.parametrize("size,text", [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (1048576, "1 MB"), (5 * 1024**4, "5120 GB")])
def test_sizes(spark, size, text):
    assert spark.range(1).select(format_bytes(F.lit(size))).first()[0] == text


def test_sizes_one_digit_to_terabytes(spark):
    row = spark.range(1).select(format_bytes(F.lit(5 * 1024**4), 1, UNITS).alias("a"), format_bytes(F.lit(1590), 1, UNITS).alias("b")).first()
    assert tuple(row) == ("5 TB", "1.6 KB")


@pytest.mark.parametrize("seconds,text", [(0.04, "0s"), (12.34, "12.3s"), (65, "1m 5s"), (3725, "1h 2m")])
def test_durations(spark, seconds, text):
    assert spark.range(1).select(format_duration(F.lit(seconds))).first()[0] == text


def test_clocks(spark):
    assert tuple(spark.range(1).select(format_clock(F.lit(3725.9)), format_clock(F.lit(3725), True)).first()) == ("62:05", "01:02:05")


def test_memory_rule(spark):
    got = [spark.range(1).select(p.memory_pressure(F.lit(u), F.lit(100)).alias("m")).first().m for u in (90, 60, 20)]
    assert [(m.action, m.factor, m.percentage) for m in got] == [("decrease", 0.8, 90), (None, None, 60), ("increase", 1.2, 20)]
