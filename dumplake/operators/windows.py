"""Windows along a key that may hold a large share of all rows.

A key is cut into stretches of bounded length, each window stays inside one stretch, and
what crosses stretches is carried by one row per stretch or by a few repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Rows per stretch.
STRETCH = 1 << 17


def number_rows(df: DataFrame, bucket: str = "bucket", order: str = "pos", name: str = "row_no", by: str = "file") -> DataFrame:
    """Dense numbers along each key, from counts per bucket and numbers inside buckets.

    ``bucket`` must rise with ``order``. The only window along a whole key runs over one row
    per bucket.
    """
    along = Window.partitionBy(by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(by, bucket).agg(F.count("*").alias("_n"))
    base = counts.select(by, bucket, F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(by, bucket).orderBy(order))
    return df.withColumn("_in", inside).join(base, [by, bucket]).withColumn(
        name, F.col("_base") + F.col("_in")).drop("_in", "_base")


def along(df: DataFrame, by: str, order: str, back: int, columns: Callable[[WindowSpec], dict[str, Column]],
          stretch: int = STRETCH) -> DataFrame:
    """Add window columns that look at most ``back`` rows behind, with an integer ``order``.

    The last ``back`` rows of each stretch are repeated at the head of the next one.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(order) / stretch))
    numbered = number_rows(bucketed, "_bucket", order, "_no", by)
    home = F.floor((F.col("_no") - 1) / stretch)
    copies = F.when((F.col("_no") - 1) % stretch >= stretch - back, F.array(home, home + 1)).otherwise(F.array(home))
    spread = numbered.select(*df.columns, "_no", home.alias("_home"), F.explode(copies).alias("_stretch"))
    window = Window.partitionBy(by, "_stretch").orderBy("_no")
    return spread.withColumns(columns(window)).filter("_home = _stretch").drop("_no", "_home", "_stretch")


def running_max(df: DataFrame, by: str, order: str, columns: dict[str, Column], stretch: int = STRETCH) -> DataFrame:
    """Add the highest value so far of each column, along an integer ``order``."""
    df = df.withColumns({"_bucket": F.floor(F.col(order) / stretch), **{f"_v{i}": c for i, c in enumerate(columns.values())}})
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(by, "_bucket").agg(*[F.max(f"_v{i}").alias(f"_t{i}") for i in range(len(columns))])
    carry = tops.select(by, "_bucket", *[F.max(f"_t{i}").over(earlier).alias(f"_c{i}") for i in range(len(columns))])
    inside = Window.partitionBy(by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(carry, [by, "_bucket"])
    out = {name: F.greatest(F.max(f"_v{i}").over(inside), F.col(f"_c{i}")) for i, name in enumerate(columns)}
    return joined.withColumns(out).drop("_bucket", *[f"_v{i}" for i in range(len(columns))], *[f"_c{i}" for i in range(len(columns))])
