"""Sizes and durations as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names.
UNITS = ("B", "KB", "MB", "GB", "TB")


def _plain(number: Column) -> Column:
    """A rounded number without trailing zeros."""
    text = F.regexp_replace(F.format_string("%.2f", number), r"0+$", "")
    return F.regexp_replace(text, r"\.$", "")


def format_bytes(size: Column, digits: int = 2, units: tuple[str, ...] = UNITS[:4]) -> Column:
    """``1.5 MB``; history uses two digits up to GB, the optimiser summary one digit up to TB."""
    size = F.greatest(size.cast("double"), F.lit(0.0))
    out = F.concat(_plain(F.round(size, digits)), F.lit(f" {units[0]}"))
    for k in range(1, len(units)):
        text = F.concat(_plain(F.round(size / float(1024**k), digits)), F.lit(f" {units[k]}"))
        out = F.when(size >= float(1024**k), text).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """``12.3s``, ``4m 5s`` or ``1h 2m``."""
    s = seconds.cast("double")
    whole = F.floor(s).cast("long")
    minutes = F.floor(s / 60).cast("long")
    return (
        F.when(s < 60, F.concat(_plain(F.round(s, 1)), F.lit("s")))
        .when(minutes < 60, F.format_string("%dm %ds", minutes, whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(minutes / 60).cast("long"), minutes % 60))
    )


def format_clock(seconds: Column, hours: bool = False) -> Column:
    """``MM:SS``, or ``HH:MM:SS``."""
    whole = F.floor(seconds).cast("long")
    if hours:
        return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def number_format(number: Column, decimals: int = 0) -> Column:
    """``1,234,567.9``: rounded half up, thousands by commas."""
    return F.format_number(F.round(number, decimals), decimals)
