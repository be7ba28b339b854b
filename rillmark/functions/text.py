"""Scalar functions on text and hashes, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """Lower case without white space at either end (tabs and line ends too)."""
    return F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")


def hash32(value: Column, seed: Column | int | str = "") -> Column:
    """0 to 2**32 - 1 from the first 8 hex digits of md5; the same in any SQL that has md5."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), value.cast("string"))), 1, 8), 16, 10).cast("long")


def percent(part: Column, total: Column) -> Column:
    """Like 12.5%; 0.0% of nothing."""
    return F.when(total == 0, "0.0%").otherwise(F.format_string("%.1f%%", part / total * 100))
