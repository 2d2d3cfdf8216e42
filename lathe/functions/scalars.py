"""Rounding to multiples, date ranges, range intersection."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times are rounded as distances from here.
EPOCH = "timestamp_ntz'2000-01-01 00:00:00'"


def xround(value: Column, multiple: float, up: bool | None = None) -> Column:
    """A number at a multiple: the next one up or down, or the nearest (a tie goes down)."""
    m = F.lit(float(multiple))
    low = F.floor(value / m) * m
    if up is None:
        return F.when(value - low > m / 2, low + m).otherwise(low)
    return F.when(value > low, low + m).otherwise(low) if up else low


def xround_time(value: Column, multiple: timedelta, up: bool | None = None) -> Column:
    """A timestamp at a multiple of a duration, counted from 2000-01-01."""
    step = F.lit(int(multiple / timedelta(microseconds=1)))
    micros = F.timestamp_diff("MICROSECOND", F.expr(EPOCH), value)
    low = (F.floor(micros / step) * step).cast("bigint")
    rest = micros - low
    chosen = F.when(rest * 2 > step, low + step).otherwise(low) if up is None else F.when(rest > 0, low + step).otherwise(low) if up else low
    return F.timestamp_add("MICROSECOND", chosen, F.expr(EPOCH))


def date_range(spark: SparkSession, start: datetime, stop: datetime, step: timedelta) -> DataFrame:
    """start, start + step, … up to but without stop; step may be negative."""
    n = max((stop - start) // step, 0)
    micros = step // timedelta(microseconds=1)
    return spark.range(n).select(F.timestamp_add("MICROSECOND", F.col("id") * F.lit(micros), F.lit(start).cast("timestamp_ntz")).alias("value"))


def range_intercept(a: range, b: range) -> range:
    """The numbers that two ascending ranges share, as a range."""
    if a.step < 0:
        a = a[::-1]
    if b.step < 0:
        b = b[::-1]
    if not a or not b:
        return range(0)
    gcd = math.gcd(a.step, b.step)
    if (b.start - a.start) % gcd:
        return range(0)
    step = a.step * b.step // gcd
    # the first common number: a.start + i * a.step hits b's residue
    i = (b.start - a.start) // gcd * pow(a.step // gcd, -1, b.step // gcd) % (b.step // gcd) if b.step // gcd > 1 else 0
    first = a.start + i * a.step
    low, high = max(a.start, b.start), min(a[-1], b[-1]) + 1
    first += max(math.ceil((low - first) / step), 0) * step
    return range(first, high, step) if first < high else range(0)
