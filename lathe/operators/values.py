"""Replacing values, merging columns, counting and describing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.text import kind_of
from lathe.operators import position
from lathe.operators.naming import require
from lathe.operators.predicates import compare, literal


def replace(df: DataFrame, mapping: Mapping, columns: Sequence[str] | None = None) -> DataFrame:
    """Values by their replacement; None stands for null on either side.  A column keeps its type, so entries of another kind don't concern it."""
    columns = [c for c in df.columns if not c.startswith("__")] if columns is None else list(columns)
    require(df.columns, columns)
    out = {}
    for c in columns:
        kind, col, new = df.schema[c].dataType, F.col(f"`{c}`"), None
        for old, value in mapping.items():
            a, b = literal(old), literal(value)
            if {kind_of(a[1]), kind_of(b[1])} - {kind_of(kind), "null"}:
                continue
            here, there = compare((col, kind), "==", a), b[0].cast(kind)
            new = F.when(here, there) if new is None else new.when(here, there)
        if new is not None:
            out[c] = new.otherwise(col)
    return df.withColumns(out) if out else df


def merge(df: DataFrame, left: str, right: str, new: str, criteria: Column) -> DataFrame:
    """One column for two: left where the criteria hold, else right.  If ``new`` names one of them it stands there, else last."""
    require(df.columns, [left, right])
    value = F.when(F.coalesce(criteria, F.lit(False)), F.col(f"`{left}`")).otherwise(F.col(f"`{right}`")).alias(new)
    if new in df.columns and new not in (left, right):
        raise ValueError(f"{new!r} is a column already")
    kept = [value if c == new else F.col(f"`{c}`") for c in df.columns if c == new or c not in (left, right)]
    return df.select(*kept, *([] if new in (left, right) else [value]))


#: Distinct values up to which statistics lists them with their counts.
HISTOGRAM = 100_000


def _quartiles(df: DataFrame, n: int) -> dict[str, float]:
    """Lower quartile, median and upper quartile: at a whole rank k/4*n between two values, else the value that covers it."""
    wanted: dict[str, tuple[int, int, int]] = {}
    for name, k in (("iqr_low", 1), ("median", 2), ("iqr_high", 3)):
        low, part = divmod(k * n, 4)
        wanted[name] = (low, low + 1, (k * (n - 1)) % 4) if not part and low < n else (low + 1, low + 1, 0)
    ranks = sorted({min(max(r, 1), n) for a, b, _ in wanted.values() for r in (a, b)})
    # distinct values with the number of rows before them, in ranges: no task holds all of them
    counts = position.with_ordinals(df.groupBy("v").agg(F.count(F.lit(1)).alias("n")), ["v"], weight=F.col("n"))
    before = F.col(position.ORDINAL)
    found = counts.where(F.exists(F.array(*[F.lit(r) for r in ranks]), lambda r: (before < r) & (r <= before + F.col("n")))).select("v", before.alias("before"), "n").collect()  # one row per rank
    at = {r: next(x["v"] for x in found if x["before"] < r <= x["before"] + x["n"]) for r in ranks}
    return {name: (at[max(a, 1)] * (4 - d) + at[min(b, n)] * d) / 4 for name, (a, b, d) in wanted.items()}


def statistics(df: DataFrame, column: str) -> dict:
    """min, max, mean, median, stdev, mode, distinct, iqr_low, iqr_high, iqr, sum, summary type and histogram of a column's values.

    The histogram has two lists, of values in order (null last) and of their counts; a column with more than
    HISTOGRAM of them has None there, and aggregate.histogram has them all.  Texts are described by their lengths, times and dates as such; a mode that ties is
    the smallest; a column without rows has no statistics.
    """
    kind = df.schema[column].dataType
    col = F.col(f"`{column}`")
    total = df.agg(F.count(F.lit(1)).alias("n"), F.count(col).alias("v"), F.countDistinct(col).alias("d"), F.max(col.isNull().cast("int")).alias("z")).first()
    if not total["n"]:
        return {}
    names = ("min", "max", "mean", "median", "stdev", "mode", "iqr_low", "iqr_high", "iqr", "sum")
    distinct = total["d"] + (total["z"] or 0)
    seen = [[], []] if distinct <= HISTOGRAM else None
    if seen:
        rows = df.groupBy(col.alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("v").asc_nulls_last()).collect()
        seen = [[r["v"] for r in rows], [r["n"] for r in rows]]
    if not total["v"]:
        return dict.fromkeys(names, "n/a") | {"distinct": distinct, "summary type": "NoneType", "histogram": seen}
    text, stamp, day = isinstance(kind, T.StringType), isinstance(kind, (T.TimestampType, T.TimestampNTZType)), isinstance(kind, T.DateType)
    if text:
        number = F.length(col)
    elif stamp:
        number = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), col.cast("timestamp_ntz")) / 1e6
    elif day:
        number = F.datediff(col, F.expr("date'1970-01-01'"))
    elif isinstance(kind, T.TimeType):
        number = F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)
    elif isinstance(kind, T.BooleanType):
        number = col.cast("int")
    else:
        number = col
    values = df.where(col.isNotNull()).select(number.alias("v"))
    row = values.agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("stdev"), F.expr("mode() WITHIN GROUP (ORDER BY v)").alias("mode"), F.sum("v").alias("sum")).first().asDict()
    row |= _quartiles(values, total["v"])
    row["iqr"] = row["iqr_high"] - row["iqr_low"]
    if isinstance(kind, T.BooleanType):
        for k in ("min", "max", "median", "mode"):
            row[k] = bool(row[k]) if row[k] in (0, 1) else row[k]
    if text:
        row = {k: f"{v} characters" for k, v in row.items()}
    if stamp or day:
        from datetime import date, datetime

        point = (lambda v: datetime(1970, 1, 1) + timedelta(seconds=v)) if stamp else (lambda v: date(1970, 1, 1) + timedelta(days=int(v)))
        row |= {k: point(row[k]) for k in ("min", "max", "mean", "median", "mode", "iqr_low", "iqr_high")}
        unit = timedelta(seconds=1) if stamp else timedelta(days=1)
        row |= {"stdev": f"{row['stdev'] * unit / timedelta(days=1)} days", "iqr": f"{row['iqr'] * unit / timedelta(days=1)} days", "sum": f"{row['sum'] * unit / timedelta(days=1)} days"}
    from lathe.operators.cast import type_name

    return {k: row[k] for k in names} | {"distinct": distinct, "summary type": type_name(kind), "histogram": seen}


def count_value(df: DataFrame, column: str, value: object) -> int:
    """Rows in which a column has a value; None counts nulls."""
    return df.where(compare((F.col(f"`{column}`"), df.schema[column].dataType), "==", literal(value))).count()


def types_of(df: DataFrame) -> dict[str, dict[str, int]]:
    """By column how many values of its type it has, and how many nulls."""
    from lathe.operators.cast import type_name

    visible = [c for c in df.columns if not c.startswith("__")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(visible)]).first()
    out = {}
    for i, c in enumerate(visible):
        n = row[f"c{i}"]
        out[c] = {k: v for k, v in ((type_name(df.schema[c].dataType), n), ("NoneType", row["n"] - n)) if v}
    return out


def predominant_types(df: DataFrame) -> dict[str, str]:
    """By column the type that most of its values have, None left out."""
    return {c: next((k for k in found if k != "NoneType"), "NoneType") for c, found in types_of(df).items()}
