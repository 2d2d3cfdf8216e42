"""Operators on streams.

Filters, typed selection, replacement, unpivot and joins with a static table need no row
order and no state, so they run on a streaming DataFrame as they are.  Operators that
need row order are refused.  Windowed aggregation is an addition of Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.operators import aggregate, cast, filters, joins, values

STATELESS = {
    "filter": lambda df, *a, **k: filters.split(df, filters.filter_predicate(df, *a, **k)),
    "column_select": lambda df, columns: cast.column_select(df, columns),
    "replace": lambda df, *a, **k: values.replace(df, *a, **k),
    "unpivot": lambda df, *a, **k: aggregate.unpivot(df, *a, **k),
    "merge": lambda df, *a, **k: values.merge(df, *a, **k),
    "enrich": lambda df, static, keys: joins.join(df, static, "left", keys, keys, merge_keys=True),
}


def apply(stream: DataFrame, operator: str, *args: object, **options: object):
    """A stateless operator on a stream; ValueError for those that need row order."""
    if operator not in STATELESS:
        raise ValueError(f"{operator!r} needs row order or all rows; on streams there are {sorted(STATELESS)}")
    return STATELESS[operator](stream, *args, **options)


def windowed(stream: DataFrame, time: str, window: str, late: str, keys: Sequence[str], functions: Mapping[str, Column], slide: str | None = None) -> DataFrame:
    """Aggregates by time window and key; rows later than ``late`` are dropped."""
    at = F.window(F.col(time), window, slide) if slide else F.window(F.col(time), window)
    # watermarks are kept on instants
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    grouped = stream.withWatermark(time, late).groupBy(at.alias("window"), *keys).agg(*[c.alias(n) for n, c in functions.items()])
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *functions)
