"""Joins on equal keys, where null equals null and NaN equals nothing.

The join itself is left to Catalyst: one Join node with a null-safe condition,
broadcast or shuffled as sizes tell.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.text import kind_of
from lathe.operators.naming import require, unique_names

KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "semi": "left_semi", "anti": "left_anti"}


def equal_keys(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], names: dict[str, str]) -> Column:
    """The condition; ``names`` has the right keys' names in the renamed right frame."""
    parts = []
    for l, r in zip(left_keys, right_keys):
        a, b = left.schema[l].dataType, right.schema[r].dataType
        if kind_of(a) != kind_of(b) and "null" not in (kind_of(a), kind_of(b)):
            raise TypeError(f"keys {l!r} ({a.simpleString()}) and {r!r} ({b.simpleString()}) don't compare")
        same = F.col(f"`{l}`").eqNullSafe(F.col(f"`{names[r]}`"))
        if isinstance(a, (T.DoubleType, T.FloatType)):
            same = same & ~F.coalesce(F.isnan(F.col(f"`{l}`")), F.lit(False))
        parts.append(same)
    return reduce(operator.and_, parts)


def join(
    left: DataFrame, right: DataFrame, kind: str = "inner", left_keys: Sequence[str] = (), right_keys: Sequence[str] = (), left_columns: Sequence[str] | None = None,
    right_columns: Sequence[str] | None = None, merge_keys: bool = False, left_order: Sequence[str] = (), right_order: Sequence[str] = (), ordered: bool = False,
) -> DataFrame:
    """Left columns, then right columns; a right name that is taken gets _1, _2, ….

    ``merge_keys`` drops the right keys, and takes for an outer join the left key where
    the left side matched and else the right one.  ``ordered`` sorts by the first
    appearance of the left key, then by left and right order; unmatched right rows come last.
    """
    if kind not in {*KINDS, "cross"}:
        raise ValueError(f"unknown join {kind!r}")
    if not all(isinstance(x, (list, tuple)) for x in (left_keys, right_keys)):
        raise TypeError("keys are lists of names")
    if len(left_keys) != len(right_keys) or (kind != "cross" and not left_keys):
        raise ValueError("a join needs as many left as right keys")
    require(left.columns, left_keys)
    require(right.columns, right_keys)
    left_columns = [c for c in left.columns if not c.startswith("__")] if left_columns is None else list(left_columns)
    right_columns = [c for c in right.columns if not c.startswith("__")] if right_columns is None else list(right_columns)
    require(left.columns, left_columns)
    require(right.columns, right_columns)
    # internal names on the right, the final ones at the end
    inner = {c: f"__r{i}" for i, c in enumerate(right.columns)}
    other = right.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], F.lit(True).alias("__right"))
    mine = left.withColumn("__left", F.lit(True))
    if ordered and left_order and left_keys:
        mine = mine.withColumn("__first", F.min(F.struct(*left_order)).over(W.partitionBy(*[f"`{k}`" for k in left_keys])))
    if kind == "cross":
        both = mine.crossJoin(other)
    else:
        both = mine.join(other, equal_keys(left, right, left_keys, right_keys, inner), KINDS[kind])
    if kind in ("semi", "anti"):
        return both.select(*[f"`{c}`" for c in left_columns])
    if ordered and left_order and right_order:
        sort = [F.col("__first").asc_nulls_last()] if left_keys else []
        both = both.orderBy(*sort, *[F.col(o).asc_nulls_last() for o in left_order], *[F.col(inner[o]).asc_nulls_last() for o in right_order])
    wanted = unique_names([*left_columns, *right_columns])
    out = []
    pairs = dict(zip(left_keys, right_keys))
    for c, name in zip(left_columns, wanted):
        col = F.col(f"`{c}`")
        if merge_keys and kind in ("outer", "right") and c in pairs:
            col = F.when(F.col("__left"), col).otherwise(F.col(inner[pairs[c]]))
        out.append(col.alias(name))
    for c, name in zip(right_columns, wanted[len(left_columns) :]):
        if not (merge_keys and c in right_keys):
            out.append(F.col(inner[c]).alias(name))
    return both.select(*out)
