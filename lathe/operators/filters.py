"""Filters.  Most give two frames: the rows that pass and the rows that fail."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.operators import predicates as P


def split(df: DataFrame, passes: Column) -> tuple[DataFrame, DataFrame]:
    return df.where(passes), df.where(P.negated(passes))


def filter_predicate(df: DataFrame, given: Sequence[Mapping] | str, filter_type: str = "all", strict_kinds: bool = False, allow_udf: bool = False) -> Column:
    """The predicate of a filter: an expression, or criteria joined by all or any.  No criteria: everything passes."""
    if isinstance(given, str):
        return P.expression(df, given, allow_udf)
    if filter_type not in ("all", "any"):
        raise ValueError(f"filter_type is all or any, not {filter_type!r}")
    parts = [P.criterion(df, g, strict_kinds) for g in given]
    return F.lit(True) if not parts else P.conjunction(parts) if filter_type == "all" else P.disjunction(parts)


def all_of(df: DataFrame, **wanted: object) -> Column:
    """Every column has its value, or satisfies its function; without any, every row."""
    return P.conjunction([P.callable_or_value(df, n, w) for n, w in wanted.items()])


def any_of(df: DataFrame, **wanted: object) -> Column:
    """Some column has its value, or satisfies its function; without any, no row."""
    return P.disjunction([P.callable_or_value(df, n, w) for n, w in wanted.items()])


def without(df: DataFrame, *values: object) -> DataFrame:
    """The rows in which no column has one of the values; None stands for null."""
    if not values:
        raise ValueError("drop needs a value")
    visible = [c for c in df.columns if not c.startswith("__")]
    if values == (None,):
        return df.na.drop("any", subset=visible)
    return df.where(P.negated(P.disjunction([P.compare(P.column(df, c), "==", P.literal(v)) for c in visible for v in values])))
