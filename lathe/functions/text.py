"""Values as text, the way users see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_text(col: Column, kind: T.DataType) -> Column:
    """The text of a value: True / False, 1.0 rather than 1, ISO dates and times.  Null stays null."""
    if isinstance(kind, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = F.regexp_replace(col.cast("decimal(38,10)").cast("string"), r"0+$", "")
        plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
        size = F.abs(col)
        return F.when((size >= 1e7) & (size < 1e16) & (col == F.floor(col)), plain).otherwise(F.lower(col.cast("string")))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return col.cast("string")
    return col.cast("string")


def number_like(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def kind_of(kind: T.DataType) -> str:
    """Types of one kind compare with each other."""
    if isinstance(kind, T.NullType):
        return "null"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return type(kind).__name__
