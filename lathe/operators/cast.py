"""Typed column selection with a table of rejects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions import infer
from lathe.functions.text import as_text
from lathe.operators.naming import require, unique_name
from lathe.session import enable_time

TYPES = ("bool", "int", "float", "str", "date", "datetime", "time")
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def type_name(kind: T.DataType) -> str:
    """The name of a column's type in a specification."""
    for name, kinds in (("bool", T.BooleanType), ("int", T.IntegralType), ("float", T.NumericType), ("date", T.DateType), ("datetime", (T.TimestampNTZType, T.TimestampType)), ("time", T.TimeType)):
        if isinstance(kind, kinds):
            return name
    return "str"


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts)


def _from_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros.cast("bigint"), F.expr(_EPOCH))


def _seconds(time: Column) -> Column:
    return F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def _clock(seconds: Column) -> Column:
    day = F.pmod(seconds.cast("bigint"), F.lit(86400))
    return F.make_time((day / 3600).cast("int"), (F.pmod(day, F.lit(3600)) / 60).cast("int"), F.pmod(day, F.lit(60)).cast("decimal(16,6)"))


def _clock_of(stamp: Column) -> Column:
    return F.make_time(F.hour(stamp), F.minute(stamp), F.date_part(F.lit("SECOND"), stamp).cast("decimal(16,6)"))


def convert(col: Column, source: str, target: str) -> Column:
    """The value as the target type; null if it has none."""
    if source == target:
        return col
    if target == "str":
        if source == "bool":
            return F.when(col, "True").otherwise("False")
        if source == "float":
            return as_text(col, T.DoubleType())
        formats = {"datetime": "yyyy-MM-dd HH:mm:ss", "date": "yyyy-MM-dd"}
        if source == "time":
            return F.concat_ws(":", *[F.lpad(f(col).cast("string"), 2, "0") for f in (F.hour, F.minute, F.second)])
        return F.date_format(col, formats[source]) if source in formats else col.cast("string")
    if source == "str":
        number = infer.parse_float(col)
        return {
            "bool": lambda: infer.parse_bool(col),
            "int": lambda: F.when((number >= -9.2e18) & (number <= 9.2e18), F.coalesce(infer.parse_int(col), F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)))),
            "float": lambda: number,
            "date": lambda: F.coalesce(infer.parse_date(col), infer.parse_datetime(col).cast("date")),
            "datetime": lambda: infer.parse_datetime(col),
            "time": lambda: infer.parse_time(col),
        }[target]()
    if source in ("bool", "int", "float"):
        number = col.cast("int") if source == "bool" else col
        whole = number.cast("bigint") if source != "float" else F.when(F.abs(number) < 9.2e18, F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("bigint"))
        span = F.abs(number) < 9.0e12
        return {
            "bool": lambda: number >= 1,
            "int": lambda: whole,
            "float": lambda: number.cast("double"),
            "date": lambda: F.when(span, _from_micros(whole * 1_000_000).cast("date")),
            "datetime": lambda: F.when(span, _from_micros(F.round(number * 1_000_000) if source == "float" else whole * 1_000_000)),
            "time": lambda: _clock(whole),
        }[target]()
    nothing = F.lit(None)
    if source == "time":
        seconds = _seconds(col)
        return {"bool": seconds >= 1, "int": seconds.cast("bigint"), "float": seconds.cast("double"), "date": nothing.cast("date"), "datetime": nothing.cast("timestamp_ntz")}[target]
    stamp = col.cast("timestamp_ntz")
    micros = _micros(stamp)
    if target == "time":
        return nothing.cast("time(6)") if source == "date" else _clock_of(stamp)
    return {"bool": micros >= 1_000_000, "int": F.floor(micros / 1_000_000).cast("bigint"), "float": micros / 1_000_000, "date": col.cast("date"), "datetime": stamp}[target]


def _python_type(name: object) -> str:
    from datetime import date, datetime, time

    return {bool: "bool", int: "int", float: "float", str: "str", date: "date", datetime: "datetime", time: "time"}.get(name, name)  # type: ignore[arg-type]


def column_select(df: DataFrame, columns: Sequence[Mapping]) -> tuple[DataFrame, DataFrame]:
    """(selected, rejected): the columns asked for with their types, and the rows in which one of them has no such value.

    A column is ``{column, type, allow_empty=False, rename=None}``.  A rejected row
    has the reason of its first failing column, and the original columns.  Empty is null
    or the empty text; allowed, it becomes null, or stays as it is in a text column.
    """
    visible = [c for c in df.columns if not c.startswith("__")]
    require(visible, [c["column"] for c in columns])
    if any(_python_type(c["type"]) == "time" for c in columns):
        enable_time(df.sparkSession)
    names: list[str] = []
    values: list[Column] = []
    reasons: list[Column] = []
    for spec in columns:
        column, target = spec["column"], _python_type(spec["type"])
        if target not in TYPES:
            raise ValueError(f"type is one of {TYPES}, not {target!r}")
        wanted = spec.get("rename")
        if isinstance(wanted, str) and wanted and not wanted.strip():
            raise ValueError("a name of blanks only")
        name = unique_name((wanted or column).strip() if wanted else column, names)
        names.append(name)
        col, source = F.col(f"`{column}`"), type_name(df.schema[column].dataType)
        empty_text = col == "" if source == "str" else F.lit(False)
        empty = col.isNull() | F.coalesce(empty_text, F.lit(False))
        value = convert(col, source, target)
        done = F.when(~empty, value)
        if target == "str" and source == "str":
            done = F.when(col.isNull(), None).otherwise(col)
        values.append(done.alias(name))
        label = f"{name}[{target}]"
        said = F.coalesce(as_text(col, df.schema[column].dataType), F.lit("None"))
        failed = F.when(~empty & value.isNull(), F.concat(F.lit("Cannot cast '"), said, F.lit(f"' from '{column}[{source}]' to '{label}'.")))
        if spec.get("allow_empty", False):
            reasons.append(failed)
        else:
            reasons.append(F.when(col.isNull(), F.lit(f"'{label}' cannot be empty.")).when(empty, F.lit(f"'{column}' cannot be empty string in '{label}'.")).otherwise(failed))
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    reject = unique_name("reject_reason", visible)
    marked = df.withColumn("__reason", reason)
    return marked.where("__reason is null").select(*values), marked.where("__reason is not null").select(F.col("__reason").alias(reject), *[F.col(f"`{c}`") for c in visible])
