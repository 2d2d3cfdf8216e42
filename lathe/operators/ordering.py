"""Sorting in three collations, ordinals, slices and gathering by position."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.text import as_text
from lathe.operators import position
from lathe.operators.naming import require

MODES = ("excel", "unix", "alphanumeric")
#: A value of mixed kinds: its kind, and the value as number or text.
MIXED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("num", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("ts", T.TimestampNTZType())])
# Rank of each kind by collation.
EXCEL_RANK = {"number": 0, "ts": 0, "text": 1, "bool": 2, "null": 3}
UNIX_RANK = {"null": 0, "bool": 1, "number": 2, "ts": 3, "text": 4}


def tagged(values: Sequence[object]) -> list[tuple | None]:
    """Python values of several kinds as rows of MIXED."""
    from datetime import date, datetime

    out: list[tuple | None] = []
    for v in values:
        if v is None:
            out.append(("null", None, None, None))
        elif isinstance(v, bool):
            out.append(("bool", float(v), None, None))
        elif isinstance(v, (int, float)):
            out.append(("number", float(v), None, None))
        elif isinstance(v, (date, datetime)):
            out.append(("ts", None, None, v if isinstance(v, datetime) else datetime(v.year, v.month, v.day)))
        else:
            out.append(("text", None, str(v), None))
    return out


def sort_columns(df: DataFrame, mapping: Mapping[str, bool], mode: str = "excel", binary: bool = False) -> list[Column]:
    """Sort expressions; True means descending.

    excel: numbers and times, text, booleans, null; reverse turns all of it.  unix: null,
    booleans, numbers, times, text; reverse leaves text last.  alphanumeric: all as
    text.  Text follows the Unicode collation unless ``binary``.
    """
    if mode not in MODES:
        raise ValueError(f"sort mode is one of {MODES}")
    if not mapping or not all(isinstance(v, bool) for v in mapping.values()):
        raise ValueError("a sort maps column names to True (descending) or False")
    require(df.columns, mapping)
    out: list[Column] = []
    collate = (lambda c: c) if binary else (lambda c: F.collate(c, "UNICODE"))
    for name, down in mapping.items():
        col, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if mode == "alphanumeric":
            text = collate(F.coalesce(as_text(col, kind), F.lit("None")))
            out.append(text.desc() if down else text.asc())
        elif isinstance(kind, T.StructType) and "kind" in kind.fieldNames():
            ranks = EXCEL_RANK if mode == "excel" else UNIX_RANK
            rank = F.coalesce(*[F.when(col["kind"] == k, r) for k, r in ranks.items()], F.lit(ranks["null"]))
            number = F.coalesce(col["num"], F.datediff(col["ts"].cast("date"), F.lit("1900-01-01").cast("date")) + F.lit(0.0)) if mode == "excel" else F.coalesce(col["num"], F.unix_micros(col["ts"].cast("timestamp")).cast("double"))
            text = collate(col["text"])
            turn = (lambda c: c.desc()) if down else (lambda c: c.asc())
            if mode == "unix" and down:
                rank = F.when(rank == UNIX_RANK["text"], -1).otherwise(rank)
            out += [turn(rank), turn(number), turn(text)]
        else:
            value = collate(col) if isinstance(kind, T.StringType) else col
            if mode == "excel":
                out.append(value.desc_nulls_first() if down else value.asc_nulls_last())
            else:
                out.append(value.desc_nulls_last() if down else value.asc_nulls_first())
    return out


def sorted_rows(df: DataFrame, mapping: Mapping[str, bool], mode: str = "excel", order: Sequence[str] | None = None, binary: bool = False) -> DataFrame:
    """Sorted; ties keep their order."""
    df, order = position.ensure(df, order)
    return df.orderBy(*sort_columns(df, mapping, mode, binary), *order)


def sort_index(df: DataFrame, mapping: Mapping[str, bool], mode: str, order: Sequence[str]) -> DataFrame:
    """ordinal (place after sorting is row order of the result) of each row before sorting."""
    numbered = position.with_ordinals(df, order)
    return numbered.orderBy(*sort_columns(df, mapping, mode), position.ORDINAL).select(F.col(position.ORDINAL).alias("position"))


def is_sorted(df: DataFrame, mapping: Mapping[str, bool], mode: str = "excel", order: Sequence[str] | None = None) -> bool:
    """Whether sorting would move no row: every row is compared with its neighbour, ranges with the row before them."""
    df, order = position.ensure(df, order)
    sort_columns(df, mapping, mode)  # checks the arguments
    values = []
    for name in mapping:
        kind, col = df.schema[name].dataType, F.col(f"`{name}`")
        if mode == "alphanumeric":
            col = F.coalesce(as_text(col, kind), F.lit("None"))
        if isinstance(kind, T.StringType) or mode == "alphanumeric":
            col = F.collate(col, "UNICODE")
        values.append(col)
    nulls_first = {n: (d if mode == "excel" else not d) for n, d in mapping.items()}
    numbered = position.with_ordinals(df, order).select(position.ORDINAL, *[v.alias(f"v{i}") for i, v in enumerate(values)])
    after = numbered.select((F.col(position.ORDINAL) - 1).alias(position.ORDINAL), *[F.col(f"v{i}").alias(f"w{i}") for i in range(len(values))])
    both = numbered.join(after, position.ORDINAL)
    wrong = F.lit(False)
    for i, (name, down) in reversed(list(enumerate(mapping.items()))):
        a, b = F.col(f"v{i}"), F.col(f"w{i}")
        order_wrong = F.when(a.isNull() | b.isNull(), (b.isNull() & a.isNotNull()) if nulls_first[name] else (a.isNull() & b.isNotNull())).otherwise(b > a if down else b < a)
        wrong = order_wrong | (a.eqNullSafe(b) & wrong)
    return both.where(wrong).isEmpty()


def sliced(df: DataFrame, rows: slice, order: Sequence[str]) -> DataFrame:
    """A Python slice of the rows, in its order, which POS then holds."""
    numbered = position.with_ordinals(df, order)
    n = df.count() if any(x is not None and x < 0 for x in (rows.start, rows.stop)) or (rows.step or 1) < 0 or rows.stop is None else None
    start, stop, step = rows.indices(n if n is not None else max(rows.stop or 0, rows.start or 0))
    at = F.col(position.ORDINAL)
    if step > 0:
        kept, place = numbered.where((at >= start) & (at < stop) & ((at - start) % step == 0)), at
    else:
        kept, place = numbered.where((at <= start) & (at > stop) & ((start - at) % -step == 0)), -at
    return kept.withColumn(position.POS, place).drop(position.ORDINAL)


def reindex(df: DataFrame, positions: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows by ordinal in the order of ``positions`` (ord, pos), which POS then holds; -1 gives a row of nulls, and a position may repeat."""
    columns = [c for c in df.columns if not c.startswith("__")]
    asked = positions.select(F.col("ord").alias(position.POS), F.col("pos").alias("__at"))
    numbered = position.with_ordinals(df, order).select(*[f"`{c}`" for c in columns], position.ORDINAL)
    return asked.join(numbered, F.col("__at") == F.col(position.ORDINAL), "left").orderBy(position.POS).select(*[f"`{c}`" for c in columns], position.POS)


def updated(df: DataFrame, column: str, rows: slice | int, value: object, order: Sequence[str]) -> DataFrame:
    """One value put into a slice of a column."""
    rows = slice(rows, rows + 1) if isinstance(rows, int) else rows
    start, stop, step = rows.indices(df.count())
    numbered = position.with_ordinals(df, order)
    at = F.col(position.ORDINAL)
    inside = (at >= start) & (at < stop) & ((at - start) % step == 0)
    return numbered.withColumn(column, F.when(inside, F.lit(value)).otherwise(F.col(f"`{column}`"))).drop(position.ORDINAL)


def assigned(df: DataFrame, column: str, key: slice | int, values: Sequence, order: Sequence[str]) -> DataFrame:
    """A column with values put into it as into a list; POS then holds the row order.

    [:] replaces all, [a:] what follows, [:b] what precedes, [a:b] what lies between, each by as many values
    as there are; [a:b:c] overwrites one place after the other.  A column that gets longer
    than the others adds rows, which are null in those; one that gets shorter ends in nulls.
    """
    n = df.count()
    if isinstance(key, int):
        if isinstance(values, (list, tuple)):
            raise TypeError("one place takes one value; a slice takes several")
        if not -n <= key < n:
            raise IndexError("there is no such row")
        return updated(df, column, key % n, values, order)
    start, stop, step = key.indices(n)
    numbered = position.with_ordinals(df, order)
    at, name = F.col(position.ORDINAL), f"`{column}`"
    over = key.step not in (None, 1)
    if over:
        places = list(range(start, stop, step))
        if len(values) > len(places):
            raise ValueError(f"{len(values)} values for a slice of {len(places)} places")
    else:
        start, stop = (0 if key.start is None else start), (n if key.stop is None else max(start, stop))
        places = [start + i for i in range(len(values))]
    from lathe.sources.sheets import frame

    given = frame(df.sparkSession, list(zip(places, values)), ["__at", "__value"])
    given = given.select(F.col("__at").cast("bigint").alias("__at"), F.col("__value").cast(df.schema[column].dataType).alias("__value"))
    if over:
        both = numbered.join(given.withColumn("__hit", F.lit(True)), at == F.col("__at"), "left")
        out = both.withColumn(column, F.when(F.col("__hit"), F.col("__value")).otherwise(F.col(name)))
        return out.withColumn(position.POS, at).drop(position.ORDINAL, "__at", "__value", "__hit")
    old = numbered.where((at < start) | (at >= stop)).select(F.when(at < start, at).otherwise(at - stop + start + len(values)).alias("__at"), F.col(name).alias("__value"))
    both = numbered.drop(column, position.POS).join(old.unionByName(given), at == F.col("__at"), "full").withColumn(position.POS, F.coalesce(at, F.col("__at")))
    return both.select(*[F.col("__value").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns if c != position.POS], position.POS)


def deleted(df: DataFrame, rows: slice | int, order: Sequence[str]) -> DataFrame:
    """All rows but those of a slice."""
    rows = slice(rows, rows + 1 or None) if isinstance(rows, int) else rows
    start, stop, step = rows.indices(df.count())
    if step < 0:
        start, stop, step = stop + 1, start + 1, 1 if step == -1 else -step
    at = F.col(position.ORDINAL)
    return position.with_ordinals(df, order).where(~((at >= start) & (at < stop) & ((at - start) % step == 0))).drop(position.ORDINAL)


def top(df: DataFrame, mapping: Mapping[str, bool], n: int, mode: str = "excel", order: Sequence[str] | None = None) -> DataFrame:
    """The first n rows in sort order."""
    return sorted_rows(df, mapping, mode, order).limit(n)


def same_rows(a: DataFrame, b: DataFrame, a_order: Sequence[str] | None, b_order: Sequence[str] | None) -> bool:
    """Whether two tables have the same names and the same values row by row; the order of the columns doesn't count."""
    names = sorted(c for c in a.columns if not c.startswith("__"))
    if names != sorted(c for c in b.columns if not c.startswith("__")):
        return False
    (a, ao), (b, bo) = position.ensure(a, a_order), position.ensure(b, b_order)
    x = position.with_ordinals(a, ao).select(position.ORDINAL, *[F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(names)])
    y = position.with_ordinals(b, bo).select(position.ORDINAL, *[F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(names)])
    both = x.join(y.withColumn("__y", F.lit(1)), position.ORDINAL, "full").withColumn("__x", F.lit(1))
    equal = reduce(operator.and_, [F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in range(len(names))], F.col("__y").isNotNull())
    return both.where(~equal).isEmpty() and x.count() == y.count()
