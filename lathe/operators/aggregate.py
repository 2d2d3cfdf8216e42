"""Grouped aggregation, pivot, unpivot, transpose, distinct rows and indices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.text import as_text
from lathe.operators import position
from lathe.operators.naming import require, shown, unique_name, unique_names

#: Distinct pivot keys that may become columns.
MAX_PIVOT = 10_000


def _numeric(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.lit(0.0)
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"a sum needs numbers, not {kind.simpleString()}")
    return col.cast("double")




def aggregate_column(function: str, name: str, kind: T.DataType, pos: Column | None) -> Column:
    """One aggregate.  Nulls are skipped, but for First, Last, Count and CountUnique, which see them."""
    col = F.col(f"`{name}`")
    if callable(function):
        # of Columns, or a pandas UDF from series to scalar
        return function(col)
    if function in ("First", "Last"):
        return (F.min_by if function == "First" else F.max_by)(F.struct(col.alias("v")), pos)["v"]
    if function == "Mode":
        return F.expr(f"mode() WITHIN GROUP (ORDER BY `{name}` DESC)")
    table: dict[str, Callable[[], Column]] = {
        "Max": lambda: F.max(col),
        "Min": lambda: F.min(col),
        "Sum": lambda: F.coalesce(F.sum(_numeric(col, kind)), F.lit(0.0)),
        "Product": lambda: F.product(_numeric(col, kind)),
        "Count": lambda: F.count(F.lit(1)),
        "CountUnique": lambda: F.countDistinct(col) + F.max(F.when(col.isNull(), 1).otherwise(0)),
        "Average": lambda: F.avg(_numeric(col, kind)),
        "StandardDeviation": lambda: F.coalesce(F.stddev_samp(_numeric(col, kind)), F.lit(0.0)),
        "Median": lambda: F.median(_numeric(col, kind)),
    }
    return table[function]()


class GroupBy:
    """Names of the aggregates."""

    max, min, sum, product, first, last = "Max", "Min", "Sum", "Product", "First", "Last"
    count, count_unique, avg, stdev, median, mode = "Count", "CountUnique", "Average", "StandardDeviation", "Median", "Mode"
    functions = ("Max", "Min", "Sum", "Product", "First", "Last", "Count", "CountUnique", "Average", "StandardDeviation", "Median", "Mode")


def groupby(df: DataFrame, keys: Sequence[str], functions: Sequence[tuple[str, str]] = (), order: Sequence[str] | None = None, ordered: bool = False) -> DataFrame:
    """Aggregates named ``Sum(column)`` by key; without functions the distinct keys, without keys one row.

    A function may also be one of Columns, or a pandas UDF that aggregates, under its own
    name.  ``ordered`` sorts groups by their first appearance.
    """
    if not keys and not functions:
        raise ValueError("groupby needs keys or functions")
    if len(set(keys)) != len(keys):
        raise ValueError("a key occurs twice")
    functions = list(dict.fromkeys((c, f) for c, f in functions))
    for c, f in functions:
        if not callable(f) and f not in GroupBy.functions:
            raise ValueError(f"unknown function {f!r}; use one of {GroupBy.functions}")
    require(df.columns, [*keys, *[c for c, _ in functions]])
    positional = ordered or any(f in ("First", "Last") for _, f in functions)
    if positional:
        df, order = position.ensure(df, order)
    pos = position.key_of(order) if positional else None
    taken = list(keys)
    out, series = [], []
    for c, f in functions:
        name = unique_name(f"{getattr(f, '__name__', 'f') if callable(f) else f}({c})", taken)
        taken.append(name)
        # pandas UDFs can't stand beside other aggregates
        (series if hasattr(f, "evalType") else out).append(aggregate_column(f, c, df.schema[c].dataType, pos).alias(name))
    quoted = [F.col(f"`{k}`") for k in keys]
    if not functions and not ordered:
        return df.select(*quoted).distinct()
    if ordered:
        out.append(F.min(pos).alias("__first"))
    grouped = df.groupBy(*quoted).agg(*out) if out else df.groupBy(*quoted).agg(*series)
    if out and series:
        other = df.groupBy(*[q.alias(f"__k{i}") for i, q in enumerate(quoted)]).agg(*series)
        same = F.lit(True)
        for i, q in enumerate(quoted):
            same = same & q.eqNullSafe(F.col(f"__k{i}"))
        grouped = grouped.join(other, same).select(*[f"`{n}`" for n in taken], *(["__first"] if ordered else []))
    return grouped.orderBy("__first").drop("__first") if ordered else grouped


def pivot(df: DataFrame, rows: Sequence[str], columns: Sequence[str], functions: Sequence[tuple[str, str]], values_as_rows: bool = True, order: Sequence[str] | None = None, ordered: bool = False) -> DataFrame:
    """Group by rows and columns, then spread the column keys.

    ``values_as_rows``: a ``function`` column, a row per row key and function, and columns
    ``(A=1,B=2)``; else columns ``Sum(B,A=1)``.  Column keys stand in order of first
    appearance; combinations that don't occur are null.
    """
    if not rows or not columns or not functions:
        raise ValueError("pivot needs rows, columns and functions")
    df, order = position.ensure(df, order)
    first = F.min(position.key_of(order))
    functions = list(dict.fromkeys(functions))
    grouped = groupby(df, [*rows, *columns], functions, order)
    if ordered:
        firsts = df.groupBy(*[F.col(f"`{r}`").alias(f"__o{i}") for i, r in enumerate(rows)]).agg(first.alias("__first"))
    # the column keys become columns, so their number is bounded by what a schema holds
    found = df.groupBy(*[f"`{c}`" for c in columns]).agg(first.alias("__first")).orderBy("__first").limit(MAX_PIVOT + 1).collect()
    if len(found) > MAX_PIVOT:
        raise ValueError(f"more than {MAX_PIVOT} column keys")
    if not found:
        return grouped.select(*[F.col(f"`{r}`") for r in rows], *([F.lit("").alias(unique_name("function", rows))] if values_as_rows else []))
    names = [f"{f}({c})" for c, f in functions]
    spread, labels = [], []
    for key in found:
        here = F.lit(True)
        for i, c in enumerate(columns):
            here = here & F.col(f"`{c}`").eqNullSafe(F.lit(key[i]))
        label = ",".join(f"{c}={shown(key[i])}" for i, c in enumerate(columns))
        labels.append(label)
        for n in names:
            spread.append(F.max(F.when(here, F.struct(F.col(f"`{n}`").alias("v")))).alias(f"__v{len(spread)}"))
    wide = grouped.groupBy(*[f"`{r}`" for r in rows]).agg(*spread)
    if ordered:
        same = F.lit(True)
        for i, r in enumerate(rows):
            same = same & F.col(f"`{r}`").eqNullSafe(F.col(f"__o{i}"))
        wide = wide.join(firsts, same).drop(*[f"__o{i}" for i in range(len(rows))])
    keys = [F.col(f"`{r}`") for r in rows]
    if not values_as_rows:
        titles = unique_names([f"{f}({c},{label})" for label in labels for c, f in functions], rows)
        out = wide.orderBy("__first") if ordered else wide
        return out.select(*keys, *[F.col(f"__v{i}")["v"].alias(t) for i, t in enumerate(titles)])
    titles = unique_names([f"({label})" for label in labels], [*rows, "function"])
    kinds = {grouped.schema[n].dataType for n in names}
    kind = kinds.pop() if len(kinds) == 1 else T.DoubleType() if all(isinstance(k, T.NumericType) for k in [*kinds]) else T.StringType()
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(j).alias("n"), F.lit(name).alias("function"), *[_cast(F.col(f"__v{i * len(names) + j}")["v"], grouped.schema[name].dataType, kind).alias(f"c{i}") for i in range(len(labels))])
                for j, name in enumerate(names)
            ]
        )
    )
    long = wide.select(*keys, *(["__first"] if ordered else []), each.alias("__e"))
    if ordered:
        long = long.orderBy("__first", F.col("__e.n"))
    return long.select(*keys, F.col("__e.function").alias(unique_name("function", rows)), *[F.col(f"__e.c{i}").alias(t) for i, t in enumerate(titles)])


def _cast(col: Column, source: T.DataType, target: T.DataType) -> Column:
    if source == target:
        return col
    return as_text(col, source) if isinstance(target, T.StringType) else col.cast(target)


def common_type(kinds: Sequence[T.DataType]) -> T.DataType:
    """One type for values of several columns: the same, a wider number or time, or text."""
    kinds = [k for k in kinds if not isinstance(k, T.NullType)] or [T.StringType()]
    if len(set(kinds)) == 1:
        return kinds[0]
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return T.LongType()
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.DoubleType()
    if all(isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)) for k in kinds):
        return T.TimestampNTZType()
    return T.StringType()


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), column_name: str = "transpose", value_name: str = "value") -> DataFrame:
    """One row per row and column of ``columns``; nulls stay; names that are taken are made unique."""
    if len(set(columns)) != len(columns):
        raise ValueError("a column occurs twice")
    require(df.columns, [*columns, *keep])
    column_name, value_name = unique_names([column_name, value_name], keep)
    kind = common_type([df.schema[c].dataType for c in columns])
    cast = df.select(*[F.col(f"`{k}`") for k in keep], *[_cast(F.col(f"`{c}`"), df.schema[c].dataType, kind).alias(f"__u{i}") for i, c in enumerate(columns)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("n"), F.col(f"__u{i}").alias("v")) for i, c in enumerate(columns)]))
    return cast.select(*[F.col(f"`{k}`") for k in keep], pairs.alias("__p")).select(*[F.col(f"`{k}`") for k in keep], F.col("__p.n").alias(column_name), F.col("__p.v").alias(value_name))


def transpose(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The first column's values become names, the other names the first column; of a repeated value the last row counts."""
    visible = [c for c in df.columns if not c.startswith("__")]
    if not visible:
        return df
    if len(visible) == 1:
        return df.select(F.col(f"`{visible[0]}`")).limit(0)
    head, rest = visible[0], visible[1:]
    df, order = position.ensure(df, order)
    keys = df.groupBy(F.col(f"`{head}`").alias("k")).agg(F.min(position.key_of(order)).alias("p")).orderBy("p").limit(MAX_PIVOT + 1).collect()
    if len(keys) > MAX_PIVOT:
        raise ValueError(f"more than {MAX_PIVOT} rows can't become columns")
    kind = common_type([df.schema[c].dataType for c in rest])
    long = df.select(F.col(f"`{head}`").alias("k"), position.key_of(order).alias("p"), *[_cast(F.col(f"`{c}`"), df.schema[c].dataType, kind).alias(f"c{i}") for i, c in enumerate(rest)])
    long = long.select("k", "p", F.posexplode(F.array(*[f"c{i}" for i in range(len(rest))])).alias("n", "v"))
    names = unique_names([head, *[shown(r["k"]) for r in keys]])
    values = [F.max_by(F.struct("v"), F.when(F.col("k").eqNullSafe(F.lit(r["k"])), F.col("p")))["v"].alias(f"v{i}") for i, r in enumerate(keys)]
    wide = long.groupBy("n").agg(*values).orderBy("n")
    label = F.element_at(F.array(*[F.lit(c) for c in rest]), F.col("n") + 1)
    return wide.select(label.alias(names[0]), *[F.col(f"v{i}").alias(n) for i, n in enumerate(names[1:])])


def drop_duplicates(df: DataFrame, columns: Sequence[str] = (), order: Sequence[str] | None = None) -> DataFrame:
    """The first row of each combination of values."""
    visible = [c for c in df.columns if not c.startswith("__")]
    columns = list(columns) or visible
    require(df.columns, columns)
    if set(columns) == set(visible):
        return df.select(*[f"`{c}`" for c in visible]).distinct()
    df, order = position.ensure(df, order)
    first = df.groupBy(*[f"`{c}`" for c in columns]).agg(F.min_by(F.struct(*[f"`{c}`" for c in df.columns]), position.key_of(order)).alias("__row"))
    return first.select(*[F.col("__row")[c].alias(c) for c in df.columns])


def index(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each combination of values the ordinals of its rows, ascending."""
    numbered = position.with_ordinals(df, order)
    return numbered.groupBy(*[f"`{c}`" for c in columns]).agg(F.sort_array(F.collect_list(position.ORDINAL)).alias("positions"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def rank_filter(df: DataFrame, partition: Sequence[str], order: Sequence[Column], top: int) -> DataFrame:
    """The top rows of each group."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*partition).orderBy(*order))).where(F.col("__rank") <= top).drop("__rank")
