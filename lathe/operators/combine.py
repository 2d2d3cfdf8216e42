"""Putting tables together and telling them apart."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lathe.operators import position
from lathe.operators.naming import require, unique_names

#: Rows of both tables together up to which the exact sequence diff runs on the driver.
EXACT_ROWS = 200_000


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both by column name; the names have to be the same."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    return a.unionByName(b)


def stack(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both by column name; what a table lacks is null; new columns come last."""
    return a.unionByName(b, allowMissingColumns=True)


def repeat(df: DataFrame, times: int, order: Sequence[str] | None = None) -> DataFrame:
    """The rows, ``times`` times over: each repetition in order, one after the other."""
    if not isinstance(times, int) or isinstance(times, bool) or times < 1:
        raise ValueError("times is a positive integer")
    df, order = position.ensure(df, order)
    out = df.withColumn("__time", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return out.orderBy("__time", *order).drop("__time")


def diff_sets(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of both as multisets, with markers 1st and 2nd: = = where both have it, + - only the first, - + only the second.

    The n-th occurrence of a row meets the n-th of the other table, by a full join on
    null-safe values: no row order and no single task is needed.
    """
    columns = [c for c in a.columns if not c.startswith("__")] if columns is None else list(columns)
    require(a.columns, columns)
    require(b.columns, columns)
    # rows are counted before they meet, so a row that occurs a million times is one row here
    sides = []
    for df, n in ((a, "__na"), (b, "__nb")):
        sides.append(df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias(n)))
    right = {c: f"__b{i}" for i, c in enumerate(columns)}
    other = sides[1].select(*[F.col(f"`{c}`").alias(n) for c, n in right.items()], "__nb")
    condition = F.lit(True)
    for c, n in right.items():
        condition = condition & F.col(f"`{c}`").eqNullSafe(F.col(n))
    both = sides[0].join(other, condition, "full")
    na, nb = F.coalesce("__na", F.lit(0)), F.coalesce("__nb", F.lit(0))
    first, second = unique_names(["1st", "2nd"], columns)
    marks = F.array(
        F.struct(F.least(na, nb).alias("n"), F.lit("=").alias("x"), F.lit("=").alias("y")),
        F.struct((na - F.least(na, nb)).alias("n"), F.lit("+").alias("x"), F.lit("-").alias("y")),
        F.struct((nb - F.least(na, nb)).alias("n"), F.lit("-").alias("x"), F.lit("+").alias("y")),
    )
    values = [F.when(F.col("__na").isNotNull(), F.col(f"`{c}`")).otherwise(F.col(n)).alias(c) for c, n in right.items()]
    marked = both.select(*values, F.explode(marks).alias("__m")).where("__m.n > 0")
    return marked.select(*[f"`{c}`" for c in columns], F.col("__m.x").alias(first), F.col("__m.y").alias(second), F.explode(F.sequence(F.lit(1), F.col("__m.n").cast("int"))).alias("__i")).drop("__i")


def diff_sequences(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None, a_order: Sequence[str] | None = None, b_order: Sequence[str] | None = None, rows: int = EXACT_ROWS) -> DataFrame:
    """The edit script from one row sequence to the other.

    Markers: = = kept, + - only in the first, - + only in the second, r r replaced (the
    second table's rows).  A sequence diff compares every row with what stands around
    it, so it runs in one process, and refuses more than ``rows`` rows; diff_sets has no such bound.
    """
    columns = [c for c in a.columns if not c.startswith("__")] if columns is None else list(columns)
    require(a.columns, columns)
    require(b.columns, columns)
    lists = []
    for df, order in ((a, a_order), (b, b_order)):
        df, order = position.ensure(df, order)
        lists.append([tuple(r) for r in df.orderBy(*order).select(*[f"`{c}`" for c in columns]).limit(rows + 1).collect()])
    if sum(map(len, lists)) > rows:
        raise ValueError(f"more than {rows} rows; use diff_sets")
    left, right = lists
    out = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [(*r, "=", "=") for r in left[i1:i2]]
        elif tag == "replace":
            out += [(*r, "r", "r") for r in right[j1:j2]]
        else:
            out += [(*r, "+", "-") for r in left[i1:i2]] + [(*r, "-", "+") for r in right[j1:j2]]
    first, second = unique_names(["1st", "2nd"], columns)
    schema = a.select(*[f"`{c}`" for c in columns]).schema.add(first, "string").add(second, "string")
    return a.sparkSession.createDataFrame(out, schema)


def occurrence(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The number of times a row's values have occurred before it."""
    return df.withColumn("occurrence", F.row_number().over(W.partitionBy(*[f"`{c}`" for c in columns]).orderBy(*order)) - 1)
