"""Row order.

The only place where an order column is made.  Order comes from named keys that
order the rows totally; a table without keys gets one hidden id in scan order.
Contiguous ordinals and running values never need a global sort: keys are cut into
ranges at bounds from a bounded hash sample (which decides balance only, never
results), rows are numbered inside their range, and one row per range carries
what precedes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lathe.scratch import spool

POS = "__pos"
RANGE = "__range"
ORDINAL = "__ordinal"
#: Rows that a range holds on average, most ranges, keys sampled per range.
RANGE_ROWS, MAX_RANGES, PER_RANGE = 200_000, 4_000, 8
#: Plan nodes that leave rows in the partition and order in which their input has them, in every job.
IN_PLACE = {"LogicalRelation", "LocalRelation", "LogicalRDD", "Range", "OneRowRelation", "Project", "Filter", "SubqueryAlias", "View", "ResolvedHint", "Union", "Generate", "Expand", "MapInPandas", "MapInArrow"}


def ensure(df: DataFrame, order: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """The frame and the names of its order keys.  Without keys a scan id: rows in the order in which the source gives them."""
    if order:
        return df, list(order)
    if POS in df.columns:
        return df, [POS]
    return df.withColumn(POS, F.monotonically_increasing_id()), [POS]


def _loose(node) -> bool:
    """Whether a plan makes ids from partitions over rows that are dealt to them anew by every job."""
    children, made = node.children(), node.expressions()
    below = [children.apply(i) for i in range(children.size())]
    if any(not made.apply(i).deterministic() for i in range(made.size())) and any(map(_dealt, below)):
        return True
    return any(map(_loose, below))


def _dealt(node) -> bool:
    children = node.children()
    return node.nodeName() not in IN_PLACE or any(_dealt(children.apply(i)) for i in range(children.size()))


def steady(df: DataFrame) -> DataFrame:
    """The frame, for what reads it in several branches or jobs.

    A scan id over a sort, join or other shuffle is another one in each of them, as bounds are sampled
    and partitions merged by what a branch reads; such a frame is written once and read from there.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.deterministic() or not _loose(plan):
        return df
    void = [c for c, t in df.dtypes if t == "void"]  # no column of a file
    kept = spool(df.drop(*void))
    return kept.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns]) if void else kept


def key_of(order: Sequence[str]) -> Column:
    """One comparable value of the order keys."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _tree(key: Column, bounds: list, low: int, high: int) -> Column:
    """Number of bounds at or under the key, by halving."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key >= bounds[mid], _tree(key, bounds, mid + 1, high)).otherwise(_tree(key, bounds, low, mid))


def range_bounds(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> list[Column]:
    """Bounds that cut the rows into ranges of similar size."""
    keys = df.select(*order)
    n = keys.count()
    parts = min(max(n // RANGE_ROWS, 1), MAX_RANGES) if ranges is None else ranges
    if parts < 2:
        return []
    every = max(n // (parts * PER_RANGE), 1)
    picked = keys.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).distinct()
    rows = sorted((tuple(r) for r in picked.collect() if all(v is not None and v == v for v in r)))
    if not rows:
        return []
    cuts = sorted({rows[len(rows) * i // parts] for i in range(1, parts)})
    return [F.struct(*[F.lit(v).alias(o) for v, o in zip(c, order)]) if len(order) > 1 else F.lit(c[0]) for c in cuts]


def with_range(df: DataFrame, order: Sequence[str], bounds: list[Column]) -> DataFrame:
    return df.withColumn(RANGE, _tree(key_of(order), bounds, 0, len(bounds)) if bounds else F.lit(0))


def with_ordinals(df: DataFrame, order: Sequence[str], ranges: int | None = None, weight: Column | None = None) -> DataFrame:
    """The frame with ORDINAL: 0, 1, 2, … in order, or the sum of the whole weights before the row."""
    bounds = range_bounds(df, order, ranges)
    # sizes and rows are two branches
    ranged = with_range(steady(df) if bounds else df, order, bounds)
    within = W.partitionBy(RANGE).orderBy(*order)
    if weight is None:
        own = F.row_number().over(within).cast("bigint") - 1
    else:
        own = F.coalesce(F.sum(weight).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    numbered = ranged.withColumn(ORDINAL, own)
    if not bounds:
        return numbered.drop(RANGE)
    # one row per range
    sizes = ranged.groupBy(RANGE).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__n"))
    before = sizes.select(RANGE, F.coalesce(F.sum("__n").over(W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return numbered.join(F.broadcast(before), RANGE).withColumn(ORDINAL, F.col(ORDINAL) + F.col("__before")).drop(RANGE, "__before")


def carry(df: DataFrame, order: Sequence[str], values: dict[str, Column], ranges: int | None = None, partition: Sequence[str] = ()) -> DataFrame:
    """For each name, the last non-null of its column up to the row, across ranges."""
    if partition:
        upto = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumns({n: F.last(v, ignorenulls=True).over(upto) for n, v in values.items()})
    bounds = range_bounds(df, order, ranges)
    ranged = with_range(steady(df) if bounds else df, order, bounds)
    upto = W.partitionBy(RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ranged.withColumns({f"__c{i}": F.last(v, ignorenulls=True).over(upto) for i, v in enumerate(values.values())})
    if not bounds:
        return local.withColumns({n: F.col(f"__c{i}") for i, n in enumerate(values)}).drop(RANGE, *[f"__c{i}" for i in range(len(values))])
    # one row per range
    lasts = ranged.groupBy(RANGE).agg(*[F.max_by(F.when(v.isNotNull(), F.struct(v.alias("v"))), F.when(v.isNotNull(), key_of(order))).alias(f"__l{i}") for i, v in enumerate(values.values())])
    before = W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select(RANGE, *[F.last(F.col(f"__l{i}"), ignorenulls=True).over(before)["v"].alias(f"__in{i}") for i in range(len(values))])
    out = local.join(F.broadcast(carried), RANGE, "left")
    out = out.withColumns({n: F.coalesce(f"__c{i}", f"__in{i}") for i, n in enumerate(values)})
    return out.drop(RANGE, *[f"__{p}{i}" for i in range(len(values)) for p in ("c", "in")])
