"""Filling in missing values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.operators import position
from lathe.operators.naming import require
from lathe.operators.predicates import compare, disjunction, literal

METHODS = ("carry forward", "mean", "mode", "nearest neighbour")
#: Rows that the exact nearest-neighbour method takes: it is sequential by definition.
EXACT_ROWS = 100_000
#: Distinct donors up to which they are broadcast, where the one-shot method has several sources and compares every distinct incomplete row with all of them.
DONORS = 200_000


def is_missing(df: DataFrame, column: str, missing: Iterable = (None,)) -> Column:
    """Whether a column has one of the sentinels; only None by default."""
    return disjunction([compare((F.col(f"`{column}`"), df.schema[column].dataType), "==", literal(m)) for m in missing])


def impute(df: DataFrame, targets: str | Sequence[str], missing: Iterable | None = None, method: str = "carry forward", sources: Sequence[str] | None = None, order: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """The table with the missing values of ``targets`` filled in.

    carry forward: the last value before, in row order.  mean, mode: of the column (a
    mode that ties is the smallest).  nearest neighbour: the value of the most similar
    row by ``sources``; by default every row is answered from the rows as given, with
    ``exact`` rows are filled one after the other and serve later ones.
    """
    targets = [targets] if isinstance(targets, str) else list(targets)
    require(df.columns, targets)
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    missing = [None] if missing is None else list(missing) if isinstance(missing, (set, list, tuple, frozenset)) else [missing]
    present = {t: F.when(~is_missing(df, t, missing), F.col(f"`{t}`")) for t in targets}
    if method == "carry forward":
        df, order = position.ensure(df, order)
        return position.carry(df, order, present)
    if method == "nearest neighbour":
        sources = [c for c in df.columns if not c.startswith("__")] if sources is None else list(sources)
        require(df.columns, sources)
        df, order = position.ensure(df, order)
        return (_exact_neighbours if exact else _neighbours)(df, targets, sources, missing, order)
    row = df
    for t in targets:
        if method == "mean" and not isinstance(df.schema[t].dataType, T.NumericType):
            raise TypeError(f"{t!r} has no mean")
    known = df.select(*[present[t].alias(f"v{i}") for i, t in enumerate(targets)])
    fill = known.agg(*[F.avg(f"v{i}").alias(f"__f{i}") if method == "mean" else F.expr(f"mode() WITHIN GROUP (ORDER BY v{i})").alias(f"__f{i}") for i in range(len(targets))])
    row = df.crossJoin(F.broadcast(fill))  # one row
    return row.withColumns({t: F.when(is_missing(df, t, missing), F.col(f"__f{i}")).otherwise(F.col(f"`{t}`")) for i, t in enumerate(targets)}).drop(*[f"__f{i}" for i in range(len(targets))])


def _ranks(df: DataFrame, column: str, missing: list) -> DataFrame:
    """Distinct present values with their rank as a share of their number."""
    values = df.where(~is_missing(df, column, missing)).select(F.col(f"`{column}`").alias("v")).distinct()
    n = values.count()
    return position.with_ordinals(values, ["v"]).select("v", (F.col(position.ORDINAL) / F.lit(float(max(n, 1)))).alias("r"))


def _neighbours(df: DataFrame, targets: list[str], sources: list[str], missing: list, order: Sequence[str]) -> DataFrame:
    """One-shot: distinct incomplete rows against distinct donors, by normalised rank distance, then row order."""
    at = [f"__r{i}" for i in range(len(sources))]
    ranked = df
    for i, s in enumerate(sources):
        ranks = _ranks(df, s, missing).select(F.col("v").alias(f"__v{i}"), F.col("r").alias(at[i]))
        ranked = ranked.join(ranks, F.col(f"`{s}`") == F.col(f"__v{i}"), "left").drop(f"__v{i}")
    out = ranked
    vector = F.array(*at)
    for t in targets:
        gone = is_missing(ranked, t, missing)
        donors = ranked.where(~gone).groupBy(vector.alias("__d")).agg(F.min_by(F.struct(F.col(f"`{t}`").alias("v")), position.key_of(order)).alias("__val"), F.min(position.key_of(order)).alias("__p"))
        asked = ranked.where(gone).select(vector.alias("__a")).distinct()
        if len(sources) == 1:
            out = _filled(out, t, missing, vector, _nearest(asked, donors))
            continue
        far = F.aggregate(F.zip_with("__a", "__d", lambda a, d: F.when(a.isNull(), 0.0).when(d.isNull(), float("inf")).otherwise(F.abs(a - d))), F.lit(0.0), lambda x, y: x + y)
        # the nearest row in several ranks has to be compared with every donor: a set of questions against all rows
        donors = F.broadcast(donors) if donors.count() <= DONORS else donors
        best = asked.crossJoin(donors).groupBy("__a").agg(F.min_by("__val", F.struct(far.alias("far"), F.col("__p"))).alias("__val"))
        out = _filled(out, t, missing, vector, best)
    return out.drop(*at)


def _filled(df: DataFrame, target: str, missing: list, vector: Column, best: DataFrame) -> DataFrame:
    """The missing values of one column from (__a, __val)."""
    mine = df.withColumn("__mine", F.when(is_missing(df, target, missing), vector))
    best = best.select(F.col("__a").alias("__key"), "__val")
    joined = mine.join(best, F.col("__mine") == F.col("__key"), "left")
    return joined.withColumn(target, F.when(F.col("__val").isNotNull(), F.col("__val")["v"]).otherwise(F.col(f"`{target}`"))).drop("__mine", "__key", "__val")


def _nearest(asked: DataFrame, donors: DataFrame) -> DataFrame:
    """(__a, __val) by one rank: the donor at or below or the one above, whichever is nearer, then the earlier row.  A question without a rank takes the earliest donor."""
    rank = F.col("__d")[0]
    given = donors.select(rank.alias("r"), F.struct("__val", "__p", rank.alias("r")).alias("donor")).where("r is not null")
    both = asked.select(F.col("__a")[0].alias("r"), F.lit(1).alias("ask")).where("r is not null").unionByName(given.withColumn("ask", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("__n", -F.col("r"))
    below = position.carry(both, ["r", "ask"], {"low": F.col("donor")})
    # the other way round, with a donor of the same rank before the question in both
    answered = position.carry(below, ["__n", "ask"], {"high": F.col("donor")}).where("ask = 1")
    gap = lambda side: F.struct(F.abs(F.col(side)["r"] - F.col("r")).alias("far"), F.col(side)["__p"].alias("p"), F.col(side)["__val"].alias("v"))
    some = F.array_sort(F.filter(F.array(F.when(F.col("low").isNotNull(), gap("low")), F.when(F.col("high").isNotNull(), gap("high"))), lambda x: x.isNotNull()))
    # the earliest donor, for where no donor has a rank
    first = donors.agg(F.min_by("__val", "__p").alias("__val")).scalar()
    known = answered.select(F.array("r").alias("__a"), F.coalesce(F.get(some, 0)["v"], first).alias("__val"))
    return known.unionByName(asked.where(F.col("__a")[0].isNull()).select("__a", first.alias("__val")))


def _exact_neighbours(df: DataFrame, targets: list[str], sources: list[str], missing: list, order: Sequence[str]) -> DataFrame:
    """Row by row from the fewest missing values on; filled values serve later rows.  Runs in one process, on EXACT_ROWS rows at most."""
    columns = [c for c in df.columns if not c.startswith("__")]
    rows = [list(r) for r in df.orderBy(*order).select(*[f"`{c}`" for c in columns]).limit(EXACT_ROWS + 1).collect()]
    if len(rows) > EXACT_ROWS:
        raise ValueError(f"more than {EXACT_ROWS} rows; use the one-shot method")
    place = {c: i for i, c in enumerate(columns)}
    gone = lambda v: any(v is m if m is None else v == m for m in missing)

    def norms(column: str) -> list[float]:
        values = [r[place[column]] for r in rows]
        known = sorted({v for v in values if not gone(v)})
        rank = {v: i / len(known) for i, v in enumerate(known)}
        return [float("inf") if gone(v) else rank[v] for v in values]

    matrix = {s: norms(s) for s in sources}
    todo = sorted((sum(gone(r[place[s]]) for s in sources), i) for i, r in enumerate(rows) if any(gone(r[place[t]]) for t in targets))
    inf = float("inf")
    for _, i in todo:
        own = [(s, matrix[s][i]) for s in sources if matrix[s][i] != inf]
        near = sorted((sum(abs(v - matrix[s][j]) for s, v in own), j) for j in range(len(rows)) if j != i)
        for t in targets:
            if gone(rows[i][place[t]]):
                value = next((rows[j][place[t]] for _, j in near if not gone(rows[j][place[t]])), None)
                if value is not None:
                    rows[i][place[t]] = value
    schema = df.select(*[f"`{c}`" for c in columns]).schema
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], schema)
