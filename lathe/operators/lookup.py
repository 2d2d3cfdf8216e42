"""First-match joins: lookup (all or any of several criteria) and match (criteria by priority)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lathe.operators import position
from lathe.operators import predicates as P
from lathe.operators.naming import unique_names

FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
#: Bytes of the right side's criteria and positions up to which a pure theta lookup broadcasts them.
THETA_BYTES = 256 << 20
#: Right rows of one key over which a running minimum is cut into ranges inside the key.
HOT_ROWS = 1_000_000


def _parsed(left: DataFrame, right: DataFrame, criteria: Sequence[tuple]) -> list[tuple]:
    """(left column or None, left literal, op, right column or None, right literal); column names win over literals."""
    out = []
    for l, op, r in criteria:
        if not callable(op) and op not in ("in", "not in", *P.OPERATORS):
            raise ValueError(f"unknown operator {op!r}")
        lc = l if isinstance(l, str) and l in left.columns else None
        rc = r if isinstance(r, str) and r in right.columns else None
        out.append((lc, l, op, rc, r))
    return out


def _condition(left: DataFrame, right: DataFrame, item: tuple, l_names: dict[str, str], r_names: dict[str, str]) -> Column:
    lc, l, op, rc, r = item
    a = (F.col(l_names[lc]), left.schema[lc].dataType) if lc else P.literal(l)
    b = (F.col(r_names[rc]), right.schema[rc].dataType) if rc else P.literal(r)
    if callable(op):
        return P.call(op, [a[0], b[0]])
    if op == "not in":
        return P.negated(P.compare(a, "in", b))
    return P.compare(a, op, b)


def lookup(left: DataFrame, right: DataFrame, *criteria: tuple, all: bool = True, right_order: Sequence[str] | None = None) -> DataFrame:  # noqa: A002
    """For every left row the first right row, in right order, that meets all (or any) criteria; nulls where none does.

    Equality alone reduces the right side to its first row per key; equality with one
    range, or one range alone, takes a running minimum over the sorted range column;
    equality with more conditions is an equi-join with a residue.  Any of several is the
    least position of each alone.  Only what has no equality and is no single range, and
    a test alone that is neither, compares distinct left values with the right side.
    """
    right, order = position.ensure(right, right_order)
    visible = [c for c in right.columns if not c.startswith("__")]
    items = _parsed(left, right, criteria)
    l_visible = [c for c in left.columns if not c.startswith("__")]
    out_names = unique_names([*l_visible, *visible])
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(visible)])
    pos = position.key_of(order)
    equal = [i for i in items if i[2] == "==" and i[0] and i[3]]
    rest = [i for i in items if i not in equal]

    def finish(joined: DataFrame, found: str = "__row") -> DataFrame:
        return joined.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(l_visible, out_names)], *[F.col(found)[f"c{i}"].alias(n) for i, n in enumerate(out_names[len(l_visible) :])])

    def back(found: DataFrame, keys: list[str]) -> DataFrame:
        """Matches by left criteria values, joined to all left rows."""
        names = {k: f"__k{i}" for i, k in enumerate(keys)}
        renamed = found.select(*[F.col(f"`{k}`").alias(n) for k, n in names.items()], "__row")
        if not keys:
            return finish(left.join(F.broadcast(renamed), F.lit(True), "left"))  # one row at most
        return finish(left.join(renamed, P.conjunction([F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in names.items()]), "left"))

    if all and equal and not rest:
        keys = {i[3]: f"__q{n}" for n, i in enumerate(equal)}
        first = right.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in keys.items()]).agg(F.min_by(row, pos).alias("__row"))
        return finish(left.join(first, P.conjunction([F.col(f"`{i[0]}`").eqNullSafe(F.col(keys[i[3]])) for i in equal]), "left"))
    right = position.steady(right)  # positions are found in one branch, their rows in another
    rows = right.select(pos.alias("__at"), row.alias("__row"))
    if all and len(rest) == 1 and _is_range(left, right, rest[0]) and len({i[0] for i in items}) == len(items):
        keys = [i[0] for i in [*equal, *rest]]
        hits = _running(left, right, equal, rest[0], order).join(rows, "__at")
        return back(hits.select(*[F.col(n).alias(c) for n, c in zip([*[f"e{n}" for n in range(len(equal))], "v"], keys)], "__row"), keys)
    used = list(dict.fromkeys(i[0] for i in items if i[0]))
    l_names = {c: f"__k{i}" for i, c in enumerate(used)}
    r_names = {c: f"__v{i}" for i, c in enumerate(dict.fromkeys(i[3] for i in items if i[3]))}
    asked = left.select(*[F.col(f"`{c}`").alias(n) for c, n in l_names.items()]).distinct() if used else left.sparkSession.range(1).select(F.lit(1).alias("__one"))
    if items and (not all or len(items) == 1):
        best = asked
        for n, i in enumerate(items):
            alone = _alone(left, right, i, order).withColumnsRenamed({"v": f"__h{n}", "__at": f"__a{n}"})
            best = best.join(alone, F.col(l_names[i[0]]).eqNullSafe(F.col(f"__h{n}")), "left") if i[0] else best.join(F.broadcast(alone), F.lit(True), "left")
        found = [F.col(f"__a{n}") for n in range(len(items))]
        best = best.select(*asked.columns, (F.least(*found) if len(found) > 1 else found[0]).alias("__at")).where(F.col("__at").isNotNull())
    else:
        there = right.select(*[F.col(f"`{c}`").alias(n) for c, n in r_names.items()], pos.alias("__at"))
        condition = (P.conjunction if all else P.disjunction)([_condition(left, right, i, l_names, r_names) for i in items])
        if not equal and _bytes(there) <= THETA_BYTES:
            there = F.broadcast(there)
        # positions are compared, and rows join once they are known
        best = asked.join(there, condition).groupBy(*asked.columns).agg(F.min("__at").alias("__at"))
    best = best.join(rows, "__at")
    if not used:
        return back(best.select("__row"), [])
    return back(best.select(*[F.col(n).alias(c) for c, n in l_names.items()], "__row"), used)


def _bytes(df: DataFrame) -> int:
    """Bytes of all values, each with the 16 that a row and a field of it take about."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    width = F.lit(16 * (len(df.columns) + 1))
    for t in texts:
        width = width + t
    return df.agg(F.sum(width).alias("b")).first()["b"] or 0


def _is_range(left: DataFrame, right: DataFrame, item: tuple) -> bool:
    lc, _, op, rc, _ = item
    return not callable(op) and op in FLIP and bool(lc and rc) and P.kind_of(left.schema[lc].dataType) == P.kind_of(right.schema[rc].dataType) != "null"


def _alone(left: DataFrame, right: DataFrame, item: tuple, order: Sequence[str]) -> DataFrame:
    """First right position (__at) by distinct left values (v) for one criterion; one row for all where it has no left column."""
    lc, _, op, rc, _ = item
    if _is_range(left, right, item):
        return _running(left, right, [], item, order)
    at = F.min(position.key_of(order)).alias("__at")
    asked = left.select(F.col(f"`{lc}`").alias("v")).distinct() if lc else left.sparkSession.range(1).select(F.lit(1).alias("__one"))
    # of equal right values the first counts
    there = right.groupBy(F.col(f"`{rc}`").alias("w")).agg(at) if rc else right.agg(at)
    if op == "!=" and lc and rc and left.schema[lc].dataType == right.schema[rc].dataType:
        there = there.orderBy("__at").limit(2)  # a value differs from one of two
    if op != "==" and _bytes(there) <= THETA_BYTES:
        there = F.broadcast(there)
    return asked.join(there, _condition(left, right, item, {lc: "v"}, {rc: "w"})).groupBy(*asked.columns).agg(F.min("__at").alias("__at")).drop("__one")


def _running(left: DataFrame, right: DataFrame, equal: list[tuple], item: tuple, order: Sequence[str]) -> DataFrame:
    """First right position (__at) by distinct left values (e0, …, v), for equalities and one range: a running minimum in the range's direction."""
    lc, _, op, rc, _ = item
    up = op in ("<", "<=")  # left below right: everything from the value upwards
    keys = [(i[0], i[3]) for i in equal]
    pos = position.key_of(order)
    asked = left.select(*[F.col(f"`{l}`").alias(f"e{n}") for n, (l, _) in enumerate(keys)], F.col(f"`{lc}`").alias("v")).where("v is not null")
    there = right.select(*[F.col(f"`{r}`").alias(f"e{n}") for n, (_, r) in enumerate(keys)], F.col(f"`{rc}`").alias("v"), pos.alias("p")).where("v is not null")
    # values of two types are distinct in the wider one, in which they compare
    wide = asked.union(there.select(asked.columns)).schema
    asked = asked.select(*[F.col(c).cast(wide[c].dataType).alias(c) for c in asked.columns]).distinct()
    if not keys:
        there = there.groupBy("v").agg(F.min("p").alias("p"))  # of equal values the first counts, so none is on many rows
    both = asked.withColumn("p", F.lit(None).cast(there.schema["p"].dataType)).withColumn("ask", F.lit(1)).unionByName(there.withColumn("ask", F.lit(0)))
    # rows that count for an equal value come before the question, others after it
    rank = F.col("ask") if op in ("<=", ">=") else -F.col("ask")
    part = [F.col(f"e{n}") for n in range(len(keys))]
    hot = keys and not right.groupBy(*[f"`{r}`" for _, r in keys]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS).limit(1).isEmpty()
    if keys and not hot:
        seen = W.partitionBy(*part).orderBy(F.col("v").desc() if up else F.col("v").asc(), rank).rowsBetween(W.unboundedPreceding, W.currentRow)
        answered = both.withColumn("first", F.min("p").over(seen))
    else:
        bounds = position.range_bounds(both, ["v"])
        ranged = position.with_range(both, ["v"], bounds)
        seen = W.partitionBy(*part, position.RANGE).orderBy(F.col("v").desc() if up else F.col("v").asc(), rank).rowsBetween(W.unboundedPreceding, W.currentRow)
        answered = ranged.withColumn("first", F.min("p").over(seen))
        if bounds:
            # one row per range, or per key and range
            side = (W.partitionBy(*part) if part else W).orderBy(F.col(position.RANGE).desc() if up else F.col(position.RANGE).asc()).rowsBetween(W.unboundedPreceding, -1)
            carried = ranged.groupBy(*part, position.RANGE).agg(F.min("p").alias("m")).select(*part, position.RANGE, F.min("m").over(side).alias("m"))
            if part:
                carried = carried.select(*[F.col(f"e{n}").alias(f"c{n}") for n in range(len(keys))], F.col(position.RANGE).alias("__cr"), "m")
                same = P.conjunction([F.col(f"e{n}").eqNullSafe(F.col(f"c{n}")) for n in range(len(keys))] + [F.col(position.RANGE) == F.col("__cr")])
                answered = answered.join(carried, same).withColumn("first", F.least("first", "m"))
            else:
                answered = answered.join(F.broadcast(carried), position.RANGE).withColumn("first", F.least("first", "m"))
    return answered.where("ask = 1 and first is not null").select(*part, "v", F.col("first").alias("__at"))


def match(left: DataFrame, right: DataFrame, *criteria: tuple, keep_left: Sequence[str] | None = None, keep_right: Sequence[str] | None = None, right_order: Sequence[str] | None = None) -> DataFrame:
    """One right row at most for every left row: by the first criterion that finds one, its first row in right order.

    Criteria are equalities; null matches nothing; left rows without a match go.
    """
    right, order = position.ensure(right, right_order)
    keep_left = [c for c in left.columns if not c.startswith("__") and (keep_left is None or c in keep_left)]
    keep_right = [c for c in right.columns if not c.startswith("__") and (keep_right is None or c in keep_right)]
    pos = position.key_of(order)
    joined = left
    for n, (l, op, r) in enumerate(criteria):
        if op != "==":
            raise ValueError("match takes equalities")
        first = right.where(F.col(f"`{r}`").isNotNull()).groupBy(F.col(f"`{r}`").alias(f"__m{n}")).agg(
            F.min_by(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep_right)], F.lit(True).alias("hit")), pos).alias(f"__f{n}")
        )
        joined = joined.join(first, F.col(f"`{l}`") == F.col(f"__m{n}"), "left")
    found = F.coalesce(*[F.col(f"__f{n}") for n in range(len(criteria))])
    names = unique_names([*keep_left, *keep_right])
    return joined.withColumn("__row", found).where(F.col("__row").isNotNull()).select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep_left, names)], *[F.col("__row")[f"c{i}"].alias(n) for i, n in enumerate(names[len(keep_left) :])]
    )
