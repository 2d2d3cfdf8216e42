"""Mixing sources to target weights by entropy balancing.

Every source gets a token target by weight, no more than ``most`` times its size.
Document rates in (0, most) of least relative entropy that meet the token constraints
are exponentially tilted in the document's size: log(w / (most - w)) = lambda * size - log(most - 1).
The convex dual separates by source; distributed Newton steps, kept inside a
bracket, solve it on the histogram of sizes.  Rates are rounded into copies by
systematic sampling in size order inside bounded blocks, and the words that a
source then lacks or exceeds are settled by single documents, one per power of two.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import TOKEN, Scratch, repeated, spool, wrap

#: Documents that one block of the rounding holds on average.
BLOCK = 1_000
#: Rows up to which a table of sources is broadcast.
SMALL = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From rows (source, size, n rows of them): sid, source, source_size, n_docs, target.

    Weights repeat over the sources in code-point order, null last.  Filling stops at
    ``most`` times a source's size and what is left goes to the others by weight: the
    level theta with sum(min(cap, theta * weight)) = pool, found in order of cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    # one row per source from here on
    order = W.orderBy(F.col("source").asc_nulls_last())
    numbered = per.withColumn("sid", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = numbered.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rising = W.orderBy(F.col("cap") / F.col("w"), "sid")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    levels = capped.withColumn("level", level)
    theta = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "sid", "level"))).over(every)["level"]
    return levels.withColumn("theta", theta).select("sid", "source", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("theta") * F.col("w"), "cap")).alias("target"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _rate(most: float) -> Column:
    """Rate of a document: 0 and ``most`` where the target is at an end of its range.  Without tilt it is 1, or half of ``most`` where that is 1 at most."""
    plain = -math.log(most - 1) if most > 1 else 0.0
    tilt = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("lam") * F.col("size") / F.col("mean") + F.lit(plain)))
    return F.when(F.col("full"), F.lit(most)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.lit(most) / (1 + F.exp(-tilt)))


def solve_dual(histogram: DataFrame, sources: DataFrame, most: float, keep: Scratch, steps: int = 60, close: float = 1e-7) -> DataFrame:
    """Newton iterations on lambda by source over (sid, size, n); a step that leaves the bracket halves it instead."""
    state = keep(
        sources.where("source_size > 0").select(
            "sid", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"), (F.col("target") >= F.col("source_size") * most * (1 - 1e-12)).alias("full"),
            F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"),
        )
    )
    rows = state.count()
    for _ in range(steps):
        rate = _rate(most)
        slope = rate * (1 - rate / most) * F.col("size") / F.col("mean")
        both = histogram.join(_small(state, rows), "sid")
        # the state is the same in all rows of a source, so it passes through the aggregation
        sums = both.groupBy("sid", "target", "mean", "full", "lam", "lo", "hi").agg(F.sum(F.col("n") * F.col("size") * rate).alias("f"), F.sum(F.col("n") * F.col("size") * slope).alias("g"))
        gap = F.col("f") - F.col("target")
        moved = (
            sums.withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("miss", F.when(F.col("full") | (F.col("target") <= 0), 0.0).otherwise(F.abs(gap) / F.col("target")))
            .withColumn("newton", F.col("lam") - gap / F.greatest(F.col("g"), F.lit(1e-300)))
        )
        half = F.when((F.col("lo") > -1e6) & (F.col("hi") < 1e6), (F.col("lo") + F.col("hi")) / 2).when(gap > 0, F.col("lam") * 2 - 1).otherwise(F.col("lam") * 2 + 1)
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi")) & (F.abs(F.col("newton") - F.col("lam")) <= 4 + F.abs("lam"))
        moved = moved.withColumn("lam", F.when(F.col("miss") <= close, F.col("lam")).when(inside, F.col("newton")).otherwise(half))
        state = keep(moved.select("sid", "target", "mean", "full", "lam", "lo", "hi", "miss"))
        if state.where(F.col("miss") > close).isEmpty():
            break
    return state


def rounded(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Copies for every kind of row (k, source, th, size): with source_size, target, rate, n (its rows) and total (the copies of all of them, 0 to most * n)."""
    spark = sized.sparkSession
    keep = Scratch(spark)
    sized = keep(sized.groupBy("k", "source", "th", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = keep(source_targets(sized, weights, share, most))
    n_sources = sources.count()
    named = sources.select(F.col("source").alias("_source"), "sid", "source_size", "n_docs")
    numbered = sized.join(_small(named, n_sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    histogram = keep(numbered.where("size > 0").groupBy("sid", "size").agg(F.sum("n").alias("n")))
    dual = solve_dual(histogram, sources, most, keep)
    state = sources.select("sid", "target").join(dual.drop("target"), "sid", "left")
    rated = numbered.join(_small(state, n_sources), "sid").withColumn("rate", F.when(F.col("size") == 0, 0.0).otherwise(_rate(most)))
    # systematic rounding in size order, in blocks that stay bounded for any source; repeated rows are one row of it
    draw = F.xxhash64("k", "th", F.lit("mix"))
    block = F.pmod(draw, F.ceil(F.col("n_docs") / F.lit(BLOCK)).cast("bigint"))
    offset = F.pmod(F.xxhash64("sid", "block"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    order = W.partitionBy("sid", "block").orderBy(F.col("size").desc(), "draw", "k", "th")
    upto = F.floor(F.sum(F.col("rate") * F.col("n")).over(order.rowsBetween(W.unboundedPreceding, 0)) + offset)
    in_blocks = rated.withColumn("draw", draw).withColumn("block", block).withColumn("upto", upto)
    total = F.least(F.greatest(F.col("upto") - F.coalesce(F.lag("upto").over(order), F.lit(0)), F.lit(0)), F.floor(F.lit(most) * F.col("n")))
    first = keep(in_blocks.withColumn("total", F.when(F.col("size") > 0, total).otherwise(0).cast("bigint")).select("k", "source", "th", "sid", "size", "source_size", "target", "rate", "n", "total", "draw"))
    # words still missing or too many, settled from large to small by one document of each power of two
    rest = first.groupBy("sid").agg((F.first("target") - F.sum(F.col("total") * F.col("size"))).alias("rest"))
    can = F.when(F.col("rest") > 0, F.col("total") < F.floor(F.lit(most) * F.col("n"))).otherwise(F.col("total") > 0) & (F.col("size") > 0) & (F.col("size") <= F.abs("rest"))
    best = first.join(_small(rest, n_sources), "sid").where(can).groupBy("sid", "rest", F.floor(F.log2("size")).alias("power")).agg(F.max(F.struct("size", "draw", "k", "th")).alias("b"))
    ladder = best.groupBy("sid", "rest").agg(F.sort_array(F.collect_list("b"), asc=False).alias("ladder"))
    element = "struct<size:bigint,draw:bigint,k:%s,th:bigint>" % dict(first.dtypes)["k"]
    picked = ladder.withColumn(
        "p",
        F.expr(
            f"aggregate(ladder, named_struct('left', abs(rest), 'who', cast(array() as array<{element}>)), "
            "(a, x) -> if(x.size <= a.left, named_struct('left', a.left - x.size, 'who', concat(a.who, array(x))), a)).who"
        ),
    ).select("sid", F.signum("rest").cast("bigint").alias("step"), F.explode("p").alias("b"))
    fixes = picked.select(F.col("b.k").alias("fk"), F.col("b.th").alias("fth"), F.col("sid").alias("fsid"), F.col("b.size").alias("fsize"), "step")
    same = F.col("k").eqNullSafe(F.col("fk")) & F.col("th").eqNullSafe(F.col("fth")) & (F.col("sid") == F.col("fsid")) & (F.col("size") == F.col("fsize"))
    settled = first.join(F.broadcast(fixes) if n_sources * 64 <= SMALL else fixes, same, "left")
    out = spool(settled.select("k", "source", "th", "size", "source_size", "target", "rate", "n", (F.col("total") + F.coalesce(F.col("step"), F.lit(0))).alias("total")))
    keep.clear()
    return out


def words(text: Column) -> Column:
    """Number of tokens; null has none."""
    n = F.coalesce(F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), F.lit(0)).cast("bigint")
    return F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(n)


def _shared_out(kinds: DataFrame, columns: list[str], most: int) -> DataFrame:
    """A row for each of the ``n`` rows of its kind, ``most`` at most, with its share of the copies: equal within one, the first ones more."""
    n, total = F.col("n"), F.col("total")
    own = F.floor(total / n).cast("bigint") + (F.col("_i") < F.pmod(total, n)).cast("bigint")
    if most <= 1:
        return kinds.select(*columns, total.alias("copies"))
    return repeated(kinds, "n", most).select(*columns, own.alias("copies"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Copies of every document for a mix in which each source comes near its token target.

    Returns one row per input row: key, size (tokens), source_size, target (of the
    source), rate, copies (0 to most), taken (copies * size).  Null and empty texts have
    size 0 and take nothing; a null source is a source, last in order; repeated rows
    are documents of their own, whose copies differ by one at most; an empty table gives no rows; texts of any
    length count whole; other columns are left out.  Which documents of
    equal size are taken depends on a hash of their key and text, so reruns agree.
    """
    base = docs.select(docs[key].alias("k"), docs[source].alias("source"), docs[text].alias("t"))
    kinds = rounded(base.select("k", "source", F.xxhash64("t").alias("th"), words(F.col("t")).alias("size")), weights, share, most)
    most_rows = kinds.agg(F.max("n").alias("n")).first()["n"] or 0
    rows = _shared_out(kinds, ["k", "size", "source_size", "target", "rate"], most_rows)
    return rows.select(F.col("k").alias(key), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", copies: str = "copies", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows that the mix takes, with all their columns and ``copies``, which replaces a column of that name.

    Rows are told apart by key, source and text.  Rows that agree in all three are
    repeats of one document: of their other columns those of one of them stand for all.
    Null and empty texts are never taken; what else holds is said in ``mix``.
    """
    row = wrap(docs, text).withColumn("_k", F.col("_row").getField(key)).withColumn("_s", F.col("_row").getField(source)).withColumn("_th", F.xxhash64("_t"))
    kinds = rounded(row.select(F.col("_k").alias("k"), F.col("_s").alias("source"), F.col("_th").alias("th"), words(F.col("_t")).alias("size")), weights, share, most)
    taken = kinds.where("total > 0").select("k", "source", "th", "n", "total")
    same = F.col("_k").eqNullSafe(F.col("k")) & F.col("_s").eqNullSafe(F.col("source")) & (F.col("_th") == F.col("th"))
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != copies]
    once = row.join(taken.where("n = 1"), same).select(*columns, F.col("total").alias(copies))
    again = taken.where("n > 1")
    many = again.agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most")).first()
    if not many["kinds"]:
        return once
    met = row.join(_small(again, many["kinds"]), same).groupBy("_k", "_s", "_th").agg(*[F.first(c).alias(c) for c in ("_row", "n", "total")])
    return once.unionByName(_shared_out(met, ["_row"], many["most"]).where("copies > 0").select(*columns, F.col("copies").alias(copies)))
