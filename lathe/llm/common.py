"""What several corpus operators share: tokenisers, table access, lineage cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lathe.scratch import Scratch as Scratch
from lathe.scratch import spool as spool

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A word of the word-level operators, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A token between ASCII blanks.
TOKEN = r"[^\x20\x09-\x0D]+"

#: Bytes outside the words of WORD become blanks, A-Z become a-z; bytes of other characters stay.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else.  Pure ASCII takes the engine's fast path."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: str | None) -> list[bytes]:
    """The words of WORD as UTF-8, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes that one Arrow batch brings into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def grid_quantile(df: DataFrame, by: list[str], value: Column, shares: dict[str, float], step: float) -> DataFrame:
    """By group and name, the place floor(value / step) that holds the share: the smallest with at least that share of the group's rows at or under it.

    Counts by place are exact and the same in every run.  One row per group and place is
    windowed, so a group is as large as the range of its values in steps.
    """
    places = df.where(value.isNotNull()).groupBy(*by, F.floor(value / F.lit(step)).cast("bigint").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    part = W.partitionBy(*by)
    upto = places.withColumn("_upto", F.sum("_n").over(part.orderBy("_at"))).withColumn("_all", F.sum("_n").over(part))
    return upto.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") >= F.lit(s) * F.col("_all"), F.col("_at"))).alias(n) for n, s in shares.items()])


#: Rows that one row is repeated into by one task.
REPEAT = 100_000


def repeated(df: DataFrame, times: str, most: int) -> DataFrame:
    """Every row ``times`` times, with its number from 0 in ``_i``.  Long repeats are dealt in parts, so that no task makes them alone; ``most`` is the largest."""
    part = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / F.lit(REPEAT)).cast("bigint"))
    parts = df.where(F.col(times) > 0).withColumn("_part", F.explode(part))
    if most > REPEAT:
        parts = parts.repartition(F.xxhash64(*parts.columns))
    first = F.col("_part") * F.lit(REPEAT)
    return parts.withColumn("_i", F.explode(F.sequence(first, F.least(first + F.lit(REPEAT), F.col(times)) - 1))).drop("_part")


#: Most blocks of neighbouring keys, and most intervals that quantiles cut.
MAX_BLOCKS, INTERVALS = 50_000, 256


def key_blocks(stats: Row, rows: int) -> Column:
    """A number that rises with the integer k, for blocks of ``rows`` rows on average; null keys have -1.

    ``stats`` is the row of ``key_stats``: quantiles cut the keys into intervals, equal widths
    cut those into blocks, and there are MAX_BLOCKS at most.
    """
    if stats["lo"] is None:
        return F.lit(-1).cast("bigint")
    blocks = min(max(stats["n"] // rows, 1), MAX_BLOCKS)
    marks = stats["q"][:: -(-INTERVALS // min(blocks, INTERVALS))]
    starts = sorted({stats["lo"], *(m for m in marks if m < stats["hi"])})
    each = -(-blocks // len(starts))
    widths = [max(-(-(b - a) // each), 1) for a, b in zip(starts, [*starts[1:], stats["hi"] + 1])]

    def interval(low: int, high: int) -> Column:
        """By halving: the last start at or under the key."""
        if low == high:
            return F.struct(F.lit(low).cast("bigint").alias("i"), F.lit(starts[low]).cast("bigint").alias("a"), F.lit(widths[low]).cast("bigint").alias("w"))
        mid = (low + high + 1) // 2
        return F.when(F.col("k") >= starts[mid], interval(mid, high)).otherwise(interval(low, mid - 1))

    at = let(interval(0, len(starts) - 1), lambda x: x["i"] * each + F.least(F.lit(each - 1).cast("bigint"), F.floor((F.col("k") - x["a"]) / x["w"])))
    return F.coalesce(F.when(F.col("k").isNotNull(), at), F.lit(-1).cast("bigint"))


def key_stats(*more: Column) -> list[Column]:
    """Aggregates that key_blocks needs: smallest, largest and number of k, and its quantiles in INTERVALS."""
    quantiles = F.percentile_approx("k", [i / INTERVALS for i in range(INTERVALS)], 4 * INTERVALS + 100)
    return [F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n"), quantiles.alias("q"), *more]


def wrap(docs: DataFrame, text: str) -> DataFrame:
    """Only _row (all columns) and _t (the text): no column of docs can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_t"))


def unwrap(df: DataFrame, columns: list[str], text: str, new: Column, **added: Column) -> DataFrame:
    """The columns again, with the new text; an added column takes the place of one with its name."""
    kept = [new.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in columns if c not in added]
    return df.select(*kept, *[c.alias(n) for n, c in added.items()])
