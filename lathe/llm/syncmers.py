"""Document fingerprints from closed syncmers over words.

A window of K words is kept if the smallest of its S-word hashes stands at one of
its two ends.  Whether a window is kept depends on nothing outside it, so an edit
disturbs only the windows that touch it, and the kept windows are anchors that
match by position in any text that shares the passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, key_blocks, key_stats, spool

K = 6
S = 2
#: Documents that a block of neighbours holds on average.
BLOCK = 5_000
#: Repeated keys up to which they are broadcast (8 bytes each).
SMALL = 1_000_000


def syncmers(text: Column, k: int = K, s: int = S) -> Column:
    """Hashes of the closed syncmers in text order.  Fewer than k words: one hash of all; none: of the text; empty or null: none."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    inner = k - s + 1

    def pick(h: Column) -> Column:
        def chosen(g: Column) -> Column:
            # the smallest is at an end: no inner one is smaller than both ends
            ends = lambda i: F.least(F.get(g, i - 1), F.get(g, i + (inner - 2)))
            between = lambda i: F.least(F.lit(2**63 - 1), *[F.get(g, i + (j - 1)) for j in range(1, inner - 1)])
            at = F.filter(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: ends(i) <= between(i))
            return F.transform(at, lambda i: F.xxhash64(F.slice(h, i, F.lit(k))))

        grams = F.transform(F.sequence(F.lit(1), F.size(h) - (s - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(s))))
        whole = F.array(F.xxhash64(h))
        return F.when(F.size(h) >= k, F.transform(F.array(grams), chosen)[0]).when(F.size(h) > 0, whole)

    hashes = F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), pick)[0]
    return F.coalesce(hashes, F.when(F.length(text) > 0, F.array(F.xxhash64(text))), F.array().cast("array<bigint>"))


def as_text(prints: Column) -> Column:
    """Eight hex digits by anchor, in text order."""
    return F.array_join(F.transform(prints, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), " ")


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two fingerprints as sets; 1 for two empty ones."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def _in_sequence(docs: DataFrame, made) -> DataFrame:
    """As with_next, for keys that are all different.

    The rows are dealt once, by blocks of neighbouring keys; a block's last row meets a copy of the first row of the next block.
    """
    block = key_blocks(docs.agg(*key_stats()).first(), BLOCK).alias("c")
    firsts = docs.groupBy(block).agg(F.max("k").alias("fk"))
    falling = W.orderBy(F.col("c").desc())
    # one row per block
    target = F.coalesce(F.lag("c").over(falling), F.min("c").over(W.partitionBy()))
    firsts = firsts.select("c", "fk", target.alias("target"))
    ghosts = docs.withColumn("c", block).join(F.broadcast(firsts), ["c"]).where(F.col("k").eqNullSafe(F.col("fk")))
    rows = docs.select("k", "t", block, F.lit(0).alias("ghost")).unionByName(ghosts.select("k", "t", F.col("target").alias("c"), F.lit(1).alias("ghost")))
    order = W.partitionBy("c").orderBy("ghost", F.col("k").desc_nulls_last())
    own = rows.repartitionByRange(F.col("c")).withColumn("own", made(F.col("t")))
    return own.withColumn("after", F.lead("own").over(order)).where("ghost = 0").select("k", "own", "after")


def with_next(docs: DataFrame, key: str, made) -> DataFrame:
    """Every row with the struct ``made`` gives of it, as ``own``, and of the document after it in descending key, as ``after``.

    Null keys come last; the document after the last is the first.  Rows with one key are
    all followed by the document of the next key; of that key's rows the largest text stands for it.
    ``docs`` has the columns k (integer) and t.  The rows of keys that repeat
    need no order among them: one stands in the sequence and the others get its successor by a
    join on the key, which is split where a key has many rows.
    """
    repeats = spool(docs.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("k").alias("rk")))
    n = repeats.count()
    if not n:
        return _in_sequence(docs, made)
    small = F.broadcast(repeats) if n <= SMALL else repeats
    same = F.col("k").eqNullSafe(F.col("rk"))
    again, single = docs.join(small, same, "left_semi"), docs.join(small, same, "left_anti")
    line = spool(_in_sequence(single.unionByName(again.groupBy("k").agg(F.max("t").alias("t"))), made))
    after = line.join(small, same, "left_semi").select(F.col("k").alias("rk"), "after")
    return line.join(small, same, "left_anti").unionByName(again.withColumn("own", made(F.col("t"))).join(after, same).select("k", "own", "after"))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprint every text, the text with its last third overwritten from the next document, and compare.

    Returns one row per input row: key, n_chars, edited (text), prints and edited_prints
    (arrays of hashes in text order), near_edited, near_next.  A null text counts as
    empty, an empty text has no prints; a lone document follows itself; repeated rows
    repeat, and all rows of one key have the same next document; texts of any length count whole;
    an empty table gives no rows; other columns are left out.  The key is an integer.
    """
    chosen = docs.select(docs[key].cast("bigint").alias("k"), F.coalesce(docs[text], F.lit("")).alias("t"))
    both = with_next(chosen, "k", lambda t: F.struct(t.alias("text"), syncmers(t).alias("prints")))
    n = F.length("own.text")
    third = F.floor(n / 3).cast("int")
    edited = both.select(
        "k", n.cast("bigint").alias("n_chars"), F.col("own.prints").alias("prints"), F.col("after.prints").alias("next_prints"),
        F.concat(F.substring(F.col("own.text"), F.lit(1), n - third), F.substring(F.col("after.text"), F.lit(1), third)).alias("edited"),
    )
    printed = edited.withColumn("edited_prints", syncmers(F.col("edited")))
    return printed.select(
        F.col("k").alias(key), "n_chars", "edited", "prints", "edited_prints",
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"), likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )
