"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The windows of all benchmark items form a hash set that every task holds; the word
windows of each training text are hashed and looked up, hits are verified on the
words themselves, and the report or the cut follows in the same row.  The set is
shipped as it is only while it has MAX_SET windows at most.  Beyond that tasks hold a bitmap of
the hashes, of BITS bits a window; what it lets through is joined with the windows, and only
texts with candidates take part in that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, ascii_lower, unwrap, wrap

WINDOW = 8
#: Windows that a task may hold as a set (about 100 bytes each); they stand in the plan, which the driver parses.
MAX_SET = 50_000
#: Bits of the bitmap for a window, and most of them in 64-bit words (128 MB): a fuller bitmap lets more through, never less.
BITS, MAX_WORDS = 32, 1 << 24
#: One word with the separators before it, in a text as it stands, and what follows the last word.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TAIL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z"
HIT = "array<struct<pos:int,len:int,gram:string>>"


def word_array(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _windows_sql(words: str, hashes: str, length: int, keep: str) -> str:
    """Windows of one length whose position i passes ``keep``."""
    return (
        f"if(size({words}) >= {length}, transform(filter(sequence(1, size({words}) - {length - 1}), i -> {keep.format(h=f'xxhash64(slice({hashes}, i, {length}))')}), "
        f"i -> named_struct('pos', i, 'len', {length}, 'gram', array_join(slice({words}, i, {length}), ' '))), cast(array() as {HIT}))"
    )


def benchmark_windows(benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Distinct windows of all items: len, h (hash), gram, items.  Items without words have none; an item with a null id has windows but is in no items."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), word_array(F.col(text)).alias("w")).where("size(w) > 0")
    at = words.selectExpr(
        "item", f"least({window}, size(w)) as len", "w", "explode(sequence(1, size(w) - least({0}, size(w)) + 1)) as i".format(window)
    ).selectExpr("item", "len", "slice(w, i, len) as g")
    return at.groupBy("len", F.expr("xxhash64(transform(g, x -> xxhash64(x)))").alias("h"), F.array_join("g", " ").alias("gram")).agg(F.collect_set("item").alias("items"))


class Benchmark:
    """The window set of a benchmark, built once and used by report and removal."""

    def __init__(self, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW):
        self.windows = Scratch(benchmark.sparkSession)(benchmark_windows(benchmark, text, item, window))
        counts = self.windows.groupBy("len").agg(F.count(F.lit(1)).alias("n")).orderBy("len").collect()  # at most ``window`` rows
        self.lengths, self.size = [r["len"] for r in counts], sum(r["n"] for r in counts)
        self.sets: dict[int, list] = {}
        if self.size <= MAX_SET:
            for r in self.windows.select("len", "h", "gram").collect():
                self.sets.setdefault(r["len"], []).append((r["h"], r["gram"]))

    def bitmap(self) -> DataFrame:
        """One row: _bits, the hashes of all windows as bits of an array of 64-bit words."""
        n = min(max(self.size * BITS // 64, 1), MAX_WORDS)
        place = F.pmod(F.shiftright("h", 6), F.lit(n)).alias("w")
        some = self.windows.groupBy(place).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(h, 64) as int))")).alias("b"))
        every = self.windows.sparkSession.range(n).select(F.col("id").alias("w")).join(some, "w", "left")
        return every.agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("bigint")).alias("b")))).alias("s")).select(F.col("s.b").alias("_bits"))

    def hits(self, docs: DataFrame, text: str) -> DataFrame:
        """docs with _hits: struct(n_words, hits); each hit is a window verified on its words."""
        words = docs.withColumn("_words", word_array(F.col(text)))
        if not self.lengths:
            return words.withColumn("_hits", F.struct(F.size("_words").cast("bigint").alias("n_words"), F.array().cast(HIT).alias("hits"))).drop("_words")
        if self.sets:
            keeps = {n: f"{{h}} in ({','.join(f'{h}L' for h in sorted({h for h, _ in pairs}))})" for n, pairs in self.sets.items()}
            grams = ",".join("'" + g.replace("\\", "\\\\").replace("'", "\\'") + "'" for pairs in self.sets.values() for _, g in pairs)
            verified = f"filter({{all}}, x -> x.gram in ({grams}))"
            return words.withColumn("_hits", F.expr(self._found(keeps, verified))).drop("_words")
        bit = "getbit(_bits[cast(pmod(shiftright(v, 6), size(_bits)) as int)], cast(pmod(v, 64) as int)) = 1"
        keeps = {n: f"exists(array({{h}}), v -> {bit})" for n in self.lengths}
        # one value, of MAX_WORDS at most
        at = words.withColumn("_bits", self.bitmap().scalar()).withColumn("_hits", F.expr(self._found(keeps, "{all}"))).drop("_words", "_bits")
        # through a generator of one row, so that both parts take the candidates instead of finding them again
        at = at.withColumn("_hits", F.explode_outer(F.array("_hits"))).withColumn("_th", F.xxhash64(text))
        some = F.size("_hits.hits") > 0
        asked = at.where(some).select("_th", F.explode("_hits.hits").alias("c")).select("_th", "c.len", "c.gram").distinct()
        true = asked.join(self.windows.select("len", "gram"), ["len", "gram"]).groupBy("_th").agg(F.collect_set("gram").alias("_g"))
        met = at.where(some).join(true, "_th", "left")
        kept = F.filter("_hits.hits", lambda x: F.coalesce(F.array_contains("_g", x["gram"]), F.lit(False)))
        met = met.withColumn("_hits", F.struct(F.col("_hits.n_words").alias("n_words"), kept.alias("hits"))).drop("_g")
        return at.where(~some).unionByName(met).drop("_th")

    def _found(self, keeps: dict[int, str], verified: str) -> str:
        every = ", ".join(_windows_sql("ws", "h", n, keeps[n]) for n in self.lengths)
        body = f"named_struct('n_words', cast(size(ws) as bigint), 'hits', {verified.format(all=f'concat({every})')})"
        return f"transform(array(_words), ws -> transform(array(transform(ws, x -> xxhash64(x))), h -> {body})[0])[0]"


def _covered(hits: Column) -> Column:
    """Words inside any window."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, x: F.struct(
        F.greatest(a["end"], x["pos"] + x["len"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(a["end"], x["pos"]))).alias("n"),
    )
    return F.aggregate(F.array_sort(hits), start, step)["n"]


def contamination_report(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, least_items: int = 2) -> DataFrame:
    """Which texts hold benchmark windows.

    Returns one row per input row: key, n_words, n_hit (words inside a window),
    n_items, items (sorted item ids), contaminated.  Null and empty texts have no words
    and no hits, as has every text if the benchmark is empty; repeated rows repeat;
    other columns are left out; texts of any length are searched whole.  A benchmark row with a null id counts hit words, but is no item.
    """
    bench = Benchmark(benchmark, window=window)
    found = bench.hits(docs.select(docs[key].alias("k"), docs[text].alias("t")), "t")
    # the text does not pass through the explode: a number stands for the row
    rows = found.select("k", F.monotonically_increasing_id().alias("r"), "_hits.n_words", F.expr("_hits.hits").alias("hits")).select("k", "r", "n_words", F.explode_outer("hits").alias("hit"))
    items = bench.windows.select(F.col("len").alias("l"), F.col("gram").alias("g"), "items")
    items = F.broadcast(items) if bench.size <= MAX_SET else items
    known = rows.join(items, (F.col("hit.len") == F.col("l")) & (F.col("hit.gram") == F.col("g")), "left")
    # a row's hits are bounded by its own length
    grouped = known.groupBy("k", "r", "n_words").agg(
        F.collect_list("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    n_items = F.size("items").cast("bigint")
    return grouped.select(F.col("k").alias(key), "n_words", _covered(F.col("hits")).alias("n_hit"), n_items.alias("n_items"), "items", (n_items >= least_items).alias("contaminated"))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, most_hit: float = 0.5) -> DataFrame:
    """Cut benchmark passages out of the texts; drop documents of which more than ``most_hit`` is hit.

    The columns of docs stay as they are, apart from the text of documents with
    hits, which loses every word inside a window with the separators before it.
    Texts without hits, nulls and empty texts pass unchanged, as do all if the benchmark is empty; repeated rows
    repeat; texts of any length are searched whole.
    """
    found = Benchmark(benchmark, window=window).hits(wrap(docs, text), "_t")
    # through a generator of one row, so that the filter and the new text take the hits instead of finding them again
    found = found.select("_row", "_t", F.explode_outer(F.array("_hits")).alias("_hits"))
    n = F.size("_hits.hits")
    kept = found.where((n == 0) | (_covered(F.col("_hits.hits")) <= most_hit * F.col("_hits.n_words")))
    pieces = F.regexp_extract_all(F.col("_t"), F.lit(PIECE), F.lit(0))
    clear = F.filter(pieces, lambda p, i: ~F.exists("_hits.hits", lambda x: (i + 1 >= x["pos"]) & (i + 1 < x["pos"] + x["len"])))
    cut_text = F.concat(F.array_join(clear, ""), F.regexp_extract(F.col("_t"), TAIL, 0))
    return unwrap(kept, docs.columns, text, F.when(n > 0, cut_text).otherwise(F.col("_t")))
