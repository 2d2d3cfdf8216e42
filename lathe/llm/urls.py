"""URL filters: rules first, then a character language-model ratio.

Two variable-order Markov models, one of accepted and one of rejected URLs, give
every URL a length-normalised log-likelihood difference; a threshold calibrated
on labelled URLs that neither model saw turns it into a verdict.  Counts stay in
distributed tables and grow with the input: blocks of URLs ask for their distinct
n-grams, joins evaluate each order, and the answers meet their block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, grid_quantile, small_batches, spool

# The rules of the query, as (string, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Words that mark a host as unwanted when the models are trained.
BAD_HOST_WORDS = ("casino", "bets", "pills", "porn", "viagra", "ads-", "adserv", "loan", "warez")
ORDER = 5
CLASSES = ("allow", "block")
#: A class backs off from contexts that it has seen fewer times, at every size of the input.
LEAST = 2
#: Lines that are scored together on average, and n-grams that a task gathers before it sends them.
BLOCK, GATHER = 20_000, 1_000_000
#: Share of accepted validation URLs that the calibrated threshold may turn away, and the steps in which scores are compared with it.
MISS, STEP = 0.02, 1e-4


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; null, or no ``://``: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)"))
    host = F.translate(F.regexp_extract(F.col("u_rest"), r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(F.expr("substring(u_rest, length(regexp_extract(u_rest, '^[^/?#]*', 0)) + 1)"), r"^[^?#]*", 0)
    return rest, F.struct(F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does.  Equal length: the first in code-point order."""
    found = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def gram_counts(labelled: DataFrame) -> DataFrame:
    """Counts of context and next character of all orders by class, over all rows of (label, line): gram, allow, block."""

    def run(batches):
        total = {c: Counter() for c in CLASSES}

        def sent():
            grams = sorted(total[CLASSES[0]].keys() | total[CLASSES[1]].keys())
            counts = [pa.array([total[c][g] for g in grams], pa.int64()) for c in CLASSES]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *counts], names=["gram", *CLASSES])
            for c in total.values():
                c.clear()

        for batch in batches:
            for label, line in zip(batch.column("label").to_pylist(), batch.column("line").to_pylist()):
                for order in range(ORDER + 1):
                    # ^ pads the front, $ ends the line
                    padded = "^" * order + line + "$"
                    total[label].update([padded[i : i + order + 1] for i in range(len(line) + 1)])
                    if sum(map(len, total.values())) > GATHER:
                        yield from sent()
        yield from sent()

    parts = labelled.select("label", "line").mapInArrow(run, "gram string, allow bigint, block bigint")
    return parts.groupBy("gram").agg(*[F.sum(c).alias(c) for c in CLASSES])


def ratios(counts: DataFrame, asked: DataFrame, keep: Scratch) -> DataFrame:
    """(gram, r): log-likelihood ratio, accepted to rejected, of the last character of each n-gram asked for.

    Interpolated Witten-Bell estimates over the contexts that a class has LEAST times or more, order by
    order: every order is a join of the n-grams asked for with counts, with the sums of their contexts and with the order below.
    """
    wanted = {ORDER: asked}
    for n in range(ORDER - 1, -1, -1):
        wanted[n] = keep(wanted[n + 1].select(F.expr("substring(gram, 2)").alias("gram")).distinct())
    known = None
    for n in range(ORDER + 1):
        grams = counts.where(F.length("gram") == n + 1)
        context = F.expr("substring(gram, 1, length(gram) - 1)")
        sums = grams.groupBy(context.alias("context")).agg(
            *[F.sum(c).alias(f"{c}_t") for c in CLASSES], *[F.sum((F.col(c) > 0).cast("bigint")).alias(f"{c}_k") for c in CLASSES]
        )
        rows = wanted[n].join(grams, "gram", "left").withColumn("context", context)
        if known is None:
            # one row: the empty context
            rows = rows.join(F.broadcast(sums), "context", "left").withColumns({f"{c}_p": F.lit(1 / 256) for c in CLASSES})
        else:
            below = known.withColumnRenamed("gram", "suffix")
            rows = rows.withColumn("suffix", F.expr("substring(gram, 2)")).join(below, "suffix").join(sums, "context", "left")
        p = {}
        for c in CLASSES:
            seen, total, kinds, low = F.coalesce(F.col(c), F.lit(0)), F.col(f"{c}_t"), F.col(f"{c}_k"), F.col(f"{c}_p")
            p[c] = F.when(total >= (LEAST if n else 1), (seen + kinds * low) / (total + kinds)).otherwise(low).alias(f"{c}_p")
        known = rows.select("gram", *p.values())
        known = known if n == ORDER else keep(known)
    return known.select("gram", (F.log("allow_p") - F.log("block_p")).alias("r"))


def _grams(line: str) -> list[str]:
    padded = "^" * ORDER + line + "$"
    return [padded[i : i + ORDER + 1] for i in range(len(line) + 1)]


def asked_grams(rows: DataFrame) -> DataFrame:
    """The different n-grams of each block of (block, line), as far as one task sees them: block, gram."""

    def run(batches):
        seen: dict[int, set] = defaultdict(set)

        def sent():
            for block, grams in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(grams), pa.int64()), pa.array(sorted(grams), pa.string())], names=["block", "gram"])
            seen.clear()

        for batch in batches:
            for block, line in zip(batch.column("block").to_pylist(), batch.column("line").to_pylist()):
                if line:
                    seen[block].update(_grams(line))
            if sum(map(len, seen.values())) > GATHER:
                yield from sent()
        yield from sent()

    return rows.select("block", "line").mapInArrow(run, "block bigint, gram string").distinct()


def _score(lines: pa.Table, answers: pa.Table) -> pa.Table:
    """The lines of a block with the length-normalised sums of their n-grams."""
    r = dict(zip(answers.column("gram").to_pylist(), answers.column("r").to_pylist()))
    scores = [sum(map(r.__getitem__, _grams(x))) / (len(x) + 1) for x in lines.column("line").to_pylist()]
    return pa.table({"line": lines.column("line"), "score": pa.array(scores, pa.float64())})


def filter_urls(pages: DataFrame, url: str = "url", key: str = "page_id", rules: Sequence[tuple[str, str]] = RULES, bad_words: Sequence[str] = BAD_HOST_WORDS, miss: float = MISS) -> DataFrame:
    """Judge every URL by the longest fitting rule, else by the model ratio.

    Training labels: URLs that a rule blocks and hosts with one of ``bad_words`` are
    rejected, all others accepted.  A quarter of the URLs (by hash)
    calibrates the threshold: the ``miss`` quantile of the accepted ones in steps of STEP, at most 0.
    Returns one row per input row: key, host, path, rule, verdict, score.  A null URL
    or one without ``://`` has empty host and path and is blocked unless a rule fits; if one of the
    classes has no URLs, all others are allowed.  Repeated rows repeat; URLs of any length count
    whole; an empty table gives no rows; other columns are left out.
    """
    small_batches(pages.sparkSession)
    keep = Scratch(pages.sparkSession)
    rest, parts = url_parts(F.col("u"))
    base = pages.select(pages[key].alias("k"), pages[url].cast("string").alias("u")).withColumn("u_rest", rest).withColumn("p", parts)
    base = base.select("k", "p.host", "p.path").withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("line", F.concat("host", "path"))
    bad = F.lit(False)
    for w in bad_words:
        bad = bad | F.col("host").contains(w)
    label = F.when(bad, "block").otherwise(F.coalesce("r.verdict", F.lit("allow")))
    fold = F.pmod(F.xxhash64("line"), F.lit(4)) == 0
    shown = keep(base.select("k", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"), "line", label.alias("label"), fold.alias("held")))
    counts = keep(gram_counts(shown.where("line != '' and not held")))
    seen = counts.where("length(gram) = 1").agg(*[F.sum(c).alias(c) for c in CLASSES]).first()
    if all(seen[c] for c in CLASSES):
        # every line is scored once, however many rows have it
        lines = keep(shown.where("line != ''").select("line").distinct())
        blocks = max(1, -(-lines.count() // BLOCK))
        rows = lines.withColumn("block", F.pmod(F.xxhash64("line"), F.lit(blocks)).cast("bigint"))
        asked = keep(asked_grams(rows))
        answers = asked.join(ratios(counts, keep(asked.select("gram").distinct()), keep), "gram")
        scores = keep(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda x, y: _score(x, y), "line string, score double"))
        scored = spool(shown.join(scores, "line", "left"))
        low = grid_quantile(scored.where("held and label = 'allow'"), [], F.col("score"), {"q": miss}, STEP).first()
        least = min(low["q"], 0) if low and low["q"] is not None else 0
    else:
        scored, least = spool(shown.withColumn("score", F.lit(None).cast("double"))), 0
    keep.clear()
    judged = F.when(F.col("line") == "", "block").when(F.col("score").isNull() | (F.floor(F.col("score") / F.lit(STEP)) >= least), "allow").otherwise("block")
    return scored.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")
