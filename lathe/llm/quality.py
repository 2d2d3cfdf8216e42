"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is a character 5-gram model by language, trained on all trusted texts.
Its counts are sharded by n-gram.  Every order is evaluated by joins of the n-grams
asked for with counts, with the sums of their contexts and with the probabilities of the
order below.  What is asked for are the distinct n-grams of blocks of documents: each
task sends every shard one packed list by block, the shard answers a block once,
and the answers meet the block's documents, which travel once and compressed.  A
document is kept if its perplexity is within quantiles of the trusted texts of its
language.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, grid_quantile, key_blocks, key_stats, small_batches, spool

ORDER = 5
START, END = "\x02", "\x03"
#: Documents that a block of neighbouring keys holds on average, and bytes of text that split one.
BLOCK, BLOCK_BYTES = 32_000, 160 << 20
#: Bytes of text for each shard (of 64 at least).
PER_SHARD = 32 << 20
#: Bytes of text for each file of a scratch table, and least files a core.  A local file system without Hadoop's native
#: library starts processes for each file, which share the executor's memory for a moment.
PER_FILE, CORE_FILES = 64 << 20, 4
#: Steps in which the logarithm of a perplexity is compared with the quantiles.
STEP = 1e-4
#: N-grams that a task gathers before it sends them.
GATHER = 1_000_000
#: Characters that are worked on at once.
CHUNK = 400_000
#: Trusted keys and split blocks up to which they are broadcast (16 bytes each), and texts that a task remembers to have met.
SMALL, REMEMBER = 2_000_000, 200_000


def _chunks(texts: list[str]):
    """Index ranges of texts with about CHUNK characters; a long text is a chunk of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def gram_codes(texts: list[str], places: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(distinct n-grams, their number at each position, positions by text) of texts that are padded in front and closed at the end."""
    text = "".join(START * (ORDER - 1) + t.replace("\x00", "\x01") + END for t in texts)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet = np.flatnonzero(np.bincount(code)).astype(np.uint32)
    bits = max(int(len(alphabet) - 1).bit_length(), 1)
    lengths = np.array([len(t) + 1 for t in texts])
    place = np.zeros(int(alphabet[-1]) + 1, np.uint64)
    place[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    symbol = place[code]
    # windows that end in padding are none
    ends = np.flatnonzero(code[ORDER - 1 :] != ord(START))
    if (bits * ORDER) <= 64:
        gram = np.zeros(len(code) - ORDER + 1, np.uint64)
        for i in range(ORDER):
            gram = (gram << np.uint64(bits)) | symbol[i : i + len(gram)]
        distinct, inverse = np.unique(gram[ends], return_inverse=True) if places else (np.unique(gram[ends]), None)
        mask = np.uint64((1 << bits) - 1)
        parts = [alphabet[(distinct >> np.uint64(bits * (ORDER - 1 - i))) & mask] for i in range(ORDER)]
        names = np.ascontiguousarray(np.stack(parts, axis=1).astype("<u4")).view(f"<U{ORDER}").ravel()
    else:
        window = np.lib.stride_tricks.sliding_window_view(code, ORDER)[ends]
        names, inverse = np.unique(np.ascontiguousarray(window).view(f"<U{ORDER}").ravel(), return_inverse=True)
    # a text may itself hold the padding character; such positions are left out above and count nowhere
    if START in "".join(texts):
        lengths = np.array([len(t) + 1 - t.count(START) for t in texts])
    return names, inverse, lengths


def _packed(grams: list[str], shards: int):
    """Sorted n-grams by shard: (shard, their places in the list, n, compressed)."""
    grams.sort()
    home = np.fromiter((zlib.crc32(g.encode()) for g in grams), np.uint32, len(grams)) % shards
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        raw = "".join([grams[i] for i in at]).encode()
        yield int(home[at[0]]), at, len(raw), zstandard.compress(raw, 6)


def _unpacked(z: bytes) -> list[str]:
    text = zstandard.decompress(z).decode()
    return [text[i : i + ORDER] for i in range(0, len(text), ORDER)]


def count_grams(texts: DataFrame, shards: int) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, t): packed counts of tasks, summed by shard."""

    def rows(lang: str, counts: Counter):
        grams = list(counts)
        for shard, at, _, z in _packed(grams, shards):
            n = np.fromiter((counts[grams[i]] for i in at), np.int64, len(at))
            yield {"shard": shard, "lang": lang, "z": z, "n": zstandard.compress(n.tobytes(), 6)}

    def run(batches):
        total: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            by = defaultdict(list)
            for l, t in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist()):
                by[l].append(t)
            for l, ts in by.items():
                for a, b in _chunks(ts):
                    names, inverse, _ = gram_codes(ts[a:b])
                    total[l].update(dict(zip(names.tolist(), np.bincount(inverse, minlength=len(names)).tolist())))
            while sum(map(len, total.values())) > GATHER:
                largest = max(total, key=lambda l: len(total[l]))
                yield from _batches(rows(largest, total.pop(largest)), schema)
        for l, c in total.items():
            yield from _batches(rows(l, c), schema)

    def add(table: pa.Table) -> pa.Table:
        total: dict[str, Counter] = defaultdict(Counter)
        for l, z, n in zip(*(table.column(c).to_pylist() for c in ("lang", "z", "n"))):
            total[l].update(dict(zip(_unpacked(z), np.frombuffer(zstandard.decompress(n), np.int64).tolist())))
        flat = [(l, g, n) for l, c in total.items() for g, n in c.items()]
        return pa.table({"lang": pa.array([x[0] for x in flat], pa.string()), "gram": pa.array([x[1] for x in flat], pa.string()), "n": pa.array([x[2] for x in flat], pa.int64())})

    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("z", pa.binary()), ("n", pa.binary())])
    sent = texts.select("lang", "t").mapInArrow(run, "shard int, lang string, z binary, n binary")
    return sent.groupBy("shard").applyInArrow(lambda t: add(t), "lang string, gram string, n bigint")


def _batches(rows, schema: pa.Schema):
    rows = list(rows)
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


class Once:
    """Lets every text through once a task, as far as it remembers; a copy that passes costs work and changes nothing."""

    def __init__(self) -> None:
        self.met: set[tuple[int, int]] = set()

    def __call__(self, batch: pa.RecordBatch) -> list[dict]:
        out = []
        for row in batch.to_pylist():
            if (name := (row["id"], row["block"])) not in self.met:
                if len(self.met) >= REMEMBER:
                    self.met.clear()
                self.met.add(name)
                out.append(row)
        return out


def asked_grams(docs: DataFrame, shards: int) -> DataFrame:
    """Packed n-grams of (block, id, lang, t) by shard: shard, block, lang, z."""

    def rows(key: tuple[int, str], grams: set):
        for shard, _, _, z in _packed(list(grams), shards):
            yield {"shard": shard, "block": key[0], "lang": key[1], "z": z}

    def run(batches):
        seen: dict[tuple[int, str], set] = defaultdict(set)
        once = Once()
        for batch in batches:
            by = defaultdict(list)
            for row in once(batch):
                by[row["block"], row["lang"]].append(row["t"])
            for key, ts in by.items():
                for a, b in _chunks(ts):
                    seen[key].update(gram_codes(ts[a:b], places=False)[0].tolist())
            while sum(map(len, seen.values())) > GATHER:
                largest = max(seen, key=lambda k: len(seen[k]))
                yield from _batches(rows(largest, seen.pop(largest)), schema)
        for key, grams in seen.items():
            yield from _batches(rows(key, grams), schema)

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("lang", pa.string()), ("z", pa.binary())])
    return docs.select("block", "id", "lang", "t").mapInArrow(run, "shard int, block bigint, lang string, z binary")


def _distinct(table: pa.Table) -> pa.Table:
    """The different n-grams that one shard is asked for."""
    grams: dict[str, set] = defaultdict(set)
    for l, z in zip(table.column("lang").to_pylist(), table.column("z")):
        grams[l].update(_unpacked(z.as_py()))
    flat = [(l, g) for l, gs in grams.items() for g in gs]
    return pa.table({"lang": pa.array([x[0] for x in flat], pa.string()), "gram": pa.array([x[1] for x in flat], pa.string())})


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """One shard's answer to every block: its n-grams and their log-probabilities."""
    p: dict[str, dict[str, float]] = defaultdict(dict)
    for l, g, v in zip(known.column("lang").to_pylist(), known.column("gram").to_pylist(), np.log(known.column("p").to_numpy()).tolist()):
        p[l][g] = v
    asks: dict[tuple[int, str], list[int]] = defaultdict(list)
    for row, key in enumerate(zip(asked.column("block").to_pylist(), asked.column("lang").to_pylist())):
        asks[key].append(row)
    out = []
    # one block after the other, so that only its n-grams are unpacked
    for (b, l), at in asks.items():
        ordered = sorted(set().union(*(_unpacked(asked.column("z")[row].as_py()) for row in at)))
        logs = np.fromiter(map(p[l].__getitem__, ordered), np.float64, len(ordered))
        out.append({"block": b, "lang": l, "z": zstandard.compress("".join(ordered).encode(), 6), "logs": zstandard.compress(logs.tobytes(), 3)})
    return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("lang", pa.string()), ("z", pa.binary()), ("logs", pa.binary())]))


def _discounted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One order: (lang, gram, part) with part = discounted count / context sum, and (lang, context, gamma)."""
    n = F.col("n")
    kinds = counts.groupBy("lang").agg(*[F.sum(F.when(n == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.when(F.col("n1") + 2 * F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))

    def discount(i: int):
        value = F.when(F.col(f"n{i}") > 0, i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(F.lit(0.5 * i))
        return F.least(F.greatest(value, F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}")

    # one row per language
    discounts = F.broadcast(kinds.select("lang", discount(1), discount(2), discount(3)))
    by_context = counts.withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)"))
    # whole numbers are summed, so that the order of the rows changes no digit
    of = [F.sum((n == i).cast("bigint") if i < 3 else (n >= i).cast("bigint")).alias(f"c{i}") for i in (1, 2, 3)]
    sums = by_context.groupBy("lang", "context").agg(F.sum("n").alias("total"), *of).join(discounts, "lang")
    contexts = sums.select("lang", "context", ((F.col("c1") * F.col("d1") + F.col("c2") * F.col("d2") + F.col("c3") * F.col("d3")) / F.col("total")).alias("gamma"), "total", "d1", "d2", "d3")
    d = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    parts = by_context.join(contexts.drop("gamma"), ["lang", "context"]).select("lang", "gram", ((n - d) / F.col("total")).alias("part"))
    return parts, contexts.select("lang", "context", "gamma")


def probabilities(counts: DataFrame, asked: DataFrame, keep: Scratch) -> DataFrame:
    """(lang, gram, p): interpolated modified Kneser-Ney probability of the last character of each n-gram asked for."""
    orders = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        # continuation counts: in how many ways an n-gram is extended to the left
        orders[n] = keep(orders[n + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    wanted = {ORDER: asked}
    for n in range(ORDER - 1, 0, -1):
        wanted[n] = keep(wanted[n + 1].select("lang", F.expr("substring(gram, 2)").alias("gram")).distinct())
    known = orders[1].groupBy("lang").agg((1 / (F.count(F.lit(1)) + 1)).alias("p")).select("lang", F.lit("").alias("gram"), "p")
    for n in range(1, ORDER + 1):
        parts, contexts = _discounted(orders[n])
        # keys are expressions, so that only the n-gram itself travels
        rows, below = wanted[n].alias("r"), known.select(F.col("lang").alias("bl"), F.col("gram").alias("suffix"), F.col("p").alias("below"))
        rows = rows.join(below, (F.col("lang") == F.col("bl")) & (F.expr("substring(gram, 2)") == F.col("suffix"))).select("lang", "gram", "below")
        contexts = contexts.withColumnRenamed("lang", "cl")
        rows = rows.join(contexts, (F.col("lang") == F.col("cl")) & (F.expr("substring(gram, 1, length(gram) - 1)") == F.col("context")), "left")
        rows = rows.select("lang", "gram", (F.coalesce("gamma", F.lit(1.0)) * F.col("below")).alias("below")).join(parts, ["lang", "gram"], "left")
        known = rows.select("lang", "gram", (F.coalesce("part", F.lit(0.0)) + F.col("below")).alias("p"))
        known = known if n == ORDER else keep(known)
    return known


def _pack(docs: DataFrame) -> DataFrame:
    """Texts for the way to their block: one compressed row for each batch, block and language."""

    def run(batches):
        once = Once()
        for batch in batches:
            by = defaultdict(list)
            for row in once(batch):
                by[row["block"], row["lang"]].append(row)
            out = []
            for (b, l), rows in by.items():
                raw = [r["t"].encode() for r in rows]
                out.append({
                    "block": b, "lang": l, "ids": np.array([(r["id"], r["mark"]) for r in rows], np.int64).tobytes(),
                    "sizes": np.array([len(x) for x in raw], np.int64).tobytes(), "z": zstandard.compress(b"".join(raw), 9),
                })
            yield from _batches(out, schema)

    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("ids", pa.binary()), ("sizes", pa.binary()), ("z", pa.binary())])
    return docs.select("block", "id", "mark", "lang", "t").mapInArrow(run, "block bigint, lang string, ids binary, sizes binary, z binary")


class Answers:
    """Log-probabilities by n-gram in sorted arrays.

    Two lists number the first three and the last two characters that occur, so that the
    code of an n-gram has 64 bits in any alphabet: 16 bytes an n-gram, not a dictionary's hundreds.
    """

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        a, b = self._halves(grams)
        self.first, i = np.unique(a, return_inverse=True)
        self.last, j = np.unique(b, return_inverse=True)
        code = (i.astype(np.uint64) << np.uint64(32)) | j.astype(np.uint64)
        order = np.argsort(code)
        self.code, self.logs = code[order], logs[order]

    @staticmethod
    def _halves(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, bits = grams.astype(np.uint64), np.uint64(21)
        return (((c[:, 0] << bits) | c[:, 1]) << bits) | c[:, 2], (c[:, 3] << bits) | c[:, 4]

    def __call__(self, names: np.ndarray) -> np.ndarray:
        a, b = self._halves(np.ascontiguousarray(names).view(np.uint32).reshape(-1, ORDER))
        code = (np.searchsorted(self.first, a).astype(np.uint64) << np.uint64(32)) | np.searchsorted(self.last, b).astype(np.uint64)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        if (self.code[at] != code).any():
            raise KeyError("an n-gram of the block has no answer")
        return self.logs[at]


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Log-probability and positions of each text of a block and language."""
    ids, sums, sizes = [np.zeros((0, 2), np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
    if docs.num_rows:
        raw = [zstandard.decompress(z.as_py()).decode().encode("utf-32-le") for z in answers.column("z")]
        logs = [np.frombuffer(zstandard.decompress(x.as_py()), np.float64) for x in answers.column("logs")]
        known = Answers(np.frombuffer(b"".join(raw), np.uint32).reshape(-1, ORDER), np.concatenate(logs))
        del raw, logs
        for row in range(docs.num_rows):
            keys = np.frombuffer(docs.column("ids")[row].as_py(), np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum(np.frombuffer(docs.column("sizes")[row].as_py(), np.int64))]).tolist()
            text = zstandard.decompress(docs.column("z")[row].as_py())
            texts = [text[a:b].decode() for a, b in zip(ends, ends[1:])]
            for a, b in _chunks(texts):
                names, inverse, lengths = gram_codes(texts[a:b])
                sums.append(np.add.reduceat(known(names)[inverse], np.concatenate([[0], np.cumsum(lengths)[:-1]])))
                sizes.append(lengths)
                ids.append(keys[a:b])
    both = np.concatenate(ids)
    return pa.table({"id": both[:, 0], "mark": both[:, 1], "log_p": np.concatenate(sums), "n": np.concatenate(sizes).astype(np.int64)})


def _blocked(whole: DataFrame, stats) -> DataFrame:
    """whole with ``block``: neighbouring keys, and parts by text of the blocks that have too many bytes, such as those of a key on many rows."""
    at = whole.withColumn("_c", key_blocks(stats, BLOCK))
    parts = F.ceil(F.sum(F.octet_length("t")) / F.lit(BLOCK_BYTES)).cast("bigint")
    large = at.groupBy("_c").agg(parts.alias("_parts")).where("_parts > 1")
    n = large.count()
    if not n:
        return at.withColumn("block", F.shiftleft("_c", 20)).drop("_c")
    split = at.join(F.broadcast(large) if n <= SMALL else large, "_c", "left")
    return split.withColumn("block", F.shiftleft("_c", 20) + F.pmod("id", F.coalesce("_parts", F.lit(1).cast("bigint")))).drop("_c", "_parts")


def classify(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", low: float = 0.002, high: float = 0.99) -> DataFrame:
    """Perplexity of every document under the model of its language, and whether it is kept.

    ``trusted`` has the key of documents with trusted text.  A document is kept if its
    perplexity lies between the ``low`` and ``high`` quantiles of the trusted documents of its
    language, all of them to four digits of the logarithm.  Returns one row per input row: key, lang, perplexity, kept.  Null and
    empty texts have no perplexity and are not kept; a null language is a language of its own; where a
    language has no trusted text there is no perplexity and documents are kept.
    Repeated rows repeat, rows with one key and different texts get a perplexity each; other columns are left out.
    Texts of any length are scored whole, in pieces that one task holds; an empty table gives no rows.
    The key is an integer; documents with near keys share a block, which only decides the work, never the result.
    """
    small_batches(docs.sparkSession)
    base = docs.select(docs[key].cast("bigint").alias("k"), F.coalesce(docs[lang].cast("string"), F.lit("")).alias("lang"), docs[text].alias("t"))
    # two hashes name a text: equal texts of a language are scored once for all that a task meets
    base = base.withColumn("id", F.xxhash64("lang", "t")).withColumn("mark", F.hash("t", "lang").cast("bigint"))
    whole = base.where("t is not null and t != ''")
    stats = whole.agg(*key_stats(F.sum(F.octet_length("t")).alias("bytes"))).first()
    ids = trusted.select(trusted[key].cast("bigint").alias("k")).where("k is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= SMALL else ids
    shards = max(64, (stats["bytes"] or 0) // PER_SHARD)
    files = max(CORE_FILES * docs.sparkSession.sparkContext.defaultParallelism, (stats["bytes"] or 0) // PER_FILE)
    keep = Scratch(docs.sparkSession, files)
    counts = keep(count_grams(whole.join(ids, "k", "left_semi"), shards))
    learned = counts.select("lang").distinct()  # one row per language
    blocks = _blocked(whole, stats).join(F.broadcast(learned), "lang", "left_semi")
    asked = keep(asked_grams(blocks, shards))
    distinct = keep(asked.groupBy("shard").applyInArrow(lambda t: _distinct(t), "lang string, gram string"))
    known = probabilities(counts, distinct, keep).withColumn("shard", (F.crc32(F.col("gram").cast("binary")) % shards).cast("int"))
    answers = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(lambda x, y: _answer(x, y), "block bigint, lang string, z binary, logs binary")
    scored = _pack(blocks).groupBy("block", "lang").cogroup(answers.groupBy("block", "lang")).applyInArrow(lambda x, y: _score(x, y), "id bigint, mark bigint, log_p double, n bigint")
    once = scored.groupBy("id", "mark").agg((-F.first("log_p") / F.first("n")).alias("rate"))
    every = spool(base.select("k", "lang", "id", "mark", (F.coalesce(F.length("t"), F.lit(0)) > 0).alias("some")).join(once, ["id", "mark"], "left").select("k", "lang", "rate", "some"), files)
    keep.clear()
    limits = grid_quantile(every.join(ids, "k", "left_semi"), ["lang"], F.col("rate"), {"low": low, "high": high}, STEP)
    judged = every.join(F.broadcast(limits), "lang", "left")  # one row per language
    inside = F.coalesce(F.floor(F.col("rate") / F.lit(STEP)).between(F.col("low"), F.col("high")), F.lit(True))
    return judged.select(F.col("k").alias(key), F.when(F.col("lang") != "", F.col("lang")).alias("lang"), F.exp("rate").alias("perplexity"), (F.col("some") & inside).alias("kept"))
