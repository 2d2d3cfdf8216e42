"""MinHash near-dedup with sequential Bayesian verification.

Equal shingle sets collapse first.  Banded signatures then give candidates: every
document against the most central one of each of its buckets, and, once the components
of these links are known, the pairs of a bucket that are still in different components
and whose exact bounds allow a link.  Candidates are compared by signature batches and
dropped as soon as the posterior probability of a link falls under the chosen miss
probability; survivors are verified exactly on their full shingle sets.

Joins that carry texts, signatures or sets are merge joins at every size: the other
side grows with the corpus, so a broadcast that a small corpus would get says nothing of a large one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, spool, wrap

SHINGLE = 5
#: A link needs percent * union <= 100 * intersection; what holds where nothing else is asked for.
PERCENT = 80
HASHES = 128
BATCH = 32
#: Posterior probability of a link under which a pair is dropped, and most chance that bands miss a pair at the threshold.
MISS = 1e-6
#: Buckets over this size have their members' unshared shingles counted, to bound pairs before they are formed.
LARGE = 16
#: Classes of the share of own shingles in a large bucket.
CLASSES = 20

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MIX = _RNG.integers(0, 1 << 63, (2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _STEP[1]
    x = (x ^ (x >> np.uint64(27))) * _STEP[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of texts; remembers the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > 300_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(SHINGLE, len(words))
        out = np.full(len(h) - size + 1, np.uint64(size))
        for i in range(size):
            out = _mix(out * _STEP[0] + h[i : len(h) - size + 1 + i])
        return np.unique(out)


def _minhash(shingles: np.ndarray) -> np.ndarray:
    # in pieces that stay in the processor's cache
    low, room = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64), np.empty((256, HASHES), np.uint64)
    for at in range(0, len(shingles), 256):
        piece = shingles[at : at + 256, None]
        part = np.multiply(piece, _A, out=room[: len(piece)])
        part += _B
        np.minimum(low, part.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def banding(percent: int, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows of each: the longest bands, and as few of them, that miss a pair at the threshold with no more than ``miss``."""
    for rows in range(HASHES, 0, -1):
        bands = max(1, math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))) if percent < 100 else 1
        if bands * rows <= HASHES:
            return bands, rows
    raise ValueError(f"{HASHES} hashes are too few for {percent} % and {miss}")


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """From (k, th, t): k, th, n_shingles, set_key, sig (a byte of each hash), bands.  Texts without words have no set_key."""
    small_batches(docs.sparkSession)
    weight, shift = _MIX[0, : bands * rows].reshape(bands, rows), _MIX[1, :bands]

    def run(batches):
        shingle = Shingler()
        for batch in batches:
            n, keys, sigs, banded = [], [], [], []
            for t in batch.column("t").to_pylist():
                s = shingle(t)
                n.append(len(s))
                if len(s):
                    m = _minhash(s)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sigs.append((m & np.uint32(255)).astype(np.uint8).tobytes())
                    b = _mix((m[: bands * rows].reshape(bands, rows).astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64) + shift)
                    banded.append(b.view(np.int64))
                else:
                    keys.append(None)
                    sigs.append(None)
                    banded.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("th"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(banded, pa.list_(pa.int64()))],
                names=["k", "th", "n_shingles", "set_key", "sig", "bands"],
            )

    return docs.select("k", "th", "t").mapInArrow(run, f"k {dict(docs.dtypes)['k']}, th bigint, n_shingles bigint, set_key binary, sig binary, bands array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """From (k, t): k, the distinct shingle hashes."""

    def run(batches):
        shingle = Shingler()
        for batch in batches:
            sets = [shingle(t).view(np.int64) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(sets, pa.list_(pa.int64()))], names=["k", "shingles"])

    return docs.select("k", "t").mapInArrow(run, f"k {dict(docs.dtypes)['k']}, shingles array<bigint>")


def least_matches(percent: int, miss: float = MISS) -> dict[int, int]:
    """Matching bytes out of n that keep P(similarity >= threshold | matches) at ``miss`` or more, under a uniform prior."""
    s = np.linspace(0.0005, 0.9995, 2000)
    p = s + (1 - s) / 256
    linked = s >= percent / 100
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[linked].sum() / weight.sum() >= miss:
                out[n] = m
                break
    return out


def prune(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose signatures leave a link possible."""
    sig = reps.select("k", "sig").hint("merge")
    both = pairs.join(sig.select(F.col("k").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("k").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    bounds = least_matches(percent)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sa", "sb"))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for n, least in bounds.items():
                matches[alive] += (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    kind = dict(pairs.dtypes)["a"]
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs, the exact sizes of intersection and union of the full sets, and which shingles of a are not in b, as a bitmap of 256 hashed bits: a, b, i, u, gone."""
    a = sets.select(F.col("k").alias("a"), F.col("shingles").alias("x")).hint("merge")
    b = sets.select(F.col("k").alias("b"), F.col("shingles").alias("y")).hint("merge")
    word = "aggregate(filter(e, s -> pmod(shiftright(s, 8), 4) = w), 0L, (m, s) -> m | shiftleft(1L, cast(pmod(s, 64) as int)))"
    gone = F.expr(f"transform(array(array_except(x, y)), e -> transform(sequence(0, 3), w -> {word}))[0]")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("x", "y")).cast("bigint").alias("i"), (F.size("x") + F.size("y")).cast("bigint").alias("n"), gone.alias("gone"))
    return both.select("a", "b", "i", (F.col("n") - F.col("i")).alias("u"), "gone")


def links(sizes: DataFrame, percent: int) -> DataFrame:
    return sizes.where(100 * F.col("i") >= percent * F.col("u")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Smallest member by node over all edges (a, b): k, comp.

    A round hooks every label to its smallest smaller neighbour, follows the hooks to their ends by
    doubling and relabels the edges; edges between equal labels go, and so do half of the labels at least.
    """
    keep = Scratch(edges.sparkSession)
    left = keep(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct())
    labels = left.select(F.explode(F.array("hi", "lo")).alias("k")).distinct().withColumn("comp", F.col("k"))
    while not left.isEmpty():
        hooks, moved = keep(left.groupBy("hi").agg(F.min("lo").alias("to"))), True
        while moved:
            for _ in range(2):
                further = hooks.select(F.col("hi").alias("to"), F.col("to").alias("further"))
                hooks = hooks.join(further, "to", "left").select("hi", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
            hooks = keep(hooks)
            moved = not hooks.where("moved").isEmpty()
        labels = keep(labels.join(hooks.select(F.col("hi").alias("comp"), "to"), "comp", "left").select("k", F.coalesce("to", "comp").alias("comp")))
        for end in ("hi", "lo"):
            left = left.join(hooks.select(F.col("hi").alias(end), F.col("to").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        left = keep(left.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi > lo").distinct())
    out = spool(labels)
    keep.clear()
    return out


def unshared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """By member of a large bucket, how many of its shingles no other such member has: k, own.  Few mean a central document, many one that links with no other such member."""
    large = members.where(F.col("n") > LARGE).select("k").distinct()
    rows = sets.join(large, "k", "left_semi").select("k", F.explode("shingles").alias("s"))
    single = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k")).where("n = 1")
    return large.join(single.groupBy("k").agg(F.count(F.lit(1)).alias("own")), "k", "left").withColumn("own", F.coalesce("own", F.lit(0)))


def _cross_pairs(members: DataFrame, comps: DataFrame, facts: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket in different components that the bounds leave open.

    Bounds: the sizes; the shingles that only one of the two has; and, of two that were
    compared with the bucket's hub, that they share no hub shingle which either lacks, and
    beyond the hub only what is not their own.  Hashed bits can only weaken the last one.
    A document's own shingles say nothing of one outside all large buckets, so they count only
    if both are in such buckets, as all members of a large one are.  In a large bucket the
    first two bounds are keys of the join: a document meets only the classes of size and
    of own share that it can link with, so that what they rule out is never formed.
    """
    labelled = members.join(comps, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    per = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n_comp"))
    main = per.groupBy("key").agg(F.max(F.struct("n_comp", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("key", F.col("m.comp").alias("main"))
    compared = sizes.select(F.col("a").alias("hub"), F.col("b").alias("k"), "i", "gone")
    large, n, own = F.col("n") > LARGE, F.col("n_shingles"), F.coalesce("own", F.lit(0))
    # most own shingles that a partner may have
    least = ((100 - percent) * n - 100 * own) / percent
    rows = labelled.join(facts, "k").where(~large | (least >= 0)).join(main, "key").join(compared, ["hub", "k"], "left")
    rows = rows.withColumn("i", F.when(F.col("k") == F.col("hub"), F.col("h")).otherwise(F.col("i"))).withColumn("gone", F.when(F.col("k") == F.col("hub"), F.array_repeat(F.lit(0).cast("bigint"), 4)).otherwise(F.col("gone")))
    # a little wider than the bounds, for what is rounded
    size_class = F.floor(F.log(n) / F.lit(math.log(100 / percent) * (1 + 1e-9)))
    rows = rows.select(
        "key", "k", "comp", "main", "own", "gone", "h", "n_shingles", (n - F.col("i")).alias("beyond"), F.when(large, size_class).otherwise(0).alias("size_class"), F.when(large, F.floor(CLASSES * own / n)).otherwise(0).alias("own_class"),
        F.when(large, F.floor(CLASSES * 100 * least / (percent * n) + 1e-9)).otherwise(0).alias("own_most"), large.alias("large"),
    )
    keys = ("key", "size_class", "own_class")
    names = [c for c in rows.columns if c not in (*keys, "main")]
    y = rows.select((F.col("comp") == F.col("main")).alias("y_main"), *[F.col(c).alias(f"y_{c}") for c in (*keys, *names)])
    near = F.when(F.col("large"), F.sequence(F.col("size_class") - 1, F.col("size_class") + 1)).otherwise(F.array("size_class"))
    x = rows.where("comp != main").withColumn("size_class", F.explode(near)).withColumn("own_class", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("own_most", F.lit(CLASSES).cast("bigint")))))
    x = x.select(*[F.col(c).alias(f"x_{c}") for c in (*keys, *names)])
    both = F.col("x_own").isNotNull() & F.col("y_own").isNotNull()
    mine = {s: F.when(both, F.col(f"{s}_own")).otherwise(0) for s in "xy"}
    shared = F.least(F.col("x_n_shingles") - mine["x"], F.col("y_n_shingles") - mine["y"])
    lacking = F.aggregate(F.zip_with("x_gone", "y_gone", lambda p, q: F.bit_count(p.bitwiseOR(q))), F.lit(0), lambda m, c: m + c)
    most = F.col("x_h") - lacking + F.least(F.col("x_beyond") - mine["x"], F.col("y_beyond") - mine["y"])
    ok = (
        (F.col("x_key") == F.col("y_key")) & (F.col("x_size_class") == F.col("y_size_class")) & (F.col("x_own_class") == F.col("y_own_class"))
        & (F.col("x_comp") != F.col("y_comp"))
        & (F.col("y_main") | (F.col("x_k") < F.col("y_k")))
        & (100 * F.least("x_n_shingles", "y_n_shingles") >= percent * F.greatest("x_n_shingles", "y_n_shingles"))
        & (100 * shared >= percent * (shared + mine["x"] + mine["y"]))
        & F.coalesce((100 + percent) * most >= percent * (F.col("x_n_shingles") + F.col("y_n_shingles")), F.lit(True))
    )
    return x.join(y, ok).select(F.least("x_k", "y_k").alias("a"), F.greatest("x_k", "y_k").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns one row per input row: key, n_shingles, component_id (smallest key
    reachable), kept (key = component_id).  Texts without words and nulls have no
    shingles and link with nothing.  Repeated rows are one node and repeat in the
    result; rows with one key and different texts share their links.  A row with a null key
    takes the component of its exact copies, or null, and is kept then; it has no near links.
    Texts of any length are compared whole; an empty table gives no rows; other columns are left out.
    The chance to miss a pair at the threshold is MISS in the bands and MISS in the pruning.
    """
    found = _found(docs.select(docs[key].alias("k"), docs[text].alias("t")), percent)
    return found.select(F.col("k").alias(key), "n_shingles", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """Of every component of near_duplicates the rows with the smallest key, rows with equal key and text once.

    All columns stay as they are; of repeated rows that differ in other columns one stays.
    Null, empty and blank texts have no copies but their repeated rows.
    """
    rows = wrap(docs, text).withColumn("_k", F.col("_row").getField(key)).withColumn("_th", F.xxhash64("_t"))
    found = _found(docs.select(docs[key].alias("k"), docs[text].alias("t")), percent)
    kept = spool(found.where(F.col("k").eqNullSafe(F.col("component_id"))).groupBy("k", "th").agg(F.count(F.lit(1)).alias("n")))
    left = rows.join(kept, F.col("_k").eqNullSafe(F.col("k")) & (F.col("_th") == F.col("th")))
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns]
    once = left.where("n = 1").select(*columns)
    if kept.where("n > 1").isEmpty():
        return once
    return once.unionByName(left.where("n > 1").groupBy("_k", "_th").agg(F.first("_row").alias("_row")).select(*columns))


def _found(base: DataFrame, percent: int) -> DataFrame:
    """By row of (k, t): k, th (hash of the text), n_shingles, component_id."""
    keep = Scratch(base.sparkSession)
    bands, rows = banding(percent)
    sigs = spool(signatures(base.withColumn("th", F.xxhash64("t")), bands, rows))
    reps = keep(
        sigs.where("set_key is not null and k is not null").groupBy("set_key").agg(F.min("k").alias("k"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    )
    banded = reps.select("k", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keep(banded.join(buckets, "key"))
    # repeated rows give a set more than once, which adds nothing to links and only weakens bounds
    sets = keep(shingle_sets(base.join(shared.select("k").distinct().hint("merge"), "k", "left_semi")))
    facts = keep(reps.select("k", "n_shingles").join(unshared(shared, sets), "k", "left"))
    hubs = shared.join(facts, "k").groupBy("key").agg(F.min(F.struct(F.coalesce("own", F.lit(0)).alias("own"), "k", "n_shingles")).alias("m")).select("key", F.col("m.k").alias("hub"), F.col("m.n_shingles").alias("h"))
    members = keep(shared.join(hubs, "key"))
    stars = members.where("k != hub").select(F.col("hub").alias("a"), F.col("k").alias("b")).distinct()
    sizes = keep(overlaps(prune(stars, reps, percent), sets))
    cross = _cross_pairs(members, components(links(sizes, percent)), facts, sizes, percent)
    comps = components(links(sizes, percent).unionByName(links(overlaps(prune(cross, reps, percent), sets), percent)))
    named = spool(reps.select("set_key", F.col("k").alias("rep")))
    keep.clear()
    rep = sigs.where("set_key is not null").select("k", "th", "n_shingles", "set_key").join(named, "set_key", "left").drop("set_key")
    found = rep.join(comps.withColumnRenamed("k", "rep"), "rep", "left").select("k", "th", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    return found.unionByName(sigs.where("set_key is null").select("k", "th", "n_shingles", F.col("k").alias("component_id")))
