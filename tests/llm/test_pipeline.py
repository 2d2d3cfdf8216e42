"""The stages in order, each held against plain versions on its own input."""

import math
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from .test_operators import SF, brute_contamination, brute_near, odd, water  # noqa: F401


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = docs.limit(1).select(F.lit(10**9).cast("bigint").alias("doc_id"), F.lit("12 34 !!").alias("text"), "lang", "source", "n_chars")
    same = docs.orderBy("doc_id").limit(1)
    docs = docs.unionByName(junk).unionByName(same)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        kept[name] = (docs, docs := spark.read.parquet(f"{tmp_path}/{name}"))
    before, after = kept["language_id"]
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == {10**9}
    before, after = kept["near_dedup"]
    want = brute_near([(r.doc_id, r.text) for r in before.collect()], 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(k for k, v in want.items() if v[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = kept["decontaminate"]
    was = brute_contamination([(r.doc_id, r.text) for r in before.collect()], items)
    now = brute_contamination([(r.doc_id, r.text) for r in after.collect()], items)
    assert any(v[1] for v in was.values()) and not any(v[1] for v in now.values())
    assert {k for k, v in was.items() if not v[1]} <= set(now)
    before, after = kept["pii"]
    old, new = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
    assert old.keys() == new.keys()
    mails = {m for t in old.values() for m in re.findall(r"[\w.%+-]+@[\w.-]+", t)}
    assert mails and not any(m in t for t in new.values() for m in mails)
    before, after = kept["source_mix"]
    sizes, source, total = {}, {}, Counter()
    for r in before.collect():
        sizes[r.doc_id], source[r.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text)), r.source
        total[r.source] += sizes[r.doc_id]
    taken = Counter()
    for r in after.collect():
        assert r.copies in (1, 2)
        taken[source[r.doc_id]] += r.copies * sizes[r.doc_id]
    target = water(total)
    assert math.isclose(sum(taken.values()), sum(target.values()), rel_tol=0.05)
    for name in list(kept)[:-1]:
        assert kept[name][1].columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r.n_chars == len(r.text) for r in kept[name][1].collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls, empty texts, repeated rows and clashing names: every stage keeps the columns and can be written."""
    bench = spark.createDataFrame([(1, "three FOUR five")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = odd.withColumn("_rows", F.lit(1)).withColumn("copies", F.lit("c"))
    want = {"language_id": None, "near_dedup": 8, "decontaminate": odd.count(), "pii": odd.count(), "source_mix": None}
    for name, stage in corpus_pipeline.STAGES:
        for given, rows in ((odd, want[name]), (odd.limit(0), 0)):
            out = stage(spark, given, str(tmp_path))
            path = f"{tmp_path}/{name}-{rows}"
            out.write.parquet(path)
            assert sorted(out.columns) == sorted(odd.columns)
            assert rows is None or spark.read.parquet(path).count() == rows
            if name != "source_mix":
                assert out.columns == odd.columns


def test_mix_stage_keeps_rows(spark):
    """Ids that have two texts each stay as many rows as they were, each with its own text."""
    texts = [(k, f"{w} " * 30, "s") for k in (1, 2) for w in ("a", "b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.source_mix(spark, docs, SF).collect()]
    assert len(got) == len(set(got)) and set(got) <= {(k, t) for k, t, _ in texts}
