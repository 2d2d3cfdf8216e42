"""A corpus pipeline of five stages, each an operator of ``lathe.llm``.

Every stage reads what its predecessor kept.  All but the last return the columns
of documents; the last adds ``copies``, how often the mix takes a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.common import Scratch, table
from lathe.llm.decontaminate import remove_contamination
from lathe.llm.dedup import keep_one
from lathe.llm.language import held_out, keep_identified, train
from lathe.llm.mixing import take
from lathe.llm.pii import pii_key, replace_pii


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars again, after texts have changed."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language for half of their letters go.

    Null and empty texts and texts without a letter have none and go.  A null doc_id or lang
    is no obstacle; repeated rows repeat; all columns stay; an empty table stays empty.
    """
    return keep_identified(docs, train(docs.where(~held_out(F.col("doc_id")))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, that with the smallest doc_id.

    Null, empty and blank texts are near nothing and stay; a row with a null doc_id goes if its
    text has a copy with one.  Rows with equal doc_id and text are one document, of
    which one row stays; rows with one doc_id and different texts stay or go together.
    All columns stay; an empty table stays empty.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go.

    Null and empty texts and texts without hits pass unchanged, as does every text if the
    benchmark is empty; repeated rows repeat; all columns stay, with n_chars of the new text.
    """
    return _measured(remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates, the same for an entity in all documents.

    Null and empty texts pass unchanged; repeated rows repeat; all columns stay, one named n_entities
    too, with n_chars of the new text; an empty table stays empty.
    """
    return _measured(replace_pii(docs, pii_key(spark), count=None))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often in ``copies``, which replaces a column of that name.

    Null and empty texts have no words and are not taken; a null source is a source; ties are
    broken by a hash of doc_id and text.  Repeated rows (in doc_id, source and text) are
    documents of their own; an empty table stays empty.
    """
    return take(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("source_mix", source_mix)]

#: Viterbi paths, model fits and rounding are no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with Parquet in the shared folder between them; a stage's input goes once the stage is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        done = Scratch(spark)
        docs = done(stage(spark, docs, sf_dir))
        if before:
            before.clear()
        before = done
    return docs
