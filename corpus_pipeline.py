"""Corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and gives a frame that is written as Parquet and read
again as the next one's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.llm import language, nearcopies, packing, quality, repeats
from chronomesh.llm.common import free_name, settle, table

#: Near copies: words of a shingle, and similarity.
SHINGLE, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    score = free_name(docs, "quality_score")
    found = quality.scored(docs, quality.fit(docs), score_col=score)
    return found.where(F.col(score) >= quality.KEEP).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is recognised as one of the learned languages."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = language.predicted(docs, language.fit(docs), lang_col=lang, score_col=score, strict=True)
    return found.where(F.col(lang) != language.UNKNOWN).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id. Different documents with one doc_id are not one document."""
    return nearcopies.without_copies(docs, words=SHINGLE, similarity=SIMILARITY)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes that occur elsewhere; n_chars counts what is left."""
    k1, k2, none = (free_name(docs, n) for n in ("t1", "t2", "no_text"))
    keys = (c.alias(n) for c, n in zip(repeats.text_key(F.coalesce("text", F.lit(""))), (k1, k2), strict=True))
    named = docs.select(F.col("text").isNull().alias(none), *(F.col(c) for c in docs.columns if c != "text"), *keys)
    cut = repeats.cut_texts(named, repeats.repeated_spans(docs), (k1, k2), "text").withColumn("text", F.when(~F.col(none), F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's tokens goes."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_copies", near_copy_stage),
    ("repeated_passages", repeat_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifiers; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
