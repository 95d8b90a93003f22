"""Corpus pipeline: five stages over ``documents``, each the whole of what the one before kept.

1. language: texts whose language is rejected go.
2. quality: texts that the quality classifier predicts as bad go.
3. near_copies: of documents linked by five-word shingles (Jaccard 0.8 or more) the smallest id stays.
4. secrets: every secret found is replaced in its text; no document goes.
5. packing: the documents are packed into sequences; the result has one row per piece.

Stages 1 to 4 return the columns of ``documents``, further ones too, whatever their names.  Every stage handles empty tables, null and empty
texts (which have no language and go in stage 1) and repeated rows as its operator states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledoc.llm import lang_id, ngram_join, packing, quality_rules, secret_scan
from tabledoc.llm.arrow_text import aside
from tabledoc.llm.joins import small_side
from tabledoc.session import load_table, materialise

#: No single text states what a trained model keeps; the stages are tested against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted with enough confidence."""
    model = lang_id.fit(docs)
    inner, columns = aside(docs, ["text"])
    return lang_id.predict(inner, model).where(~F.col("rejected")).select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules score 0.5 or more; labels serve to fit the rules only."""
    model = quality_rules.fit(docs, load_table(spark, sf_dir, "labels"))
    inner, columns = aside(docs, ["text"])
    return quality_rules.score(inner, model).where(F.col("predicted") == 1).select(*columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Documents without id are not compared and stay; rows that share an id stay or go together.
    """
    found = ngram_join.near_duplicates(docs, words=5, similarity=(4, 5))
    gone = found.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    left = docs.join(small_side(gone), "doc_id", "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``<secret>`` in place of every secret; ``n_chars``, if there, is counted anew."""
    out = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language), ("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's result is written to the shared folder and read by the next."""
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
