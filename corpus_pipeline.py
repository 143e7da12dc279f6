"""A corpus from raw documents to packed sequences: each stage works on all that its predecessor kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm import jaccard, linededup, mixing, packing, toxicity
from starfold.llm._common import documents, stored, unused, word_count


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of these documents; documents of score THRESHOLD or more go.

    Null and empty texts have the score of a text that says nothing, and stay; null ids, repeated rows
    and long texts are rows like others; an empty table stays empty. Columns keep their values.
    """
    name = unused(docs, "toxic_score")
    model = toxicity.learn(docs, documents(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name).filter(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document that consisted of nothing else goes with them.

    Null and empty texts stay; rows equal in id and text lose the same lines. n_chars follows the text.
    """
    name = unused(docs, "line_runs")
    out = linededup.dedup(docs, name=name)
    left = out.filter(F.col(name).isNull() | (word_count(F.col("text")) > 0))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return left.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least doc_id, null last.

    Texts without words (null, empty, blank) stay all; of rows equal in id and set of n-grams one stays.
    """
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the sources ask for them; null is a source of its own.

    Texts without words are taken like others of their size. An empty table stays empty.
    """
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in as few sequences as the packing can.

    Null text counts as empty and is one id; null ids and repeated rows are documents like others.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: Trained models, set similarity and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
