"""From documents to packed training sequences, one operator per stage.

Every stage sees all that its predecessor kept, as a table written in the shared folder. All but
the last return the columns of the table they are given, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adcorpus.llm.common import documents, written
from adcorpus.llm.exact_dedup import drop_copies
from adcorpus.llm.mixing import sample_mixture
from adcorpus.llm.near_dup import drop_near_copies
from adcorpus.llm.packing import pack
from adcorpus.llm.toxicity import drop_toxic, labels_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain rejects. Null and empty texts have no words
    and stay as texts without words do; without labelled documents all stay."""
    return drop_toxic(docs, labels_table(spark, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; null and empty texts are equal, a null doc_id
    stays only where no copy has one, and rows equal in id and text stay or go together."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest doc_id.
    Documents without words or without doc_id are in no group and stay."""
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of source, language and topic. Null values are a value of
    their own; texts without words cost nothing and stay; equal ids share their draw."""
    return sample_mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences. Null texts are empty and have the end id alone;
    a null doc_id stays null; equal lengths are placed by a hash of id and piece, repeated rows one
    by one; texts of any length are cut, none is left out."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mixture),
    ("packing", packed),
]

#: Classifier, signatures and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each on what the one before wrote. An empty table
    gives an empty result at every stage; columns other than those of ``documents`` are not read."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
