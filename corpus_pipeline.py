"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents as they came, whatever they are called: a stage reads ``doc_id``, ``text`` and ``lang`` and sets the others aside.

Defined cases, for all stages: an empty table gives no rows; a null or empty text fails the quality rules, is one class of
near-duplicates, stays as it is under pseudonyms and packs as its end token; rows with null or equal ids are rows of their own;
equal texts are one class, of which the row with the smallest id stays (those without one come last).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import bradley_terry, near_copies, packing, pii, quality_rules
from quillspan.llm.common import documents, set_aside, written


def drop_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    inner, back = set_aside(docs, doc_id="doc_id", text="text", lang="lang")
    return back(quality_rules.quality_rules(inner).filter("kept"))


def drop_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled documents that are left."""
    inner, back = set_aside(docs, doc_id="doc_id", text="text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return back(bradley_terry.classify(inner, labels, learn=bradley_terry.learnable()).filter(F.col("predicted") == 1))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates (five-word Jaccard of 0.8 or more, exact copies included): the one with the smallest id."""
    return near_copies.one_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts."""
    inner, back = set_aside(docs, text="text")
    return back(pii.pseudonymise(inner))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", drop_by_rules),
    ("quality_classifier", drop_by_classifier),
    ("near_duplicates", drop_near_duplicates),
    ("pseudonyms", replace_personal_data),
    ("packing", pack_sequences),
]

#: Perplexity, tokenizing and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
