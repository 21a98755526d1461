"""From raw documents to token ids: toxic documents go, repeated line chunks are cut, one document of each
near-duplicate class stays, documents that hold benchmark passages go, and the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes every stage's result to the shared folder and reads it again for the next.

Defined results: a null text counts as empty, is never toxic and has nothing to cut, and stays null until it is encoded (to no
tokens); of all rows without words one stays; repeated rows and rows with equal words are one class, of which the row with the
smallest id stays (no id before all others, then the smallest hash of the text); rows without an id, and different texts under one id, are texts of
their own; very long texts are worked on whole; labels and items without a document are ignored; an empty table gives none at every
stage.  All columns of documents, whatever further ones there are and whatever their names, reach the last stage as
they are, but for text and n_chars, which line dedup renews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casegrid.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from casegrid.llm.common import table, work_dir, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is learned from the labelled documents among ``docs`` that are not held out."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", one_of_each_class),
    ("decontamination", decontaminated),
    ("byte_bpe", encoded),
]

#: Trained models and sketches have no SQL form; a test holds each stage against brute force on what the one before kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), work_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"{path}/{k}-{name}")
    return docs
