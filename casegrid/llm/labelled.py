"""Labelled rows for the classifiers: which are held out, and a bounded sample of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string")) % modulus == remainder, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int) -> DataFrame:
    """(y, text) of at most ``per_class`` documents of each class that are not held out: those with the smallest
    hashes of their ids.  Of repeated labels the largest counts.  The ids are broadcast: there are 2 * per_class at most."""
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), modulus, remainder))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    order = F.xxhash64("doc_id")
    ids = known.filter("y = 1").orderBy(order).limit(per_class).unionByName(known.filter("y = 0").orderBy(order).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("y", "text")
