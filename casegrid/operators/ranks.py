"""Sums and maxima over the earlier rows of groups of any size.

With ``chunked`` they come in two levels, chunks of CHUNK order values and the chunks of a group, so that no task has a whole
group; without it one window does, which is quicker for groups that a task can sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 8192


def _earlier(df: DataFrame, group: list[str], order: str, value: Column, fold, both, name: str, chunked: bool) -> DataFrame:
    if not chunked:
        one = fold(value).over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
        return df.withColumn(name, both(F.lit(None), one))
    df = df.withColumns({"_chunk": F.floor(F.col(order) / CHUNK), "_value": value})
    chunks = df.groupBy(*group, "_chunk").agg(fold("_value").alias("_of"))
    before = W.partitionBy(*group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    df = df.join(chunks.select(*group, "_chunk", fold("_of").over(before).alias("_far")), [*group, "_chunk"])
    inside = fold("_value").over(W.partitionBy(*group, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn(name, both(F.col("_far"), inside)).drop("_chunk", "_value", "_of", "_far")


def earlier_sum(df: DataFrame, group: list[str], order: str, value: Column, name: str, chunked: bool = True) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group before each row by ``order`` (integers, distinct in a group)."""
    return _earlier(df, group, order, value, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), name, chunked)


def earlier_max(df: DataFrame, group: list[str], order: str, value: Column, name: str, chunked: bool = True) -> DataFrame:
    """The same with the largest ``value``; null where no row is before."""
    return _earlier(df, group, order, value, F.max, F.greatest, name, chunked)


def ranked(df: DataFrame, group: list[str], order: str, name: str, chunked: bool = True) -> DataFrame:
    """``df`` with the rank, from 0, of each row in its group."""
    return earlier_sum(df, group, order, F.lit(1), name, chunked).withColumn(name, F.col(name).cast("bigint"))
