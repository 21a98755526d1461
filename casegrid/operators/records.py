"""Looking at single cases: labels, fields with values, places and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.operators.joins import null_safe_join


def row_labels(df: DataFrame) -> DataFrame:
    """``df`` with label: the id, and the name behind it if there is one."""
    return df.withColumn("label", F.concat_ws(" - ", "case_id", F.nullif(F.col("name"), F.lit(""))))


def unpivoted(df: DataFrame, key: str = "row_idx") -> DataFrame:
    """key, field, value of every other column of each row; lists are joined by ", ", nulls are empty."""

    def flat(c: str, t: str):
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ", ") if t.startswith("array<") else F.col(c).cast("string")

    columns = [c for c, _ in df.dtypes if c != key]
    rows = df.select(key, *(F.coalesce(flat(c, t), F.lit("")).alias(c) for c, t in df.dtypes if c != key))
    return rows.unpivot(key, columns, "field", "value")


def first_place(wanted: DataFrame, df: DataFrame, column: str = "case_id") -> DataFrame:
    """``wanted`` with place: the smallest row_idx of ``df`` whose ``column`` is the same, nulls alike, or null."""
    places = df.groupBy(F.col(column).alias("k")).agg(F.min("row_idx").alias("place"))
    return wanted.join(places, F.col(column).eqNullSafe(F.col("k")), "left").drop("k")


def matched(df: DataFrame, other: DataFrame, column: str = "case_id") -> DataFrame:
    """The rows of ``df`` whose ``column`` is among those of ``other``; null is a value like any other."""
    return null_safe_join(df, other.select(F.col(column).alias("k")), column, "k", "left_semi")


def page(df: DataFrame, number: int, size: int = 10, order: tuple[str, ...] = ("row_idx",)) -> DataFrame:
    """One page of a table, from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def unmatched(df: DataFrame, other: DataFrame, column: str = "case_id") -> DataFrame:
    """The rows of ``df`` whose ``column`` is not among those of ``other``; null is a value like any other."""
    return null_safe_join(df, other.select(F.col(column).alias("k")), column, "k", "left_anti")
