"""Merging duplicate cases of a line list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.functions.nulls import null_if_blank, some
from casegrid.functions.text import name_key
from casegrid.schema import align, with_columns


def keyed(df: DataFrame) -> DataFrame:
    """``df`` under canonical names with dedupe_key: equal for rows of one person."""
    df = with_columns(align(df), ("case_id", "name", "onset_date"))
    df = df.withColumn("case_id", null_if_blank(F.upper(F.col("case_id"))))
    key = F.coalesce(F.concat(name_key("name"), F.lit(" "), F.coalesce("onset_date", F.lit("NA"))), F.col("case_id"), F.concat(F.lit("row_"), F.col("row_idx").cast("string")))
    return df.withColumn("dedupe_key", key)


def usable(df: DataFrame, c: str) -> Column:
    """Whether a column has a value worth keeping."""
    return some(c) if dict(df.dtypes)[c] == "string" else F.col(c).isNotNull()


def first_usable(df: DataFrame, columns: list[str]) -> list[Column]:
    """Of a group's rows each column's usable value of the smallest row number, or the value, usable or not, of the smallest."""

    def first(c: str) -> Column:
        ok = usable(df, c)
        return F.coalesce(F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("row_idx"))), F.min_by(c, "row_idx")).alias(c)

    return [first(c) for c in columns]


def merge_duplicates(df: DataFrame, by: tuple[str, ...] = (), numbered: bool = False) -> DataFrame:
    """One row per person: rows with equal normalised name and onset date, or without a name equal case_id, are merged and
    every column takes its first usable value in row order.  Needs ``row_idx``, of which the smallest is kept if ``numbered``;
    citations are left out."""
    df = keyed(df)
    columns = [c for c in df.columns if c not in ("row_idx", "citations", "dedupe_key", *by)]
    return df.groupBy(*by, "dedupe_key").agg(*first_usable(df, columns), *([F.min("row_idx").alias("row_idx")] if numbered else [])).drop("dedupe_key")
