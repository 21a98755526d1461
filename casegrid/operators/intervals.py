"""Which intervals hold which others, where intervals may overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 1024


def contained(inner: DataFrame, outer: DataFrame, by: list[str], width: int = WIDTH) -> DataFrame:
    """Every (inner row, outer row) of one ``by`` where the inner start..end lies within the outer low..high, ends included, as the
    columns of both.  Outer intervals are split at multiples of ``width``; an inner one is in the bucket of its start only, so the join is
    one of equal keys and gives each pair once.  Nulls, and outer intervals that end before they begin, hold nothing."""
    buckets = F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))
    many = outer.filter("low <= high").withColumn("_bucket", F.explode(buckets))
    one = inner.withColumn("_bucket", F.floor(F.col("start") / width))
    return one.join(many, [*by, "_bucket"]).filter("low <= start and end <= high").drop("_bucket")
