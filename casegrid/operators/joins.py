"""Joins in which null is a key like any other and a key of any size is shared by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.plans.tables import written

#: Rows of one key that one task takes from either side.
ROWS = 100_000


def _text_key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))


def null_safe_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", rows: int = ROWS) -> DataFrame:
    """``left`` joined with ``right`` where the keys are equal or both null: inner, left_semi or left_anti.  The other columns'
    names must differ; the right key goes.

    A key with more than ``rows`` rows is cut: into s parts on the left and t parts on the right by a hash of each row, and the
    parts are repeated so that each pair of parts meets in one place.  Tasks then hold about ``rows`` rows of each side,
    whatever a key's share of the table is.  For the semi and anti join the right side is first reduced to distinct keys.  The keys that are cut, one for every
    ``rows`` rows of input at most, are counted first and written; Spark sends them to all tasks if they are small."""
    a = left.withColumn("_k", _text_key(left_key))
    b = right.withColumn("_k", _text_key(right_key)).drop(right_key)
    if how != "inner":
        b = b.select("_k").distinct()
    sizes = a.select("_k", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("_k", F.lit(0).alias("x"), F.lit(1).alias("y")))
    parts = lambda c: F.ceil(F.sum(c) / rows).cast("int")
    cut = sizes.groupBy("_k").agg(parts("x").alias("_s"), parts("y").alias("_t")).filter("_s > 1 or _t > 1")
    cut = written(cut.withColumns({"_s": F.greatest("_s", F.lit(1)), "_t": F.greatest("_t", F.lit(1))}))

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        columns = [c for c in df.columns if c != "_k"]
        whole = F.xxhash64(*(c for c in columns if not dict(df.dtypes)[c].startswith("map"))) if columns else F.lit(0).cast("bigint")
        df = df.join(cut, "_k", "left")
        one = F.pmod(whole, F.coalesce(f"_{own}", F.lit(1)).cast("bigint")).cast("int")
        each = F.sequence(F.lit(0), F.coalesce(f"_{other}", F.lit(1)) - 1)
        return df.select(*columns, "_k", one.alias(f"_{own}"), F.explode(each).alias(f"_{other}"))

    return placed(a, "s", "t").join(placed(b, "t", "s"), ["_k", "_s", "_t"], how).drop("_k", "_s", "_t")
