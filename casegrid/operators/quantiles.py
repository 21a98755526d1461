"""Exact quantiles of columns in groups of any size, by histograms that are refined where a wanted value lies.

A pass counts the values in BINS bins of each interval that still holds a wanted rank, and keeps the least and the largest value
of each bin; the bin with the rank is the next interval, from its least to its largest value.  Bins are of equal width in every other
pass and of equal ratio in the others, so neither a wide range nor a narrow one takes many.  The ends of an interval fall
into different bins, so it shrinks until it is one value.  What a pass carries is BINS rows at most for each wanted rank,
whatever the group holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.plans.tables import written

BINS = 4096


def _cells(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, c (a column's name), x of all values that are numbers; NaN is none."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns)))
    return df.select(*keys, each.alias("v")).select(*keys, "v.*").filter("x is not null and not isnan(x)")


def _met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a`` joined with ``b`` on keys, in which nulls are equal, and c."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in (*keys, "c")})
    same = F.col("c") == F.col("_c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(b, same).drop("_c", *(f"_{k}" for k in keys))


def _bin(x: Column, lo: Column, hi: Column, bins: int, ratio: bool) -> Column:
    """The bin of a value: halves before the difference, so that it can't overflow; the upper end has the last bin."""
    ends = x == lo, x == hi
    if ratio:  # a scale on which all finite numbers are within 1,500 of zero, in order
        x, lo, hi = (F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.ln(F.abs(v)) + 746)) for v in (x, lo, hi))
    part = (x / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0))
    return F.when(ends[0], 0).when(ends[1], bins - 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.coalesce(part, F.lit(0.5)) * bins))).cast("int"))


def exact_quantiles(df: DataFrame, keys: list[str], columns: list[str], probabilities: list[float], bins: int = BINS) -> DataFrame:
    """keys, c, n (values of the column), q (array: the quantile of each probability, between neighbouring values in proportion).  Groups and
    columns without values have no row.  Values are finite.  Any column that ``keys`` name may be null."""
    cells = _cells(df, keys, columns)
    group = [*keys, "c"]
    ends = cells.groupBy(*group).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at(p)), F.ceil(at(p))) for p in probabilities))))
    # base: how many values lie below the interval
    todo = written(ends.select(*group, "n", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("bigint").alias("base")))
    done = todo.filter("lo = hi")
    known = [done.select(*group, "n", "rank", F.col("lo").alias("x"))]
    while True:
        todo = todo.filter("lo < hi")
        if todo.isEmpty():
            break
        wide = todo.select(*group, "lo", "hi", "base").distinct()
        inside = _met(cells, wide, keys).filter("x between lo and hi")
        own = [*group, "lo", "hi", "base"]
        counts = inside.groupBy(*own, _bin(F.col("x"), F.col("lo"), F.col("hi"), bins, len(known) % 2 == 0).alias("bin")).agg(F.count("*").alias("k"), F.min("x").alias("a"), F.max("x").alias("b"))
        below = F.coalesce(F.sum("k").over(W.partitionBy(*own).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("under", F.col("base") + below).select(*group, F.col("lo").alias("lo0"), F.col("hi").alias("hi0"), "k", "a", "b", "under")
        hit = _met(todo, counts, keys).filter("lo = lo0 and hi = hi0 and rank >= under and rank < under + k")
        todo = written(hit.select(*group, "n", "rank", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("under").alias("base")))
        known.append(todo.filter("lo = hi").select(*group, "n", "rank", F.col("lo").alias("x")))
    values = known[0]
    for k in known[1:]:
        values = values.unionByName(k)
    value = values.groupBy(*group, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("m"))

    def between(p: float) -> Column:
        low, high = F.col("m")[F.floor(at(p))], F.col("m")[F.ceil(at(p))]
        return F.when(low == high, low).otherwise((F.ceil(at(p)) - at(p)) * low + (at(p) - F.floor(at(p))) * high)

    return value.select(*group, "n", F.array(*map(between, probabilities)).alias("q"))
