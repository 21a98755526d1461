"""Quality rules (operator 5).

Base statistics of each whole text decide ``base_failed``; among the rest the method is a
robust multivariate outlier test.  Transformed statistics (length, as one over the root of the words, so that long texts are
no outliers by length alone; log word length; symbols, repeated lines and repeated words as roots of shares) get a minimum-covariance-determinant estimate
per language and source.  It begins at several fixed starts (medians and quantile widths, all
rows, and the rows with the smallest and with the most typical statistics).  From each, C-steps keep the
share H of rows with the smallest Mahalanobis distances, to the fraction of a row, and take their mean and
covariance, until no determinant falls any more; the start with the least determinant wins.  As
usual a last step takes mean and covariance of all rows that are not far from this estimate.
A row beyond the QUANTILE of the chi-square distribution is rejected.  Everything but the 5 x 5
inversions is grouped DataFrame sums with partial aggregation; a group that is a third
of all rows is no special case.

Two terms keep the determinant from zero, and neither is a bound or a switch.  Most texts have no symbols or repeats at all, and a
covariance of equal values says that any other value is impossible.  But a text shows a share only as well as its length
allows: counts are taken as Poisson numbers of events, and the variance that this gives each transformed statistic, averaged over
the rows of the estimate, is added to its covariance.  And each group's sums are joined by those of PRIOR rows of its
language's estimate, as the language's are by PRIOR rows of the one of all; a group of few rows is thus judged mostly as
its language is, a group of many by itself, and no number of rows changes the rule.

Defined results: a null text has no words, so it fails the base rules; a null language or
source is a value of its own, other than the empty one; very long texts are measured whole; repeated rows count each,
and rows at equal distances are kept or left out of a step together; an empty table gives none; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.llm.common import map_columns, table, work_dir, written

SYMBOLS = b"#*$%&|<>"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]")
#: A C-step counts if it lowers the determinant by more than this (in logarithms); they end when none does.
H, TOLERANCE, QUANTILE, PRIOR = 0.75, 1e-2, 0.999, 100
#: A repeated three-word window and its first occurrence are one event, and six words.
WORDS_PER_REPEAT = 6
DIMS = ("x0", "x1", "x2", "x3", "x4")
#: The counting variance of each transformed statistic.
NOISE = tuple(f"e{i}" for i in range(len(DIMS)))
BIN = 0.005
STARTS = ("median", "all", "low", "typical")


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    chars = len(text) - sum(raw.count(c) for c in b" \t\n\x0b\x0c\r")
    symbols = sum(raw.count(c) for c in SYMBOLS)
    seen, dups = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dups += bool(line.strip())
        else:
            seen.add(line)
    return n, chars, symbols, dups, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    _, pairs = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)  # numbered anew, so products stay small
    _, inverse, counts = np.unique(pairs[:-1].astype(np.int64) * len(ids) + at[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= again
    return int(covered.sum())


def _stats(batch: pa.RecordBatch) -> dict:
    got = [statistics(t) for t in batch.column("text").to_pylist()]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return {c: batch.column(c) for c in batch.schema.names if c != "text"} | {n: [g[i] for g in got] for i, n in enumerate(names)}


def measured(docs: DataFrame) -> DataFrame:
    """The base statistics, base_failed and the transformed statistics of each row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("\x00")).alias("lang"), F.coalesce("source", F.lit("\x00")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    stats = map_columns(rows, _stats, "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint")
    some, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return stats.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.lit(1.0) / F.sqrt(some)).alias("x0"),
        F.log((F.col("word_chars") + 1) / some).alias("x1"),
        F.sqrt(F.col("n_symbols") / chars).alias("x2"),
        F.sqrt(F.col("n_dup_lines") / some).alias("x3"),
        F.sqrt(F.col("n_repeat_words") / some).alias("x4"),
        # by the delta method, of as many events as there are
        (0.25 / (some.cast("double") * some)).alias("e0"),
        (1.0 / chars).alias("e1"),
        (0.25 / chars).alias("e2"),
        (0.25 / some).alias("e3"),
        (0.25 * WORDS_PER_REPEAT / some).alias("e4"),
    )


def chi_square(quantile: float, dims: int = len(DIMS)) -> float:
    """The quantile of the chi-square distribution with an odd number of degrees of freedom."""

    def below(x: float) -> float:
        term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 0.0
        for k in range(3, dims + 1, 2):
            total += term
            term *= x / k
        return math.erf(math.sqrt(x / 2)) - total

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < quantile else (lo, mid)
    return hi


def consistency(share: float, dims: int = len(DIMS)) -> float:
    """What the covariance of the ``share`` of Gaussian rows with the smallest distances must be multiplied with."""
    return share / (1 - _upper(chi_square(share, dims), dims + 2))


def _upper(x: float, dims: int) -> float:
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 0.0
    for k in range(3, dims + 1, 2):
        total += term
        term *= x / k
    return 1 - math.erf(math.sqrt(x / 2)) + total


_MODEL = "g string, start string, mean array<double>, inverse array<double>, logdet double"
_PAIRS = [(i, j) for i in range(len(DIMS)) for j in range(i, len(DIMS))]
_SUMS = [f"s{i}" for i in range(len(DIMS))] + [f"q{i}{j}" for i, j in _PAIRS] + [f"t{i}" for i in range(len(DIMS))]


def _sums() -> list[Column]:
    first = [f"sum({a}) AS s{i}" for i, a in enumerate(DIMS)]
    second = [f"sum({DIMS[i]} * {DIMS[j]}) AS q{i}{j}" for i, j in _PAIRS]
    return [F.expr(e) for e in ["count(*) AS n", *first, *second, *(f"sum({a}) AS t{i}" for i, a in enumerate(NOISE))]]


def estimate(n: float, sums: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance and the logarithm of its determinant from a group's sums."""
    k, noise = len(DIMS), len(DIMS) + len(_PAIRS)
    mean = sums[:k] / n
    cov = np.diag(sums[noise:] / n + 1e-9)
    for (i, j), q in zip(_PAIRS, sums[k:noise], strict=True):
        part = scale * (q / n - mean[i] * mean[j])
        cov[i, j] += part
        if i != j:
            cov[j, i] += part
    return mean, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def _model(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(g, s, m.tolist(), i.ravel().tolist(), float(d)) for g, s, m, i, d in rows], columns=["g", "start", "mean", "inverse", "logdet"])


def nearest(binned: DataFrame, share: float) -> DataFrame:
    """From the sums of bins of ascending distance, by g and start: those of the nearest ``share`` of all rows; of the bin in
    which this ends, its part."""
    key = ["g", "parent", "start"]
    every = W.partitionBy(*key)
    before = F.coalesce(F.sum("n").over(every.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share * F.sum("n").over(every) - before) / F.col("n")))
    return binned.withColumn("part", part).groupBy(*key).agg(*(F.expr(f"sum(part * {c}) AS {c}") for c in ("n", *_SUMS)))


def _trimmed(binned: DataFrame, share: float, scale: float) -> DataFrame:
    """The estimate of the nearest ``share`` of all rows, by g and start, with PRIOR rows of the language's."""

    def estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x = p[["n", *_SUMS]].to_numpy(float)
            yield _model([(g, s, *estimate(r[0], r[1:], scale)) for g, s, r in zip(p["g"], p["start"], x, strict=True)])

    sums, names = nearest(binned, share), ["n", *_SUMS]  # one row for each group and start
    sums = sums.selectExpr("*", *(f"sum({c}) OVER (PARTITION BY parent, start) AS p_{c}" for c in names), *(f"sum({c}) OVER (PARTITION BY start) AS a_{c}" for c in names))
    sums = sums.selectExpr("g", "start", *(f"{c} + {PRIOR} * (p_{c} + {PRIOR} * a_{c} / a_n) / (p_n + {PRIOR}) AS {c}" for c in names))
    return sums.mapInPandas(estimates, _MODEL)


def _medians(rows: DataFrame) -> DataFrame:
    """Medians and quantile widths from counts of fixed bins: exact to a bin, whatever the partitions."""
    each = F.posexplode(F.array(*(F.struct(F.col(x).alias("x"), F.col(e).alias("e")) for x, e in zip(DIMS, NOISE, strict=True)))).alias("d", "v")
    bins = rows.select("g", each).groupBy("g", "d", F.floor(F.col("v.x") / BIN).alias("b")).agg(F.count("*").alias("c"), F.sum("v.e").alias("e"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        mean, var = [], []
        for d in range(len(DIMS)):
            q = p[p.d == d].sort_values("b")
            share = q.c.cumsum().to_numpy() / q.c.sum()
            lo, mid, hi = (BIN * (q.b.to_numpy()[np.searchsorted(share, f)] + 0.5) for f in (0.25, 0.5, 0.75))
            mean.append(float(mid))
            var.append(((hi - lo) / 1.349) ** 2 + q.e.sum() / q.c.sum() + BIN**2)
        return _model([(p.g.iloc[0], "median", np.array(mean), np.diag(1 / np.array(var)), np.log(var).sum())])

    return bins.groupBy("g").applyInPandas(run, _MODEL)


def _distance(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` with start and d2 for each model of their group."""
    k = len(DIMS)
    dev = [f"({a} - mean[{i}])" for i, a in enumerate(DIMS)]
    d2 = F.expr(" + ".join(f"{dev[i]} * {dev[j]} * inverse[{i * k + j}] * {1 if i == j else 2}" for i, j in _PAIRS))
    return rows.join(model.select("g", "start", "mean", "inverse"), "g", "left").withColumn("d2", d2).drop("mean", "inverse")


def _binned(rows: DataFrame, by: Column) -> DataFrame:
    return rows.withColumn("bin", by).groupBy("g", "parent", "start", "bin").agg(*_sums())


def mcd(rows: DataFrame, path: str) -> DataFrame:
    """The model (g, start, mean, inverse, logdet) of each group of ``rows`` (g, DIMS and, if there are, NOISE and the
    ``parent`` that a group leans on).  A step is one pass: the rows' sums by group, start and bin of the distance, of which the nearest are
    put together."""
    rows = rows.select("g", F.col("parent") if "parent" in rows.columns else F.lit("").alias("parent"), *DIMS, *(F.col(e) if e in rows.columns else F.lit(0.0).alias(e) for e in NOISE))
    near, scale = F.floor(F.log1p("d2") * 64), consistency(H)
    models = len(STARTS) * rows.select("g").distinct().count()
    medians = written(_medians(rows), f"{path}/medians", models)
    d2 = F.floor(F.log1p(F.greatest("d2", F.lit(0.0))) * 64)
    from_median = _distance(rows, medians).withColumn("t", d2)
    other = F.explode(F.array(
        F.struct(F.lit("all").alias("start"), F.lit(0).cast("bigint").alias("bin")),
        F.struct(F.lit("low").alias("start"), F.floor(sum((F.col(a) for a in DIMS[2:]), F.lit(0.0)) / BIN).alias("bin")),
        F.struct(F.lit("typical").alias("start"), F.col("t").alias("bin")),
    )).alias("o")
    starts = from_median.select("g", "parent", *DIMS, *NOISE, other).select("g", "parent", *DIMS, *NOISE, "o.*").groupBy("g", "parent", "start", "bin").agg(*_sums())
    model = written(_trimmed(starts, 0.5, 1.0).unionByName(medians), f"{path}/model0", models)
    model, step = written(_trimmed(_binned(_distance(rows, model), near), H, scale), f"{path}/model1", models), 1
    while True:
        step += 1
        after = _trimmed(_binned(_distance(rows, model), near), H, scale)
        old = model.select("g", "start", *(F.col(c).alias(f"old_{c}") for c in ("mean", "inverse", "logdet")))
        falls = F.col("logdet") < F.col("old_logdet") - TOLERANCE
        both = after.join(old, ["g", "start"]).select("g", "start", *(F.when(falls, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("mean", "inverse", "logdet")), falls.alias("falls"))
        model = written(both, f"{path}/model{step}", models)
        if model.filter("falls").isEmpty():
            break
    best = model.groupBy("g").agg(F.min_by(F.struct("start", "mean", "inverse", "logdet"), F.struct("logdet", "start")).alias("m")).select("g", "m.*")
    close = _distance(rows, best).filter(F.col("d2") <= chi_square(0.975)).withColumn("bin", F.lit(0)).groupBy("g", "parent", "start", "bin").agg(*_sums())
    return written(_trimmed(close, 1.0, consistency(0.975)), f"{path}/model", models)


def judge(docs: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The base statistics, base_failed, kept and distance2 of each row."""
    path = work_dir(docs.sparkSession)
    group = F.concat_ws("\x01", "lang", "source")
    stats = written(measured(docs).withColumn("g", group).withColumnRenamed("lang", "parent").drop("source"), f"{path}/stats")
    model = mcd(stats.filter(~F.col("base_failed")), path)
    return _distance(stats, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= chi_square(quantile))).alias("kept"), F.col("d2").alias("distance2"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
