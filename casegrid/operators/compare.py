"""Comparing an extracted line list with the true one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.functions.nulls import no_name, null_like
from casegrid.functions.text import cells_match
from casegrid.operators.match import greedy_match
from casegrid.schema import align, column_sets


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _rates(df: DataFrame, tp: str, n_llm: str, n_gt: str) -> DataFrame:
    df = df.withColumns({"precision": ratio(F.col(tp), F.col(n_llm)), "recall": ratio(F.col(tp), F.col(n_gt))})
    return df.withColumn("f1_score", f1(F.col("precision"), F.col("recall")))


def case_detection(llm: DataFrame, gt: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: true_positives, false_positives, false_negatives, precision, recall, f1_score."""
    counts = [df.agg(F.count("*").alias(c)) for df, c in ((llm, "n_llm"), (gt, "n_gt"), (matches, "true_positives"))]
    one = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each
    one = one.withColumns({"false_positives": F.col("n_llm") - F.col("true_positives"), "false_negatives": F.col("n_gt") - F.col("true_positives")})
    return _rates(one, "true_positives", "n_llm", "n_gt").drop("n_llm", "n_gt")


def fp_analysis(llm: DataFrame, matches: DataFrame) -> DataFrame:
    """llm_idx, name, category of extracted rows without a true one."""
    left = llm.select(F.col("row_idx").alias("llm_idx"), "name").join(matches.select("llm_idx"), "llm_idx", "left_anti")
    kind = F.when(no_name("name"), "Empty/Null Name").when(F.length("name") < 3, "Noise/Fragment").otherwise("Hallucination / Extra Extraction")
    return left.withColumn("category", kind)


def fn_analysis(gt: DataFrame, matches: DataFrame) -> DataFrame:
    """gt_idx, name, category of true rows that were not extracted."""
    left = gt.select(F.col("row_idx").alias("gt_idx"), "name").join(matches.select("gt_idx"), "gt_idx", "left_anti")
    return left.withColumn("category", F.when(no_name("name"), "Empty GT Name").otherwise("Missed Case"))


def case_names(llm: DataFrame, gt: DataFrame, matches: DataFrame) -> DataFrame:
    """status (detected, missed, extra), row_idx and name: the names behind ``case_detection``.  A detected case is named by
    its extracted row."""
    rows = lambda df, status: df.select(F.lit(status).alias("status"), "row_idx", "name")
    taken = lambda c: matches.select(F.col(c).alias("row_idx"))
    detected = rows(llm, "detected").join(taken("llm_idx"), "row_idx", "left_semi")
    extra, missed = rows(llm, "extra").join(taken("llm_idx"), "row_idx", "left_anti"), rows(gt, "missed").join(taken("gt_idx"), "row_idx", "left_anti")
    return detected.unionByName(missed).unionByName(extra)


def compared_cells(llm: DataFrame, gt: DataFrame, matches: DataFrame, columns: list[str]) -> DataFrame:
    """column, llm_idx, has_llm, has_gt, same, error_type of every shared column of every matched pair."""
    a = llm.select(F.col("row_idx").alias("llm_idx"), *(F.col(c).cast("string").alias(f"{c}_llm") for c in columns))
    b = gt.select(F.col("row_idx").alias("gt_idx"), *(F.col(c).cast("string").alias(f"{c}_gt") for c in columns))
    pairs = matches.select("llm_idx", "gt_idx").join(a, "llm_idx").join(b, "gt_idx")
    cells = [F.struct(F.lit(c).alias("column"), (~null_like(f"{c}_llm")).alias("has_llm"), (~null_like(f"{c}_gt")).alias("has_gt"), cells_match(f"{c}_llm", f"{c}_gt", c).alias("same")) for c in columns]
    long = pairs.select("llm_idx", F.explode(F.array(*cells)).alias("cell")).select("llm_idx", "cell.*")
    kind = (
        F.when(F.col("same"), "None")
        .when(~F.col("has_llm") & F.col("has_gt"), "False Negative (Missing Value)")
        .when(F.col("has_llm") & ~F.col("has_gt"), "False Positive (Hallucinated Value)")
        .when(F.col("has_llm") & F.col("has_gt"), "Content Mismatch")
        .otherwise("Other")
    )
    return long.withColumn("error_type", kind)


def completeness(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """column and the share of all rows with a value."""
    one = df.agg(*(F.avg((~null_like(c)).cast("double")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in columns))).alias("x")).select("x.*")


def column_metrics(llm: DataFrame, gt: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    """Per column precision, recall, f1_score, accuracy among matched pairs, and completeness of either table.  Where
    no pair has a value on either side all four are 1."""
    n = lambda c: F.sum(c.cast("bigint"))
    both = F.col("has_llm") & F.col("has_gt")
    sums = cells.groupBy("column").agg(n(F.col("same") & both).alias("tp"), n(F.col("has_llm")).alias("n_llm"), n(F.col("has_gt")).alias("n_gt"), n(both).alias("n_both"))
    rates = _rates(sums, "tp", "n_llm", "n_gt").withColumn("accuracy", ratio(F.col("tp"), F.col("n_both")))
    nothing = (F.col("n_llm") == 0) & (F.col("n_gt") == 0)
    rates = rates.select("column", *(F.when(nothing, 1.0).otherwise(F.col(c)).alias(c) for c in ("precision", "recall", "f1_score", "accuracy")))
    return rates.join(completeness(llm, columns, "completeness_llm"), "column").join(completeness(gt, columns, "completeness_gt"), "column")


def error_breakdown(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("error_type") != "None").groupBy("column", "error_type").agg(F.count("*").alias("n"))


def unmatched_overlap(llm: DataFrame, gt: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the overlap of the two tables' distinct values: for line lists without a matching of rows."""

    def values(df: DataFrame, mark: str) -> DataFrame:
        rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), (~null_like(c)).alias("ok")) for c in columns))).alias("x")).select("x.*")
        return rows.filter("ok").select("column", "value").distinct().withColumn(mark, F.lit(1))

    both = values(llm, "a").join(values(gt, "b"), ["column", "value"], "full")
    n = both.groupBy("column").agg(F.count("a").alias("n_llm"), F.count("b").alias("n_gt"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("tp"), F.count("*").alias("n_any"))
    rates = _rates(n, "tp", "n_llm", "n_gt").withColumn("accuracy", ratio(F.col("tp"), F.col("n_any")))
    every = llm.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(rates, "column", "left").select("column", *(F.coalesce(c, F.lit(1.0)).alias(c) for c in ("precision", "recall", "f1_score", "accuracy")))


def overall(metrics: DataFrame) -> DataFrame:
    """Means over the columns, and how many were compared."""
    cols = ("precision", "recall", "f1_score", "accuracy", "completeness_llm", "completeness_gt")
    return metrics.agg(*(F.avg(c).alias(c) for c in cols), F.count("precision").alias("n_columns_compared"))


def compare_linelists(llm: DataFrame, gt: DataFrame) -> dict[str, DataFrame | dict]:
    """All of the above for two line lists with a ``row_idx``; structure holds the column sets."""
    llm, gt = align(llm), align(gt)
    matches = greedy_match(llm, gt)
    shared, only_llm, only_gt = ([c for c in x if c != "row_idx"] for x in column_sets(llm, gt))
    cells = compared_cells(llm, gt, matches, shared)
    per_column = column_metrics(llm, gt, cells, shared)
    return {
        "structure": {"shared": shared, "llm_only": only_llm, "gt_only": only_gt},
        "matches": matches,
        "case_detection": case_detection(llm, gt, matches),
        "case_names": case_names(llm, gt, matches),
        "false_positives": fp_analysis(llm, matches),
        "false_negatives": fn_analysis(gt, matches),
        "column_metrics": per_column,
        "error_breakdown": error_breakdown(cells),
        "overall": overall(per_column),
    }
