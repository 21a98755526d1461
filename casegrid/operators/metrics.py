"""Case, variable and list metrics, and their summary over replicate runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.functions.nulls import null_like
from casegrid.functions.text import case_ids_upper, name_key, near_either_way, same_set
from casegrid.functions.text import _short_name as short_name
from casegrid.operators.compare import f1, ratio
from casegrid.operators.joins import null_safe_join
from casegrid.operators.quantiles import exact_quantiles
from casegrid.plans.tables import written
from casegrid.schema import with_columns

VARIABLES = (
    "name", "age", "sex", "residence_village", "health_zone", "onset_date", "outcome_date", "outcome", "classification",
    "potential_infector", "most_probable_infector", "contacts", "secondary_cases",
)
LIST_VARIABLES = ("secondary_cases", "potential_infector")
ID_VARIABLES = ("contacts", "secondary_cases", "potential_infector", "most_probable_infector")
DATES = ("onset_date", "outcome_date")


def without_ids(df: DataFrame, ids: list[str] | None) -> DataFrame:
    """Rows whose case_id is not among ``ids``; a null id is not among them."""
    return df.filter(~F.coalesce(F.col("case_id").isin(ids), F.lit(False))) if ids else df


def first_per_case(df: DataFrame) -> DataFrame:
    """The first row of each case_id by row_idx; nulls are one id.  Partial minima meet, not a case's rows."""
    return df.groupBy("case_id").agg(F.min_by(F.struct(*(c for c in df.columns if c != "case_id")), "row_idx").alias("r")).select("case_id", "r.*").select(*df.columns)


def pairs_by_case(llm: DataFrame, gt: DataFrame, columns: list[str]) -> DataFrame:
    """Inner join on case_id where null equals null: case_id and <column>_llm, <column>_gt."""
    a = llm.select(F.col("case_id").alias("k"), *(F.col(c).alias(f"{c}_llm") for c in columns))
    b = gt.select("case_id", *(F.col(c).alias(f"{c}_gt") for c in columns))
    return null_safe_join(b, a, "case_id", "k")


def _distinct_keys(df: DataFrame, key: Column) -> DataFrame:
    return df.select(key.alias("k")).distinct()


def case_metrics(llm: DataFrame, gt: DataFrame, few_shot_ids: list[str] | None = None) -> DataFrame:
    """One row: case_f1, case_recall, case_precision, date_accuracy, n_gt_cases, n_llm_cases, n_matched_cases.  Cases are
    matched by id; if no id matches, by normalised name, and then the counts are of distinct names."""
    # each list is read several times, by its four columns
    gt, llm = (written(without_ids(df, few_shot_ids).select("row_idx", "case_id", "name", "onset_date", name_key("name").alias("nk"))) for df in (gt, llm))

    def counts(key: Column, suffix: str, keep_null: bool) -> DataFrame:
        one, two = (_distinct_keys(df, key) if keep_null else _distinct_keys(df, key).filter("k is not null") for df in (gt, llm))
        both = one.withColumn("side", F.lit(1)).unionByName(two.withColumn("side", F.lit(2))).groupBy("k").agg(F.sum("side").alias("s"))
        n = lambda *s: F.count(F.when(F.col("s").isin(*s), 1))
        return both.agg(n(1, 3).alias(f"g{suffix}"), n(2, 3).alias(f"l{suffix}"), n(3).alias(f"m{suffix}"))

    def dates(key: str) -> DataFrame:
        a, b = (df.withColumn("k", F.col("nk")).filter("k is not null") if key == "n" else df.withColumn("k", F.col("case_id")) for df in (gt, llm))
        if key == "n":
            a, b = (df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("row_idx"))).filter("r = 1") for df in (a, b))
        pair = a.select("k", F.col("onset_date").alias("x")).join(b.select(F.col("k").alias("q"), F.col("onset_date").alias("y")), F.col("k").eqNullSafe(F.col("q")))
        same = (F.col("x") == F.col("y")) | (F.col("x").isNull() & F.col("y").isNull())
        return pair.agg(F.avg(same.cast("double")).alias(f"d{key}"))

    one = counts(F.col("case_id"), "i", True).crossJoin(counts(F.col("nk"), "n", False)).crossJoin(dates("i")).crossJoin(dates("n"))  # one row each
    by_name = (F.col("mi") == 0) & (F.col("gi") > 0) & (F.col("li") > 0) & (F.col("mn") > 0)
    pick = lambda a, b: F.when(by_name, F.col(b)).otherwise(F.col(a))
    one = one.select(pick("gi", "gn").alias("n_gt_cases"), pick("li", "ln").alias("n_llm_cases"), pick("mi", "mn").alias("n_matched_cases"), pick("di", "dn").alias("date_accuracy"))
    p, r = ratio(F.col("n_matched_cases"), F.col("n_llm_cases")), ratio(F.col("n_matched_cases"), F.col("n_gt_cases"))
    return one.select(f1(p, r).alias("case_f1"), r.alias("case_recall"), p.alias("case_precision"), "date_accuracy", "n_gt_cases", "n_llm_cases", "n_matched_cases")


def with_list_metrics(df: DataFrame, gt: str, llm: str) -> DataFrame:
    """``df`` with the id lists of two text columns as sets, and their precision, recall and f1: gt_ids, llm_ids,
    matched_ids, n_gt, n_llm, n_matched, list_precision, list_recall, list_f1."""
    own = lambda c: F.when(null_like(c), F.array().cast("array<string>")).otherwise(case_ids_upper(F.coalesce(F.col(c), F.lit(""))))
    df = df.withColumns({"gt_ids": own(gt), "llm_ids": own(llm)})
    df = df.withColumn("matched_ids", F.array_intersect("gt_ids", "llm_ids"))
    df = df.withColumns({"n_gt": F.size("gt_ids"), "n_llm": F.size("llm_ids"), "n_matched": F.size("matched_ids")})
    n_gt, n_llm, n = F.col("n_gt"), F.col("n_llm"), F.col("n_matched")
    p = F.when((n_gt == 0) & (n_llm == 0), 1.0).when(n_gt == 0, 0.0).when(n_llm == 0, 1.0).otherwise(n / n_llm)
    r = F.when((n_gt == 0) & (n_llm == 0), 1.0).when(n_gt == 0, 1.0).when(n_llm == 0, 0.0).otherwise(n / n_gt)
    df = df.withColumns({"list_precision": p, "list_recall": r})
    return df.withColumn("list_f1", f1(F.col("list_precision"), F.col("list_recall")))


def names_to_ids(rows: DataFrame, gt: DataFrame, column: str) -> DataFrame:
    """``rows`` with names in ``column`` (without any case id) replaced by the ids of the true cases of those names."""
    first = gt.select(name_key("name").alias("k"), "case_id", "row_idx").filter("k is not null and case_id is not null")
    first = first.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("row_idx"))).filter("r = 1").select("k", "case_id")
    todo = (F.size(case_ids_upper(F.coalesce(F.col(column), F.lit("")))) == 0) & ~null_like(column)
    parts = rows.filter(todo).select(F.col(column).alias("v")).distinct().select("v", F.posexplode(F.split("v", ",")).alias("i", "part"))
    found = parts.select("v", "i", name_key("part").alias("k")).join(first, "k")
    ids = found.groupBy("v").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "case_id"))), lambda x: x["case_id"]), ", ").alias("ids"))
    cols = [c for c in rows.columns if c != column]
    return rows.join(ids, F.col(column) == F.col("v"), "left").select(*cols, F.coalesce("ids", column).alias(column)).select(*rows.columns)


def remapped(llm: DataFrame, gt: DataFrame) -> DataFrame:
    """``llm`` where, if no id of it is among those of ``gt``, rows whose normalised name a true case has get that case's id,
    the first one's by row_idx."""
    met = gt.select("case_id").join(llm.select(F.col("case_id").alias("q")), F.col("case_id").eqNullSafe(F.col("q")), "left_semi")
    none = met.agg((F.count("*") == 0).alias("none"))  # one row
    first = gt.select(name_key("name").alias("nk"), "case_id", "row_idx").filter("nk is not null").groupBy("nk").agg(F.min_by("case_id", "row_idx").alias("true_id"))
    new = F.when(F.col("none") & F.col("true_id").isNotNull(), F.col("true_id")).otherwise(F.col("case_id"))
    rows = llm.withColumn("nk", name_key("name")).join(first, "nk", "left").crossJoin(F.broadcast(none))
    return rows.select(*(new.alias(c) if c == "case_id" else c for c in llm.columns))


def values_agree(gt: Column, llm: Column, variable: Column) -> Column:
    """Typed equality of two values in the variable metrics; ids are compared in upper case and a date keeps its slashes."""
    a, b = case_ids_upper(gt), case_ids_upper(llm)
    lists = F.when((F.size(a) == 0) & (F.size(b) == 0), True).otherwise((F.size(a) > 0) & (F.size(b) > 0) & same_set(a, b))
    x, y = short_name(gt), short_name(llm)
    names = F.when((x == "") & (y == ""), True).otherwise((x != "") & (y != "") & near_either_way(x, y))
    one = lambda c: F.lower(F.trim(F.regexp_replace(c, "[^a-zA-Z0-9/ ]", "")))
    same = F.when(variable.isin(*ID_VARIABLES), lists).when(variable == "name", names).otherwise(one(gt) == one(llm))
    return F.when(null_like(gt) & null_like(llm), True).when(null_like(gt) | null_like(llm), False).otherwise(F.coalesce(same, F.lit(False)))


def variable_metrics(llm: DataFrame, gt: DataFrame, few_shot_ids: list[str] | None = None, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """Per variable n_compared, n_match, f1, precision, recall, completeness_llm, completeness_gt.  Rows are joined by
    case_id, first row each; if no id matches, names lead extracted cases to true ids.  A true case that was not extracted
    counts against recall.  Without true cases both counts are 0 and the rest null.  One aggregation for all variables."""
    needed = tuple(dict.fromkeys(("case_id", "name", *variables)))
    project = lambda df: with_columns(df, needed).select("row_idx", *needed)
    all_gt, llm = written(project(gt)), written(project(llm))  # each is read several times
    gt, llm = without_ids(all_gt, few_shot_ids), without_ids(llm, few_shot_ids)
    llm = first_per_case(remapped(llm, gt))
    gt = first_per_case(gt)
    for v in variables:
        if v in ID_VARIABLES:
            llm = names_to_ids(llm, all_gt, v)
    a = gt.select(F.col("case_id").alias("k"), *(F.col(v).cast("string").alias(f"{v}_gt") for v in variables))
    b = llm.select(F.col("case_id").alias("q"), F.lit(True).alias("hit"), *(F.col(v).cast("string").alias(f"{v}_llm") for v in variables))
    rows = a.join(b, F.col("k").eqNullSafe(F.col("q")), "left")
    cells = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f"{v}_gt").alias("gt"), F.col(f"{v}_llm").alias("llm")) for v in variables))
    long = rows.select(F.coalesce("hit", F.lit(False)).alias("hit"), F.explode(cells).alias("c")).select("hit", "c.*")
    lists = F.col("variable").isin(*LIST_VARIABLES)
    same = F.when(~lists, values_agree(F.col("gt"), F.col("llm"), F.col("variable"))).otherwise(False)
    long = with_list_metrics(long.select("*", (~null_like("gt")).alias("has_gt"), (~null_like("llm")).alias("has_llm"), same.alias("same")), "gt", "llm")
    n = lambda c: F.sum(c.cast("bigint"))
    both = F.col("hit") & F.col("has_gt") & F.col("has_llm")
    s = long.groupBy("variable").agg(
        n(both).alias("both"), n(both & F.col("same")).alias("tp"), n(F.col("hit") & F.col("has_llm")).alias("s_llm"), n(F.col("has_gt")).alias("s_gt"),
        n(F.col("hit")).alias("n_hit"), F.count("*").alias("n_all"), n((F.col("n_gt") > 0) | (F.col("n_llm") > 0)).alias("any"), F.sum("n_matched").alias("ids"),
        F.avg("list_precision").alias("lp"), F.avg("list_recall").alias("lr"), F.avg("list_f1").alias("lf"),
    )
    p, r = F.try_divide(F.col("tp"), F.col("s_llm")), F.try_divide(F.col("tp"), F.col("s_gt"))
    every = s.sparkSession.createDataFrame([(v,) for v in variables], "variable string")
    s = every.join(s, "variable", "left").fillna(0, ["any", "both", "ids", "tp"])
    return s.select(
        "variable",
        F.when(lists, F.col("any")).otherwise(F.col("both")).cast("int").alias("n_compared"),
        F.when(lists, F.col("ids")).otherwise(F.col("tp")).cast("int").alias("n_match"),
        F.when(lists, F.col("lf")).otherwise(F.when(p + r > 0, 2 * p * r / (p + r))).alias("f1"),
        F.when(lists, F.col("lp")).otherwise(p).alias("precision"),
        F.when(lists, F.col("lr")).otherwise(r).alias("recall"),
        F.try_divide(F.col("s_llm"), F.col("n_hit")).alias("completeness_llm"),
        F.try_divide(F.col("s_gt"), F.col("n_all")).alias("completeness_gt"),
    )


def per_case_list_metrics(llm: DataFrame, gt: DataFrame, few_shot_ids: list[str] | None = None) -> DataFrame:
    """Two rows for each joined pair of rows: the id lists of secondary_cases and potential_infector, joined, and their metrics."""
    gt = without_ids(gt, few_shot_ids)
    pairs = pairs_by_case(with_columns(llm, LIST_VARIABLES), with_columns(gt, LIST_VARIABLES), list(LIST_VARIABLES))
    cells = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f"{v}_gt").alias("gt"), F.col(f"{v}_llm").alias("llm")) for v in LIST_VARIABLES))
    long = with_list_metrics(pairs.select("case_id", F.explode(cells).alias("c")).select("case_id", "c.*"), "gt", "llm")
    join = lambda c, name: F.array_join(c, ", ").alias(name)
    return long.select(
        "case_id", "variable", join("gt_ids", "gt_ids"), join("llm_ids", "llm_ids"), join("matched_ids", "matched_ids"),
        join(F.array_except("gt_ids", "llm_ids"), "missed_ids"), join(F.array_except("llm_ids", "gt_ids"), "invented_ids"),
        "n_gt", "n_llm", "n_matched", F.col("list_precision").alias("precision"), F.col("list_recall").alias("recall"), F.col("list_f1").alias("f1"),
    )


RUN = ("model", "provider", "use_chunking", "replicate")


def metrics_rows(runs: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """Rows of the metrics table from runs with config and metrics as columns: the strategy's name, and
    time per case where the number of cases is known.  Without metrics (case_f1 null) all figures and times are null.
    ``variables`` (RUN, variable, f1, precision, recall) gives the figures of secondary cases and infectors, else they are
    taken from columns of ``runs``."""
    known = F.col("case_f1").isNotNull()
    if variables is not None:
        of = lambda v, c: F.max(F.when(F.col("variable") == v, F.col(c)))
        wide = variables.groupBy(*RUN).agg(*(of(v, c).alias(f"{p}_{c}") for p, v in (("secondary", "secondary_cases"), ("infector", "potential_infector")) for c in ("f1", "recall", "precision")))
        same = [F.col(c).eqNullSafe(F.col(f"v_{c}")) for c in RUN]
        runs = runs.join(wide.withColumnsRenamed({c: f"v_{c}" for c in RUN}), same, "left").drop(*(f"v_{c}" for c in RUN))
    figures = ("case_f1", "case_recall", "case_precision", "secondary_f1", "secondary_recall", "secondary_precision", "infector_f1", "infector_recall", "infector_precision", "date_accuracy")
    runs = with_columns(runs, (*figures, "error", "slurm_job_id", "slurm_exec_time_sec"))
    per_case = F.when(F.col("n_llm_cases") > 0, F.col("time_total_sec") / F.col("n_llm_cases"))
    return runs.select(
        "model", "provider", F.when(F.coalesce("use_chunking", F.lit(False)), "Chunked").otherwise("Unchunked").alias("strategy"), "replicate", "status", "error", "attempts",
        *(F.when(known, F.col(c).cast("double")).alias(c) for c in figures),
        F.when(known, F.col("time_total_sec")).alias("time_total_sec"), F.when(known, per_case).alias("time_per_case_sec"),
        F.when(known, F.col("slurm_job_id")).alias("slurm_job_id"), F.when(known, F.col("slurm_exec_time_sec")).alias("slurm_exec_time_sec"),
    )


_FULL, _FIVE = ("median", "q25", "q75", "iqr", "min", "max"), ("median", "q25", "q75", "min", "max")
#: Which statistics each figure gets.
STATS = {
    "case_f1": (*_FULL, "sd"), "case_recall": _FULL, "case_precision": _FULL,
    **{f"{a}_{b}": _FIVE for a in ("secondary", "infector") for b in ("f1", "recall", "precision")},
    "date_accuracy": _FULL, "time_total_sec": ("median", "min", "max"), "time_per_case_sec": ("median",),
}


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def percent(c: Column) -> Column:
    """100 times a share with at most one decimal; NA for null."""
    return F.coalesce(F.regexp_replace(F.round(c * 100, 1).cast("string"), r"\.0$", ""), F.lit("NA"))


def aggregate_replicates(rows: DataFrame) -> DataFrame:
    """Statistics over the successful replicates of each model, provider and strategy, and as text their ranges."""
    keys = ("model", "provider", "strategy")
    short = {"time_total_sec": "time_total", "time_per_case_sec": "time_per_case"}
    rows = written(rows.filter(F.col("status") == "Success").select(*keys, *STATS))  # each pass of the quantiles reads it
    own = {"min": F.min, "max": F.max, "sd": F.stddev_samp}
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n_replicates"), *(own[s](c).alias(f"{c}_{s}") for c, stats in STATS.items() for s in stats if s in own))
    found = exact_quantiles(rows, list(keys), list(STATS), list(QUARTILES.values()))
    wide = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("c", "q"))).alias("q"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    groups = groups.join(wide.withColumnsRenamed({k: f"_{k}" for k in keys}), same, "left")
    q = {(c, s): F.try_element_at("q", F.lit(c))[i] for c in STATS for i, s in enumerate(QUARTILES)}
    q |= {(c, "iqr"): q[c, "q75"] - q[c, "q25"] for c in STATS}
    out = groups.select(*keys, "n_replicates", *(q.get((c, s), F.col(f"{c}_{s}") if s in own else None).alias(f"{short.get(c, c)}_{s}") for c, stats in STATS.items() for s in stats))
    of = lambda m, s: percent(F.col(f"{m}_{s}"))
    figures = [m for m in STATS if not m.startswith("time")]
    ranges = [F.concat(of(m, "median"), F.lit("% ("), of(m, "min"), F.lit("-"), of(m, "max"), F.lit(")")).alias(f"{m}_range") for m in figures]
    iqrs = [F.concat(of(m, "median"), F.lit("% [IQR: "), of(m, "q25"), F.lit("-"), of(m, "q75"), F.lit("]")).alias(f"{m}_iqr_str") for m in figures if "iqr" in STATS[m]]
    return out.select("*", *ranges, *iqrs)
