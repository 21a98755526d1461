"""Two line lists derived from the driver's documents, as Spark and as DuckDB expressions.  Some names are missing, too short
or invented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.plans.tables import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cid(i: str, div: str, s: str) -> str:
    return f"concat('S', chr(65 + CAST(({i} {div} 26000) % 26 AS INT)), chr(65 + CAST(({i} {div} 1000) % 26 AS INT)), lpad(CAST({i} % 1000 AS {s}), 3, '0'))"


def _gt(name: str, div: str, s: str) -> dict[str, str]:
    cid = lambda i: _cid(i, div, s)
    return {
        "row_idx": "doc_id",
        "case_id": cid("doc_id"),
        "name": f"CASE WHEN doc_id % 89 = 4 THEN NULL ELSE {name} END",
        "sex": "CASE WHEN doc_id % 2 = 0 THEN 'female' ELSE 'male' END",
        "onset_date": f"CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat(lpad(CAST(1 + doc_id % 28 AS {s}), 2, '0'), '/', lpad(CAST(1 + doc_id % 12 AS {s}), 2, '0'), '/2026') END",
        "secondary_cases": f"CASE WHEN doc_id % 3 = 0 THEN concat({cid('(2 * doc_id + 1)')}, ', ', {cid('(2 * doc_id + 2)')}) END",
        "potential_infector": f"CASE WHEN doc_id > 0 AND ((doc_id - 1) {div} 2) % 3 = 0 THEN {cid(f'((doc_id - 1) {div} 2)')} END",
    }


def _llm(reverse: str, first: str) -> dict[str, str]:
    return {
        "row_idx": "row_idx",
        "case_id": "CASE WHEN row_idx % 4 = 0 THEN lower(case_id) ELSE case_id END",
        "name": f"CASE WHEN row_idx % 97 = 5 THEN NULL WHEN row_idx % 97 = 6 THEN 'xy' WHEN row_idx % 97 = 7 THEN 'Invented Xqzw' WHEN row_idx % 5 = 0 THEN {reverse} ELSE name END",
        "sex": "sex",
        "onset_date": "CASE WHEN row_idx % 11 = 0 THEN '01/01/2026' ELSE onset_date END",
        "secondary_cases": f"CASE WHEN row_idx % 6 = 0 THEN {first} WHEN row_idx % 10 = 9 THEN '[]' ELSE secondary_cases END",
        "potential_infector": "potential_infector",
    }


COLUMNS = ("case_id", "name", "sex", "onset_date", "secondary_cases", "potential_infector")
_NAME = "array_join(slice(filter(split(trim(regexp_replace(lower(text), '[^a-z]+', ' ')), ' '), w -> length(w) >= 3), 1, 2), ' ')"
_NAME_SQL = "array_to_string(list_slice(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda w: length(w) >= 3), 1, 2), ' ')"


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true list, derived from the texts whenever it is read."""
    return table(spark, sf_dir, "documents").select(*(F.expr(e).alias(c) for c, e in _gt(_NAME, "div", "STRING").items()))


def llm(true: DataFrame, upper: bool = False) -> DataFrame:
    """The list extracted from ``true``; with ``upper`` its ids as the parser leaves them."""
    exprs = _llm("array_join(reverse(split(name, ' ')), ' ')", "substring_index(secondary_cases, ',', 1)")
    df = true.filter("row_idx % 7 <> 3").select(*(F.expr(e).alias(c) for c, e in exprs.items()))
    return df.withColumn("case_id", F.upper("case_id")) if upper else df


def lists(spark: SparkSession, sf_dir: str, upper: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both lists (extracted, true) of one query: the texts are read once, for a table that this call writes."""
    true = written(gt(spark, sf_dir))
    return llm(true, upper), true


def _select(exprs: dict[str, str], rest: str) -> str:
    return "SELECT " + ",\n    ".join(f"{e} AS {c}" for c, e in exprs.items()) + f"\n  {rest}"


_UP = {"case_id": "upper(CASE WHEN row_idx % 4 = 0 THEN lower(case_id) ELSE case_id END)"}
_LLM_SQL = _llm("array_to_string(list_reverse(string_split(name, ' ')), ' ')", "split_part(secondary_cases, ',', 1)")
#: The same two tables as the head of a DuckDB query: WITH gt, llm, llmu (ids in upper case).
SQL = (
    f"WITH RECURSIVE gt AS (\n  {_select(_gt(_NAME_SQL, '//', 'VARCHAR'), 'FROM documents')}\n), "
    f"llm AS (\n  {_select(_LLM_SQL, 'FROM gt WHERE row_idx % 7 <> 3')}\n), "
    f"llmu AS (\n  {_select(_LLM_SQL | _UP, 'FROM gt WHERE row_idx % 7 <> 3')}\n)"
)
