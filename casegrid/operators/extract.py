"""From a model's response to rows of a line list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.functions.nulls import trim
from casegrid.schema import COLUMNS, LIST_COLUMNS

_JSON = "array<struct<" + ",".join(f"{c}:string" for c in COLUMNS) + ">>"


def _last(response: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(response, F.lit(pattern), F.lit(1)), F.lit(-1))


def candidate(response: Column | str) -> Column:
    """The part of a response that should be JSON: the last tagged block, else the last fenced one, else the last bare one."""
    r = F.col(response) if isinstance(response, str) else response
    return trim(F.coalesce(
        _last(r, r"(?s)<linelist>(.*?)</linelist>"),
        _last(r, r"(?s)```json\s*(.*?)```"),
        _last(r, r"(?s)```\s*(.*?)```"),
        _last(r, r"(?s)(\{.*?\}|\[.*?\])"),
    ))


def repaired(json: Column) -> Column:
    """An array whose one bracket was lost gets it back."""
    return F.when(json.startswith("{") & json.endswith("]"), F.concat(F.lit("["), json)).when(json.startswith("[") & json.endswith("}"), F.concat(json, F.lit("]"))).otherwise(json)


def _array(json: Column) -> Column:
    """``json`` if it is a JSON array, the array in its member ``linelist``, or null."""
    inner = F.get_json_object(json, "$.linelist")
    ok = lambda c: F.when(c.startswith("[") & F.json_array_length(c).isNotNull(), c)
    wrapped = F.concat(F.lit("["), json, F.lit("]"))
    several = F.when(~json.startswith("[") & F.get_json_object(json, "$").isNull(), ok(wrapped))
    return F.coalesce(ok(json), ok(inner), several)


def list_cell(c: Column | str) -> Column:
    """A list column's JSON array or scalar as upper-case parts joined by ", ", each once, without empties."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.when(trim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    kept = F.array_distinct(F.filter(F.transform(parts, lambda x: F.upper(x)), lambda x: x.isNotNull() & (x != "") & (x != "NULL")))
    return F.nullif(F.array_join(kept, ", "), F.lit(""))


def parse_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """The rows (columns of a line list, and row_idx from 0) in each response, beside the other columns of ``df``."""
    rest = [c for c in df.columns if c != response]
    # a column for each step: every one names the one before several times, and Spark would work out the first for each
    json = "_json"
    while json in df.columns:
        json += "_"
    steps = df.select(*rest, candidate(response).alias(json)).withColumn(json, repaired(F.col(json))).withColumn(json, _array(F.col(json)))
    # the outer form, since the inner one reads the JSON beforehand to see whether there are rows
    rows = steps.select(*rest, F.posexplode_outer(F.from_json(json, _JSON)).alias("row_idx", "r")).filter("row_idx is not null")
    typed = {"case_id": F.upper(F.col("r.case_id")), "age": F.col("r.age").try_cast("double"), **{c: list_cell(f"r.{c}") for c in LIST_COLUMNS}}
    return rows.select(*rest, "row_idx", *(typed.get(c, F.col(f"r.{c}")).alias(c) for c in COLUMNS))
