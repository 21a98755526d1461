"""Columns of a line list, their aliases, and aligning a table to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: The columns of a line list, in order.
COLUMNS = (
    "case_id", "name", "sex", "age", "age_unit", "province", "health_zone", "health_area", "residence_village", "profession",
    "onset_date", "outcome_date", "outcome", "classification", "potential_infector", "infection_route", "most_probable_infector",
    "contacts", "secondary_cases",
)
LINELIST = StructType([StructField(c, DoubleType() if c == "age" else StringType()) for c in COLUMNS])
LIST_COLUMNS = ("potential_infector", "most_probable_infector", "contacts", "secondary_cases")

#: Other names of the columns, in lower case.
ALIASES = {
    "id": "case_id",
    "patient_id": "case_id",
    "patient_name": "name",
    "gender": "sex",
    "age_units": "age_unit",
    "village": "residence_village",
    "occupation": "profession",
    "date_onset": "onset_date",
    "symptom_onset": "onset_date",
    "status": "outcome",
    "infector": "potential_infector",
    "source_case": "potential_infector",
    "route": "infection_route",
}


def canonical(name: str) -> str:
    low = name.lower()
    return low if low in COLUMNS else ALIASES.get(low, name)


def align(df: DataFrame) -> DataFrame:
    """Columns under their canonical names; of several with one name the first stays."""
    seen: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        seen.setdefault(canonical(c), i)
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return numbered.select(*(F.col(f"c{i}").alias(c) for c, i in seen.items()))


def with_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Missing columns added as null strings."""
    return df.select("*", *(F.lit(None).cast("string").alias(c) for c in names if c not in df.columns))


def column_sets(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Shared columns and those of either side only, in the order of their table."""
    return [c for c in a.columns if c in b.columns], [c for c in a.columns if c not in b.columns], [c for c in b.columns if c not in a.columns]
