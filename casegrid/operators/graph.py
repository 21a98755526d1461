"""Who is linked to whom: relationships, nodes and edges of the transmission graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.functions.text import reference_ids
from casegrid.schema import with_columns

#: Column, relationship type, whether the column names the source.
RELATIONS = (
    ("contacts", "contact", False),
    ("secondary_cases", "secondary_case", False),
    ("potential_infector", "potential_infector", True),
    ("most_probable_infector", "most_probable_infector", True),
)
#: Colours of edges by type and of nodes by group.
EDGE_COLORS = {"secondary_case": "#1b9e77", "most_probable_infector": "#d95f02", "potential_infector": "#7570b3", "contact": "#636363"}
NODE_COLORS = {"Female": "#d95f5f", "Male": "#2c7fb8", "Referenced only": "#bdbdbd", "Unknown": "#756bb1"}


def relationships(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, source_case_id, target_case_id, relationship_type, each once; one pass over the line list.  ``by`` keeps documents
    apart, whose ids mean different cases."""
    df = with_columns(df, tuple(c for c, _, _ in RELATIONS))
    own = F.col("case_id")

    def links(c: str, kind: str, back: bool):
        return F.transform(reference_ids(c), lambda x: F.struct((x if back else own).alias("source_case_id"), (own if back else x).alias("target_case_id"), F.lit(kind).alias("relationship_type")))

    each = [links(*r) for r in RELATIONS]
    rows = df.select(*by, F.explode(F.flatten(F.array(*each))).alias("r")).select(*by, "r.*")
    for c in ("source_case_id", "target_case_id"):
        rows = rows.filter(F.col(c).isNotNull() & (F.col(c) != ""))
    return rows.distinct()


def arranged(relations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """In the order of the relationship table: by type, source and target."""
    return relations.orderBy(*by, "relationship_type", "source_case_id", "target_case_id")


def nodes(df: DataFrame, relations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each case and each case that is only referred to: by, id, label, group, title, color_background, color_border."""
    df = with_columns(df, ("name", "sex", "age", "outcome"))
    ids = df.select(*by, F.col("case_id").alias("id")).union(relations.select(*by, "source_case_id")).union(relations.select(*by, "target_case_id")).filter("id is not null").distinct()
    rows = ids.join(df.select(*by, F.col("case_id").alias("id"), "name", "sex", F.col("age").cast("string").alias("age"), "outcome"), [*by, "id"], "left")
    sex = F.lower(F.trim("sex"))
    only = F.col("name").isNull() & F.col("sex").isNull() & F.col("outcome").isNull()
    group = F.when(only, "Referenced only").when(sex.isin("f", "female"), "Female").when(sex.isin("m", "male"), "Male").otherwise("Unknown")
    color = F.create_map(*(F.lit(x) for kv in NODE_COLORS.items() for x in kv))[F.col("group")]
    known = lambda c: F.coalesce(c, F.lit("Unknown"))
    title = F.concat(F.lit("<b>"), "id", F.lit("</b><br>Name: "), known("name"), F.lit("<br>Sex: "), known("sex"), F.lit("<br>Age: "), known("age"), F.lit("<br>Outcome: "), known("outcome"))
    return rows.withColumn("group", group).select(*by, "id", F.coalesce("name", "id").alias("label"), "group", title.alias("title"), color.alias("color_background"), F.lit("#ffffff").alias("color_border"))


def edges(relations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, from, to, label, title, dashes, arrows, color; contacts have no direction."""
    contact = F.col("relationship_type") == "contact"
    color = F.create_map(*(F.lit(x) for kv in EDGE_COLORS.items() for x in kv))[F.col("relationship_type")]
    return relations.select(
        *by, F.col("source_case_id").alias("from"), F.col("target_case_id").alias("to"), F.col("relationship_type").alias("label"),
        F.col("relationship_type").alias("title"), contact.alias("dashes"), F.when(contact, "").otherwise("to").alias("arrows"), color.alias("color"),
    )


def link_closure(relations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, case_id, contact_id: every link in both directions, each once."""
    pairs = F.array(F.struct(F.col("source_case_id").alias("case_id"), F.col("target_case_id").alias("contact_id")), F.struct(F.col("target_case_id").alias("case_id"), F.col("source_case_id").alias("contact_id")))
    return relations.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*").distinct()


def missing_mirrors(relations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Secondary cases whose own row does not name the source as infector, and infectors that don't list the case."""
    keys = [*by, "source_case_id", "target_case_id"]
    of = lambda kind: relations.filter(F.col("relationship_type") == kind).select(*keys)
    one = of("secondary_case").join(of("potential_infector"), keys, "left_anti").withColumn("missing", F.lit("potential_infector"))
    two = of("potential_infector").join(of("secondary_case"), keys, "left_anti").withColumn("missing", F.lit("secondary_case"))
    return one.unionByName(two)


def degree(relations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, case_id, n_out, n_in over directed relationships."""
    directed = relations.filter(F.col("relationship_type") != "contact").select(*by, "source_case_id", "target_case_id").distinct()
    ends = F.array(F.struct(F.col("source_case_id").alias("case_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_case_id").alias("case_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return directed.select(*by, F.explode(ends).alias("e")).select(*by, "e.*").groupBy(*by, "case_id").agg(F.sum("o").cast("bigint").alias("n_out"), F.sum("i").cast("bigint").alias("n_in"))
