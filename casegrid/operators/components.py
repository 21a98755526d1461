"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.plans.tables import written


def components(links: DataFrame) -> DataFrame:
    """v, root (smallest member) of everything that a link (v, w) names.  In each round every vertex points to its smallest
    neighbour's smallest neighbour, and the links between what they point to go on, until none is left."""
    edges = written(links.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).filter("a <> b").distinct())
    loops = links.select(F.col("v")).unionByName(links.select(F.col("w").alias("v"))).distinct()
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))
        near = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("p"))
        rounds.append(written(near.join(near.select(F.col("v").alias("p"), F.col("p").alias("root")), "p").select("v", "root")))
        of = lambda c: rounds[-1].select(F.col("v").alias(c), F.col("root").alias(f"r_{c}"))
        met = edges.join(of("a"), "a").join(of("b"), "b").filter("r_a <> r_b")
        edges = written(met.select(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b")).distinct())
    roots = loops.select("v", F.col("v").alias("root"))
    for r in rounds:
        roots = roots.join(r.select(F.col("v").alias("root"), F.col("root").alias("far")), "root", "left").select("v", F.coalesce("far", "root").alias("root"))
    return roots
