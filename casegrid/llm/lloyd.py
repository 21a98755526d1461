"""Centroid clustering of integer vectors by Lloyd's rounds that only look at what changed.

State is a written table of vectors with their cluster and distance, and beside it the sums and counts of all clusters, which
are k * d numbers on the driver.  A round compares each vector with the centroids that changed; only vectors whose own
centroid changed are compared with all.  Vectors that move add themselves to their new cluster and take themselves from the old
one: each task sums these signed integers by cluster, and the sums of the tasks are added up.  A task that runs again gives
the same rows, and each round reads the table that the last one wrote, so a lost executor costs its own tasks only.

Defined results: vectors with other than ``dims`` components, a null or non-finite one, and null vectors are left out.
Components become floor(scale * x), those beyond 2**27 in size count as 2**27 (sums of squares then fit a long).  Repeated rows
are vectors of their own; equal distances go to the smaller number; vectors with equal first hashes start in the order of
their components, those without an id after all others.  Fewer than k vectors are so many clusters.  An empty
table gives none.  Only ``vec_id`` and ``embedding`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.common import forget, table, work_dir, written

DIMS, SCALE, K, ROUNDS, SALT = 64, 1024, 8, 10, "3:"
MOST = 2**27
#: Vectors in a file of the state, about.
PER_FILE = 20_000
STATE = "vec_id bigint, v array<int>, cluster int, distance bigint, n bigint, sums array<bigint>"
RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def integral(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integer components, of the vectors that count."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int")
    kept = embeddings.filter(F.coalesce((F.size("embedding") == dims) & F.forall("embedding", good), F.lit(False)))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, salt: str = SALT) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in vectors.orderBy(F.asc_nulls_last(order), "v").select("v").limit(k).collect()], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, changed: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The new (cluster, distance) of rows whose last ones are given (cluster -1: none yet)."""
    stale = (cluster < 0) | changed[cluster]
    best, at = np.where(stale, np.iinfo(np.int64).max, distance), np.where(stale, len(centroids), cluster)
    for c in range(len(centroids)):
        rows = slice(None) if changed[c] else np.flatnonzero(stale)
        diff = x[rows] - centroids[c]
        d = np.einsum("ij,ij->i", diff, diff)
        closer = (d < best[rows]) | ((d == best[rows]) & (c < at[rows]))
        best[rows], at[rows] = np.where(closer, d, best[rows]), np.where(closer, c, at[rows])
    return at, best


def assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The state after a round, and at the end of each task a row for every cluster that gained or lost vectors there."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    k, d = centroids.shape
    schema = to_arrow_schema(StructType.fromDDL(STATE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, moved = np.zeros((k, d), np.int64), np.zeros(k, np.int64), np.zeros(k, bool)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
            old, was = b.column("cluster").to_numpy(zero_copy_only=False), b.column("distance").to_numpy(zero_copy_only=False)
            new, distance = nearest(x, centroids, changed, old.astype(np.int64), was)
            go = np.flatnonzero(new != old)
            for c in np.unique(np.concatenate([new[go], old[go]])):
                if c >= 0:
                    come, leave = go[new[go] == c], go[old[go] == c]
                    sums[c] += x[come].sum(0) - x[leave].sum(0)
                    counts[c] += len(come) - len(leave)
                    moved[c] = True
            none = pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, schema.field("sums").type)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v").cast(schema.field("v").type), pa.array(new, pa.int32()), pa.array(distance, pa.int64()), *none], schema=schema)
        at = np.flatnonzero(moved)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), schema.field("v").type), pa.array(at, pa.int32()), pa.nulls(len(at), pa.int64()), pa.array(counts[at]), pa.array(list(sums[at]), schema.field("sums").type)], schema=schema)

    return state.select("vec_id", "v", "cluster", "distance").mapInArrow(run, STATE)


def transfers(state: DataFrame, k: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """What the clusters' sums and counts gained in the round that wrote ``state``."""
    by_task = state.filter("n is not null").select("cluster", F.posexplode(F.concat("sums", F.array("n"))).alias("i", "x"))
    out = np.zeros((k, d + 1), np.int64)
    for r in by_task.groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect():  # k * (d + 1) rows at most
        out[r.cluster, r.i] = r.x
    return out[:, :d], out[:, d]


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) of ``vectors`` (vec_id, v) after ``rounds`` rounds and one more assignment, and the
    centroids.  Rounds end early once no centroid changes: the others would change nothing."""
    spark = vectors.sparkSession
    path = work_dir(spark)
    rows = vectors.count()
    centroids = first_centroids(vectors, k, salt) if rows else np.zeros((0, 1), np.int64)
    state = vectors.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).coalesce(rows // PER_FILE + 1)
    if not len(centroids):
        return state, centroids
    sums, counts, changed = np.zeros_like(centroids), np.zeros(len(centroids), np.int64), np.ones(len(centroids), bool)
    for r in range(rounds + 1):
        both = written(assigned(state, centroids, changed), f"{path}/{r}")
        state = both.filter("n is null").select("vec_id", "v", "cluster", "distance")
        if r:
            forget(spark, f"{path}/{r - 1}")
        if r == rounds:
            break
        more, n = transfers(both, *centroids.shape)
        sums, counts = sums + more, counts + n
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        changed = (new != centroids).any(1)
        if not changed.any():
            break
        centroids = new
    return state, centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, centroids = clustered(integral(table(spark, sf_dir, "embeddings")))
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    inertia = {r.cluster: int(r.x) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}  # k rows
    long = lambda n: F.lit(min(n, 2**63 - 1)).cast("bigint")
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return state.select(
        "vec_id", "cluster", "distance", of([long(inertia.get(c, 0)) for c in range(len(name))]).alias("cluster_inertia"),
        long(sum(inertia.values())).alias("inertia"), of(map(F.lit, name)).alias("centroid_sha256"),
    )


def _sql() -> str:
    """Every round written out, each comparing all vectors with all centroids."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS MATERIALIZED (
  SELECT v.r, c.c, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{r} c
), a{r} AS MATERIALIZED (SELECT r, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS e FROM (SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM a{r} JOIN x USING (r) GROUP BY c, i) GROUP BY c
), c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.e, o.e) AS e FROM c{r} o LEFT JOIN m{r} m USING (c))""")
    return f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
), x AS MATERIALIZED (SELECT r, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256(concat('{SALT}', vec_id)) AS h, e FROM v ORDER BY h, e LIMIT {K})),
{', '.join(steps)}
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.e, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} f USING (c)"""


OP11_SQL = _sql()
