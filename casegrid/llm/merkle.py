"""A hash tree over the rows of each source, and over the sources, with a proof for every row.

Leaves are range-sorted by source and id.  Each task builds the aligned subtrees that lie wholly in its range, level upon level,
as the rows pass; what is left at its edges, a few nodes of each level, meets by coordinate (level, group, run).  The same
build over the subroots gives the root.  Proofs come from the top: a node's siblings and what its parent has, down to
the runs of leaves, which are joined as whole runs.

Defined results: rows without an id come first and are never tampered; rows with one id are ordered by their leaf; repeated
rows are leaves of their own; null values count as ``-``, null sources are one group before all others; very long texts are
hashed in the JVM and never leave the first pass; an empty table has no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.common import table, work_dir, written
from casegrid.llm.ranks import placed

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
KID = "struct<id:bigint,h:string,other:string>"
NODE = f"level int, g string, c bigint, n bigint, whole boolean, kids array<{KID}>"


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row: each value as its bytes' number, a colon and itself, or ``-`` for null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, columns.values())), 256)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and, where the row is tampered with (5 divides the id's crc32), the leaf it then has."""
    own = {c: F.col(c).cast("bigint" if c in ("doc_id", "n_chars") else "string") for c in FIELDS}
    lower = F.translate(own["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    struck = F.coalesce(F.crc32(own["doc_id"].cast("string")) % 5 == 0, F.lit(False))
    return docs.select(own["doc_id"].alias("doc_id"), own["source"].alias("source"), leaf(own).alias("leaf"), F.when(struck, leaf(own | {"text": lower})).alias("tampered"))


def width(n: int, level: int) -> int:
    """Nodes of a tree of ``n`` leaves at a level."""
    for _ in range(level):
        n = -(-n // FAN)
    return n


def height(n: int) -> int:
    level = 0
    while n > 1:
        n, level = -(-n // FAN), level + 1
    return level


class Builder:
    """Leaves of one task in order; gives whole runs, and single nodes whose run isn't whole here."""

    def __init__(self) -> None:
        self.group, self.n, self.open = None, 0, []  # for each level the nodes (c, kid) of the run that is open

    def add(self, g: str, c: int, n: int, kid: dict) -> Iterator[tuple]:
        if g != self.group:
            yield from self.close()
            self.group, self.n = g, n
        yield from self._put(0, c, kid)

    def _put(self, level: int, c: int, kid: dict) -> Iterator[tuple]:
        if len(self.open) <= level:
            self.open.append([])
        run, count = self.open[level], width(self.n, level)
        if run and run[0][0] // FAN != c // FAN:
            yield from self._spill(level)
        run.append((c, kid))
        if count > 1 and len(run) == min(FAN, count - c // FAN * FAN):
            kids = [k for _, k in run]
            run.clear()
            yield level, self.group, c // FAN, self.n, True, kids
            up = hashlib.sha256("".join(k["h"] for k in kids).encode()).hexdigest()
            yield from self._put(level + 1, c // FAN, {"id": None, "h": up, "other": None})

    def _spill(self, level: int) -> Iterator[tuple]:
        for c, kid in self.open[level]:
            yield level, self.group, c, self.n, False, [kid]
        self.open[level].clear()

    def close(self) -> Iterator[tuple]:
        for level in range(len(self.open)):
            yield from self._spill(level)


def local_trees(leaves: DataFrame) -> DataFrame:
    """NODE rows of ``leaves`` (g, before, total, id, h, other): a whole run under its parent's coordinate, or one node
    under its own."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(NODE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        build = Builder()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("g", "before", "total", "id", "h", "other"))
            out = [x for g, c, n, i, h, o in zip(*cols) for x in build.add(g, c, n, {"id": i, "h": h, "other": o})]
            if out:
                yield batch(out)
        if out := [*build.close()]:
            yield batch(out)

    return leaves.sortWithinPartitions("g", "before").select("g", "before", "total", "id", "h", "other").mapInArrow(run, NODE)


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["h"]), "")


def forest(rows: DataFrame, order: list[str], path: str, count: int) -> tuple[DataFrame, DataFrame, int]:
    """Trees over about ``count`` ``rows`` (g, not null; id, h, other; sorted by ``order`` in their group): roots (g, root), members
    (g, id, h, other, path), where a path is the siblings left and right of the node at each level, from below, and a bound
    of the number of roots."""
    nodes = written(local_trees(placed(rows, "g", order, path, count)), f"{path}/nodes")
    one = nodes.agg(F.max("n").alias("n"), F.count(F.when(~F.col("whole"), 1)).alias("loose")).first()
    levels = height(one.n or 0)

    def alone(level: int) -> DataFrame:
        return nodes.filter(f"level = {level} and not whole").select("g", "c", "n", F.col("kids")[0].alias("kid"))

    loose, runs = alone(0), []
    roots = [loose.filter("n = 1")]
    for level in range(levels):
        # the nodes of this level whose run no task had whole meet by the run's coordinate, 16 of them at most
        met = (
            loose.filter(F.col("n") > FAN**level).groupBy("g", F.floor(F.col("c") / FAN).alias("c"), "n")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "kid"))), lambda x: x["kid"]).alias("kids"))
        )
        met = written(met, f"{path}/met{level}", rows=one.loose)
        runs.append(nodes.filter(f"level = {level} and whole").select("g", "c", "n", "kids").unionByName(met))
        up = F.struct(F.lit(None).cast("bigint").alias("id"), F.sha2(_joined(F.col("kids")), 256).alias("h"), F.lit(None).cast("string").alias("other"))
        loose = alone(level + 1).unionByName(met.select("g", "c", "n", up.alias("kid")))
        roots.append(loose.filter(F.col("n") <= FAN ** (level + 1)))
    empty = F.array().cast("array<struct<left:string,right:string>>").alias("path")
    members, paths = roots[0].select("g", "kid", empty), None
    for level in reversed(range(levels)):
        # the parents of this level's runs: nodes with a path from above, and the roots that stand right here
        parents = roots[level + 1].select("g", "c", empty)
        parents = parents if paths is None else paths.unionByName(parents)
        each = runs[level].join(parents, ["g", "c"]).select("g", "c", "kids", "path", F.posexplode("kids").alias("i", "kid"))
        side = lambda a, n: _joined(F.slice("kids", a, n))
        own = F.struct(side(F.lit(1), F.col("i")).alias("left"), side(F.col("i") + 2, F.lit(FAN)).alias("right"))
        paths = each.select("g", (F.col("c") * FAN + F.col("i")).alias("c"), "kid", F.concat(F.array(own), "path").alias("path"))
        if level == 0:
            members = members.unionByName(paths.drop("c"))
        paths = paths.drop("kid")
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return found.select("g", F.col("kid.h").alias("root")), members.select("g", "kid.*", "path"), one.loose


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered (null where it is not), subroot, root and path of each row."""
    base = work_dir(docs.sparkSession)
    count = docs.count()
    rows = written(digests(docs), f"{base}/leaves", rows=count)
    g = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    subroots, members, n = forest(rows.select(g.alias("g"), F.col("doc_id").alias("id"), F.col("leaf").alias("h"), F.col("tampered").alias("other")), ["id", "h"], f"{base}/sources", count)
    subroots = written(subroots, f"{base}/subroots", rows=n)
    # "-" sorts before "s": the null source first, the others by their bytes
    roots, tops, _ = forest(subroots.select(F.lit("").alias("g"), F.lit(None).cast("bigint").alias("id"), F.col("root").alias("h"), F.col("g").alias("other")), ["other"], f"{base}/top", n)
    tops = written(tops.select(F.col("other").alias("g"), F.col("h").alias("subroot"), F.col("path").alias("top")).crossJoin(roots.select("root")), f"{base}/tops", rows=n)  # one root
    return members.join(tops, "g").select(F.col("id").alias("doc_id"), F.col("h").alias("leaf"), F.col("other").alias("tampered"), "subroot", "root", F.concat("path", "top").alias("path"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents"))
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    fold = F.aggregate("path", F.coalesce("tampered", "leaf"), lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(name: str, first: str, count: int) -> str:
    """CTEs of the levels of trees over ``first`` (g, pos, n, h): name0, name1, ... with the siblings of each node, and roots."""
    out = []
    for k in range(count):
        made = first if k == 0 else f"SELECT g, pos // {FAN} AS pos, (any_value(n) + {FAN - 1}) // {FAN} AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{k - 1} WHERE n > 1 GROUP BY g, pos // {FAN}"
        run = f"OVER (PARTITION BY g, pos // {FAN} ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}{k} AS MATERIALIZED (SELECT *, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM ({made}))""")
    return ",\n".join(out) + f",\n{name}r AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(count)) + ")"


def _up(name: str, key: str, place: str, count: int) -> str:
    return "".join(f" LEFT JOIN {name}{k} ON {name}{k}.n > 1 AND {name}{k}.g = {key} AND {name}{k}.pos = {place} // {FAN**k}" for k in range(count))


def _sql() -> str:
    """Level by level, each node from the one below; crc32 bit by bit.  Deep enough for 16 ** 5 rows of a source."""
    deep, wide = 6, 4
    one = lambda c: f"coalesce(concat(strlen({c}), ':', {c}), '-')"
    values = {c: f"CAST({c} AS VARCHAR)" for c in FIELDS}
    lower = f"translate({values['text']}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    h = lambda v: f"sha256(concat({', '.join(one(x) for x in v.values())}))"
    bits = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: xor(d >> 1, CASE WHEN d % 2 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    steps, fold, sib = [], "coalesce(tampered, leaf)", []
    for name, count in (("l", deep), ("t", wide)):
        for k in range(count):
            fold = f"CASE WHEN {name}{k}.h IS NULL THEN f ELSE sha256(concat({name}{k}.a, f, {name}{k}.b)) END" if steps else f"CASE WHEN l0.h IS NULL THEN {fold} ELSE sha256(concat(l0.a, {fold}, l0.b)) END"
            steps.append(fold)
            sib.append(f"{name}{k}.a, {name}{k}.b")
    wide_rows = ", ".join(f"{n}{k}.h AS {n}{k}h, {n}{k}.a AS {n}{k}a, {n}{k}.b AS {n}{k}b" for n, c in (("l", deep), ("t", wide)) for k in range(c))
    nested = f"SELECT *, {steps[0].replace('l0.', 'l0')} AS f FROM j"
    for (n, k), s in zip([(n, k) for n, c in (("l", deep), ("t", wide)) for k in range(c)][1:], steps[1:]):
        nested = f"SELECT * REPLACE ({s.replace(f'{n}{k}.', f'{n}{k}')} AS f) FROM ({nested})"
    proof = ", ".join(x.replace(".", "") for x in sib)
    return f"""WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(concat('s', source), '-') AS g, {h(values)} AS leaf, CASE WHEN doc_id IS NOT NULL AND ({crc}) % 5 = 0 THEN {h(values | {'text': lower})} END AS tampered FROM documents
), p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
{_levels('l', 'SELECT g, pos, n, leaf AS h FROM p', deep)},
s AS MATERIALIZED (SELECT g AS k, 0 AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, h FROM lr),
{_levels('t', 'SELECT g, pos, n, h FROM s', wide)},
j AS MATERIALIZED (SELECT p.doc_id, p.leaf, p.tampered, s.h AS subroot, tr.h AS root, {wide_rows} FROM p JOIN s ON s.k = p.g CROSS JOIN tr{_up('l', 'p.g', 'p.pos', deep)}{_up('t', '0', 's.pos', wide)})
SELECT doc_id, leaf, subroot, root, sha256(concat({proof})) AS proof_sha256, f AS folded_root, f = root AS verified FROM ({nested})"""


OP13_SQL = _sql()
