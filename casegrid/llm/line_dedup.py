"""Line dedup (operator 1).

Method: content-defined line chunks.  Every line is hashed, and a rolling hash over the last
WINDOW line hashes decides whether a chunk ends at a line, so an inserted or deleted line
moves boundaries only near itself.  Chunks of several lines, at least two of them not
blank, that an earlier document has too are removed; so are repeats inside a document.
A repeated passage seldom begins and ends at boundaries, so a second, finest level of chunks
takes over at its edges, and for short passages: every line that is not blank with the next
such line and the blank ones between them.  So every line of a block of two or more lines
that are not blank, which an earlier document has, is removed.

Hashes of chunks lead to those that occur in several documents; only these are compared,
by their bytes: they are grouped by the chunk itself.  Chunks of the finest level inside a larger
chunk that is removed need no comparison.  A group's copies meet as partial minima, never
as rows in one task.

Defined results: a null text counts as empty (one blank line); an earlier document is one
with a smaller doc_id, null ids first; rows with the same id and text are one document and
each gets its result; rows with the same id but another text are documents of the same
rank, whose common chunks both stay; very long texts
are cut into chunks whole; of the places of a chunk in one text the first stays; an empty table gives none; all other columns of the
documents, whatever their names, are returned as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.common import did, keyed, map_columns, slices, table, work_dir, written

WINDOW, DIVISOR, BASE, PRIME = 3, 4, 31, 1_000_003
#: Levels of chunks.
COARSE, FINE = 0, 1


def line_hash(line: str) -> bytes:
    return hashlib.md5(line.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def cuts(hashes: list[bytes], window: int = WINDOW, divisor: int = DIVISOR) -> list[int]:
    """Where chunks end: after each line whose rolling hash is a multiple of ``divisor``, and after the last."""
    n = len(hashes)
    h = np.frombuffer(b"".join(hashes), ">u4")[::4].astype(np.int64)
    roll = np.zeros(n, np.int64)
    for back in range(window):
        roll[back:] += h[: n - back] * BASE**back
    ends = (np.flatnonzero(roll % PRIME % divisor == 0) + 1).tolist()
    return ends if ends and ends[-1] == n else [*ends, n]


def chunks(text: str) -> list[tuple[int, int, int, bytes]]:
    """(first line, number of lines, level, hash) of the chunks that may be removed."""
    if "\n" not in text:
        return []
    lines = text.split("\n")
    hashes = [line_hash(x) for x in lines]
    some = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
    if len(some) < 2:
        return []
    key = lambda a, b: hashlib.blake2b(b"".join(hashes[a:b]), digest_size=16).digest()
    out, a, full = [], 0, np.searchsorted(some, [0, *(ends := cuts(hashes))])
    for k, b in enumerate(ends):
        if full[k + 1] - full[k] > 1:
            out.append((a, b - a, COARSE, key(a, b)))
        a = b
    taken = {(s, n) for s, n, _, _ in out}
    return out + [(a, b + 1 - a, FINE, key(a, b + 1)) for a, b in zip(some, some[1:], strict=False) if (a, b + 1 - a) not in taken]


_FOUND = "did bigint, th bigint, start int, n int, level int, key binary, again boolean"


def _found(batch: pa.RecordBatch) -> dict:
    """Rows of the chunks; ``again``: an earlier place in the same text has the same chunk."""
    names = ("did", "th", "start", "n", "level", "key", "again")
    out = {k: [] for k in names}
    for d, h, text in zip(*(batch.column(c).to_pylist() for c in ("did", "th", "text")), strict=True):
        seen = set()
        for start, n, level, key in sorted(chunks(text)):
            for k, v in zip(names, (d, h, start, n, level, key, key in seen), strict=True):
                out[k].append(v)
            seen.add(key)
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks' bytes of each text, once each; ``hits`` are its chunks that other documents have, too."""
    for batch in batches:
        for b in slices(batch):
            names, out = ("did", "key", "chunk"), ([], [], [])
            texts = pc.struct_field(b.column("row"), "text").to_pylist()
            for text, d, hits in zip(texts, b.column("did").to_pylist(), b.column("hits").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                larger = sorted((h["start"], h["start"] + h["n"]) for h in hits if h["level"] == COARSE and d > h["first"])
                starts, done = np.array([x[0] for x in larger], int), set()
                for h in hits:
                    if h["key"] in done:
                        continue
                    a, e = h["start"], h["start"] + h["n"]
                    at = int(np.searchsorted(starts, a, "right")) - 1  # chunks of this level don't overlap
                    if h["level"] == FINE and at >= 0 and larger[at][1] >= e:
                        continue
                    done.add(h["key"])
                    for o, v in zip(out, (d, h["key"], "\n".join(lines[a:e])), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.string())], names=names)


def _rows(docs: DataFrame) -> DataFrame:
    """The whole rows, and their keys: one exchange of them serves both readers."""
    return docs.select(F.struct("*").alias("row"), did().alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


def removals(docs: DataFrame) -> DataFrame:
    """did, th, start, n of each chunk to remove from ``docs``."""
    path = work_dir(docs.sparkSession)
    found = written(map_columns(keyed(docs), _found, _FOUND), f"{path}/found")
    shared = found.groupBy("key").agg(F.min("did").alias("first"), F.max("did").alias("last")).filter("first < last").select("key", "first")
    hits = written(found.filter("not again").join(shared, "key"), f"{path}/hits")
    per_text = hits.groupBy("did", "th").agg(F.collect_set(F.struct("start", "n", "level", "key", "first")).alias("hits"))
    texts = _rows(docs).join(per_text, ["did", "th"]).mapInArrow(_compared, "did bigint, key binary, chunk string")
    groups = texts.groupBy("key", "chunk").agg(F.min("did").alias("first"), F.max("did").alias("last"))
    # two texts under one hash are two groups here; such a hash removes nothing
    groups = groups.groupBy("key").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("texts")).filter("texts = 1 and first < last")
    across = hits.drop("first").join(groups.select("key", "first"), "key").filter("did > first").select("did", "th", "start", "n")
    return found.filter("again").select("did", "th", "start", "n").unionByName(across)


def _without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """What is left, number of lines, number of removed ones."""
    lines = text.split("\n")
    gone = np.zeros(len(lines), bool)
    for start, n in spans:
        gone[start : start + n] = True
    if not gone.any():
        return text, len(lines), 0
    return "\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g), len(lines), int(gone.sum())


def deduplicated(docs: DataFrame) -> DataFrame:
    """``row`` (the document's columns), and r_text, n_lines, n_removed."""
    spans = removals(docs).groupBy("did", "th").agg(F.collect_set(F.struct("start", "n")).alias("r_spans"))
    both = _rows(docs).join(spans, ["did", "th"], "left").drop("did", "th").withColumn("r_text", F.coalesce("row.text", F.lit("")))

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                got = [_without(t, [(s["start"], s["n"]) for s in spans or ()]) for t, spans in zip(b.column("r_text").to_pylist(), b.column("r_spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], names=["row", "r_text", "n_lines", "n_removed"])

    schema = both.select("row", "r_text", F.lit(0).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_removed")).schema
    return both.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated chunks taken out of text (a null text stays null) and n_chars, if there, counted anew."""
    out = deduplicated(docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("r_text"))
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return out.select(*(new.get(c, F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", F.col("n_removed").alias("n_removed_lines"), F.sha2("r_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, i, list_extract(lines, i) AS line, lines, length(lines) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d, UNNEST(range(1, length(lines) + 1)) AS u(i)
), h AS (
  SELECT *, CAST('0x' || left(md5(line), 8) AS BIGINT) AS h, length(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))) > 0 AS word FROM l
), r AS (
  SELECT *, (h + 31 * coalesce(lag(h, 1) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % 1000003 % 4 = 0 OR i = n AS ends
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), c AS (
  SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM r
), g AS (
  SELECT doc_id, min(i) AS a, max(i) AS b, string_agg(line, chr(10) ORDER BY i) AS chunk
  FROM c GROUP BY doc_id, c HAVING sum(CAST(word AS INT)) > 1
  UNION
  SELECT doc_id, i AS a, j AS b, array_to_string(list_slice(lines, i, j), chr(10)) AS chunk
  FROM (SELECT doc_id, i, lines, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM h WHERE word) p WHERE j IS NOT NULL
), k AS (
  SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, a) AS k FROM g) q WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, UNNEST(range(a, b + 1)) AS i FROM k
)
SELECT h.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed_lines,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY h.i) FILTER (WHERE gone.i IS NULL), '')) AS kept_sha256
FROM h LEFT JOIN gone ON h.doc_id = gone.doc_id AND h.i = gone.i GROUP BY h.doc_id
"""
