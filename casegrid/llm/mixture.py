"""Mixing sources to target weights, as blocks of equal length in output shards.

The words of a source, document after document, are packed into blocks of BLOCK words (the last one shorter).  A source's target
in words is a number of slots, of which the last takes only the words that are still wanted.  Each output shard has SLOTS slots and
draws how many of them each source gets: multinomial counts, given that all shards together meet the sources' slots.  The draw
splits the shards in halves down to one, so a shard knows its counts and the rank of its first slot of each source by itself.
The r-th slot of a source is led to a block by a pseudorandom permutation of its block numbers, another for each turn through
the source, and joined with the block by its number.

Drawing the shards independently would miss the targets by the draws' deviation and could take a source more than twice; the
condition on the totals is why targets are met to the word.

Defined results: a null text has no words; a document without words is never taken; rows that share an id, and repeated rows, are
documents of their own; a source without words has target 0; null is a source, the last one; very long documents lie in
many blocks, and no step holds one whole but the one that counts its words.  An empty table gives none.  Only doc_id, text
and source are read.  What is collected is one row per source.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.common import map_columns, table, work_dir, written
from casegrid.llm.ranks import placed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, TURNS = (5, 2, 1), Fraction(3, 2), 2
BLOCK, SLOTS, SEED = 512, 1024, 12
#: numpy draws hypergeometric numbers among fewer than this many; beyond, a rounded normal of the same mean and variance.
EXACT = 10**9


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: Fraction
    blocks: int = 0
    slots: int = 0
    #: Words of the last slot.
    rest: int = 0

    @property
    def key(self) -> str:
        return group_key(self.name)


def group_key(name: str | None) -> str:
    return "-" if name is None else "s" + name


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, turns: int = TURNS) -> dict[str | None, Fraction]:
    """Words of each source: shares by weight, none above ``turns`` times its size, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, names
    while free:
        by = left / sum(weight[s] for s in free)
        full = [s for s in free if by * weight[s] > turns * sizes[s]]
        for s in full or free:
            out[s] = Fraction(turns * sizes[s]) if full else by * weight[s]
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def _keys(seed: int, *what: object) -> list[int]:
    d = hashlib.sha256(":".join(map(str, (seed, *what))).encode()).digest()
    return [int.from_bytes(d[i : i + 8], "little") for i in range(0, 32, 8)]


def permuted(x: np.ndarray, n: int, keys: list[int], back: bool = False) -> np.ndarray:
    """Where a pseudorandom permutation of range(n) leads: four Feistel rounds over the next even number of bits, repeated while
    the result is outside.  ``back`` is its inverse."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> shift, v & mask
        if back:
            a, b = b, a
        for k in reversed(keys) if back else keys:
            m = (b + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, (a ^ (m >> np.uint64(32))) & mask
        return (b << shift) | a if back else (a << shift) | b

    out = np.array(x, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = once(out[todo])
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def planned(sizes: dict[str | None, int], block: int = BLOCK, seed: int = SEED) -> list[Source]:
    """The sources with their targets as slots, in order."""
    out = []
    for name, target in targets(sizes).items():
        size = sizes[name]
        n, want = -(-size // block), round(target)
        if not want:
            out.append(Source(name, size, target, n))
            continue
        turn, words = divmod(want - 1, size)  # the last word is the one at place ``words`` of this turn
        # the shorter last block may come anywhere in a turn: at place ``short``
        short = int(permuted(np.array([n - 1]), n, _keys(seed, group_key(name), turn), back=True)[0])
        lost, k = n * block - size, words // block
        if k >= short:
            k = (words + lost) // block if words >= (short + 1) * block - lost else short
        before = k * block - lost * (k > short)
        out.append(Source(name, size, target, n, turn * n + k + 1, words + 1 - before))
    return sorted(out, key=lambda s: (s.name is None, s.name or ""))


def _drawn(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """Multivariate hypergeometric: how ``take`` of the slots fall among the sources, one source after another."""
    out, left, rest = np.zeros_like(counts), take, int(counts.sum())
    for i, n in enumerate(counts.tolist()):
        rest -= n
        if n + rest < EXACT:
            k = int(rng.hypergeometric(n, rest, left)) if left else 0
        else:
            p = n / (n + rest)
            sd = (left * p * (1 - p) * (n + rest - left) / (n + rest)) ** 0.5
            k = min(max(round(rng.normal(left * p, sd)), left - rest, 0), n, left)
        out[i], left = k, left - k
    return out


def drawn(shard: int, shards: int, slots: int, counts: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(first, count): of each source, the rank of the shard's first slot and how many it gets."""
    low, high, first = 0, shards, np.zeros_like(counts)
    while high - low > 1:
        mid = (low + high) // 2
        left = _drawn(np.random.Generator(np.random.PCG64(_keys(seed, "split", low, high))), counts, (mid - low) * slots)
        if shard < mid:
            counts, high = left, mid
        else:
            counts, first, low = counts - left, first + left, mid
    return first, counts


def slots(spark: SparkSession, sources: list[Source], block: int = BLOCK, per_shard: int = SLOTS, seed: int = SEED) -> DataFrame:
    """shard, slot, g (the source's key), block and take (words from the block's start) of the whole mix."""
    total = sum(s.slots for s in sources)
    shards = -(-total // per_shard)
    counts = np.array([s.slots for s in sources], np.int64)

    def of(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("shard", "slot", "g", "block", "take")}
        for shard in batch["id"].to_pylist():
            first, count = drawn(shard, shards, per_shard, counts, seed)
            places = np.random.Generator(np.random.PCG64(_keys(seed, "order", shard))).permutation(int(count.sum()))
            at = 0
            for s, f, n in zip(sources, first.tolist(), count.tolist()):
                ranks = np.arange(f, f + n)
                for turn in range(f // s.blocks, (f + n - 1) // s.blocks + 1) if n else ():
                    r = ranks[ranks // s.blocks == turn]
                    b = permuted(r - turn * s.blocks, s.blocks, _keys(seed, s.key, turn))
                    size = np.minimum(block, s.size - b * block)
                    out["take"] += np.where(r == s.slots - 1, s.rest, size).tolist()
                    out["block"] += b.tolist()
                out["slot"] += places[at : at + n].tolist()
                out["g"] += [s.key] * n
                at += n
            out["shard"] += [shard] * int(count.sum())
        return out

    return map_columns(spark.range(0, shards, 1, max(1, min(shards, shards * per_shard // 65_536 + 8))), of, "shard bigint, slot bigint, g string, block bigint, take bigint")


def packed(docs: DataFrame, path: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, th, g, size) of all documents, written, and pieces (g, block, row, doc_id, th, lo, hi, at): words lo to
    hi of a block are those of the document from its ``at``-th on."""
    text = F.coalesce("text", F.lit(""))
    g = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), g.alias("g"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"))
    count = docs.count()
    rows = written(rows, f"{path}/rows", rows=count)
    # in a source documents lie in pseudorandom order, so that a block mixes what came in together
    stream = placed(rows.filter("size > 0").withColumn("key", F.xxhash64("doc_id", "th")), "g", ["key", "row"], path, count, "size")
    first, last = F.col("before"), F.col("before") + F.col("size")
    pieces = stream.select("*", F.explode(F.sequence(F.floor(first / block), F.floor((last - 1) / block))).alias("block"))
    start = F.col("block") * block
    lo = F.greatest(first, start)
    return rows, pieces.select("g", "block", "row", "doc_id", "th", (lo - start).alias("lo"), (F.least(last, start + block) - start).alias("hi"), (lo - first).alias("at"))


def mixed(docs: DataFrame, block: int = BLOCK, per_shard: int = SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, list[Source]]:
    """The mix: spans (shard, slot, g, block, lo, words, row, doc_id, th, at), of each slot the runs of ``words`` words of
    documents, from their ``at``-th word on, by their place ``lo``; the documents' rows (see ``packed``); and the sources."""
    spark, path = docs.sparkSession, work_dir(docs.sparkSession)
    rows, pieces = packed(docs, path, block)
    sizes = {None if r.g == "-" else r.g[1:]: r.n for r in rows.groupBy("g").agg(F.sum("size").alias("n")).collect()}  # one row per source
    sources = planned(sizes, block, seed)
    taken = slots(spark, sources, block, per_shard, seed).join(pieces, ["g", "block"]).filter("lo < take")
    return taken.select("shard", "slot", "g", "block", "lo", (F.least("hi", "take") - F.col("lo")).alias("words"), "row", "doc_id", "th", "at"), rows, sources


def rendered(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """shard, slot, g, block and text of each slot: its words joined by blanks.  A text is cut once for all its spans, which meet it
    by id and hash; one text is taken of repeated rows."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).dropDuplicates(["d", "h"])
    cuts = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("shard", "slot", "g", "block", "lo", "words", "at")).alias("cuts"))
    met = cuts.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")))
    words = met.select("cuts", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"))
    each = words.select(F.explode(F.transform("cuts", lambda c: F.struct(c.alias("c"), F.array_join(F.slice(F.col("w"), (c["at"] + 1).cast("int"), c["words"].cast("int")), " ").alias("text")))).alias("x"))
    return each.select("x.c.*", "x.text").groupBy("shard", "slot", "g", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "text"))), lambda x: x["text"]), " ").alias("text"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, rows, sources = mixed(table(spark, sf_dir, "documents"))
    taken = spans.groupBy("row").agg(F.sum("words").alias("taken"))
    facts = spark.createDataFrame([(s.key, s.size, float(s.target)) for s in sources], "g string, source_size bigint, target double")
    facts = written(facts, f"{work_dir(spark)}/sources", rows=len(sources))  # so that Spark knows its size
    return rows.join(facts, "g").join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
