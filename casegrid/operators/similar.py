"""Joins of names that are alike: sets of words by an index, approximate names by trees of their letters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.operators.tries import LONGEST, LONGEST_TEXT, MOST, Patterns
from casegrid.plans.tables import written


def _rare_first(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables (key, words) with their words by how few sets of both have them."""
    tokens = a.select(F.lit("a").alias("side"), "key", F.explode("words").alias("word")).unionByName(b.select(F.lit("b").alias("side"), "key", F.explode("words").alias("word")))
    seen = tokens.groupBy("word").agg(F.count("*").alias("n"))
    sorted_ = tokens.join(seen, "word").groupBy("side", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("words"))
    return sorted_.filter("side = 'a'").drop("side"), sorted_.filter("side = 'b'").drop("side")


def similar_sets(a: DataFrame, b: DataFrame, threshold: float, within: str = "run") -> DataFrame:
    """(a, b, similarity) of the sets (key, ``within``, words; keys distinct, words each once) of either table that are in one
    ``within`` and have a Jaccard similarity of at least ``threshold``, which is above 0.

    Sets of n and m words at the threshold share at least t / (1 + t) * (n + m) of them.  With words in one order, rarest first,
    two such sets share one among the first n - that + 1 and m - that + 1; only those are indexed, for each pair of sizes by
    itself.  A word that every set has comes last and is indexed only where sharing it alone is enough."""
    share = threshold / (1 + threshold)

    def indexed(words: DataFrame, keys: DataFrame, name: str, own_first: bool) -> DataFrame:
        n = F.size("words")
        partners = F.sequence(F.ceil(n * threshold - 1e-9).cast("int"), F.floor(n / threshold + 1e-9).cast("int"))

        def prefix(m: Column) -> Column:
            needed = F.ceil((n + m) * share - 1e-9).cast("int")
            sizes = (n, m) if own_first else (m, n)
            return F.transform(F.slice("words", F.lit(1), F.greatest(n - needed + 1, F.lit(0))), lambda w: F.struct(w.alias("word"), sizes[0].alias("n"), sizes[1].alias("m")))

        rows = words.join(keys.select("key", within), "key")
        return rows.select(F.col("key").alias(name), within, F.col("words").alias(f"{name}_words"), F.explode(F.flatten(F.transform(partners, prefix))).alias("x")).select(name, within, f"{name}_words", "x.*")

    x, y = _rare_first(a, b)
    pairs = indexed(x, a, "a", True).join(indexed(y, b, "b", False), [within, "word", "n", "m"]).dropDuplicates(["a", "b"])
    both = F.size(F.array_intersect("a_words", "b_words"))
    return pairs.withColumn("similarity", both / (F.col("n") + F.col("m") - both)).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")


#: Patterns that a task holds, texts that it searches for them, and the parts into which fewer texts are still dealt.
PATTERNS, TEXTS, PARTS = 1 << 19, 1 << 15, 16
#: The longest pattern whose column of an edit table fits the bits of a long.
BITS = 64
#: Pairs whose signatures are compared at a time, and entries of a table of letters.
AT_A_TIME = 1 << 20


def _points(low: list[str]) -> np.ndarray:
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)


class _Strings:
    """Strings of one side: letters one after the other as numbers in an alphabet, and per string where they begin, how many there
    are, the edits it allows as a pattern and its signatures."""

    def __init__(self, low: list[str], share: float, alphabet: np.ndarray) -> None:
        self.low, self.alphabet = low, len(alphabet)
        self.size = np.array([*map(len, low)], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.edits = np.ceil(self.size * share).astype(np.int64)
        self.letters = np.searchsorted(alphabet, _points(low))

    @cached_property
    def _owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.low)), self.size)

    @cached_property
    def pairs(self) -> np.ndarray:
        two = np.flatnonzero(self._owner[1:] == self._owner[:-1])
        mixed = (self.letters[two] * 0x9E3779B1 + self.letters[two + 1] * 0x85EBCA77) * 0x27D4EB2F >> 15
        out = np.zeros((2, len(self.low)), np.uint64)
        np.bitwise_or.at(out, (mixed >> 6 & 1, self._owner[two]), np.uint64(1) << (mixed & 63).astype(np.uint64))
        return out

    @cached_property
    def counts(self) -> np.ndarray:
        """A bit for each of the first three letters of each of 21 kinds."""
        kind = self._owner * 21 + self.letters % 21
        order = np.argsort(kind, kind="stable")
        first = np.r_[True, kind[order][1:] != kind[order][:-1]][: len(order)]
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        seen = order[nth < 3]
        out = np.zeros(len(self.low), np.uint64)
        np.bitwise_or.at(out, self._owner[seen], np.uint64(1) << (self.letters[seen] % 21 * 3 + nth[nth < 3]).astype(np.uint64))
        return out

    @cached_property
    def least(self) -> np.ndarray:
        """Each edit takes away two pairs of letters at most."""
        return np.maximum(np.bitwise_count(self.pairs).sum(axis=0, dtype=np.int64) - 2 * self.edits, 0).astype(np.uint8)

    @cached_property
    def most(self) -> np.ndarray:
        return np.minimum(self.edits, 64).astype(np.uint8)


def _least_edits(p: str, x: str) -> int:
    """As ``_within``, of one pattern of any length."""
    full, eq = (1 << len(p)) - 1, {}
    for i, c in enumerate(p):
        eq[c] = eq.get(c, 0) | 1 << i
    up, down, score, best = full, 0, len(p), len(p)
    for c in x:
        e = eq.get(c, 0)
        level = ((e & up) + up ^ up) | e
        more, less = down | full & ~(level | up), up & level
        score += (more >> len(p) - 1 & 1) - (less >> len(p) - 1 & 1)
        best = min(best, score)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | full & ~(e | down | more), more & (e | down)
    return best


def _within(p: _Strings, x: _Strings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pattern ``i`` of ``p`` is within its edits of some part of text ``j`` of ``x``, for each of the pairs.  One column of the
    edit table is two words of bits, where it rises and where it falls from row to row; the last row is the highest bit, and rows
    below a shorter pattern match any letter."""
    out = np.zeros(len(i), bool)
    long = p.size[i] > BITS
    for n in np.flatnonzero(long):
        out[n] = _least_edits(p.low[i[n]], x.low[j[n]]) <= p.edits[i[n]]
    todo = np.flatnonzero(~long)
    todo = todo[np.argsort(-x.size[j[todo]].astype(np.int32), kind="stable")]
    i, j = i[todo], j[todo]
    if not len(i):
        return out
    used = np.zeros(len(p.low), bool)
    used[i] = True
    own = np.flatnonzero(used)
    row = (np.cumsum(used) - 1)[i]
    place = np.repeat(p.at[own] - np.cumsum(p.size[own]) + p.size[own], p.size[own]) + np.arange(p.size[own].sum())
    seen = np.zeros(p.alphabet, bool)
    seen[p.letters[place]] = True
    alphabet = np.flatnonzero(seen)
    number = np.full(p.alphabet, len(alphabet))
    number[alphabet] = np.arange(len(alphabet))
    if len(own) > 1 and len(own) * (len(alphabet) + 1) > 8 * AT_A_TIME:
        half = row < len(own) // 2
        for part in (half, ~half):
            out[todo[part]] = _within(p, x, i[part], j[part])
        return out
    word = np.int32 if p.size[own].max() <= 32 else np.int64
    width = word(0).nbytes * 8
    unsigned = np.uint32 if width == 32 else np.uint64
    bit = np.repeat(width - p.size[own], p.size[own]) + place - np.repeat(p.at[own], p.size[own])
    masks = np.zeros((len(own), len(alphabet) + 1), unsigned)
    np.bitwise_or.at(masks, (np.repeat(np.arange(len(own)), p.size[own]), number[p.letters[place]]), unsigned(1) << bit.astype(unsigned))
    below = np.where(p.size[own] < width, (unsigned(1) << (width - p.size[own]).astype(unsigned)) - unsigned(1), unsigned(0)).astype(unsigned)
    masks = (masks | below[:, None]).view(word)
    code = number[x.letters]
    flat, row, at = masks.ravel(), row * masks.shape[1], x.at[j]
    up, down = (~below).view(word)[row // masks.shape[1]], np.zeros(len(i), word)
    score = p.size[i].astype(word)
    best = score.copy()
    sizes = -x.size[j]
    for t in range(int(-sizes[0])):
        n = int(np.searchsorted(sizes, -t))  # the pairs whose text has a letter more
        e, u, d = flat[row[:n] + code[at[:n] + t]], up[:n], down[:n]
        level = (((e & u) + u) ^ u) | e
        more, less = d | ~(level | u), u & level
        score[:n] += (less >> (width - 1)) - (more >> (width - 1))
        np.minimum(best[:n], score[:n], out=best[:n])
        more, less = more << 1, less << 1
        e |= d
        up[:n], down[:n] = less | ~(e | more), more & e
    out[todo] = best <= p.edits[i]
    return out


def _holds(p: _Strings, x: _Strings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """As ``_within``, for strings that may be empty or too short."""
    may = (np.minimum(p.size[i], x.size[j]) > 0) & (x.size[j] + p.edits[i] >= p.size[i])
    may[may] = _within(p, x, i[may], j[may])
    return may | (p.size[i] == 0) & (x.size[j] == 0)


def _by_signatures(p: _Strings, x: _Strings, patterns: np.ndarray, texts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_parts``, a few patterns at a time: k edits leave all but 2 k of a pattern's pairs of letters as they are, so words of bits, a
    bit for some pairs of letters each, tell most strings apart; edits are counted for the others."""
    step = max(1, AT_A_TIME // max(1, len(texts)))
    for k in range(0, len(patterns) if len(texts) else 0, step):
        some = patterns[k : k + step]
        both = np.bitwise_count(p.pairs[0, some, None] & x.pairs[0, texts])
        both += np.bitwise_count(p.pairs[1, some, None] & x.pairs[1, texts])
        may = (both >= p.least[some, None]) & (np.bitwise_count(p.counts[some, None] & ~x.counts[texts]) <= p.most[some, None])
        i, j = np.divmod(np.flatnonzero(may), len(texts))
        i, j = some[i], texts[j]
        right = _holds(p, x, i, j)
        yield i[right], j[right]


def _parts(p: _Strings, x: _Strings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), each once, where pattern ``i`` of ``p`` is within its edits of some part of text ``j`` of ``x``: by trees of the patterns' letters,
    and by signatures where either is too long or too short for these."""
    plain = (p.size > 1) & (p.size <= LONGEST) & (p.edits > 0) & (p.edits < p.size) & (p.edits <= MOST)
    fits = (x.size > 0) & (x.size <= LONGEST_TEXT)
    i, j = np.flatnonzero(plain), np.flatnonzero(fits)
    for m, n in Patterns(p.letters, p.at[i], p.size[i], p.edits[i], p.alphabet).within(x.letters, x.at[j], x.size[j]):
        yield i[m], j[n]
    yield from _by_signatures(p, x, i, np.flatnonzero(~fits))
    yield from _by_signatures(p, x, np.flatnonzero(~plain), np.arange(len(x.low)))


def _alike(a: _Strings, b: _Strings, ways: tuple[int, ...] = (0, 1)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of which one is in the other, each once: by way 0 those whose ``b`` is in ``a``, by way 1 those whose ``a`` only is in ``b``."""
    if 0 in ways:
        for j, i in _parts(b, a):
            yield i, j
    if 1 in ways:
        for i, j in _parts(a, b):
            new = ~_holds(b, a, j, i)
            yield i[new], j[new]


def approximate_join(a: DataFrame, b: DataFrame, share: float = 0.2) -> DataFrame:
    """(a, b) of the distinct strings of two one-column tables of which one is in the other up to ceil(share * length) edits, either way
    round, without regard to case.

    Either side's strings are patterns that are searched in the other's.  A group has PATTERNS patterns and TEXTS texts at most; every
    block of patterns meets every block of texts."""
    sides = [written(df.select(F.col(df.columns[0]).alias("name")).filter("name is not null").distinct()) for df in (a, b)]
    sizes = [df.count() for df in sides]
    blocks = [max(-(-n // PATTERNS), 1) for n in sizes]
    size = F.least(F.length("name"), F.lit(LONGEST + 1))
    parts = [max(-(-n // TEXTS), min(PARTS, -(-n // 256)), 1) for n in sizes]

    def block(side: int) -> Column:
        """Names of one length in one block, as trees of these grow less than their number; a length of many names in several."""
        if blocks[side] == 1:
            return F.lit(0).cast("bigint")
        rank, before = F.lit(0).cast("bigint"), 0
        for length, n in sorted((r[0], r[1]) for r in sides[side].groupBy(size).count().collect()):
            rank = F.when(size == length, before + F.pmod(F.xxhash64("name"), F.lit(n))).otherwise(rank)
            before += n
        return F.floor(rank * blocks[side] / before).cast("bigint")

    block_of = [block(0), block(1)]

    def dealt(way: int, side: int) -> DataFrame:
        """The strings of a side as the texts (``side`` is the way) or the patterns of a way."""
        text = side == way
        own = F.pmod(F.xxhash64("name"), F.lit(parts[side])) if text else block_of[side]
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((blocks if text else parts)[1 - side] - 1).cast("bigint")))
        low = F.nullif(F.lower("name"), F.col("name")).alias("low")
        return sides[side].select("name", low, F.lit(side).alias("side"), F.lit(way).alias("way"), (other if text else own).alias("i"), (own if text else other).alias("j"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([*batches])
        mine = [rows.filter(pa.compute.equal(rows.column("side"), k)).combine_chunks() for k in (0, 1)]
        names = [m.column("name") for m in mine]
        low = [pa.compute.coalesce(m.column("low"), m.column("name")).to_pylist() for m in mine]
        way = rows.column("way")[0].as_py()
        alphabet = np.unique(_points(low[0] + low[1]))
        if low[0] and low[1]:
            for i, j in _alike(*(_Strings(x, share, alphabet) for x in low), (way,)):
                yield pa.RecordBatch.from_arrays([c.take(pa.array(n)).combine_chunks() for c, n in zip(names, (i, j), strict=True)], ["a", "b"])

    groups = blocks[1] * parts[0] + blocks[0] * parts[1]
    rows = dealt(0, 0).unionByName(dealt(0, 1)).unionByName(dealt(1, 0)).unionByName(dealt(1, 1))
    # more partitions than groups, so that few have two
    return rows.repartition(min(8 * groups, 2_000), "way", "i", "j").groupBy("way", "i", "j").applyInArrow(compared, "a string, b string")
