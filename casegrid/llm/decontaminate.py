"""Benchmark decontamination (operator 3): documents that hold a passage of a benchmark item, word for word or reworded.

Method: latent semantic retrieval.  Texts are cut into passages of words, whose TF-IDF
rows (hashed terms) make a matrix A over the whole corpus.  A randomised SVD finds its
leading right singular vectors in one pass: every partition adds up A'(A R) for a random test matrix
R, and the Nystroem form of the sums gives the vectors.  Sliding passages of all texts are
projected and compared with the items' passages by cosine.  Rewordings and short items that
the latent space misses are retrieved by the pairs of near words that they share with an
item at about one offset.  A candidate is decided by the longest common subsequence of words
around it.  A share of VERBATIM of the item is a leak; a
share of REWORDED is one if the item's answer (its last sentence, or the last third of a single long one) is there too; and so is a
share of VERBATIM of any PASSAGE successive words of a longer item, for texts that quote a part.

Items are read in blocks of BLOCK rows in the order of their ids; each block is one pass over
the texts, written before the next block is broadcast, so what is broadcast is bounded.

Defined results: a null text counts as empty, and a text without words holds no item; items
without words are ignored; repeated items are found once each by id; repeated rows get the
same result each; without items nothing is contaminated; very long
texts are searched whole; an empty table gives none; a null doc_id stays null; all other
columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.common import forget, hash_words, slices, table, work_dir, written

TERMS, RANK, EXTRA, SEED = 8192, 64, 8, 5
#: Sliding passages begin every STEP words and have these many words; the least cosine of a candidate for each.
STEP, SIZES, COSINES = 4, (16, 32), (0.8, 0.8)
VERBATIM, REWORDED, ANSWER, ONE = 0.7, 0.6, 0.8, 24
#: Pairs are of words at most GAP apart; a candidate shares one pair for each PER words of the item (or of 32), in a band of offsets.
GAP, PER, BAND = 2, 3, 16
_BITS = 20
#: Passages of an item that are decided by themselves: their words, and the step between them.
PASSAGE, PASSAGE_STEP = 24, 4
BLOCK = 2_000
#: Bytes of text that are worked on at once.
PART = 1 << 20
_SHARDS = 128
#: What parts words: white space and ASCII punctuation.
_PARTS = np.zeros(256, bool)
_PARTS[np.frombuffer(bytes(range(33)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x7f", np.uint8)] = True


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (lower case) of the texts, one text after the other, and where each text's begin."""
    raws = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
    h, starts = hash_words(b, _PARTS)
    return h, np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))


def terms(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(TERMS - 1)).astype(np.int64)


def _padded(n: np.ndarray, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` with every text's terms padded with TERMS to a multiple of ``size``, and each text's first group of ``size``."""
    count = np.diff(begin)
    groups = -(-count // size)
    first = np.cumsum(np.concatenate([[0], groups]))
    out = np.full(int(first[-1]) * size, TERMS)
    out[np.arange(len(n)) + np.repeat(first[:-1] * size - begin[:-1], count)] = n
    return out, first


def _sums(rows: np.ndarray, padded: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``rows`` (of which the last is zero) over each ``size`` successive terms."""
    out = np.empty((len(padded) // size, rows.shape[1]), np.float32)
    for a in range(0, len(out), 256):  # blocks that fit in the cache
        out[a : a + 256] = rows[padded[a * size : (a + 256) * size]].reshape(-1, size, rows.shape[1]).sum(1)
    return out


def _with_zero(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])


def latent_space(docs: DataFrame, rank: int = RANK) -> np.ndarray:
    """What each term adds to its passage's latent vector (its weight by its row of the leading right singular vectors of
    the corpus's TF-IDF passages), and a last row of zeros.

    One pass over all texts.  With F the counts of terms by passage and D their weights (inverse passage frequency), the
    matrix is A = F D.  Every partition adds up F'F R for a random R, and the passages that have each term.  As D is known by
    then, D F'F R is A'A (1/D) R: the product that the Nystroem form needs, for the test matrix (1/D) R."""
    random = np.random.default_rng(SEED).normal(size=(TERMS, rank + EXTRA)).astype(np.float32)
    width, cols = TERMS // _SHARDS, rank + EXTRA
    rows_of = _with_zero(random)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros((cols + 1, TERMS)), 0  # the last row counts passages
        for batch in batches:
            for b in slices(batch, PART):
                h, begin = tokens(b.column("text").to_pylist())
                padded, first = _padded(terms(h), begin, SIZES[-1])
                z = _sums(rows_of, padded, SIZES[-1])  # F R, passage by passage
                passage = np.arange(len(padded)) // SIZES[-1]
                for c, column in enumerate(np.ascontiguousarray(z.T)):
                    total[c] += np.bincount(padded, column[passage], TERMS + 1)[:TERMS]
                own = np.sort(padded.astype(np.uint16).reshape(-1, SIZES[-1]), axis=1)
                new = np.concatenate([np.ones((len(own), 1), bool), own[:, 1:] != own[:, :-1]], axis=1)
                total[cols] += np.bincount(own[new], minlength=TERMS + 1)[:TERMS]
                passages += int(first[-1])
        m = [np.ascontiguousarray(total[:, s * width : (s + 1) * width]).tobytes() for s in range(_SHARDS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SHARDS), pa.int32()), pa.array(m, pa.binary()), pa.array([passages] * _SHARDS)], names=["shard", "m", "passages"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        passages: dict[int, int] = {}
        for b in batches:
            for s, m, n in zip(b.column("shard").to_pylist(), b.column("m").to_pylist(), b.column("passages").to_pylist(), strict=True):
                sums[s] = sums.get(s, 0) + np.frombuffer(m, np.float64)
                passages[s] = passages.get(s, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary()), pa.array(list(passages.values()), pa.int64())], names=["shard", "m", "passages"])

    schema, y, passages = "shard int, m binary, passages bigint", np.zeros((cols + 1, TERMS)), 0
    for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema).repartition("shard").mapInArrow(add, schema).collect():
        y[:, r["shard"] * width : (r["shard"] + 1) * width] += np.frombuffer(r["m"]).reshape(cols + 1, width)
        passages = r["passages"]
    idf = np.log((1.5 + passages) / (1 + y[cols]))  # above 0, whatever the counts
    y = idf[:, None] * y[:cols].T
    core = (random / idf[:, None]).T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(), 1e-300)
    out = np.zeros((TERMS, rank), np.float32)
    if good.any():
        u, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
        out[:, : min(rank, u.shape[1])] = u[:, :rank]
    return _with_zero((idf[:, None] * out).astype(np.float32))


def positions(a: list) -> dict:
    """For each word of ``a`` the bits of its places."""
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def lcs(masks: dict, size: int, b: list, least: float = 0) -> int:
    """Length of the longest common subsequence of ``b`` and the ``size`` words of ``masks``, by bits of one integer; 0 if it
    must be less than ``least``."""
    hits = [masks[w] for w in b if w in masks]
    if len(hits) < least:
        return 0
    full = (1 << size) - 1
    v = full
    for m in hits:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def answer(text: str) -> str:
    """The last sentence; of a single sentence of ONE words or more its last third."""
    body = text.strip().rstrip(".!?…")
    last = body[max(body.rfind(c) for c in ".!?\n") + 1 :]
    words = last.split()
    return " ".join(words[-(len(words) // 3) :]) if len(last) == len(body) and len(words) >= ONE else last


@dataclass
class Items:
    """A block of benchmark items (words as hashes) and their latent passages: query q starts at word starts[q] of item
    owner[q] and is compared with the texts' passages of SIZES[size[q]] words."""

    ids: list[int | None]
    words: list[dict]
    passages: list[list[tuple[int, dict]]]
    answers: list[tuple[dict, int]]
    owner: np.ndarray
    starts: np.ndarray
    size: np.ndarray
    vectors: np.ndarray
    length: np.ndarray
    held: np.ndarray  # which terms each item has
    pairs: np.ndarray  # keys of the items' word pairs, ascending
    pair_item: np.ndarray
    pair_place: np.ndarray
    known: np.ndarray  # which low bits the keys have


def word_pairs(h: np.ndarray) -> Iterator[np.ndarray]:
    """For each gap the keys of the pairs that begin at each word."""
    for gap in range(1, GAP + 1):
        k = h[:-gap] * np.uint64(0x9E3779B97F4A7C15) ^ h[gap:]
        yield (k ^ (k >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(8)


def prepared(rows: list[tuple[int | None, str]], projected: np.ndarray) -> Items:
    ids, all_words, lengths, answers, owner, starts, size, vectors = [], [], [], [], [], [], [], []
    pairs, passages = [], []
    for item_id, text in rows:
        h, _ = tokens([text])
        if not len(h):
            continue
        n = terms(h)
        k = 0 if len(n) < SIZES[1] + 2 * STEP else 1
        for a in sorted({*range(0, max(1, len(n) - SIZES[k] + 1), SIZES[-1]), max(0, len(n) - SIZES[k])}):
            owner.append(len(ids)), starts.append(a), size.append(k), vectors.append(projected[n[a : a + SIZES[k]]].sum(0))
        pairs += [(k, np.full(len(k), len(ids)), np.arange(len(k))) for k in word_pairs(h)] if len(h) > GAP else [(h[:1], np.full(1, len(ids)), np.zeros(1, int))]
        ids.append(item_id), all_words.append(positions(h.tolist()))
        passages.append([(a, positions(h[a : a + PASSAGE].tolist())) for a in sorted({*range(0, len(h) - PASSAGE, PASSAGE_STEP), len(h) - PASSAGE})] if len(h) > PASSAGE else [])
        last = tokens([answer(text)])[0].tolist()
        lengths.append(len(h)), answers.append((positions(last), len(last)))
    v = np.array(vectors, np.float32).reshape(-1, projected.shape[1])
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    held = np.zeros((len(ids), TERMS + 1), bool)
    for i, w in enumerate(all_words):
        held[i, terms(np.array(list(w), np.uint64))] = True
    keys, item, place = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int))
    order = np.argsort(keys, kind="stable")
    known = np.zeros(1 << _BITS, bool)
    known[(keys & np.uint64((1 << _BITS) - 1)).astype(int)] = True
    return Items(ids, all_words, passages, answers, np.array(owner, int), np.array(starts, int), np.array(size, int), v, np.array(lengths, int), held, keys[order], item[order], place[order], known)


def candidates(h: np.ndarray, begin: np.ndarray, projected: np.ndarray, items: Items) -> np.ndarray:
    """Rows (text, item, where the item's first word would be in the text) whose passages are near in the latent space."""
    none = np.empty((0, 3), np.int64)
    if not len(h) or not len(items.owner):
        return none
    out = []
    padded, first = _padded(terms(h), begin, STEP)
    # the blocks' sums, with zero blocks behind each text, so that a passage's sum never reaches into the next one
    gap = SIZES[-1] // STEP - 1
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(int(first[-1])) - first[:-1][text]
    sums = np.zeros((int(first[-1]) + gap * (len(count) + 1), projected.shape[1]), np.float32)
    at = np.arange(int(first[-1])) + gap * text
    sums[at] = _sums(projected, padded, STEP)
    left, width = count[text] - place, 1  # blocks from here to the text's end
    for k, size in enumerate(SIZES):
        while width < size // STEP:
            sums = sums[: len(sums) - width] + sums[width:]
            width *= 2
        queries = np.flatnonzero(items.size == k)
        # a passage within its text, or all of a shorter text; larger passages at every second step
        whole = np.flatnonzero(((left >= width) & (place % (1 + k) == 0)) | (place == 0) | (left == width))
        if not len(queries):
            continue
        vectors = np.ascontiguousarray(items.vectors[queries].T)
        for a in range(0, len(whole), 2048):
            w = sums[at[whole[a : a + 2048]]]
            near = np.flatnonzero(w @ vectors >= COSINES[k] * np.maximum(np.sqrt(np.einsum("ij,ij->i", w, w)), 1e-9)[:, None])
            b = whole[a + near // len(queries)]
            q = queries[near % len(queries)]
            start = place[b] * STEP - items.starts[q]
            out.append((text[b] * len(items.ids) + items.owner[q] << 32) + start + (1 << 31))
    if not out:
        return none
    code = np.unique(np.concatenate(out))
    pair = code >> 32
    return np.stack([pair // len(items.ids), pair % len(items.ids), (code & 0xFFFFFFFF) - (1 << 31)], 1)


def by_pairs(h: np.ndarray, begin: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Rows as of ``candidates``: where a text shares enough word pairs with an item in a band of offsets, and those of
    them with enough for a passage."""
    pair, place, offset = [], [], []
    for gap, k in enumerate(word_pairs(h), 1):
        at = np.flatnonzero(items.known[(k & np.uint64((1 << _BITS) - 1)).astype(int)])
        lo, hi = np.searchsorted(items.pairs, k[at]), np.searchsorted(items.pairs, k[at], "right")
        t = np.searchsorted(begin, at, "right") - 1
        n = np.where(at + gap < begin[t + 1], hi - lo, 0)  # both words in one text
        own = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        pair.append(np.repeat(t, n) * len(items.ids) + items.pair_item[own])
        place.append(items.pair_place[own] * GAP + gap - 1), offset.append(np.repeat(at - begin[t], n) - items.pair_place[own])
    pair, place, offset = (np.concatenate(x) if x else np.empty(0, int) for x in (pair, place, offset))
    out, part, least = [], [], np.maximum(1, np.minimum(items.length, SIZES[-1]) // PER)
    for shift in (0, BAND // 2):  # bands overlap by half
        code = (pair << 32) + (offset + shift) // BAND + (1 << 31)
        often = np.argsort(code, kind="stable")
        band = np.flatnonzero(np.diff(code[often], prepend=-1))
        raw = np.diff(np.append(band, len(code)))
        often = often[np.repeat(raw >= least[(code[often[band]] >> 32) % max(1, len(items.ids))], raw)]
        order = often[np.lexsort((place[often], code[often]))]
        c, p = code[order], place[order]
        band = np.flatnonzero(np.diff(c, prepend=-1))
        new = np.concatenate([[1], (c[1:] != c[:-1]) | (p[1:] != p[:-1])]) if len(c) else c
        count = np.add.reduceat(new, band) if len(c) else c  # a pair of the item counts once, however often a text repeats it
        code = c[band]
        own = (code >> 32) % max(1, len(items.ids))
        enough = count >= least[own]
        code, count, own = code[enough], count[enough], own[enough]
        part.append((count >= PASSAGE * 2 // 3) & (items.length[own] > PASSAGE))
        both = code >> 32
        out.append(np.stack([both // max(1, len(items.ids)), both % max(1, len(items.ids)), ((code & 0xFFFFFFFF) - (1 << 31)) * BAND - shift + BAND // 2], 1))
    rows = np.concatenate(out)
    return rows, rows[np.concatenate(part)]


def merged(rows: np.ndarray) -> np.ndarray:
    """Of candidates (text, item, start) those whose starts fall in one band as one: (text, item, first start, last start)."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return np.empty((0, 4), np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0) | (np.diff(rows[:, 2] // BAND) != 0)]))
    return np.concatenate([rows[new], rows[np.append(new[1:], len(rows)) - 1, 2:]], 1)


def likely(near: np.ndarray, h: np.ndarray, begin: np.ndarray, items: Items) -> np.ndarray:
    """Those of the candidates around which enough words have terms of the item: a common sequence is no longer than that."""
    n, out = np.append(terms(h), TERMS), []
    for part in np.array_split(near[np.argsort(items.length[near[:, 1]], kind="stable")], max(1, len(near) >> 14)):
        t, i = part[:, 0], part[:, 1]
        lo = np.maximum(begin[t], begin[t] + part[:, 2] - 4 * STEP)
        hi = np.minimum(begin[t + 1], begin[t] + part[:, 2] + items.length[i] + 4 * STEP)
        count = np.zeros(len(part), np.int32)
        flat, row = items.held.ravel(), i * (TERMS + 1)
        for k in range(int((hi - lo).max(initial=0))):
            at = lo + k
            count += flat[row + n[np.where(at < hi, at, len(h))]]
        out.append(part[count >= REWORDED * items.length[i]])
    return np.concatenate(out)


def found(texts: list[str], projected: np.ndarray, items: Items) -> list[dict[int, float]]:
    """For each text the index of each item that it holds, with the share of the item's words found in order."""
    h, begin = tokens(texts)
    best: list[dict[int, float]] = [{} for _ in texts]
    if not len(h) or not items.ids:
        return best
    whole, parts = by_pairs(h, begin, items)
    near = np.concatenate([candidates(h, begin, projected, items), whole])
    for t, i, start, last in merged(likely(near, h, begin, items)).tolist():
        if best[t].get(i, 0) >= 1:
            continue
        own, size, lo, hi = items.words[i], int(items.length[i]), int(begin[t]), int(begin[t + 1])
        around = h[max(lo, lo + start - 4 * STEP) : min(hi, lo + last + size + 4 * STEP)].tolist()
        share = lcs(own, size, around, REWORDED * size) / size
        wanted, n = items.answers[i]
        if share >= VERBATIM or (share >= REWORDED and n and lcs(wanted, n, around) >= ANSWER * n):
            best[t][i] = max(best[t].get(i, 0), share)
    for t, i, start, last in merged(parts).tolist():
        if i in best[t]:
            continue
        lo, hi, size = int(begin[t]), int(begin[t + 1]), int(items.length[i])
        for a, words in items.passages[i]:
            around = h[max(lo, lo + start + a - BAND) : max(lo, min(hi, lo + last + a + PASSAGE + BAND))].tolist()
            if lcs(words, PASSAGE, around, VERBATIM * PASSAGE) >= VERBATIM * PASSAGE:
                best[t][i] = lcs(items.words[i], size, h[max(lo, lo + start - BAND) : min(hi, lo + last + size + BAND)].tolist()) / size
                break
    return best


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int | None, str]], bool]]:
    """The items, BLOCK at a time, and whether a block is the last."""
    block = []
    for r in benchmark.select(F.col("item_id").cast("bigint").alias("i"), F.coalesce("text", F.lit("")).alias("t")).distinct().orderBy("i", "t").toLocalIterator():
        if len(block) == BLOCK:
            yield block, False
            block = []
        block.append((r["i"], r["t"]))
    if block:
        yield block, True


def _passes(rows: DataFrame, benchmark: DataFrame, space: np.ndarray, search) -> DataFrame:
    """``rows`` after one pass of ``search(projected, items)`` for each block of items.  All but the last are written, so that
    one block is broadcast at a time and no stage holds several."""
    spark, before = rows.sparkSession, None
    for block, last in _blocks(benchmark):
        shared = spark.sparkContext.broadcast((space, prepared(block, space)))

        def run(batches, shared=shared):
            yield from search(batches, *shared.value)

        rows = rows.mapInArrow(run, rows.schema)
        if not last:
            path = f"{work_dir(spark)}/passed"
            rows = written(rows, path)
            shared.destroy()
            if before:
                forget(spark, before)
            before = path
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_ids (ascending) and share (the largest) of each row."""

    def search(batches: Iterator[pa.RecordBatch], projected: np.ndarray, items: Items) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, PART):
                got = found(b.column("text").to_pylist(), projected, items)
                before, share = b.column("item_ids").to_pylist(), b.column("share").to_pylist()
                ids = [sorted({*x, *(items.ids[i] for i in g if items.ids[i] is not None)}) for g, x in zip(got, before, strict=True)]
                most = [max([s, *g.values()]) for g, s in zip(got, share, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(ids, b.schema.field("item_ids").type), pa.array(most, pa.float64())], schema=b.schema)

    none = F.array().cast("array<bigint>").alias("item_ids")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), none, F.lit(0.0).alias("share"))
    return _passes(rows, benchmark, latent_space(docs), search).select("doc_id", "item_ids", "share")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, whose text holds no benchmark item."""

    def search(batches: Iterator[pa.RecordBatch], projected: np.ndarray, items: Items) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, PART):
                yield b.filter(pa.array([not g for g in found([t or "" for t in b.column("text").to_pylist()], projected, items)], pa.bool_()))

    return _passes(docs, benchmark, latent_space(docs), search)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.col("share") > 0).alias("contaminated"), F.size("item_ids").cast("bigint").alias("n_items"), "item_ids", "share")
