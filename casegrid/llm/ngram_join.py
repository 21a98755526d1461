"""N-gram Jaccard join (operator 2): documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Method: MinHash LSH forest.  Each text's signature is cut into TREES label strings of
DEPTH minima.  In each tree the labels are sorted, so that texts with a common prefix are
neighbours: the sorted list is a prefix trie.  A text is first compared in its deepest
node that holds another text, at up to DEPTH minima: its prefix is shortened until it
meets one.  The least depth is the one at which a pair at the threshold shares a node in some tree as often as the
target recall asks.  A node of that depth whose texts are then all of one class is settled, and they stay at the
depths they have reached; the texts of the others are shortened to it and compared across classes.
Pairs are verified exactly on their shingle sets.

Copies first: texts with equal words form one class and only one of them is compared.
In a node not all pairs are compared.  Every text is verified against the smallest one before it in its
deepest shared node; those that match are linked by it, and the links of all trees are joined to
classes.  In the nodes that are not settled, only texts outside the node's largest class are compared further,
with texts of other classes, and only where the triangle inequality of the Jaccard
distance and the sets' parity sketches let them match.  Neither test rules out a match, so
no link that would join two classes is lost, and a node of near copies costs one row each.

Links are joined to classes by rounds of contraction on written tables.  A link never leaves
its class, so all links are then counted inside the classes.  A class that is larger than a block is dealt to blocks by
the distance of its texts from a centre, the shingles that most of a sample of them have.  By the triangle inequality whole
blocks are linked with each other, or not at all, without a comparison; the others meet once, where the common
shingles of all pairs are counted exactly.  So near copies of one text cost one row each, however many they are.

Defined results: a null text counts as empty; a text of fewer than five words has its
words as its only shingle; a text without words only equals others without words; repeated
rows get the same result each; rows that share an id (or have none) but not their words are
texts of their own, compared each; a null doc_id stays null and a class is named by its
smallest id, nulls first; very long texts are compared by all their shingles; an
empty table gives none; other columns are ignored here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegrid.llm.common import NULL_ID, SPACES, did, hash_words, keyed, slices, table, work_dir, written

N, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL, SEED = 20, 9, 0.9995, 7
#: Bits of a set's parity sketch.  Two sets' sketches differ in no more bits than the sets differ in shingles, so the
#: sketches rule pairs out without error.
BITS = 2048
#: A class is dealt to blocks of about so many texts, or shingles, when its links are counted.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: The centre of a class of several blocks is the majority of about so many of its texts, or shingles.
SAMPLE, SAMPLE_SHINGLES = 64, 1 << 21
_WIDTH = 2048


def depth_for(recall: float = RECALL, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH) -> int:
    """The least prefix length: shortened from ``depth`` until a pair at the threshold meets in some tree as often as asked."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def shingles(text: str, n: int = N) -> np.ndarray:
    """The sorted set of hashes of the text's runs of ``n`` words."""
    h, _ = hash_words(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), SPACES)
    if not len(h):
        return h
    n = min(n, len(h))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total = _mix(total ^ h[k : k + len(total)]) + np.uint64(k + 1)
    return np.unique(total)


def _parameters(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**32, count, np.uint32), rng.integers(0, 2**32, count, np.uint32) | np.uint32(1)


def signature(s: np.ndarray, xor: np.ndarray, times: np.ndarray) -> np.ndarray:
    """One minimum for each pair of parameters, over the upper halves of the hashes."""
    out, s = np.full(len(xor), np.uint32(2**32 - 1)), (s >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(s), 256):  # blocks that fit in the cache
        out = np.minimum(out, ((s[a : a + 256, None] ^ xor) * times).min(0))
    return out


def copy_key(text: str) -> bytes:
    return hashlib.blake2b(b" ".join(text.encode("utf-8", "surrogatepass").split()), digest_size=16).digest()


def labels(minima: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each tree's row of ``minima`` the first ``least`` as one key, and up to four more as a string of 16-bit characters."""
    minima = minima.astype(np.uint64)
    key, rest = np.arange(len(minima), dtype=np.uint64), np.zeros(len(minima), np.uint64)
    for k in range(least):
        key = _mix(key ^ minima[:, k]) + np.uint64(k)
    for k in range(least, least + 4):
        rest <<= np.uint64(16)
        if k < minima.shape[1]:
            rest |= _mix(minima[:, k]) >> np.uint64(48)
    return key.view(np.int64), rest.view(np.int64)


def _signed(least: int):
    xor, times = _parameters(TREES * DEPTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                copies, keys, rests = [], [], []
                for text in b.column("text").to_pylist():
                    s = shingles(text)
                    copies.append(copy_key(text))
                    key, rest = labels(signature(s, xor, times).reshape(TREES, DEPTH), least) if len(s) else ([], [])
                    keys.append(key), rests.append(rest)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("did"), b.column("th"), pa.array(copies, pa.binary()), pa.array(keys, longs), pa.array(rests, longs)], names=["did", "th", "copy", "keys", "rests"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (key, rest, v), of which each key is the trie below the least prefix: of each key with several
    rows each row with the smallest v before it in its deepest node that holds an earlier one (the very first with itself),
    and how many minima beyond the key they share.  As v is a hash, the trees mostly agree on whom a text is compared with.
    What is kept between batches is the last row and the smallest v of each node around it."""
    key = rest = v = leader = np.empty(0, np.int64)
    more = np.array([-1])  # of the last row, which waits for its successor
    smallest = np.zeros(5, np.int64)
    names = ["key", "v", "leader", "more"]
    for b in batches:
        if not b.num_rows:
            continue
        carried = len(key) > 0
        key, rest, v = (np.concatenate([x[-1:], b.column(c).to_numpy()]) for x, c in ((key, "key"), (rest, "rest"), (v, "v")))
        x = (rest[1:] ^ rest[:-1]).view(np.uint64)
        lcp = np.where(key[1:] == key[:-1], sum((x < np.uint64(1 << k)).astype(int) for k in (48, 32, 16, 0)), -1)
        before, more, leader = leader[-1:], np.concatenate([more[-1:], lcp]), v.copy()
        if carried:
            leader[0] = before[0]
        values, rank = np.unique(np.concatenate([v, smallest]), return_inverse=True)
        for level in range(5):
            node = np.cumsum(np.concatenate([[0], more[1:] < level])) * (len(values) + 1)
            r = rank[: len(v)].copy()
            if carried:
                r[0] = rank[len(v) + level]
            least = values[np.minimum.accumulate(r - node) + node]  # later nodes rank lower, so each begins anew
            here = np.flatnonzero(more[1:] == level) + 1
            leader[here] = least[here - 1]
            smallest[level] = least[-1]
        e = np.flatnonzero((more[:-1] >= 0) | (more[1:] >= 0))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[e], v[e], leader[e], np.maximum(more[e], 0).astype(np.int32))], names=names)
    if len(key) and more[-1] >= 0:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[-1:], v[-1:], leader[-1:], more[-1:].astype(np.int32))], names=names)


def sketch(s: np.ndarray) -> np.ndarray:
    """For each of BITS bins of hashes the parity of how many of the set fall in it, as 64-bit words."""
    odd = np.bincount((s >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, 4 << 20):
            own = [shingles(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("v"), pa.array([s.tobytes() for s in own], pa.binary()), pa.array([len(s) for s in own], pa.int32()), pa.array([sketch(s) for s in own], pa.list_(pa.int64()))], names=["v", "s", "size", "bits"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in slices(batch):
            out, held, raw = [], None, None
            for x, y in zip(p.column("s"), p.column("t"), strict=True):
                y = y.as_py()
                if y != raw:
                    held, raw = np.frombuffer(y, np.uint64), y
                out.append(1 - jaccard(np.frombuffer(x.as_py(), np.uint64), held))
            yield pa.RecordBatch.from_arrays([p.column("v"), p.column("leader"), pa.array(out, pa.float64())], names=["v", "leader", "d"])


def _roots(members: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """v, root: the classes of all texts that a verified link names.  ``members``: key, v and its leader (of ``_neighbours``);
    ``sets``: of each v.

    First every text is verified against its leader.  The links of all trees are joined to
    classes, and a key of one class is settled.  In the others, texts outside the key's largest class are compared with those of
    other classes that the triangle inequality over a common leader and the sets' parity sketches allow to match, both
    without error: some of them in each round, many more in the next, as a round's links may have joined the rest."""
    most, rows = 1 - THRESHOLD + 1e-12, members.count()

    def verify(pairs: DataFrame, at: str) -> DataFrame:
        both = pairs.distinct().join(sets.select("v", "s"), "v").join(sets.select(F.col("v").alias("leader"), F.col("s").alias("t")), "leader")
        return written(both.select("v", "leader", "s", "t").mapInArrow(_verified, "v bigint, leader bigint, d double"), at, rows)

    def linked(verified: DataFrame) -> DataFrame:
        return verified.filter(F.col("d") <= most).select("v", F.col("leader").alias("w"))

    verified = verify(members.filter("v <> leader").select("v", "leader"), f"{path}/verified0")
    links = linked(verified)
    own = ["size", *(f"b{i}" for i in range(BITS // 64))]
    traits = sets.select("v", "size", *(F.col("bits")[i].alias(f"b{i}") for i in range(BITS // 64)))
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"l_{c}"))) for c in own[1:]), F.lit(0))
    # sets that share the threshold of their union differ in this part of their sizes' sum at most
    alike = differ <= (F.col("size") + F.col("l_size")) * ((1 - THRESHOLD) / (1 + THRESHOLD)) + 1e-9
    near = (F.col("leader") != F.col("l_leader")) | (F.abs(F.col("d0") - F.col("e0")) <= most)
    round_, share, roots = 0, 256, None
    while True:
        roots = _joined(roots, links, f"{path}/classes{round_}")
        named = members.join(roots.withColumnRenamed("root", "c"), "v", "left").withColumn("c", F.coalesce("c", "v"))
        unsettled = named.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least <> most").select("key")
        members = named.join(unsettled, "key", "left_semi")
        if not round_:
            members = members.join(verified, ["v", "leader"], "left").withColumn("d0", F.coalesce("d", F.lit(0.0))).drop("d").join(traits, "v")
        members = written(members, f"{path}/open{round_}", rows)
        if members.isEmpty():
            return roots
        sizes = members.groupBy("key", "c").agg(F.count("*").alias("n"))
        members = members.join(sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main")), "key")
        # of the members outside the largest class, one of each of ``share`` slots leads this round
        slot = F.pmod(F.xxhash64("v"), F.lit(share)).alias("slot")
        leads = members.filter("c <> main").groupBy("key", slot).agg(F.min("v").alias("l_v")).select(F.col("key").alias("l_key"), "l_v")
        traits_of = members.select(F.col("key").alias("l_key"), F.col("v").alias("l_v"), F.col("leader").alias("l_leader"), F.col("d0").alias("e0"), F.col("c").alias("e"), *(F.col(c).alias(f"l_{c}") for c in own))
        leaders = leads.join(traits_of, ["l_key", "l_v"])
        met = members.join(leaders, (F.col("key") == F.col("l_key")) & (F.col("c") != F.col("e")) & near & alike)
        links = linked(verify(met.select(F.greatest("v", "l_v").alias("v"), F.least("v", "l_v").alias("leader")), f"{path}/verified{round_ + 1}"))
        members = members.join(leads.select(F.col("l_key").alias("key"), F.col("l_v").alias("v")), ["key", "v"], "left_anti").drop("c", "main")
        round_, share = round_ + 1, share * 256


def _joined(roots: DataFrame | None, links: DataFrame, path: str) -> DataFrame:
    """``roots`` (v, root) after more links: only what these say of whole classes is worked on."""
    if roots is None:
        return components(links, path)
    if links.isEmpty():
        return roots
    of = lambda c: roots.select(F.col("v").alias(c), F.col("root").alias(f"r_{c}"))
    met = links.join(of("v"), "v", "left").join(of("w"), "w", "left").select(F.coalesce("r_v", "v").alias("v"), F.coalesce("r_w", "w").alias("w"))
    upper = components(met, path)
    known = roots.join(upper.select(F.col("v").alias("root"), F.col("root").alias("far")), "root", "left").select("v", F.coalesce("far", "root").alias("root"))
    return written(known.unionByName(upper.join(roots, "v", "left_anti")), f"{path}/all", roots.count())


def components(links: DataFrame, path: str) -> DataFrame:
    """v, root (smallest member) of everything that a link names, by contraction: in each round every vertex points to its
    smallest neighbour's smallest neighbour, and the links between what they point to go on, until none is left."""
    edges = links.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).filter("a <> b").distinct()
    edges, rounds = written(edges, f"{path}/edges0", links.count()), []
    n = edges.count()
    while n or not rounds:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.*")
        near = both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("p"))
        parents = near.join(near.select(F.col("v").alias("p"), F.col("p").alias("root")), "p").select("v", "root")
        rounds.append(written(parents, f"{path}/parents{len(rounds)}", 2 * n))
        of = lambda c: rounds[-1].select(F.col("v").alias(c), F.col("root").alias(f"r_{c}"))
        met = edges.join(of("a"), "a").join(of("b"), "b").filter("r_a <> r_b")
        edges = written(met.select(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b")).distinct(), f"{path}/edges{len(rounds)}", n)
        n = edges.count()
    n, roots = rounds[0].count(), rounds.pop()
    for earlier in reversed(rounds):
        roots = earlier.join(roots.select(F.col("v").alias("root"), F.col("root").alias("far")), "root", "left").select("v", F.coalesce("far", "root").alias("root"))
    return written(roots, f"{path}/roots", n)


def _named(signed: DataFrame, path: str) -> DataFrame:
    """copy, v, did, th, keys, rests: of each text with words of its own the smallest row that has it, and a number that no
    other has."""
    reps = signed.groupBy("copy").agg(F.min(F.struct("did", "th", "keys", "rests")).alias("r"))
    seed = 0
    while True:
        named = written(reps.select("copy", F.xxhash64(F.lit(seed), "copy").alias("v"), "r.*"), f"{path}/reps{seed}")
        if named.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return named
        seed += 1


def _forest(reps: DataFrame) -> DataFrame:
    """key, v, leader, more of all trees: see ``_neighbours``."""
    rows = reps.select("v", F.explode(F.arrays_zip("keys", "rests")).alias("l")).select(F.col("l.keys").alias("key"), F.col("l.rests").alias("rest"), "v")
    return rows.repartition("key").sortWithinPartitions("key", "rest", "v").mapInArrow(_neighbours, "key bigint, v bigint, leader bigint, more int")


def _judged(docs: DataFrame, recall: float = RECALL, count: bool = True) -> DataFrame:
    """did, th, rep, root, n_links (if asked for) of each row, and kept_did, kept_th: the smallest row of its class."""
    spark = docs.sparkSession
    path = work_dir(spark)
    signed = written(keyed(docs).mapInArrow(_signed(depth_for(recall)), "did bigint, th bigint, copy binary, keys array<bigint>, rests array<bigint>"), f"{path}/signed")
    reps = _named(signed, path)
    members = written(_forest(reps), f"{path}/members").drop("more")
    reps = reps.select("copy", "v", "did", "th")
    ids = signed.select("did", "th", "copy").join(reps.select("copy", F.col("did").alias("rep"), F.col("th").alias("rep_th"), "v"), "copy").drop("copy")
    if members.isEmpty():
        return ids.select("did", "th", "rep", F.col("rep").alias("root"), F.lit(0).cast("bigint").alias("n_links"), F.col("rep").alias("kept_did"), F.col("rep_th").alias("kept_th"))
    wanted = reps.join(members.select("v").distinct(), "v", "left_semi").select("did", "th", "v")
    texts = keyed(docs).join(wanted, ["did", "th"]).select("v", "text").dropDuplicates(["v"])
    sets = written(texts.mapInArrow(_sets, "v bigint, s binary, size int, bits array<bigint>"), f"{path}/sets")
    roots = _roots(members, sets, path)
    smallest = roots.join(reps, "v").groupBy("root").agg(F.min(F.struct("did", "th")).alias("kept"))
    named = roots.join(smallest, "root").select("v", "kept")
    named = named.join(degrees(sets, roots, path), "v") if count else named.withColumn("n", F.lit(0))
    return ids.join(named, "v", "left").select(
        "did", "th", "rep", F.coalesce("kept.did", "rep").alias("root"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("kept.did", "rep").alias("kept_did"), F.coalesce("kept.th", "rep_th").alias("kept_th"),
    )


def linked_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Which sets of ``a`` (rows) and of ``b`` (columns) are at the threshold."""
    sizes = np.array([len(s) for s in [*a, *b]])
    _, col, count = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    several = count > 1
    use = several[col]
    row, col = np.repeat(np.arange(len(sizes)), sizes)[use], (np.cumsum(several) - 1)[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(a), len(b)), np.float32)
    for c in range(0, int(several.sum()), _WIDTH):  # a part of the shingles at a time
        lo, hi = np.searchsorted(col, (c, c + _WIDTH))
        x = np.zeros((len(sizes), _WIDTH), np.float32)
        x[row[lo:hi], col[lo:hi] - c] = 1
        both += x[: len(a)] @ x[len(a) :].T
    return both >= THRESHOLD * (sizes[: len(a), None] + sizes[None, len(a) :] - both) - 1e-3


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, n: links of each text in each meeting of two blocks; the rows of a meeting come one after the other."""

    def meet(rows: list, i: int, j: int) -> pa.RecordBatch:
        a, b = ([r for r in rows if r[1] == k] for k in (i, j))
        sets = [[np.frombuffer(r[2], np.uint64) for r in x] for x in (a, b)]
        ids, n = [], []
        if a and b:
            hit = linked_pairs(*sets)
            ids, n = [r[0] for r in a], hit.sum(1) - (i == j)
            if i != j:
                ids, n = ids + [r[0] for r in b], np.concatenate([n, hit.sum(0)])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["v", "n"])

    at, rows = None, []
    for batch in batches:
        columns = [batch.column(c) for c in ("root", "i", "j", "v", "own", "s")]
        for root, i, j, v, own, s in zip(*columns, strict=True):
            key = root.as_py(), i.as_py(), j.as_py()
            if key != at:
                if rows:
                    yield meet(rows, *at[1:])
                at, rows = key, []
            rows.append((v.as_py(), own.as_py(), s.as_py()))
    if rows:
        yield meet(rows, *at[1:])


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """root, centre: the shingles that more than half of a class's sampled sets have."""
    for batch in batches:
        out = []
        for own in batch.column("sets").to_pylist():
            values, count = np.unique(np.concatenate([np.frombuffer(s, np.uint64) for s in own]), return_counts=True)
            out.append(values[2 * count > len(own)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("root"), pa.array(out, pa.binary())], names=["root", "centre"])


def _unit(seed: int) -> Column:
    """A number in [0, 1) by hash of v."""
    return F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 30)) / (1 << 30)


def _rings(texts: DataFrame, path: str, rows: int) -> DataFrame:
    """v, root, d, own: the texts of large classes (v, s, root, and n, m, w of the class), dealt to blocks by the distance d
    from the centre of their class.

    The centre is any set; that it is the majority of about SAMPLE texts (fewer long ones) makes distances from it small.
    Blocks follow each other by hundredths of d; a fuller hundredth is dealt to several by hash."""
    most = F.least(F.lit(SAMPLE), F.greatest(F.lit(1), SAMPLE_SHINGLES * F.col("n") / F.col("m")))
    sampled = texts.filter(_unit(1) * F.col("n") < most).groupBy("root").agg(F.collect_list("s").alias("sets"))
    centres = written(sampled.mapInArrow(_centres, "root bigint, centre binary"), f"{path}/centres", rows // BLOCK)
    # a class meets its centre in as many parts as it has blocks
    parts = texts.select("root", F.ceil("w").alias("parts")).distinct()
    spread = centres.join(parts, "root").select("root", F.col("centre").alias("t"), F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    both = texts.withColumn("part", F.pmod(F.xxhash64("v"), F.ceil("w")).cast("int")).join(spread, ["root", "part"], "left")
    both = both.select("v", F.col("root").alias("leader"), "s", F.coalesce("t", F.lit(bytearray())).alias("t"))
    far = written(both.mapInArrow(_verified, "v bigint, leader bigint, d double").withColumnRenamed("leader", "root"), f"{path}/far", rows)
    ring = F.floor(F.col("d") * 100).alias("ring")
    per_text = texts.groupBy("root").agg(F.max(F.col("w") / F.col("n")).alias("each"))
    rings = far.groupBy("root", ring).agg(F.count("*").alias("k")).join(per_text, "root").withColumn("share", F.col("k") * F.col("each"))
    before = F.coalesce(F.sum("share").over(Window.partitionBy("root").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rings = rings.select("root", "ring", "share", before.alias("before"))
    own = F.floor(F.col("before") + F.col("share") * _unit(2)).cast("int").alias("own")
    return written(far.withColumn("ring", ring).join(rings, ["root", "ring"]).select("v", "root", "d", own), f"{path}/dealt", rows)


def _certain(dealt: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(v, n: partners that need no comparison; root, i, j: the blocks whose texts must be compared).

    Jaccard distances obey the triangle inequality: two texts are linked if their distances from the centre sum to no more
    than a link's, and are not if these differ by more.  Both are told of whole blocks by their least and greatest."""
    most = 1 - THRESHOLD
    blocks = dealt.groupBy("root", "own").agg(F.count("*").alias("k"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    one = blocks.select("root", *(F.col(c).alias(f"{c}_i") for c in ("own", "k", "lo", "hi")))
    two = blocks.select("root", *(F.col(c).alias(f"{c}_j") for c in ("own", "k", "lo", "hi")))
    apart = F.greatest(F.col("lo_j") - F.col("hi_i"), F.col("lo_i") - F.col("hi_j")) > most + 1e-9
    met = one.join(two, "root").filter((F.col("own_i") <= F.col("own_j")) & ~apart)
    met = written(met.withColumn("sure", F.col("hi_i") + F.col("hi_j") <= most - 1e-9), f"{path}/met")
    sure, same = met.filter("sure"), F.col("own_i") == F.col("own_j")
    sums = sure.select("root", F.col("own_i").alias("own"), (F.col("k_j") - same.cast("int")).alias("n")).unionByName(
        sure.filter(~same).select("root", F.col("own_j").alias("own"), F.col("k_i").alias("n"))
    )
    counted = dealt.join(sums.groupBy("root", "own").agg(F.sum("n").alias("n")), ["root", "own"]).select("v", "n")
    return counted, met.filter("not sure").select("root", F.col("own_i").alias("i"), F.col("own_j").alias("j"))


def degrees(sets: DataFrame, roots: DataFrame, path: str) -> DataFrame:
    """v, n: how many other texts of its class each is linked with."""
    named, rows = sets.select("v", "s", "size").join(roots, "v"), roots.count()
    sizes = named.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("m"))
    sizes = sizes.withColumn("w", F.greatest(F.col("n") / BLOCK, F.col("m") / BLOCK_SHINGLES))
    large = written(sizes.filter("w > 1"), f"{path}/large", rows // BLOCK)
    met = named.join(large, "root", "left_anti").select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), "v", F.lit(0).alias("own"), "s")
    counts = []
    if not large.isEmpty():
        texts = named.drop("size").join(large, "root")
        dealt = _rings(texts, path, rows)
        counted, compared = _certain(dealt, path)
        ends = F.explode(F.array_distinct(F.array("i", "j"))).alias("own")
        open_ = compared.select("root", "i", "j", ends).join(dealt.select("root", "own", "v"), ["root", "own"]).join(sets.select("v", "s"), "v")
        met, counts = met.unionByName(open_.select(*met.columns)), [counted]
    met = met.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    out = met.mapInArrow(_counted, "v bigint, n bigint")
    for n in counts:
        out = out.unionByName(n)
    return out.groupBy("v").agg(F.sum("n").alias("n"))


def classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """did, rep (smallest id with the same words), root (smallest id of its class), n_links (texts with other
    words that its words are linked with) for each row."""
    return _judged(docs, recall).select("did", "rep", "root", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class: the row with the class's smallest id, and of several texts under that id the one with
    the smallest hash; all its columns as they are."""
    kept = _judged(docs, count=False).select(F.col("kept_did").alias("did"), F.col("kept_th").alias("th")).distinct()
    rows = docs.select(F.struct("*").alias("row"), did().alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    rows = rows.join(kept, ["did", "th"], "left_semi").dropDuplicates(["did", "th"])
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return classes(table(spark, sf_dir, "documents")).select(real("did").alias("doc_id"), real("rep").alias("copy_id"), real("root").alias("class_id"), "n_links")
