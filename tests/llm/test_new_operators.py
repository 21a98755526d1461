"""Clustering, mixing and the hash tree against brute force, on small tables with nulls, ties, repeats and odd columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegrid.llm import lloyd, merkle, mixture

VECTORS = "vec_id bigint, embedding array<float>, v string, cluster string, n bigint"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, g string, row string, path string"


def vectors(seed=3, n=90):
    rng = random.Random(seed)
    rows = [[i, [rng.choice([-1.5, -0.25, 0.1, 0.7, 2.0]) + rng.random() for _ in range(64)]] for i in range(n)]
    rows += [[i, list(rows[i][1])] for i in range(4)] + [[1000 + i, list(rows[5][1])] for i in range(6)]
    rows += [[None, list(rows[7][1])], [200, [0.0] * 64], [201, [1e30, -1e30] + [0.0] * 62]]
    bad = [[300, None], [301, []], [302, [0.5] * 63], [303, [None] + [0.5] * 63], [304, [float("nan")] + [0.5] * 63], [305, [math.inf] + [0.5] * 63]]
    return [(*r, "x", "y", 1) for r in rows + bad]


def whole(e):
    m = 2**27
    return [math.floor(min(max(float(np.float32(x)) * 1024, -m), m)) for x in e]


def lloyd_by_hand(rows, k=8, rounds=10):
    kept = [(i, whole(e)) for i, e, *_ in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    for r in range(rounds + 1):
        at = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r == rounds:
            break
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    per = defaultdict(int)
    for d, c in at:
        per[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, per[c], sum(per.values()), name[c]) for (i, _), (d, c) in zip(kept, at))


def op11(df):
    from pyspark.sql import SparkSession

    import casegrid.llm.lloyd as m

    class At:
        def __enter__(self):
            self.old, m.table = m.table, lambda *_: df

        def __exit__(self, *_):
            m.table = self.old

    with At():
        return m.op11_centroid_clustering(SparkSession.active(), "")


@pytest.mark.parametrize("n", [90, 2])
def test_clusters_equal_the_definition(spark, n):
    rows = vectors(n=90) if n == 90 else [(1, [0.5] * 64, "", "", 0), (2, [0.5] * 64, "", "", 0)]
    got = op11(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert Counter(map(tuple, got)) == lloyd_by_hand(rows)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert op11(empty).collect() == []
    assert op11(spark.createDataFrame([(1, None, "", "", 0), (2, [1.0], "", "", 0)], VECTORS)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_a_round_looks_only_at_what_changed():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-50, 50, (300, 5)), rng.integers(-50, 50, (6, 5))
    every = np.ones(6, bool)
    at, d = lloyd.nearest(x, c, every, np.full(300, -1), np.zeros(300, np.int64))
    moved = c.copy()
    moved[[1, 4]] += rng.integers(-40, 40, (2, 5))
    changed = (moved != c).any(1)
    some = lloyd.nearest(x, moved, changed, at, d)
    full = lloyd.nearest(x, moved, every, np.full(300, -1), np.zeros(300, np.int64))
    assert (some[0] == full[0]).all() and (some[1] == full[1]).all()
    assert (at != some[0]).any()


def documents():
    rng = random.Random(9)
    rows, sources = [], ["b", "a", None, "", "é", "zz", "a b"]
    for i in range(260):
        s = "hot" if i % 3 == 0 else rng.choice(sources)
        rows.append((i, " ".join(rng.choice(["Uno", "dos", "TRES", "é€"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", None]), s, rng.choice([5, None]), "g", "r", "p"))
    rows += [rows[3], rows[3], rows[9], (None, "Null id", "en", "a", 1, "g", "r", "p"), (None, "Null id two", None, "a", None, "g", "r", "p"), (999, None, "en", "a", 0, "g", "r", "p")]
    rows += [(1000, "Long Word\t" * 9000, "en", "b", 1, "g", "r", "p"), (1001, "", "en", "only", 0, "g", "r", "p"), (1002, "One", "en", "solo", 3, "g", "r", "p"), (5, "other text, same id", "en", "b", 2, "g", "r", "p")]
    return rows


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, for each leaf its siblings left and right by level)."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for nodes in levels[:-1]:
            run = i // 16 * 16
            path.append((nodes[run:i], nodes[i + 1 : run + 16]))
            i //= 16
        paths.append(path)
    return levels[-1][0], paths


def manifest_by_hand(rows):
    def leaf(r, text):
        vals = (r[0], r[3], r[2], r[4], text)
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, order = [], []
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        order.append(own)
        trees.append(tree([leaf(r, r[1]) for r in own]))
    root, tops = tree([t[0] for t in trees])
    out = Counter()
    for own, (sub, paths), top in zip(order, trees, tops):
        for r, path in zip(own, paths):
            path = path + top
            h = leaf(r, r[1])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                h = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for a, b in path:
                h = digest(*a, h, *b)
            out[(r[0], leaf(r, r[1]), sub, root, digest(*(x for a, b in path for x in a + b)), h, h == root)] += 1
    return out


def op13(spark, df, monkeypatch):
    monkeypatch.setattr(merkle, "table", lambda *_: df)
    return Counter(map(tuple, merkle.op13_merkle_manifest(spark, "").collect()))


@pytest.mark.parametrize("parts", [1, 7])
def test_manifest_equals_the_definition(spark, monkeypatch, parts):
    rows = documents()
    got = op13(spark, spark.createDataFrame(rows, DOCS).repartition(parts), monkeypatch)
    assert got == manifest_by_hand(rows)
    assert {v for *_, v in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark, monkeypatch):
    one = [(7, "Text", "en", None, 4, "g", "r", "p")]
    assert op13(spark, spark.createDataFrame(one, DOCS), monkeypatch) == manifest_by_hand(one)
    assert not op13(spark, spark.createDataFrame([], DOCS), monkeypatch)


def test_ragged_edges_meet():
    """However the leaves are cut into tasks, whole runs and loose nodes together are the tree."""
    leaves = [digest(str(i)) for i in range(700)]
    root, _ = tree(leaves)
    for cuts in ([], [1], [15, 16, 17], [250, 263], [255, 256, 257, 512]):
        rows = []
        for a, b in zip([0, *cuts], [*cuts, 700]):
            build = merkle.Builder()
            for i in range(a, b):
                rows += build.add("g", i, 700, {"id": i, "h": leaves[i], "other": None})
            rows += build.close()
        loose = {(level, c): kids[0]["h"] for level, _, c, _, whole_, kids in rows if not whole_}
        for level in range(merkle.height(700)):
            for c in range(merkle.width(700, level + 1)):
                kids = [loose.get((level, i)) for i in range(16 * c, min(16 * c + 16, merkle.width(700, level)))]
                if all(kids):
                    loose[(level + 1, c)] = digest(*kids)
        assert loose[(merkle.height(700), 0)] == root
        assert len(cuts) > 0 or sum(not r[4] for r in rows) == 1


def targets_by_hand(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        left = Fraction(3, 2) * sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: Fraction(2 * sizes[s]) for s in over}


@pytest.mark.parametrize("block", [1, 7, 512])
def test_mix_meets_its_targets(spark, block):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    spans, docs, sources = mixture.mixed(df, block=block, per_shard=64)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = targets_by_hand(sizes)
    assert {s.name: s.target for s in sources} == want
    got = spans.collect()
    taken = defaultdict(int)
    for s in got:
        taken[s.g] += s.words
    assert {s: taken[mixture.group_key(s)] for s in sizes} == {s: round(t) for s, t in want.items()}
    by_row, size = Counter(), {r.row: r.size for r in docs.collect()}
    for s in got:
        by_row[s.row] += s.words
    assert len(size) == len(rows) and all(n <= 2 * size[r] for r, n in by_row.items())
    # a slot is filled from its start without gaps, and no document gives the same words to one turn twice
    slots = defaultdict(list)
    for s in got:
        slots[s.shard, s.slot].append((s.lo, s.words))
    for runs in slots.values():
        at = 0
        for lo, n in sorted(runs):
            assert lo == at
            at += n
        assert at <= block
    assert max(Counter((s.row, s["at"]) for s in got).values()) <= 2


def test_mix_is_the_same_again_and_renders_its_words(spark, monkeypatch):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(mixture, "table", lambda *_: df)
    one = Counter(map(tuple, mixture.op12_source_mix(spark, "").collect()))
    assert one == Counter(map(tuple, mixture.op12_source_mix(spark, "").collect()))
    assert len(rows) == sum(one.values())
    spans, _, _ = mixture.mixed(df, block=32)
    texts = mixture.rendered(spans, df).collect()
    words = Counter(w for r in texts for w in r.text.split(" "))
    total = Counter()
    of = {(r[0], r[1] or ""): re.findall(mixture.WORD, r[1] or "") for r in rows}
    hashes = {(r.doc_id, r.th): r.text for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()}
    for s in spans.collect():
        total.update(of[s.doc_id, hashes[s.doc_id, s.th]][s["at"] : s["at"] + s.words])
    assert words == total


def test_empty_mix(spark, monkeypatch):
    monkeypatch.setattr(mixture, "table", lambda *_: spark.createDataFrame([], DOCS))
    assert mixture.op12_source_mix(spark, "").collect() == []
    monkeypatch.setattr(mixture, "table", lambda *_: spark.createDataFrame([(1, None, None, None, 1, "", "", "")], DOCS))
    assert [tuple(r) for r in mixture.op12_source_mix(spark, "").collect()] == [(1, 0, 0, 0.0, 0)]


def test_counts_of_shards_meet_the_slots():
    counts = np.array([7, 0, 90, 31])
    every = [mixture.drawn(i, 13, 10, counts) for i in range(13)]
    assert (sum(c for _, c in every) == counts).all()
    assert [int(c.sum()) for _, c in every] == [10] * 12 + [8]
    first = np.zeros(4, int)
    for f, c in every:
        assert (f == first).all()
        first = first + c
    rng = np.random.default_rng(0)
    big = np.array([10**12, 3 * 10**12])
    left = mixture._drawn(rng, big, 10**12)
    assert left.sum() == 10**12 and abs(left[0] / 10**12 - 0.25) < 1e-4


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutations_of_block_numbers(n):
    p = mixture.permuted(np.arange(n), n, mixture._keys(1, "s", 0))
    assert sorted(p.tolist()) == list(range(n))
    assert mixture.permuted(p, n, mixture._keys(1, "s", 0), back=True).tolist() == list(range(n))
