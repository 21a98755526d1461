"""The text operators against brute force, on small tables with nulls, empties, long texts, ties, repeats and odd columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegrid.llm import bpe, chat, decontaminate, line_dedup, ngram_join, quality_classifier, quality_rules, secrets, suffix_dedup, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, did bigint, row string, key string, th string"


def words(rng, n, stems="ka lo mi tu ren sol vid pra nex dor".split()):
    return [rng.choice(stems) + rng.choice(stems) + rng.choice(stems) for _ in range(n)]


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    lines = [" ".join(words(rng, 9)) for _ in range(12)]
    texts = []
    for i in range(n):
        own = [" ".join(words(rng, rng.randint(3, 14))) for _ in range(rng.randint(1, 9))]
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = lines[: 4 + i % 7]
        texts.append("\n".join(own))
    texts += [texts[0], texts[3], texts[3] + " tail", texts[6].replace("ka", "lo", 1), "", "   \n\n ", "a", "ab " * 2000, "x" * 5000, "é€😀 " * 60, "\n" * 300, texts[9] + "\n" + texts[9]]
    rows = [(i, t, "en", "s", len(t), i % 2, "r", "k", "t") for i, t in enumerate(texts)]
    rows += [(None, texts[1], None, None, None, None, None, None, None), (len(rows), None, "en", "s", 0, 1, "r", "k", "t"), rows[5], rows[7]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def order(d):
    return -(2**63) if d is None else d


def _pieces(text):
    """(first line, line after the last, bytes) of the chunks of a text, by their definition."""
    lines = text.split("\n")
    some = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
    out = {(a, b + 1) for a, b in zip(some, some[1:])}
    out |= {(s, s + n) for s, n, level, _ in line_dedup.chunks(text) if level == line_dedup.COARSE}
    return [(a, b, "\n".join(lines[a:b])) for a, b in sorted(out)]


def test_line_dedup(docs):
    rows = corpus()
    texts = {(order(r[0]), r[1] or "") for r in rows}
    first = {}
    for d, t in sorted(texts):
        for _, _, c in _pieces(t):
            first.setdefault(c, d)
    want = defaultdict(int)
    for r in rows:
        t, seen = r[1] or "", set()
        gone = set()
        for a, b, c in _pieces(t):
            if c in seen or first[c] < order(r[0]):
                gone.update(range(a, b))
            seen.add(c)
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        want[(r[0], len(t.split("\n")), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = defaultdict(int)
    for r in line_dedup.deduplicated(docs).select("row.doc_id", "n_lines", "n_removed", F.sha2("r_text", 256).alias("h")).collect():
        got[tuple(r)] += 1
    assert got == want and sum(k[2] for k in want) > 20
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert out.filter("text is null").count() == 1


def test_line_dedup_removes_whole_passages(spark):
    """Passages of two lines and more in foreign surroundings go to the last line, and nothing else does."""
    rng = random.Random(17)
    line = lambda: " ".join(words(rng, rng.randint(6, 15)))
    rows, want = [], {}
    passages = [[line() for _ in range(n)] for n in (2, 2, 3, 4, 6, 9)] + [[line(), "", line(), " ", line()]]
    for i in range(60):
        own = [[line() for _ in range(rng.randint(1, 4))] for _ in range(3)]
        p = passages[i % len(passages)] if i % 2 else []
        rows.append((i, "\n".join([*own[0], *p, *own[1], *own[2]])))
        first = i < 2 * len(passages)
        want[i] = "\n".join([*own[0], *(p if first else []), *own[1], *own[2]])
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want


def test_chunks_resist_shifts():
    rng = random.Random(4)
    lines = [" ".join(words(rng, 6)) for _ in range(60)]
    coarse = lambda x: {k for _, _, level, k in line_dedup.chunks("\n".join(x)) if level == line_dedup.COARSE}
    a, b = coarse(lines), coarse(["new", *lines[:30], "other", *lines[30:]])
    assert len(a) > 5 and len(a & b) >= len(a) - 4


def test_ngram_join(docs):
    rows = corpus()
    sets = {i: set(ngram_join.shingles(r[1] or "").tolist()) for i, r in enumerate(rows)}
    ids = [order(r[0]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = (rows[i][1] or "").split() == (rows[j][1] or "").split()
            if same or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = sorted((find(i), find(j)), key=lambda k: (ids[k], k))
                parent[y] = x
    want = defaultdict(list)
    for i in range(len(rows)):
        want[ids[i]].append(ids[find(i)])
    got = defaultdict(list)
    for r in ngram_join.classes(docs).collect():
        got[r["did"]].append(r["root"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({x for v in want.values() for x in v})


def test_ngram_join_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = words(rng, 120)
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"changed{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(words(rng, 100))) for i in range(20)]
    out = {r["did"]: r["root"] for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(out[i] == 0 for i in range(150)) and all(out[1000 + i] == 1000 + i for i in range(20))


def test_forest_shortens_prefixes_by_text():
    """Each row's leader is the smallest before it in its deepest node, wherever batches end; the depth varies by row."""
    import pyarrow as pa

    rng = random.Random(21)
    rows = []
    for key in range(40):
        for _ in range(rng.choice((1, 1, 2, 5, 30))):
            rest = 0
            for _ in range(4):
                rest = rest << 16 | rng.choice((1, 1, 1, 40000))
            rows.append((key, rest - (1 << 64) if rest >> 63 else rest, rng.randrange(-(2**62), 2**62)))
    rows.sort()
    chars = lambda r: [(r[1] >> k) & 0xFFFF for k in (48, 32, 16, 0)]
    want = set()
    for i, r in enumerate(rows):
        own = [q for q in rows[:i] if q[0] == r[0]]
        if own:
            shared = [next((k for k in range(4) if chars(q)[k] != chars(r)[k]), 4) for q in own]
            want.add((r[0], r[2], min(q[2] for q, n in zip(own, shared) if n == max(shared)), max(shared)))
        elif i + 1 < len(rows) and rows[i + 1][0] == r[0]:
            want.add((r[0], r[2], r[2], 0))
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + size])], names=["key", "rest", "v"]) for a in range(0, len(rows), size)]
        got = [tuple(x.values()) for b in ngram_join._neighbours(iter(batches)) for x in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want, size
    assert {w[3] for w in want} == {0, 1, 2, 3, 4}


def test_components(spark, tmp_path):
    rng = random.Random(22)
    links = [(i, i + 1) for i in range(100, 160)] + [(1000, 2000 + i) for i in range(50)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)]
    parent = {v: v for e in links for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for v, w in links:
        a, b = sorted((find(v), find(w)))
        parent[b] = a
    got = ngram_join.components(spark.createDataFrame([e for e in links if e[0] != e[1]], "v bigint, w bigint"), f"file://{tmp_path}").collect()
    assert {r["v"]: r["root"] for r in got} == {v: find(v) for e in links if e[0] != e[1] for v in e} and len(got) == len({r["v"] for r in got})


def test_ngram_join_counts_every_link(spark, monkeypatch):
    rng = random.Random(3)
    base, rows = words(rng, 120), []
    for i in range(90):
        w = list(base)
        for _ in range(1 + i % 3):
            w[rng.randrange(120)] = f"changed{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(words(rng, 80))) for i in range(10)] + [(300, rows[0][1]), (301, rows[1][1] + " tail")]
    sets = {t: set(ngram_join.shingles(t).tolist()) for _, t in rows}
    want = {d: sum(t != u and len(sets[t] & s) >= 0.8 * len(sets[t] | s) for u, s in sets.items()) for d, t in rows}
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["did"]: r["n_links"] for r in ngram_join.classes(d).collect()} == want and len(set(want.values())) > 5
    for block, sample in ((20, 64), (7, 3)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "SAMPLE", sample)
        assert {r["did"]: r["n_links"] for r in ngram_join.classes(d).collect()} == want


def test_ngram_join_counts_near_copies_without_comparing_them(spark, monkeypatch, tmp_path):
    rng = random.Random(31)
    base, rows = words(rng, 200), []
    for i in range(400):
        w = list(base)
        for _ in range(i % 3):
            w[rng.randrange(200)] = f"changed{rng.randrange(10**6)}"
        if i % 40 == 0:  # far from the centre: linked with some only
            w[:7] = [f"far{i}x{k}" for k in range(7)]
            w[30 + i % 80] = w[90] = f"more{i}"
        rows.append((i, ngram_join.shingles(" ".join(w)), 0))
    rows = list({s.tobytes(): (v, s, r) for v, s, r in rows}.values())
    monkeypatch.setattr(ngram_join, "BLOCK", 50)
    table = spark.createDataFrame([(v, s.tobytes(), len(s)) for v, s, _ in rows], "v bigint, s binary, size int")
    roots = spark.createDataFrame([(v, r) for v, _, r in rows], "v bigint, root bigint")
    want = {v: sum(v != w and ngram_join.jaccard(s, t) >= 0.8 for w, t, _ in rows) for v, s, _ in rows}
    assert {r["v"]: r["n"] for r in ngram_join.degrees(table, roots, str(tmp_path / "all")).collect()} == want
    assert len(set(want.values())) > 3
    near = [(v, s) for v, s, _ in rows if v % 40]
    table = spark.createDataFrame([(v, s.tobytes(), len(s)) for v, s in near], "v bigint, s binary, size int")
    whole = {"root": F.lit(0).cast("bigint"), "n": F.lit(len(near)), "m": F.lit(sum(len(s) for _, s in near)), "w": F.lit(len(near) / 50)}
    dealt = ngram_join._rings(table.withColumns(whole), str(tmp_path / "near"), len(near))
    counted, compared = ngram_join._certain(dealt, str(tmp_path / "near"))
    assert compared.isEmpty() and counted.count() == len(near)
    assert {r["v"]: r["n"] for r in counted.collect()} == {v: len(near) - 1 for v, _ in near}


def test_ngram_join_texts_that_share_an_id(spark):
    rng = random.Random(12)
    texts = [" ".join(words(rng, 60)) for _ in range(9)]
    near = " ".join([*texts[4].split()[:-1], "changed"])
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:8]] + [(8, near), (None, texts[0]), (7, texts[4]), (9, texts[8])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = ngram_join.keep_one(d).collect()
    assert len(kept) == 9 and {r["text"] for r in kept} == set(texts)
    null = ngram_join.NULL_ID
    got = sorted((r["did"], r["root"], r["n_links"]) for r in ngram_join.classes(d).collect())
    assert got == sorted([(null, null, 0)] * 5 + [(7, 7, 1)] * 2 + [(7, 7, 0)] * 3 + [(8, 7, 1), (9, 9, 0)])


def test_suffix_dedup(docs):
    rows = corpus()
    seen, want = set(), {}
    for d, t in sorted({(order(r[0]), r[1] or "") for r in rows}):
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want[d] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    got = suffix_dedup.deduplicated(docs).drop("kept").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[order(r["doc_id"])], r["doc_id"]


@pytest.mark.parametrize("room", (150, 1500, 20_000))
def test_suffix_dedup_crowded_minimizer(spark, monkeypatch, room):
    """With little room in memory contexts are dealt out by their parts, and these by windows; the result is the same."""
    rng = random.Random(43)
    line = " ".join(words(rng, 18))
    rows = [(r[0], r[1]) for r in corpus(5, 25) if r[0] is not None]
    rows += [(3000 + i, " ".join([*words(rng, rng.randint(0, 12)), line[rng.randint(0, 20) :], *words(rng, rng.randint(0, 12))])) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    usual = sorted(map(tuple, suffix_dedup.deduplicated(d).drop("kept").collect()))

    def small(batches, f=suffix_dedup._repeats, room=room):
        from casegrid.llm import suffix_dedup as m

        m.IN_MEMORY = room
        yield from f(batches)

    monkeypatch.setattr(suffix_dedup, "_repeats", small)
    assert sorted(map(tuple, suffix_dedup.deduplicated(d).drop("kept").collect())) == usual


def test_halves():
    """Each window is in one part, and all windows of a part hold what they share, at one distance from the minimizer."""
    rng = random.Random(47)
    for unit in ("abcdefgh ", "ab", "x"):
        raw = "".join(rng.choice(unit) for _ in range(600)).encode() + b"ab" * 80
        for a, b, *_ in zip(*suffix_dedup.minimizer_runs(raw), strict=True):
            context, seen = raw[a : b + 99], []
            for o, part, shared in suffix_dedup.halves(context):
                assert context[o : o + len(part)] == part and len(shared) in (60, 61)
                seen += range(o, o + len(part) - 99)
                assert all(shared in part[k : k + 100] for k in range(len(part) - 99))
            assert seen == list(range(b - a))


def test_suffix_dedup_shared_runs():
    """Which runs are repeats, and which go on, wherever batches end."""
    import pyarrow as pa

    rng = random.Random(29)
    rows = sorted((rng.randrange(25), rng.randrange(3), rng.randrange(6), rng.randrange(4) << 32 | rng.randrange(3), 40 << 2 | (rng.random() < 0.1) * suffix_dedup._TWICE) for _ in range(160))
    rows = sorted([*rows, *rng.sample(rows, 12), *((1000 + i, 5, 1, i, 8 << 2 | suffix_dedup._KNOWN) for i in range(5))])
    want, contexts = set(), defaultdict(set)
    for k, c, *_ in rows:
        contexts[k].add(c)
    for i, (k, c, d, at, span) in enumerate(rows):
        before = [r for r in rows[:i] if r[:2] == (k, c)]
        if span & suffix_dedup._KNOWN or any(r[2:4] != (d, at) for r in before):
            want.add((d, at, k, span, True))
        elif not before and (len(contexts[k]) > 1 or span & suffix_dedup._TWICE):
            want.add((d, at, k, span, False))
    names = ["key", "context", "did", "at", "span"]
    for size in (1, 3, 50, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + size])], names=names) for a in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in suffix_dedup._shared(iter(batches)) for r in b.to_pylist()]
        assert set(got) == want, size


def test_suffix_dedup_of_random_repeats(spark):
    """Passages cut anywhere, periodic text, texts of one id, no ids and exact copies, byte by byte."""
    rng = random.Random(37)
    base = ["".join(rng.choice("abcd \n") for _ in range(rng.randint(90, 400))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 150)))]
        for _ in range(rng.randint(0, 3)):
            b = rng.choice(base)
            a = rng.randrange(len(b) // 2)
            parts += [b[a : a + rng.randint(50, len(b))], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 40)))]
        if i % 17 == 0:
            parts.append(rng.choice(("ab", "q", "xyz12")) * rng.randint(60, 200))
        rows.append((rng.choice((None, 7, i, i)), "".join(parts)))
    rows += rng.sample(rows, 10) + [(2000, rows[3][1])]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    rank = {(r["doc_id"], r["text"]): (r["did"], r["th"]) for r in suffix_dedup.keyed(texts).collect()}
    seen, want = set(), {}
    for d, t in sorted(set(rows), key=lambda r: rank[r]):
        raw, gone = t.encode(), bytearray(len(t.encode()))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want[d, t] = (d, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    got = [tuple(r) for r in suffix_dedup.deduplicated(texts.repartition(5)).drop("kept").collect()]
    assert sorted(map(str, got)) == sorted(str(want[r]) for r in rows)


def test_deep_shallow_sorting():
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab") for _ in range(400))
    windows = [base[i : i + 100] for i in (rng.randrange(40) for _ in range(300))] + [bytes([rng.randrange(256)]) * 100 for _ in range(50)]
    first = {}
    want = [first.setdefault(w, i) for i, w in enumerate(windows)]
    assert suffix_dedup.deep_shallow(b"".join(windows), np.arange(len(windows)) * 100).tolist() == want
    assert suffix_dedup.deep_shallow(b"".join(windows), np.arange(len(windows)) * 100, [range(300), range(300, 350)]).tolist() == want


@pytest.fixture(scope="module")
def library():
    """The tiktoken library over the same ranks: what the encoder is held against."""
    import base64

    import tiktoken

    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_bpe_merges(library):
    enc, rng = bpe.encoder(bpe.default_ranks(), bpe.default_pattern()), random.Random(19)
    for _ in range(400):
        s = "".join(rng.choice("abetins xé😀#=0") for _ in range(rng.randint(1, 60)))
        assert bpe.merge(s.encode(), enc.ranks) == library._encode_single_piece(s.encode())
    for s in ("x" * 7000, "ab" * 3000, "aAbB9+/" * 900, "\n" * 999):
        assert bpe.merge(s.encode(), enc.ranks) == library._encode_single_piece(s.encode())


def test_bpe(docs, library):
    rows = corpus()
    want = sorted((str(r[0]), len(ids := library.encode_ordinary(r[1] or "")), " ".join(map(str, ids)), (r[1] or "").encode()) for r in rows)
    got = sorted((str(r[0]), r[1], r[2], bytes(r[3])) for r in bpe.encode(docs).collect())
    assert got == want


def test_bpe_long_texts_are_stitched(spark, library):
    enc = bpe.encoder(bpe.default_ranks(), bpe.default_pattern())
    rng = random.Random(5)
    text = " ".join(words(rng, 9000)) + "y" * 3000 + " " * 2500 + "\n\n don't 12345 é€😀" * 3000
    for chunk in (700, 5000, 1 << 16):
        starts = bpe.chunk_starts(len(text), chunk)
        got = bpe.stitched(enc, text, [bpe.chunk_ends(enc, text, s, chunk) for s in starts], chunk)
        assert got == enc.ends(text)
    rows = [(1, text), (1, text), (2, text + "z"), (3, "w" * 100_000 + " end"), (None, "é" * 40_000)]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        t = dict(rows)[r["doc_id"]]
        assert r["ids"] == " ".join(map(str, library.encode_ordinary(t))) and bytes(r["decoded"]) == t.encode()


def test_secrets(spark):
    text = "é Password = 'abcdefgh1' token: short api_key=\"ZZZZ.9999\" AKIAABCDEFGHIJKL AKIA1 " + "0123456789abcdef" * 2 + " kJ8s_Qp2LmX9vRtY7wZa3BcD"
    row = secrets.scan_secrets(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert (row[0]["n_assign"], row[0]["n_access"], row[0]["n_hex"]) == (2, 1, 1)
    spans = [s.split(":") for s in row[0]["spans"].split(",")]
    assert [s[0] for s in spans] == ["assign", "assign", "access", "hex", "entropy"]
    assert text[int(spans[0][1]) : int(spans[0][2])] == "Password = 'abcdefgh1"
    base = ",".join(":".join(s) for s in spans[:4])
    assert row[0]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert row[1]["spans"] == row[2]["spans"] == "" and row[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_secrets_entropy_counts():
    import math

    rng = random.Random(1)
    s = "".join(rng.choice("abcdefXYZ0189") for _ in range(80))
    for i, e in enumerate(secrets.entropies(s)):
        w = s[i : i + secrets.WINDOW]
        assert abs(e + sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))) < 1e-9


def test_secrets_leave_plain_words_alone():
    t = "an-ordinary-hyphenated-compound 2026-01-02-03-04-05-06-07 https://example.org/a1B2c3D4e5F6g7H8i9J0 123e4567-e89b-12d3-a456-426614174000 ======================"
    assert secrets.entropy_spans(t, []) == []


def test_secrets_after_urls_and_of_every_class():
    key = "kJ8s_Qp2LmX9vRtY7wZa3BcD"
    around = ("see https://host/x\n{}", '{{"u":"https://host/x","k":"{}"}}', "https://host/x,{}", "https://host/x\t{}", "https://host/x?sig={}", "https://host/x#{}", "https://user:{}@host/x", "https://{}@host/x")
    for form in around:
        text = form.format(key)
        (a, _, b), = secrets.entropy_spans(text, [])
        assert a <= text.index(key) + 1 and b >= text.index(key) + len(key) - 1, form
    rng = random.Random(4)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        keys = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(50)]
        assert sum(bool(secrets.entropy_spans(k, [])) for k in keys) >= 40, letters
    plain = "getUserNameFromDatabaseConnection internationalization/of/ordinary-words https://host.org/" + key + "/x https://me@host.org/" + key
    assert secrets.entropy_spans(plain, []) == []


def test_secrets_after_long_urls_and_beside_base_spans():
    key = "kJ8s_Qp2LmX9vRtY7wZa3BcD"
    for n in (10, 400, 5000):
        text = f"https://x.org/?{'a.' * n}&k={key}"
        assert [text[a:b] for a, _, b in secrets.entropy_spans(text, secrets.base_spans(text))] == [f"k={key}"], n
        hidden = f"https://x.org/{'a.' * n}/{key}"
        assert secrets.entropy_spans(hidden, []) == []
    joined = "0123456789abcdef" * 2 + "-" + key  # one run of characters, of which the first part is a hex span
    base = secrets.base_spans(joined)
    assert [joined[a:b] for a, _, b in base] == ["0123456789abcdef" * 2]
    (a, _, b), = secrets.entropy_spans(joined, base)
    assert a >= 32 and joined[a:b].endswith(key)


def test_secrets_by_brute_force(spark):
    """The whole result against a scan position by position, which shares neither patterns nor tables with the operator."""
    import math
    import string

    low, up, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    often = dict(zip(low, (80, 15, 28, 43, 127, 22, 20, 55, 70, 3, 10, 40, 25, 70, 72, 20, 3, 62, 64, 85, 32, 10, 20, 3, 15, 5), strict=True))

    def run_from(t, i, of):
        j = i
        while j < len(t) and t[j] in of:
            j += 1
        return j

    def assign(t, i):
        for key in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if t[i : i + len(key)].lower() != key:
                continue
            j = i + len(key)
            j += t[j : j + 1] in ("'", '"') and j < len(t)
            j = run_from(t, j, " ")
            if t[j : j + 1] not in (":", "=") or j >= len(t):
                continue
            j = run_from(t, j + 1, " ")
            j += t[j : j + 1] in ("'", '"') and j < len(t)
            end = run_from(t, j, low + up + digits + "+/_.=-")
            if end > j:
                return end, end - j >= 8
        return None

    def base(t):
        out, i = [], 0
        while i < len(t):
            got = assign(t, i)
            if got and got[1]:
                out.append((i, 0, got[0]))
            i = got[0] if got else i + 1
        for kind, head, of, least in ((1, "AKIA", up + digits, 16), (2, "", digits + "abcdef", 32)):
            i = 0
            while i < len(t):
                end = run_from(t, i + len(head), of) if t.startswith(head, i) else i
                if end > i + len(head):
                    if end - i >= least:
                        out.append((i, kind, end))
                    i = end
                else:
                    i += 1
        return sorted(out)

    def plain(s):
        parts = s.replace("_", "-").replace("/", "-").strip("-").split("-")
        parts = [p for p in parts if p]
        for p in parts:
            if p.isdigit() and len(p) <= 4:
                continue
            w = p.rstrip(digits)
            if not w.isalpha() or len(p) - len(w) > 3:
                return False
            # capitals begin the word or stand before small letters; a run of capitals comes first only
            runs = "".join("U" if c in up else "l" for c in w)
            head = len(runs) - len(runs.lstrip("U"))
            if any(runs[i] == "U" and (i + 1 == len(runs) or runs[i + 1] == "U") for i in range(head, len(runs))):
                return False
        return bool(parts) and math.prod(often[c.lower()] * 26 / sum(often.values()) for c in s if c.isalpha()) >= 1 - 1e-9

    def level(s):
        if all(c in digits for c in s):
            return 2.7
        if all(c in digits + "abcdef" for c in s) or all(c in digits + "ABCDEF" for c in s):
            return 3.07
        if all(c in low for c in s) or all(c in up for c in s):
            return 3.32
        return 3.45 if all(c in low + digits for c in s) or all(c in up + digits for c in s) else 3.62

    def entropy(t, taken):
        covered = {i for a, _, b in taken for i in range(a, b)}
        out, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and j not in covered and t[j] in low + up + digits + "+/_=-":
                j += 1
            s = t[i:j]
            if len(s) >= 16 and not plain(s) and not (s.replace("-", "").isdigit() and "-" in s and all(0 < len(p) < 9 for p in s.split("-"))):
                bits = [-sum(w.count(c) / 16 * math.log2(w.count(c) / 16) for c in set(w)) for w in (s[k : k + 16] for k in range(len(s) - 15))]
                high = [k for k, e in enumerate(bits) if e >= level(s) - 1e-12]
                if high:
                    out.append((i + high[0], 3, i + high[-1] + 16))
            i = max(j, i + 1)
        return out

    rng = random.Random(23)
    letters = ("abc", digits, low, up, digits + "abcdef", low + digits, low + up, low + up + digits + "+/", low + "-_/")
    some = lambda a, b: "".join(rng.choice(of) for of in [rng.choice(letters)] for _ in range(rng.randint(a, b)))
    heads = ("password", "Secret", "api_KEY = ", "tokentoken:", "passwd='", "apikey\": \"", "AKIA", "AKIAAKIA", "2026-01-02-03-04-05", "secret=token=", "dist-packages", "toLowerCaseLetters2", "deadbeef", "-", "_of_the_", "x2-", " ", " é ")
    texts = ["".join(rng.choice((rng.choice(heads), some(1, 40), some(14, 70), " ")) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    kinds = ("assign", "access", "hex", "entropy")
    show = lambda spans: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
    for i, t in enumerate(texts):
        b, r = base(t), got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in b) for k in range(3)), t
        assert r["base_sha256"] == hashlib.sha256(show(b).encode()).hexdigest(), t
        assert r["spans"] == show(b + entropy(t, b)), t
    assert sum("entropy" in r["spans"] for r in got.values()) > 100


def test_secrets_miss_few_and_leave_names_alone():
    """Of random strings of 24 characters at most 5 % are missed, whatever their class; long words and identifiers stay."""
    import string

    rng = random.Random(5)
    low, up, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    for of in (digits + "abcdef", low, up, digits, low + digits, low + up, low + up + digits, low + up + digits + "+/"):
        keys = ["".join(rng.choice(of) for _ in range(24)) for _ in range(1500)]
        assert sum(not secrets.entropy_spans(k, []) for k in keys) <= 75, of
    names = "/usr/local/lib/python3/dist-packages/module2 my_long_variable_name_v2_final_copy3 disproportionately anticonstitutionnellement Donaudampfschifffahrtsgesellschaft"
    assert secrets.entropy_spans(names, []) == []
    assert secrets.entropy_spans("a" * 200_000 + "-" + "bc" * 200_000, []) == []


def test_quality_rule_statistics():
    t = "a b c a b c\n\x0bx #$\n\nx #$\n\n a b"
    n, chars, symbols, dups, rep = quality_rules.statistics(t)
    w = t.encode().split()
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    assert (n, symbols, rep) == (len(w), 4, len(covered)) and chars == sum(len(x.decode()) for x in w)
    assert dups == 0 and quality_rules.statistics("x y\nz\nx y\n\n\n")[3] == 1
    assert quality_rules.statistics("") == (0, 0, 0, 0, 0)


def test_quality_rules_reject_outliers(spark):
    """Symbols, repeated lines and repeated words by themselves; long clean texts stay; odd columns are ignored."""
    rng = random.Random(8)
    text = lambda n: " ".join(words(rng, n))
    rows = [(i, text(rng.randint(80, 300)), "en", "s") for i in range(250)] + [(900 + i, text(6000), "en", "s") for i in range(3)]
    rows += [(1000 + i, " ".join(w + "#$%&" for w in words(rng, 150)), "en", "s") for i in range(8)]
    line = text(4)
    rows += [(1100 + i, "\n".join([*(text(4) for _ in range(25)), *[line] * 12]), "en", "s") for i in range(8)]
    phrase = text(5)
    rows += [(1200 + i, " ".join([*words(rng, 110), *[phrase] * 10]), "en", "s") for i in range(8)]
    rows += [(2000, None, None, None), (2001, "too short", "en", "s"), (2002, "a b c " * 60, "xx", None), rows[0]]
    rows += [(3000 + i, text(100), "", "") for i in range(3)] + [(3100 + i, text(100), None, None) for i in range(3)]
    odd = ("g", "d2", "start", "bin", "mean", "x0", "n", "kept")
    docs = spark.createDataFrame([(*r, *range(len(odd))) for r in rows], "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{c} int" for c in odd))
    got = quality_rules.judge(docs).collect()
    out = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and [r["kept"] for r in got if r["doc_id"] == 0] in ([True] * 2, [False] * 2)
    assert sum(out[i]["kept"] for i in range(250)) >= 246 and all(out[900 + i]["kept"] for i in range(3))
    assert not any(out[k + i]["kept"] for k in (1000, 1100, 1200) for i in range(8))
    assert out[2000]["base_failed"] and out[2001]["base_failed"] and out[2002]["base_failed"]


def test_quality_rules_kept_by_brute_force(spark):
    """One group: every verdict against an exact search (sorted distances, random starts) over statistics counted anew.  Rows whose
    distance is within a tenth of the cut-off are left open, as the operator's C-steps and the search may stop at different subsets."""
    rng = random.Random(12)
    texts = [" ".join(words(rng, rng.randint(50, 400))) for _ in range(220)]
    texts += [t + " " + " ".join(t.split()[: rng.randint(3, 20)]) for t in texts[:30]]
    texts += ["\n".join([t, *["one line more"] * rng.randint(1, 12)]) for t in texts[30:50]]
    texts += [" ".join(w + rng.choice(("", "#", "$%")) for w in t.split()) for t in texts[50:75]] + [texts[0]] * 3
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")).collect()}

    def counts(t):
        w, seen, dups, covered = t.split(), set(), 0, set()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {g for g, c in Counter(grams).items() if c > 1}
        for i, g in enumerate(grams):
            covered |= {i, i + 1, i + 2} if g in again else set()
        for line in t.split("\n"):
            dups += line in seen and bool(line.strip())
            seen.add(line)
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dups, len(covered)

    n, c, sy, du, re_ = np.array([counts(t) for t in texts], float).T
    fine = (n >= 50) & (100 * re_ <= 50 * n)
    x = np.stack([n**-0.5, np.log((c + 1) / n), np.sqrt(sy / c), np.sqrt(du / n), np.sqrt(re_ / n)], 1)
    noise = np.stack([1 / (4 * n * n), 1 / c, 1 / (4 * c), 1 / (4 * n), 6 / (4 * n)], 1)

    def model(of, scale):
        return x[of].mean(0), scale * np.cov(x[of].T, bias=True) + np.diag(noise[of].mean(0) + 1e-9)

    def far(mean, cov):
        d = x - mean
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    passed, best = np.flatnonzero(fine), None
    draw = np.random.default_rng(0)
    for _ in range(30):
        of = draw.choice(passed, 40, replace=False)
        for _ in range(60):
            of = passed[np.argsort(far(*model(of, 1.412))[passed])[: int(0.75 * len(passed))]]
        det = np.linalg.slogdet(model(of, 1.412)[1])[1]
        best = min(best or (det, of), (det, of), key=lambda b: b[0])
    d2 = far(*model(best[1], 1.412))
    d2 = far(*model(passed[d2[passed] <= 12.833], quality_rules.consistency(0.975)))
    open_ = 0
    for i in range(len(texts)):
        assert got[i]["base_failed"] == (not fine[i])
        if fine[i] and abs(d2[i] / 20.515 - 1) < 0.1:
            open_ += 1
        else:
            assert got[i]["kept"] == bool(fine[i] and d2[i] <= 20.515), (i, d2[i], got[i]["distance2"])
    assert open_ <= 10 and 20 < sum(not r["kept"] for r in got.values()) < 90


def test_quality_rules_lean_on_their_language(spark):
    """Sums of the nearest share, to the fraction of a bin's rows, and the rows of the prior, against plain arithmetic; one more
    row in a group changes its estimate by little."""
    rng, k = np.random.default_rng(6), len(quality_rules.DIMS)
    sizes = {("a", "p"): 400, ("b", "p"): 3, ("c", "q"): 99, ("d", "q"): 100}
    x = {g: rng.normal(i, 1, (n, k)) for i, (g, n) in enumerate(sizes.items())}
    rows = spark.createDataFrame([(g, p, "s", int(i), *map(float, r)) for (g, p), m in x.items() for i, r in enumerate(m // 0.01 * 0.01)], "g string, parent string, start string, bin bigint, " + ", ".join(f"{d} double" for d in quality_rules.DIMS))
    rows = rows.withColumn("bin", F.floor(F.col("bin") / 7)).select("*", *(F.lit(0.5).alias(e) for e in quality_rules.NOISE))
    binned = rows.groupBy("g", "parent", "start", "bin").agg(*quality_rules._sums())
    got = {r["g"]: np.array(r["mean"]) for r in quality_rules._trimmed(binned, 0.75, 1.0).collect()}
    sums = {}
    for key, m in x.items():
        weight, left = np.zeros(len(m)), 0.75 * len(m)
        for b in range(0, len(m), 7):
            weight[b : b + 7] = min(1.0, left / len(m[b : b + 7]))
            left -= weight[b : b + 7].sum()
        sums[key] = (weight.sum(), weight @ (m // 0.01 * 0.01))
    total = (sum(n for n, _ in sums.values()), sum(s for _, s in sums.values()))
    for (g, p), (n, s) in sums.items():
        ln, ls = sum(a for (_, q), (a, _) in sums.items() if q == p), sum(b for (_, q), (_, b) in sums.items() if q == p)
        prior = (ls + 100 * total[1] / total[0]) / (ln + 100)
        assert np.allclose(got[g], (s + 100 * prior) / (n + 100)), g


def test_minimum_covariance_determinant(spark, tmp_path):
    """A fifth of far rows does not move the estimate, and no random start of an exact search finds a much smaller determinant."""
    rng = np.random.default_rng(3)
    k = len(quality_rules.DIMS)
    mix = np.tril(rng.normal(0, 0.3, (k, k))) + np.eye(k)
    clean = rng.normal(size=(400, k)) @ mix.T + 5
    x = np.concatenate([clean, rng.normal(12, 0.3, (100, k))])
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{d} double" for d in quality_rules.DIMS)).repartition(3)
    m = quality_rules.mcd(rows, f"file://{tmp_path}").first()
    mean, inverse = np.array(m["mean"]), np.array(m["inverse"]).reshape(k, k)
    assert np.abs(mean - clean.mean(0)).max() < 0.25
    d = x - mean
    far = np.einsum("ij,jk,ik->i", d, inverse, d) > quality_rules.chi_square(0.999)
    assert far[400:].all() and far[:400].mean() < 0.02

    def search(start):
        for _ in range(50):
            mu, cov = start.mean(0), np.cov(start.T, bias=True)
            e = x - mu
            start = x[np.argsort(np.einsum("ij,jk,ik->i", e, np.linalg.inv(cov), e))[: int(quality_rules.H * len(x)) + 1]]
        return np.linalg.slogdet(np.cov(start.T, bias=True))[1]

    best = min(search(x[rng.choice(len(x), 30, replace=False)]) for _ in range(30))
    trimmed = spark.read.parquet(f"file://{tmp_path}/model2").collect()
    assert min(r["logdet"] for r in trimmed) - k * np.log(quality_rules.consistency(quality_rules.H)) < best + 0.1


def test_chi_square():
    for p, want in ((0.5, 4.351), (0.975, 12.833), (0.999, 20.515)):
        assert abs(quality_rules.chi_square(p) - want) < 1e-3
    assert abs(quality_rules.consistency(0.75) - 1.412) < 1e-2


def _labelled(spark, seed=0):
    rng = random.Random(seed)
    bad = ["zorgle", "blixer", "quonk"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = words(rng, rng.randint(30, 120))
        if toxic:
            for k in range(4):
                w[rng.randrange(len(w))] = rng.choice(bad)
        good = i % 3 != 0
        text = " ".join(w).capitalize() + "." if good else " | ".join(x + "###" for x in w)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    rows += [(9001, None), (9002, ""), (None, "some text")]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = _labelled(spark)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all((got[i]["score"] >= 0.3) == (i % 5 == 0) for i in held)
    assert 0 <= got[9001]["score"] < 0.3 and got[9001]["score"] == got[9002]["score"]
    assert all(got[i]["segments"] for i in held if i % 5 == 0)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 600 - 120 + 3
    empty = toxicity.fit(docs, labels.limit(0))
    assert all(r["score"] < 1e-9 for r in toxicity.score(docs, empty).collect())


def test_maximal_segments():
    """All of them, against the definition: the best segment, then the same left and right of it."""

    def want(s, a, b):
        best = max(((round(sum(s[i:j]), 9), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        return want(s, a, best[2]) + [best[2:]] + want(s, best[3], b)

    rng = random.Random(6)
    for _ in range(150):
        s = [rng.choice((-1.0, -1.0, -1.0, rng.uniform(0.2, 3))) for _ in range(25)]
        got = toxicity.maximal_segments([(i, x) for i, x in enumerate(s) if x > 0], -1.0)
        assert sorted((a, b) for a, b, _ in got) == want(s, 0, 25)
        assert all(abs(sum(s[a:b]) - x) < 1e-9 for a, b, x in got)


def test_maximal_segments_take_linear_time():
    import time

    for hits in ([(3 * i, 0.5) for i in range(200_000)], [(2 * i, 1.5) for i in range(200_000)], [(i, 1.0 + i % 7) for i in range(200_000)]):
        began = time.process_time()
        assert toxicity.maximal_segments(hits, -1.0)
        assert time.process_time() - began < 3


def test_quality_classifier(spark):
    docs, labels = _labelled(spark, 1)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == (i % 3 != 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and 9001 in got and None in got
    flat = quality_classifier.score(docs, quality_classifier.fit(docs, labels.limit(0))).select("score").distinct().collect()
    assert [r[0] for r in flat] == [0.5]


def test_isotonic():
    import numpy as np

    x, y = quality_classifier.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.5]), np.ones(6))
    assert all(np.diff(y) > 0) and all(np.diff(x) > 0)


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, 15 + 3 * i)).capitalize() + ". " + " ".join(words(rng, 6)) + ".") for i in range(14)] + [(99, ""), (98, None)]
    rows = [(i, " ".join(words(rng, rng.randint(5, 300)))) for i in range(120)]
    for i in range(14):
        w = rows[i][1].split()
        rows[i] = (i, " ".join([*w[: len(w) // 2], items[i][1], *w[len(w) // 2 :]]))
    reworded = items[12][1].split()
    for k in range(5, len(reworded) - 8, 7):
        reworded[k] = "otherword"
    rows += [(500, " ".join(words(rng, 40) + reworded + words(rng, 40))), (501, None), (502, ""), (503, "short"), (None, items[13][1])]
    docs, benchmark = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(docs, benchmark).collect()}
    assert all(got[i] == [i] for i in range(14)) and got[500] == [12] and got[None] == [13]
    assert not any(got[i] for i in [*range(14, 120), 501, 502, 503])
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 16
    assert decontaminate.drop_contaminated(docs, benchmark.limit(0)).count() == len(rows)


def _latent(rng, items):
    import numpy as np

    space = decontaminate._with_zero(np.random.default_rng(1).normal(size=(decontaminate.TERMS, decontaminate.RANK)).astype(np.float32))
    return space, decontaminate.prepared(items, space)


def test_decontamination_finds_rewordings_and_short_items():
    rng = random.Random(13)
    around = lambda w: " ".join([*words(rng, 37), *w, *words(rng, 45)])
    for n, share in ((6, 1), (8, 1), (11, 1), (40, 0.8), (40, 0.72), (59, 0.7)):
        items = [(i, " ".join(words(rng, n))) for i in range(40)]
        texts = []
        for _, t in items:
            w = t.split()
            for k in rng.sample(range(n), int((1 - share) * n + 1e-9)):
                w[k] = "otherword"
            texts.append(around(w))
        got = decontaminate.found(texts, *_latent(rng, items))
        assert sum(i in g for i, g in enumerate(got)) >= 36, (n, share)
        assert not any(set(g) - {i} for i, g in enumerate(got)) and not any(decontaminate.found([around([]) for _ in range(40)], *_latent(rng, items)))


def test_decontamination_finds_quotes_of_a_part():
    rng = random.Random(14)
    for n, quoted in ((59, 40), (59, 29), (200, 100)):
        items = [(i, " ".join(words(rng, n))) for i in range(20)]
        texts = []
        for _, t in items:
            a = rng.randrange(n - quoted)
            texts.append(" ".join([*words(rng, 33), *t.split()[a : a + quoted], *words(rng, 41)]))
        got = decontaminate.found(texts, *_latent(rng, items))
        assert all(set(g) == {i} for i, g in enumerate(got)), (n, quoted)
    few = [" ".join([*words(rng, 33), *t.split()[:9], *words(rng, 41)]) for _, t in items]
    assert not any(decontaminate.found(few, *_latent(rng, items)))


def test_lcs():
    rng = random.Random(7)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 15))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(decontaminate.positions(a), len(a), b) == t[-1][-1]


CHAT = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "more"),
        (4, 0, "user", "hi"), (4, 1, "bot", "other"), (5, 0, None, None), (None, 0, "user", "lone"), (None, 1, "user", "lone"), (None, 0, "bot", "second"), (None, 3, "user", "hi"), (6, 0, "a", "b:c"),
        (6, None, "a", "first"), (4, 1, "bot", "other"), (7, 0, "user", "hi"), (8, 0, "user", "x" * 100_000), (9, 0, "bot", "second")]


def test_chat(spark):
    odd = ("conv", "pos", "h1", "last", "id", "k", "turns")
    rows = spark.createDataFrame([(*r, *range(len(odd))) for r in CHAT], "conv_id bigint, turn bigint, role string, text string, " + ", ".join(f"{c} int" for c in odd))
    got = chat.render(chat.maximal(rows)).collect()
    out = {r["conv_id"]: r for r in got if r["conv_id"] is not None}
    assert set(out) == {2, 4, 5, 6, 8} and out[4]["n_turns"] == 2
    assert out[2]["chat"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert out[6]["chat"].startswith("<|im_start|>a\nfirst") and len(out[8]["chat"]) > 100_000
    # rows without an id are conversations of their own: of equal ones, and of those that begin longer ones, one text stays
    assert sorted((r["n_turns"], r["chat"]) for r in got if r["conv_id"] is None) == [(1, "<|im_start|>bot\nsecond<|im_end|>\n"), (1, "<|im_start|>user\nlone<|im_end|>\n")]


def test_chat_sql(spark):
    import duckdb
    import pandas as pd

    frame = pd.DataFrame(CHAT, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", frame)
    want = sorted(map(str, con.execute(f"SELECT conv_id, n_turns, chat FROM ({chat.OP8_SQL})").fetchall()))
    got = chat.render(chat.maximal(spark.createDataFrame(CHAT, "conv_id bigint, turn bigint, role string, text string")))
    assert sorted(str(tuple(r)) for r in got.select("conv_id", "n_turns", "chat").collect()) == want


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    for df in (
        line_dedup.dedup_lines(nothing), ngram_join.keep_one(nothing), ngram_join.classes(nothing), decontaminate.contamination(nothing, benchmark),
        toxicity.score(nothing, toxicity.fit(nothing, labels)), quality_rules.judge(nothing), secrets.scan_secrets(nothing), suffix_dedup.deduplicated(nothing),
        quality_classifier.score(nothing, quality_classifier.fit(nothing, labels)), bpe.encode(nothing),
        chat.render(chat.maximal(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))),
    ):
        assert df.count() == 0


def test_redact(spark):
    d = spark.createDataFrame([(1, "a password=abcdefgh9 b", "x"), (2, None, "y")], "doc_id bigint, text string, spans string")
    out = {r["doc_id"]: r["text"] for r in secrets.redact(d).collect()}
    assert out == {1: "a [secret] b", 2: None}


def test_operators_that_read_texts_ignore_other_columns(spark, docs):
    """A row for each row, equal results for repeated rows, whatever the other columns are called; a very long text too."""
    rows = corpus()
    long = " ".join(words(random.Random(2), 60_000))
    more = spark.createDataFrame([(7000, long, "en", "s", 1, 1, "r", "k", "t")] * 2, SCHEMA)
    odd = docs.unionByName(more).withColumns({c: F.lit(1) for c in ("y", "n", "s", "score", "spans", "share", "item_ids", "part", "uid", "apart", "term", "h")})
    learn, labels = _labelled(spark)
    toxic, good = toxicity.fit(learn, labels), quality_classifier.fit(learn, labels)
    benchmark = spark.createDataFrame([(1, " ".join(long.split()[30_000:30_060]), 9)], "item_id bigint, text string, doc_id int")
    for out in (toxicity.score(odd, toxic), quality_classifier.score(odd, good), secrets.scan_secrets(odd), decontaminate.contamination(odd, benchmark), bpe.encode(odd, digest=True), suffix_dedup.deduplicated(odd).drop("kept")):
        got = out.collect()
        assert len(got) == len(rows) + 2
        same = defaultdict(set)
        for r in got:
            same[r["doc_id"]].add(str(r))
        assert all(len(v) == 1 for v in same.values())
    assert {r["doc_id"] for r in decontaminate.contamination(odd, benchmark).filter("share > 0").collect()} == {7000}
    kept = decontaminate.drop_contaminated(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == len(rows)


def test_decontamination_by_blocks(spark, monkeypatch):
    """Several blocks of items, one written pass for each, find what one block finds."""
    rng = random.Random(31)
    items = [(i, " ".join(words(rng, 30))) for i in range(9)]
    rows = [(i, " ".join([*words(rng, 40), items[i % 9][1] if i % 2 else "", *(items[(i + 1) % 9][1].split() if i % 5 == 0 else ()), *words(rng, 40)])) for i in range(40)] + [(None, None), (1, "")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    find = lambda: sorted((str(r["doc_id"]), r["item_ids"], round(r["share"], 9)) for r in decontaminate.contamination(docs, benchmark).collect())
    whole, kept = find(), decontaminate.drop_contaminated(docs, benchmark).count()
    monkeypatch.setattr(decontaminate, "BLOCK", 4)
    assert find() == whole and decontaminate.drop_contaminated(docs, benchmark).count() == kept
    want = [sorted({*([i % 9] if i % 2 else ()), *([(i + 1) % 9] if i % 5 == 0 else ())}) for i in range(40)]
    assert [x for i in range(40) for s, x, _ in whole if s == str(i) and (i != 1 or x)] == want


def test_pipeline_stages(spark, tmp_path, library):
    """Each stage on what the one before kept, against brute force: nulls, repeated rows, ties and odd columns included."""
    import corpus_pipeline

    rng = random.Random(41)
    bad = ["zorgle", "blixer", "quonk"]
    line = lambda: " ".join(words(rng, 12))
    passage, item = [line() for _ in range(5)], " ".join(words(rng, 40))
    rows, labels = [], []
    for i in range(240):
        own = [line() for _ in range(rng.randint(5, 9))]
        if i % 6 == 0:
            own[2] = " ".join([*own[2].split(), *(rng.choice(bad) for _ in range(4))])
        if i % 8 == 1:
            own[3:3] = passage
        if i % 30 == 2:
            own[1] = item
        rows.append((i, "\n".join(own), "en", "s", 0, "a"))
        if i < 200:
            labels.append((i, 1, int(i % 6 == 0)))
    near = rows[3][1].split(" ")
    rows += [(500, rows[3][1], "en", "s", 0, "b"), (501, " ".join([*near[:-1], "other"]), "en", "s", 0, "b"), (502, None, None, None, None, None), (503, "", "", "", 0, ""), (None, line(), None, None, None, None), (None, line(), None, None, None, None), rows[4], rows[4]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string"
    write = lambda data, s, name: spark.createDataFrame(data, s).write.parquet(f"{tmp_path}/{name}.parquet")
    write(rows, schema, "documents"), write(labels, "doc_id bigint, quality int, toxic int", "labels"), write([(1, item)], "item_id bigint, text string", "benchmark")
    sf, docs, at = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        at[name] = [tuple(r) for r in docs.collect()]
        if name != "byte_bpe":
            assert docs.columns == [f.split()[0] for f in schema.split(", ")], name
    assert sorted(map(str, at["toxicity"])) == sorted(str(r) for r in rows if not any(b in (r[1] or "") for b in bad))
    first, texts = {}, sorted({(order(r[0]), r[1] or "") for r in at["toxicity"]})
    for d, text in texts:
        for _, _, c in _pieces(text):
            first.setdefault(c, d)

    def cut(d, text):
        if text is None:
            return None
        gone = {i for a, b, c in _pieces(text) if first[c] < order(d) for i in range(a, b)}
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    assert sorted((str(r[0]), str(r[1])) for r in at["line_dedup"]) == sorted((str(r[0]), str(cut(r[0], r[1]))) for r in at["toxicity"])
    sets = lambda x: set(ngram_join.shingles(x or "").tolist())
    kept, every = at["ngram_join"], at["line_dedup"]
    alike = lambda p, q: (p or "").split() == (q or "").split() or len(sets(p) & sets(q)) >= 0.8 * max(1, len(sets(p) | sets(q)))
    assert not any(alike(p[1], q[1]) for i, p in enumerate(kept) for q in kept[:i])
    assert all(any(alike(r[1], k[1]) for k in kept) for r in every) and {str(r) for r in kept} <= {str(r) for r in every}
    assert sorted(map(str, at["decontamination"])) == sorted(str(r) for r in kept if item not in (r[1] or "")) and len(at["decontamination"]) < len(kept)
    ids = sorted((str(r[0]), hashlib.sha256(" ".join(map(str, library.encode_ordinary(r[1] or ""))).encode()).hexdigest()) for r in at["decontamination"])
    assert sorted((str(r[0]), r[2]) for r in at["byte_bpe"]) == ids
    again = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(map(str, again)) == sorted(map(str, at["byte_bpe"]))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", SCHEMA), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
