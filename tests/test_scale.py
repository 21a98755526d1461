"""The operators that replace pairs, whole groups and repeated calls, against brute force."""

from __future__ import annotations

import datetime
import decimal
import itertools
import json
import math
import os
import random
import sys
import threading
import zipfile
import zlib
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from casegrid import schema
from casegrid.functions import text
from casegrid.operators import client, dedupe, extract, intervals, joins, match, needles, provenance, quantiles, ranks, records, similar, tries
from casegrid.plans import fixtures, pipeline
from casegrid.sources import document_source, files
from casegrid.sources.pdf import page_texts
from casegrid.streaming import merge

NAMES = "row_idx bigint, name string"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers get the clients below as they are


def serial(extracted, true, threshold=0.5):
    """Each extracted row in order takes its most similar true row that is free."""
    words = lambda n: {w for w in (n or "").split() if len(w) >= 3}
    taken, out = set(), []
    for i, n in sorted(extracted):
        best = None
        for j, m in sorted(true):
            a, b = words(n), words(m)
            s = len(a & b) / len(a | b) if a and b else 0
            if j not in taken and s >= threshold and (best is None or s > best[0]):
                best = s, j
        if best:
            taken.add(best[1])
            out.append((i, best[1]))
    return out


def some_names(rng, n, stems):
    return [None if rng.random() < 0.05 else " ".join(rng.sample(stems, rng.randint(1, min(3, len(stems))))) for _ in range(n)]


@pytest.mark.parametrize("seed, one_task", [(1, 10**6), (3, 0)])
def test_greedy_match_is_the_serial_choice(spark, monkeypatch, seed, one_task):
    """Few words, so that many rows want the same true rows; once with the windows in chunks."""
    monkeypatch.setattr(match, "ONE_TASK", one_task)
    monkeypatch.setattr(ranks, "CHUNK", 5)
    rng = random.Random(seed)
    stems = ["ann", "bee", "cee", "dee"][: 2 + seed % 3]
    a = list(zip(range(0, 90, 3), some_names(rng, 13, stems)))
    b = list(zip(range(1, 60, 2), some_names(rng, 14, stems)))
    got = match.greedy_match(spark.createDataFrame(a, NAMES), spark.createDataFrame(b, NAMES))
    assert sorted((r.llm_idx, r.gt_idx) for r in got.collect()) == serial(a, b)


def test_greedy_match_of_nothing_and_with_a_clashing_name(spark):
    one, none = spark.createDataFrame([(0, "Ann Lee", "x")], NAMES + ", size string"), spark.createDataFrame([], NAMES + ", size string")
    assert match.greedy_match(one, none, ("size",)).count() == match.greedy_match(none, one, ("size",)).count() == 0
    assert [tuple(r) for r in match.greedy_match(one, one, ("size",)).collect()] == [("x", 0, 0, "Ann Lee", 1.0)]


def test_no_python_in_the_matching(spark):
    a = spark.createDataFrame([(0, "Ann Lee"), (1, "Bob Ray")], NAMES)
    plan = match.greedy_match(a, a)._jdf.queryExecution().toString() + match._alike(*match._sides(a, a, ()), 0.5)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_similar_sets(spark, threshold):
    rng = random.Random(4)
    stems = [f"w{i}" for i in range(14)]
    sets = lambda n: {tuple(sorted({"all", *rng.sample(stems, rng.randint(0, 5))})) for _ in range(n)}
    a, b = sorted(sets(60)), sorted(sets(60))
    df = lambda s: spark.createDataFrame([(" ".join(x), "r", list(x)) for x in s], "key string, run string, words array<string>")
    got = {(r.a, r.b): r.similarity for r in similar.similar_sets(df(a), df(b), threshold).collect()}
    jaccard = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    assert got == {(" ".join(x), " ".join(y)): jaccard(x, y) for x in a for y in b if jaccard(x, y) >= threshold}


def test_a_word_of_every_name_adds_no_pair(spark):
    """What meets in the index are the pairs that share a rare word, not all of them."""
    rows = [(f"all n{i} m{i}", "r", ["all", f"n{i}", f"m{i}"]) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, run string, words array<string>")
    met = similar.similar_sets(df, df, 0.5)
    met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 400 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    index = similar._rare_first(df, df)[0].select(F.explode(F.slice("words", 1, 2)).alias("w"))
    assert index.filter("w = 'all'").count() == 0


def edits(p, x):
    column, best = list(range(len(p) + 1)), len(p)
    for c in x:
        new = [0]
        for i in range(1, len(p) + 1):
            new.append(min(column[i] + 1, new[-1] + 1, column[i - 1] + (p[i - 1] != c)))
        column, best = new, min(best, new[-1])
    return best


def is_near(p, x):
    p, x = p.lower(), x.lower()
    return p == x or bool(p) and bool(x) and edits(p, x) <= math.ceil(len(p) * 0.2)


def test_edits_by_bits(spark):
    rng = random.Random(2)
    rows = [("", ""), ("", "a"), ("a", ""), ("Ab", "xaBx"), ("é" * 62, "é" * 60)]
    for n in (1, 2, 3, 5, 8, 12, 30, 61, 62, 63, 70) * 12:
        p = "".join(rng.choice("abcé ") for _ in range(n))
        x = "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 30)))
        rows.append((p, x + p[: n // 2] + rng.choice("abz") + p[n // 2 + rng.randint(0, 1) :] if rng.random() < 0.6 else x))
    df = spark.createDataFrame(rows, "p string, x string")
    for r in df.select("p", "x", text.near(F.col("p"), F.col("x")).alias("near"), F.when(F.length("p").between(1, text.BITS), text.least_edits(F.col("p"), F.col("x"))).alias("edits")).collect():
        assert r.near == is_near(r.p, r.x), r
        assert r.edits is None or r.edits == edits(r.p, r.x), r


def test_approximate_join(spark):
    rng = random.Random(6)
    name = lambda: "".join(rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 6, 9, 14])))
    a = [name() for _ in range(60)] + ["", None, "ABCD abcd", "z" * 70]
    b = [x and x[: len(x) // 2] + "q" + x[len(x) // 2 :] for x in a[:30]] + [name() for _ in range(40)] + ["", "z" * 68]
    got = similar.approximate_join(spark.createDataFrame([(x,) for x in a], "name string"), spark.createDataFrame([(x,) for x in b], "other string"))
    rows = [tuple(r) for r in got.collect()]
    want = {(x, y) for x in {*a} for y in {*b} if x is not None and y is not None and (is_near(x, y) or is_near(y, x))}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_approximate_join_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "PATTERNS", 25)
    monkeypatch.setattr(similar, "TEXTS", 40)
    rng = random.Random(12)
    a, b = ([*{"".join(rng.choice("abcd") for _ in range(rng.choice([5, 9, 9, 9, 14, 50]))) for _ in range(n)}] for n in (70, 60))
    got = [tuple(r) for r in similar.approximate_join(*(spark.createDataFrame([(x,) for x in s], "name string") for s in (a, b))).collect()]
    assert len(got) == len({*got}) and {*got} == {(x, y) for x in a for y in b if is_near(x, y) or is_near(y, x)}


def test_no_row_for_each_pair_that_shares_a_piece(spark):
    """Names meet in blocks; the plan joins nothing, and a piece that all names have adds no rows."""
    a = spark.createDataFrame([(f"{i:04d}tion{i * 7919 % 10007:05d}",) for i in range(600)], "name string")
    joined = similar.approximate_join(a, a.select(F.concat("name", F.lit("x"))))
    assert "Join" not in joined._jdf.queryExecution().toString()
    assert {(r.a, r.b) for r in joined.collect() if r.b == r.a + "x"} == {(r.name, r.name + "x") for r in a.collect()}


@pytest.mark.parametrize("at_a_time", [1, 40, 1 << 20])
def test_blocks_of_names_against_all_edits(monkeypatch, at_a_time):
    monkeypatch.setattr(similar, "AT_A_TIME", at_a_time)
    rng = random.Random(at_a_time)
    name = lambda: "".join(rng.choice("abcdé 𝒳\0") for _ in range(rng.choice([0, 1, 2, 4, 6, 10, 15, 31, 32, 33, 63, 64, 65, 80])))
    a = [*{name() for _ in range(50)}, ""]
    b = [x[: len(x) // 2] + rng.choice(["", "zz", "é"]) + x[len(x) // 2 + rng.randint(0, 3) :] for x in a[:30]] + [name() for _ in range(30)] + ["", ""]
    alphabet = np.unique(similar._points(a + b))
    found = [(a[i], b[j], i, j) for m, n in similar._alike(*(similar._Strings(x, 0.2, alphabet) for x in (a, b))) for i, j in zip(m.tolist(), n.tolist(), strict=True)]
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if is_near(x, y) or is_near(y, x)}
    assert len(found) == len({(i, j) for *_, i, j in found}) and {(i, j) for *_, i, j in found} == want


def test_edits_are_counted_for_few_pairs_of_names(monkeypatch):
    """Names that share words and letters: edits are counted, pair by pair, only where the other way round has been found already."""
    rng = random.Random(9)
    parts = ["th", "er", "on", "tion", "ent", "and", "ing", "re", "he", "at", "ly", "ble", "ou", "st"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    words = [word() for _ in range(300)]
    a, b = ([*{f"{rng.choice(words)} {rng.choice(words)}" for _ in range(n)}] for n in (1_500, 1_200))
    counted, within = [], similar._within
    monkeypatch.setattr(similar, "_within", lambda p, x, i, j: counted.append(len(i)) or within(p, x, i, j))
    alphabet = np.unique(similar._points(a + b))
    sides = [similar._Strings(x, 0.2, alphabet) for x in (a, b)]
    found = {(i, j) for m, n in similar._alike(*sides) for i, j in zip(m.tolist(), n.tolist(), strict=True)}
    assert 0 < sum(counted) <= len(found) < len(a) * len(b) / 30
    some = rng.sample(range(len(a)), 40)
    assert {(i, j) for i, j in found if i in {*some}} == {(i, j) for i in some for j in range(len(b)) if is_near(a[i], b[j]) or is_near(b[j], a[i])}


@pytest.mark.parametrize(("letters", "many", "at_once"), [("ab", 1 << 21, 1 << 14), ("abc", 40, 60), ("abc" + "".join(map(chr, range(0x4E00, 0x4F50))), 1 << 21, 40)])
def test_trees_of_patterns_against_all_edits(monkeypatch, letters, many, at_once):
    monkeypatch.setattr(tries, "MANY", many)
    monkeypatch.setattr(tries, "AT_ONCE", at_once)
    rng = random.Random(at_once)
    name = lambda n: "".join(rng.choice(letters if rng.random() < 0.3 else letters[:3]) for _ in range(n))
    patterns = [name(n) for n in range(2, 41) for _ in range(3)] * 2
    blurred = lambda x: "".join(rng.choice([c, c, c, c, c, c, rng.choice(letters), c + rng.choice(letters), ""]) for c in x)
    texts = [name(rng.randint(0, 12)) + blurred(p) + name(rng.randint(0, 9)) for p in patterns] + [letters[:n] * (60 // n) for n in (1, 2, 3)] + [letters] * 2
    texts = [x[:63] for x in texts] + ["a"]
    alphabet = np.unique(similar._points(patterns + texts))
    p, x = (similar._Strings(s, 0.2, alphabet) for s in (patterns, texts))
    found = [t for i, j in tries.Patterns(p.letters, p.at, p.size, p.edits, p.alphabet).within(x.letters, x.at, x.size) for t in zip(i.tolist(), j.tolist(), strict=True)]
    want = {(i, j) for i, q in enumerate(patterns) for j, y in enumerate(texts) if similar._least_edits(q, y) <= p.edits[i]}
    assert len(found) == len({*found}) and {*found} == want and want


def test_search_of_many_words(spark):
    rng = random.Random(5)
    docs = {d: [("".join(rng.choice("ab ") for _ in range(rng.randint(0, 40)))) for _ in range(5)] for d in range(6)}
    words = {d: ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 3))) for _ in range(9)] + ["ab", "ab", ""] for d in range(6)}
    texts = spark.createDataFrame([(d, 300 * i, t) for d, ts in docs.items() for i, t in enumerate(ts)] + [(None, 0, "ab"), (1, 9999, None)], "doc_id int, part bigint, text string")
    needle = spark.createDataFrame([(d, i, w) for d, ws in words.items() for i, w in enumerate(ws)] + [(None, 1, "ab"), (2, 99, None)], "doc_id int, needle bigint, word string")
    got = {tuple(r) for r in needles.search(texts, needle).collect()}
    assert got == {(d, 300 * p, i, t.index(w) + 1) for d in docs for p, t in enumerate(docs[d]) for i, w in enumerate(words[d]) if w and w in t}


def test_citations_equal_a_search_of_each_case(spark):
    blocks = spark.createDataFrame([(1, 0, "Ann saw abc001", [("q0", 1, 2)]), (1, 1, "ABC001 and ANN", [("q1", 3, 4), ("q2", 5, 6)]), (1, 2, "none", [("q3", 7, 8)]), (2, 0, "ann", [("q4", 0, 1)])], "doc_id int, pos int, text string, citations array<struct<cited_text:string,start_char_index:int,end_char_index:int>>")
    cases = spark.createDataFrame([(1, 0, "Abc001", None), (1, 1, None, "Ann"), (1, 2, "", ""), (2, 0, "ABC001", "Bob")], "doc_id int, row_idx int, case_id string, name string")
    got = Counter((r.doc_id, r.row_idx, r.cited_text) for r in provenance.citations_for_cases(cases, blocks).collect())
    assert got == Counter((1, i, q) for i in (0, 1) for q in ("q0", "q1", "q2"))


@pytest.mark.parametrize("width", [3, 1024])
def test_contained(spark, width):
    rng = random.Random(8)
    outer = [(rng.randint(0, 2), i, a, a + rng.randint(-2, 30)) for i in range(60) for a in [rng.randint(1, 60)]] + [(None, 99, 1, 9), (1, 98, None, 4)]
    inner = [(rng.randint(0, 2), a, a + rng.randint(0, 4)) for _ in range(80) for a in [rng.randint(1, 60)]] + [(None, 2, 3), (1, None, 3)]
    got = intervals.contained(spark.createDataFrame(inner, "d int, start bigint, end bigint"), spark.createDataFrame(outer, "d int, o int, low bigint, high bigint"), ["d"], width)
    ok = lambda *x: None not in x
    want = Counter((d, s, e, o) for d, s, e in inner for k, o, a, b in outer if ok(d, s, a) and d == k and a <= s and e <= b)
    assert Counter((r.d, r.start, r.end, r.o) for r in got.collect()) == want


@pytest.mark.parametrize("bins", [32, 4096])
def test_exact_quantiles(spark, bins):
    rng = random.Random(7)
    groups = {"a": [rng.random() for _ in range(301)], None: [rng.choice([1.5, 2.5, -3.0]) for _ in range(40)], "one": [7.25], "wide": [(-1) ** i * 10.0 ** (i % 300) for i in range(200)], "same": [4.0] * 9, "ends": [-1.7e308, 1.7e308, 0.0]}
    rows = [(g, x, None if i % 3 else x) for g, xs in groups.items() for i, x in enumerate(xs)] + [("none", None, None), ("a", float("nan"), None)]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, x double, y double").repartition(3), ["g"], ["x", "y"], [0.0, 0.25, 0.5, 0.9, 1.0], bins)
    found = {(r.g, r.c): (r.n, r.q) for r in got.collect()}
    assert len(found) == 2 * len(groups)
    for g, xs in groups.items():
        for c, own in (("x", xs), ("y", xs[::3])):
            n, q = found[g, c]
            s = sorted(own)
            want = [s[math.floor(p * (len(s) - 1))] * (1 - (p * (len(s) - 1)) % 1) + s[math.ceil(p * (len(s) - 1))] * ((p * (len(s) - 1)) % 1) for p in (0.0, 0.25, 0.5, 0.9, 1.0)]
            assert n == len(own) and np.allclose(q, want, rtol=1e-12), (g, c)


def test_quantiles_of_many_rows(spark):
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.hash("id") / 7).alias("x"))
    got = quantiles.exact_quantiles(df, ["g"], ["x"], [0.25, 0.5, 0.75]).first()
    assert np.allclose(got.q, df.agg(F.percentile("x", [0.25, 0.5, 0.75]).alias("q")).first().q, rtol=1e-12)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_null_safe_join(spark, how):
    rng = random.Random(3)
    keys = lambda n: [rng.choice([None, None, "hot", f"k{rng.randint(0, 30)}", ""]) for _ in range(n)]
    a, b = [(k, i) for i, k in enumerate(keys(120))], [(k, i) for i, k in enumerate(keys(50))]
    left, right = spark.createDataFrame(a, "case_id string, x int"), spark.createDataFrame(b, "k string, y int")
    got = Counter(map(tuple, joins.null_safe_join(left, right, "case_id", "k", how, rows=7).collect()))
    inside = {k for k, _ in b}
    want = {"inner": [(k, i, j) for k, i in a for m, j in b if k == m], "left_semi": [x for x in a if x[0] in inside], "left_anti": [x for x in a if x[0] not in inside]}[how]
    assert got == Counter(want)


def test_a_hot_key_is_shared_by_tasks(spark):
    """With 30 % null keys no task of the join has more than three times the median rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(20_000).select(F.when(F.col("id") % 10 > 2, F.col("id")).cast("string").alias("case_id"), F.col("id").alias("x"))
        right = spark.range(40).select(F.when(F.col("id") % 10 > 2, F.col("id")).cast("string").alias("k"), F.col("id").alias("y"))
        sizes = [r["n"] for r in joins.null_safe_join(left, right, "case_id", "k", rows=150).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 6_000 * 12 + 28 and len(sizes) == 4 and max(sizes) <= 3 * sorted(sizes)[1]


class Counting:
    """Answers every prompt, notes it in a file, and stops after so many notes or fails where it is told to."""

    def __init__(self, log, stop=None, fail=None):
        self.log, self.stop, self.fail = str(log), stop, fail

    def call(self, prompt):
        if self.stop and os.path.exists(self.log) and len(open(self.log).readlines()) >= self.stop:
            raise SystemExit("stopped")
        with open(self.log, "a") as f:
            f.write(prompt + "\n")
        if self.fail and self.fail in prompt:
            raise ValueError("no answer")
        return {"text": prompt.upper(), "prompt_tokens": 1, "completion_tokens": 2}


def test_a_stopped_run_goes_on_and_asks_once(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"prompt {i % 30}") for i in range(40)], "doc_id int, prompt string")
    log, ledger = tmp_path / "log", f"file://{tmp_path}/ledger"
    with pytest.raises(Exception):  # noqa: B017, PT011  the job that the client stops
        client.call_model(prompts, Counting(log, stop=12), "ollama", ledger=ledger, every=5, at_once=1)
    half = log.read_text().splitlines()
    known = {r.response for r in spark.read.schema(client.ANSWER).parquet(ledger).collect()}
    out = client.call_model(prompts, Counting(log), "ollama", ledger=ledger, every=5, at_once=3)
    assert {r.prompt: r.response for r in out.collect()} == {f"prompt {i}": f"PROMPT {i}" for i in range(30)} and out.count() == 40
    calls = Counter(log.read_text().splitlines())
    assert set(calls) == {f"prompt {i}" for i in range(30)} and known and all(calls[k.lower()] == 1 for k in known) and len(half) == 12
    client.call_model(prompts, Counting(log), "ollama", ledger=ledger)
    assert Counter(log.read_text().splitlines()) == calls


def test_jobs_do_not_grow_with_the_prompts(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(60)], "doc_id int, prompt string")
    out = client.call_model(prompts, client.FakeClient(), "ollama", ledger=f"file://{tmp_path}/ledger", every=2)
    assert out.filter("status = 'ok'").count() == 60
    assert 1 < len({f.name.split("-", 2)[2] for f in (tmp_path / "ledger").glob("part-*")}) <= 16


def test_a_task_that_ended_is_in_the_ledger(spark, tmp_path, monkeypatch):
    """Also when the job that it belongs to is stopped."""
    monkeypatch.setattr(client, "JOBS", 1)
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(400)], "doc_id int, prompt string")
    log, ledger = tmp_path / "log", f"file://{tmp_path}/ledger"
    with pytest.raises(Exception):  # noqa: B017, PT011  the job that the client stops
        client.call_model(prompts, Counting(log, stop=250), "ollama", ledger=ledger, every=16, at_once=1)
    known = {r.response for r in spark.read.schema(client.ANSWER).parquet(ledger).filter("status = 'ok'").collect()}
    out = client.call_model(prompts, Counting(log), "ollama", ledger=ledger, every=16, at_once=1)
    assert {r.response for r in out.collect()} == {f"PROMPT {i}" for i in range(400)}
    calls = Counter(log.read_text().splitlines())
    assert len(known) > 100 and all(calls[k.lower()] == 1 for k in known)


def test_a_call_that_fails_is_a_row(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, " "), (4, None)], "doc_id int, prompt string")
    ledger = f"file://{tmp_path}/ledger"
    got = {r.doc_id: (r.status, r.response, r.error) for r in client.call_model(prompts, Counting(tmp_path / "log", fail="bad"), "ollama", ledger=ledger).collect()}
    assert got[1] == ("ok", "GOOD", None) and got[2] == ("failed", None, "ValueError: no answer") and {got[3][0], got[4][0]} == {"failed"}
    again = {r.doc_id: r.status for r in client.call_model(prompts, Counting(tmp_path / "log"), "ollama", ledger=ledger).collect()}
    assert again[2] == "ok" and (tmp_path / "log").read_text().splitlines().count("good") == 1


@pytest.fixture
def stub():
    """A local server in place of a provider: the first request of each prompt is refused for a moment, a key that is wrong for good."""
    seen = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = body["messages"][0]["content"]
            seen[prompt] += 1
            status = 401 if self.headers["api-key"] != "right" else 429 if seen[prompt] == 1 else 200
            answer = {"choices": [{"message": {"content": '<linelist>[{"case_id":"syn1","name":"Ann Lee","sex":"female"}]</linelist>'}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}
            data = json.dumps(answer if status == 200 else {"error": status}).encode()
            self.send_response(status)
            self.send_header("Retry-After", "0")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_a_run_against_a_provider(spark, stub, monkeypatch):
    url, seen = stub
    monkeypatch.setenv("AZURE_OPENAI_ENDPOINT", url)
    monkeypatch.setenv("AZURE_OPENAI_API_KEY", "right")
    docs = spark.createDataFrame([(1, "- SYN1 (Ann Lee), female")], "doc_id int, content string")
    http = client.HttpClient("azure", "m")
    with pytest.raises(PermissionError):
        pipeline.run(docs, "t {{content}}", http)
    # the environment of the workers is that of the session's start, so the request is made here
    request = http.request("t")
    http.request = lambda prompt: (request[0], request[1], {"messages": [{"role": "user", "content": prompt}]})
    assert http.call("hello")["prompt_tokens"] == 3 and seen["hello"] == 2
    monkeypatch.setattr(client.HttpClient, "request", lambda self, prompt: (request[0], request[1], {"messages": [{"role": "user", "content": prompt}]}))
    out = pipeline.run(docs, "t {{content}}", Fixed(*request[:2]), approved=True)
    assert [(r.case_id, r.name) for r in out["linelist"].collect()] == [("SYN1", "Ann Lee")] and [tuple(r) for r in out["calls"].collect()] == [(1, "ok", None)]
    wrong = Fixed(request[0], {"api-key": "wrong"})
    bad = pipeline.run(docs, "u {{content}}", wrong, approved=True)["calls"].first()
    assert bad.status == "failed" and "401" in bad.error and seen["u - SYN1 (Ann Lee), female"] == 1


class Fixed(client.HttpClient):
    """An HTTP client whose address and headers are set before the workers get it."""

    def __init__(self, url, headers):
        super().__init__("azure", "m")
        self.to = url, headers

    def request(self, prompt):
        return *self.to, {"messages": [{"role": "user", "content": prompt}]}


class Cited:
    """Answers as a provider that cites the document does."""

    def call_cited(self, instructions, document):
        at = document.index("female")
        parts = [{"text": '<linelist>[{"case_id":"syn1","name":"Ann Lee","sex":"female","outcome":"Died"}]', "start": 0, "end": 1, "citations": [{"cited_text": document[at : at + 6], "start_char_index": at, "end_char_index": at + 6}]}, {"text": "</linelist>", "start": 1, "end": 2, "citations": []}]
        return {"text": "".join(p["text"] for p in parts), "blocks": parts, "prompt_tokens": 1, "completion_tokens": 1}


def test_cited_answers_reach_the_cells(spark):
    content = "- SYN1 (Ann Lee), no females here.\n\n- SYN2 is female. Died."
    docs = spark.createDataFrame([(1, content)], "doc_id int, content string")
    out = pipeline.run(docs, "rules {{content}}", Cited(), provider="ollama", cited=True)
    assert [(r.cited_text, r.start_char_index) for r in out["spans"].collect()] == [("female", content.index("female"))]
    cells = {r.field: (content[r.start - 1 : r.end], r.start) for r in out["cells"].filter("field in ('sex', 'outcome')").collect()}
    assert cells["sex"] == ("female", content.index("female") + 1)


def test_statuses_that_may_pass():
    assert [s for s in (400, 401, 404, 408, 429, 500, 503) if client.passing(s)] == [408, 429, 500, 503]
    assert client.asked_pause({"Retry-After": "3"}, 9) == 3 and client.asked_pause({"Retry-After": "Mon"}, 9) == client.asked_pause(None, 9) == 9


@pytest.mark.parametrize("cuts", [(25, 26), (3, 3)])
def test_merging_a_stream_is_merging_the_table(spark, tmp_path, cuts):
    rng = random.Random(11)
    rows = [(rng.randint(0, 2), i, rng.choice(["a1", "", None, "a2"]), rng.choice(["Ann Lee", "lee ann", "Bob", None, "null"]), rng.choice(["01/01/2026", None]), rng.choice(["male", "null", None, " "]), rng.choice([None, 3.0, 4.5])) for i in range(40)]
    schema = "doc_id int, row_idx bigint, case_id string, name string, onset_date string, sex string, age double"
    df = spark.createDataFrame(rows, schema)
    columns = ["doc_id", "row_idx", "case_id", "name", "onset_date", "sex", "age"]
    want = Counter(map(tuple, dedupe.merge_duplicates(df, ("doc_id",), numbered=True).select(columns).collect()))
    order = rows[:]
    rng.shuffle(order)
    for k, part in enumerate((order[: cuts[0]], order[cuts[0] : cuts[1]], order[cuts[1] :])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema(schema + ", part int").parquet(f"{tmp_path}/in").drop("part")
        merge.write_merged(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(180)
    got = merge.read_merged(spark, f"{tmp_path}/out")
    assert Counter(map(tuple, got.select(columns).collect())) == want


def test_merging_a_stream_needs_no_python(spark, tmp_path):
    """Nor does it turn values into text: dates and decimals are kept as they are."""
    row = (1, 0, "a1", "Ann Lee", None, datetime.date(2026, 1, 2), decimal.Decimal("1.5"))
    df = spark.createDataFrame([row, (*row[:1], 1, *row[2:4], "01/01/2026", None, None), (*row[:1], 2, *row[2:5], None, decimal.Decimal("9"))], "doc_id int, row_idx bigint, case_id string, name string, onset_date string, seen date, dose decimal(5,1)")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    plan = merge.merged_rows(stream)._jdf.queryExecution().logical().toString()
    assert "TransformWithState" not in plan and "Python" not in plan and "Pandas" not in plan
    merge.write_merged(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(180)
    got = sorted(map(tuple, merge.read_merged(spark, f"{tmp_path}/out").select("row_idx", "onset_date", "seen", "dose").collect()))
    assert got == [(0, None, datetime.date(2026, 1, 2), decimal.Decimal("1.5")), (1, "01/01/2026", None, None)]


def pdf_file(pages, packed=False, cmap=b""):
    """A file of pages of content streams; ``packed`` puts all other objects into a compressed stream."""
    stream = lambda head, data: b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(data), data)
    kids = b" ".join(b"%d 0 R" % (11 + 2 * i) for i in range(len(pages)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Resources << /Font << /F1 3 0 R >> >> /Kids [%s] >>" % kids, 3: b"<< /Type /Font /BaseFont /Helvetica %s >>" % (b"/ToUnicode 4 0 R" if cmap else b"")}
    for i, page in enumerate(pages):
        objects |= {10 + 2 * i: stream(b"/Filter /FlateDecode", zlib.compress(page)), 11 + 2 * i: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (10 + 2 * i)}
    if cmap:
        objects[4] = stream(b"", cmap)
    if packed:
        inner = {k: v for k, v in objects.items() if b"stream" not in v}
        places = itertools.accumulate([0, *(len(v) + 1 for v in inner.values())])
        head = b" ".join(b"%d %d" % (k, p) for k, p in zip(inner, places)) + b" "
        objects = {k: v for k, v in objects.items() if k not in inner} | {90: stream(b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(inner), len(head)), zlib.compress(head + b" ".join(inner.values())))}
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGE = rb"BT /F1 12 Tf 72 700 Td (Case \(one\) \351) Tj 0 -14 Td [(SYN) -20 (001) -300 (Ann)] TJ T* (next) ' ET"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_text(packed):
    assert page_texts(pdf_file([PAGE, b"BT /F1 9 Tf (two) Tj ET"], packed)) == ["Case (one) é\nSYN001 Ann\nnext", "two"]
    codes = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0041> <00E9> endbfchar 2 beginbfrange <0042> <0043> <0061> <0050> <0051> [<0058> <00590059>] endbfrange"
    assert page_texts(pdf_file([b"BT /F1 12 Tf <004100420043> Tj <00500051> Tj ET"], packed, codes)) == ["éabXYY"]
    for bad in (b"no", b"%PDF-1.4 trailer << /Encrypt 5 0 R >>"):
        with pytest.raises(ValueError, match="PDF"):
            page_texts(bad)
    assert page_texts(b"%PDF-1.4\n%%EOF") == []


def test_document_source(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.txt").write_text("plain é")
    (folder / "deep" / "b.MD").write_text("# head")
    (folder / "c.pdf").write_bytes(pdf_file([PAGE]))
    with zipfile.ZipFile(folder / "e.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (folder / "d.xyz").write_text("?")
    (folder / ".hidden.txt").write_text("no")
    document_source.register(spark)
    read = spark.read.format("document").option("onError", "row").option("bytesPerPartition", 10)
    df = read.load(str(folder))
    got = {r.label: (r.content, r.content_type, r.bytes, r.error) for r in df.collect()}
    assert got == {"a.txt": ("plain é", "text", 8, None), "b.MD": ("# head", "markdown", 6, None), "c.pdf": ("Case (one) é\nSYN001 Ann\nnext", "text", (folder / "c.pdf").stat().st_size, None), "e.docx": ("one\n\ntwo", "markdown", (folder / "e.docx").stat().st_size, None), "d.xyz": (None, None, 1, "ValueError: cannot read d.xyz: unknown file type")}
    assert df.rdd.getNumPartitions() > 1
    assert spark.read.format("document").load(str(folder / "a.txt")).first().content == "plain é"
    with pytest.raises(Exception, match="unknown file type"):
        spark.read.format("document").load(str(folder)).collect()
    assert {r.label for r in files.read_documents(spark, str(folder / "c.pdf")).collect()} == {"c.pdf"}


def test_lists_are_read_anew(spark, tmp_path):
    """A table that changes between two calls changes what both give."""
    rows = lambda text_: spark.createDataFrame([(1, text_)], "doc_id bigint, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    rows("Anna Bella")
    assert [r.name for r in fixtures.lists(spark, str(tmp_path))[1].collect()] == ["anna bella"]
    rows("Clara Doria")
    assert [r.name for r in fixtures.lists(spark, str(tmp_path))[1].collect()] == ["clara doria"]


def test_a_response_is_searched_once(spark):
    """Each pattern stands once in the plan; columns named like the parser's own, nulls and null items come through."""
    rows = [(1, "a", '<linelist>[null, {"case_id":"x1"}]</linelist>'), (2, "b", None), (3, "c", "<linelist>[]</linelist>"), (4, "d", "none"), (5, "e", '```json\n{"linelist":[{"case_id":"x2"}]}\n```')]
    df = extract.parse_responses(spark.createDataFrame(rows, "doc_id int, _json string, response string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 4 and plan.count("from_json") <= 1 + len(schema.LIST_COLUMNS)
    assert {(r.doc_id, r._json, r.row_idx, r.case_id) for r in df.collect()} == {(1, "a", 0, None), (1, "a", 1, "X1"), (5, "e", 0, "X2")}


def test_records_that_have_no_match(spark):
    a = spark.createDataFrame([("A",), (None,), ("B",)], "case_id string")
    assert [r.case_id for r in records.unmatched(a, a.filter("case_id = 'A' or case_id is null")).collect()] == ["B"]
