"""Very long texts, and ties, in the text operators and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from casegrid.llm import bpe, decontaminate, line_dedup, ngram_join, quality_classifier, quality_rules, toxicity

STEMS = np.array([a + b + c for a in "ka lo mi tu ren sol vid".split() for b in "pra nex dor ba".split() for c in "zu fi gon hel wa".split()])
DOCS = "doc_id bigint, text string"


def words(seed, n):
    """``n`` words; five in a row are seldom met twice."""
    rng = np.random.default_rng(seed)
    return (STEMS[rng.integers(0, len(STEMS), n)].astype(object) + STEMS[rng.integers(0, len(STEMS), n)].astype(object)).tolist()


@pytest.fixture(scope="module")
def long_words():
    """More bytes than one Arrow batch of texts may have."""
    out = words(1, 400_000)
    assert sum(map(len, out)) + len(out) > 4 << 20
    return out


def test_line_dedup_of_a_very_long_text(spark, long_words):
    lines = [" ".join(long_words[i : i + 10]) for i in range(0, len(long_words), 10)]
    block = [" ".join(words(50 + i, 9)) for i in range(6)]
    docs = spark.createDataFrame([(1, "\n".join(["own start", *block])), (2, "\n".join([*lines, *block]))], DOCS)
    got = {r["row"]["doc_id"]: r for r in line_dedup.deduplicated(docs).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"]) == (0, len(block))
    assert got[2]["r_text"] == "\n".join(lines)


def test_ngram_join_of_very_long_texts(spark, long_words):
    text = " ".join(long_words)
    near, half = " ".join([*long_words[:-1], "changed"]), " ".join(long_words[: len(long_words) // 2])
    docs = spark.createDataFrame([(1, text), (2, near), (3, half), (4, text)], DOCS)
    got = {r["did"]: (r["rep"], r["root"], r["n_links"]) for r in ngram_join.classes(docs).collect()}
    assert got == {1: (1, 1, 1), 2: (2, 1, 1), 3: (3, 3, 0), 4: (1, 1, 1)}
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(docs).collect()) == [1, 3]


def test_quality_rules_of_a_very_long_text(long_words):
    line = "a line that comes again"
    text = f"{line}\n{' '.join(long_words)} #*\n{line}"
    n, chars, symbols, dups, repeated = quality_rules.statistics(text)
    split = text.split()
    seen: dict[tuple[str, ...], int] = {}
    grams = list(zip(split, split[1:], split[2:], strict=False))
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    assert (n, chars, symbols, dups, repeated) == (len(split), sum(map(len, split)), 2, 1, len(covered))


def test_decontamination_of_a_very_long_text(spark, long_words):
    """An item at the very end is found; the text without it, and other columns with odd names, stay."""
    item = " ".join(words(70, 40))
    rows = [(1, " ".join(long_words), "a"), (2, " ".join([*long_words, item]), "b"), (3, "short text", "c")]
    docs = spark.createDataFrame(rows, f"{DOCS}, item_id string")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in kept) == [(1, "a"), (3, "c")]


def test_pipeline_of_very_long_texts(spark, tmp_path, long_words):
    import corpus_pipeline

    item = " ".join(words(71, 40))
    text = " ".join(long_words)
    block = "\n".join(" ".join(words(80 + i, 12)) for i in range(5))
    other = " ".join(words(2, 300_000))
    rows = [(1, text), (2, " ".join([*long_words[:-1], "changed"])), (3, " ".join([*words(3, 300_000), item])), (4, block), (5, f"{other}\n{block}")]
    write = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write(rows, DOCS, "documents"), write([(1, item)], "item_id bigint, text string", "benchmark"), write([], "doc_id bigint, quality int, toxic int", "labels")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 4, 5}
    want = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in ((1, text), (4, block), (5, other))}
    assert {d: r["decoded_sha256"] for d, r in got.items()} == want


def labelled(spark):
    rows, labels = [], []
    for i in range(400):
        w = words(1000 + i, 40 + i % 60)
        if i % 5 == 0:
            w[3:3] = ["zorgle", "blixer", "quonk"]
        good = i % 3 != 0
        rows.append((i, (" ".join(w).capitalize() + "." if good else " | ".join(x + "##" for x in w))))
        labels.append((i, int(good), int(i % 5 == 0)))
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_of_ties(spark):
    """Equal texts score alike wherever they stand, and segments of equal score are both found."""
    rows, labels = labelled(spark)
    passage = ["zorgle", "blixer", "quonk"]
    twice = " ".join([*words(5, 60), *passage, *words(6, 400), *passage, *words(7, 60)])
    docs = spark.createDataFrame([*rows, (5000, twice), (5001, twice), (None, twice), (5002, rows[1][1])], DOCS)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["score"] == by[5001]["score"] == by[None]["score"] >= 0.3 and by[5002]["score"] == by[1]["score"]
    assert [(s["start"], s["end"]) for s in by[5000]["segments"]] == [(60, 63), (463, 466)]
    assert len({s["score"] for s in by[5000]["segments"]}) == 1


def test_quality_classifier_of_ties(spark):
    rows, labels = labelled(spark)
    again = [(6000 + i, t) for i, t in rows[:30]]
    docs = spark.createDataFrame([*rows, *again], DOCS).repartition(5)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()}
    assert all(got[6000 + i] == got[i] for i in range(30))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == (i % 3 != 0) for i in held) >= 0.97 * len(held)


def test_quality_rules_of_ties(spark):
    """Rows of equal statistics are kept or rejected together, also where a whole group is equal."""
    rng = random.Random(4)
    rows = [(i, " ".join(words(i, rng.randint(60, 200))), "en", "s") for i in range(80)]
    rows += [(100 + i, rows[i % 7][1], "en", "s") for i in range(21)]
    odd = " ".join(f"{w}#$%" for w in words(9, 120))
    rows += [(200 + i, odd, "en", "s") for i in range(4)] + [(300 + i, rows[0][1], "fr", None) for i in range(5)]
    docs = spark.createDataFrame(rows, f"{DOCS}, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert all(kept[100 + i] == kept[i % 7] for i in range(21))
    assert {kept[200 + i] for i in range(4)} == {False} and len({kept[300 + i] for i in range(5)}) == 1


def test_byte_bpe_of_a_very_long_text_decodes(spark, long_words):
    text = " ".join(long_words[:50_000]) + "\n" + "é😀" * 50_000
    got = bpe.encode(spark.createDataFrame([(1, text)], DOCS), digest=True).first()
    assert got["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_latent_search_by_itself(spark, monkeypatch):
    """With the vectors of the given texts and no word pairs, nearly all items are found of which a tenth of the words is replaced."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text is not null")
    space, rng = decontaminate.latent_space(docs), random.Random(5)
    hosts = [t for t in (r["text"].split() for r in docs.orderBy("doc_id").select("text").collect()) if 150 < len(t) < 400]
    bag = [w for t in hosts for w in t]
    items = [(i, " ".join(hosts[i % len(hosts)][20 : 20 + (24, 40, 60)[i % 3]])) for i in range(60)]
    texts = []
    for _, t in items:
        w = t.split()
        for k in rng.sample(range(len(w)), len(w) // 10):
            w[k] = rng.choice(bag)
        host = rng.choice(hosts)
        texts.append(" ".join([*host[:60], *w, *host[60:120]]))
    none = np.empty((0, 3), np.int64)
    monkeypatch.setattr(decontaminate, "by_pairs", lambda h, begin, items: (none, none))
    got = decontaminate.found(texts, space, decontaminate.prepared(items, space))
    assert sum(i in g for i, g in enumerate(got)) >= 54
