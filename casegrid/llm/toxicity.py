"""Toxicity (operator 4).

Method: maximum-scoring segments.  Tokens (words, and their prefixes of four and five
letters for words seen too rarely) get log-odds of the toxic against the clean class
under a Dirichlet prior shaped like the whole training vocabulary; all those that stand out
by z-score form the lexicon, and every other word has the common, slightly negative
log-odds of the rest.  A linear-time scan finds all maximal scoring segments of a text.
By extreme-value theory the best of n words' segments reaches S by chance with
probability 1 - exp(-K n exp(-lambda S)); lambda comes from the clean words' scores, K
from the clean documents.  A one-dimensional logistic curve over lambda S - ln(K n),
fitted to the labels, makes a score of it.

Defined results: a null or empty text has no segment and gets the score of that; repeated
rows are scored alike; very long texts are scored whole; segments of equal score stay apart; without labelled rows of both classes every score is 0; an empty
table gives none; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.common import map_columns, table
from casegrid.llm.labelled import held_out, sample

PER_CLASS = 30_000
MIN_Z, PRIOR = 4.0, 0.1
THRESHOLD = 0.3
#: Words whose weight a worker remembers; beyond it the memory starts anew.
MEMORY = 50_000
#: The curve is fitted to evidence up to this, either way, so that a few extreme texts don't decide its slope.
MOST = 30.0
_STRIP = ".,;:!?\"'()[]{}<>|*#-_…«»„“”"


def features(word: str) -> list[str]:
    """The word as a token, and its prefixes, marked."""
    w = word.strip(_STRIP)
    return [w, *(f"{w[:k]}*" for k in (5, 4) if len(w) > k)] if w else []


def _counts(batch: pa.RecordBatch) -> dict:
    seen = (Counter(), Counter())
    for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
        seen[y].update(set(text.lower().split()))  # a text counts each word once, however often it repeats it
    out: dict[str, list[int]] = {}
    for y in (0, 1):
        for word, n in seen[y].items():
            for x in features(word):
                out.setdefault(x, [0, 0])[y] += n
    return {"token": list(out), "clean": [v[0] for v in out.values()], "toxic": [v[1] for v in out.values()]}


@dataclass
class Model:
    """weights: log-odds of the lexicon; rest: of any other word; lam, k: extreme-value parameters; a, b: logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    rest: float = -0.01
    lam: float = 1.0
    k: float = 0.1
    a: float = 0.0
    b: float = -50.0
    memory: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"memory": {}}

    def weight(self, word: str) -> float:
        for x in features(word):
            if x in self.weights:
                w = self.weights[x]
                break
        else:
            w = self.rest
        if len(self.memory) > MEMORY:
            self.memory.clear()
        self.memory[word] = w
        return w

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first word, end, score), in one pass."""
        known, weight = self.memory, self.weight
        scores = [known[w] if w in known else weight(w) for w in words]
        return maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], self.rest)

    def evidence(self, n: int, best: float) -> float:
        return self.lam * best - math.log(self.k * max(n, 1))

    def score(self, n: int, best: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.a * self.evidence(n, best) + self.b))))

    def significant(self, n: int, segments: list[tuple[int, int, float]], most: float = 0.05) -> list[tuple[int, int, float]]:
        return [s for s in segments if 1 - math.exp(-self.k * max(n, 1) * math.exp(-self.lam * s[2])) <= most]


def maximal_segments(hits: list[tuple[int, float]], rest: float) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa's algorithm where all positions but the hits score ``rest`` <= 0, in linear time: a stack of
    candidates with the running totals left of and at the end of each, and the place of the last one below it with a smaller
    left total.  What no candidate can reach any more is done and leaves the stack."""
    done: list[tuple[int, int, float, float, int]] = []
    stack: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, 0
    for i, s in hits:
        left = total + rest * (i - at)
        total, at = left + s, i + 1
        first, end, right = i, i + 1, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0:
                done += stack
                stack.clear()
                break
            if stack[j][3] >= right:
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, end, left, right, j))
    return [(a, b, r - lo) for a, b, lo, r, _ in done + stack]


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, per_class: int = PER_CLASS) -> Model:
    """Learns from at most ``per_class`` labelled documents of each class that are not held out.  What comes to the
    driver is bounded by them: the tokens that stand out (each in at least a dozen of them), totals, and a histogram."""
    rows = sample(docs, labels, "toxic", modulus, remainder, per_class)
    counts = map_columns(rows, _counts, "token string, clean bigint, toxic bigint").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    word = ~F.col("token").endswith("*")
    both = counts.groupBy().agg(*(F.sum(F.when(word, F.col(c))).alias(c) for c in ("clean", "toxic"))).first()
    n0, n1 = both["clean"] or 0, both["toxic"] or 0
    if not n0 or not n1:
        return Model()
    prior = PRIOR * (n0 + n1)
    part = (F.col("clean") + F.col("toxic")) / float(n0 + n1) * prior
    odds = lambda c, n: F.log((F.col(c) + part) / F.greatest(F.lit(n + prior) - F.col(c) - part, F.lit(1.0)))
    scored = counts.withColumn("w", odds("toxic", n1) - odds("clean", n0)).withColumn("z", F.col("w") / F.sqrt(1 / (F.col("toxic") + part) + 1 / (F.col("clean") + part)))
    top = scored.filter((F.col("z") >= MIN_Z) & (F.col("w") > 1)).collect()
    model = Model(weights={r["token"]: r["w"] for r in top})
    # a prefix only counts what its lexicon words have not: it stands for words too rare to stand out
    lexical = [r for r in top if not r["token"].endswith("*")]
    p1, p0 = (min(0.5, (sum(r[c] for r in lexical) + 1) / (n + 2)) for c, n in (("toxic", n1), ("clean", n0)))
    model.rest = min(-1e-3, math.log((1 - p1) / (1 - p0)))
    model.lam = _lambda([(r["w"], (r["clean"] + 0.5) / n0) for r in lexical], model.rest)

    def best(batch: pa.RecordBatch) -> dict:
        got = [(y, *_best(model, text)) for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        return {"y": [g[0] for g in got], "n": [g[1] for g in got], "s": [g[2] for g in got]}

    bins = (
        map_columns(rows, best, "y int, n bigint, s double")
        .select("y", F.round(F.log1p("n") * 4).cast("int").alias("n"), F.round("s", 0).cast("int").alias("s"))
        .groupBy("y", "n", "s").agg(F.count("*").alias("c")).orderBy("y", "n", "s").collect()
    )
    least = min(model.weights.values(), default=1.0)
    clean = [r for r in bins if r["y"] == 0]
    above = sum(r["c"] for r in clean if r["s"] >= least) + 0.5
    length = sum(r["c"] * math.expm1(r["n"] / 4) for r in clean)
    model.k = max(1e-12, above / max(length, 1.0) * math.exp(model.lam * least))
    x = np.array([model.evidence(round(math.expm1(r["n"] / 4)), r["s"]) for r in bins])
    model.a, model.b = _logistic(np.clip(x, -MOST, MOST), np.array([r["y"] for r in bins], float), np.array([r["c"] for r in bins], float))
    return model


def _lambda(scores: list[tuple[float, float]], rest: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the clean words."""
    left = max(0.0, 1 - sum(p for _, p in scores))
    f = lambda x: left * math.exp(x * rest) + sum(p * math.exp(min(x * s, 700)) for s, p in scores) - 1
    lo, hi = 1e-3, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    if f(lo) > 0:
        return 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge on the slope."""
    scale = max(1.0, float(np.abs(x).max(initial=1.0)))
    m, theta = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(m @ theta, -500, 500)))
        g = m.T @ (c * (p - y)) + 1e-2 * np.array([theta[0], 0])
        h = (m * (c * p * (1 - p))[:, None]).T @ m + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(h, g)
        theta -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def _best(model: Model, text: str) -> tuple[int, float]:
    words = text.lower().split()
    return len(words), max((s for _, _, s in model.segments(words)), default=0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_segments (significant ones) and segments (first word, end, score) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded like the sample that it was learned from

    def run(batch: pa.RecordBatch) -> dict:
        m = shared.value
        scores, found = [], []
        for text in batch.column("text").to_pylist():
            words = text.lower().split()
            segments = m.segments(words)
            scores.append(m.score(len(words), max((s for _, _, s in segments), default=0.0)))
            found.append([{"start": a, "end": b, "score": s} for a, b, s in m.significant(len(words), segments)])
        return {c: batch.column(c) for c in batch.schema.names if c != "text"} | {"score": scores, "segments": found}

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_columns(texts, run, "doc_id bigint, score double, segments array<struct<start:int,end:int,score:double>>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, whole and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            keep = [m.score(*_best(m, t or "")) < threshold for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("segments").alias("n_segments"))
