"""Quality classifier (operator 9).

Method: random Fourier features.  Statistics of a text, standardised, go through random
cosines whose inner products approximate a Gaussian kernel; each partition sums its
normal equations, the sums are added and solved with a ridge, and isotonic regression of
the labels on the ridge scores of rows that the equations have not seen (every fourth text by its hash) calibrates them.

The classifier is fitted on at most PER_CLASS labelled documents of each class; every
text is scored whole, however long.  Defined results: a null text counts as empty and an empty text is
scored like any other; repeated rows are scored alike; without labelled rows of both
classes every score is the share of label 1, or 0.5 if there are no labels; an empty table gives none;
columns other than doc_id and text, whatever their names, are ignored; texts with equal statistics tie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.common import map_columns, slices, table, work_dir, written
from casegrid.llm.labelled import held_out, sample

PER_CLASS, COSINES, RIDGE, WIDTH, SEED = 30_000, 256, 1e-3, 4.0, 11
THRESHOLD = 0.5
#: A statistic further than FAR deviations from its mean counts as that far: the cosines were fitted to nothing beyond.
FAR = 6
#: Calibration bins: so many to a unit of the ridge score, which is meant to be 0 or 1; all scores beyond LEAST and MOST share the outer bins.
BINS, LEAST, MOST = 200, -2.0, 3.0
_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "comma": b",", "stop": b".!?", "pipe": b"|",
    "symbol": b"#*$%&<>", "quote": b"\"'", "dash": b"-_", "bracket": b"()[]{}", "slash": b"/\\:;=@+", "newline": b"\n", "space": b" \t\r\x0b\x0c",
}
_MASK = np.array([[b in set(v) for b in range(256)] for v in _KINDS.values()], np.float64)
N_STATS = len(_KINDS) + 11


def statistics(text: str) -> np.ndarray:
    """Shares and logs that don't name any word."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    kinds = _MASK @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    more = [
        np.log1p(len(words)), lengths.mean(), lengths.std(), lengths.max(), distinct / n, distinct / np.sqrt(n), pairs / max(n - 1, 1),
        same / n, 1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)), np.log1p(len(words) / max(len(lines), 1)),
    ]
    return np.concatenate([np.sqrt(kinds / size), more])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([statistics(t) for t in batch.column("text").to_pylist()]).reshape(-1, N_STATS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shift: np.ndarray
    theta: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -FAR, FAR)
        angles = np.tile(self.shift, (len(z), 1))
        for k, wave in enumerate(self.waves):  # sums in this order for each row; those of a product differ with the rows around it
            angles += z[:, k, None] * wave
        return np.hstack([np.sqrt(2 / COSINES) * np.cos(angles), z / 10, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self.cosines(x) * self.theta).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.theta is None or not len(x):
            return np.full(len(x), self.knots[1][0])
        return np.interp(self.raw(x), *self.knots)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots at the pools' mean places."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            p = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], p, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, per_class: int = PER_CLASS) -> Model:
    spark = docs.sparkSession
    rows = sample(docs, labels, "quality", modulus, remainder, per_class)
    rows = rows.select("y", "text", (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("apart"))
    features = map_columns(rows, lambda b: {"y": b.column("y"), "apart": b.column("apart"), "x": list(_matrix(b))}, "y int, apart boolean, x array<double>")
    features = written(features, f"{work_dir(spark)}/features")  # bounded like the sample
    rng = np.random.default_rng(SEED)
    sums = features.groupBy().agg(F.count("*").alias("n"), F.sum("y").alias("y"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(N_STATS)), *(F.sum(F.col("x")[i] * F.col("x")[i]).alias(f"q{i}") for i in range(N_STATS))).first()
    n = sums["n"]
    if not n or sums["y"] in (0, n):
        share = float(sums["y"] or 0) / n if n else 0.5
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros((N_STATS, COSINES)), np.zeros(COSINES), None, (np.array([0.0]), np.array([share])))
    mean = np.array([sums[f"s{i}"] / n for i in range(N_STATS)])
    scale = np.sqrt(np.maximum(np.array([sums[f"q{i}"] / n for i in range(N_STATS)]) - mean**2, 1e-8))
    model = Model(mean, scale, rng.normal(0, 1 / WIDTH, (N_STATS, COSINES)), rng.uniform(0, 2 * np.pi, COSINES))

    def equations(batches):
        total = None
        for b in batches:
            for s in slices(b, 4 << 20):
                a = model.cosines(np.array(s.column("x").to_pylist()).reshape(-1, N_STATS))
                y = np.array(s.column("y").to_pylist(), float)
                part = np.hstack([a.T @ a, (a.T @ y)[:, None]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    # too few labels of a class to keep some apart: all rows serve for both
    seen = features.groupBy("apart").agg(F.countDistinct("y").alias("n")).collect()
    if len(seen) == 2 and all(r["n"] == 2 for r in seen):
        features, apart = features.filter("not apart"), features.filter("apart")
    else:
        apart = features
    # the sample is bounded, so are its partitions' sums
    k = COSINES + N_STATS + 1
    total = sum((np.frombuffer(r["m"]).reshape(k, k + 1) for r in features.coalesce(16).mapInArrow(equations, "m binary").collect()), np.zeros((k, k + 1)))
    model.theta = np.linalg.solve(total[:, :k] + RIDGE * n * np.eye(k) / 10, total[:, k])
    scored = map_columns(apart, lambda b: {"y": b.column("y"), "s": model.raw(np.array(b.column("x").to_pylist()).reshape(-1, N_STATS))}, "y int, s double")
    bins = scored.groupBy(F.floor(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.col("s"))) * BINS).alias("b")).agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("b").collect()
    model.knots = isotonic(*(np.array([r[c] for r in bins], float) for c in ("s", "y", "n")))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each text."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": np.clip(model.score(_matrix(batch)), 0, 1)}

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_columns(texts, run, "doc_id bigint, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
