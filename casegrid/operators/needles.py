"""Searching many words in a text at once: one automaton for each document, one pass over each of its texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of one document that one row holds, and bytes of texts that are sent to a worker at once.
TEXTS, BATCH = 256, "4m"
TEXT, NEEDLE = "array<struct<part:bigint,text:string>>", "array<struct<needle:bigint,word:string>>"


def firsts(texts: list[dict], needles: list[dict]) -> Iterator[tuple[int, int, int]]:
    """(part, needle, first) of every needle that a text has, places from 1."""
    import ahocorasick

    numbers = defaultdict(list)
    for n in needles:
        numbers[n["word"]].append(n["needle"])
    tree = ahocorasick.Automaton()
    for word in numbers:
        tree.add_word(word, word)
    tree.make_automaton()
    for t in texts:
        seen = set()
        for end, word in tree.iter(t["text"]):
            if word not in seen:
                seen.add(word)
                yield from ((t["part"], k, end - len(word) + 2) for k in numbers[word])
                if len(seen) == len(numbers):
                    break


def search_rows(rows: DataFrame, needles: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, part, needle, first) of every needle (key, needle number, word) that a text of a row (key, texts: TEXT) of its document
    has: where it first begins, from 1.  Null keys, words and texts, and empty words, meet nothing.  The words of a document
    are one array, beside each of its rows."""
    words = needles.select(key, F.col("needle").cast("bigint").alias("needle"), "word").dropna().filter("word <> ''")
    words = words.groupBy(key).agg(F.collect_list(F.struct("needle", "word")).alias("words"))
    met = rows.select(key, F.filter("texts", lambda t: t["text"].isNotNull() & t["part"].isNotNull()).cast(TEXT).alias("texts")).join(words, key)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, (t, w) in enumerate(zip(b.column("texts").to_pylist(), b.column("words").to_pylist())):
                new = [*firsts(t, w)]
                out += new
                at += [i] * len(new)
            if out:
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in zip(*out))], names=[key, "part", "needle", "first"])

    return met.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, part bigint, needle bigint, first bigint")


def search(texts: DataFrame, needles: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same of single texts (key, part number, text), of which up to TEXTS of a document become a row."""
    rows = texts.select(key, F.col("part").cast("bigint").alias("part"), "text").dropna()
    rows = rows.groupBy(key, F.floor(F.col("part") / TEXTS).alias("chunk")).agg(F.collect_list(F.struct("part", "text")).alias("texts"))
    return search_rows(rows, needles, key)
