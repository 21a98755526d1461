"""What the text operators share: reading tables, document keys and intermediate tables.

A document row is identified inside the operators by ``did`` (its doc_id; a null
doc_id counts as the smallest bigint) together with ``th`` (a hash of its text), so
that repeated rows are one document, and rows that share an id but not a text are not
mixed up.  Operators read ``doc_id`` and ``text`` only; any other column, whatever its
name, is carried along where the operator returns whole rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)
BATCH = 4 << 20
PER_FILE = 1_000_000
#: ASCII white space, by byte.
SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_BASE = 0x9E3779B97F4A7C15
KEPT = (1 << 20) + (1 << 16)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2**64, of which KEPT are kept."""

    def of(base: int, n: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        return np.cumprod(p)

    if not _POWERS:
        _POWERS.extend(of(x, KEPT) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    if n <= KEPT:
        return _POWERS[0], _POWERS[1]
    return of(_BASE, n), of(pow(_BASE, -1, 1 << 64), n)


def hash_words(b: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of bytes that are not in ``parts``, and where each begins: differences of one running
    polynomial, each divided by the power at its place."""
    word = np.zeros(len(b) + 2, bool)
    word[1:-1] = ~parts[b]
    at = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = at[::2], at[1::2]
    up, down = _powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)), starts


def bounded(spark: SparkSession) -> None:
    """Texts go to Python workers in Arrow batches of at most BATCH bytes (a longer text alone), so that what a worker and
    its JVM hold of them does not depend on the texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder, read through Spark so that any store works."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def did() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID))


def keyed(docs: DataFrame) -> DataFrame:
    """(did, th, text) of each row; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(did().alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def work_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names in spark.checkpoint.dir; it goes when the driver ends."""
    bounded(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "casegrid-work")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    p, files = _file_system(spark, path)
    files.mkdirs(p)
    files.deleteOnExit(p)
    return path


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: later reads don't depend on its lineage.  ``rows``, about how
    many it has, keeps a small table to a few files, one for each PER_FILE."""
    if rows is not None:
        df = df.repartition(rows // PER_FILE + 1)
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    p, files = _file_system(spark, path)
    files.delete(p, True)


def map_columns(df: DataFrame, f, schema: str) -> DataFrame:
    """``f`` over dicts of Python lists, one per Arrow batch; it returns the new columns' lists by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(types)
        for batch in batches:
            for part in slices(batch):
                cols = f(part)
                yield pa.RecordBatch.from_arrays([pa.array(cols[x.name], x.type) for x in out], schema=out)

    from pyspark.sql.types import StructType

    bounded(df.sparkSession)
    types = StructType.fromDDL(schema)
    return df.mapInArrow(run, types)


def slices(batch: pa.RecordBatch, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``most`` bytes, a single longer row alone, so that working memory stays bounded."""
    if batch.nbytes <= most or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), most)
    yield from slices(batch.slice(half), most)
