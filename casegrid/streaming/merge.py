"""Merging duplicate cases over a stream: the state of a person is the first usable value of each column so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casegrid.operators.dedupe import first_usable, keyed

#: Spark's state store that keeps what it holds on disk.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged_rows(rows: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A streaming DataFrame with each person's row as it is after the micro-batch, whenever it may have changed: by, dedupe_key,
    row_idx (the smallest) and the columns.  The state is that of Spark's own aggregates; needs ``row_idx``; citations are left out."""
    rows = keyed(rows.drop("citations")).withColumn("row_idx", F.col("row_idx").cast("bigint"))
    keys = [*by, "dedupe_key"]
    columns = [c for c in rows.columns if c not in (*keys, "row_idx")]
    return rows.groupBy(*keys).agg(F.min("row_idx").alias("row_idx"), *first_usable(rows, columns))


def write_merged(rows: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ("doc_id",)) -> StreamingQuery:
    """Writes what each micro-batch changed under its number; a batch that runs again replaces itself."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return merged_rows(rows, by).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_merged(spark: SparkSession, path: str, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The merged line list: of each person the row of the last batch that changed it."""
    rows = spark.read.parquet(path)
    keys = [*by, "dedupe_key"]
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*by, "r.*")
