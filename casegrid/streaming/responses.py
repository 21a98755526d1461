"""The stateless steps over a stream of model responses: each response is parsed as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from casegrid.operators.extract import parse_responses
from casegrid.operators.graph import relationships


def parse_stream(responses: DataFrame, column: str = "response") -> DataFrame:
    """Rows of the line lists in a streaming DataFrame of responses."""
    return parse_responses(responses, column)


def write_stream(responses: DataFrame, linelist_path: str, relations_path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's rows and relationships; batches are written once under their number."""

    def each(batch: DataFrame, number: int) -> None:
        rows = parse_responses(batch).persist()
        rows.write.mode("overwrite").parquet(f"{linelist_path}/batch={number}")
        relationships(rows, tuple(c for c in ("doc_id",) if c in rows.columns)).write.mode("overwrite").parquet(f"{relations_path}/batch={number}")
        rows.unpersist()

    return responses.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
