"""Places of rows in a range-sorted table, by group, without a task that sees a whole group.

Rows are dealt by ranges of (group, order) and sorted inside them, so a group of any size spreads over neighbouring partitions.
Each partition numbers its rows as they pass, and what the earlier partitions of a group hold is a running sum over one
row per (group, partition).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.llm.common import PER_FILE, written


def placed(df: DataFrame, group: str, order: list[str], path: str, n: int, weight: str | None = None) -> DataFrame:
    """``df`` with ``before`` (what the rows of its group that sort before a row weigh, or their number) and ``total``.  The
    sorted rows, about ``n``, are written once under ``path``, a file for each PER_FILE.  ``group`` is not null; ties in ``order``
    fall anyhow."""
    weight_of = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    rows = df.withColumn("_w", weight_of).repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    # the number of the sorted partition is in the upper bits, also where several are written by one task
    rows = rows.withColumns({"_part": F.monotonically_increasing_id(), "_run": F.lit(0).cast("bigint")})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            w = b.column("_w").to_numpy(zero_copy_only=False)
            run = at + np.cumsum(w) - w
            at += int(w.sum())
            part = b.column("_part").to_numpy(zero_copy_only=False) >> 33
            b = b.set_column(b.num_columns - 2, "_part", pa.array(part, pa.int64()))
            yield b.set_column(b.num_columns - 1, "_run", pa.array(run, pa.int64()))

    rows = written(rows.mapInArrow(number, rows.schema).coalesce(n // PER_FILE + 1), f"{path}/sorted")
    parts = rows.groupBy(group, "_part").agg(F.sum("_w").alias("_n"), F.min("_run").alias("_first"))
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(group, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_add"), F.sum("_n").over(W.partitionBy(group)).alias("total"))
    # written, so that Spark knows its size and sends it to all tasks if it is small
    parts = written(parts, f"{path}/parts", rows=parts.count())
    return rows.join(parts, [group, "_part"]).withColumn("before", F.col("_run") + F.col("_add")).select(*df.columns, "before", "total")
