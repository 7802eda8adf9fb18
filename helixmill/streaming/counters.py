"""Running counters over a stream of alignment records.

The batch reports are sums over records, so a stream of saved record files can keep them up to
date: each micro-batch is aggregated by the same functions and added to the totals so far. This
goes beyond the batch engine; it claims no other semantics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import readstats


def contig_counts(stream: DataFrame) -> DataFrame:
    """A08 as a streaming aggregate, for outputMode complete or update."""
    unmapped = F.col("flag").bitwiseAND(4) != 0
    return stream.groupBy("tid").agg(F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"))


def keep_flagstat(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes one flagstat row for each micro-batch under path, by batch id, so a repeated batch replaces itself; total() adds them."""

    def add(batch: DataFrame, batch_id: int) -> None:
        readstats.flagstat(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total(parts: DataFrame) -> DataFrame:
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns if c != "batch"])
