"""Reports of many samples in one job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a record's number within its sample.
ORDER_BITS = 44


def together(samples: dict[str, DataFrame]) -> DataFrame:
    """One alignment table with sample_id; rec_ord is the sample's number and the record's own, so records of two samples never meet."""
    parts = [df.withColumn("sample_id", F.lit(name)).withColumn("rec_ord", F.lit(k << ORDER_BITS) + F.col("rec_ord")) for k, (name, df) in enumerate(sorted(samples.items()))]
    return reduce(DataFrame.unionByName, parts)


def each(reads: DataFrame, report: Callable[[DataFrame], DataFrame], names: list[str] | None = None) -> DataFrame:
    """report of each sample's records, never of several together, with sample_id; all in one job. The samples are named, or read from the table."""
    names = names if names is not None else sorted(r.sample_id for r in reads.select("sample_id").distinct().collect())
    parts = [report(reads.where(F.col("sample_id") == n).drop("sample_id")).select(F.lit(n).alias("sample_id"), "*") for n in names]
    return reduce(DataFrame.unionByName, parts) if parts else report(reads.limit(0).drop("sample_id")).select(F.lit("").alias("sample_id"), "*").limit(0)
