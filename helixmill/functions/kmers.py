"""Bases, k-mers and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fragment length bins and their labels; bin midpoints of the approximate median.
TLEN_EDGES = [0, 50, 80, 120, 160, 200, 300, 500]
TLEN_BINS = ["lt_50", "50_80", "80_120", "120_160", "160_200", "200_300", "300_500", "gt_500"]
TLEN_MIDPOINTS = [25, 65, 100, 140, 180, 250, 400, 750]


def reverse_complement(c: Column | str) -> Column:
    return F.reverse(F.translate(F.upper(c), "ACGT", "TGCA"))


def valid(c: Column, k: int = 4) -> Column:
    return F.upper(c).rlike(f"^[ACGT]{{{k}}}$")


def ratio(n: Column, d: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d)


def clip_bin(n: Column) -> Column:
    return F.when(n == 1, "len_1").when(n == 2, "len_2").when(n >= 3, "len_3plus")


def tlen_bin(v: Column) -> Column:
    out = F.lit(TLEN_BINS[-1])
    for name, top in reversed(list(zip(TLEN_BINS, TLEN_EDGES[1:], strict=False))):
        out = F.when(v < top, name).otherwise(out)
    return out


def splice_class(left: Column, right: Column) -> Column:
    """F32, on either strand."""
    pair = F.concat(F.upper(left), F.lit("-"), F.upper(right))
    return F.when(pair.isin("GT-AG", "CT-AC"), "gt_ag").when(pair.isin("GC-AG", "CT-GC"), "gc_ag").when(pair.isin("AT-AC", "GT-AT"), "at_ac").otherwise("other")


def entropy(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Shannon entropy in bits of the counts of each group; null for a total of 0."""
    totals = counts.groupBy(*by).agg(F.sum(n).alias("__t")) if by else counts.agg(F.sum(n).alias("__t"))
    both = counts.join(totals, by) if by else counts.crossJoin(F.broadcast(totals))  # one row
    p = F.col(n) / F.col("__t")
    part = F.when(F.col(n) > 0, -p * F.log2(p)).otherwise(0.0)
    agg = [F.when(F.sum(n) > 0, F.sum(part)).alias("entropy")]
    return both.groupBy(*by).agg(*agg) if by else both.agg(*agg)


def divergence(p: Column, q: Column) -> Column:
    """One term of F25, the Jensen-Shannon divergence in bits, for shares p and q."""
    m = (p + q) / 2
    side = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (side(p) + side(q)) / 2
