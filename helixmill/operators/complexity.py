"""Library complexity (A25, M03-M08): a frequency-of-frequencies table from Spark, extrapolated on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar, flags


def fragment_keys(reads: DataFrame, longest: int = 100_000_000) -> DataFrame:
    """Fragments as (tid, s, e): pairs by name merged on one contig up to `longest`, else their records; single reads by start."""
    kept = reads.where(flags.complexity_filter()).select("qname", "tid", "pos", (F.col("pos") + cigar.reference_length()).alias("stop"), flags.has(flags.PAIRED).alias("paired"), "rec_ord")
    single = kept.where("not paired").select("tid", F.col("pos").alias("s"), F.lit(-1).cast("long").alias("e"))
    nth = Window.partitionBy("qname").orderBy("rec_ord")
    pairs = kept.where("paired").withColumn("pair", F.floor((F.row_number().over(nth) - 1) / 2))
    both = pairs.groupBy("qname", "pair").agg(F.count("*").alias("n"), F.countDistinct("tid").alias("contigs"), F.min("pos").alias("s"), F.max("stop").alias("e"), F.collect_list(F.struct("tid", F.col("pos").alias("s"), F.col("stop").alias("e"))).alias("own"), F.min("tid").alias("tid"))
    merged = (F.col("n") == 2) & (F.col("contigs") == 1) & (F.col("e") - F.col("s") <= longest)
    parts = both.select(F.explode(F.when(merged, F.array(F.struct("tid", "s", "e"))).otherwise(F.col("own"))).alias("f"))
    return parts.select("f.tid", "f.s", "f.e").unionByName(single)


def frequency_table(fragments: DataFrame) -> DataFrame:
    """J and n_j."""
    return fragments.groupBy("tid", "s", "e").agg(F.count("*").alias("j")).groupBy("j").agg(F.count("*").alias("n_j"))


def interpolate(hist: dict[int, int], total: int, distinct: int, target: float) -> float:
    """Expected distinct among `target` fragments; the running sum is cut to a whole number at each step. The ratio of binomials is a product of j factors: differences of large log-gammas lose the digits that decide the cut."""
    acc = 0
    for j, n in sorted(hist.items()):
        if total - j >= target:
            acc = int(acc + n * math.prod((total - target - i) / (total - i) for i in range(j)))
    return distinct - acc


def continued_fraction(series: list[float]) -> list[float]:
    """Quotient-difference coefficients of a power series."""
    n = len(series)
    q, e = np.zeros((n, n + 1)), np.zeros((n, n + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        for j in range(n - 1):
            q[1 if n > 1 else 0, j] = series[j + 1] / series[j]
        for i in range(1, n):
            for j in range(n - 1 - i):
                e[i, j] = q[i, j + 1] - q[i, j] + e[i - 1, j + 1]
            if i + 1 < n:
                for j in range(n - 1 - i):
                    q[i + 1, j] = q[i, j + 1] * e[i, j + 1] / e[i, j]
    out = [series[0]]
    for k in range(1, n):
        out.append(-q[(k + 1) // 2, 0] if k % 2 else -e[k // 2, 0])
    return out


def evaluate(coefficients: list[float], t: float, degree: int) -> float:
    """The continued fraction at t by forward recurrence, rescaled where it grows or shrinks."""
    a0, a1 = 0.0, coefficients[0]
    b0, b1 = 1.0, 1.0
    for c in coefficients[1:degree]:
        a0, a1 = a1, a1 + c * t * a0
        b0, b1 = b1, b1 + c * t * b0
        size = max(abs(a1), abs(b1))
        if size > 1e20 or (0 < size < 1e-20):
            a0, a1, b0, b1 = (x / size for x in (a0, a1, b0, b1))
    return a1 / b1 if b1 else math.nan


def evaluate_all(coefficients: list[float], ts: np.ndarray, degree: int) -> np.ndarray:
    """evaluate at many t."""
    a0, a1 = np.zeros(len(ts)), np.full(len(ts), coefficients[0])
    b0, b1 = np.ones(len(ts)), np.ones(len(ts))
    with np.errstate(all="ignore"):
        for c in coefficients[1:degree]:
            a0, a1 = a1, a1 + c * ts * a0
            b0, b1 = b1, b1 + c * ts * b0
            size = np.maximum(np.abs(a1), np.abs(b1))
            size = np.where((size > 1e20) | ((0 < size) & (size < 1e-20)), size, 1.0)
            a0, a1, b0, b1 = (x / size for x in (a0, a1, b0, b1))
        return np.where(b1 != 0, a1 / b1, math.nan)


def good_curve(values: list[float]) -> bool:
    """Finite, never negative, never falling, and never bent upward."""
    v = np.asarray(values, float)
    steps = np.diff(v)
    return bool(np.isfinite(v).all() and (v >= 0).all() and (steps >= 0).all() and (np.diff(steps) <= 0).all())


def choose_degree(hist: dict[int, int], max_terms: int = 100) -> tuple[list[float], int] | None:
    """The first degree, from eight upward by twos, whose curve up to 100 is well behaved; of a series of six terms or fewer its own length only."""
    first_gap = next(j for j in range(1, max(hist) + 2) if not hist.get(j))
    terms = min(max_terms, first_gap - 1)
    terms -= terms % 2
    if terms < 3:
        return None
    coefficients = continued_fraction([(-1) ** j * float(hist[j + 1]) for j in range(terms)])
    grid = 0.05 * np.arange(1, 2001)
    for degree in [terms] if terms <= 6 else range(8, terms + 1, 2):
        if good_curve(np.concatenate([[0.0], grid * evaluate_all(coefficients, grid, degree)])):
            return coefficients, degree
    return None


def curve(hist: dict[int, int], max_extrap: float = 1e10, step: float = 1e6, max_terms: int = 100) -> list[tuple[float, float]] | None:
    """Expected distinct fragments at each depth; None where the table does not support it."""
    total, distinct = sum(j * n for j, n in hist.items()), sum(hist.values())
    if distinct < 10 or sum((-1) ** (j + 1) * n for j, n in hist.items()) < 0:
        return None
    chosen = choose_degree(hist, max_terms)
    if chosen is None:
        return None
    grid, t = [], step
    while t < max_extrap:
        grid.append(t)
        t += step
    inner = [(t, interpolate(hist, total, distinct, t)) for t in grid if t < total]
    outer = np.array(grid[len(inner) :])
    fold = (outer - total) / total
    return [(0.0, 0.0), *inner, *zip(outer.tolist(), (distinct + fold * evaluate_all(*chosen[:1], fold, chosen[1])).tolist(), strict=True)]


def bootstrap(hist: dict[int, int], n: int = 100, seed: int = 408, confidence: float = 0.95, **more: float) -> list[tuple[float, float, float, float]] | None:
    """Median and quantiles of curves of resampled tables; the generator is numpy's, so bounds agree in distribution only."""
    if n == 0:  # the plain curve
        return [(t, v, math.nan, math.nan) for t, v in found] if (found := curve(hist, **more)) else None
    rng = np.random.default_rng(seed)
    js, ns = np.array(sorted(hist)), np.array([hist[j] for j in sorted(hist)])
    curves: list[list[float]] = []
    for _ in range(100 * n):
        drawn = rng.multinomial(ns.sum(), ns / ns.sum())
        got = curve({int(j): int(k) for j, k in zip(js, drawn, strict=True) if k}, **more)
        if got and good_curve([v for _, v in got]):
            curves.append([v for _, v in got])
            grid = [t for t, _ in got]
        if len(curves) == n:
            break
    if not curves:
        return None
    if len(curves) == 1:
        return [(t, v, math.nan, math.nan) for t, v in zip(grid, curves[0], strict=True)]
    low, mid, high = np.quantile(np.array(curves), [(1 - confidence) / 2, 0.5, (1 + confidence) / 2], axis=0)
    return list(zip(grid, mid.tolist(), low.tolist(), high.tolist(), strict=True))


def report(hist: dict[int, int], settings: dict) -> list[tuple[float, float, float, float]] | None:
    """All points of the configured grid: reads, median, lower and upper bound."""
    c = settings
    return bootstrap(hist, c["n_bootstraps"], c["seed"], c["confidence"], max_extrap=c["max_extrap"], step=c["step"], max_terms=c["max_terms"]) if hist else None
