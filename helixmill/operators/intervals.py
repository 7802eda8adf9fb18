"""Interval algebra on half-open [s, e): merge, gaps, subtraction, and joins by bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a join bin in bases.
BIN = 1 << 12
#: Bits of the bins of each level of a shelf, for short targets (exons) and long ones (genes); and how many entries of a shelf are broadcast (some 60 bytes each).
LEVELS, LONG_LEVELS, BROADCAST_ENTRIES = (9, 12, 17, 22, 31), (12, 17, 22, 31), 1_000_000


def merge(df: DataFrame, by: list[str]) -> DataFrame:
    """Unions of overlapping or adjacent intervals of each group."""
    w = Window.partitionBy(*by).orderBy("s", "e")
    top = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(*by, "s", "e", F.when(top.isNull() | (F.col("s") > top), 1).otherwise(0).alias("new"))
    grouped = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def union_length(df: DataFrame, by: list[str], name: str = "eff_len") -> DataFrame:
    """Bases that the intervals of each group cover."""
    return merge(df, by).groupBy(*by).agg(F.sum(F.col("e") - F.col("s")).alias(name))


def gaps(df: DataFrame, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """What lies between consecutive intervals of each group."""
    w = Window.partitionBy(*by).orderBy("s", "e")
    return df.withColumn("__n", F.lead("s").over(w)).where("__n > e").select(*by, *(columns or []), F.col("e").alias("s"), F.col("__n").alias("e"))


def offsets(df: DataFrame, by: list[str]) -> DataFrame:
    """Df with `before`, the length of the group's earlier intervals."""
    w = Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(F.col("e") - F.col("s")).over(w), F.lit(0)))


def subtract(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The parts of the merged intervals a that b does not cover, by a sweep over all edges."""
    edge = lambda d, side: merge(d, by).select(*by, F.explode(F.array(F.struct(F.col("s").alias("p"), F.lit(1).alias("d")), F.struct(F.col("e").alias("p"), F.lit(-1).alias("d")))).alias("x")).select(*by, F.col("x.p").alias("p"), (F.col("x.d") if side == "a" else F.lit(0)).alias("da"), (F.col("x.d") if side == "b" else F.lit(0)).alias("db"))
    points = edge(a, "a").unionByName(edge(b, "b")).groupBy(*by, "p").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(*by).orderBy("p")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = points.select(*by, F.col("p").alias("s"), F.lead("p").over(w).alias("e"), F.sum("da").over(run).alias("ina"), F.sum("db").over(run).alias("inb"))
    return merge(swept.where("ina > 0 and inb = 0 and e is not null").select(*by, "s", "e"), by)


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], closed: bool = False, bin_size: int = BIN) -> DataFrame:
    """Pairs of left (s, e) and right (rs, re) that share a base; closed: that touch is enough.

    Both sides are dealt to the bins that they cross and joined on group and bin; a pair is kept in
    the bin where the later of the two starts lies, so it comes once. A contig is thereby split
    over as many tasks as it has bins. The optimizer broadcasts an annotation below its size bound.
    """
    last = F.col("e") if closed else F.greatest(F.col("e") - 1, F.col("s"))
    rlast = F.col("re") if closed else F.greatest(F.col("re") - 1, F.col("rs"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / bin_size), F.floor(b / bin_size)))
    lb, rb = left.withColumn("__bin", bins(F.col("s"), last)), right.withColumn("__bin", bins(F.col("rs"), rlast))
    hit = (F.col("s") <= F.col("re")) & (F.col("rs") <= F.col("e")) if closed else (F.col("s") < F.col("re")) & (F.col("rs") < F.col("e"))
    owner = F.col("__bin") == F.floor(F.greatest("s", "rs") / bin_size)
    return lb.join(rb, [*by, "__bin"]).where(hit & owner).drop("__bin")


def point_join(points: DataFrame, right: DataFrame, by: list[str], strict: bool = False, bin_size: int = BIN) -> DataFrame:
    """Points p in [rs, re), or strictly inside for strict."""
    rb = right.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("rs") / bin_size), F.floor(F.col("re") / bin_size))))
    inside = (F.col("rs") < F.col("p")) & (F.col("p") < F.col("re")) if strict else (F.col("rs") <= F.col("p")) & (F.col("p") < F.col("re"))
    return points.withColumn("__bin", F.floor(F.col("p") / bin_size)).join(rb, [*by, "__bin"]).where(inside).drop("__bin")


def shelf(targets: DataFrame, by: list[str], columns: list[str], closed: bool = False, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """by, level, bin, and near: the targets (rs, re, columns) that touch each bin of each level. It is marked for broadcast if it has few entries."""
    last = F.col("re") if closed else F.greatest(F.col("re") - 1, F.col("rs"))
    rows = targets.select(*by, F.struct("rs", "re", *columns).alias("t"), last.alias("last")).distinct()
    spans = [(k, F.shiftright("t.rs", k), F.shiftright("last", k)) for k in levels]
    entries = rows.agg(F.sum(reduce(lambda x, y: x + y, [b - a + 1 for _, a, b in spans]))).first()[0] or 0
    bins = F.array(*[F.struct(F.lit(k).alias("level"), a.alias("a"), b.alias("b")) for k, a, b in spans])
    placed = rows.select(*by, "t", F.explode(bins).alias("x")).select(*by, "t", "x.level", F.explode(F.sequence("x.a", "x.b")).alias("bin"))
    out = placed.groupBy(*by, "level", "bin").agg(F.collect_list("t").alias("near"))
    return F.broadcast(out) if entries <= BROADCAST_ENTRIES else out


def beside(rows: DataFrame, first: Column, last: Column, targets: DataFrame, by: list[str], columns: list[str], closed: bool = False, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """rows with `near`: all targets (rs, re, columns) that touch [first, last], and some that lie by.

    A row looks up the two bins or fewer that it crosses at the finest level where it does, so rows
    are neither exploded nor grouped again, and few targets are broadcast: then no row moves. The
    caller filters `near`. A row without a place has none.
    """
    table = shelf(targets, by, columns, closed, levels)
    level = F.lit(levels[-1])
    for k in reversed(levels[:-1]):
        level = F.when(F.shiftright(last, k) - F.shiftright(first, k) <= 1, k).otherwise(level)
    at = lambda c: F.call_function("shiftright", c.cast("long"), F.col("__level"))
    keyed = rows.withColumn("__first", first).withColumn("__last", last).withColumn("__level", F.when(F.col("__first").isNotNull(), level)).withColumn("__b1", at(F.col("__first")))
    keyed = keyed.withColumn("__b2", F.when(at(F.col("__last")) != F.col("__b1"), at(F.col("__last"))))
    named = lambda n: table.select(*[F.col(c).alias(f"__{c}{n}") for c in by], F.col("level").alias(f"__level{n}"), F.col("bin").alias(f"__bin{n}"), F.col("near").alias(f"__near{n}"))
    for n, b in ((1, "__b1"), (2, "__b2")):
        on = (F.col("__level") == F.col(f"__level{n}")) & (F.col(b) == F.col(f"__bin{n}"))
        for c in by:
            on = on & (F.col(c) == F.col(f"__{c}{n}"))
        keyed = keyed.join(named(n), on, "left")
    more = F.filter("__near2", lambda x: x.rs >= F.call_function("shiftleft", F.col("__b2"), F.col("__level")))  # others are in the first bin too
    near = F.when(F.col("__near1").isNull(), F.coalesce("__near2", F.array().cast(keyed.schema["__near2"].dataType))).when(F.col("__near2").isNull(), F.col("__near1")).otherwise(F.concat("__near1", more))
    # a target of the second bin that also touches the first is in its list, so a missing first list hides none
    return keyed.select(*rows.columns, near.alias("near"))
