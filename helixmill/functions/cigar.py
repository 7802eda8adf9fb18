"""CIGAR folds (F01-F07, F13). Reports differ in which operations emit a block and which advance the reference, so one fold takes the two sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"(\d+)([MIDNSHP=X])"


def ops(cigar: Column | str) -> Column:
    """array of (len, op)."""
    lens, kinds = F.regexp_extract_all(cigar, F.lit(PATTERN), F.lit(1)), F.regexp_extract_all(cigar, F.lit(PATTERN), F.lit(2))
    return F.zip_with(lens, kinds, lambda n, k: F.struct(n.cast("long").alias("len"), k.alias("op")))


def fold(cigar: Column | str, start: Column, emit: str, advance: str, query: str = "") -> Column:
    """Blocks (s, e, q) of the operations in emit; those in emit or advance move the reference, those in query the read."""
    cigar = F.col(cigar) if isinstance(cigar, str) else cigar
    kinds = lambda op, among: op.isin(list(among)) if among else F.lit(False)
    zero = F.struct(start.cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<s:bigint,e:bigint,q:bigint>>").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        block = F.struct(acc.p.alias("s"), (acc.p + o.len).alias("e"), acc.q.alias("q"))
        return F.struct(
            F.when(kinds(o.op, emit + advance), acc.p + o.len).otherwise(acc.p).alias("p"),
            F.when(kinds(o.op, query), acc.q + o.len).otherwise(acc.q).alias("q"),
            F.when(kinds(o.op, emit), F.concat(acc.out, F.array(block))).otherwise(acc.out).alias("out"),
        )

    walked = F.aggregate(ops(cigar), zero, step, lambda acc: acc.out)
    if "M" not in emit:
        return F.when(cigar.contains("N") if emit == "N" else F.lit(True), walked).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,q:bigint>>"))
    whole = F.regexp_extract(cigar, r"^(\d+)M$", 1).try_cast("long")  # most reads are one block
    return F.when(whole.isNotNull(), F.array(F.struct(start.cast("long").alias("s"), (start + whole).cast("long").alias("e"), F.lit(0).cast("long").alias("q")))).otherwise(walked)


def aligned_blocks(cigar: Column | str = "cigar", start: Column | None = None) -> Column:
    """M, = and X emit; D and N advance. q is the block's place in the read."""
    return fold(cigar, F.col("pos") if start is None else start, "M=X", "DN", "M=XIS")


def exon_blocks(cigar: Column | str = "cigar", start: Column | None = None) -> Column:
    """only M emits; D, N and S advance."""
    return fold(cigar, F.col("pos") if start is None else start, "M", "DNS")


def introns(cigar: Column | str = "cigar", start: Column | None = None) -> Column:
    """N emits; M and D advance."""
    return fold(cigar, F.col("pos") if start is None else start, "N", "MD")


def span_blocks(cigar: Column | str = "cigar", start: Column | None = None) -> Column:
    """only M emits; M, =, X, N, D, I and S advance."""
    return fold(cigar, F.col("pos") if start is None else start, "M", "=XNDIS", "M=XIS")


def position_blocks(cigar: Column | str = "cigar", start: Column | None = None) -> Column:
    """M, = and X emit; D, N and S advance."""
    return fold(cigar, F.col("pos") if start is None else start, "M=X", "DNS")


def length_of(cigar: Column | str, kinds: str) -> Column:
    """Sum of the lengths of some operations (F06: M, I, = and X; N)."""
    return F.aggregate(ops(cigar), F.lit(0).cast("long"), lambda acc, o: acc + F.when(o.op.isin(list(kinds)), o.len).otherwise(0))


def query_length(cigar: Column | str = "cigar") -> Column:
    return length_of(cigar, "MI=X")


def intron_length(cigar: Column | str = "cigar") -> Column:
    return length_of(cigar, "N")


def reference_length(cigar: Column | str = "cigar") -> Column:
    return length_of(cigar, "MDN=X")


def leading_clip(cigar: Column | str = "cigar") -> Column:
    return F.coalesce(F.regexp_extract(cigar, r"^(\d+)S", 1).try_cast("long"), F.lit(0).cast("long"))


def trailing_clip(cigar: Column | str = "cigar") -> Column:
    return F.coalesce(F.regexp_extract(cigar, r"(\d+)S$", 1).try_cast("long"), F.lit(0).cast("long"))
