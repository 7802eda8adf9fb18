"""Flag algebra: SAM flag bits and the read filters of each report.

No filter is shared by all reports: each keeps or drops secondary, duplicate, quality-failed and
supplementary records in its own way, so each is its own expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bits of a SAM flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
FIRST, SECOND, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800


def has(bit: int, flag: str | Column = "flag") -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    return c.bitwiseAND(F.lit(bit)) != 0


def none_of(bits: int, flag: str | Column = "flag") -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    return c.bitwiseAND(F.lit(bits)) == 0


def primary() -> Column:
    """Neither secondary nor supplementary."""
    return none_of(SECONDARY | SUPPLEMENTARY)


def leftmost_proper_mate(min_mapq: int = 30) -> Column:
    """One row for each proper pair on one contig, the mate of positive template length."""
    clean = none_of(UNMAPPED | MATE_UNMAPPED | SECONDARY | SUPPLEMENTARY | QCFAIL | DUPLICATE)
    return clean & has(PAIRED) & has(PROPER) & (F.col("tid") == F.col("mtid")) & (F.col("mapq") >= min_mapq) & (F.col("tlen") > 0)


def primary_mapped(min_mapq: int = 30) -> Column:
    """P04."""
    return none_of(UNMAPPED | SECONDARY | SUPPLEMENTARY | QCFAIL | DUPLICATE) & (F.col("mapq") >= min_mapq)


def counted(paired: bool) -> Column:
    """Keeps secondary records and duplicates, asks no mapping quality."""
    base = none_of(UNMAPPED | SUPPLEMENTARY | QCFAIL)
    return base & has(PAIRED) if paired else base


def standard(min_mapq: int | None = 30) -> Column:
    """P06, and P08 without a mapping quality."""
    base = none_of(QCFAIL | DUPLICATE | SECONDARY | UNMAPPED)
    return base if min_mapq is None else base & (F.col("mapq") >= min_mapq)


def duplication_filter(min_mapq: int = 30) -> Column:
    """P07."""
    return none_of(UNMAPPED | QCFAIL) & (F.col("mapq") >= min_mapq)


def complexity_filter() -> Column:
    """Placed, primary; quality-failed records and duplicates stay."""
    return F.col("tid").isNotNull() & (F.col("tid") >= 0) & primary()


def strand_agrees(library: str, gene_strand: str | Column = "strand") -> Column:
    """Does the read's strand suit the gene's, for an unstranded, forward or reverse library?"""
    g = F.col(gene_strand) if isinstance(gene_strand, str) else gene_strand
    if library == "unstranded":
        return F.lit(True)
    flipped = has(REVERSE) != (has(PAIRED) & has(SECOND))
    read = F.when(flipped, "-").otherwise("+")
    same = read == g
    return (g == ".") | (same if library == "forward" else ~same)


def autosome(name: Column) -> Column:
    """1 to 22 after an optional chr."""
    return F.regexp_replace(name, "^(chr|CHR)", "").rlike("^([1-9]|1[0-9]|2[0-2])$")


def chrom_y(name: Column) -> Column:
    return F.upper(F.regexp_replace(name, "^(chr|CHR)", "")) == "Y"


def canonical(name: Column) -> Column:
    """F30."""
    return F.upper(F.regexp_replace(name, "(?i)^chr", "")).rlike("^([1-9]|1[0-9]|2[0-2]|X|Y|M|MT)$")
