"""The per-gene table (A39-A42): reads, fragment lengths, deciles, overlaps, clips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar, flags, kmers
from . import counting, fragmentomics, intervals


#: What the table reads of each member of a fragment.
CARRY = ["flag", "tid", "pos", "mapq", "cigar", "mtid", "mpos", "tlen"]


def members(frags: DataFrame) -> DataFrame:
    """The members of fragments of exactly one gene, with `gene_id`, the fragment's `n_members`, is_dup and is_multi, and `nth`, the member's place. frags: counting.fragments with CARRY."""
    one = frags.where(F.size("genes") == 1).select(F.col("genes")[0].alias("gene_id"), F.size("members").alias("n_members"), "is_dup", "is_multi", F.posexplode("members").alias("nth", "m"))
    return one.select("gene_id", "n_members", "is_dup", "is_multi", "nth", "m.*")


def single_gene(frags: DataFrame, min_mapq: int = 30) -> DataFrame:
    """Primary mapped mates of fragments of exactly one gene."""
    return members(frags).where(flags.primary_mapped(min_mapq))


def clip_columns() -> tuple[Column, Column]:
    """Whether a read is clipped at its 5' and at its 3' end."""
    rev = flags.has(flags.REVERSE)
    lead, trail = cigar.leading_clip() > 0, cigar.trailing_clip() > 0
    return F.when(rev, trail).otherwise(lead), F.when(rev, lead).otherwise(trail)


def count_columns(used: Column) -> list[Column]:
    """Sums over the rows for which `used` holds."""
    c5, c3 = clip_columns()
    n, n5, n3 = F.count_if(used), F.count_if(used & c5), F.count_if(used & c3)
    return [n.alias("primary_reads"), n5.alias("primary_reads_with_5p_clip"), n3.alias("primary_reads_with_3p_clip"), F.when(n > 0, n5 / n).alias("soft_clip_rate_5p"), F.when(n > 0, n3 / n).alias("soft_clip_rate_3p")]


def read_counts(one: DataFrame) -> DataFrame:
    return one.groupBy("gene_id").agg(*count_columns(F.lit(True)))


def motifs(one: DataFrame, fasta: DataFrame, min_mapq: int = 30, chunk: int = 65536) -> DataFrame:
    """Per gene: pairs used and skipped, 5' and 3' 4-mer counts as maps, their entropies and divergence in bits."""
    pairs = fragmentomics.motif_pairs(one.where("n_members = 2"), fasta, 4, min_mapq, chunk, ["gene_id"])
    kinds = pairs.groupBy("gene_id").agg(*[F.count_if(F.col("kind") == k).alias(f"em_pair_count_{k}") for k in ("used", "skipped_non_acgt", "skipped_oob")])
    per = fragmentomics.motif_rows(pairs, "gene_id").groupBy("gene_id", "kmer").agg(F.count_if(F.col("end") == "5p").alias("n5"), F.count_if(F.col("end") == "3p").alias("n3"))
    w = Window.partitionBy("gene_id")  # at most 256 rows
    shares = per.withColumn("p", F.col("n5") / F.sum("n5").over(w)).withColumn("q", F.col("n3") / F.sum("n3").over(w))
    bits = lambda c: F.sum(F.when(F.col(c) > 0, -F.col(c) * F.log2(c)).otherwise(0.0))
    counts = lambda n: F.map_from_entries(F.array_sort(F.array_compact(F.collect_list(F.when(F.col(n) > 0, F.struct("kmer", F.col(n).alias("n")))))))
    found = shares.groupBy("gene_id").agg(counts("n5").alias("em_5p"), counts("n3").alias("em_3p"), bits("p").alias("em_shannon_5p"), bits("q").alias("em_shannon_3p"), F.greatest(F.lit(0.0), F.sum(kmers.divergence(F.col("p"), F.col("q")))).alias("em_jsd_5p_3p"))
    return kinds.join(found, "gene_id", "left")


def length_columns(pair: Column) -> list[Column]:
    """Eight length bins and the overflow; count, mean, least and greatest are of lengths up to 1000 only."""
    inside = pair & (F.col("tlen") <= 1000)
    bins = [F.count_if(inside & (kmers.tlen_bin(F.col("tlen")) == b)).alias(f"tlen_bin_{b}") for b in kmers.TLEN_BINS]
    own = F.when(inside, F.col("tlen"))
    return [*bins, F.count_if(pair & (F.col("tlen") > 1000)).alias("tlen_overflow"), F.count_if(inside).alias("tlen_count"), F.avg(own).alias("tlen_mean"), F.min(own).alias("tlen_min"), F.max(own).alias("tlen_max")]


def with_median(out: DataFrame) -> DataFrame:
    """The approximate median: the midpoint of the bin that half of all lengths reach; the overflow counts as a bin at 1001."""
    names = [f"tlen_bin_{b}" for b in kmers.TLEN_BINS]
    upto = [reduce(lambda a, b: a + b, map(F.col, names[: k + 1])) for k in range(len(names))]
    total = F.col("tlen_count") + F.col("tlen_overflow")
    median: Column = F.lit(1001.0)
    for c, mid in reversed(list(zip(upto, kmers.TLEN_MIDPOINTS, strict=True))):
        median = F.when(2 * c >= total, F.lit(float(mid))).otherwise(median)
    return out.withColumn("tlen_median_approx", F.when(total > 0, median))


def leftmost(min_mapq: int = 30) -> Column:
    return flags.leftmost_proper_mate(min_mapq) & (F.col("n_members") == 2)


def fragment_bins(one: DataFrame, min_mapq: int = 30) -> DataFrame:
    return with_median(one.where(leftmost(min_mapq)).groupBy("gene_id").agg(*length_columns(F.lit(True))))


def shapes(exons: DataFrame, cds: DataFrame | None = None) -> DataFrame:
    """For each gene strand, total, gs, ge, ex (its merged exons with `before`, the length of earlier ones) and cds (its CDS ranges, merged and cut to the exons). A gene's exons are few: they travel as one array to its reads."""
    merged = intervals.merge(exons, ["gene_id", "strand"])
    parts = intervals.offsets(merged, ["gene_id", "strand"]).select("gene_id", "strand", F.col("s").alias("rs"), F.col("e").alias("re"), "before")
    shape = parts.groupBy("gene_id", "strand").agg(F.array_sort(F.collect_list(F.struct("rs", "re", "before"))).alias("ex"), F.sum(F.col("re") - F.col("rs")).alias("total"), F.min("rs").alias("gs"), F.max("re").alias("ge"))
    if cds is None:
        return shape.withColumn("cds", F.array().cast("array<struct<rs:bigint,re:bigint>>"))
    one = intervals.merge(cds.where("s < e").select("gene_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")), ["gene_id"])
    cut = one.join(parts.select("gene_id", "rs", "re"), "gene_id").select("gene_id", F.greatest("s", "rs").alias("rs"), F.least("e", "re").alias("re")).where("rs < re")
    return shape.join(cut.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("rs", "re"))).alias("cds")), "gene_id", "left").withColumn("cds", F.coalesce("cds", F.array().cast("array<struct<rs:bigint,re:bigint>>")))


def with_overlaps(one: DataFrame, shape: DataFrame) -> DataFrame:
    """one with exon, span and c: a read's bases in its gene's exons, between the gene's ends, and in its CDS; and `tenths`, the decile of each of its blocks' parts in an exon (A40: by the part's midpoint)."""
    zero = F.lit(0).cast("long")
    rows = one.withColumn("__blocks", cigar.aligned_blocks()).join(shape, "gene_id")
    shared = lambda b, parts: F.aggregate(parts, zero, lambda a, x: a + F.greatest(zero, F.least(x.re, b.e) - F.greatest(x.rs, b.s)))
    summed = lambda f: F.aggregate("__blocks", zero, lambda a, b: a + f(b))

    def tenth(b: Column, x: Column) -> Column:
        place = x.before + F.floor((F.greatest(b.s, x.rs) + 1 + F.least(b.e, x.re)) / 2) - x.rs - 1
        share = (place + 0.5) / F.col("total")
        return F.least(F.lit(9), F.floor(10 * F.when(F.col("strand") == "-", 1 - share).otherwise(share)).cast("int"))

    tenths = F.flatten(F.transform("__blocks", lambda b: F.transform(F.filter("ex", lambda x: (x.rs < b.e) & (b.s < x.re)), lambda x: tenth(b, x))))
    return rows.withColumn("exon", summed(lambda b: shared(b, F.col("ex")))).withColumn("span", summed(lambda b: F.greatest(zero, F.least(b.e, F.col("ge")) - F.greatest(b.s, F.col("gs"))))).withColumn("c", summed(lambda b: shared(b, F.col("cds")))).withColumn("tenths", tenths).drop("__blocks", "ex", "cds", "gs", "ge", "total")


def overlap_columns(used: Column) -> list[Column]:
    part = lambda c: F.coalesce(F.sum(F.when(used, c)), F.lit(0))
    return [part(F.col("exon")).alias("exon_aligned_bp"), part(F.col("span") - F.col("exon")).alias("intron_aligned_bp"), part(F.col("c")).alias("cds_aligned_bp"), part(F.col("exon") - F.col("c")).alias("utr_aligned_bp")]


def with_rates(out: DataFrame) -> DataFrame:
    """The CDS's share of exonic bases, the introns' share of all."""
    rate = lambda n, d: F.when(d > 0, n / d)
    exon, intron = F.col("exon_aligned_bp"), F.col("intron_aligned_bp")
    return out.withColumn("cds_utr_ratio", rate(F.col("cds_aligned_bp"), exon)).withColumn("intron_retention_rate", rate(intron, exon + intron))


def overlap_bases(one: DataFrame, shape: DataFrame) -> DataFrame:
    """Exon, intron, CDS and UTR bases of each gene's own reads."""
    return with_rates(with_overlaps(one, shape).groupBy("gene_id").agg(*overlap_columns(F.lit(True))))


def decile_column(used: Column) -> Column:
    of = lambda k: F.size(F.filter("tenths", lambda t: t == k))
    return F.array(*[F.coalesce(F.sum(F.when(used, of(k))), F.lit(0)) for k in range(10)]).alias("decile_coverage")


def deciles(one: DataFrame, shape: DataFrame) -> DataFrame:
    """Ten counts along the gene body of the midpoints of block and exon overlaps."""
    return with_overlaps(one, shape).groupBy("gene_id").agg(decile_column(F.lit(True)))


def table(reads: DataFrame, exons: DataFrame, genes: DataFrame, lengths: DataFrame, fc_reads: DataFrame, paired: bool = True, library: str = "unstranded", cds: DataFrame | None = None, fasta: DataFrame | None = None, min_reads: int = 20, min_mapq: int = 30, chunk: int = 65536) -> DataFrame:
    """One row for each gene with at least min_reads primary reads (P16). cds: gene_id, s, e.

    Fragments carry what the table reads of their members, so each member is met once, in one
    aggregate by gene; only the motifs, which need the reference, are a second one.
    """
    carry = [*CARRY, *(["contig"] if fasta is not None else [])]
    all_members = members(counting.fragments(reads, exons, paired, library, carry))
    used, lead = flags.primary_mapped(min_mapq), F.col("nth") == 0
    rows = with_overlaps(all_members, shapes(exons, cds))
    own = rows.groupBy("gene_id").agg(
        F.count_if(lead).alias("fragment_count_assigned"),
        F.count_if(lead & ~F.col("is_multi")).alias("primary_reads_unique"),
        F.count_if(lead & ~F.col("is_multi") & ~F.col("is_dup")).alias("primary_reads_unique_nodup"),
        F.count_if(lead & F.col("is_multi")).alias("primary_reads_multi"),
        *count_columns(used), *length_columns(used & leftmost(min_mapq)), *overlap_columns(used), decile_column(used),
    ).where(F.col("primary_reads") >= min_reads)
    out = genes.join(lengths.withColumnRenamed("eff_len", "effective_length"), "gene_id").join(with_rates(with_median(own)), "gene_id").join(fc_reads, "gene_id", "left")
    if fasta is not None:
        out = out.join(motifs(all_members.where(used), fasta, min_mapq, chunk), "gene_id", "left")
    whole = [n for n, kind in out.dtypes if kind in ("bigint", "int") and (n.startswith(("tlen_bin", "tlen_over", "tlen_count", "primary", "fc_", "fragment_", "em_pair")) or n.endswith("_bp"))]
    return out.fillna(0, subset=whole)
