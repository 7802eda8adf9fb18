"""Fragment lengths, end motifs, soft clips, periodicity, splice motifs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar, flags, kmers

MOST = 1000


def fragment_lengths(reads: DataFrame, min_mapq: int = 30) -> DataFrame:
    """Template lengths of proper pairs, each once; over 1000 as 1001."""
    return reads.where(flags.leftmost_proper_mate(min_mapq)).groupBy(F.least("tlen", F.lit(MOST + 1)).alias("tlen")).agg(F.count("*").alias("n"))


def fragment_summary(hist: DataFrame) -> DataFrame:
    """Bins, short and long shares, mean (over 1000 counts as 1001) and the first length that half of the pairs reach."""
    inside = F.col("tlen") <= MOST
    total = F.sum("n")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    w = Window.orderBy("tlen")  # at most 1001 rows
    ranked = hist.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    half = F.ceil(F.col("all") / 2)
    return ranked.agg(
        *[part(inside & (kmers.tlen_bin(F.col("tlen")) == b)).alias(f"bin_{b}") for b in kmers.TLEN_BINS],
        part(~inside).alias("overflow"),
        kmers.ratio(part(F.col("tlen") < 80), total).alias("frac_lt_80"),
        kmers.ratio(part(F.col("tlen") >= 300), total).alias("frac_ge_300"),
        (F.sum(F.col("tlen") * F.col("n")) / total).alias("mean"),
        F.min(F.when(F.col("upto") >= half, F.col("tlen"))).alias("median"),
    )


def readthrough_rate(reads: DataFrame, min_mapq: int = 30) -> DataFrame:
    """Share of pairs shorter than the read."""
    kept = reads.where(flags.leftmost_proper_mate(min_mapq))
    short = F.count_if(F.abs("tlen") < F.length("seq"))
    return kept.agg(kmers.ratio(short, F.count("*")).alias("adapter_readthrough_rate"), F.count("*").alias("n"))


def motif_pairs(reads: DataFrame, fasta: DataFrame, k: int = 4, min_mapq: int = 30, chunk: int = 65536, keep: list[str] | None = None) -> DataFrame:
    """rec_ord (and the columns `keep`), kind (used, skipped_non_acgt, skipped_oob), and the 5' and 3' k-mers p5 and p3 of each proper pair.

    fasta: contig, chunk_no, seq, in chunks of `chunk` bases that overlap by k - 1, so only the chunks
    of fragment ends are joined, one end after the other, and no contig is moved whole. reads need `contig`.
    """
    pairs = reads.where(flags.leftmost_proper_mate(min_mapq)).select(*dict.fromkeys(["rec_ord", "contig", "pos", "tlen", *(keep or [])]))
    for name, at in (("p5", F.col("pos")), ("p3", F.col("pos") + F.col("tlen") - k)):
        own = fasta.select(F.col("contig").alias("__c"), F.col("chunk_no").alias("__n"), F.col("seq").alias("__seq"))
        found = pairs.join(own, (F.col("contig") == F.col("__c")) & (F.floor(at / chunk) == F.col("__n")), "left")
        pairs = found.withColumn(name, F.upper(F.substring("__seq", (F.pmod(at, F.lit(chunk)) + 1).cast("int"), F.lit(k)))).drop("__c", "__n", "__seq")
    inside = (F.col("tlen") >= k) & (F.length("p5") == k) & (F.length("p3") == k)
    clean = kmers.valid(F.col("p5"), k) & kmers.valid(F.col("p3"), k)
    kind = F.when(F.coalesce(inside, F.lit(False)), F.when(clean, "used").otherwise("skipped_non_acgt")).otherwise("skipped_oob")
    return pairs.select("rec_ord", *(keep or []), kind.alias("kind"), "p5", kmers.reverse_complement("p3").alias("p3"))


def motif_rows(pairs: DataFrame, *keep: str) -> DataFrame:
    """end and kmer of both ends of the used pairs."""
    motif = lambda end, c: F.struct(F.lit(end).alias("end"), F.col(c).alias("kmer"))
    return pairs.where("kind = 'used'").select(*keep, F.explode(F.array(motif("5p", "p5"), motif("3p", "p3"))).alias("m")).select(*keep, "m.end", "m.kmer")


def end_motifs(reads: DataFrame, fasta: DataFrame, k: int = 4, min_mapq: int = 30, chunk: int = 65536) -> DataFrame:
    """Counts of 5' and 3' k-mers of fragments from the reference, and of used and skipped pairs."""
    pairs = motif_pairs(reads, fasta, k, min_mapq, chunk)
    tallies = pairs.groupBy("kind").agg(F.count("*").alias("n")).select(F.col("kind").alias("end"), F.lit(None).cast("string").alias("kmer"), "n")
    return motif_rows(pairs).groupBy("end", "kmer").agg(F.count("*").alias("n")).unionByName(tallies)


def soft_clips(reads: DataFrame, min_mapq: int = 30, k: int = 4) -> DataFrame:
    """Clip-length bins and end 4-mers of clipped ends, by read-oriented end."""
    rev = flags.has(flags.REVERSE)
    lead, trail = cigar.leading_clip(), cigar.trailing_clip()
    kept = reads.where(flags.primary_mapped(min_mapq)).select(F.when(rev, trail).otherwise(lead).alias("c5"), F.when(rev, lead).otherwise(trail).alias("c3"), F.when(rev, kmers.reverse_complement("seq")).otherwise(F.upper("seq")).alias("s"))
    end = lambda name, c, m: F.struct(F.lit(name).alias("end"), c.alias("clip"), m.alias("kmer"))
    ends = kept.select(F.explode(F.array(end("5p", F.col("c5"), F.substring("s", 1, k)), end("3p", F.col("c3"), F.expr(f"right(s, {k})")))).alias("x")).select("x.*").where("clip > 0")
    return ends.where(kmers.valid(F.col("kmer"), k)).groupBy("end", kmers.clip_bin(F.col("clip")).alias("clip_bin"), "kmer").agg(F.count("*").alias("n"))


def clip_rates(reads: DataFrame, min_mapq: int = 30) -> DataFrame:
    rev = flags.has(flags.REVERSE)
    lead, trail = cigar.leading_clip() > 0, cigar.trailing_clip() > 0
    n5, n3 = F.count_if(F.when(rev, trail).otherwise(lead)), F.count_if(F.when(rev, lead).otherwise(trail))
    return reads.where(flags.primary_mapped(min_mapq)).agg(kmers.ratio(n5, F.count("*")).alias("rate_5p"), kmers.ratio(n3, F.count("*")).alias("rate_3p"), F.count("*").alias("n"))


def periodicity(hist: DataFrame, low: int = 50, high: int = 500, size: int = 512) -> dict[str, float | None]:
    """Spectrum of the length histogram, its mean removed; at most 1001 rows reach the driver."""
    counts = np.zeros(high - low + 1)
    for r in hist.where(F.col("tlen").between(low, high)).collect():
        counts[r.tlen - low] = r.n
    if not counts.any():
        return {"total_power": 0.0, "nucleosomal_fraction": 0.0, "helical_fraction": 0.0, "peak_period": None, "peak_power": 0.0}
    power = np.abs(np.fft.rfft(counts - counts.mean(), size)) ** 2
    total = power[1:].sum()
    # whole-number division puts every nucleosomal period in one bin, and the helical ones in two
    nucleosomal = power[[size // p for p in (145, 170)]].mean()
    helical = power[[size // 10, size // 11]].mean()
    peak = 2 + int(np.argmax(power[2:]))
    share = lambda x: float(x / total) if total else 0.0
    return {"total_power": float(total), "nucleosomal_fraction": share(nucleosomal), "helical_fraction": share(helical), "peak_period": size // peak, "peak_power": share(power[peak])}


def splice_motifs(found: DataFrame, fasta: DataFrame, chunk: int = 65536) -> DataFrame:
    """Distinct junctions (contig, s, e) by their dinucleotides."""
    places = found.select("contig", "s", "e", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("s").alias("at")), F.struct(F.lit("r").alias("side"), (F.col("e") - 2).alias("at")))).alias("x")).select("contig", "s", "e", "x.side", "x.at", F.floor(F.col("x.at") / chunk).alias("chunk_no")).distinct()
    seen = places.join(fasta, ["contig", "chunk_no"], "left").withColumn("m", F.substring("seq", (F.pmod("at", F.lit(chunk)) + 1).cast("int"), F.lit(2)))
    both = seen.groupBy("contig", "s", "e").agg(F.max(F.when(F.col("side") == "l", F.col("m"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("m"))).alias("r"))
    kind = F.when((F.length("l") == 2) & (F.length("r") == 2), kmers.splice_class(F.col("l"), F.col("r"))).otherwise("oob")
    return both.select(kind.alias("class")).groupBy("class").agg(F.count("*").alias("n"))
