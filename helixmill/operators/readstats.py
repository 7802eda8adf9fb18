"""Counters and histograms of records."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar, flags
from ..functions.flags import none_of
from ..functions.numbers import depth_percentile

has = flags.has


def flagstat(reads: DataFrame) -> DataFrame:
    """One pass; pair counters are of primary records."""
    n = lambda c: F.count_if(c)
    prim, pair = flags.primary(), flags.primary() & has(flags.PAIRED)
    mapped = ~has(flags.UNMAPPED)
    both = pair & mapped & ~has(flags.MATE_UNMAPPED)
    elsewhere = both & (F.col("mtid") != F.col("tid"))
    return reads.agg(
        F.count("*").alias("total"),
        n(prim).alias("primary_reads"),
        n(has(flags.SECONDARY)).alias("secondary"),
        n(has(flags.SUPPLEMENTARY)).alias("supplementary"),
        n(~has(flags.QCFAIL) & has(flags.DUPLICATE)).alias("duplicates"),
        n(prim & has(flags.DUPLICATE)).alias("primary_duplicates"),
        n(mapped).alias("mapped"),
        n(prim & mapped).alias("primary_mapped"),
        n(pair).alias("paired"),
        n(pair & has(flags.FIRST)).alias("read1"),
        n(pair & has(flags.SECOND)).alias("read2"),
        n(pair & has(flags.PROPER)).alias("properly_paired"),
        n(both).alias("both_mapped"),
        n(pair & mapped & has(flags.MATE_UNMAPPED)).alias("singletons"),
        n(elsewhere).alias("mate_elsewhere"),
        n(elsewhere & (F.col("mapq") >= 5)).alias("mate_elsewhere_q5"),
    )


def cascade(min_mapq: int = 30) -> Column:
    """The first rule that a record meets."""
    return F.when(has(flags.QCFAIL), "qc_failed").when(has(flags.DUPLICATE), "duplicate").when(has(flags.SECONDARY), "non_primary").when(has(flags.UNMAPPED), "unmapped").when(F.col("mapq") < min_mapq, "non_unique").otherwise("unique")


def bam_stat(reads: DataFrame, min_mapq: int = 30) -> DataFrame:
    unique = F.col("kind") == "unique"
    n = lambda c: F.count_if(unique & c)
    kinds = ["qc_failed", "duplicate", "non_primary", "unmapped", "non_unique", "unique"]
    spliced = F.col("cigar").contains("N")
    proper = has(flags.PAIRED) & has(flags.PROPER)
    return reads.withColumn("kind", cascade(min_mapq)).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds],
        n(has(flags.FIRST)).alias("read1"),
        n(has(flags.SECOND)).alias("read2"),
        n(~has(flags.REVERSE)).alias("plus"),
        n(has(flags.REVERSE)).alias("minus"),
        n(spliced).alias("spliced"),
        n(~spliced).alias("non_spliced"),
        n(proper).alias("proper_pairs"),
        n(proper & (F.col("mtid") != F.col("tid"))).alias("proper_elsewhere"),
    )


def idxstats(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """All contigs, and records without one as *."""
    per = reads.groupBy("tid").agg(F.count_if(~has(flags.UNMAPPED)).alias("mapped"), F.count_if(has(flags.UNMAPPED)).alias("unmapped"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    placed = contigs.join(per, "tid", "left").select("tid", "name", "length", zero("mapped"), zero("unmapped"))
    lost = reads.where(F.col("tid").isNull() | (F.col("tid") < 0)).agg(F.count("*").alias("unmapped"))
    return placed.unionByName(lost.select(F.lit(-1).alias("tid"), F.lit("*").alias("name"), F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("mapped"), "unmapped"))


#: Fixed value: the four-bit codes of bases, in order.
BASE_CODES = "=ACMGRSVTWYHKDBN"


def _orientation() -> Column:
    """F18."""
    first = F.when(has(flags.FIRST), 1).otherwise(-1)
    side, forward = first * F.signum(F.col("mpos") - F.col("pos")), first * F.when(has(flags.REVERSE), -1).otherwise(1)
    return F.when(has(flags.REVERSE) == has(flags.MATE_REVERSE), "other").when((side == 0) | (side * forward > 0), "inward").otherwise("outward")


def insert_sizes(reads: DataFrame, most: int = 8000) -> DataFrame:
    """Template sizes, cut at most, by orientation: n mates and half as many pairs."""
    kept = flags.primary() & has(flags.PAIRED) & none_of(flags.UNMAPPED | flags.MATE_UNMAPPED) & (F.col("tlen") != 0)
    per = reads.where(kept).groupBy(F.least(F.abs("tlen"), F.lit(most)).alias("size"), _orientation().alias("orientation")).agg(F.count("*").alias("n"))
    return per.withColumn("pairs", F.floor(F.col("n") / 2))


def bulk(sizes: DataFrame, share: float = 0.99) -> DataFrame:
    """Mean and population SD over the smallest sizes up to the first that brings their part over share."""
    flat = sizes.groupBy("size").agg(F.sum("n").alias("n"))
    w = Window.orderBy("size")  # at most 8001 rows
    total = F.sum("n").over(Window.partitionBy())
    upto = F.sum("n").over(w)
    kept = flat.withColumn("before", (upto - F.col("n")) / total).where(F.col("before") <= share)
    mean = F.sum(F.col("size") * F.col("n")) / F.sum("n")
    return kept.agg(mean.alias("insert_mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("size") * F.col("size") * F.col("n")) / F.sum("n") - mean * mean)).alias("insert_sd"), F.sum("n").alias("n_mates"))


def summary(reads: DataFrame, quality: Column) -> DataFrame:
    """Scalars of the summary section in one pass; quality is an array<int>.

    Records that are filtered, unmapped or duplicates are those of the first-match cascade (A07).
    """
    prim, pair = flags.primary(), has(flags.PAIRED)
    mapped, dup = ~has(flags.UNMAPPED), has(flags.DUPLICATE)
    good, last = prim & ~has(flags.QCFAIL), pair & has(flags.SECOND)
    length = F.length("seq").cast("long")
    cig = mapped & ~has(flags.SECONDARY)
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    most = lambda c: F.coalesce(F.max(F.when(c, length)), F.lit(0).cast("long"))
    mean = lambda c: F.coalesce(F.round(total(c, length) / F.nullif(F.count_if(c), F.lit(0))), F.lit(0)).cast("long")
    q_sum = F.aggregate(quality, F.lit(0).cast("long"), lambda a, x: a + x)
    bases, wrong = total(cig, cigar.length_of("cigar", "M=XI")), total(prim & mapped, F.greatest(F.col("nm"), F.lit(0)))
    proper = F.count_if(prim & pair & has(flags.PROPER))
    return reads.agg(
        F.count_if(prim).alias("raw_total"),
        F.count_if(has(flags.QCFAIL)).alias("filtered"),
        (F.count_if(prim) - F.count_if(has(flags.QCFAIL))).alias("sequences"),
        F.count_if(prim & ~last).alias("first_fragments"),
        F.count_if(prim & last).alias("last_fragments"),
        F.count_if(prim & mapped).alias("reads_mapped"),
        F.count_if(good & mapped & pair & ~has(flags.MATE_UNMAPPED)).alias("reads_mapped_and_paired"),
        F.count_if(cascade() == "unmapped").alias("reads_unmapped"),
        proper.alias("reads_properly_paired"),
        F.count_if(prim & pair).alias("reads_paired"),
        F.count_if(prim & dup).alias("reads_duplicated"),
        F.count_if(prim & mapped & (F.col("mapq") == 0)).alias("reads_mq0"),
        F.count_if(has(flags.SECONDARY)).alias("secondary"),
        F.count_if(has(flags.SUPPLEMENTARY)).alias("supplementary"),
        total(prim, length).alias("total_length"),
        total(prim & ~last, length).alias("total_first_fragment_length"),
        total(prim & last, length).alias("total_last_fragment_length"),
        total(prim & mapped, length).alias("bases_mapped"),
        bases.alias("bases_mapped_cigar"),
        total(prim & dup, length).alias("bases_duplicated"),
        wrong.alias("mismatches"),
        F.when(bases > 0, wrong / bases).otherwise(0.0).alias("error_rate"),
        mean(prim).alias("average_length"),
        mean(prim & ~last).alias("average_first_fragment_length"),
        mean(prim & last).alias("average_last_fragment_length"),
        most(prim).alias("maximum_length"),
        most(prim & ~last).alias("maximum_first_fragment_length"),
        most(prim & last).alias("maximum_last_fragment_length"),
        F.coalesce(total(good, q_sum) / F.nullif(total(good, F.size(quality)), F.lit(0)), F.lit(0.0)).alias("average_quality"),
        F.count_if(prim & pair & mapped & ~has(flags.MATE_UNMAPPED) & (F.col("mtid") != F.col("tid")) & (F.col("mapq") >= 5)).alias("pairs_on_different_chromosomes"),
        F.when(F.count_if(prim) > 0, 100.0 * proper / F.count_if(prim)).otherwise(0.0).alias("percentage_properly_paired"),
    )


def orientations(reads: DataFrame) -> DataFrame:
    """Pairs by orientation, half of the mates; mates at one place of one contig count too, though their size is 0."""
    kept = flags.primary() & has(flags.PAIRED) & none_of(flags.UNMAPPED | flags.MATE_UNMAPPED) & ((F.col("tlen") != 0) | (F.col("tid") == F.col("mtid")))
    n = lambda k: F.floor(F.count_if(_orientation() == k) / 2)
    return reads.where(kept).agg(n("inward").alias("inward_oriented_pairs"), n("outward").alias("outward_oriented_pairs"), n("other").alias("pairs_with_other_orientation"))


def checksums(reads: DataFrame) -> DataFrame:
    """sums (of 32 bits) of the CRC-32 of all records' names, sequences (four bits a base, two bases a byte) and qualities (without their offset)."""
    codes = F.translate(F.upper("seq"), BASE_CODES, "0123456789ABCDEF")
    packed = F.unhex(F.when(F.length(codes) % 2 == 1, F.concat(codes, F.lit("0"))).otherwise(codes))
    shown = F.unhex(F.array_join(F.transform(F.split("qual", ""), lambda c: F.lpad(F.hex(F.ascii(c) - 33), 2, "0")), ""))
    part = lambda c, cond: F.pmod(F.coalesce(F.sum(F.when(cond, F.crc32(c))), F.lit(0)), F.lit(1 << 32))
    some = (F.col("seq") != "*") & (F.length("seq") > 0)
    none = F.unhex(F.repeat(F.lit("FF"), F.length("seq")))  # no qualities: each byte is 255
    return reads.agg(part(F.col("qname").cast("binary"), F.lit(True)).alias("names"), part(packed, some).alias("sequences"), part(F.when(F.col("qual") == "*", none).otherwise(shown), some).alias("qualities"))


def lengths(reads: DataFrame) -> DataFrame:
    """A10: read lengths of all, first and last fragments."""
    which = F.explode(F.array_compact(F.array(F.lit("RL"), F.when(has(flags.SECOND), "LRL").otherwise("FRL"))))
    return reads.where(flags.primary()).select(F.length("seq").alias("length"), which.alias("section")).groupBy("section", "length").agg(F.count("*").alias("n"))


def mapping_qualities(reads: DataFrame) -> DataFrame:
    return reads.where(flags.primary() & none_of(flags.QCFAIL | flags.DUPLICATE | flags.UNMAPPED)).groupBy("mapq").agg(F.count("*").alias("n"))


def tallies(reads: DataFrame, values: Column) -> DataFrame:
    """is_last, rev, cycle, v and n: how many primary records have the value v at a read-oriented cycle (F17, from 0).

    values: array<int>, or a string, whose bytes are the values. Each task adds whole Arrow batches
    to one table of counts, so no row is made for a base.
    """
    source = reads.where(flags.primary()).select("flag", values.alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bool, bool], np.ndarray] = {}
        for batch in batches:
            flag, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(column) if pa.types.is_string(column.type) else pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if pa.types.is_string(column.type):
                flat = np.frombuffer("".join(x or "" for x in column.to_pylist()).encode("latin-1", "replace"), np.uint8).astype(np.int64)
            else:
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
            rev, last = (flag & flags.REVERSE) > 0, (flag & flags.SECOND) > 0
            row = np.repeat(np.arange(len(flag)), sizes)
            cycle = np.where(rev[row], sizes[row] - 1 - place, place)
            for key in {(bool(a), bool(b)) for a, b in zip(last, rev, strict=True)}:
                on = (last[row] == key[0]) & (rev[row] == key[1]) & (flat >= 0) & (flat < 256)
                if on.any():
                    counts = np.bincount(cycle[on] * 256 + flat[on])
                    old = found.get(key, np.zeros(0, np.int64))
                    new = np.zeros(max(len(old), len(counts)), np.int64)
                    new[: len(old)] += old
                    new[: len(counts)] += counts
                    found[key] = new
        for (last, rev), counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"is_last": pa.array(np.full(len(at), last)), "rev": pa.array(np.full(len(at), rev)), "cycle": pa.array((at // 256).astype(np.int32)), "v": pa.array((at % 256).astype(np.int32)), "n": pa.array(counts[at])})

    return source.mapInArrow(run, "is_last boolean, rev boolean, cycle int, v int, n long").groupBy("is_last", "rev", "cycle", "v").agg(F.sum("n").alias("n"))


def quality_by_cycle(reads: DataFrame, quality: Column, cap: int = 63) -> DataFrame:
    """Counts by first or last fragment, cycle and quality."""
    return tallies(reads, quality).groupBy("is_last", "cycle", F.least("v", F.lit(cap)).alias("quality")).agg(F.sum("n").alias("n"))


def cycle_quality(reads: DataFrame, quality: Column, most: int = 200) -> DataFrame:
    """Mean quality by cycle."""
    found = tallies(reads.where(flags.primary_mapped(0)), quality).where(F.col("cycle") < most).groupBy("is_last", "cycle")
    return found.agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean_quality"), F.sum("n").alias("n"))


def bases_by_cycle(reads: DataFrame, oriented: bool = False) -> DataFrame:
    """Counts and percent of A, C, G and T by cycle (percent of these four); oriented: as sequenced (GCT)."""
    base = F.chr(F.col("v"))
    shown = F.when(F.col("rev"), F.translate(base, "ACGT", "TGCA")).otherwise(base) if oriented else base
    rows = tallies(reads, F.col("seq")).select("is_last", "cycle", shown.alias("base"), "n").where("base in ('A','C','G','T')").groupBy("is_last", "cycle", "base").agg(F.sum("n").alias("n"))
    return rows.select("is_last", "cycle", "base", "n", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("is_last", "cycle"))).alias("percent"))


def total_bases(reads: DataFrame) -> DataFrame:
    """FTC and LTC: A, C, G, T and N of first and last fragments."""
    n = lambda b: F.coalesce(F.sum(F.when(F.col("v") == ord(b), F.col("n"))), F.lit(0)).alias(b.lower())
    return tallies(reads, F.upper("seq")).groupBy("is_last").agg(*[n(b) for b in "ACGTN"])


def gc_steps(reads: DataFrame, bins: int = 200) -> DataFrame:
    """For each of 200 steps of GC content, the reads whose content lies there, as a step function over the read's bin range."""
    gc = F.length(F.regexp_replace("seq", "[^GC]", ""))
    n = F.length("seq")
    low, high = F.floor(gc * (bins - 1) / n).cast("int"), F.floor((gc + 1) * (bins - 1) / n).cast("int")
    rows = reads.where(flags.primary() & (F.length("seq") > 0)).select(has(flags.SECOND).alias("is_last"), low.alias("lo"), F.least(high, F.lit(bins - 1)).alias("hi"))
    counted = rows.groupBy("is_last", "lo", "hi").agg(F.count("*").alias("n")).where("hi > lo")
    return counted.select("is_last", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("bin"), "n").groupBy("is_last", "bin").agg(F.sum("n").alias("n"))


def runs(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Only rows whose value differs from the one before."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("__b", F.lag(value).over(w)).where(F.col("__b").isNull() | (F.col("__b") != F.col(value))).drop("__b")


def gc_plateaus(reads: DataFrame, bins: int = 200) -> DataFrame:
    """A12 as it is written: percent of GC in the middle of each run of equal counts, and the count; runs of none are left out."""
    sides = gc_steps(reads, bins).select("is_last").distinct()
    every = sides.crossJoin(F.broadcast(reads.sparkSession.range(bins - 1).select(F.col("id").cast("int").alias("bin"))))  # two sides, 199 bins
    full = every.join(gc_steps(reads, bins), ["is_last", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    starts = runs(full, ["is_last"], "bin", "n")
    last = F.coalesce(F.lead("bin").over(Window.partitionBy("is_last").orderBy("bin")), F.lit(bins - 1))
    return starts.withColumn("upto", last).where("n > 0").select("is_last", ((F.col("bin") + F.col("upto") - 1) * 0.5 * 100 / (bins - 1)).alias("percent"), "n")


def indels(reads: DataFrame) -> DataFrame:
    """Insertions and deletions by size."""
    ops = reads.where(none_of(flags.UNMAPPED | flags.SECONDARY)).select(F.explode(cigar.ops("cigar")).alias("o")).where("o.op in ('I', 'D')")
    return ops.groupBy(F.col("o.len").alias("size")).agg(F.count_if(F.col("o.op") == "I").alias("insertions"), F.count_if(F.col("o.op") == "D").alias("deletions"))


def indels_by_cycle(reads: DataFrame) -> DataFrame:
    """Indels by read-oriented cycle; a deletion at cycle 0 is left out."""
    zero = F.struct(F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<op:string,q:bigint,len:bigint>>").alias("out"))
    step = lambda a, o: F.struct((a.q + F.when(o.op.isin("M", "I", "=", "X", "S"), o.len).otherwise(0)).alias("q"), F.when(o.op.isin("I", "D"), F.concat(a.out, F.array(F.struct(o.op.alias("op"), a.q.alias("q"), o.len.alias("len"))))).otherwise(a.out).alias("out"))
    found = reads.where(none_of(flags.UNMAPPED | flags.SECONDARY)).select("flag", F.length("seq").alias("n"), F.explode(F.aggregate(cigar.ops("cigar"), zero, step, lambda a: a.out)).alias("o"))
    found = found.where("o.op = 'I' or o.q > 0")
    rev = has(flags.REVERSE)
    cycle = F.when(F.col("o.op") == "I", F.when(rev, F.col("n") - F.col("o.q") - F.col("o.len")).otherwise(F.col("o.q"))).otherwise(F.when(rev, F.col("n") - F.col("o.q") - 1).otherwise(F.col("o.q") - 1))
    return found.select(has(flags.SECOND).alias("is_last"), cycle.alias("cycle"), F.col("o.op").alias("op")).groupBy("cycle", "is_last", "op").agg(F.count("*").alias("n"))


def depth_histogram(reads: DataFrame, most: int = 1000) -> DataFrame:
    """Bases by depth, from the depth's steps at block edges (W06); depths over most count as most + 1.

    Edges are summed first. Depth is a running sum within stretches of 64 kb, onto which the sum of
    all earlier stretches of the contig is added, so no contig needs one task.
    """
    stretch = 1 << 16
    blocks = reads.where(none_of(flags.UNMAPPED | flags.SECONDARY)).select("tid", F.explode(cigar.aligned_blocks()).alias("b"))
    edges = blocks.select("tid", F.explode(F.array(F.struct(F.col("b.s").alias("p"), F.lit(1).alias("d")), F.struct(F.col("b.e").alias("p"), F.lit(-1).alias("d")))).alias("x"))
    steps = edges.groupBy("tid", F.col("x.p").alias("p")).agg(F.sum("x.d").alias("d")).withColumn("part", F.floor(F.col("p") / stretch))
    sums = steps.groupBy("tid", "part").agg(F.sum("d").alias("d"), F.min("p").alias("first"))
    w = Window.partitionBy("tid").orderBy("part")  # a row for each stretch
    base = sums.select("tid", "part", (F.sum("d").over(w) - F.col("d")).alias("base"), F.lead("first").over(w).alias("after"))
    here = Window.partitionBy("tid", "part").orderBy("p")
    walked = steps.join(base, ["tid", "part"]).select((F.col("base") + F.sum("d").over(here)).alias("depth"), (F.coalesce(F.lead("p").over(here), F.col("after")) - F.col("p")).alias("len"))
    return walked.where("depth > 0 and len > 0").groupBy(F.least("depth", F.lit(most + 1)).alias("depth")).agg(F.sum("len").alias("n_bases"))


def gc_depth(reads: DataFrame, width: int = 20_000, stretch: int = 1 << 21) -> DataFrame:
    """Bins opened by the arrival of reads: a read more than width beyond the open bin's start opens the next.

    Reads come by place, as in a sorted file. Reads of one place are summed first. The bin that is
    open where a stretch of a contig begins follows from the stretch before it, so each stretch tells
    for each possible end of that bin which bin it leaves open; these few rows are followed along a
    contig; then each stretch, knowing its first bin, sums its places, and a bin's parts are added.
    """
    n = F.length("seq")
    kept = reads.where(none_of(flags.UNMAPPED | flags.SECONDARY) & (n > 0))
    rows = kept.groupBy("tid", "pos").agg(F.count("*").alias("n"), F.sum(F.length(F.regexp_replace("seq", "[^GC]", "")) / n).alias("gc")).withColumn("part", F.floor(F.col("pos") / stretch))

    def leads(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """For an open bin that ends before `upto` (and not before the row above), the start of the bin that is open behind the stretch."""
        places = np.sort(pdf.pos.to_numpy())
        nxt = np.searchsorted(places, places + width, "right")
        jump = np.where(nxt == len(places), np.arange(len(places)), np.minimum(nxt, len(places) - 1))
        while (jump[jump] != jump).any():
            jump = jump[jump]
        some = np.searchsorted(places, key[1] * stretch + width, "right") + 1  # an open bin began in the stretch before
        upto, left = places[:some], places[jump[:some]]
        ends = np.flatnonzero(np.append(left[1:] != left[:-1], True))
        return pd.DataFrame({"tid": key[0], "part": key[1], "upto": upto[ends], "left": left[ends]})

    def follow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The bin that is open where each stretch begins; -1 where none is."""
        now, out = -1, []
        for part, rows in pdf.sort_values(["part", "upto"]).groupby("part"):
            out.append((key[0], int(part), now))
            upto = rows.upto.to_numpy()
            k = int(np.searchsorted(upto, now + width if now >= 0 else -1, "right"))  # the first place beyond the open bin
            if k < len(upto):
                now = int(rows.left.iloc[k])
        return pd.DataFrame(out, columns=["tid", "part", "open"])

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        places, now = pdf.pos.to_numpy(), int(pdf.open.iloc[0])
        starts, names = [], []
        at = 0
        if now >= 0 and places[0] <= now + width:
            starts, names = [0], [now]
            at = int(np.searchsorted(places, now + width, "right"))
        while at < len(places):
            starts.append(at)
            names.append(places[at])
            at = int(np.searchsorted(places, places[at] + width, "right"))
        return pd.DataFrame({"tid": key[0], "bin_start": names, "depth": np.add.reduceat(pdf.n.to_numpy(), starts), "gc": np.add.reduceat(pdf.gc.to_numpy(), starts)})

    per = rows.groupBy("tid", "part")
    opened = per.applyInPandas(leads, "tid int, part long, upto long, left long").groupBy("tid").applyInPandas(follow, "tid int, part long, open long")
    parts = rows.join(opened, ["tid", "part"]).groupBy("tid", "part").applyInPandas(sums, "tid int, bin_start long, depth long, gc double")
    return parts.groupBy("tid", "bin_start").agg(F.sum("depth").alias("depth"), F.sum("gc").alias("gc_sum")).select("tid", "bin_start", "depth", "gc_sum", (F.col("gc_sum") / F.col("depth")).alias("gc"))


def gc_depth_report(bins: DataFrame, average_length: float, width: int = 20_000) -> list[tuple[float, ...]]:
    """For each whole percent of GC, the cumulated percent of bins and the 10th, 25th, 50th, 75th and 90th percentile of depth (scaled to coverage).

    The last bin keeps its plain sum of shares, and an empty bin comes first, so that the highest bin
    is not written. A row for each 20 kb of genome reaches the driver.
    """
    rows = bins.orderBy("tid", "bin_start").select("gc_sum", "depth").collect()
    if not rows:
        return []
    shown = [(r.gc_sum if k == len(rows) - 1 else math.floor(100 * r.gc_sum / r.depth + 0.5), r.depth) for k, r in enumerate(rows)]
    ordered = [(0.0, 0), *sorted(shown)]
    out, k, scale = [], 0, average_length / width
    while k < len(rows):
        first = k
        while k < len(rows) and abs(ordered[k][0] - ordered[first][0]) < 0.1:
            k += 1
        depths = [float(d) for _, d in ordered[first:k]]
        out.append((float(ordered[first][0]), (k + 1) * 100.0 / (len(rows) + 1), *(depth_percentile(depths, p) * scale for p in (10, 25, 50, 75, 90))))
    return out


def chrom_metrics(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Contigs with records, by name; pair sizes ask no mapping quality and keep duplicates."""
    prim = flags.primary()
    pair = prim & has(flags.PAIRED) & has(flags.PROPER) & none_of(flags.UNMAPPED | flags.MATE_UNMAPPED | flags.QCFAIL) & (F.col("tid") == F.col("mtid")) & (F.col("tlen") > 0)
    per = reads.where("tid >= 0").groupBy("tid").agg(
        F.count("*").alias("total"),
        F.count_if(~has(flags.UNMAPPED)).alias("mapped"),
        F.count_if(has(flags.DUPLICATE)).alias("duplicates"),
        F.count_if(pair).alias("proper_pairs"),
        F.coalesce(F.avg(F.when(pair, F.col("tlen"))), F.lit(0.0)).alias("mean_insert"),
    )
    share = F.sum("mapped").over(Window.partitionBy())  # a row for each contig
    return contigs.join(per, "tid").select("name", "length", "total", "mapped", "duplicates", (F.col("mapped") / share).alias("mapped_fraction"), "proper_pairs", "mean_insert")
