import itertools
import random

import pytest
from pyspark.sql import functions as F

from helixmill.functions import cigar, flags, kmers, numbers


def walk(text, start, emit, advance):
    """Blocks by a plain loop."""
    out, p, n = [], start, ""
    for c in text:
        if c.isdigit():
            n += c
            continue
        if c in emit:
            out.append((p, p + int(n)))
        if c in emit + advance:
            p += int(n)
        n = ""
    return out


DIALECTS = [(cigar.aligned_blocks, "M=X", "DN"), (cigar.exon_blocks, "M", "DNS"), (cigar.introns, "N", "MD"), (cigar.span_blocks, "M", "=XNDIS"), (cigar.position_blocks, "M=X", "DNS")]


def test_each_operation_under_each_dialect(spark):
    rng = random.Random(0)
    texts = ["50M", "*", "5S10M100N20M2I3M1D4M", "3H2P4=5X6M"] + ["".join(f"{rng.randrange(1, 9)}{o}" for o in ops) for ops in itertools.product("MIDNSHP=X", repeat=2)]
    df = spark.createDataFrame([(t, 1000) for t in texts], "cigar string, pos long")
    for f, emit, advance in DIALECTS:
        for r in df.select("cigar", f().alias("b")).collect():
            assert [(b.s, b.e) for b in r.b] == walk(r.cigar, 1000, emit, advance), (f.__name__, r.cigar)
    r = df.where("cigar = '5S10M100N20M2I3M1D4M'").select(cigar.aligned_blocks().alias("b"), cigar.query_length().alias("q"), cigar.intron_length().alias("n"), cigar.leading_clip().alias("l"), cigar.trailing_clip().alias("t")).first()
    assert [(b.s, b.e, b.q) for b in r.b] == [(1000, 1010, 5), (1110, 1130, 15), (1130, 1133, 37), (1134, 1138, 40)]
    assert (r.q, r.n, r.l, r.t) == (39, 100, 5, 0)


def test_filters_bit_by_bit(spark):
    df = spark.range(4096).select(F.col("id").cast("int").alias("flag"), F.lit(1).alias("tid"), F.lit(1).alias("mtid"), F.lit(30).alias("mapq"), F.lit(100).alias("tlen"))
    ids = lambda c: {r.flag for r in df.where(c).collect()}
    assert ids(flags.leftmost_proper_mate()) == {f for f in range(4096) if not f & 0xF0C and f & 3 == 3}
    assert ids(flags.primary_mapped()) == {f for f in range(4096) if not f & 0xF04}
    assert ids(flags.counted(True)) == {f for f in range(4096) if not f & 0xA04 and f & 1}
    assert ids(flags.standard(None)) == {f for f in range(4096) if not f & 0x704}
    assert ids(flags.duplication_filter()) == {f for f in range(4096) if not f & 0x204}


@pytest.mark.parametrize("library", ["unstranded", "forward", "reverse"])
def test_strand_rule(spark, library):
    rows = [(f, s) for f in (0, 16, 65, 81, 129, 145) for s in "+-."]
    for r in spark.createDataFrame(rows, "flag int, strand string").withColumn("ok", flags.strand_agrees(library)).collect():
        read = "-" if bool(r.flag & 16) != bool(r.flag & 1 and r.flag & 128) else "+"
        want = True if library == "unstranded" or r.strand == "." else (read == r.strand) == (library == "forward")
        assert r.ok == want


def test_names_and_motifs(spark):
    names = ["chr1", "22", "chr23", "X", "chrY", "CHRy", "chrM", "MT", "GL1", "chr01"]
    got = {r.n: (r.a, r.y, r.c) for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", flags.autosome(F.col("n")).alias("a"), flags.chrom_y(F.col("n")).alias("y"), flags.canonical(F.col("n")).alias("c")).collect()}
    assert [n for n in names if got[n][0]] == ["chr1", "22"] and [n for n in names if got[n][1]] == ["chrY", "CHRy"]
    assert not got["GL1"][2] and not got["chr23"][2] and got["chrM"][2]
    pairs = [("GT", "AG", "gt_ag"), ("CT", "AC", "gt_ag"), ("gc", "ag", "gc_ag"), ("CT", "GC", "gc_ag"), ("AT", "AC", "at_ac"), ("GT", "AT", "at_ac"), ("AA", "AG", "other")]
    for r in spark.createDataFrame(pairs, "a string, b string, w string").withColumn("g", kmers.splice_class(F.col("a"), F.col("b"))).collect():
        assert r.g == r.w
    edges = [(0, "lt_50"), (49, "lt_50"), (50, "50_80"), (79, "50_80"), (80, "80_120"), (199, "160_200"), (499, "300_500"), (500, "gt_500"), (1000, "gt_500")]
    for r in spark.createDataFrame(edges, "v int, w string").withColumn("g", kmers.tlen_bin(F.col("v"))).collect():
        assert r.g == r.w


def test_entropy(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 4), ("b", 0), ("c", 0)], "g string, n int")
    got = {r.g: r.entropy for r in kmers.entropy(df, ["g"]).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": None}


def test_number_formats():
    cases = {0.1: "0.1", 1e5: "1e+05", 123456.0: "123456", 1e-5: "1e-05", 0.0001: "1e-04", 0.00012: "0.00012", 2 / 3: "0.666666666666667", 100.0: "100", 1e15: "1e+15", 0.0: "0", 229660.940071126: "229660.940071126"}
    for v, s in cases.items():
        assert numbers.sig15(v) == s
    assert [numbers.sig15(x) for x in (None, float("nan"), float("inf"), -float("inf"))] == ["NA", "NA", "Inf", "-Inf"]
    assert numbers.depth_percentile([1, 2, 3, 4], 50) == 2.5 and numbers.depth_percentile([1, 2], 1) == 1 and numbers.depth_percentile([], 5) == 0
    assert numbers.pretty_breaks(0, 10) == [0, 2, 4, 6, 8, 10] and numbers.c_exponent(0.0012) == "1.200000e-03"
