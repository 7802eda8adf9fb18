"""Read origin, transcript coverage and bias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar, flags
from . import intervals


def usable(reads: DataFrame) -> DataFrame:
    """What the cascade leaves: mapped, primary, no supplement, no quality failure, one hit."""
    return reads.where(flags.none_of(flags.UNMAPPED | flags.SECONDARY | flags.SUPPLEMENTARY | flags.QCFAIL) & (F.coalesce("nh", F.lit(1)) <= 1))


def cascade_counts(reads: DataFrame) -> DataFrame:
    mapped = ~flags.has(flags.UNMAPPED)
    return reads.agg(F.count_if(~mapped).alias("not_aligned"), F.count_if(mapped & (F.coalesce("nh", F.lit(1)) > 1)).alias("multi_mapped"), F.count_if(mapped & flags.has(flags.SECONDARY)).alias("secondary"), F.count_if(mapped & ~flags.has(flags.SECONDARY) & ~flags.has(flags.SUPPLEMENTARY) & ~flags.has(flags.QCFAIL)).alias("read_count"))


def _gaps(tx_exons: DataFrame) -> DataFrame:
    return intervals.gaps(tx_exons.select("tx_id", "tid", "s", "e"), ["tx_id"], ["tid"]).where("s < e").select("tid", F.col("s").alias("rs"), F.col("e").alias("re"))


def located(kept: DataFrame, exons: DataFrame, introns: DataFrame | None = None) -> DataFrame:
    """kept's reads that have M blocks, with `blocks`, `hits` (block i, gene_id, strand, s, e: each block and merged exon of a gene that encloses it), `touches` (a block overlaps an exon without lying in it) and `intronic` (J13: a block touches an intron; abutting is touching)."""
    merged = intervals.merge(exons, ["tid", "gene_id", "strand"]).select("tid", F.col("s").alias("rs"), F.col("e").alias("re"), "gene_id", "strand")
    # introns count only as covered bases, so their union will do
    union = None if introns is None else intervals.merge(introns.select("tid", F.col("rs").alias("s"), F.col("re").alias("e")), ["tid"]).select("tid", F.col("s").alias("rs"), F.col("e").alias("re"))
    targets = merged if union is None else merged.unionByName(union.select("tid", "rs", "re", F.lit(None).cast("string").alias("gene_id"), F.lit(None).cast("string").alias("strand")))
    rows = kept.withColumn("blocks", cigar.span_blocks()).where(F.size("blocks") > 0)
    first, last = F.get("blocks", F.lit(0))["s"], F.get("blocks", F.size("blocks") - 1)["e"]
    near = intervals.beside(rows, first, last, targets, ["tid"], ["gene_id", "strand"], closed=True)
    exon = lambda x: x.gene_id.isNotNull()
    inside = lambda x, b: (x.rs <= b.s) & (b.e <= x.re)
    own = lambda b, i: F.transform(F.filter("near", lambda x: exon(x) & inside(x, b)), lambda x: F.struct(i.alias("i"), x.gene_id.alias("gene_id"), x.strand.alias("strand"), b.s.alias("s"), b.e.alias("e")))
    touches = F.exists("near", lambda x: exon(x) & F.exists("blocks", lambda b: (b.s < x.re) & (x.rs < b.e) & ~inside(x, b)))
    intronic = F.exists("near", lambda x: ~exon(x) & F.exists("blocks", lambda b: (b.s <= x.re) & (x.rs <= b.e)))
    return near.select(*kept.columns, "blocks", F.flatten(F.transform("blocks", own)).alias("hits"), touches.alias("touches"), intronic.alias("intronic"))


def enclosing_genes(library: str = "unstranded") -> Column:
    """The genes whose merged exons enclose every block, from `hits` and `blocks`."""
    hits = F.col("hits")
    if library != "unstranded":
        flip = (flags.has(flags.FIRST) | ~flags.has(flags.PAIRED)) if library == "reverse" else (flags.has(flags.PAIRED) & ~flags.has(flags.FIRST))
        strand = F.when(flags.has(flags.REVERSE) != flip, "-").otherwise("+")
        hits = F.filter("hits", lambda h: h.strand == strand)
    genes = F.array_distinct(F.transform(hits, lambda h: h.gene_id))
    return F.array_sort(F.filter(genes, lambda g: F.size(F.array_distinct(F.transform(F.filter(hits, lambda h: h.gene_id == g), lambda h: h.i))) == F.size("blocks")))


def _pair_key() -> list:
    mine, mate = F.struct("tid", "pos"), F.struct(F.col("mtid").alias("tid"), F.col("mpos").alias("pos"))
    return [F.col("qname"), F.least(mine, mate).alias("a"), F.greatest(mine, mate).alias("b")]


def _proper() -> Column:
    return flags.has(flags.PAIRED) & flags.has(flags.PROPER)


def _used(reads: DataFrame) -> DataFrame:
    return usable(reads).select("qname", "tid", "pos", "mtid", "mpos", "flag", "cigar")


def strand_votes(reads: DataFrame, exons: DataFrame) -> DataFrame:
    """Votes for either library strand: a vote for each block and each gene that encloses it, of reads that count at once and of proper pairs of which both mates are left."""
    rows = located(_used(reads), exons)
    first = ~flags.has(flags.PAIRED) | flags.has(flags.FIRST)
    agrees = lambda h: F.when(flags.has(flags.REVERSE), h.strand == "-").otherwise(h.strand == "+") == first
    voted = rows.withColumn("fwd", F.size(F.filter("hits", agrees))).withColumn("rev", F.size("hits") - F.col("fwd"))
    both = voted.where(_proper()).groupBy(*_pair_key()).agg(F.count("*").alias("n"), F.sum("fwd").alias("fwd"), F.sum("rev").alias("rev")).where("n = 2")
    every = voted.where(~_proper()).select("fwd", "rev").unionByName(both.select("fwd", "rev"))
    return every.agg(F.coalesce(F.sum("fwd"), F.lit(0)).alias("ssp_fwd"), F.coalesce(F.sum("rev"), F.lit(0)).alias("ssp_rev"))


def origin(reads: DataFrame, exons: DataFrame, tx_exons: DataFrame, library: str = "unstranded") -> DataFrame:
    """Weights by origin. A proper pair waits for its mate and counts two; mates' gene sets are intersected; a lone mate is lost."""
    per = located(_used(reads), exons, _gaps(tx_exons)).withColumn("genes", enclosing_genes(library))
    rows = per.select("qname", "tid", "pos", "mtid", "mpos", _proper().alias("proper"), "genes", "intronic", "touches")
    lone = rows.where("not proper").select("genes", "intronic", "touches", F.lit(1).alias("weight"))
    pairs = rows.where("proper").groupBy(*_pair_key()).agg(F.count("*").alias("n"), F.collect_list("genes").alias("g"), F.bool_or("intronic").alias("intronic"), F.bool_or("touches").alias("touches")).where("n = 2")
    paired = pairs.select(F.array_intersect(F.col("g")[0], F.col("g")[1]).alias("genes"), "intronic", "touches", F.lit(2).alias("weight"))
    n = F.size("genes")
    kind = F.when(n == 1, "exonic").when(n > 1, "ambiguous").when(F.col("intronic"), "intronic").otherwise("intergenic")
    # one pass: each row tells its origin, and once more that it touches an exon
    told = F.array_compact(F.array(F.struct(kind.alias("origin"), F.col("weight").alias("w")), F.when(F.col("touches"), F.struct(F.lit("overlapping_exon").alias("origin"), F.lit(1).alias("w")))))
    out = lone.unionByName(paired).select(F.explode(told).alias("t")).groupBy("t.origin").agg(F.sum("t.w").alias("n"))
    zero = reads.sparkSession.createDataFrame([("overlapping_exon", 0)], "origin string, n long")
    return out.unionByName(zero).groupBy("origin").agg(F.sum("n").alias("n"))


def read_junctions(reads: DataFrame) -> DataFrame:
    """Each skipped stretch of usable reads with M blocks: tid, its first and last place as the report reckons them (start + bases of the read before it, 1-based; its length further on), and the read's two bases on either side."""
    skips = F.transform(cigar.fold("cigar", F.lit(0), "N", "", "M=XIS"), lambda b: F.struct((b.q + F.col("pos") + 1).alias("p1"), (b.q + F.col("pos") + 1 + b.e - b.s).alias("p2"), b.q.alias("q")))
    kept = usable(reads).where(F.col("cigar").contains("N") & F.col("cigar").contains("M")).select("tid", "seq", F.explode(skips).alias("j"))
    two = lambda at: F.upper(F.substring("seq", (at + 1).cast("int"), F.lit(2)))
    seen = (F.col("j.q") > 2) & (F.col("j.q") + 1 < F.length("seq"))
    return kept.select("tid", "j.p1", "j.p2", F.when(seen, F.concat(two(F.col("j.q") - 2), F.lit("/"), two(F.col("j.q")))).alias("motif"))


def junction_support(reads: DataFrame, tx_exons: DataFrame) -> DataFrame:
    """reads' junctions by how many ends lie within one base of an annotated boundary (the last base of an exon, the first of the next)."""
    marks = _gaps(tx_exons).select("tid", F.explode(F.array(F.col("rs"), F.col("re") + 1)).alias("b")).select("tid", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("p")).distinct()
    out = read_junctions(reads).select("tid", "p1", "p2")
    for k in ("p1", "p2"):
        out = out.join(marks.select("tid", F.col("p").alias(k), F.lit(1).alias(f"k{k}")), ["tid", k], "left")
    n = F.coalesce("kp1", F.lit(0)) + F.coalesce("kp2", F.lit(0))
    return out.select(F.when(n == 2, "known").when(n == 1, "partly_known").otherwise("novel").alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def junction_motifs(reads: DataFrame, most: int = 11) -> DataFrame:
    """The commonest pairs of bases beside reads' junctions, in percent of all junctions; ties by name."""
    found = read_junctions(reads)
    total = found.agg(F.count("*").alias("all"))
    per = found.where("motif is not null").groupBy("motif").agg(F.count("*").alias("n"))  # at most 17^4 rows
    return per.crossJoin(F.broadcast(total)).select("motif", "n", (100.0 * F.col("n") / F.col("all")).alias("percent")).orderBy(F.desc("n"), "motif").limit(most)


def transcript_coverage(reads: DataFrame, exons: DataFrame, tx_exons: DataFrame) -> DataFrame:
    """tx_id, strand, total, and depth by exonic place: counted reads' blocks that a gene's merged exon encloses, without each block's last base, on that gene's transcripts.

    tx_exons: tx_id, gene_id, tid, strand, s, e. Places run through the exons in order, on the minus
    strand from the last exon to the first, and through each exon's bases upward on either strand.
    """
    own = F.transform("hits", lambda h: F.struct(h.gene_id.alias("gene_id"), h.s.alias("s"), (h.e - 1).alias("e")))
    rows = located(_used(reads), exons).select("qname", "tid", "pos", "mtid", "mpos", _proper().alias("proper"), own.alias("own"))
    both = rows.where("proper").groupBy(*_pair_key()).agg(F.collect_list("own").alias("own")).where(F.size("own") == 2).select(F.flatten("own").alias("own"))
    inside = rows.where("not proper").select("own").unionByName(both).select(F.explode("own").alias("h")).select("h.*")
    blocks = inside.where("s < e").groupBy("gene_id", "s", "e").agg(F.count("*").alias("k"))
    order = F.when(F.col("strand") == "-", -F.col("s")).otherwise(F.col("s"))
    before = Window.partitionBy("tx_id", "gene_id", "tid", "strand").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = tx_exons.select("tx_id", "gene_id", "tid", "strand", "s", "e").withColumn("before", F.coalesce(F.sum(F.col("e") - F.col("s")).over(before), F.lit(0))).withColumn("total", F.sum(F.col("e") - F.col("s")).over(Window.partitionBy("tx_id")))
    hits = blocks.join(parts.select("gene_id", "tx_id", "strand", "total", "before", F.col("s").alias("rs"), F.col("e").alias("re")), "gene_id").where("s < re and rs < e")
    lo, hi = F.greatest("s", "rs") - F.col("rs") + F.col("before"), F.least("e", "re") - F.col("rs") + F.col("before")
    edges = hits.select("tx_id", "strand", "total", "k", F.explode(F.array(F.struct(lo.alias("p"), F.lit(1).alias("d")), F.struct(hi.alias("p"), F.lit(-1).alias("d")))).alias("x"))
    steps = edges.groupBy("tx_id", "strand", "total", F.col("x.p").alias("p")).agg(F.sum(F.col("k") * F.col("x.d")).alias("d"))
    w = Window.partitionBy("tx_id").orderBy("p")
    return steps.select("tx_id", "strand", "total", F.col("p").alias("lo"), F.lead("p").over(w).alias("hi"), F.sum("d").over(w).alias("depth")).where("hi is not null and depth > 0")


def mean_coverage(depths: DataFrame) -> DataFrame:
    return depths.groupBy("tx_id", "strand", "total").agg((F.sum((F.col("hi") - F.col("lo")) * F.col("depth")) / F.first("total")).alias("mean"))


def hash_place(name: Column, size: Column) -> Column:
    """the bucket of a name in a hash table of `size` buckets (a power of two): 31 h + byte over its bytes, folded once."""
    low = F.lit((1 << 32) - 1).cast("long")
    code = F.aggregate(F.regexp_extract_all(F.hex(name.cast("binary")), F.lit(".."), F.lit(0)), F.lit(0).cast("long"), lambda h, x: (h * 31 + F.conv(x, 16, 10).cast("long")).bitwiseAND(low))
    return code.bitwiseXOR(F.shiftright(code, 16)).bitwiseAND(size - 1)


def table_size(n: Column) -> Column:
    """the buckets of a hash table of n entries: 16, doubled while n exceeds three quarters of them."""
    size = F.lit(1 << 30)
    for k in range(29, 3, -1):
        size = F.when(n <= (1 << k) * 3 // 4, 1 << k).otherwise(size)
    return size.cast("long")


def iteration_order(transcripts: DataFrame) -> DataFrame:
    """tx_id and `place` (a struct to sort by): by gene bucket and the gene's first transcript, then by transcript bucket and order. transcripts: tx_id, gene_id, tx_ord."""
    per = transcripts.groupBy("gene_id").agg(F.min("tx_ord").alias("__first"), F.count("*").alias("__n"))
    n = per.agg(F.count("*").alias("__genes"))
    both = transcripts.join(per, "gene_id").crossJoin(F.broadcast(n))  # one row
    return both.select("tx_id", F.struct(hash_place(F.col("gene_id"), table_size(F.col("__genes"))).alias("a"), F.col("__first").alias("b"), hash_place(F.col("tx_id"), table_size(F.col("__n"))).alias("c"), F.col("tx_ord").alias("d")).alias("place"))


def profiles(depths: DataFrame, transcripts: DataFrame, bins: int = 100, top: int = 500) -> DataFrame:
    """100-bin profiles of all, the lowest and the highest covered transcripts; of those of one mean the last in iteration order stands."""
    means = mean_coverage(depths).join(iteration_order(transcripts), "tx_id")
    once = means.withColumn("__n", F.row_number().over(Window.partitionBy("mean").orderBy(F.desc("place")))).where("__n = 1")
    low = once.orderBy("mean", "tx_id").limit(top).select("tx_id", F.lit("low").alias("profile"))
    high = once.orderBy(F.desc("mean"), "tx_id").limit(top).select("tx_id", F.lit("high").alias("profile"))
    chosen = once.select("tx_id", F.lit("total").alias("profile")).unionByName(low).unionByName(high)
    step = F.ceil(F.col("total") / bins)
    dealt = depths.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))))
    inside = F.least("hi", (F.col("bin") + 1) * step) - F.greatest("lo", F.col("bin") * step)
    per = dealt.groupBy("tx_id", "bin").agg((F.sum(inside * F.col("depth")) / F.first("total")).alias("v"))
    return per.join(chosen, "tx_id").groupBy("profile", "bin").agg(F.sum("v").alias("coverage"))


def bias(depths: DataFrame, transcripts: DataFrame, most: int = 1000, least_length: int = 500, edge: int = 100) -> DataFrame:
    """5' and 3' bias of the best covered transcript of each gene, among the `most` best; transcripts: tx_id, gene_id, tx_ord. On the minus strand the 5' end is at the last place."""
    means = mean_coverage(depths).where((F.col("total") >= least_length) & (F.col("mean") >= 1)).join(transcripts.select("tx_id", "gene_id", "tx_ord"), "tx_id")
    best = means.withColumn("__n", F.row_number().over(Window.partitionBy("gene_id").orderBy(F.desc("mean"), F.desc("tx_ord")))).where("__n = 1").orderBy(F.desc("mean"), "tx_id").limit(most)
    part = lambda a, b: F.sum(F.greatest(F.lit(0).cast("long"), F.least("hi", b) - F.greatest("lo", a)) * F.col("depth")) / edge
    ends = depths.join(best.select("tx_id", "mean"), "tx_id").groupBy("tx_id", "mean", "strand").agg(part(F.lit(0).cast("long"), F.lit(edge).cast("long")).alias("head"), part(F.col("total") - edge, F.col("total")).alias("tail"))
    minus = F.col("strand") == "-"
    five, three = F.when(minus, F.col("tail")).otherwise(F.col("head")) / F.col("mean"), F.when(minus, F.col("head")).otherwise(F.col("tail")) / F.col("mean")
    rows = ends.select(five.alias("b5"), three.alias("b3"), F.when(three > 0, five / three).when(five > 0, F.lit(float("inf"))).alias("ratio"))
    return rows.agg(F.percentile("b5", F.lit(0.5)).alias("bias_5p"), F.percentile("b3", F.lit(0.5)).alias("bias_3p"), F.percentile("ratio", F.lit(0.5)).alias("bias_5p_3p"), F.count("*").alias("n"))


def coverage_histogram(depths: DataFrame, most: int = 50) -> DataFrame:
    """51 bins of mean coverage."""
    return mean_coverage(depths).groupBy(F.least(F.floor("mean"), F.lit(most)).alias("bin")).agg(F.count("*").alias("n"))

