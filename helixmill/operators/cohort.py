"""Sample-level reports: gene classes, panels, sex, saturation, SNPs, fingerprints, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar, flags, kmers
from . import intervals, rseqc


def gene_class_fractions(fc_reads: DataFrame, genes: DataFrame, classes: DataFrame) -> DataFrame:
    """Share of assigned reads of each class (class, symbol); matched counts genes, bundled symbols."""
    total = fc_reads.agg(F.sum("fc_reads").alias("assigned"))
    sizes = classes.distinct().groupBy("class").agg(F.count("*").alias("bundled"))
    hit = classes.distinct().join(genes.select("gene_id", "symbol"), "symbol")
    per = hit.join(fc_reads, "gene_id", "left").groupBy("class").agg(F.countDistinct("gene_id").alias("matched"), F.coalesce(F.sum("fc_reads"), F.lit(0)).cast("long").alias("reads"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return sizes.join(per, "class", "left").crossJoin(F.broadcast(total)).select("class", "bundled", zero("matched"), zero("reads"), kmers.ratio(F.coalesce("reads", F.lit(0)), F.coalesce("assigned", F.lit(0))).alias("fraction"))  # one row of totals


def panel_totals(panels: DataFrame, genes: DataFrame, fc_reads: DataFrame) -> DataFrame:
    """Entries, reads and their share of assigned reads for each panel and cell type. An entry's gene is that of its gene_id, else the last gene of its symbol; a gene counts for each entry."""
    by_symbol = genes.groupBy("symbol").agg(F.max_by("gene_id", "gene_ord").alias("sym_gene"))
    ids = genes.select(F.col("gene_id").alias("own_gene"))
    cells = panels.select("panel", "cell_type").distinct()
    found = panels.join(ids, panels.gene_id == ids.own_gene, "left").join(by_symbol, panels.gene_symbol == by_symbol.symbol, "left")
    members = found.select("panel", "cell_type", F.coalesce("own_gene", "sym_gene").alias("gene_id")).where("gene_id is not null")
    sums = members.join(fc_reads, "gene_id", "left").groupBy("panel", "cell_type").agg(F.count("*").alias("n_genes"), F.coalesce(F.sum("fc_reads"), F.lit(0)).cast("long").alias("reads"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    total = fc_reads.agg(F.coalesce(F.sum("fc_reads"), F.lit(0)).alias("assigned"))
    return cells.join(sums, ["panel", "cell_type"], "left").crossJoin(F.broadcast(total)).select("panel", "cell_type", zero("n_genes"), zero("reads"), kmers.ratio(F.coalesce("reads", F.lit(0)), F.col("assigned")).alias("fraction"))  # one row of totals


def sex_inference(per_contig: DataFrame, fc_reads: DataFrame, genes: DataFrame) -> DataFrame:
    """A35. per_contig: name, mapped."""
    reads = per_contig.agg(F.coalesce(F.sum(F.when(flags.chrom_y(F.col("name")), F.col("mapped"))), F.lit(0)).alias("chr_y"), F.coalesce(F.sum(F.when(flags.autosome(F.col("name")), F.col("mapped"))), F.lit(0)).alias("autosomes"))
    own = fc_reads.join(genes.select("gene_id", "symbol"), "gene_id")
    of = lambda s: F.coalesce(F.sum(F.when(F.col("symbol") == s, F.col("fc_reads"))), F.lit(0))
    marks = own.agg(F.coalesce(F.sum("fc_reads"), F.lit(0)).alias("assigned"), of("XIST").alias("xist"), of("RPS4Y1").alias("rps4y1"))
    both = reads.crossJoin(marks).select("*", kmers.ratio(F.col("chr_y"), F.col("autosomes")).alias("y_ratio"), kmers.ratio(F.col("xist"), F.col("assigned")).alias("xist_fraction"), kmers.ratio(F.col("rps4y1"), F.col("assigned")).alias("rps4y1_fraction"))  # one row each
    male = (F.col("y_ratio") > 1e-3) | (F.col("rps4y1_fraction") > 1e-5)
    female = F.col("xist_fraction") > 1e-4
    return both.withColumn("predicted", F.when(F.col("autosomes") < 1000, "unknown").when(male & female, "ambiguous").when(male, "male").when(female, "female").otherwise("unknown"))


def gene_saturation(assigned: DataFrame, fractions: list[float] | None = None) -> DataFrame:
    """Genes with 1 and 10 reads among the reads whose name's checksum bucket lies below each fraction. assigned: qname, gene_id."""
    fractions = fractions or [0.05, 0.10, 0.25, 0.50, 0.75, 1.00]
    per = assigned.groupBy("gene_id", (F.crc32(F.col("qname").cast("binary")) % 100).alias("bucket")).agg(F.count("*").alias("n"))
    cuts = F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), F.ceil(F.lit(f) * 100).alias("cut")) for f in fractions])).alias("x")
    grown = per.select("gene_id", "bucket", "n", cuts).where(F.col("bucket") < F.col("x.cut")).groupBy("gene_id", F.col("x.fraction").alias("fraction")).agg(F.sum("n").alias("n"))
    return grown.groupBy("fraction").agg(F.count("*").alias("genes_ge_1"), F.count_if(F.col("n") >= 10).alias("genes_ge_10"), F.sum("n").alias("reads"))


def snp_depths(reads: DataFrame, sites: DataFrame, min_mapq: int = 30, min_depth: int = 4) -> DataFrame:
    """Bases over each site (tid, site, ref, alt); sites without reads stay."""
    blocks = reads.where(flags.primary_mapped(min_mapq)).select("tid", "seq", F.explode(cigar.aligned_blocks()).alias("b")).select("tid", "seq", F.col("b.s").alias("s"), F.col("b.e").alias("e"), F.col("b.q").alias("q"))
    keys = ["tid", "site", "ref", "alt"]
    hits = intervals.overlap_join(blocks, sites.select(*keys, F.col("site").alias("rs"), (F.col("site") + 1).alias("re")), ["tid"])
    seen = hits.select(*keys, F.upper(F.substring("seq", (F.col("q") + F.col("site") - F.col("s") + 1).cast("int"), F.lit(1))).alias("base"))
    per = seen.groupBy(*keys).agg(*[F.count_if(F.col("base") == b).alias(f"depth_{b.lower()}") for b in "ACGT"])
    out = sites.select(*keys).join(per, keys, "left").fillna(0, subset=[f"depth_{b}" for b in "acgt"])
    total = sum((F.col(f"depth_{b}") for b in "acg"), F.col("depth_t"))
    pick = lambda c: F.when(c == "A", F.col("depth_a")).when(c == "C", F.col("depth_c")).when(c == "G", F.col("depth_g")).when(c == "T", F.col("depth_t")).otherwise(0)
    known = pick(F.col("ref")) + pick(F.col("alt"))
    return out.withColumn("depth", total).withColumn("ref_count", pick(F.col("ref"))).withColumn("alt_count", pick(F.col("alt"))).withColumn("other_count", F.col("depth") - known).withColumn("alt_fraction", F.when(F.col("depth") > 0, pick(F.col("alt")) / F.col("depth")).otherwise(0.0)).withColumn("called", F.col("depth") >= min_depth)


# Contig lengths that tell assemblies apart.
GENOMES = [
    ("GRCh38", "1", 248956422), ("GRCh38", "2", 242193529), ("GRCh38", "3", 198295559), ("GRCh38", "4", 190214555), ("GRCh38", "X", 156040895), ("GRCh38", "Y", 57227415),
    ("GRCh37", "1", 249250621), ("GRCh37", "2", 243199373), ("GRCh37", "3", 198022430), ("GRCh37", "4", 191154276), ("GRCh37", "X", 155270560), ("GRCh37", "Y", 59373566),
    ("T2T-CHM13v2", "1", 248387328), ("T2T-CHM13v2", "2", 242696752), ("T2T-CHM13v2", "3", 201105948), ("T2T-CHM13v2", "4", 193574945), ("T2T-CHM13v2", "X", 154259566), ("T2T-CHM13v2", "Y", 62460029),
]


def fingerprint(contigs: DataFrame, least: int = 3) -> DataFrame:
    """Assemblies of which at least three contigs agree."""
    known = contigs.sparkSession.createDataFrame(GENOMES, "genome string, short string, length long")
    named = contigs.select(F.regexp_replace("name", "(?i)^chr", "").alias("short"), "length")
    return named.join(known, ["short", "length"]).groupBy("genome").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def naming_style(contigs: DataFrame) -> DataFrame:
    """Chr or no_chr, over canonical contigs; unknown where there are both or none."""
    named = F.lower("name").startswith("chr")
    kept = contigs.where(flags.canonical(F.col("name"))).agg(F.bool_or(named).alias("a"), F.bool_or(~named).alias("b"))
    one = lambda x, y: F.coalesce(F.col(x), F.lit(False)) & ~F.coalesce(F.col(y), F.lit(False))
    return kept.select(F.when(one("a", "b"), "chr").when(one("b", "a"), "no_chr").otherwise("unknown").alias("style"))


def name_bridge(reads_style: str, genes_style: str, explicit: bool = False) -> str:
    """What joins alignments and annotation of different naming: add_chr, or unsupported (name the contigs explicitly), else none. An explicit prefix or mapping wins."""
    if explicit:
        return "none"
    return {("no_chr", "chr"): "add_chr", ("chr", "no_chr"): "unsupported"}.get((reads_style, genes_style), "none")


def sampled_strandedness(reads: DataFrame, transcripts: DataFrame, min_mapq: int = 30, most: int = 1_000_000) -> DataFrame:
    """The library told by the first `most` records in file order; all of them are used."""
    return rseqc.infer_strandedness(rseqc.strand_classes(rseqc.first_records(reads, most), transcripts, min_mapq))


def first_pass(reads: DataFrame, most: int = 1000) -> DataFrame:
    """The first records in file order: paired library? how many duplicates?"""
    head = reads.where(flags.primary() & ~flags.has(flags.UNMAPPED)).orderBy("rec_ord").limit(most)
    return head.agg(F.count("*").alias("sampled"), F.count_if(flags.has(flags.PAIRED)).alias("paired"), F.count_if(flags.has(flags.DUPLICATE)).alias("duplicates")).withColumn("is_paired", 2 * F.col("paired") > F.col("sampled")).withColumn("skip_dup_check", (F.col("sampled") >= 500) & (F.col("duplicates") == 0))


# The flags.
FLAGS = "single_end_no_tlen duplicates_not_marked low_paired_fraction low_mapping_rate read_length_caps_long_fragments high_rrna_fraction tagmentation_endmotif_bias unstranded_endbias_unreliable low_complexity_library high_duplication_nonbiological cfdna_contamination_suspected end_motifs_skipped_no_fasta".split()


# The rules of A43 over one row of sample metrics; each gives its flag where its condition is true.
def qc_flags(sample: DataFrame) -> DataFrame:
    """The sorted distinct flags of each sample row.

    Columns: is_paired, skip_dup_check, properly_paired, paired, mapped, total, max_length, rrna_reads,
    biotype_assigned, library_prep, strandedness, complexity_slope, duplicates, fit_intercept,
    genes_with_reads, intron_tags, cds_tags, utr_tags, median_tlen, has_fasta.
    """
    c = F.col
    share = lambda n, d: F.when(d > 0, n / d)
    low_complexity = F.when(c("complexity_slope").isNotNull(), ~F.isnan("complexity_slope") & (c("complexity_slope") < 0.2)).otherwise((share(c("duplicates"), c("mapped")) > 0.95) & (c("biotype_assigned") < 1_000_000))
    rules: dict[str, Column] = {
        "single_end_no_tlen": ~c("is_paired"),
        "duplicates_not_marked": c("skip_dup_check"),
        "low_paired_fraction": c("is_paired") & (share(c("properly_paired"), c("paired")) < 0.7),
        "low_mapping_rate": share(c("mapped"), c("total")) < 0.7,
        "read_length_caps_long_fragments": (c("max_length") > 0) & (c("max_length") < 100),
        "high_rrna_fraction": share(c("rrna_reads"), c("biotype_assigned")) > 0.4,
        "tagmentation_endmotif_bias": F.lower("library_prep").contains("tagment"),
        "unstranded_endbias_unreliable": c("strandedness") == "unstranded",
        "low_complexity_library": low_complexity,
        "high_duplication_nonbiological": (c("fit_intercept") > 0.5) & (c("genes_with_reads") >= 1000),
        "cfdna_contamination_suspected": (share(c("intron_tags"), c("intron_tags") + c("cds_tags") + c("utr_tags")) > 0.5) & (c("median_tlen") > 150),
        "end_motifs_skipped_no_fasta": ~c("has_fasta"),
    }
    assert set(rules) == set(FLAGS)
    found = F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in rules.items()])
    return sample.withColumn("qc_flags", F.array_sort(F.array_distinct(F.array_compact(found))))


def snp_summary(found: DataFrame, min_depth: int = 4) -> DataFrame:
    """Sites, those with reads, and those with enough of them."""
    return found.agg(F.count("*").alias("sites_total"), F.count_if(F.col("depth") > 0).alias("sites_with_any_depth"), F.count_if(F.col("called")).alias("sites_called"), F.lit(min_depth).alias("min_depth_for_called"))
