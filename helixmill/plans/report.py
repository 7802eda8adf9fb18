"""A sample's whole report: all operators over one alignment table and one annotation."""

from __future__ import annotations

import hashlib
import json
import resource
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohort, complexity, counting, fragmentomics, intervals, pergene, qualimap, readstats, rseqc
from ..sources import alignments, bundled
from ..sources.config import Params

VERSION = "0.2.0"


@dataclass
class Sample:
    """reads and contigs of one sample; exons (gene_id, tid, s, e, strand, biotype), genes (gene_id, gene_ord, symbol, tid, s, e, strand), transcripts and tx_exons (tx_id, tid, strand, s, e)."""

    sample_id: str
    reads: DataFrame
    contigs: DataFrame
    exons: DataFrame
    genes: DataFrame
    transcripts: DataFrame
    tx_exons: DataFrame
    panels: DataFrame | None = None
    classes: DataFrame | None = None
    sites: DataFrame | None = None
    fasta: DataFrame | None = None
    hashes: dict[str, str] = field(default_factory=dict)
    cds: DataFrame | None = None
    bam_path: str = ""
    gtf_path: str = ""
    bam_size_bytes: int = 0


def _one(df: DataFrame) -> dict:
    row = df.first()
    return row.asDict(recursive=True) if row else {}


def _map(df: DataFrame, key: str, value: str) -> dict:
    return {str(r[key]): r[value] for r in df.orderBy(key).collect()}


def run(sample: Sample, params: Params) -> dict:
    """The sample's document. Each block is its own Spark job over the saved alignment table; only small reports reach the driver."""
    if not params["library_prep"]:
        raise ValueError("library_prep is required")
    began = time.monotonic()
    kept: list[DataFrame] = []
    try:
        return _document(sample, params, began, kept)
    finally:
        for df in kept:
            df.unpersist()


#: Fixed value: the MD5 that stands for a file without one.
NO_MD5 = "0" * 32


def _document(sample: Sample, params: Params, began: float, kept: list[DataFrame]) -> dict:
    def held(df: DataFrame) -> DataFrame:
        """df for several blocks: made once, and again only where an executor is lost."""
        kept.append(df.persist())
        return kept[-1]

    q, reads = params["min_mapq"], sample.reads
    first = _one(cohort.first_pass(reads))
    paired = first["is_paired"] if params["paired"] is None else params["paired"]
    classes = rseqc.strand_classes(reads, sample.transcripts, q)
    strand = _one(rseqc.infer_strandedness(classes))
    skip_dup = params["skip_dup_check"] or first["skip_dup_check"]
    if not skip_dup:
        counting.check_duplicates_marked(reads)
    frags = held(counting.tallied(counting.fragments(reads, sample.exons, paired, params["library"])))
    counts = frags.where("gene_id is not null")
    counting.check_contigs(reads, counts)
    lengths = intervals.union_length(sample.exons, ["gene_id"])
    matrix = held(counting.dup_matrix(sample.genes, lengths, counts, counting.mapped_total(reads, frags)))
    status = held(counting.read_status(reads, sample.exons, paired, params["library"]))
    fc = status.where("gene_id is not null").groupBy("gene_id").agg(F.count("*").alias("fc_reads"))
    biotypes = _map(counting.biotype_counts(counting.biotype_status(reads, sample.exons, paired, params["library"])), "biotype", "n")
    flat = _one(readstats.flagstat(reads))
    events = held(rseqc.splice_events(reads, q))
    js, far_ = params["junction_saturation"], params["inner_distance"]
    summary = _one(readstats.summary(reads, _quality(reads)))
    sizes = _one(readstats.bulk(readstats.insert_sizes(reads)))
    known = rseqc.known_introns(sample.tx_exons)
    found = rseqc.junctions(events, known, params["min_intron"])
    sets = held(rseqc.regions(sample.transcripts, sample.tx_exons))
    regions = rseqc.region_report(rseqc.region_tags(reads, sets), sets).collect()
    hist = fragmentomics.fragment_lengths(reads, q)
    lengths_row = _one(fragmentomics.fragment_summary(hist)) if paired else {}
    fit = counting.fit_duplication(matrix)
    n_genes = matrix.where("all_counts > 0").count()
    stat = _one(readstats.bam_stat(reads, q))
    # The names of the document's fields and of its first block.
    named = {
        "total_records": stat["total"], "primary": flat["primary_reads"], "primary_mapped": flat["primary_mapped"], "primary_duplicates": flat["primary_duplicates"], "mapped": flat["mapped"], "secondary": flat["secondary"], "supplementary": flat["supplementary"],
        "duplicates": stat["duplicate"], "multimappers": stat["non_unique"], "forward": stat["plus"], "reverse": stat["minus"], "splice": stat["spliced"], "non_splice": stat["non_spliced"], "paired_flagstat": flat["paired"], "read1_flagstat": flat["read1"], "read2_flagstat": flat["read2"],
        "singletons": flat["singletons"], "mate_diff_chr": flat["mate_elsewhere"], "max_read_length": summary["maximum_length"], "mean_read_length": summary["total_length"] / summary["raw_total"] if summary["raw_total"] else 0.0, "bases_mapped": summary["bases_mapped"],
    }
    doc = {
        "schema_version": "1.0.0", "extractor_version": VERSION, "git_commit": "unknown", "sample_id": sample.sample_id, "bam_path": sample.bam_path, "bam_md5": sample.hashes.get("bam", NO_MD5), "bam_size_bytes": sample.bam_size_bytes,
        "gtf_path": sample.gtf_path, "gtf_md5": sample.hashes.get("gtf", NO_MD5), "reference_fasta_md5": sample.hashes.get("fasta"), "library_prep": params["library_prep"], "paired_end": paired, "is_paired": paired, "strandedness": strand["strandedness"],
        "read_length_max": named["max_read_length"], "read_length_mean": named["mean_read_length"], "read_count_total": stat["total"], "read_count_after_filters": stat["unique"], "hashes": sample.hashes,
        "filters": {"min_mapq": q, "require_proper_pair": False, "drop_secondary": True, "drop_supplementary": True, "drop_duplicates": False},
        "flagstat": flat, "bam_stat": {**stat, **named}, "infer_experiment": {**strand, "total_sampled": strand["total"], "frac_failed": strand["failed"], "frac_protocol1": strand["forward"], "frac_protocol2": strand["reverse"], "mismatch": rseqc.strandedness_mismatch(strand["strandedness"], params["library"])},
        "samtools_stats": {**summary, **sizes, **_one(readstats.orientations(reads))},
        "read_distribution": {"regions": [r.asDict() for r in regions]},
        "junction_annotation": {r["class"]: r.asDict() for r in rseqc.junction_summary(found, events, params["min_intron"]).collect()},
        "junction_saturation": [r.asDict() for r in rseqc.junction_saturation(events, known, params["min_intron"], js["min_coverage"], js["percentile_floor"], js["percentile_ceiling"], js["percentile_step"], js["seed"]).orderBy("percent").collect()],
        "featurecounts": {"status": _map(counting.status_counts(status, reads), "status", "n"), "biotypes": biotypes},
        "dupradar": {**_one(counting.dup_stats(matrix)), "fit": fit},
        "qualimap": {**_map(qualimap.origin(reads, sample.exons, sample.tx_exons, params["library"]), "origin", "n"), **_one(qualimap.cascade_counts(reads)), **_one(qualimap.strand_votes(reads, sample.exons)), "junctions": _map(qualimap.junction_support(reads, sample.tx_exons), "class", "n")},
        "per_chromosome": {r["name"]: r.asDict() for r in readstats.chrom_metrics(reads, sample.contigs).orderBy("name").collect()},
        "soft_clips": _one(fragmentomics.clip_rates(reads, q)),
        "saturation": [r.asDict() for r in cohort.gene_saturation(status.where("gene_id is not null"), params["saturation_fractions"]).orderBy("fraction").collect()],
        "sex_inference": _one(cohort.sex_inference(readstats.idxstats(reads, sample.contigs), fc, sample.genes)),
    }
    if paired:
        merged = intervals.merge(sample.exons, ["tid"])
        far = held(rseqc.inner_distances(reads, sample.transcripts, merged, q, far_["sample_size"]))
        doc["inner_distance"] = {"total": far.count(), "histogram": _map(rseqc.distance_histogram(far, *(far_[k] for k in ("lower_bound", "upper_bound", "step"))), "lo", "n"), **_one(far.agg(F.avg("distance").alias("mean"), F.percentile("distance", F.lit(0.5)).alias("median")))}
        doc["fragment_length"], doc["periodicity"] = lengths_row, fragmentomics.periodicity(hist)
        doc["adapter_readthrough_rate"] = _one(fragmentomics.readthrough_rate(reads, q))["adapter_readthrough_rate"]
    if params["read_duplication"]["enabled"]:
        doc["read_duplication"] = {by: _map(rseqc.duplication(reads, by, q), "occurrence", "n_keys") for by in ("position", "sequence")}
    if params["tin"]["enabled"]:
        doc["tin"] = _one(rseqc.tin_summary(rseqc.tin(reads, sample.transcripts, sample.tx_exons, params["tin"]["sample_size"], params["tin"]["min_coverage"])))
    slope: float | None = None
    if params["complexity"]["enabled"]:
        c = params["complexity"]
        table = {r.j: r.n_j for r in complexity.frequency_table(complexity.fragment_keys(reads, c["longest"])).collect()}
        curve = complexity.report(table, c)
        names = ("total_reads", "expected_distinct", "lower_ci", "upper_ci")
        doc["preseq"] = {"curve": [{k: None if v != v else v for k, v in zip(names, p, strict=True)} for p in curve] if curve else None}
        slope = float(curve[-1][1] - curve[-2][1]) / c["step"] if curve and len(curve) > 1 else None
    spark = reads.sparkSession
    kinds_ = sample.classes if sample.classes is not None else bundled.classes(spark)
    doc["gene_class_fractions"] = {r["class"]: r.asDict() for r in cohort.gene_class_fractions(fc, sample.genes, kinds_).collect()}
    panels = sample.panels if sample.panels is not None else bundled.panels(spark, params["panels"])
    doc["panels"] = [r.asDict() for r in cohort.panel_totals(panels, sample.genes, fc).orderBy("panel", "cell_type").collect()]
    sites = sample.sites if sample.sites is not None else bundled.snps(spark, sample.contigs)
    depths = held(cohort.snp_depths(reads, sites, q))
    doc["snp_fingerprint"] = {**_one(cohort.snp_summary(depths)), "sites": [r.asDict() for r in depths.orderBy("tid", "site").collect()]}
    if sample.fasta is not None:
        named = reads.join(sample.contigs.select("tid", F.col("name").alias("contig")), "tid") if "contig" not in reads.columns else reads
        doc["end_motifs"] = [r.asDict() for r in fragmentomics.end_motifs(named, sample.fasta, min_mapq=q).orderBy("end", "kmer").collect()]
        doc["splice_site_dinucleotides"] = _map(fragmentomics.splice_motifs(found.join(sample.contigs.select("tid", F.col("name").alias("contig")), "tid"), sample.fasta), "class", "n")
    tags = {r.region: r.tags for r in regions}
    metrics = {
        "is_paired": paired, "skip_dup_check": bool(first["skip_dup_check"]), "properly_paired": flat["properly_paired"], "paired": flat["paired"], "mapped": flat["mapped"], "total": flat["total"], "duplicates": flat["duplicates"],
        "max_length": summary["maximum_length"], "rrna_reads": biotypes.get("rRNA", 0), "biotype_assigned": sum(biotypes.values()), "library_prep": params["library_prep"], "strandedness": strand["strandedness"],
        "complexity_slope": slope, "fit_intercept": fit["intercept"], "genes_with_reads": n_genes, "intron_tags": tags.get("intron", 0), "cds_tags": tags.get("cds_exon", 0), "utr_tags": tags.get("utr_5", 0) + tags.get("utr_3", 0),
        "median_tlen": lengths_row.get("median"), "has_fasta": sample.fasta is not None,
    }
    kinds = "is_paired boolean, skip_dup_check boolean, properly_paired long, paired long, mapped long, total long, duplicates long, max_length long, rrna_reads long, biotype_assigned long, library_prep string, strandedness string, complexity_slope double, fit_intercept double, genes_with_reads long, intron_tags long, cds_tags long, utr_tags long, median_tlen long, has_fasta boolean"
    row = reads.sparkSession.createDataFrame([tuple(metrics[k.split()[0]] for k in kinds.split(", "))], kinds)
    doc["qc_flags"] = cohort.qc_flags(row).first().qc_flags
    doc["runtime_seconds"] = round(time.monotonic() - began, 3)
    doc["peak_rss_mb"] = round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1)
    return doc


def _quality(reads: DataFrame):
    """Base qualities as array<int>, whichever way the table holds them."""
    return F.col("quality") if "quality" in reads.columns else alignments.quality()


#: The fields that every document has, and the flags that it may have.
REQUIRED = "extractor_version schema_version git_commit sample_id bam_path bam_md5 bam_size_bytes gtf_path gtf_md5 reference_fasta_md5 library_prep paired_end strandedness read_length_max read_length_mean read_count_total read_count_after_filters filters qc_flags runtime_seconds peak_rss_mb".split()


def schema() -> dict:
    """The JSON schema of the document's required part."""
    text, whole, number = {"type": "string"}, {"type": "integer", "minimum": 0}, {"type": "number", "minimum": 0}
    kinds = dict.fromkeys(REQUIRED, text) | dict.fromkeys(("bam_size_bytes", "read_length_max", "read_count_total", "read_count_after_filters"), whole) | dict.fromkeys(("read_length_mean", "runtime_seconds", "peak_rss_mb"), number)
    kinds |= {"paired_end": {"type": "boolean"}, "filters": {"type": "object"}, "reference_fasta_md5": {"type": ["string", "null"]}, "qc_flags": {"type": "array", "uniqueItems": True, "items": {"enum": sorted(cohort.FLAGS)}}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": REQUIRED, "additionalProperties": True, "properties": kinds}


def per_gene(sample: Sample, params: Params, cds: DataFrame | None = None) -> DataFrame:
    """The per-gene table of a sample."""
    reads, q = sample.reads, params["min_mapq"]
    paired = bool(_one(cohort.first_pass(reads))["is_paired"]) if params["paired"] is None else params["paired"]
    fc = counting.read_status(reads, sample.exons, paired, params["library"]).where("gene_id is not null").groupBy("gene_id").agg(F.count("*").alias("fc_reads"))
    named = reads if "contig" in reads.columns or sample.fasta is None else reads.join(sample.contigs.select("tid", F.col("name").alias("contig")), "tid")
    return pergene.table(named, sample.exons, sample.genes, intervals.union_length(sample.exons, ["gene_id"]), fc, paired, params["library"], cds if cds is not None else sample.cds, sample.fasta, params["min_gene_reads"], q)


def document_hash(doc: dict) -> str:
    return hashlib.md5(json.dumps(doc, sort_keys=True, default=str).encode()).hexdigest()
