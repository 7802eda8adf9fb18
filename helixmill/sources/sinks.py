"""Reports as text, JSON and Parquet (K01-K13). Rows are ordered in Spark; a report reaches the driver only where it is written."""

from __future__ import annotations

import json
import math
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import c_exponent, commas, one_place, sig15
from ..operators import readstats


def write_table(rows: list[list], path: str, header: list[str] | None = None) -> None:
    lines = ["\t".join(header)] if header else []
    lines += ["\t".join(sig15(v) if isinstance(v, float) or v is None else str(v) for v in r) for r in rows]
    Path(path).write_text("\n".join(lines) + "\n")


DUP_COLUMNS = ["gene_id", "gene_length", *(f"{c}{m}" for m in ("_multi", "") for c in ("all_counts", "filtered_counts", "dup_rate", "dups_per_id", "rpk", "rpkm"))]
# The headings of the duplication matrix.
DUP_HEADER = "ID geneLength allCountsMulti filteredCountsMulti dupRateMulti dupsPerIdMulti RPKMulti PKMMulti allCounts filteredCounts dupRate dupsPerId RPK RPKM".split()


def write_dup_matrix(matrix: DataFrame, path: str) -> None:
    """Genes in annotation order; an undefined rate is NA."""
    write_table([list(r) for r in matrix.orderBy("gene_ord").select(*DUP_COLUMNS).collect()], path, DUP_HEADER)


def write_status(status: DataFrame, path: str, sample: str) -> None:
    """The assignment summary."""
    name = lambda s: s if s == "Assigned" else f"Unassigned_{s}"
    write_table([[name(r.status), r.n] for r in status.orderBy("status").collect()], path, ["Status", sample])


def write_biotypes(counts: DataFrame, path: str, sample: str) -> None:
    """Most first, then by name."""
    rows = counts.orderBy(counts.n.desc(), counts.biotype.asc()).collect()
    write_table([[r.biotype, r.n] for r in rows], path, ["Biotype", sample])


def flagstat_text(row: dict) -> str:
    """K05."""
    percent = lambda n, d: f"{100 * n / d:.2f}%" if d else "N/A"
    r = row
    lines = [
        f"{r['total']} + 0 in total (QC-passed reads + QC-failed reads)", f"{r['primary_reads']} + 0 primary", f"{r['secondary']} + 0 secondary", f"{r['supplementary']} + 0 supplementary",
        f"{r['duplicates']} + 0 duplicates", f"{r['primary_duplicates']} + 0 primary duplicates", f"{r['mapped']} + 0 mapped ({percent(r['mapped'], r['total'])} : N/A)",
        f"{r['primary_mapped']} + 0 primary mapped ({percent(r['primary_mapped'], r['primary_reads'])} : N/A)", f"{r['paired']} + 0 paired in sequencing", f"{r['read1']} + 0 read1", f"{r['read2']} + 0 read2",
        f"{r['properly_paired']} + 0 properly paired ({percent(r['properly_paired'], r['paired'])} : N/A)", f"{r['both_mapped']} + 0 with itself and mate mapped", f"{r['singletons']} + 0 singletons ({percent(r['singletons'], r['paired'])} : N/A)",
        f"{r['mate_elsewhere']} + 0 with mate mapped to a different chr", f"{r['mate_elsewhere_q5']} + 0 with mate mapped to a different chr (mapQ>=5)",
    ]
    return "\n".join(lines) + "\n"


def write_idxstats(stats: DataFrame, path: str) -> None:
    rows = sorted(stats.collect(), key=lambda r: (r.tid < 0, r.tid))
    write_table([[r.name, r.length, r.mapped, r.unmapped] for r in rows], path)


def write_tin(scores: DataFrame, path: str) -> None:
    """Every transcript; a failed one has 0.0, a passed one without coverage 0."""
    rows = scores.orderBy("tx_id").collect()
    show = lambda r: "0.0" if not r.passed else ("0" if r.tin == 0 else sig15(r.tin))
    write_table([[r.tx_id, r.tid, r.s, r.e, show(r)] for r in rows], path, ["geneID", "chrom", "tx_start", "tx_end", "TIN"])


def write_junctions(found: DataFrame, contigs: DataFrame, path: str) -> None:
    """By header contig, then as first met."""
    rows = found.join(contigs.select("tid", "name"), "tid").orderBy("tid", "first_rec", "first_nth").collect()
    write_table([[r.name, r.s, r.e, r.events, r["class"]] for r in rows], path, ["chrom", "intron_st(0-based)", "intron_end(1-based)", "read_count", "annotation"])


def junction_bed(found: DataFrame, contigs: DataFrame, path: str, edge: int = 10) -> None:
    """BED12, a block on either side of each junction."""
    colours = {"known": "205,0,0", "partial_novel": "0,205,0", "complete_novel": "0,0,205"}
    rows = found.join(contigs.select("tid", "name"), "tid").orderBy("tid", "first_rec", "first_nth").collect()
    write_table([[r.name, r.s - edge, r.e + edge, r["class"], r.events, ".", r.s - edge, r.e + edge, colours[r["class"]], 2, f"{edge},{edge}", f"0,{r.e - r.s + edge}"] for r in rows], path)


def write_histogram(df: DataFrame, columns: list[str], path: str, header: list[str] | None = None) -> None:
    """Any ordered small table."""
    write_table([list(r) for r in df.orderBy(columns[0]).select(*columns).collect()], path, header)


def region_text(report: DataFrame) -> str:
    """K06."""
    lines = [f"{'Group':<20}{'Total_bases':<20}{'Tag_count':<20}{'Tags/Kb':<20}"]
    lines += [f"{r.region:<20}{r.total_bases:<20}{r.tags:<20}{r.tags_per_kb:<18.2f}" for r in report.orderBy("region").collect()]
    return "\n".join(lines) + "\n"


# The lines of the read counts report, by heading, with the field of readstats.bam_stat; an empty line follows the marked ones.
COUNT_LINES = [
    ("Total records:", "total", True), ("QC failed:", "qc_failed", False), ("Optical/PCR duplicate:", "duplicate", False), ("Non primary hits", "non_primary", False), ("Unmapped reads:", "unmapped", False), ("mapq < mapq_cut (non-unique):", "non_unique", True),
    ("mapq >= mapq_cut (unique):", "unique", False), ("Read-1:", "read1", False), ("Read-2:", "read2", False), ("Reads map to '+':", "plus", False), ("Reads map to '-':", "minus", False), ("Non-splice reads:", "non_spliced", False), ("Splice reads:", "spliced", False),
    ("Reads mapped in proper pairs:", "proper_pairs", False),
]


def bam_stat_text(row: dict) -> str:
    """K06."""
    rule = "#" + "=" * 50
    lines = [f"{title:<40}{row[key]}" + ("\n" if gap else "") for title, key, gap in COUNT_LINES]
    return "\n".join(["", rule, "#All numbers are READ count", rule, "", *lines, f"Proper-paired reads map to different chrom:{row['proper_elsewhere']}"]) + "\n"


# The protocols of pairs and of single reads.
PROTOCOLS = {"PairEnd": ("1++,1--,2+-,2-+", "1+-,1-+,2++,2--"), "SingleEnd": ("++,--", "+-,-+")}


def infer_text(row: dict, kind: str) -> str:
    """Shares of the two protocols; kind: PairEnd, SingleEnd or another."""
    if kind not in PROTOCOLS:
        return "\n\nUnknown Data type\n"
    told = [("failed to determine", row["failed"]), *((f'explained by "{p}"', row[c]) for p, c in zip(PROTOCOLS[kind], ("forward", "reverse"), strict=True))]
    return "\n".join(["", "", f"This is {kind} Data", *(f"Fraction of reads {text}: {share:.4f}" for text, share in told)]) + "\n"


def fit_text(fit: dict, sample: str) -> str:
    """The fit's two numbers."""
    return f"{sample} - dupRadar Int (duprate at low read counts): {sig15(fit['intercept'])}\n{sample} - dupRadar Sl (progression of the duplication rate): {sig15(fit['slope'])}\n"


# The lines of the summary section: heading, field, remark.
SUMMARY_LINES = [
    ("raw total sequences", "raw_total", "excluding supplementary and secondary reads"), ("filtered sequences", "filtered", ""), ("sequences", "sequences", ""), ("is sorted", "is_sorted", "sorted by coordinate"), ("1st fragments", "first_fragments", ""), ("last fragments", "last_fragments", ""),
    ("reads mapped", "reads_mapped", ""), ("reads mapped and paired", "reads_mapped_and_paired", "paired-end technology bit set + both mates mapped"), ("reads unmapped", "reads_unmapped", ""), ("reads properly paired", "reads_properly_paired", "proper-pair bit set"), ("reads paired", "reads_paired", "paired-end technology bit set"),
    ("reads duplicated", "reads_duplicated", "PCR or optical duplicate bit set"), ("reads MQ0", "reads_mq0", "mapped and MQ=0"), ("reads QC failed", "filtered", ""), ("non-primary alignments", "non_primary", ""), ("supplementary alignments", "supplementary", ""), ("total length", "total_length", "ignores clipping"),
    ("total first fragment length", "total_first_fragment_length", "ignores clipping"), ("total last fragment length", "total_last_fragment_length", "ignores clipping"), ("bases mapped", "bases_mapped", "ignores clipping"), ("bases mapped (cigar)", "bases_mapped_cigar", "more accurate"), ("bases trimmed", "bases_trimmed", ""),
    ("bases duplicated", "bases_duplicated", ""), ("mismatches", "mismatches", "from NM fields"), ("error rate", "error_rate", "mismatches / bases mapped (cigar)"), ("average length", "average_length", ""), ("average first fragment length", "average_first_fragment_length", ""), ("average last fragment length", "average_last_fragment_length", ""),
    ("maximum length", "maximum_length", ""), ("maximum first fragment length", "maximum_first_fragment_length", ""), ("maximum last fragment length", "maximum_last_fragment_length", ""), ("average quality", "average_quality", ""), ("insert size average", "insert_mean", ""), ("insert size standard deviation", "insert_sd", ""),
    ("inward oriented pairs", "inward_oriented_pairs", ""), ("outward oriented pairs", "outward_oriented_pairs", ""), ("pairs with other orientation", "pairs_with_other_orientation", ""), ("pairs on different chromosomes", "pairs_on_different_chromosomes", ""), ("percentage of properly paired reads (%)", "percentage_properly_paired", ""),
]


def summary_text(row: dict) -> str:
    """The summary section, from readstats.summary, orientations and bulk."""
    row = {"is_sorted": 1, "bases_trimmed": 0, "non_primary": row["secondary"] + row["supplementary"], "insert_mean": 0.0, "insert_sd": 0.0, **{k: v for k, v in row.items() if v is not None}}
    show = lambda key, v: c_exponent(v) if key == "error_rate" else one_place(v) if isinstance(v, float) else str(v)
    return "".join(f"SN\t{title}:\t{show(key, row[key])}" + (f"\t# {remark}" if remark else "") + "\n" for title, key, remark in SUMMARY_LINES)


def stats_text(reads: DataFrame, quality: Column) -> str:
    """Checksums, summary and distributions. All sections are small: by length, cycle, percent or depth."""
    row = {}
    for df in (readstats.summary(reads, quality), readstats.orientations(reads), readstats.bulk(readstats.insert_sizes(reads))):
        row |= df.first().asDict()
    out = [summary_text(row)]
    if "qual" in reads.columns:
        chk = readstats.checksums(reads).first()
        out.insert(0, f"CHK\t{chk.names:08x}\t{chk.sequences:08x}\t{chk.qualities:08x}\n")
    tell = lambda tag, rows: out.append("".join("\t".join([tag, *map(str, r)]) + "\n" for r in rows))
    found = readstats.quality_by_cycle(reads, quality).collect()
    for tag, last in (("FFQ", False), ("LFQ", True)):
        own = {(r.cycle, r.quality): r.n for r in found if r.is_last == last}
        top = max((q for _, q in own), default=-1)
        tell(tag, [[c + 1, *(own.get((c, q), 0) for q in range(top + 1))] for c in sorted({c for c, _ in own})])
    steps = readstats.gc_plateaus(reads).orderBy("percent").collect()
    for tag, last in (("GCF", False), ("GCL", True)):
        tell(tag, [(f"{r.percent:.2f}", r.n) for r in steps if r.is_last == last])
    for tag, oriented in (("GCC", False), ("GCT", True)):
        own: dict[int, dict[str, int]] = {}
        for r in readstats.bases_by_cycle(reads, oriented).collect():
            own.setdefault(r.cycle, dict.fromkeys("ACGT", 0))[r.base] += r.n
        tell(tag, [(c + 1, *(f"{100 * n / sum(b.values()):.2f}" for n in b.values())) for c, b in sorted(own.items())])
    bases = readstats.bases_by_cycle(reads).collect()
    totals = {r.is_last: r for r in readstats.total_bases(reads).collect()}
    for tag, total, last in (("FBC", "FTC", False), ("LBC", "LTC", True)):
        share = {(r.cycle, r.base): r.percent for r in bases if r.is_last == last}
        tell(tag, [(c + 1, *(f"{share.get((c, b), 0.0):.2f}" for b in "ACGT")) for c in sorted({c for c, _ in share})])
        tell(total, [[getattr(totals[last], b) for b in "acgtn"]] if last in totals else [[0] * 5])
    sizes: dict[int, dict[str, int]] = {}
    for r in readstats.insert_sizes(reads).collect():
        sizes.setdefault(r.size, {"inward": 0, "outward": 0, "other": 0})[r.orientation] = r.n
    tell("IS", [(k, sum(v.values()) // 2, *(n // 2 for n in v.values())) for k, v in sorted(sizes.items())])
    lengths = readstats.lengths(reads).orderBy("length").collect()
    for tag in ("RL", "FRL", "LRL"):
        tell(tag, [(r.length, r.n) for r in lengths if r.section == tag])
    tell("MAPQ", [tuple(r) for r in readstats.mapping_qualities(reads).orderBy("mapq").collect()])
    tell("ID", [tuple(r) for r in readstats.indels(reads).orderBy("size").collect()])
    cycles: dict[int, dict[tuple[str, bool], int]] = {}
    for r in readstats.indels_by_cycle(reads).collect():
        cycles.setdefault(r.cycle, {})[r.op, r.is_last] = r.n
    tell("IC", [(c + 1, *(v.get(k, 0) for k in (("I", False), ("I", True), ("D", False), ("D", True)))) for c, v in sorted(cycles.items())])
    tell("COV", [(f"[{r.depth}-{r.depth}]" if r.depth <= 1000 else "[1000<]", min(r.depth, 1000), r.n_bases) for r in readstats.depth_histogram(reads).orderBy("depth").collect()])
    mean = row["total_length"] / row["raw_total"] if row["raw_total"] else 0.0
    tell("GCD", [(one_place(r[0]), *(f"{v:.3f}" for v in r[1:])) for r in readstats.gc_depth_report(readstats.gc_depth(reads), mean)])
    return "".join(out)


def origin_text(origin: dict, cascade: dict, votes: dict, bias: dict, motifs: list[tuple[str, float]], at_junctions: int, bam: str, gtf: str, library: str = "unstranded") -> str:
    """The read origin report."""
    n = {k: origin.get(k, 0) for k in ("exonic", "intronic", "intergenic", "ambiguous", "overlapping_exon")}
    placed = n["exonic"] + n["intronic"] + n["intergenic"]
    two = lambda v: "NaN" if v is None or v != v else f"{v:.2f}".rstrip("0").rstrip(".")
    share = lambda k: f"{commas(n[k])} ({two(100 * n[k] / placed if placed else 0.0)}%)"
    all_votes = votes["ssp_fwd"] + votes["ssp_rev"]
    # The headings and their lines.
    sections = {
        "Input": [f"bam file = {bam}", f"gff file = {gtf}", "counting algorithm = uniquely-mapped-reads", f"protocol = {'non-strand-specific' if library == 'unstranded' else 'strand-specific-' + library}", "5'-3' bias region size = 100", "5'-3' bias number of top transcripts = 1000"],
        "Reads alignment": [f"reads aligned  = {commas(cascade['read_count'])}", f"total alignments = {commas(cascade['read_count'] + cascade['secondary'])}", f"secondary alignments = {commas(cascade['secondary'])}", f"non-unique alignments = {commas(cascade['multi_mapped'])}", f"aligned to genes  = {commas(n['exonic'])}", f"ambiguous alignments = {commas(n['ambiguous'])}", f"no feature assigned = {commas(n['intronic'] + n['intergenic'])}", f"not aligned = {commas(cascade['not_aligned'])}"]
        + ([f"SSP estimation (fwd/rev) = {votes['ssp_fwd'] / all_votes:.2f} / {votes['ssp_rev'] / all_votes:.2f}"] if all_votes else []),
        "Reads genomic origin": [f"exonic =  {share('exonic')}", f"intronic = {share('intronic')}", f"intergenic = {share('intergenic')}", f"overlapping exon = {share('overlapping_exon')}"],
        "Transcript coverage profile": [f"5' bias = {two(bias['bias_5p'])}", f"3' bias = {two(bias['bias_3p'])}", f"5'-3' bias = {two(bias['bias_5p_3p'])}"],
        "Junction analysis": [f"reads at junctions = {commas(at_junctions)}", *([""] + [f"{m} : {two(p)}%" for m, p in motifs] if motifs else [])],
    }
    body = "\n\n\n".join(f">>>>>>> {title}\n\n" + "\n".join(f"    {x}" if x else "" for x in lines) for title, lines in sections.items())
    return "RNA-Seq QC report\n-----------------------------------\n\n" + body + "\n"


def write_feature_counts(exons: DataFrame, genes: DataFrame, lengths: DataFrame, counts: DataFrame, contigs: DataFrame, path: str, sample: str) -> None:
    """Genes in annotation order with their exons' contigs, ends and strands, length and reads."""
    parts = exons.join(contigs.select("tid", "name"), "tid").groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "name", "strand"))).alias("x"))
    rows = genes.select("gene_id", "gene_ord").join(parts, "gene_id").join(lengths, "gene_id", "left").join(counts, "gene_id", "left").orderBy("gene_ord").collect()
    joined = lambda r, f: ";".join(str(f(x)) for x in r.x)
    write_table([[r.gene_id, joined(r, lambda x: x.name), joined(r, lambda x: x.s + 1), joined(r, lambda x: x.e), joined(r, lambda x: x.strand), r.eff_len or 0, r.fc_reads or 0] for r in rows], path, ["Geneid", "Chr", "Start", "End", "Strand", "Length", sample])


def inner_distance_text(histogram: DataFrame, step: int = 5) -> str:
    """Mean, median and sample deviation from bin centres."""
    rows = sorted((r.lo + step / 2, r.n) for r in histogram.collect())
    total = sum(n for _, n in rows)
    if total < 2:
        return "Name\tNA\n"
    mean = sum(c * n for c, n in rows) / total
    upto, median = 0, rows[-1][0]
    for c, n in rows:
        upto += n
        if 2 * upto >= total:
            median = c
            break
    deviation = math.sqrt(sum(n * (c - mean) ** 2 for c, n in rows) / (total - 1))
    return f"mean\t{sig15(mean)}\nmedian\t{sig15(median)}\nsd\t{sig15(deviation)}\n"


def clean(value):
    """JSON without numbers that are none."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: clean(v) for k, v in value.items()}
    return [clean(v) for v in value] if isinstance(value, (list, tuple)) else value


def write_envelope(document: dict, path: str) -> None:
    """Key order is kept."""
    Path(path).write_text(json.dumps(clean(document), indent=2) + "\n")


# The columns of the per-gene file, in order, and the kinds of those that have others here.
GENE_COLUMNS = (
    "gene_id gene_symbol chrom gene_start gene_end strand effective_length biotype fragment_count_assigned primary_reads primary_reads_unique primary_reads_unique_nodup primary_reads_multi fc_reads "
    "tlen_bin_lt_50 tlen_bin_50_80 tlen_bin_80_120 tlen_bin_120_160 tlen_bin_160_200 tlen_bin_200_300 tlen_bin_300_500 tlen_bin_gt_500 tlen_overflow tlen_count tlen_mean tlen_median_approx tlen_min tlen_max "
    "em_pair_count_used em_pair_count_skipped_non_acgt em_pair_count_skipped_oob em_5p em_3p em_shannon_5p em_shannon_3p em_jsd_5p_3p decile_coverage soft_clip_rate_5p soft_clip_rate_3p primary_reads_with_5p_clip primary_reads_with_3p_clip "
    "exon_aligned_bp intron_aligned_bp cds_aligned_bp utr_aligned_bp cds_utr_ratio intron_retention_rate"
).split()
GENE_KINDS = {"em_5p": "map<string,bigint>", "em_3p": "map<string,bigint>", "em_shannon_5p": "double", "em_shannon_3p": "double", "em_jsd_5p_3p": "double", "biotype": "string", "gene_symbol": "string"}


def gene_layout(table: DataFrame, contigs: DataFrame) -> DataFrame:
    """The per-gene table in the file's columns, after gene_ord; places count from 1. What the table lacks (motifs without a reference) is null, or 0 for counts."""
    named = table.join(F.broadcast(contigs.select("tid", F.col("name").alias("chrom"))), "tid", "left")  # a row for each contig
    own = {"gene_symbol": F.col("symbol") if "symbol" in table.columns else None, "gene_start": F.col("s") + 1, "gene_end": F.col("e")}

    def column(name: str) -> Column:
        known = own.get(name)
        if known is None and name in named.columns:
            known = F.col(name)
        if known is None:
            known = F.lit(0).cast("long") if name.startswith("em_pair") else F.lit(None).cast(GENE_KINDS[name])
        return known.alias(name)

    return named.select("gene_ord", *map(column, GENE_COLUMNS))


def gene_metadata(document: dict, min_reads: int, n_genes: int, n_rows: int) -> dict[str, str]:
    """The file's notes, from the sample's document."""
    told = {"sample_id": document["sample_id"], "extractor_version": document["extractor_version"], "git_commit": document["git_commit"], "per_gene_schema_version": document["schema_version"], "bam_md5": document["bam_md5"], "gtf_md5": document["gtf_md5"], "library_prep": document["library_prep"], "min_gene_reads_threshold": min_reads, "n_genes_total": n_genes, "n_genes_emitted": n_rows, "paired_end": str(document["paired_end"]).lower(), "strandedness": document["strandedness"]}
    return {f"helixmill.{k}": str(v) for k, v in told.items()}


def write_per_gene(table: DataFrame, path: str, metadata: dict[str, str], contigs: DataFrame | None = None) -> None:
    """One file with key-value metadata, 10,000 rows a group, with contigs in the file's layout; batches pass through the driver one at a time."""
    ordered = (table if contigs is None else gene_layout(table, contigs)).orderBy("gene_ord")
    ordered = ordered if contigs is None else ordered.drop("gene_ord")
    writer = None
    try:
        names, part = ordered.columns, []

        def flush() -> None:
            nonlocal writer, part
            batch = pa.Table.from_pylist([r.asDict(recursive=True) for r in part], schema=schema)
            writer = writer or pq.ParquetWriter(path, schema.with_metadata({k.encode(): str(v).encode() for k, v in metadata.items()}), compression="snappy")
            writer.write_table(batch, row_group_size=10_000)
            part = []

        schema = ordered.limit(0).toArrow().schema
        for row in ordered.toLocalIterator(prefetchPartitions=False):
            part.append(row)
            if len(part) == 10_000:
                flush()
        if part or writer is None:
            flush()
        assert names
    finally:
        if writer:
            writer.close()
