import gzip
import struct
import zlib

import pytest

from helixmill.operators import readstats
from helixmill.plans import report, views
from helixmill.sources import alignments, annotation, config, sinks
from helixmill.streaming import counters

SAM = """@HD\tVN:1.6
@SQ\tSN:chr1\tLN:2000
@SQ\tSN:chr2\tLN:1000
r1\t99\tchr1\t101\t60\t5M\t=\t201\t105\tACGTN\tIIIII\tNH:i:1\tHI:i:1\tRG:Z:x
r1\t147\tchr1\t201\t60\t2S3M\t=\t101\t-105\tGGGTT\tABCDE\tNH:i:2\tNM:i:1
u\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*
"""


def bam(path):
    """The records of SAM as BAM, in two BGZF blocks."""
    text = b"@HD\tVN:1.6\n"
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 2)
    for name, n in ((b"chr1\0", 2000), (b"chr2\0", 1000)):
        head += struct.pack("<i", len(name)) + name + struct.pack("<i", n)
    body = b""
    for line in SAM.splitlines()[3:]:
        f = line.split("\t")
        tid, mtid = (0 if f[2] == "chr1" else -1), (0 if f[6] == "=" else -1)
        ops, n = b"", ""
        for c in f[5] if f[5] != "*" else "":
            if c.isdigit():
                n += c
            else:
                ops, n = ops + struct.pack("<I", int(n) << 4 | alignments.OPS.index(c)), ""
        seq = f[9] + "=" * (len(f[9]) % 2)
        packed = bytes(alignments.BASES.index(seq[i]) << 4 | alignments.BASES.index(seq[i + 1]) for i in range(0, len(seq), 2))
        qual = bytes(ord(c) - 33 for c in f[10]) if f[10] != "*" else b"\xff" * len(f[9])
        tags = b"".join(t[:2].encode() + (b"C" + bytes([int(t[5:])]) if t[3] == "i" else b"Z" + t[5:].encode() + b"\0") for t in f[11:])
        name = f[0].encode() + b"\0"
        rec = struct.pack("<iiBBHHHiiii", tid, int(f[3]) - 1, len(name), int(f[4]), 0, len(ops) // 4, int(f[1]), len(f[9]), mtid, int(f[7]) - 1, int(f[8])) + name + ops + packed + qual + tags
        body += struct.pack("<i", len(rec)) + rec
    data = head + body
    with open(path, "wb") as out:
        for part in (data[:70], data[70:], b""):
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.write(c.compress(part) + c.flush())


def bgzf(path, data, size):
    """data as blocks of `size` bytes with their sizes in their headers."""
    with open(path, "wb") as out:
        for part in [*(data[a : a + size] for a in range(0, len(data), size)), b""]:
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = c.compress(part) + c.flush()
            out.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))


def test_large_bam_files_are_read_in_parts(spark, tmp_path):
    def data(n, tag):
        out = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 10**6)
        for k in range(n):
            name, bases = f"{tag}{k}".encode() + b"\0", 7 + k % 5
            packed = bytes([0x12] * ((bases + 1) // 2))
            rec = struct.pack("<iiBBHHHiiii", 0, k, len(name), 60, 0, 1, 0, bases, -1, -1, 0) + name + struct.pack("<I", bases << 4) + packed + bytes([k % 40] * bases) + b"NHC\x01"
            out += struct.pack("<i", len(rec)) + rec
        return out

    (tmp_path / "in").mkdir()
    for size in (23, 500, 60_000):
        bgzf(tmp_path / "in" / "a.bam", data(400, "a"), size)
        bgzf(tmp_path / "in" / "b.bam", data(7, "b"), size)
        reads, contigs = alignments.read_bam(spark, str(tmp_path / "in"), records=50)
        rows = reads.orderBy("rec_ord").collect()
        assert [(r.qname, r.pos, r.cigar, r.nh) for r in rows] == [(f"a{k}", k, f"{7 + k % 5}M", 1) for k in range(400)] + [(f"b{k}", k, f"{7 + k % 5}M", 1) for k in range(7)]
        assert [r.rec_ord for r in rows] == [*range(400), *((1 << alignments.ORDER_BITS) + k for k in range(7))]
        assert rows[3].seq == "ACACACACAC" and rows[3].qual == "$" * 10 and contigs.count() == 1
    bgzf(tmp_path / "x.bam", data(400, "a"), 500)
    with alignments.opened(str(tmp_path / "x.bam")) as handle:
        parts = list(alignments.bam_parts(handle, 50))
    assert sum(p[3] for p in parts) == 400 and len(parts) >= 6


def test_settings_names():
    p = config.Params.of({"rna": {"junction_saturation": {"percentile_floor": 10}, "preseq": {"step_size": 5.0, "defects": True}, "stranded": "Reverse", "chromosome_mapping": {"1": "chr1"}}})
    assert p["junction_saturation"]["percentile_floor"] == 10 and p["complexity"]["step"] == 5.0 and p["library"] == "reverse" and p["chromosome_mapping"] == {"1": "chr1"}
    for wrong in ({"inner_distance": {"low": 1}}, {"nonsense": 1}, {"preseq": {"steps": 1}}):
        with pytest.raises(ValueError):
            config.Params.of(wrong)


def test_sam_and_bam_agree(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    bam(tmp_path / "a.bam")
    columns = ["qname", "flag", "contig", "pos", "mapq", "cigar", "mpos", "tlen", "seq", "qual", "nh", "hi", "nm", "is_dup", "is_primary"]
    a, ca = alignments.read_sam(spark, str(tmp_path / "a.sam"))
    b, cb = alignments.read_bam(spark, str(tmp_path / "a.bam"))
    rows = lambda d: [tuple(r) for r in d.orderBy("rec_ord").select(*columns).collect()]
    assert rows(a) == rows(b) and len(rows(a)) == 3
    assert rows(a)[0][:5] == ("r1", 99, "chr1", 100, 60) and rows(a)[1][10:13] == (2, None, 1)
    assert [tuple(r) for r in ca.orderBy("tid").collect()] == [tuple(r) for r in cb.orderBy("tid").collect()] == [(0, "chr1", 2000, "chr1"), (1, "chr2", 1000, "chr2")]
    assert [r.q for r in a.where("flag = 147").select(alignments.quality().alias("q")).collect()] == [[32, 33, 34, 35, 36]]
    alignments.save(a, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("contig = 'chr1'").count() == 2


GTF = """#!comment
chr1\tx\tgene\t1\t900\t.\t+\t.\tgene_id "A";
chr1\tx\texon\t101\t200\t.\t+\t.\tgene_id "A"; transcript_id "A1"; gene_name "Aa"; gene_type "rRNA";
chr1\tx\texon\t301\t400\t.\t+\t.\tgene_id "A"; transcript_id "A1"; gene_name "Zz";
chr1\tx\tCDS\t151\t350\t.\t+\t.\tgene_id "A"; transcript_id "A1";
chr1\tx\tstart_codon\t151\t153\t.\t+\t.\tgene_id "A"; transcript_id "A1";
chr1\tx\tstop_codon\t348\t350\t.\t+\t.\tgene_id "A"; transcript_id "A1";
chr2\tx\texon\t11\t90\t.\t-\t.\tgene_id "B"; transcript_id "B1";
chr2\tx\tCDS\t21\t80\t.\t-\t.\tgene_id "B"; transcript_id "B1";
chr2\tx\tstart_codon\t78\t80\t.\t-\t.\tgene_id "B"; transcript_id "B1";
chr2\tx\tstop_codon\t21\t23\t.\t-\t.\tgene_id "B"; transcript_id "B1";
chr2\tx\texon\t201\t290\t.\t.\t.\tgene_id "C";
chr2\tx\texon\t1\t9\t.\t+\t.\ttranscript_id "lost";
"""


@pytest.mark.parametrize("packed", [False, True])
def test_gtf(spark, tmp_path, packed):
    path = tmp_path / "a.gtf"
    path.write_bytes(gzip.compress(GTF.encode()) if packed else GTF.encode())
    g = annotation.read_gtf(spark, str(path), ("gene_name", "gene_type"))
    genes = annotation.genes(g, ("gene_name", "gene_type")).orderBy("gene_ord").collect()
    assert [(r.gene_id, r.contig, r.s, r.e, r.strand) for r in genes] == [("A", "chr1", 100, 400, "+"), ("B", "chr2", 10, 90, "-"), ("C", "chr2", 200, 290, ".")]
    assert (genes[0].gene_name, genes[0].gene_type, genes[1].gene_name) == ("Aa", "rRNA", None)
    tx = {r.tx_id: (r.s, r.e, r.cds_s, r.cds_e) for r in annotation.transcripts(g).collect()}
    assert tx == {"A1": (100, 400, 150, 350), "B1": (10, 90, 20, 80), "C__no_tx": (200, 290, None, None)}
    assert annotation.digest(str(path), unpacked=True) == annotation.digest(str(path)) or packed


def test_small_tables(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("# c\ngene_id\tgene_symbol\tpanel\tcell_type\tweight\n\tHBB\tp1\tred\t1\nG1\tX\tp1\tblue\t1\n")
    assert [tuple(r) for r in annotation.read_panels(spark, str(tmp_path / "p.tsv")).collect()] == [(None, "HBB", "p1", "red"), ("G1", "X", "p1", "blue")]
    (tmp_path / "bad.tsv").write_text("a\tb\n")
    with pytest.raises(ValueError):
        annotation.read_panels(spark, str(tmp_path / "bad.tsv"))
    (tmp_path / "s.tsv").write_text("#x\nchrom\tpos\tref\talt\nchr1\t10\ta\tG\trs1\nchr9\t3\tC\tT\n")
    sites = annotation.read_snps(spark, str(tmp_path / "s.tsv"))
    assert [tuple(r) for r in sites.collect()] == [("chr1", 9, "A", "G", "rs1"), ("chr9", 2, "C", "T", None)]
    assert annotation.missing_contigs(sites, spark.createDataFrame([("chr1",)], "name string")) == 1
    with pytest.raises(ValueError):
        annotation.read_snps(spark, "x.vcf")
    (tmp_path / "c.txt").write_text("HBB\n\n# no\n HBA1 \n")
    assert sorted(r.symbol for r in annotation.read_symbols(spark, hb=str(tmp_path / "c.txt")).collect()) == ["HBA1", "HBB"]


def test_fasta_chunks(spark, tmp_path):
    seqs = {"c1": "ACGTTGCAAC" * 5 + "TT", "c2": "GG", "c3": "ACGTACGTA"}
    (tmp_path / "f.fa").write_text("".join(f">{n} about\n" + "\n".join(s[i : i + 7] for i in range(0, len(s), 7)) + "\n" for n, s in seqs.items()))
    rows = annotation.read_fasta(spark, str(tmp_path / "f.fa"), chunk=8, overlap=3).collect()
    assert {(r.contig, r.chunk_no): r.seq for r in rows} == {(n, k): s[k * 8 : k * 8 + 11] for n, s in seqs.items() for k in range(-(-len(s) // 8))}


def test_settings():
    p = config.Params.of({"tin": {"min_coverage": 5}}, {"tin": {"sample_size": 50}}, min_mapq=20)
    assert (p["tin"], p["min_mapq"], p["min_intron"]) == ({"enabled": True, "sample_size": 50, "min_coverage": 5}, 20, 50)
    assert config.fractions("0.1,x,1") == [0.1, 1.0] and config.DEFAULTS["tin"]["min_coverage"] == 10


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sample(spark):
    from helixmill.plans.catalog import Tables

    try:
        t = Tables(spark, DATA)
        reads = t.reads.cache()
    except Exception as e:
        pytest.skip(f"no driver tables: {e}")
    return report.Sample("s1", reads, t.contigs, t.exons, t.genes, t.transcripts, t.tx_exons)


def test_whole_report(sample, tmp_path):
    params = config.Params.of(library_prep="ligation", complexity={"max_extrap": 5e4, "step": 1e3}, min_gene_reads=1)
    doc = report.run(sample, params)
    assert doc["flagstat"]["total"] == sample.reads.count() == sum(doc["bam_stat"][k] for k in ("qc_failed", "duplicate", "non_primary", "unmapped", "non_unique", "unique"))
    assert set(report.REQUIRED) <= set(doc) and set(report.schema()["required"]) == set(report.REQUIRED) and doc["read_count_total"] == doc["flagstat"]["total"] and doc["peak_rss_mb"] > 0
    assert "end_motifs_skipped_no_fasta" in doc["qc_flags"] and doc["qc_flags"] == sorted(doc["qc_flags"])
    shares = [p["genes_ge_1"] for p in doc["saturation"]]
    assert shares == sorted(shares) and doc["junction_saturation"][-1]["percent"] == 100
    sinks.write_envelope(doc, str(tmp_path / "e.json"))
    assert (tmp_path / "e.json").read_text().startswith('{\n  "schema_version"')
    table = report.per_gene(sample, params)
    sinks.write_per_gene(table, str(tmp_path / "g.parquet"), {"sample_id": "s1"})
    import pyarrow.parquet as pq

    back = pq.read_table(tmp_path / "g.parquet")
    assert back.num_rows == table.count() > 0 and back.schema.metadata[b"sample_id"] == b"s1"
    notes = sinks.gene_metadata(doc, 1, sample.genes.count(), back.num_rows)
    sinks.write_per_gene(table, str(tmp_path / "h.parquet"), notes, sample.contigs)
    laid = pq.read_table(tmp_path / "h.parquet")
    assert laid.column_names == sinks.GENE_COLUMNS and len(laid.column_names) == 47 and laid.num_rows == back.num_rows
    assert laid["gene_start"].to_pylist() == [s + 1 for s in back["s"].to_pylist()] and set(laid["chrom"].to_pylist()) <= {"chr1", "chr2", "chr3", "chr4", "chr5"} and laid["em_5p"].null_count == laid.num_rows
    assert len(notes) == 12 and laid.schema.metadata[b"helixmill.n_genes_emitted"] == str(back.num_rows).encode()
    with pytest.raises(ValueError):
        report.run(sample, config.Params.of())


def test_text_reports(sample, tmp_path):
    from pyspark.sql import functions as F

    from helixmill.operators import counting, intervals, qualimap, rseqc

    reads = sample.reads.withColumn("qual", F.array_join(F.transform("quality", lambda q: F.chr(q + 33)), ""))
    text = sinks.stats_text(reads, F.col("quality"))
    tags = {line.split("\t")[0] for line in text.splitlines()}
    assert tags >= set("CHK SN FFQ LFQ GCF GCL GCC GCT FBC LBC FTC LTC IS RL FRL LRL MAPQ ID IC COV GCD".split())
    assert text.count("\nSN\t") == 39 and f"SN\traw total sequences:\t{reads.where('flag & 2304 = 0').count()}\t# excluding" in text
    row = readstats.bam_stat(reads).first().asDict()
    assert f"{'Total records:':<40}{row['total']}\n\n" in sinks.bam_stat_text(row)
    told = rseqc.infer_strandedness(rseqc.strand_classes(reads, sample.transcripts)).first().asDict()
    assert 'explained by "1++,1--,2+-,2-+": ' + f"{told['forward']:.4f}" in sinks.infer_text(told, "PairEnd") and "Unknown" in sinks.infer_text(told, "Mixture")
    assert sinks.fit_text({"intercept": 0.597277876400675, "slope": 0.967140186993884}, "test") == "test - dupRadar Int (duprate at low read counts): 0.597277876400675\ntest - dupRadar Sl (progression of the duplication rate): 0.967140186993884\n"
    motifs = [(r.motif, r.percent) for r in qualimap.junction_motifs(reads).collect()]
    origin = {r.origin: r.n for r in qualimap.origin(reads, sample.exons, sample.tx_exons).collect()}
    out = sinks.origin_text(origin, qualimap.cascade_counts(reads).first().asDict(), qualimap.strand_votes(reads, sample.exons).first().asDict(), {"bias_5p": 1.5, "bias_3p": None, "bias_5p_3p": 0.25}, motifs, 10, "a.bam", "a.gtf")
    assert "    5' bias = 1.5\n    3' bias = NaN\n    5'-3' bias = 0.25" in out and len(motifs) == 11 and ">>>>>>> Junction analysis" in out
    status = counting.read_status(reads, sample.exons)
    fc = status.where("gene_id is not null").groupBy("gene_id").agg(F.count("*").alias("fc_reads"))
    sinks.write_feature_counts(sample.exons, sample.genes, intervals.union_length(sample.exons, ["gene_id"]), fc, sample.contigs, str(tmp_path / "fc.txt"), "s1")
    lines = (tmp_path / "fc.txt").read_text().splitlines()
    assert lines[0].split("\t")[-1] == "s1" and len(lines) == 1 + sample.genes.count() and sum(int(x.split("\t")[-1]) for x in lines[1:]) == fc.agg(F.sum("fc_reads")).first()[0]
    sinks.write_biotypes(counting.biotype_counts(counting.biotype_status(reads, sample.exons)), str(tmp_path / "b.txt"), "s1")
    sinks.write_status(counting.status_counts(status, reads), str(tmp_path / "s.txt"), "s1")
    assert "Unassigned_NoFeatures" in (tmp_path / "s.txt").read_text()
    assert sinks.flagstat_text(readstats.flagstat(reads).first().asDict()).count("\n") == 16
    sinks.write_idxstats(readstats.idxstats(reads, sample.contigs), str(tmp_path / "i.txt"))
    assert (tmp_path / "i.txt").read_text().splitlines()[-1].startswith("*\t0\t")
    events, known = rseqc.splice_events(reads), rseqc.known_introns(sample.tx_exons)
    found = rseqc.junctions(events, known)
    sinks.write_junctions(found, sample.contigs, str(tmp_path / "j.xls"))
    sinks.junction_bed(found, sample.contigs, str(tmp_path / "j.bed"))
    assert len((tmp_path / "j.xls").read_text().splitlines()) == 1 + len((tmp_path / "j.bed").read_text().splitlines())
    sinks.write_tin(rseqc.tin(reads, sample.transcripts, sample.tx_exons), str(tmp_path / "t.xls"))
    far = rseqc.distance_histogram(rseqc.inner_distances(reads, sample.transcripts, intervals.merge(sample.exons, ["tid"])))
    sinks.write_histogram(far, ["lo", "n"], str(tmp_path / "d.txt"))
    assert sinks.inner_distance_text(far).startswith("mean\t")
    sets = rseqc.regions(sample.transcripts, sample.tx_exons)
    assert "cds_exon" in sinks.region_text(rseqc.region_report(rseqc.region_tags(reads, sets), sets))


def test_invariance_under_order_and_partitions(sample):
    mixed = sample.reads.repartition(7).orderBy("seq")
    assert readstats.flagstat(mixed).collect() == readstats.flagstat(sample.reads).collect()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(readstats.depth_histogram(mixed)) == key(readstats.depth_histogram(sample.reads))


def test_streaming_totals_equal_one_pass(spark, sample, tmp_path):
    sample.reads.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sample.reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counters.keep_flagstat(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    parts = spark.read.parquet(str(tmp_path / "out"))
    assert parts.count() == 3 and counters.total(parts).first() == readstats.flagstat(sample.reads).first()


def test_views_use_every_shape(sample):
    assert {r.ln for r in sample.reads.select("ln").distinct().collect()} == set(views.SHAPES)
