"""Annotation and dimension sources."""

from __future__ import annotations

import gzip
import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def is_gzip(path: str) -> bool:
    """By the file's first bytes, not its name."""
    with open(path, "rb") as f:
        return f.read(2) == b"\x1f\x8b"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line, in file order; compressed text is found by content where the path is local."""
    if not path.endswith(".gz") and os.path.isfile(path) and is_gzip(path):
        files = spark.read.format("binaryFile").load(path)

        def unpack(batches):
            import pandas as pd

            for b in batches:
                for content in b.content:
                    lines = gzip.decompress(content).decode().split("\n")
                    for a in range(0, len(lines), 10_000):
                        yield pd.DataFrame({"value": lines[a : a + 10_000]})

        lines = files.select("content").mapInPandas(unpack, "value string")
    else:
        lines = spark.read.text(path)
    return lines.withColumn("line", F.monotonically_increasing_id())


def attribute(attrs: Column | str, key: str) -> Column:
    """The first value of a GTF attribute, null where absent."""
    found = F.regexp_extract(attrs, rf'(?:^|;)\s*{key}\s+"?([^";]*)"?', 1)
    return F.when(found != "", F.trim(found))


def read_gtf(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Exon, CDS, start and stop codon rows on half-open intervals, in file order."""
    f = F.split("value", "\t")
    lines = text_lines(spark, path).where(~F.col("value").startswith("#") & (F.size(F.split("value", "\t")) >= 9))
    rows = lines.select("line", f[0].alias("contig"), f[2].alias("feature"), (f[3].cast("long") - 1).alias("s"), f[4].cast("long").alias("e"), f[6].alias("strand"), f[8].alias("attrs")).where(F.col("feature").isin("exon", "CDS", "start_codon", "stop_codon"))
    if rows.where("s >= e").take(1):
        raise ValueError("a feature starts beyond its end")
    gene = attribute("attrs", "gene_id")
    tx = F.coalesce(attribute("attrs", "transcript_id"), F.concat(gene, F.lit("__no_tx")))
    return rows.where(gene.isNotNull()).select("line", "contig", "feature", "s", "e", "strand", gene.alias("gene_id"), tx.alias("tx_id"), *[attribute("attrs", k).alias(k) for k in extra])


def exons(gtf: DataFrame) -> DataFrame:
    return gtf.where("feature = 'exon'")


def genes(gtf: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Genes in the order they first appear; contig, strand and attributes of the first exon."""
    first = lambda c: F.min_by(c, "line").alias(c)
    per = exons(gtf).groupBy("gene_id").agg(F.min("line").alias("gene_ord"), first("contig"), first("strand"), F.min("s").alias("s"), F.max("e").alias("e"), *[first(c) for c in extra])
    return per


def transcripts(gtf: DataFrame) -> DataFrame:
    """D5, A.1: spans, and CDS ranges from the last codon lines; a coding transcript without codons is all CDS."""
    key = ["gene_id", "tx_id"]
    codon = lambda kind, c: F.max_by(F.when(F.col("feature") == kind, F.col(c)), F.when(F.col("feature") == kind, F.col("line")))
    per = gtf.groupBy(*key).agg(
        F.min(F.when(F.col("feature") == "exon", F.col("line"))).alias("tx_ord"),
        F.min_by("contig", F.when(F.col("feature") == "exon", F.col("line"))).alias("contig"),
        F.min_by("strand", F.when(F.col("feature") == "exon", F.col("line"))).alias("strand"),
        F.min(F.when(F.col("feature") == "exon", F.col("s"))).alias("s"),
        F.max(F.when(F.col("feature") == "exon", F.col("e"))).alias("e"),
        F.count_if(F.col("feature") == "CDS").alias("n_cds"),
        codon("start_codon", "s").alias("start_s"), codon("start_codon", "e").alias("start_e"), codon("stop_codon", "s").alias("stop_s"), codon("stop_codon", "e").alias("stop_e"),
    ).where("s is not null")
    plus, minus = F.col("strand") == "+", F.col("strand") == "-"
    low = F.when(plus, F.coalesce("start_s", "s")).when(minus, F.coalesce(F.col("stop_e") - 3, "s")).otherwise(F.col("s"))
    high = F.when(plus, F.coalesce("stop_e", "e")).when(minus, F.coalesce(F.col("start_s") + 3, "e")).otherwise(F.col("e"))
    coding = F.col("n_cds") > 0
    return per.select(*key, "tx_ord", "contig", "strand", "s", "e", F.when(coding, low).alias("cds_s"), F.when(coding, high).alias("cds_e"))


def has_attribute(gtf_lines: DataFrame, key: str, rows: int = 1000) -> bool:
    """Does one of the first exon rows have the attribute?"""
    head = gtf_lines.where(F.col("value").rlike(r"^[^#\t]+\t[^\t]*\texon\t")).limit(rows)
    return bool(head.where(attribute(F.col("value"), key).isNotNull() | F.col("value").rlike(rf'\b{key} "')).take(1))


def contig_names(gtf_lines: DataFrame, rows: int = 1000) -> DataFrame:
    """Name of the contigs of the first feature rows, for cohort.naming_style."""
    return gtf_lines.where(~F.col("value").startswith("#")).limit(rows).select(F.split("value", "\t")[0].alias("name")).distinct()


def read_panels(spark: SparkSession, *paths: str) -> DataFrame:
    """Marker panels; five fields a row, an optional header, # comments."""
    out = None
    for path in paths:
        lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
        f = F.split("value", "\t")
        if lines.where(F.size(F.split("value", "\t")) < 5).take(1):
            raise ValueError(f"{path}: a row has fewer than five fields")
        rows = lines.select(F.when(f[0] != "", f[0]).alias("gene_id"), f[1].alias("gene_symbol"), f[2].alias("panel"), f[3].alias("cell_type")).where("gene_symbol <> 'gene_symbol'")
        out = rows if out is None else out.unionByName(rows)
    return out


def read_snps(spark: SparkSession, path: str) -> DataFrame:
    """Sites from tab-separated chrom, 1-based pos, ref, alt and optional id."""
    if path.endswith((".vcf", ".gz", ".bcf")):
        raise ValueError("sites are read from tab-separated text")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    rows = lines.select(f[0].alias("contig"), (f[1].try_cast("long") - 1).alias("site"), F.upper(f[2]).alias("ref"), F.upper(f[3]).alias("alt"), F.get(f, F.lit(4)).alias("rsid"))
    return rows.where("site is not null")


def missing_contigs(sites: DataFrame, contigs: DataFrame) -> int:
    return sites.join(contigs.select(F.col("name").alias("contig")), "contig", "left_anti").count()


def read_symbols(spark: SparkSession, **paths: str) -> DataFrame:
    """Class and symbol from lists of one symbol a line."""
    out = None
    for name, path in paths.items():
        rows = spark.read.text(path).select(F.lit(name).alias("class"), F.trim("value").alias("symbol")).where("symbol <> '' and symbol not like '#%'")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def read_fasta(spark: SparkSession, path: str, chunk: int = 65536, overlap: int = 3) -> DataFrame:
    """Contig, chunk_no and seq, in chunks of `chunk` bases that run `overlap` bases into the next.

    Lines get their place in the contig from running lengths, so a contig is never one row.
    """
    lines = text_lines(spark, path).where("value <> ''")
    heads = lines.where(F.col("value").startswith(">")).select("line", F.regexp_extract("value", r"^>(\S+)", 1)).collect()  # one row a contig
    if not heads:
        return spark.createDataFrame([], "contig string, chunk_no long, seq string")
    table = F.array(*[F.struct(F.lit(n).alias("line"), F.lit(name).alias("name")) for n, name in sorted(tuple(h) for h in heads)])
    body = lines.where(~F.col("value").startswith(">"))
    marked = body.withColumn("contig", F.element_at(F.filter(table, lambda h: h.line < F.col("line")), -1)["name"])
    before = Window.partitionBy("contig").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("at", F.coalesce(F.sum(F.length("value")).over(before), F.lit(0)))
    first, last = F.floor(F.greatest(F.lit(0), F.col("at") - overlap) / chunk), F.floor((F.col("at") + F.length("value") - 1) / chunk)
    dealt = placed.withColumn("chunk_no", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest(F.col("at"), F.col("chunk_no") * chunk), F.least(F.col("at") + F.length("value"), (F.col("chunk_no") + 1) * chunk + overlap)
    pieces = dealt.select("contig", "chunk_no", lo.alias("lo"), F.substring("value", (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int")).alias("p")).where("p <> ''")
    return pieces.groupBy("contig", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("lo", "p"))).alias("ps")).select("contig", F.col("chunk_no").cast("long").alias("chunk_no"), F.array_join(F.transform("ps", lambda x: x.p), "").alias("seq"))


def digest(path: str, unpacked: bool = False) -> str:
    """MD5 of a file's bytes, or of its uncompressed text."""
    h = hashlib.md5()
    opener = gzip.open if unpacked and is_gzip(path) else open
    with opener(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()
