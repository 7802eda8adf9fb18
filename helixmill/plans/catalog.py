"""The queries of the alignment engine by name, with their SQL for DuckDB.

The SQL takes blocks, introns and lengths from a literal table of the seven CIGAR shapes, while
the queries parse CIGAR strings, so the two derive the results apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kmers
from ..operators import cohort, complexity, counting, fragmentomics, intervals, pergene, qualimap, readstats, rseqc
from ..sources.config import DEFAULTS
from . import views
from .views import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


class Tables:
    """The views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @property
    def reads(self) -> DataFrame:
        return views.reads(self.spark, self.dir)

    @property
    def exons(self) -> DataFrame:
        return views.exons(self.spark, self.dir)

    @property
    def genes(self) -> DataFrame:
        return views.genes(self.spark, self.dir)

    @property
    def contigs(self) -> DataFrame:
        return views.contigs(self.spark, self.dir)

    @property
    def lengths(self) -> DataFrame:
        return intervals.union_length(self.exons, ["gene_id"])

    @property
    def tx_exons(self) -> DataFrame:
        """One transcript a gene: its merged exons."""
        return intervals.merge(self.exons, ["gene_id", "tid", "strand"]).withColumn("tx_id", F.col("gene_id"))

    @property
    def transcripts(self) -> DataFrame:
        g = self.genes
        width = F.col("e") - F.col("s")
        return g.select(F.col("gene_id").alias("tx_id"), "gene_id", F.col("gene_ord").alias("tx_ord"), "tid", "s", "e", "strand", F.when(F.col("gene_ord") % 3 != 0, F.col("s") + 7).alias("cds_s"), F.when(F.col("gene_ord") % 3 != 0, F.col("s") + F.floor(width / 2) + 7).alias("cds_e"))

    @property
    def quality(self):
        return F.col("quality")

    @property
    def long_reads(self) -> DataFrame:
        """Reads of which every fifth pair is four times as long, so lengths run beyond every bound."""
        return self.reads.withColumn("tlen", F.when(F.col("qname").cast("long") % 5 == 0, F.col("tlen") * 4).otherwise(F.col("tlen")))

    @property
    def cds(self) -> DataFrame:
        """Two CDS ranges of two genes in three, which overlap."""
        tx = self.transcripts.where("cds_s is not null")
        return tx.select("gene_id", F.col("cds_s").alias("s"), F.col("cds_e").alias("e")).unionByName(tx.select("gene_id", (F.col("cds_s") + 3).alias("s"), (F.col("cds_e") + 5).alias("e")))

    @property
    def status(self) -> DataFrame:
        """Each counted record's gene."""
        return counting.read_status(self.reads, self.exons)

    @property
    def fc_reads(self) -> DataFrame:
        return self.status.where("gene_id is not null").groupBy("gene_id").agg(F.count("*").alias("fc_reads"))


MERGED = "mx AS (SELECT gene_id, tid, strand, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY gene_id ORDER BY s, e) AS isl FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY gene_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM exons)) GROUP BY gene_id, tid, strand, isl)"
HITS = "hits AS (SELECT DISTINCT rec_ord, gene_id FROM blocks JOIN exons ON blocks.tid = exons.tid AND blocks.s < exons.e AND exons.s < blocks.e)"
PER = "per AS (SELECT reads.rec_ord, any_value(qname) AS qname, any_value(flag) AS flag, any_value(nh) AS nh, count(gene_id) AS n, min(gene_id) AS g FROM reads LEFT JOIN hits USING (rec_ord) WHERE flag & 2564 = 0 GROUP BY reads.rec_ord)"
STATUS = f"{HITS}, {PER}, st AS (SELECT *, CASE WHEN nh > 1 THEN 'MultiMapping' WHEN n = 0 THEN 'NoFeatures' WHEN n = 1 THEN 'Assigned' ELSE 'Ambiguity' END AS status FROM per)"
FC = "fc AS (SELECT g AS gene_id, count(*) AS fc_reads FROM st WHERE status = 'Assigned' GROUP BY g)"


@query("f01_aligned_blocks", oracle(" SELECT rec_ord, s, e, q FROM blocks", blocks=True).replace("SELECT rec_ord, s, e, q", "SELECT rec_ord, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CAST(q AS BIGINT) AS q"))
def aligned_blocks(spark, d):
    from ..functions import cigar

    return Tables(spark, d).reads.select("rec_ord", F.inline(cigar.aligned_blocks()))


@query("f04_introns", oracle(" SELECT rec_ord, CAST(pos + a AS BIGINT) AS s, CAST(pos + b AS BIGINT) AS e FROM reads JOIN (VALUES (2, 20, 120), (6, 10, 210), (6, 220, 270)) v(ln, a, b) USING (ln)"))
def introns(spark, d):
    from ..functions import cigar

    return Tables(spark, d).reads.select("rec_ord", F.inline(cigar.introns())).drop("q")


@query("a45_effective_length", oracle(" SELECT gene_id, CAST(eff_len AS BIGINT) AS eff_len FROM eff"))
def effective_length(spark, d):
    return Tables(spark, d).lengths


@query("w03_subtract", oracle(" SELECT tid, CAST(count(*) AS BIGINT) AS bases FROM (SELECT DISTINCT tid, unnest(range(s, e)) AS p FROM genes EXCEPT SELECT DISTINCT tid, unnest(range(s, e)) AS p FROM exons) GROUP BY tid"))
def subtract(spark, d):
    t = Tables(spark, d)
    return intervals.subtract(t.genes, t.exons, ["tid"]).groupBy("tid").agg(F.sum(F.col("e") - F.col("s")).alias("bases"))


@query("j01_gene_hits", oracle(" SELECT rec_ord, CAST(count(*) AS BIGINT) AS n_genes, min(gene_id) AS first_gene FROM hits GROUP BY rec_ord", HITS, blocks=True))
def gene_hits(spark, d):
    t = Tables(spark, d)
    return counting.read_genes(t.reads, t.exons).select("rec_ord", F.size("genes").cast("long").alias("n_genes"), F.array_min("genes").alias("first_gene"))


@query("a02_assignment_status", oracle(" SELECT status, count(*) AS n FROM st GROUP BY status UNION ALL SELECT 'Unmapped', count(*) FROM reads WHERE flag & 4 > 0 UNION ALL SELECT 'Singleton', 0 UNION ALL SELECT 'Chimera', 0", STATUS, blocks=True))
def assignment_status(spark, d):
    t = Tables(spark, d)
    return counting.status_counts(t.status, t.reads)


@query("a02_fc_reads", oracle(" SELECT gene_id, fc_reads FROM fc", STATUS, FC, blocks=True))
def fc_reads(spark, d):
    return Tables(spark, d).fc_reads


FRAGMENTS = f"""{HITS}, gl AS (SELECT rec_ord, list(gene_id ORDER BY gene_id) AS gs FROM hits GROUP BY rec_ord),
k AS (SELECT reads.*, coalesce(gs, []) AS gs, flag & 64 > 0 AS r1 FROM reads LEFT JOIN gl USING (rec_ord) WHERE flag & 2564 = 0 AND flag & 1 > 0),
x AS (SELECT * FROM k WHERE r1), y AS (SELECT * FROM k WHERE NOT r1),
fr AS (SELECT CASE WHEN x.rec_ord IS NULL THEN y.gs WHEN y.rec_ord IS NULL THEN x.gs WHEN len(list_intersect(x.gs, y.gs)) > 0 THEN list_intersect(x.gs, y.gs) ELSE list_distinct(list_concat(x.gs, y.gs)) END AS gs,
  coalesce(x.flag, y.flag) & 1024 > 0 AS is_dup, coalesce(x.nh, y.nh) > 1 AS is_multi, x.rec_ord AS xr, y.rec_ord AS yr
  FROM x FULL JOIN y ON x.qname = y.qname AND x.tid = y.mtid AND x.pos = y.mpos AND x.mtid = y.tid AND x.mpos = y.pos),
gc AS (SELECT gs[1] AS gene_id, count(*) AS all_multi, count(*) FILTER (NOT is_dup) AS nodup_multi, count(*) FILTER (NOT is_multi) AS all_unique, count(*) FILTER (NOT is_dup AND NOT is_multi) AS nodup_unique FROM fr WHERE len(gs) = 1 GROUP BY 1)"""
MATRIX = """nm AS (SELECT (SELECT count(*) FROM fr) + (SELECT count(*) FROM reads WHERE flag & 4 > 0 AND flag & 1 > 0 AND flag & 8 = 0 AND flag & 2304 = 0) AS n),
dm AS (SELECT gene_id, gene_ord, CAST(eff_len AS BIGINT) AS gene_length, coalesce(all_multi, 0) AS am, coalesce(nodup_multi, 0) AS fm, coalesce(all_unique, 0) AS au, coalesce(nodup_unique, 0) AS fu, n FROM genes JOIN eff USING (gene_id) LEFT JOIN gc USING (gene_id), nm)"""


@query("a01_gene_counts", oracle(" SELECT * FROM gc", FRAGMENTS, blocks=True))
def gene_counts(spark, d):
    t = Tables(spark, d)
    return counting.gene_counts(counting.fragments(t.reads, t.exons))


def _matrix(t: Tables) -> DataFrame:
    frags = counting.fragments(t.reads, t.exons)
    return counting.dup_matrix(t.genes, t.lengths, counting.gene_counts(frags), counting.total_mapped(t.reads, frags))


_rate = lambda a, f: f"CASE WHEN {a} > 0 THEN ({a} - {f}) / {a} END"


@query(
    "a03_dup_matrix",
    oracle(
        f""" SELECT gene_id, gene_ord, gene_length, am AS all_counts_multi, fm AS filtered_counts_multi, {_rate("am", "fm")} AS dup_rate_multi, am - fm AS dups_per_id_multi, am * 1000.0 / gene_length AS rpk_multi, am * 1e9 / gene_length / n AS rpkm_multi,
  au AS all_counts, fu AS filtered_counts, {_rate("au", "fu")} AS dup_rate, au - fu AS dups_per_id, au * 1000.0 / gene_length AS rpk, au * 1e9 / gene_length / n AS rpkm FROM dm""",
        FRAGMENTS,
        MATRIX,
        blocks=True,
    ),
)
def dup_matrix(spark, d):
    return _round(_matrix(Tables(spark, d)))


def _round(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


SQL["a03_dup_matrix"] = "SELECT gene_id, gene_ord, gene_length, all_counts_multi, filtered_counts_multi, round(dup_rate_multi, 6) AS dup_rate_multi, dups_per_id_multi, round(rpk_multi, 6) AS rpk_multi, round(rpkm_multi, 6) AS rpkm_multi, all_counts, filtered_counts, round(dup_rate, 6) AS dup_rate, dups_per_id, round(rpk, 6) AS rpk, round(rpkm, 6) AS rpkm FROM (" + SQL["a03_dup_matrix"] + ")"


@query("a04_dup_stats", oracle(" SELECT count(*) AS n_regions, count(*) FILTER (au > 0) AS n_covered, count(*) FILTER (au = 0 OR au > fu) AS n_with_dups, round(count(*) FILTER (au > 0) / count(*), 6) AS f_covered, round(count(*) FILTER (au = 0 OR au > fu) / count(*), 6) AS f_dups, round(count(*) FILTER (au = 0 OR au > fu) / count(*) FILTER (au > 0), 6) AS f_dups_covered FROM dm", FRAGMENTS, MATRIX, blocks=True))
def dup_stats(spark, d):
    return _round(counting.dup_stats(_matrix(Tables(spark, d))))


@query("m01_duplication_fit")
def duplication_fit(spark, d):
    fit = counting.fit_duplication(_matrix(Tables(spark, d)))
    return spark.createDataFrame([tuple(round(v, 6) for v in fit.values())], ", ".join(f"{k} double" for k in fit))


_SOLVE = "(sw * swxz - swx * swz) / (sw * swxx - swx * swx) AS b1, (swxx * swz - swx * swxz) / (sw * swxx - swx * swx) AS b0"
_SUMS = "sum(w) AS sw, sum(w * x) AS swx, sum(w * x * x) AS swxx, sum(w * z) AS swz, sum(w * x * z) AS swxz"
FIT = f"""pt AS (SELECT log10(au * 1000.0 / gene_length) AS x, (au - fu) / au AS y FROM dm WHERE au > 0),
fit AS (SELECT 0 AS k, b0, b1 FROM (SELECT {_SOLVE} FROM (SELECT {_SUMS} FROM (SELECT x, mu * (1 - mu) AS w, ln(mu / (1 - mu)) + (y - mu) / (mu * (1 - mu)) AS z FROM (SELECT x, y, (y + 0.5) / 2 AS mu FROM pt))))
  UNION ALL SELECT k + 1, b0, b1 FROM (SELECT k, {_SOLVE} FROM (SELECT k, {_SUMS} FROM (SELECT k, x, mu * (1 - mu) AS w, eta + (y - mu) / (mu * (1 - mu)) AS z FROM (SELECT k, x, y, b0 + b1 * x AS eta, least(greatest(1 / (1 + exp(-(b0 + b1 * x))), 1e-10), 1 - 1e-10) AS mu FROM fit, pt WHERE k < 24)) GROUP BY k))),
done AS (SELECT b0, b1 FROM fit WHERE k = 24)"""
SQL["m01_duplication_fit"] = oracle(" SELECT round(b0, 6) AS beta0, round(b1, 6) AS beta1, round(exp(b0), 6) AS intercept, round(exp(b1), 6) AS slope FROM done", FRAGMENTS, MATRIX, FIT, blocks=True).replace("WITH ", "WITH RECURSIVE ", 1)


@query("m02_rpkm_threshold", oracle(" SELECT round(min(au * 1000.0 / gene_length), 6) AS rpk_threshold FROM dm WHERE au * 1e9 / gene_length / n >= 500", FRAGMENTS, MATRIX, blocks=True))
def rpkm_threshold(spark, d):
    return _round(counting.rpkm_threshold(_matrix(Tables(spark, d)), 500))


@query("w11_duplication_boxes")
def duplication_boxes(spark, d):
    return _round(counting.dup_boxes(_matrix(Tables(spark, d))))


SQL["w11_duplication_boxes"] = oracle(
    f""", rk AS (SELECT au * 1000.0 / gene_length AS r, CASE WHEN au > 0 THEN (au - fu) / au END AS d FROM dm), qa AS (SELECT quantile_cont(r, [{", ".join(f"{k / 20!r}" for k in range(21))}]) AS q FROM rk)
  SELECT CAST(k AS INTEGER) AS bin, count(*) AS genes, round(avg(r), 6) AS mean_rpk, count(d) AS rated, round(quantile_cont(d, 0.25), 6) AS q1, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS q3 FROM rk, qa, (SELECT unnest(range(20)) AS k) WHERE r >= q[k + 1] AND (r < q[k + 2] OR (k = 19 AND r <= q[k + 2])) GROUP BY k""",
    FRAGMENTS,
    MATRIX,
    blocks=True,
)


@query("o01_biotype_order", oracle(" SELECT row_number() OVER (ORDER BY n DESC, biotype) AS place, biotype, n FROM (SELECT biotype, count(*) AS n FROM (SELECT rec_ord, min(biotype) AS biotype FROM (SELECT DISTINCT hits.rec_ord, biotype FROM hits JOIN genes USING (gene_id)) JOIN (SELECT rec_ord FROM reads WHERE flag & 2564 = 0 AND nh <= 1) USING (rec_ord) GROUP BY rec_ord HAVING count(*) = 1) GROUP BY biotype)", HITS, blocks=True))
def biotype_order(spark, d):
    t = Tables(spark, d)
    counts = counting.biotype_counts(counting.biotype_status(t.reads, t.exons))
    return counts.select(F.row_number().over(Window.orderBy(F.desc("n"), "biotype")).cast("long").alias("place"), "biotype", "n")  # a row for each biotype


@query("u05_samples", oracle(" SELECT CASE WHEN rec_ord % 3 = 0 THEN 'a' ELSE 'b' END AS sample_id, count(*) AS total, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 2304 = 0 AND flag & 3 = 3) AS properly_paired FROM reads GROUP BY 1"))
def samples(spark, d):
    from .samples import each

    reads = Tables(spark, d).reads.withColumn("sample_id", F.when(F.col("rec_ord") % 3 == 0, "a").otherwise("b"))
    return each(reads, readstats.flagstat).select("sample_id", "total", "mapped", "properly_paired")


@query("a05_biotype_counts", oracle(" SELECT biotype, count(*) AS n FROM (SELECT rec_ord, min(biotype) AS biotype FROM (SELECT DISTINCT hits.rec_ord, biotype FROM hits JOIN genes USING (gene_id)) JOIN (SELECT rec_ord FROM reads WHERE flag & 2564 = 0 AND nh <= 1) USING (rec_ord) GROUP BY rec_ord HAVING count(*) = 1) GROUP BY biotype", HITS, blocks=True))
def biotype_counts(spark, d):
    t = Tables(spark, d)
    return counting.biotype_counts(counting.biotype_status(t.reads, t.exons))


@query(
    "a05_without_biotypes",
    oracle(
        " SELECT k AS biotype, count(*) AS n FROM (SELECT rec_ord, min(k) AS k FROM (SELECT DISTINCT hits.rec_ord, CASE WHEN gene_ord % 4 = 0 THEN 'gene:' || gene_id ELSE biotype END AS k FROM hits JOIN genes USING (gene_id)) JOIN (SELECT rec_ord FROM reads WHERE flag & 2564 = 0 AND nh <= 1) USING (rec_ord) GROUP BY rec_ord HAVING count(*) = 1) WHERE k NOT LIKE 'gene:%' GROUP BY k",
        HITS,
        blocks=True,
    ),
)
def without_biotypes(spark, d):
    """A quarter of the genes has no biotype: each is a feature of its own."""
    t = Tables(spark, d)
    exons = t.exons.withColumn("biotype", F.when(F.col("gene_ord") % 4 != 0, F.col("biotype")))
    return counting.biotype_counts(counting.biotype_status(t.reads, exons))


@query("p19_p20_guards", oracle(" SELECT 'duplicates' AS guard, CASE WHEN count(*) FILTER (flag & 1024 > 0) > 0 THEN 'passes' ELSE 'stops' END AS told FROM reads UNION ALL SELECT 'no duplicates', 'stops' UNION ALL SELECT 'contigs', 'passes' UNION ALL SELECT 'other contigs', 'stops'"))
def guards(spark, d):
    t = Tables(spark, d)
    far = t.exons.withColumn("tid", F.col("tid") + 100)

    def told(check, *args) -> str:
        try:
            check(*args)
        except ValueError:
            return "stops"
        return "passes"

    counts = lambda exons: counting.gene_counts(counting.fragments(t.reads, exons))
    rows = [("duplicates", told(counting.check_duplicates_marked, t.reads)), ("no duplicates", told(counting.check_duplicates_marked, t.reads.where(F.col("flag").bitwiseAND(1024) == 0)))]
    rows += [("contigs", told(counting.check_contigs, t.reads, counts(t.exons))), ("other contigs", told(counting.check_contigs, t.reads, counts(far)))]
    return spark.createDataFrame(rows, "guard string, told string")


@query(
    "a06_flagstat",
    oracle(
        """ SELECT count(*) AS total, count(*) FILTER (flag & 2304 = 0) AS primary_reads, count(*) FILTER (flag & 256 > 0) AS secondary, count(*) FILTER (flag & 2048 > 0) AS supplementary,
  count(*) FILTER (flag & 512 = 0 AND flag & 1024 > 0) AS duplicates, count(*) FILTER (flag & 2304 = 0 AND flag & 1024 > 0) AS primary_duplicates, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 2308 = 0) AS primary_mapped,
  count(*) FILTER (p) AS paired, count(*) FILTER (p AND flag & 64 > 0) AS read1, count(*) FILTER (p AND flag & 128 > 0) AS read2, count(*) FILTER (p AND flag & 2 > 0) AS properly_paired, count(*) FILTER (p AND flag & 12 = 0) AS both_mapped,
  count(*) FILTER (p AND flag & 12 = 8) AS singletons, count(*) FILTER (p AND flag & 12 = 0 AND mtid <> tid) AS mate_elsewhere, count(*) FILTER (p AND flag & 12 = 0 AND mtid <> tid AND mapq >= 5) AS mate_elsewhere_q5 FROM (SELECT *, flag & 2304 = 0 AND flag & 1 > 0 AS p FROM reads)"""
    ),
)
def flagstat(spark, d):
    return readstats.flagstat(Tables(spark, d).reads)


@query(
    "a07_bam_stat",
    oracle(
        """ SELECT count(*) AS total, count(*) FILTER (k = 1) AS qc_failed, count(*) FILTER (k = 2) AS duplicate, count(*) FILTER (k = 3) AS non_primary, count(*) FILTER (k = 4) AS unmapped, count(*) FILTER (k = 5) AS non_unique, count(*) FILTER (k = 6) AS unique,
  count(*) FILTER (k = 6 AND flag & 64 > 0) AS read1, count(*) FILTER (k = 6 AND flag & 128 > 0) AS read2, count(*) FILTER (k = 6 AND flag & 16 = 0) AS plus, count(*) FILTER (k = 6 AND flag & 16 > 0) AS minus, count(*) FILTER (k = 6 AND ln IN (2, 6)) AS spliced,
  count(*) FILTER (k = 6 AND ln NOT IN (2, 6)) AS non_spliced, count(*) FILTER (k = 6 AND flag & 3 = 3) AS proper_pairs, count(*) FILTER (k = 6 AND flag & 3 = 3 AND mtid <> tid) AS proper_elsewhere
  FROM (SELECT *, CASE WHEN flag & 512 > 0 THEN 1 WHEN flag & 1024 > 0 THEN 2 WHEN flag & 256 > 0 THEN 3 WHEN flag & 4 > 0 THEN 4 WHEN mapq < 30 THEN 5 ELSE 6 END AS k FROM reads)"""
    ),
)
def bam_stat(spark, d):
    return readstats.bam_stat(Tables(spark, d).reads)


@query("a08_idxstats", oracle(" SELECT tid, name, length, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 > 0) AS unmapped FROM contigs LEFT JOIN reads USING (tid) GROUP BY tid, name, length UNION ALL SELECT -1, '*', 0, 0, 0"))
def idxstats(spark, d):
    t = Tables(spark, d)
    return readstats.idxstats(t.reads, t.contigs)


@query("a08_unplaced", oracle(" SELECT c.tid, name, length, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 > 0) AS unmapped FROM contigs c LEFT JOIN (SELECT * FROM reads WHERE flag & 4 = 0 OR rec_ord % 2 = 0) r ON c.tid = r.tid GROUP BY c.tid, name, length UNION ALL SELECT -1, '*', 0, 0, count(*) FROM reads WHERE flag & 4 > 0 AND rec_ord % 2 = 1"))
def unplaced(spark, d):
    """Half of the unmapped records have no place."""
    t = Tables(spark, d)
    return readstats.idxstats(t.reads.withColumn("tid", F.when((F.col("flag").bitwiseAND(4) == 0) | (F.col("rec_ord") % 2 == 0), F.col("tid"))), t.contigs)


@query(
    "a09_summary",
    oracle(
        """ SELECT count(*) FILTER (p) AS raw_total, count(*) FILTER (flag & 512 > 0) AS filtered, count(*) FILTER (p) - count(*) FILTER (flag & 512 > 0) AS sequences, count(*) FILTER (p AND NOT l) AS first_fragments, count(*) FILTER (p AND l) AS last_fragments,
  count(*) FILTER (p AND m) AS reads_mapped, count(*) FILTER (p AND m AND flag & 512 = 0 AND flag & 9 = 1) AS reads_mapped_and_paired, count(*) FILTER (flag & 1796 = 4) AS reads_unmapped, count(*) FILTER (p AND flag & 3 = 3) AS reads_properly_paired, count(*) FILTER (p AND flag & 1 > 0) AS reads_paired,
  count(*) FILTER (p AND flag & 1024 > 0) AS reads_duplicated, count(*) FILTER (p AND m AND mapq = 0) AS reads_mq0, count(*) FILTER (flag & 256 > 0) AS secondary, count(*) FILTER (flag & 2048 > 0) AS supplementary,
  50 * count(*) FILTER (p) AS total_length, 50 * count(*) FILTER (p AND NOT l) AS total_first_fragment_length, 50 * count(*) FILTER (p AND l) AS total_last_fragment_length, 50 * count(*) FILTER (p AND m) AS bases_mapped, CAST(sum(CASE WHEN m AND flag & 256 = 0 THEN CASE WHEN ln IN (3, 7) THEN 45 ELSE 50 END ELSE 0 END) AS BIGINT) AS bases_mapped_cigar,
  50 * count(*) FILTER (p AND flag & 1024 > 0) AS bases_duplicated, CAST(sum(CASE WHEN p AND m THEN nm ELSE 0 END) AS BIGINT) AS mismatches, round(sum(CASE WHEN p AND m THEN nm ELSE 0 END) / sum(CASE WHEN m AND flag & 256 = 0 THEN CASE WHEN ln IN (3, 7) THEN 45 ELSE 50 END ELSE 0 END), 6) AS error_rate,
  CAST(50 AS BIGINT) AS average_length, CAST(50 AS BIGINT) AS average_first_fragment_length, CAST(50 AS BIGINT) AS average_last_fragment_length, CAST(50 AS BIGINT) AS maximum_length, CAST(50 AS BIGINT) AS maximum_first_fragment_length, CAST(50 AS BIGINT) AS maximum_last_fragment_length,
  round(sum(CASE WHEN p AND flag & 512 = 0 THEN list_sum(list_transform(range(50), lambda i: 2 + (rec_ord * 3 + i * 11) % 40)) ELSE 0 END) / (50 * count(*) FILTER (p AND flag & 512 = 0)), 6) AS average_quality,
  count(*) FILTER (p AND flag & 13 = 1 AND mtid <> tid AND mapq >= 5) AS pairs_on_different_chromosomes, round(100.0 * count(*) FILTER (p AND flag & 3 = 3) / count(*) FILTER (p), 6) AS percentage_properly_paired FROM (SELECT *, flag & 2304 = 0 AS p, flag & 4 = 0 AS m, flag & 129 = 129 AS l FROM reads)"""
    ),
)
def summary(spark, d):
    t = Tables(spark, d)
    return _round(readstats.summary(t.reads, t.quality))


@query("a09_orientations", oracle(" SELECT count(*) FILTER (o = 'inward') // 2 AS inward_oriented_pairs, count(*) FILTER (o = 'outward') // 2 AS outward_oriented_pairs, count(*) FILTER (o = 'other') // 2 AS pairs_with_other_orientation FROM (SELECT CASE WHEN (flag & 16 > 0) = (flag & 32 > 0) THEN 'other' WHEN mpos = pos THEN 'inward' WHEN ((flag & 64 > 0) = (mpos > pos)) = ((flag & 64 > 0) = (flag & 16 = 0)) THEN 'inward' ELSE 'outward' END AS o FROM reads WHERE flag & 2304 = 0 AND flag & 13 = 1 AND (tlen <> 0 OR tid = mtid))"))
def pair_orientations(spark, d):
    return readstats.orientations(Tables(spark, d).reads)


CRC = "ct AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS tbl)"
_crc = lambda codes: f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"
_ORDS = "list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)"
_NIBBLES = "list_transform(range(25), lambda i: 16 * (CASE substr(seq, 2 * i + 1, 1) WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END) + CASE substr(seq, 2 * i + 2, 1) WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END)"


@query("f11_checksums", oracle(f" SELECT CAST(sum({_crc(_ORDS.format('qname'))}) % 4294967296 AS BIGINT) AS names, CAST(sum({_crc(_NIBBLES)}) % 4294967296 AS BIGINT) AS sequences, CAST(sum({_crc('list_transform(range(50), lambda i: 2 + (rec_ord * 3 + i * 11) % 40)')}) % 4294967296 AS BIGINT) AS qualities FROM reads, ct", CRC))
def checksums(spark, d):
    t = Tables(spark, d)
    return readstats.checksums(t.reads.withColumn("qual", F.array_join(F.transform("quality", lambda q: F.chr(q + 33)), "")))


@query("a10_mapping_qualities", oracle(" SELECT mapq, count(*) AS n FROM reads WHERE flag & 3844 = 0 GROUP BY mapq"))
def mapping_qualities(spark, d):
    return readstats.mapping_qualities(Tables(spark, d).reads)


@query("a10_lengths", oracle(" SELECT 'RL' AS section, 50 AS length, count(*) AS n FROM reads WHERE flag & 2304 = 0 UNION ALL SELECT CASE WHEN flag & 128 > 0 THEN 'LRL' ELSE 'FRL' END, 50, count(*) FROM reads WHERE flag & 2304 = 0 GROUP BY 1"))
def lengths(spark, d):
    return readstats.lengths(Tables(spark, d).reads)


CYCLES = "cy AS (SELECT flag & 128 > 0 AS is_last, CASE WHEN flag & 16 > 0 THEN 49 - i ELSE i END AS cycle, rec_ord, flag, i, seq FROM (SELECT *, unnest(range(50)) AS i FROM reads WHERE flag & 2304 = 0))"


@query("a11_quality_by_cycle", oracle(" SELECT is_last, CAST(cycle AS INTEGER) AS cycle, CAST(2 + (rec_ord * 3 + i * 11) % 40 AS INTEGER) AS quality, count(*) AS n FROM cy GROUP BY ALL", CYCLES))
def quality_by_cycle(spark, d):
    t = Tables(spark, d)
    return readstats.quality_by_cycle(t.reads, t.quality)


@query("a12_gc_steps", oracle(" SELECT is_last, CAST(b AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n FROM (SELECT is_last, n, unnest(range(lo, hi)) AS b FROM (SELECT flag & 128 > 0 AS is_last, g * 199 // 50 AS lo, least((g + 1) * 199 // 50, 199) AS hi, count(*) AS n FROM (SELECT flag, length(regexp_replace(seq, '[^GC]', '', 'g')) AS g FROM reads WHERE flag & 2304 = 0) GROUP BY ALL)) GROUP BY ALL"))
def gc_steps(spark, d):
    return readstats.gc_steps(Tables(spark, d).reads)


@query("a13_bases_by_cycle", oracle(" SELECT is_last, CAST(cycle AS INTEGER) AS cycle, substr(seq, CAST(i + 1 AS BIGINT), 1) AS base, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY is_last, cycle), 6) AS percent FROM cy GROUP BY is_last, cycle, base", CYCLES))
def bases_by_cycle(spark, d):
    return _round(readstats.bases_by_cycle(Tables(spark, d).reads))


@query("a13_oriented_bases", oracle(" SELECT is_last, CAST(cycle AS INTEGER) AS cycle, base, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY is_last, cycle), 6) AS percent FROM (SELECT is_last, cycle, CASE WHEN flag & 16 > 0 THEN translate(substr(seq, CAST(i + 1 AS BIGINT), 1), 'ACGT', 'TGCA') ELSE substr(seq, CAST(i + 1 AS BIGINT), 1) END AS base FROM cy) GROUP BY is_last, cycle, base", CYCLES))
def oriented_bases(spark, d):
    return _round(readstats.bases_by_cycle(Tables(spark, d).reads, oriented=True))


@query("a13_total_bases", oracle(" SELECT flag & 128 > 0 AS is_last, " + ", ".join(f"CAST(sum(len(seq) - len(replace(seq, '{b}', ''))) AS BIGINT) AS {b.lower()}" for b in "ACGTN") + " FROM reads WHERE flag & 2304 = 0 GROUP BY 1"))
def total_bases(spark, d):
    return readstats.total_bases(Tables(spark, d).reads)


@query(
    "w08_gc_plateaus",
    oracle(
        """, gs AS (SELECT is_last, b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT is_last, n, unnest(range(lo, hi)) AS b FROM (SELECT flag & 128 > 0 AS is_last, g * 199 // 50 AS lo, least((g + 1) * 199 // 50, 199) AS hi, count(*) AS n FROM (SELECT flag, length(regexp_replace(seq, '[^GC]', '', 'g')) AS g FROM reads WHERE flag & 2304 = 0) GROUP BY ALL)) GROUP BY ALL),
  full_ AS (SELECT s.is_last, g.b, coalesce(gs.n, 0) AS n FROM (SELECT DISTINCT is_last FROM gs) s, (SELECT unnest(range(199)) AS b) g LEFT JOIN gs ON gs.is_last = s.is_last AND gs.b = g.b),
  st AS (SELECT *, lag(n) OVER (PARTITION BY is_last ORDER BY b) AS pn FROM full_)
  SELECT is_last, round((b + u - 1) * 0.5 * 100 / 199, 6) AS percent, n FROM (SELECT *, coalesce(lead(b) OVER (PARTITION BY is_last ORDER BY b), 199) AS u FROM st WHERE pn IS NULL OR pn <> n) WHERE n > 0"""
    ),
)
def gc_plateaus(spark, d):
    return _round(readstats.gc_plateaus(Tables(spark, d).reads))


SIZES = "sz AS (SELECT least(abs(tlen), 8000) AS size, CASE WHEN (flag & 16 > 0) = (flag & 32 > 0) THEN 'other' WHEN mpos = pos THEN 'inward' WHEN ((flag & 64 > 0) = (mpos > pos)) = ((flag & 64 > 0) = (flag & 16 = 0)) THEN 'inward' ELSE 'outward' END AS orientation, count(*) AS n, count(*) // 2 AS pairs FROM reads WHERE flag & 2304 = 0 AND flag & 1 > 0 AND flag & 12 = 0 AND tlen <> 0 GROUP BY 1, 2)"


@query("a14_insert_sizes", oracle(" SELECT * FROM sz", SIZES))
def insert_sizes(spark, d):
    return readstats.insert_sizes(Tables(spark, d).reads)


@query("w07_insert_bulk", oracle(" SELECT round(sum(size * n) / sum(n), 6) AS insert_mean, round(sqrt(greatest(0, sum(size * size * n) / sum(n) - (sum(size * n) / sum(n)) ** 2)), 6) AS insert_sd, CAST(sum(n) AS BIGINT) AS n_mates FROM (SELECT size, n, (sum(n) OVER (ORDER BY size) - n) / sum(n) OVER () AS b FROM (SELECT size, sum(n) AS n FROM sz GROUP BY size)) WHERE b <= 0.99", SIZES))
def insert_bulk(spark, d):
    return _round(readstats.bulk(readstats.insert_sizes(Tables(spark, d).reads)))


@query("a15_indels", oracle(" SELECT CAST(CASE ln WHEN 4 THEN 2 ELSE 3 END AS BIGINT) AS size, count(*) FILTER (ln = 4) AS insertions, count(*) FILTER (ln = 5) AS deletions FROM reads WHERE flag & 260 = 0 AND ln IN (4, 5) GROUP BY 1"))
def indels(spark, d):
    return readstats.indels(Tables(spark, d).reads)


@query("a15_indels_by_cycle", oracle(" SELECT CAST(CASE WHEN ln = 4 THEN CASE WHEN flag & 16 > 0 THEN 50 - 25 - 2 ELSE 25 END ELSE 24 END AS BIGINT) AS cycle, flag & 128 > 0 AS is_last, CASE ln WHEN 4 THEN 'I' ELSE 'D' END AS op, count(*) AS n FROM reads WHERE flag & 260 = 0 AND ln IN (4, 5) GROUP BY ALL"))
def indels_by_cycle(spark, d):
    return readstats.indels_by_cycle(Tables(spark, d).reads)


@query("a16_depth_histogram", oracle(" SELECT least(n, 1001) AS depth, count(*) AS n_bases FROM (SELECT tid, p, count(*) AS n FROM (SELECT tid, unnest(range(s, e)) AS p FROM blocks WHERE flag & 260 = 0) GROUP BY tid, p) GROUP BY 1", blocks=True))
def depth_histogram(spark, d):
    return readstats.depth_histogram(Tables(spark, d).reads)


DEPTH_BINS = """gr AS (SELECT tid, pos, length(regexp_replace(seq, '[^GC]', '', 'g')) / 50 AS g FROM reads WHERE flag & 260 = 0),
ch AS (SELECT tid, min(pos) AS s FROM gr GROUP BY tid UNION ALL SELECT ch.tid, min(gr.pos) FROM ch JOIN gr ON gr.tid = ch.tid AND gr.pos > ch.s + 20000 GROUP BY ch.tid),
gb AS (SELECT gr.tid, ch.s AS bin_start, count(*) AS depth, sum(g) AS gs FROM gr ASOF JOIN ch ON gr.tid = ch.tid AND gr.pos >= ch.s GROUP BY gr.tid, ch.s)"""


@query("a17_gc_depth", oracle(" SELECT tid, CAST(bin_start AS BIGINT) AS bin_start, depth, round(gs / depth, 6) AS gc FROM gb", DEPTH_BINS).replace("WITH ", "WITH RECURSIVE ", 1))
def gc_depth(spark, d):
    return _round(readstats.gc_depth(Tables(spark, d).reads).select("tid", "bin_start", "depth", "gc"))


_at = lambda p: f"CASE WHEN CAST(floor({p} * (n + 1) / 100.0) AS BIGINT) < 1 THEN ds[1] WHEN CAST(floor({p} * (n + 1) / 100.0) AS BIGINT) >= n THEN ds[n] ELSE ds[CAST(floor({p} * (n + 1) / 100.0) AS BIGINT)] + ({p} * (n + 1) / 100.0 - floor({p} * (n + 1) / 100.0)) * (ds[CAST(floor({p} * (n + 1) / 100.0) AS BIGINT) + 1] - ds[CAST(floor({p} * (n + 1) / 100.0) AS BIGINT)]) END"


@query(
    "a17_gc_report",
    oracle(
        f""", num AS (SELECT *, row_number() OVER (ORDER BY tid, bin_start) AS k, count(*) OVER () AS m FROM gb),
  shown AS (SELECT CASE WHEN k = m THEN gs ELSE floor(100 * gs / depth + 0.5) END AS gc, depth, m FROM num UNION ALL SELECT 0.0, 0, max(m) FROM num),
  ordered AS (SELECT *, row_number() OVER (ORDER BY gc, depth) AS r FROM shown),
  grp AS (SELECT gc, max(r) AS r, any_value(m) AS m, count(*) AS n, list(CAST(depth AS DOUBLE) ORDER BY depth) AS ds FROM ordered WHERE r <= m GROUP BY gc)
  SELECT round(gc, 6) AS gc, round((r + 1) * 100.0 / (m + 1), 6) AS percent, {", ".join(f"round(({_at(p)}) * 50 / 20000, 6) AS p{p}" for p in (10, 25, 50, 75, 90))} FROM grp""",
        DEPTH_BINS,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def gc_report(spark, d):
    rows = readstats.gc_depth_report(readstats.gc_depth(Tables(spark, d).reads), 50.0)
    return spark.createDataFrame([tuple(round(v, 6) for v in r) for r in rows], "gc double, percent double, p10 double, p25 double, p50 double, p75 double, p90 double")


STRANDS = "sp AS (SELECT rec_ord, flag, string_agg(strand, ':' ORDER BY f) AS k FROM (SELECT rec_ord, flag, strand, min(struct_pack(a := g.s, b := g.e)) AS f FROM (SELECT rec_ord, flag, tid, pos AS s, pos + CASE WHEN ln IN (3, 7) THEN 45 ELSE 50 END AS e FROM reads WHERE flag & 1796 = 0 AND mapq >= 30) r JOIN genes g ON r.tid = g.tid AND r.s < g.e AND g.s < r.e GROUP BY rec_ord, flag, strand) GROUP BY rec_ord, flag)"


@query("a18_strand_classes", oracle(" SELECT CASE WHEN flag & 1 = 0 THEN '' WHEN flag & 64 > 0 THEN '1' ELSE '2' END || CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END || k AS key, count(*) AS n FROM sp GROUP BY 1", STRANDS))
def strand_classes(spark, d):
    t = Tables(spark, d)
    return rseqc.strand_classes(t.reads, t.transcripts)


@query("a18_strandedness")
def strandedness(spark, d):
    t = Tables(spark, d)
    return _round(rseqc.infer_strandedness(rseqc.strand_classes(t.reads, t.transcripts)))


@query("a46_sampled_strandedness")
def sampled_strandedness(spark, d):
    t = Tables(spark, d)
    return _round(cohort.sampled_strandedness(t.reads, t.transcripts, most=3000))


@query("j23_strandedness_mismatch")
def strandedness_mismatch(spark, d):
    t = Tables(spark, d)
    told = rseqc.infer_strandedness(rseqc.strand_classes(t.reads, t.transcripts)).first().strandedness
    rows = [(given, told, rseqc.strandedness_mismatch(told, given)) for given in ("forward", "reverse", "unstranded")]
    return spark.createDataFrame(rows, "given string, told string, better string")


@query("a19_duplication_by_position", oracle(" SELECT n AS occurrence, count(*) AS n_keys FROM (SELECT tid, pos, CASE ln WHEN 7 THEN 3 ELSE ln END AS shape, count(*) AS n FROM (SELECT tid, pos, ln FROM reads WHERE flag & 516 = 0 AND mapq >= 30 AND ln <> 3 UNION ALL SELECT tid, pos, 8 FROM reads WHERE flag & 516 = 0 AND mapq >= 30 AND ln = 3) GROUP BY ALL) GROUP BY n"))
def duplication_by_position(spark, d):
    return rseqc.duplication(Tables(spark, d).reads)


@query("a19_duplication_by_sequence", oracle(" SELECT n AS occurrence, count(*) AS n_keys FROM (SELECT seq, count(*) AS n FROM reads WHERE flag & 516 = 0 AND mapq >= 30 GROUP BY seq) GROUP BY n"))
def duplication_by_sequence(spark, d):
    return rseqc.duplication(Tables(spark, d).reads, "sequence")


@query("a20_read_distribution")
def read_distribution(spark, d):
    t = Tables(spark, d)
    sets = rseqc.regions(t.transcripts, t.tx_exons).persist()  # of the annotation's size; looked up, and measured
    return _round(rseqc.region_report(rseqc.region_tags(t.reads, sets), sets))


JUNCTIONS = f"""{MERGED}, kn AS (SELECT DISTINCT tid, e AS s, nx AS e FROM (SELECT tid, e, lead(s) OVER (PARTITION BY gene_id ORDER BY s) AS nx FROM mx) WHERE nx > e),
ev AS (SELECT rec_ord, o, tid, pos + a AS s, pos + b AS e FROM reads JOIN (VALUES (2, 0, 20, 120), (6, 0, 10, 210), (6, 1, 220, 270)) v(ln, o, a, b) USING (ln) WHERE flag & 1796 = 0 AND mapq >= 30),
jn AS (SELECT tid, s, e, count(*) AS events, CASE WHEN a AND b THEN 'known' WHEN a OR b THEN 'partial_novel' ELSE 'complete_novel' END AS class FROM (SELECT ev.*, (tid, s) IN (SELECT tid, s FROM kn) AS a, (tid, e) IN (SELECT tid, e FROM kn) AS b FROM ev) GROUP BY tid, s, e, a, b)"""


@query("a21_junctions", oracle(" SELECT tid, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, events, class FROM jn", JUNCTIONS))
def junctions(spark, d):
    t = Tables(spark, d)
    return rseqc.junctions(rseqc.splice_events(t.reads), rseqc.known_introns(t.tx_exons)).drop("first_rec", "first_nth")


@query("a21_junction_summary", oracle(" SELECT class, count(*) AS n_junctions, CAST(sum(events) AS BIGINT) AS n_events FROM jn GROUP BY class UNION ALL SELECT 'filtered', 0, count(*) FROM ev WHERE e - s < 50", JUNCTIONS))
def junction_summary(spark, d):
    t = Tables(spark, d)
    ev = rseqc.splice_events(t.reads)
    return rseqc.junction_summary(rseqc.junctions(ev, rseqc.known_introns(t.tx_exons)), ev)


@query("a22_junction_saturation_end", oracle(" SELECT 100 AS percent, count(*) FILTER (k) AS known, count(*) FILTER (NOT k) AS novel, count(*) AS all_junctions FROM (SELECT DISTINCT tid, s, e, (tid, s, e) IN (SELECT tid, s, e FROM kn) AS k FROM ev)", JUNCTIONS))
def junction_saturation_end(spark, d):
    t = Tables(spark, d)
    return rseqc.junction_saturation(rseqc.splice_events(t.reads), rseqc.known_introns(t.tx_exons)).where("percent = 100")


def _saturation(least: int) -> str:
    return oracle(
        f""", pl AS (SELECT *, row_number() OVER (ORDER BY md5(rec_ord || ':' || o || ':42'), rec_ord, o) AS place, count(*) OVER () AS total FROM ev WHERE e - s >= 50),
  sn2 AS (SELECT tid, s, e, any_value(total) AS total, min(place) AS f, list(place ORDER BY place)[{least}] AS nth, (tid, s, e) IN (SELECT tid, s, e FROM kn) AS k FROM pl GROUP BY tid, s, e)
  SELECT CAST(percent AS INTEGER) AS percent, count(*) FILTER (k AND nth <= total * percent // 100) AS known, count(*) FILTER (NOT k AND f <= total * percent // 100) AS novel, count(*) FILTER (f <= total * percent // 100) AS all_junctions FROM sn2, (SELECT unnest(range(5, 101, 5)) AS percent) GROUP BY percent""",
        JUNCTIONS,
    )


@query("a22_junction_saturation", _saturation(1))
def junction_saturation(spark, d):
    t = Tables(spark, d)
    return rseqc.junction_saturation(rseqc.splice_events(t.reads), rseqc.known_introns(t.tx_exons))


@query("a22_junction_saturation_thrice", _saturation(3))
def junction_saturation_thrice(spark, d):
    t = Tables(spark, d)
    return rseqc.junction_saturation(rseqc.splice_events(t.reads), rseqc.known_introns(t.tx_exons), min_coverage=3)


@query("o05_junction_order", oracle(" SELECT row_number() OVER (ORDER BY tid, rec_ord, o) AS place, tid, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, events FROM (SELECT tid, s, e, count(*) AS events, min(struct_pack(r := rec_ord, o := o)).r AS rec_ord, min(struct_pack(r := rec_ord, o := o)).o AS o FROM ev WHERE e - s >= 50 GROUP BY tid, s, e)", JUNCTIONS))
def junction_order(spark, d):
    t = Tables(spark, d)
    found = rseqc.junctions(rseqc.splice_events(t.reads), rseqc.known_introns(t.tx_exons))
    order = Window.orderBy("tid", "first_rec", "first_nth")  # the rows of one text file
    return found.select(F.row_number().over(order).cast("long").alias("place"), "tid", "s", "e", "events")


@query("a23_inner_distance")
def inner_distance(spark, d):
    t = Tables(spark, d)
    merged = intervals.merge(t.exons, ["tid"])
    return rseqc.inner_distances(t.reads, t.transcripts, merged).groupBy("class").agg(F.count("*").alias("n"), F.sum("distance").alias("total"))


@query("a23_distance_histogram")
def distance_histogram(spark, d):
    t = Tables(spark, d)
    return rseqc.distance_histogram(rseqc.inner_distances(t.reads, t.transcripts, intervals.merge(t.exons, ["tid"])))


TIN = f"""{MERGED}, tot AS (SELECT gene_id, sum(e - s) AS l FROM mx GROUP BY gene_id), bases AS (SELECT gene_id, tid, s, e, p, row_number() OVER (PARTITION BY gene_id ORDER BY p) - 1 AS i FROM (SELECT *, unnest(range(s + 1, e + 1)) AS p FROM mx)),
pts AS (SELECT gene_id, tid, p, l FROM bases JOIN tot USING (gene_id) WHERE l <= 100 OR i % (l // 100) = 0 OR p = s + 1 OR p = e),
sz AS (SELECT gene_id, CASE WHEN any_value(l) <= 100 THEN any_value(l) + 2 ELSE count(*) END AS n FROM pts GROUP BY gene_id),
ok AS (SELECT g.gene_id, count(*) AS c FROM genes g JOIN (SELECT DISTINCT tid, CAST(pos AS BIGINT) AS p FROM reads WHERE flag & 772 = 0) r ON g.tid = r.tid AND g.s <= r.p AND r.p < g.e GROUP BY g.gene_id),
dep AS (SELECT pts.gene_id, p, count(*) AS c FROM pts JOIN blocks b ON pts.tid = b.tid AND b.s < p AND p <= b.e WHERE b.flag & 1796 = 0 GROUP BY pts.gene_id, p),
sc AS (SELECT gene_id, exp(-sum(c / t * ln(c / t))) AS h FROM (SELECT gene_id, c, sum(c) OVER (PARTITION BY gene_id) AS t FROM dep) GROUP BY gene_id)"""


@query("a24_tin", oracle(" SELECT gene_id AS tx_id, coalesce(c, 0) > 10 AS passed, round(CASE WHEN coalesce(c, 0) > 10 THEN coalesce(100 * h / n, 0.0) ELSE 0.0 END, 6) AS tin FROM genes LEFT JOIN ok USING (gene_id) LEFT JOIN sz USING (gene_id) LEFT JOIN sc USING (gene_id)", TIN, blocks=True))
def tin(spark, d):
    t = Tables(spark, d)
    return _round(rseqc.tin(t.reads, t.transcripts, t.tx_exons)).select("tx_id", "passed", "tin")


@query("a24_tin_summary", oracle(" SELECT round(avg(t), 6) AS tin_mean, round(coalesce(median(t), 0.0), 6) AS tin_median, round(stddev_pop(t), 6) AS tin_sd, count(*) AS n_passed FROM (SELECT coalesce(100 * h / n, 0.0) AS t FROM genes JOIN ok USING (gene_id) LEFT JOIN sz USING (gene_id) LEFT JOIN sc USING (gene_id) WHERE c > 10)", TIN, blocks=True))
def tin_summary(spark, d):
    t = Tables(spark, d)
    return _round(rseqc.tin_summary(rseqc.tin(t.reads, t.transcripts, t.tx_exons)))


FREQUENCIES = """kp AS (SELECT reads.*, pos + CASE ln WHEN 1 THEN 50 WHEN 2 THEN 150 WHEN 3 THEN 45 WHEN 4 THEN 48 WHEN 5 THEN 53 WHEN 6 THEN 300 ELSE 45 END AS stop FROM reads WHERE flag & 2304 = 0),
pr AS (SELECT qname, count(*) AS n, count(DISTINCT tid) AS c, min(pos) AS s, max(stop) AS e, min(tid) AS tid FROM kp WHERE flag & 1 > 0 GROUP BY qname),
ff AS (SELECT tid, s, e FROM pr WHERE n = 2 AND c = 1 UNION ALL SELECT kp.tid, pos, stop FROM kp JOIN pr USING (qname) WHERE flag & 1 > 0 AND NOT (n = 2 AND c = 1) UNION ALL SELECT tid, pos, -1 FROM kp WHERE flag & 1 = 0),
fq AS (SELECT j, count(*) AS n_j FROM (SELECT tid, s, e, count(*) AS j FROM ff GROUP BY ALL) GROUP BY j)"""


@query("a25_complexity_table", oracle(" SELECT j, n_j FROM fq", FREQUENCIES))
def complexity_table(spark, d):
    return complexity.frequency_table(complexity.fragment_keys(Tables(spark, d).reads))


@query(
    "m03_interpolation",
    oracle(
        """, tn AS (SELECT sum(j * n_j) AS total, sum(n_j) AS dist FROM fq), tg AS (SELECT k, total * k / 8 AS target FROM tn, (SELECT unnest(range(1, 8)) AS k)),
  ts AS (SELECT k, dist, list(CASE WHEN total - j >= target THEN n_j * exp(lgamma(total - j + 1) - lgamma(total - j - target + 1) - (lgamma(total + 1) - lgamma(total - target + 1))) ELSE 0 END ORDER BY j) AS terms FROM fq, tn, tg GROUP BY k, dist)
  SELECT CAST(k AS BIGINT) AS eighth, CAST(dist - list_reduce(list_concat([0.0::DOUBLE], terms), lambda a, x: floor(a + x)) AS BIGINT) AS distinct_reads FROM ts""",
        FREQUENCIES,
    ),
)
def interpolation(spark, d):
    """Expected distinct fragments at eighths of the depth."""
    hist = {r.j: r.n_j for r in complexity_table(spark, d).collect()}  # one row for each frequency
    total, distinct = sum(j * n for j, n in hist.items()), sum(hist.values())
    return spark.createDataFrame([(k, int(complexity.interpolate(hist, total, distinct, total * k / 8))) for k in range(1, 8)], "eighth long, distinct_reads long")


@query("f27_number_text", oracle(" SELECT gene_id, CASE WHEN au > 0 THEN printf('%.15g', (au - fu) / au) ELSE 'NA' END AS dup_rate, printf('%.15g', au * 1000.0 / gene_length) AS rpk FROM dm", FRAGMENTS, MATRIX, blocks=True))
def number_text(spark, d):
    """numbers as the duplication matrix writes them."""
    from ..functions.numbers import sig15

    def shown(batches):
        for b in batches:
            yield b.assign(dup_rate=[sig15(v) for v in b.dup_rate], rpk=[sig15(v) for v in b.rpk])

    return _matrix(Tables(spark, d)).select("gene_id", "dup_rate", "rpk").mapInPandas(shown, "gene_id string, dup_rate string, rpk string")


@query("m06_complexity_curve")
def complexity_curve(spark, d):
    hist = {r.j: r.n_j for r in complexity_table(spark, d).collect()}  # one row for each frequency
    found = complexity.report(hist, DEFAULTS["complexity"]) or []
    rows = [(float(t), *(None if v != v else round(float(v), 4) for v in vs)) for t, *vs in found]
    return spark.createDataFrame(rows, "total_reads double, expected_distinct double, lower_ci double, upper_ci double")


def _origin(strand: str = "") -> str:
    return f"""{MERGED}, ux AS (SELECT * FROM reads WHERE flag & 2820 = 0 AND nh <= 1),
qs(ln, o, a, b) AS (VALUES (1, 0, 0, 50), (2, 0, 0, 20), (2, 1, 120, 150), (3, 0, 5, 50), (4, 0, 0, 25), (4, 1, 27, 50), (5, 0, 0, 25), (5, 1, 28, 53), (6, 0, 0, 10), (6, 1, 210, 220), (6, 2, 270, 300), (7, 0, 0, 45)),
ub AS (SELECT ux.*, o, pos + a AS s, pos + b AS e FROM ux JOIN qs USING (ln)),
nb AS (SELECT rec_ord, count(*) AS n FROM ub GROUP BY rec_ord),
en AS (SELECT rec_ord, gene_id, count(DISTINCT CASE WHEN mx.s <= ub.s AND ub.e <= mx.e THEN o END) AS k FROM ub JOIN mx ON ub.tid = mx.tid AND ub.s < mx.e AND mx.s < ub.e {strand} GROUP BY rec_ord, gene_id),
gl2 AS (SELECT rec_ord, coalesce(list(gene_id) FILTER (k = n), []) AS gs FROM en JOIN nb USING (rec_ord) GROUP BY rec_ord),
tt AS (SELECT rec_ord, bool_or(NOT (mx.s <= ub.s AND ub.e <= mx.e)) AS t FROM ub JOIN mx ON ub.tid = mx.tid AND ub.s < mx.e AND mx.s < ub.e GROUP BY rec_ord),
gap2 AS (SELECT tid, e AS s, nx AS e FROM (SELECT tid, e, lead(s) OVER (PARTITION BY gene_id ORDER BY s) AS nx FROM mx) WHERE nx > e),
it AS (SELECT DISTINCT rec_ord FROM ub JOIN gap2 g ON ub.tid = g.tid AND ub.s <= g.e AND g.s <= ub.e),
rw AS (SELECT ux.*, coalesce(gs, []) AS gs, coalesce(t, false) AS t, it.rec_ord IS NOT NULL AS i, flag & 3 = 3 AS proper FROM ux LEFT JOIN gl2 USING (rec_ord) LEFT JOIN tt USING (rec_ord) LEFT JOIN it USING (rec_ord)),
un2 AS (SELECT gs, i, t, 1 AS w FROM rw WHERE NOT proper UNION ALL SELECT list_intersect(a.gs, b.gs), a.i OR b.i, a.t OR b.t, 2 FROM rw a JOIN rw b ON a.proper AND b.proper AND a.qname = b.qname AND a.flag & 64 > 0 AND b.flag & 128 > 0),
cnt AS (SELECT rec_ord FROM rw WHERE NOT proper UNION ALL SELECT unnest([a.rec_ord, b.rec_ord]) FROM rw a JOIN rw b ON a.proper AND b.proper AND a.qname = b.qname AND a.flag & 64 > 0 AND b.flag & 128 > 0)"""


ORIGIN = _origin()


@query("a26_strand_votes", oracle(" SELECT count(*) FILTER (y = f) AS ssp_fwd, count(*) FILTER (y <> f) AS ssp_rev FROM (SELECT DISTINCT rec_ord, o, gene_id, (flag & 16 > 0) = (strand = '-') AS y, flag & 1 = 0 OR flag & 64 > 0 AS f FROM ub JOIN cnt USING (rec_ord) JOIN mx ON ub.tid = mx.tid AND mx.s <= ub.s AND ub.e <= mx.e)", ORIGIN))
def strand_votes(spark, d):
    t = Tables(spark, d)
    return qualimap.strand_votes(t.reads, t.exons)


@query("a26_read_origin")
def read_origin(spark, d):
    t = Tables(spark, d)
    return qualimap.origin(t.reads, t.exons, t.tx_exons)


@query("a26_cascade", oracle(" SELECT count(*) FILTER (flag & 4 > 0) AS not_aligned, count(*) FILTER (flag & 4 = 0 AND nh > 1) AS multi_mapped, count(*) FILTER (flag & 4 = 0 AND flag & 256 > 0) AS secondary, count(*) FILTER (flag & 2820 = 0) AS read_count FROM reads"))
def cascade(spark, d):
    return qualimap.cascade_counts(Tables(spark, d).reads)


@query("a26_junction_support")
def junction_support(spark, d):
    t = Tables(spark, d)
    return qualimap.junction_support(t.reads, t.tx_exons)


@query(
    "o02_junction_motifs",
    oracle(
        """, jm AS (SELECT CASE WHEN q > 2 AND q + 1 < 50 THEN substr(seq, CAST(q - 1 AS BIGINT), 2) || '/' || substr(seq, CAST(q + 1 AS BIGINT), 2) END AS motif FROM ux JOIN (VALUES (2, 20), (6, 10), (6, 20)) v(ln, q) USING (ln))
  SELECT motif, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM jm), 6) AS percent FROM jm GROUP BY motif ORDER BY n DESC, motif LIMIT 11""",
        ORIGIN,
    ),
)
def junction_motifs(spark, d):
    return _round(qualimap.junction_motifs(Tables(spark, d).reads))


def _read_origin(library: str, flip: str) -> None:
    @query(f"a26_read_origin_{library}", oracle(" SELECT CASE WHEN len(gs) = 1 THEN 'exonic' WHEN len(gs) > 1 THEN 'ambiguous' WHEN i THEN 'intronic' ELSE 'intergenic' END AS origin, CAST(sum(w) AS BIGINT) AS n FROM un2 GROUP BY 1 UNION ALL SELECT 'overlapping_exon', count(*) FROM un2 WHERE t", _origin(f"AND strand = CASE WHEN (flag & 16 > 0) <> ({flip}) THEN '-' ELSE '+' END")))
    def stranded_origin(spark, d):
        t = Tables(spark, d)
        return qualimap.origin(t.reads, t.exons, t.tx_exons, library)

    @query(f"j01_gene_hits_{library}", oracle(f" SELECT rec_ord, CAST(count(DISTINCT gene_id) AS BIGINT) AS n_genes, min(gene_id) AS first_gene FROM blocks JOIN exons ON blocks.tid = exons.tid AND blocks.s < exons.e AND exons.s < blocks.e WHERE (CASE WHEN (flag & 16 > 0) <> (flag & 129 = 129) THEN '-' ELSE '+' END = strand) = {str(library == 'forward').lower()} GROUP BY rec_ord", blocks=True))
    def stranded_hits(spark, d):
        t = Tables(spark, d)
        return counting.read_genes(t.reads, t.exons, library).select("rec_ord", F.size("genes").cast("long").alias("n_genes"), F.array_min("genes").alias("first_gene"))


_read_origin("forward", "flag & 65 = 1")
_read_origin("reverse", "flag & 64 > 0 OR flag & 1 = 0")


PLACES = f"""{ORIGIN}, cvb AS (SELECT DISTINCT rec_ord, o, gene_id, ub.s, ub.e - 1 AS e FROM ub JOIN cnt USING (rec_ord) JOIN mx ON ub.tid = mx.tid AND mx.s <= ub.s AND ub.e <= mx.e),
ofs AS (SELECT *, sum(e - s) OVER (PARTITION BY gene_id ORDER BY CASE strand WHEN '-' THEN -s ELSE s END) - (e - s) AS before, sum(e - s) OVER (PARTITION BY gene_id) AS l FROM mx),
bas AS (SELECT gene_id, strand, l, before + p - s AS i, p FROM (SELECT *, unnest(range(s, e)) AS p FROM ofs)),
dpt AS (SELECT bas.gene_id, any_value(strand) AS strand, any_value(l) AS l, i, count(*) AS c FROM bas JOIN cvb ON bas.gene_id = cvb.gene_id AND cvb.s <= p AND p < cvb.e GROUP BY bas.gene_id, i),
mns AS (SELECT gene_id, any_value(strand) AS strand, any_value(l) AS l, sum(c) / any_value(l) AS mean FROM dpt GROUP BY gene_id)"""


@query(
    "a27_coverage_profile",
    oracle(
        """, cap AS (SELECT min(c) AS cap FROM (SELECT unnest(list_transform(range(4, 31), lambda k: 1::BIGINT << k)) AS c) WHERE (SELECT count(*) FROM genes) <= c * 3 // 4),
  hsh AS (SELECT gene_id, gene_ord, list_reduce(list_concat([0::BIGINT], list_transform(string_split(gene_id, ''), lambda ch: ascii(ch)::BIGINT)), lambda h, x: (h * 31 + x) & 4294967295) AS h FROM genes),
  once AS (SELECT * FROM (SELECT mns.*, row_number() OVER (PARTITION BY mean ORDER BY xor(h, h >> 16) & (cap - 1) DESC, gene_ord DESC) AS k FROM mns JOIN hsh USING (gene_id), cap) WHERE k = 1),
  chosen AS (SELECT gene_id, 'total' AS profile FROM once UNION ALL SELECT * FROM (SELECT gene_id, 'low' FROM once ORDER BY mean LIMIT 500) UNION ALL SELECT * FROM (SELECT gene_id, 'high' FROM once ORDER BY mean DESC LIMIT 500))
  SELECT profile, CAST(bin AS BIGINT) AS bin, round(sum(v), 6) AS coverage FROM (SELECT gene_id, i // CAST(ceil(l / 100) AS BIGINT) AS bin, sum(c) / any_value(l) AS v FROM dpt GROUP BY gene_id, i // CAST(ceil(l / 100) AS BIGINT)) JOIN chosen USING (gene_id) GROUP BY profile, bin""",
        PLACES,
    ),
)
def coverage_profile(spark, d):
    t = Tables(spark, d)
    return _round(qualimap.profiles(qualimap.transcript_coverage(t.reads, t.exons, t.tx_exons), t.transcripts).withColumn("bin", F.col("bin").cast("long")))


MEANS = f"""{ORIGIN}, mc AS (SELECT gene_id, sum(n) AS n FROM (SELECT DISTINCT rec_ord, o, gene_id, ub.e - 1 - ub.s AS n FROM ub JOIN cnt USING (rec_ord) JOIN mx ON ub.tid = mx.tid AND mx.s <= ub.s AND ub.e <= mx.e) GROUP BY gene_id), tl AS (SELECT gene_id, sum(e - s) AS l FROM mx GROUP BY gene_id)"""


@query("a27_mean_coverage", oracle(" SELECT gene_id AS tx_id, round(n / l, 6) AS mean FROM mc JOIN tl USING (gene_id)", MEANS))
def mean_coverage(spark, d):
    t = Tables(spark, d)
    return _round(qualimap.mean_coverage(qualimap.transcript_coverage(t.reads, t.exons, t.tx_exons)).select("tx_id", "mean"))


@query("a27_coverage_histogram", oracle(" SELECT CAST(least(floor(n / l), 50) AS BIGINT) AS bin, count(*) AS n FROM mc JOIN tl USING (gene_id) GROUP BY 1", MEANS))
def coverage_histogram(spark, d):
    t = Tables(spark, d)
    return qualimap.coverage_histogram(qualimap.transcript_coverage(t.reads, t.exons, t.tx_exons))


@query(
    "a27_bias",
    oracle(
        """, ends2 AS (SELECT gene_id, any_value(mns.strand) AS strand, any_value(mean) AS mean, sum(CASE WHEN i < 20 THEN c ELSE 0 END) / 20 AS head, sum(CASE WHEN i >= dpt.l - 20 THEN c ELSE 0 END) / 20 AS tail FROM dpt JOIN mns USING (gene_id) WHERE gene_id IN (SELECT gene_id FROM mns WHERE l >= 60 AND mean >= 1 ORDER BY mean DESC, gene_id LIMIT 1000) GROUP BY gene_id),
  b AS (SELECT CASE strand WHEN '-' THEN tail ELSE head END / mean AS five, CASE strand WHEN '-' THEN head ELSE tail END / mean AS three FROM ends2)
  SELECT round(median(five), 6) AS bias_5p, round(median(three), 6) AS bias_3p, round(median(CASE WHEN three > 0 THEN five / three WHEN five > 0 THEN 'Infinity'::DOUBLE END), 6) AS bias_5p_3p, count(*) AS n FROM b""",
        PLACES,
    ),
)
def bias(spark, d):
    t = Tables(spark, d)
    return _round(qualimap.bias(qualimap.transcript_coverage(t.reads, t.exons, t.tx_exons), t.transcripts, least_length=60, edge=20))


LEFT = "lm AS (SELECT * FROM reads WHERE flag & 3852 = 0 AND flag & 3 = 3 AND tid = mtid AND mapq >= 30 AND tlen > 0)"


@query("a28_fragment_lengths", oracle(" SELECT least(tlen, 1001) AS tlen, count(*) AS n FROM lm GROUP BY 1", LEFT))
def fragment_lengths(spark, d):
    return fragmentomics.fragment_lengths(Tables(spark, d).reads)


_BINS = ", ".join(f"count(*) FILTER (tlen >= {a} AND tlen < {b}) AS bin_{n}" for n, a, b in zip(kmers.TLEN_BINS, kmers.TLEN_EDGES, [*kmers.TLEN_EDGES[1:], 1001], strict=True))


@query("a28_fragment_summary", oracle(f" SELECT {_BINS}, count(*) FILTER (tlen > 1000) AS overflow, round(count(*) FILTER (tlen < 80) / count(*), 6) AS frac_lt_80, round(count(*) FILTER (tlen >= 300) / count(*), 6) AS frac_ge_300, round(avg(least(tlen, 1001)), 6) AS mean, CAST(quantile_disc(least(tlen, 1001), 0.5) AS BIGINT) AS median FROM lm", LEFT))
def fragment_summary(spark, d):
    return _round(fragmentomics.fragment_summary(fragmentomics.fragment_lengths(Tables(spark, d).reads)))


LONG = "rl AS (SELECT * REPLACE (CASE WHEN CAST(qname AS BIGINT) % 5 = 0 THEN tlen * 4 ELSE tlen END AS tlen) FROM reads), ll AS (SELECT * FROM rl WHERE flag & 3852 = 0 AND flag & 3 = 3 AND tid = mtid AND mapq >= 30 AND tlen > 0)"


@query("a28_fragment_summary_overflow", oracle(f" SELECT {_BINS}, count(*) FILTER (tlen > 1000) AS overflow, round(count(*) FILTER (tlen < 80) / count(*), 6) AS frac_lt_80, round(count(*) FILTER (tlen >= 300) / count(*), 6) AS frac_ge_300, round(avg(least(tlen, 1001)), 6) AS mean, CAST(quantile_disc(least(tlen, 1001), 0.5) AS BIGINT) AS median FROM ll", LONG))
def fragment_summary_overflow(spark, d):
    return _round(fragmentomics.fragment_summary(fragmentomics.fragment_lengths(Tables(spark, d).long_reads)))


@query("a28_readthrough", oracle(" SELECT round(count(*) FILTER (abs(tlen) < 50) / count(*), 6) AS adapter_readthrough_rate, count(*) AS n FROM lm", LEFT))
def readthrough(spark, d):
    return _round(fragmentomics.readthrough_rate(Tables(spark, d).reads))


#: A reference sequence in chunks: the bases of a chunk come from hashes of its 32-base pieces.
CHUNK = 1024


def _fasta(t: Tables) -> DataFrame:
    """Chunks of 1024 bases, each with three bases of the next, over the first 500,000 bases of four contigs."""
    rows = t.contigs.where("tid < 4").select(F.col("name").alias("contig"), F.explode(F.sequence(F.lit(0), F.lit(487))).alias("chunk_no"))
    piece = lambda k: F.translate(F.md5(F.concat("contig", F.lit(":"), k.cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGN")
    own = F.array_join(F.transform(F.sequence(F.col("chunk_no") * 32, F.col("chunk_no") * 32 + 32), piece), "")
    return rows.select("contig", "chunk_no", F.substring(own, 1, CHUNK + 3).alias("seq"))


_PIECE = "translate(md5(c || ':' || CAST({k} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGN')"
_AT = lambda p: f"substr({_PIECE.format(k=f'({p}) // 32')} || {_PIECE.format(k=f'({p}) // 32 + 1')}, CAST(({p}) % 32 + 1 AS BIGINT), 4)"
MOTIFS = f"""{LEFT}, em AS (SELECT CASE WHEN tid < 4 AND pos // 1024 <= 487 THEN {_AT("pos")} END AS p5, CASE WHEN tid < 4 AND (pos + tlen - 4) // 1024 <= 487 THEN {_AT("pos + tlen - 4")} END AS p3, tlen FROM (SELECT *, 'chr' || CAST(tid + 1 AS VARCHAR) AS c FROM lm)),
ek AS (SELECT *, CASE WHEN p5 IS NULL OR p3 IS NULL OR tlen < 4 THEN 'skipped_oob' WHEN p5 LIKE '%N%' OR p3 LIKE '%N%' THEN 'skipped_non_acgt' ELSE 'used' END AS kind FROM em)"""


@query("a29_end_motifs", oracle(' SELECT \'5p\' AS "end", p5 AS kmer, count(*) AS n FROM ek WHERE kind = \'used\' GROUP BY p5 UNION ALL SELECT \'3p\', translate(reverse(p3), \'ACGT\', \'TGCA\'), count(*) FROM ek WHERE kind = \'used\' GROUP BY 2 UNION ALL SELECT kind, NULL, count(*) FROM ek GROUP BY kind', MOTIFS))
def end_motifs(spark, d):
    t = Tables(spark, d)
    return fragmentomics.end_motifs(t.reads.withColumn("contig", F.concat(F.lit("chr"), (F.col("tid") + 1).cast("string"))), _fasta(t), chunk=CHUNK)


CLIPS = "sc AS (SELECT CASE WHEN (ln = 3) = (flag & 16 = 0) THEN '5p' ELSE '3p' END AS ed, CASE WHEN flag & 16 > 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS q FROM reads WHERE flag & 3844 = 0 AND mapq >= 30 AND ln IN (3, 7))"


@query("a30_soft_clips", oracle(' SELECT ed AS "end", \'len_3plus\' AS clip_bin, CASE WHEN ed = \'5p\' THEN substr(q, 1, 4) ELSE substr(q, 47, 4) END AS kmer, count(*) AS n FROM sc GROUP BY ALL', CLIPS))
def soft_clips(spark, d):
    return fragmentomics.soft_clips(Tables(spark, d).reads)


SHORT = "sq AS (SELECT CASE WHEN (ln = 3) = (flag & 16 = 0) THEN '5p' ELSE '3p' END AS ed, CASE rec_ord % 3 WHEN 0 THEN 'len_1' WHEN 1 THEN 'len_2' ELSE 'len_3plus' END AS clip_bin, CASE WHEN flag & 16 > 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS q FROM reads WHERE flag & 3844 = 0 AND mapq >= 30 AND ln IN (3, 7))"


@query("a30_short_clips", oracle(' SELECT ed AS "end", clip_bin, CASE WHEN ed = \'5p\' THEN substr(q, 1, 4) ELSE substr(q, 47, 4) END AS kmer, count(*) AS n FROM sq GROUP BY ALL', SHORT))
def short_clips(spark, d):
    """Clips of one, two and more bases."""
    reads = Tables(spark, d).reads
    n = F.when(F.col("rec_ord") % 3 == 0, "1").when(F.col("rec_ord") % 3 == 1, "2").otherwise("5")
    cut = F.when(F.col("ln") == 3, F.concat(n, F.lit("S45M"))).when(F.col("ln") == 7, F.concat(F.lit("45M"), n, F.lit("S"))).otherwise(F.col("cigar"))
    return fragmentomics.soft_clips(reads.withColumn("cigar", cut))


@query("a30_clip_rates", oracle(" SELECT round(count(*) FILTER (ln IN (3, 7) AND (ln = 3) = (flag & 16 = 0)) / count(*), 6) AS rate_5p, round(count(*) FILTER (ln IN (3, 7) AND (ln = 3) <> (flag & 16 = 0)) / count(*), 6) AS rate_3p, count(*) AS n FROM reads WHERE flag & 3844 = 0 AND mapq >= 30"))
def clip_rates(spark, d):
    return _round(fragmentomics.clip_rates(Tables(spark, d).reads))


@query(
    "m09_periodicity",
    oracle(
        """, hc AS (SELECT k, coalesce(n, 0) AS n FROM (SELECT unnest(range(451)) AS k) LEFT JOIN (SELECT tlen - 50 AS k, count(*) AS n FROM lm WHERE tlen BETWEEN 50 AND 500 GROUP BY 1) USING (k)),
  hx AS (SELECT k, n - avg(n) OVER () AS x FROM hc),
  pw AS (SELECT j, sum(x * cos(2 * pi() * j * k / 512)) ** 2 + sum(x * sin(2 * pi() * j * k / 512)) ** 2 AS p FROM hx, (SELECT unnest(range(257)) AS j) GROUP BY j),
  tt2 AS (SELECT sum(p) FILTER (j >= 1) AS total, max(p) FILTER (j >= 2) AS top FROM pw)
  SELECT round(total, 0) AS total_power, round((SELECT p FROM pw WHERE j = 3) / total, 6) AS nucleosomal_fraction, round((SELECT avg(p) FROM pw WHERE j IN (51, 46)) / total, 6) AS helical_fraction, CAST(512 // (SELECT min(j) FROM pw, tt2 WHERE j >= 2 AND p >= top * (1 - 1e-12)) AS DOUBLE) AS peak_period, round(top / total, 6) AS peak_power FROM tt2""",
        LEFT,
    ),
)
def periodicity(spark, d):
    got = fragmentomics.periodicity(fragmentomics.fragment_lengths(Tables(spark, d).reads))
    return spark.createDataFrame([tuple(None if v is None else round(float(v), 0 if k == "total_power" else 6) for k, v in got.items())], ", ".join(f"{k} double" for k in got))


@query(
    "a31_chrom_metrics",
    oracle(
        """ SELECT name, length, total, mapped, duplicates, round(mapped / sum(mapped) OVER (), 6) AS mapped_fraction, proper_pairs, round(coalesce(mean_insert, 0), 6) AS mean_insert FROM (SELECT tid, count(*) AS total, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 1024 > 0) AS duplicates,
  count(*) FILTER (p) AS proper_pairs, avg(CASE WHEN p THEN tlen END) AS mean_insert FROM (SELECT *, flag & 2816 = 0 AND flag & 3 = 3 AND flag & 12 = 0 AND tid = mtid AND tlen > 0 AS p FROM reads) GROUP BY tid) JOIN contigs USING (tid)"""
    ),
)
def chrom_metrics(spark, d):
    t = Tables(spark, d)
    return _round(readstats.chrom_metrics(t.reads, t.contigs))


@query("a32_cycle_quality", oracle(" SELECT is_last, CAST(cycle AS INTEGER) AS cycle, round(avg(2 + (rec_ord * 3 + i * 11) % 40), 6) AS mean_quality, count(*) AS n FROM cy WHERE flag & 3844 = 0 GROUP BY is_last, cycle", CYCLES))
def cycle_quality(spark, d):
    t = Tables(spark, d)
    return _round(readstats.cycle_quality(t.reads, t.quality))


CLASSES = "cl AS (SELECT DISTINCT substr(p_brand, 7, 1) AS class, p_name AS symbol FROM part WHERE p_partkey % 7 = 0 UNION SELECT 'none', 'absent symbol')"


def _classes(t: Tables) -> DataFrame:
    part = t.spark.read.parquet(f"{t.dir}/part.parquet")
    return part.where("p_partkey % 7 = 0").select(F.substring("p_brand", 7, 1).alias("class"), F.col("p_name").alias("symbol")).union(t.spark.createDataFrame([("none", "absent symbol")], "class string, symbol string")).distinct()


@query("a33_gene_classes", oracle(" SELECT class, bundled, coalesce(matched, 0) AS matched, coalesce(r, 0) AS reads, round(coalesce(r, 0) / (SELECT sum(fc_reads) FROM fc), 6) AS fraction FROM (SELECT class, count(*) AS bundled FROM cl GROUP BY class) LEFT JOIN (SELECT class, count(DISTINCT gene_id) AS matched, CAST(coalesce(sum(fc_reads), 0) AS BIGINT) AS r FROM cl JOIN genes USING (symbol) LEFT JOIN fc USING (gene_id) GROUP BY class) USING (class)", STATUS, FC, CLASSES, blocks=True))
def gene_classes(spark, d):
    t = Tables(spark, d)
    return _round(cohort.gene_class_fractions(t.fc_reads, t.genes, _classes(t)))


PANELS = "pn AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'G' || CAST(p_partkey AS VARCHAR) END AS gid, p_name AS gene_symbol, 'panel' || CAST(p_partkey % 2 AS VARCHAR) AS panel, 'cell' || CAST(p_partkey % 5 AS VARCHAR) AS cell_type FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT 'G' || CAST(p_partkey AS VARCHAR), p_name, 'panel' || CAST(p_partkey % 2 AS VARCHAR), 'cell' || CAST(p_partkey % 5 AS VARCHAR) FROM part WHERE p_partkey % 22 = 0 UNION ALL SELECT NULL, 'absent', 'panel0', 'ghost'), sy AS (SELECT symbol AS gene_symbol, arg_max(gene_id, gene_ord) AS sg FROM genes GROUP BY symbol)"


@query("a34_panels", oracle(" SELECT panel, cell_type, coalesce(n, 0) AS n_genes, coalesce(r, 0) AS reads, round(coalesce(r, 0) / (SELECT sum(fc_reads) FROM fc), 6) AS fraction FROM (SELECT DISTINCT panel, cell_type FROM pn) LEFT JOIN (SELECT panel, cell_type, count(*) AS n, CAST(coalesce(sum(fc_reads), 0) AS BIGINT) AS r FROM (SELECT panel, cell_type, coalesce(gid, sg) AS gene_id FROM pn LEFT JOIN sy USING (gene_symbol) WHERE coalesce(gid, sg) IS NOT NULL) LEFT JOIN fc USING (gene_id) GROUP BY ALL) USING (panel, cell_type)", STATUS, FC, PANELS, blocks=True))
def panels(spark, d):
    t = Tables(spark, d)
    part = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 11 = 0")
    text = lambda c: F.col(c).cast("string")
    rows = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("G"), text("p_partkey"))).alias("gene_id"), F.col("p_name").alias("gene_symbol"), F.concat(F.lit("panel"), (F.col("p_partkey") % 2).cast("string")).alias("panel"), F.concat(F.lit("cell"), (F.col("p_partkey") % 5).cast("string")).alias("cell_type"))
    ghost = spark.createDataFrame([(None, "absent", "panel0", "ghost")], "gene_id string, gene_symbol string, panel string, cell_type string")
    twice = rows.where(F.col("p_partkey") % 22 == 0).withColumn("gene_id", F.concat(F.lit("G"), text("p_partkey")))  # some genes stand in a cell twice
    return _round(cohort.panel_totals(rows.unionByName(twice).drop("p_partkey").unionByName(ghost), t.genes, t.fc_reads))


@query(
    "a35_sex",
    oracle(
        """, pc AS (SELECT CASE tid WHEN 4 THEN 'chrY' WHEN 3 THEN 'X' ELSE 'chr' || CAST(tid + 1 AS VARCHAR) END AS name, count(*) AS mapped FROM reads WHERE flag & 4 = 0 GROUP BY tid),
  sg AS (SELECT CASE gene_ord % 50 WHEN 0 THEN 'XIST' WHEN 1 THEN 'RPS4Y1' END AS sym, fc_reads FROM fc JOIN genes USING (gene_id)),
  v AS (SELECT (SELECT CAST(coalesce(sum(mapped), 0) AS BIGINT) FROM pc WHERE name = 'chrY') AS chr_y, (SELECT CAST(coalesce(sum(mapped), 0) AS BIGINT) FROM pc WHERE name IN ('chr1', 'chr2', 'chr3')) AS autosomes, (SELECT CAST(sum(fc_reads) AS BIGINT) FROM sg) AS assigned, (SELECT CAST(coalesce(sum(fc_reads), 0) AS BIGINT) FROM sg WHERE sym = 'XIST') AS xist, (SELECT CAST(coalesce(sum(fc_reads), 0) AS BIGINT) FROM sg WHERE sym = 'RPS4Y1') AS rps4y1)
  SELECT *, round(chr_y / autosomes, 6) AS y_ratio, round(xist / assigned, 6) AS xist_fraction, round(rps4y1 / assigned, 6) AS rps4y1_fraction, CASE WHEN autosomes < 1000 THEN 'unknown' WHEN (chr_y / autosomes > 1e-3 OR rps4y1 / assigned > 1e-5) AND xist / assigned > 1e-4 THEN 'ambiguous' WHEN chr_y / autosomes > 1e-3 OR rps4y1 / assigned > 1e-5 THEN 'male' WHEN xist / assigned > 1e-4 THEN 'female' ELSE 'unknown' END AS predicted FROM v""",
        STATUS,
        FC,
        blocks=True,
    ),
)
def sex(spark, d):
    t = Tables(spark, d)
    name = F.when(F.col("tid") == 4, "chrY").when(F.col("tid") == 3, "X").otherwise(F.concat(F.lit("chr"), (F.col("tid") + 1).cast("string")))
    per = t.reads.where("flag & 4 = 0").groupBy("tid").agg(F.count("*").alias("mapped")).select(name.alias("name"), "mapped")
    genes = t.genes.withColumn("symbol", F.when(F.col("gene_ord") % 50 == 0, "XIST").when(F.col("gene_ord") % 50 == 1, "RPS4Y1").otherwise(F.col("symbol")))
    return _round(cohort.sex_inference(per, t.fc_reads, genes))


@query(
    "a36_gene_saturation",
    oracle(
        f""", bk AS (SELECT g AS gene_id, {_crc(_ORDS.format('qname'))} % 100 AS b FROM st, ct WHERE status = 'Assigned'),
  grown AS (SELECT f AS fraction, gene_id, count(*) AS n FROM bk, (SELECT unnest([0.05, 0.10, 0.25, 0.50, 0.75, 1.00]::DOUBLE[]) AS f) WHERE b < ceil(f * 100) GROUP BY 1, 2)
  SELECT fraction, count(*) AS genes_ge_1, count(*) FILTER (n >= 10) AS genes_ge_10, CAST(sum(n) AS BIGINT) AS reads FROM grown GROUP BY fraction""",
        STATUS,
        CRC,
        blocks=True,
    ),
)
def gene_saturation(spark, d):
    t = Tables(spark, d)
    return cohort.gene_saturation(t.status.where("gene_id is not null").select("qname", "gene_id"))


@query("a36_gene_saturation_end", oracle(" SELECT CAST(1.0 AS DOUBLE) AS fraction, count(*) AS genes_ge_1, count(*) FILTER (fc_reads >= 10) AS genes_ge_10, CAST(sum(fc_reads) AS BIGINT) AS reads FROM fc", STATUS, FC, blocks=True))
def gene_saturation_end(spark, d):
    return gene_saturation(spark, d).where("fraction = 1")


SNPS = "sn AS (SELECT CAST(p_partkey % 5 AS INTEGER) AS tid, (p_partkey * 23) % 4900000 + 17 AS site, substr('ACGT', CAST(p_size % 4 + 1 AS BIGINT), 1) AS ref, substr('CGTA', CAST(p_size % 4 + 1 AS BIGINT), 1) AS alt FROM part WHERE p_partkey % 4 = 1)"
SEEN = "se AS (SELECT sn.tid, site, ref, alt, substr(seq, CAST(q + site - s + 1 AS BIGINT), 1) AS base FROM sn JOIN blocks b ON sn.tid = b.tid AND s <= site AND site < e WHERE flag & 3844 = 0 AND mapq >= 30), sd AS (SELECT tid, site, ref, alt, " + ", ".join(f"count(base) FILTER (base = '{b}') AS depth_{b.lower()}" for b in "ACGT") + " FROM sn LEFT JOIN se USING (tid, site, ref, alt) GROUP BY ALL)"


@query("a37_snp_fingerprint", oracle(" SELECT *, depth - ref_count - alt_count AS other_count, round(CASE WHEN depth > 0 THEN alt_count / depth ELSE 0 END, 6) AS alt_fraction, depth >= 4 AS called FROM (SELECT *, depth_a + depth_c + depth_g + depth_t AS depth, CASE ref WHEN 'A' THEN depth_a WHEN 'C' THEN depth_c WHEN 'G' THEN depth_g ELSE depth_t END AS ref_count, CASE alt WHEN 'A' THEN depth_a WHEN 'C' THEN depth_c WHEN 'G' THEN depth_g ELSE depth_t END AS alt_count FROM sd)", SNPS, SEEN, blocks=True))
def snp_fingerprint(spark, d):
    t = Tables(spark, d)
    part = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 4 = 1")
    letter = lambda s: F.substring(F.lit(s), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1))
    sites = part.select((F.col("p_partkey") % 5).cast("int").alias("tid"), ((F.col("p_partkey") * 23) % 4900000 + 17).alias("site"), letter("ACGT").alias("ref"), letter("CGTA").alias("alt"))
    return _round(cohort.snp_depths(t.reads, sites))


@query("a37_snp_summary", oracle(" SELECT count(*) AS sites_total, count(*) FILTER (depth > 0) AS sites_with_any_depth, count(*) FILTER (depth >= 4) AS sites_called, 4 AS min_depth_for_called FROM (SELECT depth_a + depth_c + depth_g + depth_t AS depth FROM sd)", SNPS, SEEN, blocks=True))
def snp_summary(spark, d):
    return cohort.snp_summary(snp_fingerprint(spark, d))


@query("a38_splice_motifs")
def splice_motifs(spark, d):
    t = Tables(spark, d)
    found = rseqc.junctions(rseqc.splice_events(t.reads), rseqc.known_introns(t.tx_exons)).select(F.concat(F.lit("chr"), (F.col("tid") + 1).cast("string")).alias("contig"), "s", "e")
    return fragmentomics.splice_motifs(found, _fasta(t), chunk=CHUNK)


ONE = f"{FRAGMENTS}, og AS (SELECT rec_ord, gene_id, both_in FROM (SELECT gs[1] AS gene_id, xr IS NOT NULL AND yr IS NOT NULL AS both_in, unnest([xr, yr]) AS rec_ord FROM fr WHERE len(gs) = 1) JOIN reads USING (rec_ord) WHERE flag & 3844 = 0 AND mapq >= 30), o1 AS (SELECT reads.*, gene_id, both_in FROM og JOIN reads USING (rec_ord))"


def _one(t: Tables) -> DataFrame:
    return pergene.single_gene(counting.fragments(t.reads, t.exons, carry=pergene.CARRY))


@query("a39_read_counts", oracle(" SELECT gene_id, count(*) AS primary_reads, count(*) FILTER (c5) AS primary_reads_with_5p_clip, count(*) FILTER (c3) AS primary_reads_with_3p_clip, round(count(*) FILTER (c5) / count(*), 6) AS soft_clip_rate_5p, round(count(*) FILTER (c3) / count(*), 6) AS soft_clip_rate_3p FROM (SELECT *, ln IN (3, 7) AND (ln = 3) = (flag & 16 = 0) AS c5, ln IN (3, 7) AND (ln = 3) <> (flag & 16 = 0) AS c3 FROM o1) GROUP BY gene_id", ONE, blocks=True))
def pergene_counts(spark, d):
    return _round(pergene.read_counts(_one(Tables(spark, d))))


@query("a41_overlap_bases", oracle(" SELECT gene_id, CAST(sum(x) AS BIGINT) AS exon_aligned_bp, CAST(sum(w - x) AS BIGINT) AS intron_aligned_bp FROM (SELECT b.rec_ord, b.s, b.e, gene_id, sum(greatest(0, least(b.e, mx.e) - greatest(b.s, mx.s))) AS x, greatest(0, least(b.e, max(mx.e)) - greatest(b.s, min(mx.s))) AS w FROM og JOIN blocks b USING (rec_ord) JOIN mx USING (gene_id) GROUP BY b.rec_ord, b.s, b.e, gene_id) GROUP BY gene_id", ONE, MERGED, blocks=True))
def overlap_bases(spark, d):
    t = Tables(spark, d)
    return pergene.overlap_bases(_one(t), pergene.shapes(t.exons)).select("gene_id", "exon_aligned_bp", "intron_aligned_bp")


CODING = "cdr AS (SELECT gene_id, gene_ord, s + 7 AS cs, s + (e - s) // 2 + 7 AS ce FROM genes WHERE gene_ord % 3 <> 0), cdb AS (SELECT DISTINCT gene_id, p FROM (SELECT gene_id, unnest(range(cs, ce)) AS p FROM cdr UNION ALL SELECT gene_id, unnest(range(cs + 3, ce + 5)) FROM cdr) JOIN mx USING (gene_id) WHERE mx.s <= p AND p < mx.e)"


@query(
    "a41_coding_bases",
    oracle(
        """, ob AS (SELECT b.rec_ord, b.s, b.e, gene_id, sum(greatest(0, least(b.e, mx.e) - greatest(b.s, mx.s))) AS x, greatest(0, least(b.e, max(mx.e)) - greatest(b.s, min(mx.s))) AS w FROM og JOIN blocks b USING (rec_ord) JOIN mx USING (gene_id) GROUP BY b.rec_ord, b.s, b.e, gene_id),
  cc AS (SELECT gene_id, count(*) AS c FROM og JOIN blocks b USING (rec_ord) JOIN cdb USING (gene_id) WHERE b.s <= p AND p < b.e GROUP BY gene_id),
  al AS (SELECT gene_id, CAST(sum(x) AS BIGINT) AS x, CAST(sum(w - x) AS BIGINT) AS i FROM ob GROUP BY gene_id)
  SELECT gene_id, x AS exon_aligned_bp, i AS intron_aligned_bp, coalesce(c, 0) AS cds_aligned_bp, x - coalesce(c, 0) AS utr_aligned_bp, round(CASE WHEN x > 0 THEN coalesce(c, 0) / x END, 6) AS cds_utr_ratio, round(CASE WHEN x + i > 0 THEN i / (x + i) END, 6) AS intron_retention_rate FROM al LEFT JOIN cc USING (gene_id)""",
        ONE,
        MERGED,
        CODING,
        blocks=True,
    ),
)
def coding_bases(spark, d):
    t = Tables(spark, d)
    return _round(pergene.overlap_bases(_one(t), pergene.shapes(t.exons, t.cds)))


@query("a40_deciles", oracle(" SELECT gene_id, CAST(least(9, floor(10 * CASE WHEN strand = '-' THEN 1 - r ELSE r END)) AS BIGINT) AS decile, count(*) AS n FROM (SELECT gene_id, strand, (before + (greatest(b.s, mx.s) + 1 + least(b.e, mx.e)) // 2 - mx.s - 1 + 0.5) / total AS r FROM og JOIN blocks b USING (rec_ord) JOIN (SELECT *, sum(e - s) OVER (PARTITION BY gene_id ORDER BY s) - (e - s) AS before, sum(e - s) OVER (PARTITION BY gene_id) AS total FROM mx) mx USING (gene_id) WHERE b.s < mx.e AND mx.s < b.e) GROUP BY ALL", ONE, MERGED, blocks=True))
def deciles(spark, d):
    t = Tables(spark, d)
    per = pergene.deciles(_one(t), pergene.shapes(t.exons))
    return per.select("gene_id", F.posexplode("decile_coverage").alias("decile", "n")).where("n > 0").select("gene_id", F.col("decile").cast("long").alias("decile"), "n")


@query("a39_per_gene_table")
def per_gene_table(spark, d):
    t = Tables(spark, d)
    reads = t.long_reads.withColumn("contig", F.concat(F.lit("chr"), (F.col("tid") + 1).cast("string")))
    made = pergene.table(reads, t.exons, t.genes, t.lengths, t.fc_reads, cds=t.cds, fasta=_fasta(t), min_reads=5, chunk=CHUNK)
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x.key, F.lit(":"), x.value.cast("string"))), ",")
    return _round(made.withColumn("decile_coverage", F.array_join(F.col("decile_coverage").cast("array<string>"), ",")).withColumn("em_5p", text("em_5p")).withColumn("em_3p", text("em_3p")))


@query("a42_fragment_bins")
def fragment_bins(spark, d):
    t = Tables(spark, d)
    return _round(pergene.fragment_bins(pergene.single_gene(counting.fragments(t.long_reads, t.exons, carry=pergene.CARRY))))


@query("a43_qc_flags")
def qc_flags(spark, d):
    """All rules over the sample's own reports; the biotype Brand#11 stands for rRNA, and the library's name is a setting."""
    t = Tables(spark, d)
    flat = readstats.flagstat(t.reads).crossJoin(cohort.first_pass(t.reads).select("is_paired", "skip_dup_check"))  # one row each
    strand = rseqc.infer_strandedness(rseqc.strand_classes(t.reads, t.transcripts)).first().strandedness
    matrix = _matrix(t)
    biotypes = {r.biotype: r.n for r in counting.biotype_counts(counting.biotype_status(t.reads, t.exons)).collect()}
    sets = rseqc.regions(t.transcripts, t.tx_exons)
    tags = {r.region: r.tags for r in rseqc.region_report(rseqc.region_tags(t.reads, sets), sets).collect()}
    told = {
        "max_length": readstats.summary(t.reads, t.quality).first().maximum_length, "rrna_reads": biotypes.get("Brand#11", 0), "biotype_assigned": sum(biotypes.values()), "library_prep": "Tagmentation kit", "strandedness": strand, "complexity_slope": None,
        "fit_intercept": counting.fit_duplication(matrix)["intercept"], "genes_with_reads": matrix.where("all_counts > 0").count(), "intron_tags": tags["intron"], "cds_tags": tags["cds_exon"], "utr_tags": tags["utr_5"] + tags["utr_3"],
        "median_tlen": fragmentomics.fragment_summary(fragmentomics.fragment_lengths(t.reads)).first().median, "has_fasta": True,
    }
    row = flat.select("is_paired", "skip_dup_check", "properly_paired", "paired", "mapped", "total", "duplicates", *[F.lit(v).cast("double" if v is None else T.LongType() if isinstance(v, int) and not isinstance(v, bool) else _kind(v)).alias(k) for k, v in told.items()])
    return cohort.qc_flags(row).select(F.array_join("qc_flags", ",").alias("qc_flags"))


def _kind(value) -> str:
    return "boolean" if isinstance(value, bool) else "double" if isinstance(value, float) else "string"


_GENOMES = "(VALUES ('GRCh38', '1', 248956422), ('GRCh38', '2', 242193529), ('GRCh38', '3', 198295559), ('GRCh38', '4', 190214555), ('GRCh38', 'X', 156040895), ('GRCh38', 'Y', 57227415), ('GRCh37', '1', 249250621), ('GRCh37', '2', 243199373), ('GRCh37', '3', 198022430), ('GRCh37', '4', 191154276), ('GRCh37', 'X', 155270560), ('GRCh37', 'Y', 59373566), ('T2T-CHM13v2', '1', 248387328), ('T2T-CHM13v2', '2', 242696752), ('T2T-CHM13v2', '3', 201105948), ('T2T-CHM13v2', '4', 193574945), ('T2T-CHM13v2', 'X', 154259566), ('T2T-CHM13v2', 'Y', 62460029)) g(genome, short, length)"


@query("a47_fingerprint", f"SELECT genome, count(*) AS n FROM (SELECT CASE r_regionkey WHEN 0 THEN '1' WHEN 1 THEN '4' WHEN 2 THEN 'X' WHEN 3 THEN '2' ELSE 'Y' END AS short, CASE r_regionkey WHEN 0 THEN 248387328 WHEN 1 THEN 193574945 WHEN 2 THEN 154259566 WHEN 3 THEN 242193529 ELSE 57227415 END AS length FROM region) JOIN {_GENOMES} USING (short, length) GROUP BY genome HAVING count(*) >= 3")
def fingerprint(spark, d):
    """Three contigs of one assembly among two of another."""
    region = spark.read.parquet(f"{d}/region.parquet")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), F.col("r_regionkey").cast("int") + 1)
    return cohort.fingerprint(region.select(pick("chr1", "4", "chrX", "Chr2", "Y").alias("name"), pick(248387328, 193574945, 154259566, 242193529, 57227415).cast("long").alias("length")))


@query("a48_naming_style", oracle(""" SELECT 'as told' AS contigs, style, CASE style WHEN 'no_chr' THEN 'add_chr' ELSE 'none' END AS bridge FROM (SELECT CASE WHEN bool_and(name LIKE 'chr%') THEN 'chr' WHEN bool_or(name LIKE 'chr%') THEN 'unknown' ELSE 'no_chr' END AS style FROM contigs)
  UNION ALL SELECT 'cut', CASE WHEN bool_or(substr(name, 4) LIKE 'chr%') THEN 'unknown' ELSE 'no_chr' END, 'add_chr' FROM contigs UNION ALL SELECT 'mixed', 'unknown', 'none' UNION ALL SELECT 'odd', 'unknown', 'none'"""))
def naming_style(spark, d):
    contigs = Tables(spark, d).contigs
    cut = F.substring("name", 4, 9)
    views_ = {"as told": contigs, "cut": contigs.withColumn("name", cut), "mixed": contigs.withColumn("name", F.when(F.col("tid") > 1, cut).otherwise(F.col("name"))), "odd": contigs.withColumn("name", F.concat(F.lit("scaffold"), cut))}
    styles = {k: cohort.naming_style(v).first().style for k, v in views_.items()}
    return spark.createDataFrame([(k, s, cohort.name_bridge(s, "chr")) for k, s in styles.items()], "contigs string, style string, bridge string")


@query("a46_first_pass", oracle(" SELECT count(*) AS sampled, count(*) FILTER (flag & 1 > 0) AS paired, count(*) FILTER (flag & 1024 > 0) AS duplicates, 2 * count(*) FILTER (flag & 1 > 0) > count(*) AS is_paired, count(*) >= 500 AND count(*) FILTER (flag & 1024 > 0) = 0 AS skip_dup_check FROM (SELECT * FROM reads WHERE flag & 2308 = 0 ORDER BY rec_ord LIMIT 1000)"))
def first_pass(spark, d):
    return cohort.first_pass(Tables(spark, d).reads)


# Sources: the views are written in the format of each and read again.
@query(
    "s01_sam_text",
    oracle(
        """ SELECT r.rec_ord, r.qname, flag, c.name AS contig, r.tid, CAST(pos AS BIGINT) AS pos, mapq, cigar, mtid, CAST(coalesce(mpos, -1) AS BIGINT) AS mpos, tlen, seq, nh, CAST(CASE WHEN r.rec_ord % 3 = 0 THEN 2 END AS INTEGER) AS hi, nm, flag & 1024 > 0 AS is_dup, flag & 2304 = 0 AS is_primary
  FROM (SELECT * REPLACE (row_number() OVER (ORDER BY rec_ord) - 1 AS rec_ord), rec_ord AS own FROM reads) r JOIN contigs c ON r.tid = c.tid WHERE own % 7 = 0""".replace("CASE WHEN r.rec_ord % 3 = 0", "CASE WHEN own % 3 = 0").replace("r.rec_ord, r.qname", "own AS rec_ord, r.qname")
    ),
)
def sam_text(spark, d):
    """Every seventh record as SAM text; a record keeps its number as the first part of its name."""
    from ..sources import alignments

    t = Tables(spark, d)
    names = {r.tid: r.name for r in t.contigs.select("tid", "name").collect()}  # a row for each contig
    name = lambda c: F.element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]), c)
    rnext = F.when(F.col("mtid").isNull(), "*").when(F.col("mtid") == F.col("tid"), "=").otherwise(name(F.col("mtid")))
    text = lambda c: F.col(c).cast("string")
    tags = F.concat_ws("\t", F.concat(F.lit("NM:i:"), text("nm")), F.when(F.col("rec_ord") % 3 == 0, "HI:i:2"), F.concat(F.lit("NH:i:"), text("nh")), F.lit("XS:Z:NH:i:9"))
    fields = [F.concat_ws(":", text("rec_ord"), "qname"), text("flag"), name(F.col("tid")), (F.col("pos") + 1).cast("string"), text("mapq"), F.col("cigar"), rnext, (F.coalesce("mpos", F.lit(-1)) + 1).cast("string"), text("tlen"), F.col("seq"), F.lit("*"), tags]
    body = t.reads.where("rec_ord % 7 = 0").select(F.col("rec_ord").alias("o"), F.concat_ws("\t", *fields).alias("value"))
    head = t.contigs.select((F.col("tid") - 100).cast("long").alias("o"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), text("length")).alias("value"))
    got, _ = alignments.read_sam(spark, views.as_text(body.unionByName(head), "o"))
    own = F.split("qname", ":")
    return got.select(own[0].cast("long").alias("rec_ord"), own[1].alias("qname"), "flag", "contig", "tid", "pos", "mapq", "cigar", "mtid", "mpos", "tlen", "seq", "nh", "hi", "nm", "is_dup", "is_primary")


def _gtf(t: Tables) -> DataFrame:
    """The genes as GTF lines: exons, and CDS and codons of some, as the annotation of one transcript each."""
    attrs = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "T'), "gene_id", F.lit('"; gene_name "'), "symbol", F.lit('"; gene_biotype "'), "biotype", F.lit('";'))
    line = lambda kind, s, e, o: F.struct(F.lit(kind).alias("kind"), s.cast("long").alias("s"), e.cast("long").alias("e"), o.cast("long").alias("o"))
    c = F.col
    coding, codons = c("gene_ord") % 3 != 0, c("gene_ord") % 2 == 0
    more = F.array_compact(F.array(F.when(coding, line("CDS", c("s") + 2, c("s") + 5, c("gene_ord") * 100 + 90)), F.when(codons, line("start_codon", c("s") + 4, c("s") + 7, c("gene_ord") * 100 + 91)), F.when(codons, line("stop_codon", c("e") - 6, c("e") - 3, c("gene_ord") * 100 + 92))))
    rest = t.genes.select("gene_id", "symbol", "biotype", "tid", "strand", F.explode(more).alias("x")).select("gene_id", "symbol", "biotype", "tid", "strand", "x.*")
    order = Window.partitionBy("gene_id").orderBy("s", "e")
    exon = t.exons.select("gene_id", "symbol", "biotype", "tid", "strand", F.lit("exon").alias("kind"), "s", "e", (c("gene_ord") * 100 + F.row_number().over(order)).cast("long").alias("o"))
    text = lambda x: x.cast("string")
    return exon.unionByName(rest).select("o", F.concat_ws("\t", F.concat(F.lit("chr"), text(c("tid") + 1)), F.lit("made"), "kind", text(c("s") + 1), text(c("e")), F.lit("."), "strand", F.lit("."), attrs).alias("value"))


@query(
    "s05_gtf",
    oracle(
        """ SELECT gene_id, row_number() OVER (ORDER BY gene_ord) AS place, 'chr' || (tid + 1) AS contig, strand, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, symbol AS gene_name, biotype AS gene_biotype, 'T' || gene_id AS tx_id,
  CAST(CASE WHEN gene_ord % 3 <> 0 THEN CASE WHEN gene_ord % 2 <> 0 THEN s WHEN strand = '+' THEN s + 4 ELSE e - 6 END END AS BIGINT) AS cds_s, CAST(CASE WHEN gene_ord % 3 <> 0 THEN CASE WHEN gene_ord % 2 <> 0 THEN e WHEN strand = '+' THEN e - 3 ELSE s + 7 END END AS BIGINT) AS cds_e, n AS n_exons
  FROM genes JOIN (SELECT gene_id, count(*) AS n FROM exons GROUP BY gene_id) USING (gene_id)"""
    ),
)
def gtf_text(spark, d):
    """S05, S06, A.1: genes, transcripts and coding ranges from GTF text."""
    from ..sources import annotation

    rows = annotation.read_gtf(spark, views.as_text(_gtf(Tables(spark, d)), "o"), ("gene_name", "gene_biotype"))
    genes, tx = annotation.genes(rows, ("gene_name", "gene_biotype")), annotation.transcripts(rows)
    count = annotation.exons(rows).groupBy("gene_id").agg(F.count("*").alias("n_exons"))
    place = F.row_number().over(Window.orderBy("gene_ord")).cast("long")  # a row for each gene
    return genes.join(tx.select("gene_id", "tx_id", "cds_s", "cds_e"), "gene_id").join(count, "gene_id").select("gene_id", place.alias("place"), "contig", "strand", "s", "e", "gene_name", "gene_biotype", "tx_id", "cds_s", "cds_e", "n_exons")


@query("s08_gzip_gtf", oracle(" SELECT 'exon' AS feature, count(*) AS n, count(DISTINCT gene_id) AS genes FROM exons UNION ALL SELECT 'CDS', count(*), count(*) FROM genes WHERE gene_ord % 3 <> 0 UNION ALL SELECT unnest(['start_codon', 'stop_codon']), count(*), count(*) FROM genes WHERE gene_ord % 2 = 0"))
def gzip_gtf(spark, d):
    """The same from compressed text."""
    from ..sources import annotation

    rows = annotation.read_gtf(spark, views.as_text(_gtf(Tables(spark, d)), "o", packed=True))
    return rows.groupBy("feature").agg(F.count("*").alias("n"), F.countDistinct("gene_id").alias("genes"))


@query("s02_one_contig", oracle(" SELECT count(*) AS n, CAST(sum(pos) AS BIGINT) AS places, count(*) FILTER (flag & 1024 > 0) AS duplicates FROM reads WHERE tid = 2"))
def one_contig(spark, d):
    """One contig of the table saved by contig: only its folder is read."""
    from ..sources import alignments

    t = Tables(spark, d)
    path = views.new_path(spark)
    if path is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    alignments.save(t.reads.select("rec_ord", "flag", "pos", F.concat(F.lit("chr"), (F.col("tid") + 1).cast("string")).alias("contig")), path)
    return spark.read.parquet(path).where("contig = 'chr3'").agg(F.count("*").alias("n"), F.sum("pos").alias("places"), F.count_if(F.col("flag").bitwiseAND(1024) > 0).alias("duplicates"))


@query("s09_fasta", oracle(f" SELECT contig, CAST(k AS BIGINT) AS chunk_no, md5(seq) AS seq_md5, CAST(len(seq) AS BIGINT) AS n FROM (SELECT contig, k, substr(string_agg({_PIECE.format(k='(k * 32 + j)')}, '' ORDER BY j), 1, CASE WHEN k = 9 THEN 1000 ELSE 1027 END) AS seq FROM (SELECT name AS contig, name AS c, k, j FROM contigs, (SELECT unnest(range(10)) AS k), (SELECT unnest(range(33)) AS j) WHERE tid < 4) GROUP BY contig, k)"))
def fasta_text(spark, d):
    """Chunks of a reference of 10216 bases a contig, from lines of 60 bases."""
    from ..sources import annotation

    t = Tables(spark, d)
    piece = lambda k: F.translate(F.md5(F.concat("name", F.lit(":"), k.cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGN")
    whole = F.substring(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(320)), piece), ""), 1, 9 * 1024 + 1000)
    lines = t.contigs.where("tid < 4").select("tid", F.concat(F.array(F.concat(F.lit(">"), "name", F.lit(" made up"))), F.regexp_extract_all(whole, F.lit(".{1,60}"), F.lit(0))).alias("x")).select("tid", F.posexplode("x").alias("i", "value"))
    got = annotation.read_fasta(spark, views.as_text(lines.withColumn("o", F.col("tid") * 1_000_000 + F.col("i")), "o"), CHUNK, 3)
    return got.select("contig", "chunk_no", F.md5("seq").alias("seq_md5"), F.length("seq").cast("long").alias("n"))


@query("s10_panel_rows", oracle(" SELECT gid AS gene_id, gene_symbol, panel, cell_type, count(*) AS n FROM pn GROUP BY ALL", PANELS))
def panel_rows(spark, d):
    """Marker panels from tab-separated text, with a heading and remarks."""
    from ..sources import annotation

    part = spark.read.parquet(f"{d}/part.parquet")
    text = lambda c: F.col(c).cast("string")
    row = lambda gid: F.concat_ws("\t", gid, "p_name", F.concat(F.lit("panel"), (F.col("p_partkey") % 2).cast("string")), F.concat(F.lit("cell"), (F.col("p_partkey") % 5).cast("string")), F.lit("0.5"))
    own = F.concat(F.lit("G"), text("p_partkey"))
    first = part.where("p_partkey % 11 = 0").select(F.col("p_partkey").alias("o"), row(F.when(F.col("p_partkey") % 3 == 0, own).otherwise("")).alias("value"))
    twice = part.where("p_partkey % 22 = 0").select(F.col("p_partkey").alias("o"), row(own).alias("value"))
    head = spark.createDataFrame([(-2, "# made up"), (-1, "gene_id\tgene_symbol\tpanel\tcell_type\tweight"), (-1, "\tabsent\tpanel0\tghost\t1")], "o long, value string")
    got = annotation.read_panels(spark, views.as_text(first.unionByName(head), "o"), views.as_text(twice.unionByName(head.where("o = -2")), "o"))
    return got.groupBy("gene_id", "gene_symbol", "panel", "cell_type").agg(F.count("*").alias("n"))


@query("s12_bundled_lists", "SELECT * FROM (VALUES ('class', 'apolipoprotein', 22), ('class', 'hemoglobin', 10), ('class', 'ribosomal_protein', 165), ('panel', 'lm22', 33), ('panel', 'tabula_sapiens_cfrna', 26), ('panel', 'vorperian', 23), ('snps', 'common', 12)) v(kind, name, n)")
def bundled_lists(spark, d):
    from ..sources import bundled

    count = lambda df, kind, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return count(bundled.classes(spark), "class", F.col("class")).unionByName(count(bundled.panels(spark), "panel", F.col("panel"))).unionByName(count(bundled.snps(spark), "snps", F.lit("common")))


@query("s11_snp_rows", oracle(" SELECT 'chr' || (tid + 1) AS contig, CAST(site AS BIGINT) AS site, ref, alt, 'rs' || site AS rsid FROM sn", SNPS))
def snp_rows(spark, d):
    """Sites from tab-separated text."""
    from ..sources import annotation

    part = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 4 = 1")
    letter = lambda s: F.lower(F.substring(F.lit(s), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1)))
    site = (F.col("p_partkey") * 23) % 4900000 + 17
    value = F.concat_ws("\t", F.concat(F.lit("chr"), (F.col("p_partkey") % 5 + 1).cast("string")), (site + 1).cast("string"), letter("ACGT"), letter("CGTA"), F.concat(F.lit("rs"), site.cast("string")))
    lines = part.select(F.col("p_partkey").alias("o"), value.alias("value")).unionByName(spark.createDataFrame([(-1, "#chrom"), (-1, "chrom\tpos\tref\talt")], "o long, value string"))
    return annotation.read_snps(spark, views.as_text(lines, "o"))


@query("s12_symbol_rows", oracle(" SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS class, p_name AS symbol FROM part WHERE p_partkey % 7 = 0"))
def symbol_rows(spark, d):
    """Lists of one symbol a line."""
    from ..sources import annotation

    part = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 7 = 0")
    paths = {name: views.as_text(part.where(F.col("p_partkey") % 2 == k).select(F.col("p_partkey").alias("o"), F.concat(F.lit(" "), "p_name").alias("value")), "o") for k, name in enumerate(("even", "odd"))}
    return annotation.read_symbols(spark, **paths)


# More SQL: reports whose oracle needs several steps.
SQL["a18_strandedness"] = oracle(
    """, kc AS (SELECT CASE WHEN flag & 1 = 0 THEN '' WHEN flag & 64 > 0 THEN '1' ELSE '2' END || CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END || k AS key, count(*) AS n FROM sp GROUP BY 1),
  fr2 AS (SELECT sum(CASE WHEN key IN ('1++', '1--', '2+-', '2-+', '++', '--') THEN n ELSE 0 END) / sum(n) AS f, sum(CASE WHEN key IN ('1+-', '1-+', '2++', '2--', '+-', '-+') THEN n ELSE 0 END) / sum(n) AS r, CAST(sum(n) AS BIGINT) AS total FROM kc)
  SELECT round(f, 6) AS forward, round(r, 6) AS reverse, total, round(1.0 - f - r, 6) AS failed, CASE WHEN f > 0.75 THEN 'forward' WHEN r > 0.75 THEN 'reverse' WHEN f < 0.75 AND r < 0.75 THEN 'unstranded' ELSE 'undetermined' END AS strandedness FROM fr2""",
    STRANDS,
)
_TX = """tx AS (SELECT gene_id, tid, strand, s, e, CASE WHEN gene_ord % 3 <> 0 THEN s + 7 ELSE s END AS cs, CASE WHEN gene_ord % 3 <> 0 THEN s + (e - s) // 2 + 7 ELSE e END AS ce FROM genes),
ex AS (SELECT mx.tid, mx.strand, mx.s, mx.e, cs, ce FROM mx JOIN tx USING (gene_id)),
raw_sets AS (
  SELECT 'cds_exon' AS region, tid, greatest(s, cs) AS s, least(e, ce) AS e FROM ex
  UNION ALL SELECT CASE strand WHEN '+' THEN 'utr_5' ELSE 'utr_3' END, tid, s, least(e, cs) FROM ex
  UNION ALL SELECT CASE strand WHEN '+' THEN 'utr_3' ELSE 'utr_5' END, tid, greatest(s, ce), e FROM ex
  UNION ALL SELECT 'intron', tid, e, nx FROM (SELECT tid, e, lead(s) OVER (PARTITION BY gene_id ORDER BY s) AS nx FROM mx)
  UNION ALL SELECT 'tss_up_' || k || 'kb', tid, CASE strand WHEN '-' THEN e ELSE greatest(0, s - k * 1000) END, CASE strand WHEN '-' THEN e + k * 1000 ELSE s END FROM tx, (VALUES (1), (5), (10)) v(k)
  UNION ALL SELECT 'tes_down_' || k || 'kb', tid, CASE strand WHEN '-' THEN greatest(0, s - k * 1000) ELSE e END, CASE strand WHEN '-' THEN s ELSE e + k * 1000 END FROM tx, (VALUES (1), (5), (10)) v(k)),
pb AS (SELECT DISTINCT region, tid, unnest(range(s, e)) AS p FROM raw_sets WHERE s < e),
rank_of AS (SELECT *, CASE region WHEN 'cds_exon' THEN 1 WHEN 'utr_5' THEN 2 WHEN 'utr_3' THEN 2 WHEN 'intron' THEN 3 ELSE 4 END AS k FROM pb),
best AS (SELECT tid, p, min(k) AS k FROM rank_of GROUP BY tid, p),
own AS (SELECT region, tid, p FROM rank_of JOIN best USING (tid, p, k)),"""
# a midpoint lies strictly inside a merged set if its base and the one before are both in the set
SQL["a20_read_distribution"] = oracle(
    """ , mid AS (SELECT rec_ord, bs, tid, (2 * pos + bs + be) // 2 AS p FROM reads JOIN xs USING (ln) WHERE flag & 1796 = 0),
  hit AS (SELECT rec_ord, bs, list(region) AS rs FROM mid JOIN own o USING (tid, p) JOIN (SELECT region, tid, p + 1 AS p FROM own) o2 USING (region, tid, p) GROUP BY rec_ord, bs),
  kind AS (SELECT CASE WHEN rs IS NULL THEN 'unassigned' WHEN list_contains(rs, 'cds_exon') THEN 'cds_exon' WHEN list_contains(rs, 'utr_5') AND list_contains(rs, 'utr_3') THEN 'unassigned' WHEN list_contains(rs, 'utr_5') THEN 'utr_5' WHEN list_contains(rs, 'utr_3') THEN 'utr_3'
    WHEN list_contains(rs, 'intron') THEN 'intron' WHEN list_contains(rs, 'tss_up_10kb') AND list_contains(rs, 'tes_down_10kb') THEN 'unassigned' WHEN list_contains(rs, 'tss_up_1kb') THEN 'tss_up_1kb' WHEN list_contains(rs, 'tss_up_5kb') THEN 'tss_up_5kb' WHEN list_contains(rs, 'tss_up_10kb') THEN 'tss_up_10kb'
    WHEN list_contains(rs, 'tes_down_1kb') THEN 'tes_down_1kb' WHEN list_contains(rs, 'tes_down_5kb') THEN 'tes_down_5kb' WHEN list_contains(rs, 'tes_down_10kb') THEN 'tes_down_10kb' ELSE 'unassigned' END AS region FROM mid LEFT JOIN hit USING (rec_ord, bs)),
  tags AS (SELECT region, count(*) AS n FROM kind GROUP BY region),
  wide AS (SELECT a.region, CAST(sum(n) AS BIGINT) AS n FROM (VALUES ('cds_exon', 'cds_exon'), ('utr_5', 'utr_5'), ('utr_3', 'utr_3'), ('intron', 'intron'), ('tss_up_1kb', 'tss_up_1kb'), ('tss_up_5kb', 'tss_up_1kb'), ('tss_up_5kb', 'tss_up_5kb'), ('tss_up_10kb', 'tss_up_1kb'), ('tss_up_10kb', 'tss_up_5kb'), ('tss_up_10kb', 'tss_up_10kb'),
    ('tes_down_1kb', 'tes_down_1kb'), ('tes_down_5kb', 'tes_down_1kb'), ('tes_down_5kb', 'tes_down_5kb'), ('tes_down_10kb', 'tes_down_1kb'), ('tes_down_10kb', 'tes_down_5kb'), ('tes_down_10kb', 'tes_down_10kb')) a(region, part) JOIN tags ON tags.region = a.part GROUP BY a.region)
  SELECT region, count(*) AS total_bases, coalesce(any_value(n), 0) AS tags, round(coalesce(any_value(n), 0) * 1000.0 / (count(*) + 1), 6) AS tags_per_kb FROM own LEFT JOIN wide USING (region) GROUP BY region""",
    MERGED,
    _TX.rstrip(","),
    "xs(ln, bs, be) AS (VALUES (1, 0, 50), (2, 0, 20), (2, 120, 150), (3, 5, 50), (4, 0, 25), (4, 25, 48), (5, 0, 25), (5, 28, 53), (6, 0, 10), (6, 210, 220), (6, 270, 300), (7, 0, 45))",
)
_LENGTHS = f"""fb AS (SELECT gene_id, {", ".join(f"count(*) FILTER (tlen >= {a} AND tlen < {b}) AS tlen_bin_{n}" for n, a, b in zip(kmers.TLEN_BINS, kmers.TLEN_EDGES, [*kmers.TLEN_EDGES[1:], 1001], strict=True))},
  count(*) FILTER (tlen > 1000) AS tlen_overflow, count(*) FILTER (tlen <= 1000) AS tlen_count, round(avg(tlen) FILTER (tlen <= 1000), 6) AS tlen_mean, min(tlen) FILTER (tlen <= 1000) AS tlen_min, max(tlen) FILTER (tlen <= 1000) AS tlen_max,
  CAST(quantile_disc(CASE {" ".join(f"WHEN tlen < {b} THEN {m}" for b, m in zip([*kmers.TLEN_EDGES[1:], 1001], kmers.TLEN_MIDPOINTS, strict=True))} ELSE 1001 END, 0.5) AS DOUBLE) AS tlen_median_approx
  FROM (SELECT * REPLACE (CASE WHEN CAST(qname AS BIGINT) % 5 = 0 THEN tlen * 4 ELSE tlen END AS tlen) FROM o1) WHERE flag & 3855 = 3 AND tid = mtid AND tlen > 0 AND both_in GROUP BY gene_id)"""
SQL["a42_fragment_bins"] = oracle(" SELECT * FROM fb", ONE, _LENGTHS, blocks=True)
_NAMES = [*(f"tlen_bin_{b}" for b in kmers.TLEN_BINS), "tlen_overflow", "tlen_count"]
_GENE_MOTIFS = f"""gm AS (SELECT gene_id, CASE WHEN tid < 4 AND pos // 1024 <= 487 THEN {_AT("pos")} END AS p5, CASE WHEN tid < 4 AND (pos + tlen - 4) // 1024 <= 487 THEN {_AT("pos + tlen - 4")} END AS p3, tlen FROM (SELECT * REPLACE (CASE WHEN CAST(qname AS BIGINT) % 5 = 0 THEN tlen * 4 ELSE tlen END AS tlen), 'chr' || CAST(tid + 1 AS VARCHAR) AS c FROM o1 WHERE both_in AND flag & 3855 = 3 AND tid = mtid AND tlen > 0)),
gk AS (SELECT *, CASE WHEN p5 IS NULL OR p3 IS NULL OR tlen < 4 THEN 'skipped_oob' WHEN p5 LIKE '%N%' OR p3 LIKE '%N%' THEN 'skipped_non_acgt' ELSE 'used' END AS kind FROM gm),
gp AS (SELECT gene_id, count(*) FILTER (kind = 'used') AS em_pair_count_used, count(*) FILTER (kind = 'skipped_non_acgt') AS em_pair_count_skipped_non_acgt, count(*) FILTER (kind = 'skipped_oob') AS em_pair_count_skipped_oob FROM gk GROUP BY gene_id),
gr2 AS (SELECT gene_id, kmer, count(*) FILTER (e5) AS n5, count(*) FILTER (NOT e5) AS n3 FROM (SELECT gene_id, p5 AS kmer, true AS e5 FROM gk WHERE kind = 'used' UNION ALL SELECT gene_id, translate(reverse(p3), 'ACGT', 'TGCA'), false FROM gk WHERE kind = 'used') GROUP BY gene_id, kmer),
gs2 AS (SELECT *, n5 / sum(n5) OVER (PARTITION BY gene_id) AS p, n3 / sum(n3) OVER (PARTITION BY gene_id) AS q FROM gr2),
ge AS (SELECT gene_id, coalesce(string_agg(kmer || ':' || n5, ',' ORDER BY kmer) FILTER (n5 > 0), '') AS em_5p, coalesce(string_agg(kmer || ':' || n3, ',' ORDER BY kmer) FILTER (n3 > 0), '') AS em_3p, sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) AS em_shannon_5p, sum(CASE WHEN q > 0 THEN -q * log2(q) ELSE 0 END) AS em_shannon_3p,
  greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS em_jsd_5p_3p FROM gs2 GROUP BY gene_id)"""
SQL["a39_per_gene_table"] = (
    f"""SELECT gene_id, gene_ord, tid, strand, symbol, biotype, s, e, effective_length, fragment_count_assigned, primary_reads_unique, primary_reads_unique_nodup, primary_reads_multi, primary_reads, primary_reads_with_5p_clip, primary_reads_with_3p_clip, soft_clip_rate_5p, soft_clip_rate_3p,
  {", ".join(f"coalesce({n}, 0) AS {n}" for n in _NAMES)}, tlen_mean, tlen_min, tlen_max, exon_aligned_bp, intron_aligned_bp, cds_aligned_bp, utr_aligned_bp, decile_coverage, tlen_median_approx, cds_utr_ratio, intron_retention_rate, coalesce(fc_reads, 0) AS fc_reads,
  coalesce(em_pair_count_used, 0) AS em_pair_count_used, coalesce(em_pair_count_skipped_non_acgt, 0) AS em_pair_count_skipped_non_acgt, coalesce(em_pair_count_skipped_oob, 0) AS em_pair_count_skipped_oob, em_5p, em_3p, round(em_shannon_5p, 6) AS em_shannon_5p, round(em_shannon_3p, 6) AS em_shannon_3p, round(em_jsd_5p_3p, 6) AS em_jsd_5p_3p
  FROM ({oracle(" SELECT gene_id, gene_ord, tid, strand, symbol, biotype, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CAST(eff_len AS BIGINT) AS effective_length FROM genes JOIN eff USING (gene_id)")}) JOIN ({SQL["a39_read_counts"]}) USING (gene_id)
  LEFT JOIN ({oracle(" SELECT gene_id, all_multi AS fragment_count_assigned, all_unique AS primary_reads_unique, nodup_unique AS primary_reads_unique_nodup, all_multi - all_unique AS primary_reads_multi FROM gc", FRAGMENTS, blocks=True)}) USING (gene_id)
  LEFT JOIN ({SQL["a42_fragment_bins"]}) USING (gene_id) LEFT JOIN ({SQL["a41_coding_bases"]}) USING (gene_id) LEFT JOIN ({SQL["a02_fc_reads"]}) USING (gene_id)
  LEFT JOIN (SELECT gene_id, array_to_string(list_transform(range(10), lambda k: coalesce(m[k], 0)), ',') AS decile_coverage FROM (SELECT gene_id, map(list(decile), list(n)) AS m FROM ({SQL["a40_deciles"]}) GROUP BY gene_id)) USING (gene_id)
  LEFT JOIN ({oracle(" SELECT * FROM gp LEFT JOIN ge USING (gene_id)", ONE, _GENE_MOTIFS, blocks=True)}) USING (gene_id)
  WHERE primary_reads >= 5"""
)
SQL["a26_read_origin"] = oracle(" SELECT CASE WHEN len(gs) = 1 THEN 'exonic' WHEN len(gs) > 1 THEN 'ambiguous' WHEN i THEN 'intronic' ELSE 'intergenic' END AS origin, CAST(sum(w) AS BIGINT) AS n FROM un2 GROUP BY 1 UNION ALL SELECT 'overlapping_exon', count(*) FROM un2 WHERE t", ORIGIN)
SQL["a26_junction_support"] = oracle(
    """, jr AS (SELECT tid, pos + 1 + q AS p1, pos + 1 + q + n AS p2 FROM ux JOIN (VALUES (2, 20, 100), (6, 10, 200), (6, 20, 50)) v(ln, q, n) USING (ln)), mk AS (SELECT DISTINCT tid, unnest([b - 1, b, b + 1]) AS p FROM (SELECT tid, s AS b FROM gap2 UNION ALL SELECT tid, e + 1 FROM gap2))
  SELECT CASE k WHEN 2 THEN 'known' WHEN 1 THEN 'partly_known' ELSE 'novel' END AS class, count(*) AS n FROM (SELECT CAST((tid, p1) IN (SELECT tid, p FROM mk) AS INTEGER) + CAST((tid, p2) IN (SELECT tid, p FROM mk) AS INTEGER) AS k FROM jr) GROUP BY 1""",
    ORIGIN,
)
SQL["a46_sampled_strandedness"] = SQL["a18_strandedness"].replace("FROM reads WHERE flag & 1796 = 0 AND mapq >= 30", "FROM (SELECT * FROM reads ORDER BY rec_ord LIMIT 3000) WHERE flag & 1796 = 0 AND mapq >= 30")
SQL["j23_strandedness_mismatch"] = f"SELECT given, strandedness AS told, CASE WHEN strandedness NOT IN ('undetermined', given) THEN strandedness END AS better FROM ({SQL['a18_strandedness']}), (VALUES ('forward'), ('reverse'), ('unstranded')) g(given)"
DISTANCE = f"""{MERGED}, me AS (SELECT DISTINCT tid, unnest(range(s, e)) AS p FROM exons),
kp2 AS (SELECT *, pos + CASE ln WHEN 2 THEN 150 WHEN 3 THEN 45 WHEN 6 THEN 300 WHEN 7 THEN 45 ELSE 50 END AS r1e FROM reads WHERE flag & 1805 = 1 AND mapq >= 30 AND ((tid = mtid AND (mpos > pos OR (mpos = pos AND flag & 64 = 0))) OR tid < mtid)),
xs2(ln, bs, be) AS (VALUES (1, 0, 50), (2, 0, 20), (2, 120, 150), (3, 5, 50), (4, 0, 25), (4, 25, 48), (5, 0, 25), (5, 28, 53), (6, 0, 10), (6, 210, 220), (6, 270, 300), (7, 0, 45)),
ins AS (SELECT rec_ord, sum(greatest(0, least(pos + be, r1e) - greatest(pos + bs, mpos))) AS x FROM kp2 JOIN xs2 USING (ln) GROUP BY rec_ord),
lt AS (SELECT * FROM genes WHERE gene_ord NOT IN (SELECT min(gene_ord) FROM genes GROUP BY tid)),
cm AS (SELECT DISTINCT rec_ord FROM kp2 k JOIN lt ON k.tid = k.mtid AND lt.tid = k.tid AND lt.s <= r1e - 1 AND r1e - 1 < lt.e AND lt.s <= mpos AND mpos < lt.e),
exb AS (SELECT rec_ord, count(*) AS x FROM kp2 k JOIN me ON k.tid = k.mtid AND me.tid = k.tid AND r1e <= p AND p < mpos GROUP BY rec_ord),
ds AS (SELECT k.rec_ord, k.tid, k.mtid, CASE WHEN k.tid = mtid THEN CASE WHEN mpos >= r1e THEN mpos - r1e ELSE -ins.x END END AS d, coalesce(exb.x, 0) AS x, cm.rec_ord IS NOT NULL AS c FROM kp2 k JOIN ins USING (rec_ord) LEFT JOIN exb USING (rec_ord) LEFT JOIN cm USING (rec_ord)),
dc AS (SELECT *, CASE WHEN tid <> mtid THEN 'sameChrom=No' WHEN NOT c THEN 'sameTranscript=No,dist=genomic' WHEN d <= 0 THEN 'readPairOverlap' WHEN x = d THEN 'sameTranscript=Yes,sameExon=Yes,dist=mRNA' WHEN x > 0 THEN 'sameTranscript=Yes,sameExon=No,dist=mRNA' ELSE 'sameTranscript=Yes,nonExonic=Yes,dist=genomic' END AS class FROM ds),
dd AS (SELECT class, CASE WHEN class = 'sameTranscript=Yes,sameExon=No,dist=mRNA' THEN x ELSE d END AS distance FROM dc)"""
SQL["a23_inner_distance"] = oracle(" SELECT class, count(*) AS n, CAST(sum(distance) AS BIGINT) AS total FROM dd GROUP BY class", DISTANCE)
SQL["a23_distance_histogram"] = oracle(" SELECT CAST(-250 + (CAST(ceil((distance + 250) / 5) AS BIGINT) - 1) * 5 AS BIGINT) AS lo, count(*) AS n FROM dd WHERE distance > -250 AND distance <= 250 GROUP BY 1", DISTANCE)
_JAT = lambda p: f"substr({_PIECE.format(k=f'({p}) // 32')} || {_PIECE.format(k=f'({p}) // 32 + 1')}, CAST(({p}) % 32 + 1 AS BIGINT), 2)"
SQL["a38_splice_motifs"] = oracle(
    f""", sj AS (SELECT CASE WHEN tid < 4 AND s // 1024 <= 487 AND (e - 2) // 1024 <= 487 THEN {_JAT("s")} || '-' || {_JAT("e - 2")} END AS m FROM (SELECT DISTINCT tid, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, 'chr' || CAST(tid + 1 AS VARCHAR) AS c FROM jn WHERE e - s >= 50))
  SELECT CASE WHEN m IS NULL THEN 'oob' WHEN m IN ('GT-AG', 'CT-AC') THEN 'gt_ag' WHEN m IN ('GC-AG', 'CT-GC') THEN 'gc_ag' WHEN m IN ('AT-AC', 'GT-AT') THEN 'at_ac' ELSE 'other' END AS class, count(*) AS n FROM sj GROUP BY 1""",
    JUNCTIONS,
)
_one_of = lambda name, column, where="true": f"(SELECT {column} FROM ({SQL[name]}) WHERE {where})"
SQL["a43_qc_flags"] = f"""WITH v AS (SELECT {_one_of("a46_first_pass", "is_paired")} AS is_paired, {_one_of("a46_first_pass", "skip_dup_check")} AS skip, f.*, {_one_of("a18_strandedness", "strandedness")} AS strandedness, {_one_of("m01_duplication_fit", "intercept")} AS fit, {_one_of("a03_dup_matrix", "count(*)", "all_counts > 0")} AS genes,
  {_one_of("a05_biotype_counts", "coalesce(sum(n), 0)", "biotype = 'Brand#11'")} AS rrna, {_one_of("a05_biotype_counts", "sum(n)")} AS assigned, {_one_of("a20_read_distribution", "sum(tags)", "region = 'intron'")} AS introns, {_one_of("a20_read_distribution", "sum(tags)", "region IN ('intron', 'cds_exon', 'utr_5', 'utr_3')")} AS tags, {_one_of("a28_fragment_summary", "median")} AS tlen FROM ({SQL["a06_flagstat"]}) f)
  SELECT coalesce(string_agg(flag, ',' ORDER BY flag), '') AS qc_flags FROM (SELECT unnest([CASE WHEN NOT is_paired THEN 'single_end_no_tlen' END, CASE WHEN skip THEN 'duplicates_not_marked' END, CASE WHEN is_paired AND properly_paired / paired < 0.7 THEN 'low_paired_fraction' END, CASE WHEN mapped / total < 0.7 THEN 'low_mapping_rate' END, 'read_length_caps_long_fragments',
  CASE WHEN rrna / assigned > 0.4 THEN 'high_rrna_fraction' END, 'tagmentation_endmotif_bias', CASE WHEN strandedness = 'unstranded' THEN 'unstranded_endbias_unreliable' END, CASE WHEN duplicates / mapped > 0.95 AND assigned < 1000000 THEN 'low_complexity_library' END, CASE WHEN fit > 0.5 AND genes >= 1000 THEN 'high_duplication_nonbiological' END,
  CASE WHEN introns / tags > 0.5 AND tlen > 150 THEN 'cfdna_contamination_suspected' END]) AS flag FROM v) WHERE flag IS NOT NULL"""
