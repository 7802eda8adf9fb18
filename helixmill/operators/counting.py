"""Gene counting and the duplication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar, flags
from . import intervals


def with_genes(reads: DataFrame, exons: DataFrame, library: str = "unstranded", feature: str = "gene_id") -> DataFrame:
    """Reads with `genes`: the sorted distinct genes whose exons its blocks overlap, empty where none. Reads are neither grouped nor joined with themselves."""
    rows = reads.withColumn("__blocks", cigar.aligned_blocks())
    first, last = F.get("__blocks", F.lit(0))["s"], F.get("__blocks", F.size("__blocks") - 1)["e"] - 1
    targets = exons.select("tid", F.col("s").alias("rs"), F.col("e").alias("re"), F.col(feature).alias("g"), "strand")
    placed = intervals.beside(rows, first, last, targets, ["tid"], ["g", "strand"])
    hit = F.filter("near", lambda x: F.exists("__blocks", lambda b: (b.s < x.re) & (x.rs < b.e)) & flags.strand_agrees(library, x.strand))
    return placed.select(*reads.columns, F.array_sort(F.array_distinct(F.transform(hit, lambda x: x.g))).alias("genes"))


def read_genes(reads: DataFrame, exons: DataFrame, library: str = "unstranded") -> DataFrame:
    """rec_ord and genes of the reads with any."""
    return with_genes(reads.select("rec_ord", "tid", "flag", "pos", "cigar"), exons, library).where(F.size("genes") > 0).select("rec_ord", "genes")


def fragments(reads: DataFrame, exons: DataFrame, paired: bool = True, library: str = "unstranded", carry: list[str] | None = None) -> DataFrame:
    """One row for each fragment: genes, is_dup, is_multi and its members' rec_ords (with `carry`: their rec_ords and these columns).

    Mates meet on name, both ends and the hit index; a first and a second read make a pair, whose
    genes are the common ones, or all if none is common. Its status comes from the first read. A
    record without a partner is a fragment of its own; so is each of several first (or second)
    reads of one key, whose order is that of rec_ord.
    """
    used = ["rec_ord", "qname", "tid", "flag", "pos", "cigar", "mtid", "mpos", "nh", *(["hi"] if "hi" in reads.columns else []), *(carry or [])]
    kept = with_genes(reads.where(flags.counted(paired)).select(*dict.fromkeys(used)), exons, library)
    dup, multi = flags.has(flags.DUPLICATE), F.coalesce("nh", F.lit(1)) > 1
    member = F.struct("rec_ord", *carry) if carry else F.col("rec_ord")
    if not paired:
        return kept.select("genes", dup.alias("is_dup"), multi.alias("is_multi"), F.array(member).alias("members"))
    first = flags.has(flags.FIRST)
    mine, mate = F.struct("tid", "pos"), F.struct(F.col("mtid").alias("tid"), F.col("mpos").alias("pos"))
    hi = F.coalesce("hi", F.lit(-1)) if "hi" in reads.columns else F.lit(-1)
    keyed = kept.select("qname", F.when(first, mine).otherwise(mate).alias("a"), F.when(first, mate).otherwise(mine).alias("b"), hi.alias("hi"), F.struct(F.when(first, 0).otherwise(1).alias("side"), "rec_ord", "genes", dup.alias("is_dup"), multi.alias("is_multi"), member.alias("member")).alias("r"))
    groups = keyed.groupBy("qname", "a", "b", "hi").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    side = lambda n: F.filter("rs", lambda r: r.side == n)
    paired_up = F.zip_with(side(0), side(1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))  # nth first read with nth second read
    each = groups.select(F.explode(paired_up).alias("p"))
    x, y = F.col("p.x"), F.col("p.y")
    common = F.array_intersect(x.genes, y.genes)
    genes = F.when(x.isNull(), y.genes).when(y.isNull(), x.genes).when(F.size(common) > 0, common).otherwise(F.array_union(x.genes, y.genes))
    return each.select(genes.alias("genes"), F.coalesce(x.is_dup, y.is_dup).alias("is_dup"), F.coalesce(x.is_multi, y.is_multi).alias("is_multi"), F.array_compact(F.array(x.member, y.member)).alias("members"))


def tallied(frags: DataFrame) -> DataFrame:
    """Fragments of each gene in four modes, and all `fragments`; those of no gene or several under null."""
    one = frags.select(F.when(F.size("genes") == 1, F.col("genes")[0]).alias("gene_id"), "is_dup", "is_multi")
    return one.groupBy("gene_id").agg(
        F.count("*").alias("all_multi"),
        F.count_if(~F.col("is_dup")).alias("nodup_multi"),
        F.count_if(~F.col("is_multi")).alias("all_unique"),
        F.count_if(~F.col("is_dup") & ~F.col("is_multi")).alias("nodup_unique"),
    )


def gene_counts(frags: DataFrame) -> DataFrame:
    """Fragments of exactly one gene in four modes."""
    return tallied(frags).where("gene_id is not null")


def read_status(reads: DataFrame, exons: DataFrame, paired: bool = False, library: str = "unstranded") -> DataFrame:
    """Each counted record's status and, if assigned, its gene."""
    kept = with_genes(reads.where(flags.counted(paired)).select("rec_ord", "qname", "tid", "flag", "pos", "cigar", "nh"), exons, library)
    n = F.size("genes")
    status = F.when(F.coalesce("nh", F.lit(1)) > 1, "MultiMapping").when(n == 0, "NoFeatures").when(n == 1, "Assigned").otherwise("Ambiguity")
    return kept.select("rec_ord", "qname", "genes", status.alias("status")).withColumn("gene_id", F.when(F.col("status") == "Assigned", F.col("genes")[0]))


def status_counts(status: DataFrame, reads: DataFrame) -> DataFrame:
    """The assignment summary; singleton and chimera are never counted."""
    own = status.groupBy("status").agg(F.count("*").alias("n"))
    unmapped = reads.where(flags.has(flags.UNMAPPED)).agg(F.count("*").alias("n")).select(F.lit("Unmapped").alias("status"), "n")
    fixed = own.sparkSession.createDataFrame([("Singleton", 0), ("Chimera", 0)], "status string, n long")
    return own.unionByName(unmapped).unionByName(fixed)


def total_mapped(reads: DataFrame, frags: DataFrame) -> DataFrame:
    """N of RPKM: fragments, and unmapped records whose mate is mapped."""
    return mapped_total(reads, tallied(frags))  # the table of gene_counts: one pass over the fragments serves both


def mapped_total(reads: DataFrame, tallies: DataFrame) -> DataFrame:
    """total_mapped from the output of tallied."""
    lone = reads.where(flags.has(flags.UNMAPPED) & flags.has(flags.PAIRED) & ~flags.has(flags.MATE_UNMAPPED) & flags.primary()).agg(F.count("*").alias("u"))
    return tallies.agg(F.coalesce(F.sum("all_multi"), F.lit(0)).alias("f")).crossJoin(lone).select((F.col("f") + F.col("u")).alias("n_mapped"))  # one row each


def dup_matrix(genes: DataFrame, lengths: DataFrame, counts: DataFrame, n_mapped: DataFrame) -> DataFrame:
    """All genes of positive length, with rates and RPK and RPKM in both modes; an undefined rate is null."""
    both = genes.select("gene_id", "gene_ord").join(lengths.where("eff_len > 0"), "gene_id").join(counts, "gene_id", "left").crossJoin(F.broadcast(n_mapped))  # n_mapped is one row
    c = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    out = [F.col("gene_id"), F.col("gene_ord"), F.col("eff_len").alias("gene_length")]
    for mode, a, f in (("_multi", "all_multi", "nodup_multi"), ("", "all_unique", "nodup_unique")):
        rpk = c(a) * 1000.0 / F.col("eff_len")
        out += [
            c(a).alias(f"all_counts{mode}"),
            c(f).alias(f"filtered_counts{mode}"),
            F.when(c(a) > 0, (c(a) - c(f)) / c(a)).alias(f"dup_rate{mode}"),
            (c(a) - c(f)).alias(f"dups_per_id{mode}"),
            rpk.alias(f"rpk{mode}"),
            F.when(F.col("n_mapped") > 0, rpk * 1e6 / F.col("n_mapped")).otherwise(0.0).alias(f"rpkm{mode}"),
        ]
    return both.select(*out)


def dup_stats(matrix: DataFrame) -> DataFrame:
    """Genes, covered genes, and genes with duplication (those without a rate count as such)."""
    return matrix.agg(
        F.count("*").alias("n_regions"),
        F.count_if(F.col("all_counts") > 0).alias("n_covered"),
        F.count_if(F.col("dup_rate").isNull() | (F.col("dup_rate") > 0)).alias("n_with_dups"),
    ).select("*", (F.col("n_covered") / F.col("n_regions")).alias("f_covered"), (F.col("n_with_dups") / F.col("n_regions")).alias("f_dups"), (F.col("n_with_dups") / F.col("n_covered")).alias("f_dups_covered"))


def fit_duplication(matrix: DataFrame, most_iterations: int = 25) -> dict[str, float]:
    """Logistic fit of dup_rate on log10(rpk) by reweighted least squares; one row a gene reaches the driver."""
    rows = matrix.where("dup_rate is not null and rpk > 0").select("rpk", "dup_rate").toPandas()
    x, y = np.log10(rows.rpk.to_numpy(float)), rows.dup_rate.to_numpy(float)
    design = np.stack([np.ones_like(x), x], axis=1)
    mu = np.clip((y + 0.5) / 2, 1e-10, 1 - 1e-10)
    eta = np.log(mu / (1 - mu))

    def deviance(m: np.ndarray) -> float:
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = np.where(y > 0, y * np.log(y / m), 0.0), np.where(y < 1, (1 - y) * np.log((1 - y) / (1 - m)), 0.0)
        return float(2 * (a + b).sum())

    old = deviance(mu)
    beta = np.zeros(2)
    for _ in range(most_iterations):
        w = mu * (1 - mu)
        z = eta + (y - mu) / w
        beta = np.linalg.solve(design.T @ (design * w[:, None]), design.T @ (w * z))
        eta = design @ beta
        mu = np.clip(1 / (1 + np.exp(-eta)), 1e-10, 1 - 1e-10)
        new = deviance(mu)
        if abs(new - old) / (abs(new) + 0.1) < 1e-8:
            break
        old = new
    return {"beta0": float(beta[0]), "beta1": float(beta[1]), "intercept": float(np.exp(beta[0])), "slope": float(np.exp(beta[1]))}


def dup_boxes(matrix: DataFrame, n: int = 20) -> DataFrame:
    """Duplication rates in n bins of RPK quantiles of all genes, each from its lower quantile up to below the next, the last with its upper one: genes, mean RPK, genes with a rate, and quartiles of the rates. A gene may lie in no bin or, in the last, beside it."""
    cuts = matrix.agg(F.percentile("rpk", F.array(*[F.lit(k / n) for k in range(n + 1)])).alias("q"))
    bins = F.array(*[F.struct(F.lit(k).alias("bin"), F.col("q")[k].alias("lo"), F.col("q")[k + 1].alias("hi")) for k in range(n)])
    inside = (F.col("rpk") >= F.col("b.lo")) & ((F.col("rpk") < F.col("b.hi")) | ((F.col("b.bin") == n - 1) & (F.col("rpk") <= F.col("b.hi"))))
    dealt = matrix.select("rpk", "dup_rate").crossJoin(F.broadcast(cuts)).select("rpk", "dup_rate", F.explode(bins).alias("b")).where(inside)  # one row of quantiles
    quartile = lambda p: F.percentile("dup_rate", F.lit(p))
    return dealt.groupBy("b.bin").agg(F.count("*").alias("genes"), F.avg("rpk").alias("mean_rpk"), F.count("dup_rate").alias("rated"), quartile(0.25).alias("q1"), quartile(0.5).alias("median"), quartile(0.75).alias("q3"))


def rpkm_threshold(matrix: DataFrame, rpkm: float = 0.5) -> DataFrame:
    """M02."""
    return matrix.agg(F.min(F.when(F.col("rpkm") >= rpkm, F.col("rpk"))).alias("rpk_threshold"))


def biotype_status(reads: DataFrame, exons: DataFrame, paired: bool = False, library: str = "unstranded") -> DataFrame:
    """As A02 with biotypes as features; each gene without one is a feature of its own."""
    kinds = exons.withColumn("kind", F.coalesce("biotype", F.concat(F.lit("gene:"), "gene_id")))
    kept = with_genes(reads.where(flags.counted(paired)).select("rec_ord", "tid", "flag", "pos", "cigar", "nh"), kinds, library, "kind")
    n = F.size("genes")
    status = F.when(F.coalesce("nh", F.lit(1)) > 1, "MultiMapping").when(n == 0, "NoFeatures").when(n == 1, "Assigned").otherwise("Ambiguity")
    return kept.select("rec_ord", status.alias("status"), F.when(status == "Assigned", F.col("genes")[0]).alias("biotype"))


def biotype_counts(status: DataFrame) -> DataFrame:
    return status.where("biotype is not null and biotype not like 'gene:%'").groupBy("biotype").agg(F.count("*").alias("n"))


def check_duplicates_marked(reads: DataFrame) -> None:
    """P19."""
    if not reads.where(flags.has(flags.DUPLICATE)).take(1):
        raise ValueError("no record is marked as a duplicate; mark duplicates first, or skip this check")


def check_contigs(reads: DataFrame, counts: DataFrame) -> None:
    """P20."""
    if not counts.take(1) and reads.where(~flags.has(flags.UNMAPPED)).take(1):
        raise ValueError("records are mapped, but no gene has any: do the contig names of alignments and annotation agree?")
