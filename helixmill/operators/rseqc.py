"""Strand, position, junction and transcript-integrity reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar, flags
from . import intervals


def strand_classes(reads: DataFrame, transcripts: DataFrame, min_mapq: int = 30) -> DataFrame:
    """Records by key: mate (if paired), own strand, and the strands of transcripts they overlap in start order."""
    kept = reads.where(flags.standard(min_mapq)).select("flag", "tid", F.col("pos").alias("s"), (F.col("pos") + cigar.query_length()).alias("e"))
    targets = transcripts.where("strand in ('+', '-')").select("tid", F.col("s").alias("rs"), F.col("e").alias("re"), "strand")
    near = intervals.beside(kept, F.col("s"), F.col("e") - 1, targets, ["tid"], ["strand"], levels=intervals.LONG_LEVELS)
    hit = F.array_sort(F.array_distinct(F.filter("near", lambda x: (F.col("s") < x.re) & (x.rs < F.col("e")))))
    seen = F.array_join(F.array_distinct(F.transform(hit, lambda x: x.strand)), ":")
    mate = F.when(flags.has(flags.PAIRED), F.when(flags.has(flags.FIRST), "1").otherwise("2")).otherwise("")
    key = F.concat(mate, F.when(flags.has(flags.REVERSE), "-").otherwise("+"), F.col("seen"))
    return near.withColumn("seen", seen).where("seen <> ''").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


# The keys of the two protocols, for pairs and single reads.
FORWARD_KEYS, REVERSE_KEYS = ["1++", "1--", "2+-", "2-+", "++", "--"], ["1+-", "1-+", "2++", "2--", "+-", "-+"]


def infer_strandedness(classes: DataFrame, threshold: float = 0.75) -> DataFrame:
    p = lambda keys: F.coalesce(F.sum(F.when(F.col("key").isin(keys), F.col("n"))), F.lit(0)) / F.sum("n")
    out = classes.agg(p(FORWARD_KEYS).alias("forward"), p(REVERSE_KEYS).alias("reverse"), F.sum("n").alias("total"))
    kind = F.when(F.col("forward") > threshold, "forward").when(F.col("reverse") > threshold, "reverse").when((F.col("forward") < threshold) & (F.col("reverse") < threshold), "unstranded").otherwise("undetermined")
    return out.withColumn("failed", 1.0 - F.col("forward") - F.col("reverse")).withColumn("strandedness", kind)


def strandedness_mismatch(inferred: str, given: str) -> str | None:
    """The library that the reads tell, where it is told and is not the given one."""
    return None if inferred in ("undetermined", given) else inferred


def duplication(reads: DataFrame, by: str = "position", min_mapq: int = 30) -> DataFrame:
    """How many keys occur how often, by position (contig, start, blocks) or by sequence."""
    kept = reads.where(flags.duplication_filter(min_mapq))
    blocks = F.transform(cigar.position_blocks(), lambda b: F.struct(b.s.alias("s"), b.e.alias("e")))
    keys = [F.upper("seq").alias("k")] if by == "sequence" else [F.col("tid"), F.col("pos"), blocks.alias("k")]
    per = kept.groupBy(*keys).agg(F.count("*").alias("occurrence"))
    return per.groupBy("occurrence").agg(F.count("*").alias("n_keys"))


FLANKS = [1000, 5000, 10000]


def regions(transcripts: DataFrame, tx_exons: DataFrame) -> DataFrame:
    """A.2: the ten region sets, merged and subtracted. transcripts: tx_id, tid, s, e, strand, cds_s, cds_e; tx_exons: tx_id, tid, s, e.

    All sets' edges are swept once: between two edges each set is there or not, and the priorities decide.
    """
    tx = transcripts.select("tx_id", "tid", "strand", F.col("s").alias("ts"), F.col("e").alias("te"), F.coalesce("cds_s", "s").alias("cs"), F.coalesce("cds_e", "e").alias("ce"))
    ex = tx_exons.select("tx_id", "s", "e").join(tx, "tx_id")
    plus, minus = F.col("strand") == "+", F.col("strand") == "-"
    part = lambda name, s, e: F.struct(name.alias("region"), s.cast("long").alias("s"), e.cast("long").alias("e"))
    before = F.when(plus, "utr_5").when(minus, "utr_3")
    after = F.when(plus, "utr_3").when(minus, "utr_5")
    exonic = F.array(part(F.lit("cds_exon"), F.greatest("s", "cs"), F.least("e", "ce")), part(before, F.col("s"), F.least("e", "cs")), part(after, F.greatest("s", "ce"), F.col("e")))
    flanks = []
    for k in FLANKS:
        low, high = (F.greatest(F.lit(0), F.col("ts") - k), F.col("ts")), (F.col("te"), F.col("te") + k)
        for name, first, second in ((f"tss_up_{k // 1000}kb", high, low), (f"tes_down_{k // 1000}kb", low, high)):
            flanks.append(part(F.lit(name), *(F.when(minus, x).otherwise(y) for x, y in zip(first, second, strict=True))))
    intron = intervals.gaps(tx_exons.select("tx_id", "tid", "s", "e"), ["tx_id"], ["tid"]).select("tid", F.lit("intron").alias("region"), "s", "e")
    rows = ex.select("tid", F.inline(exonic)).unionByName(tx.select("tid", F.inline(F.array(*flanks)))).unionByName(intron).where("s < e and region is not null")
    names = ["cds_exon", "utr_5", "utr_3", "intron", *(f"{n}_{k // 1000}kb" for k in FLANKS for n in ("tss_up", "tes_down"))]
    edges = rows.select("tid", "region", F.explode(F.array(F.struct(F.col("s").alias("p"), F.lit(1).alias("d")), F.struct(F.col("e").alias("p"), F.lit(-1).alias("d")))).alias("x"))
    steps = edges.groupBy("tid", F.col("x.p").alias("p")).agg(*[F.sum(F.when(F.col("region") == n, F.col("x.d")).otherwise(0)).alias(n) for n in names])
    w = Window.partitionBy("tid").orderBy("p")  # edges of the annotation
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    here = steps.select("tid", F.col("p").alias("s"), F.lead("p").over(w).alias("e"), *[(F.sum(n).over(run) > 0).alias(n) for n in names]).where("e is not null")
    c = F.col
    exon = c("cds_exon") | c("utr_5") | c("utr_3")
    rule = {"cds_exon": c("cds_exon"), "utr_5": c("utr_5") & ~c("cds_exon"), "utr_3": c("utr_3") & ~c("cds_exon"), "intron": c("intron") & ~exon} | {n: c(n) & ~exon & ~c("intron") for n in names[4:]}
    found = here.select("tid", "s", "e", F.explode(F.array_compact(F.array(*[F.when(cond, n) for n, cond in rule.items()]))).alias("region"))
    return intervals.merge(found, ["region", "tid"])


def region_tags(reads: DataFrame, region_sets: DataFrame) -> DataFrame:
    """Exon blocks by the region that strictly holds their midpoint; flank counts include the nearer ones."""
    mids = F.transform(cigar.exon_blocks(), lambda b: F.floor((b.s + b.e) / 2))
    kept = reads.where(flags.standard(None)).select("tid", mids.alias("mids")).where(F.size("mids") > 0)
    targets = region_sets.select("tid", "region", F.col("s").alias("rs"), F.col("e").alias("re"))
    near = intervals.beside(kept, F.array_min("mids"), F.array_max("mids"), targets, ["tid"], ["region"])
    held = F.transform("mids", lambda p: F.transform(F.filter("near", lambda x: (x.rs < p) & (p < x.re)), lambda x: x.region))
    per = near.select(F.explode(held).alias("r"))
    on = lambda n: F.array_contains("r", n)
    tss, tes = [f"tss_up_{k // 1000}kb" for k in FLANKS], [f"tes_down_{k // 1000}kb" for k in FLANKS]
    up, down = on(tss[-1]), on(tes[-1])
    kind = F.when(on("cds_exon"), "cds_exon").when(on("utr_5") & on("utr_3"), "unassigned").when(on("utr_5"), "utr_5").when(on("utr_3"), "utr_3").when(on("intron"), "intron").when(up & down, "unassigned")
    for names in (tss, tes):
        for n in names:
            kind = kind.when(on(n), n)
    found = per.select(kind.otherwise("unassigned").alias("region")).groupBy("region").agg(F.count("*").alias("n"))
    wider = reduce(lambda c, x: c.when(F.col("region") == x[0], F.array(*map(F.lit, x[1]))), [(n, names[k:]) for names in (tss, tes) for k, n in enumerate(names)], F.when(F.lit(False), F.array(F.lit(""))))
    return found.select(F.explode(wider.otherwise(F.array("region"))).alias("region"), "n").groupBy("region").agg(F.sum("n").alias("tags"))


def region_report(tags: DataFrame, region_sets: DataFrame) -> DataFrame:
    bases = region_sets.groupBy("region").agg(F.sum(F.col("e") - F.col("s")).alias("total_bases"))
    return bases.join(tags, "region", "left").select("region", "total_bases", F.coalesce("tags", F.lit(0).cast("long")).alias("tags"), (F.coalesce("tags", F.lit(0)) * 1000.0 / (F.col("total_bases") + 1)).alias("tags_per_kb"))


def splice_events(reads: DataFrame, min_mapq: int = 30) -> DataFrame:
    """Every intron of every kept record: rec_ord, nth, tid, s, e."""
    return reads.where(flags.standard(min_mapq)).select("rec_ord", "tid", F.posexplode(cigar.introns()).alias("nth", "b")).select("rec_ord", "nth", "tid", F.col("b.s").alias("s"), F.col("b.e").alias("e"))


def junctions(events: DataFrame, known: DataFrame, min_intron: int = 50) -> DataFrame:
    """Distinct junctions with class, events and first record; known: tid, s, e of annotated introns."""
    per = events.where(F.col("e") - F.col("s") >= min_intron).groupBy("tid", "s", "e").agg(F.count("*").alias("events"), F.min(F.struct("rec_ord", "nth")).alias("first"))
    starts, ends = known.select("tid", "s").distinct().withColumn("ks", F.lit(True)), known.select("tid", "e").distinct().withColumn("ke", F.lit(True))
    a, b = F.coalesce("ks", F.lit(False)), F.coalesce("ke", F.lit(False))
    kind = F.when(a & b, "known").when(a | b, "partial_novel").otherwise("complete_novel")
    return per.join(starts, ["tid", "s"], "left").join(ends, ["tid", "e"], "left").select("tid", "s", "e", "events", kind.alias("class"), F.col("first.rec_ord").alias("first_rec"), F.col("first.nth").alias("first_nth"))


def junction_summary(found: DataFrame, events: DataFrame, min_intron: int = 50) -> DataFrame:
    per = found.groupBy("class").agg(F.count("*").alias("n_junctions"), F.sum("events").alias("n_events"))
    short = events.where(F.col("e") - F.col("s") < min_intron).agg(F.count("*").alias("n_events")).select(F.lit("filtered").alias("class"), F.lit(0).cast("long").alias("n_junctions"), "n_events")
    return per.unionByName(short)


def junction_saturation(events: DataFrame, known: DataFrame, min_intron: int = 50, min_coverage: int = 1, floor: int = 5, ceiling: int = 100, step: int = 5, seed: int = 42) -> DataFrame:
    """Known, novel and all junctions in prefixes of a seeded order of observations.

    An observation's place is its hash's rank; it is found from counts of 2^16 hash ranges, so no
    task sorts all of them. A junction is seen at its first place, a known one at its
    min_coverage-th: a least place, or of each task only the min_coverage least of a junction travel.
    """
    name = F.md5(F.concat_ws(":", F.col("rec_ord").cast("string"), F.col("nth").cast("string"), F.lit(str(seed))))
    marked = events.where(F.col("e") - F.col("s") >= min_intron).withColumn("h", name).withColumn("range", F.substring("h", 1, 4))
    sizes = marked.groupBy("range").agg(F.count("*").alias("n"))
    w = Window.orderBy("range")  # at most 2^16 rows
    before = sizes.select("range", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("h", "rec_ord", "nth"))
    placed = marked.join(before, "range").select("tid", "s", "e", (F.col("before") + place).alias("place"), "total")
    seen = placed.groupBy("tid", "s", "e").agg(F.min("place").alias("first"), F.min("place").alias("nth"), F.first("total").alias("total"))
    if min_coverage > 1:
        order = F.row_number().over(Window.partitionBy("tid", "s", "e").orderBy("place"))
        later = placed.withColumn("__n", order).where(F.col("__n") <= min_coverage).where(F.col("__n") == min_coverage).select("tid", "s", "e", F.col("place").alias("nth"))
        seen = seen.drop("nth").join(later, ["tid", "s", "e"], "left")
    both = seen.join(known.select("tid", "s", "e").distinct().withColumn("known", F.lit(True)), ["tid", "s", "e"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    points = sorted({*range(floor, ceiling + 1, step), 100})
    percents = F.explode(F.array(*map(F.lit, points))).alias("percent")
    grown = both.select("known", "first", "nth", "total", percents).withColumn("upto", F.floor(F.col("total") * F.col("percent") / 100))
    return grown.groupBy("percent").agg(F.count_if(F.col("known") & (F.col("nth") <= F.col("upto"))).alias("known"), F.count_if(~F.col("known") & (F.col("first") <= F.col("upto"))).alias("novel"), F.count_if(F.col("first") <= F.col("upto")).alias("all_junctions"))


def first_records(reads: DataFrame, most: int) -> DataFrame:
    """The rows of the `most` smallest rec_ords. The bound is found from counts of ranges of 2^20 rec_ords, so only one range is sorted."""
    sizes = reads.groupBy(F.shiftright("rec_ord", 20).alias("range")).agg(F.count("*").alias("n"))
    upto = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("range")))  # a row for each million records
    over = upto.where(F.col("upto") > most).orderBy("range").first()
    if over is None:
        return reads
    inside = reads.where(F.shiftright("rec_ord", 20) == over.range).select("rec_ord").orderBy("rec_ord").limit(most - (over.upto - over.n))
    top = inside.agg(F.max("rec_ord")).first()[0]
    return reads.where(F.col("rec_ord") <= (over.range * (1 << 20) - 1 if top is None else top))


def exonic_shelf(transcripts: DataFrame, merged_exons: DataFrame) -> DataFrame:
    """tid and bin, for all bins up to a contig's last exon or transcript: tx (the transcripts that touch it), ex (merged exons) and cum (exonic bases before the bin)."""
    size = intervals.BIN
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor((b - 1) / size)))
    tx = transcripts.where("s < e").select("tid", F.struct("tx_id", "s", "e").alias("t"), bins(F.col("s"), F.col("e")).alias("bin")).groupBy("tid", "bin").agg(F.collect_list("t").alias("tx"))
    parts = merged_exons.where("s < e").select("tid", "s", "e", bins(F.col("s"), F.col("e")).alias("bin"))
    inside = F.least("e", (F.col("bin") + 1) * size) - F.greatest("s", F.col("bin") * size)
    ex = parts.groupBy("tid", "bin").agg(F.collect_list(F.struct("s", "e")).alias("ex"), F.sum(inside).alias("n"))
    last = transcripts.select("tid", "e").unionByName(merged_exons.select("tid", "e")).groupBy("tid").agg(F.floor(F.max("e") / size).alias("last"))
    every = last.select("tid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("bin"))
    before = Window.partitionBy("tid").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 4 kb of a contig
    full = every.join(ex, ["tid", "bin"], "left").join(tx, ["tid", "bin"], "left")
    none = lambda c: F.coalesce(c, F.array())
    return full.select("tid", "bin", none("tx").alias("tx"), none("ex").alias("ex"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cum"))


def inner_distances(reads: DataFrame, transcripts: DataFrame, merged_exons: DataFrame, min_mapq: int = 30, most: int | None = None) -> DataFrame:
    """Class and distance of each pair, decided at its left mate. transcripts: tx_id, tx_ord, tid, s, e; merged_exons: tid, s, e.

    The first transcript of each contig is left out. `most` keeps the pairs of the smallest rec_ord.
    Each pair looks up the bins of its read's end and its mate's start; exonic bases between them
    are a difference of running sums, so pairs are not grouped.
    """
    both = flags.standard(min_mapq) & flags.has(flags.PAIRED) & ~flags.has(flags.MATE_UNMAPPED)
    same = (F.col("tid") == F.col("mtid")) & ((F.col("mpos") > F.col("pos")) | ((F.col("mpos") == F.col("pos")) & ~flags.has(flags.FIRST)))
    kept = reads.where(both & (same | (F.col("tid") < F.col("mtid"))))
    kept = first_records(kept, most) if most else kept
    end = F.col("pos") + cigar.query_length() + cigar.intron_length()
    base = kept.select("rec_ord", "tid", "mtid", "pos", "mpos", "cigar", end.alias("r1e"))
    inside = F.aggregate(cigar.exon_blocks(), F.lit(0).cast("long"), lambda a, b: a + F.greatest(F.lit(0).cast("long"), F.least(b.e, F.col("r1e")) - F.greatest(b.s, F.col("mpos"))))
    base = base.withColumn("d", F.when(F.col("tid") == F.col("mtid"), F.when(F.col("mpos") >= F.col("r1e"), F.col("mpos") - F.col("r1e")).otherwise(-inside)))
    order = Window.partitionBy("tid").orderBy("tx_ord")
    later = transcripts.withColumn("__n", F.row_number().over(order)).where("__n > 1").select("tid", "tx_id", "s", "e")
    shelf, size = exonic_shelf(later, merged_exons), intervals.BIN
    span = F.floor(F.col("e") / size) - F.floor(F.col("s") / size) + 1
    entries = later.select(span.alias("n")).unionByName(merged_exons.select(span.alias("n"))).unionByName(merged_exons.groupBy("tid").agg(F.max(F.floor(F.col("e") / size)).alias("n")).select("n")).agg(F.sum("n")).first()[0] or 0
    shelf = F.broadcast(shelf) if entries <= intervals.BROADCAST_ENTRIES else shelf
    total = merged_exons.groupBy("tid").agg(F.sum(F.col("e") - F.col("s")).alias("__total"))
    local = F.col("tid") == F.col("mtid")
    keyed = base.withColumn("__b1", F.when(local, F.floor((F.col("r1e") - 1) / size))).withColumn("__b2", F.when(local, F.floor(F.col("mpos") / size)))
    for n in "12":
        own = shelf.select(F.col("tid").alias(f"__t{n}"), F.col("bin").alias(f"__bin{n}"), F.col("tx").alias(f"tx{n}"), F.col("ex").alias(f"ex{n}"), F.col("cum").alias(f"cum{n}"))
        keyed = keyed.join(own, (F.col("tid") == F.col(f"__t{n}")) & (F.col(f"__b{n}") == F.col(f"__bin{n}")), "left")
    keyed = keyed.join(F.broadcast(total.withColumnRenamed("tid", "__tid")), F.col("tid") == F.col("__tid"), "left")  # a row for each contig

    def stabbed(n: str, p: Column) -> Column:
        return F.transform(F.filter(f"tx{n}", lambda t: (t.s <= p) & (p < t.e)), lambda t: t.tx_id)

    def before(n: str, p: Column) -> Column:
        """Exonic bases before p, which lies in the bin or at its end; all of them behind the last bin."""
        here = F.aggregate(f"ex{n}", F.lit(0).cast("long"), lambda a, x: a + F.greatest(F.lit(0).cast("long"), F.least(x.e, p) - F.greatest(x.s, F.col(f"__b{n}") * size)))
        return F.coalesce(F.col(f"cum{n}") + here, F.col("__total"))

    common = F.coalesce(F.arrays_overlap(stabbed("1", F.col("r1e") - 1), stabbed("2", F.col("mpos"))), F.lit(False))
    x = F.when(F.col("mpos") > F.col("r1e"), before("2", F.col("mpos")) - before("1", F.col("r1e")))
    full = keyed.withColumn("common", F.when(common, True)).withColumn("x", x).withColumn("has_exons", F.when(F.col("__total").isNotNull(), True))
    x = F.coalesce("x", F.lit(0).cast("long"))
    kind = (
        F.when(F.col("tid") != F.col("mtid"), "sameChrom=No")
        .when(F.col("common").isNull(), "sameTranscript=No,dist=genomic")
        .when(F.col("d") <= 0, "readPairOverlap")
        .when(F.col("has_exons").isNull(), "unknownChromosome,dist=genomic")
        .when(x == F.col("d"), "sameTranscript=Yes,sameExon=Yes,dist=mRNA")
        .when(x > 0, "sameTranscript=Yes,sameExon=No,dist=mRNA")
        .otherwise("sameTranscript=Yes,nonExonic=Yes,dist=genomic")
    )
    return full.select("rec_ord", kind.alias("class"), F.when(kind == "sameTranscript=Yes,sameExon=No,dist=mRNA", x).otherwise(F.col("d")).alias("distance"))


def distance_histogram(distances: DataFrame, low: int = -250, high: int = 250, step: int = 5) -> DataFrame:
    """Counts in (lo, lo + step]; values outside are dropped."""
    bin_ = F.ceil((F.col("distance") - low) / step) - 1
    kept = distances.where(F.col("distance").isNotNull()).select((low + bin_ * step).alias("lo")).where((F.col("lo") >= low) & (F.col("lo") < high))
    return kept.groupBy("lo").agg(F.count("*").alias("n"))


def sampled_positions(tx_exons: DataFrame, sample: int = 100) -> DataFrame:
    """tx_id, tid, p (1-based) of sampled exonic bases, and n, the size of the sample."""
    per = tx_exons.groupBy("tx_id", "tid").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("ex"), F.sum(F.col("e") - F.col("s")).alias("total"))  # a transcript's exons
    bases = F.flatten(F.transform("ex", lambda x: F.sequence(x.s + 1, x.e)))
    step = F.floor(F.col("total") / sample)
    strided = F.filter("bases", lambda p, i: (i % step) == 0)
    edges = F.flatten(F.transform("ex", lambda x: F.array(x.s + 1, x.e)))
    short = F.col("total") <= sample
    chosen = per.withColumn("bases", bases).withColumn("chosen", F.array_distinct(F.when(short, F.col("bases")).otherwise(F.concat(strided, edges))))
    return chosen.select("tx_id", "tid", F.when(short, F.col("total") + 2).otherwise(F.size("chosen")).alias("n"), F.explode("chosen").alias("p"))


def depth_at(blocks: DataFrame, points: DataFrame, stretch: int = 1 << 16) -> DataFrame:
    """points (tid, p from 1, and more columns) that blocks (tid, s, e, k) cover, with c: how many, each block counted k times.

    Points lie among the blocks' edges in one sweep, within stretches, onto which the sums of all
    earlier ones are added; so no block is dealt out to the points in it, and no contig needs one task.
    """
    edges = blocks.select("tid", F.explode(F.array(F.struct(F.col("s").alias("at"), F.col("k").alias("d")), F.struct(F.col("e").alias("at"), (-F.col("k")).alias("d")))).alias("x")).groupBy("tid", "x.at").agg(F.sum("x.d").alias("d"))
    more = [c for c in points.columns if c != "tid"]
    own = points.select("tid", (F.col("p") - 1).alias("at"), F.lit(0).cast("long").alias("d"), F.col("p").isNotNull().alias("__point"), *more)
    rows = edges.withColumn("__point", F.lit(False)).unionByName(own, allowMissingColumns=True).withColumn("part", F.floor(F.col("at") / stretch))
    sums = rows.groupBy("tid", "part").agg(F.sum("d").alias("s"))
    before = Window.partitionBy("tid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    carried = sums.select("tid", "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    here = Window.partitionBy("tid", "part").orderBy("at")  # edges at a place count there
    walked = rows.join(carried, ["tid", "part"]).select("tid", "__point", *more, (F.col("base") + F.sum("d").over(here)).alias("c"))
    return walked.where("__point and c > 0").drop("__point")


def tin(reads: DataFrame, transcripts: DataFrame, tx_exons: DataFrame, sample: int = 100, min_coverage: int = 10) -> DataFrame:
    """Integrity number of each transcript (0 unless over min_coverage distinct starts lie in it)."""
    kept = reads.where(flags.none_of(flags.UNMAPPED | flags.QCFAIL | flags.SECONDARY))
    first = F.get(cigar.aligned_blocks(), F.lit(0))
    starts = kept.select("tid", first["s"].alias("p")).distinct()
    spans = transcripts.select("tx_id", "tid", F.col("s").alias("rs"), F.col("e").alias("re"))
    passed = intervals.point_join(starts, spans, ["tid"]).groupBy("tx_id").agg(F.count("*").alias("starts"))
    blocks = kept.where(~flags.has(flags.DUPLICATE)).select("tid", F.explode(cigar.aligned_blocks()).alias("b")).select("tid", F.col("b.s").alias("s"), F.col("b.e").alias("e")).groupBy("tid", "s", "e").agg(F.count("*").alias("k"))
    covered = depth_at(blocks, sampled_positions(tx_exons, sample))
    # the entropy of the shares c / t is ln t - sum(c ln c) / t
    total, c = F.sum("c"), F.col("c").cast("double")
    score = covered.groupBy("tx_id").agg((100 * F.exp(F.log(total) - F.sum(c * F.log(c)) / total) / F.first("n")).alias("score"))
    out = transcripts.join(passed, "tx_id", "left").join(score, "tx_id", "left")
    ok = F.coalesce("starts", F.lit(0)) > min_coverage
    return out.select("tx_id", "tid", "s", "e", ok.alias("passed"), F.when(ok, F.coalesce("score", F.lit(0.0))).otherwise(0.0).alias("tin"))


def tin_summary(scores: DataFrame) -> DataFrame:
    return scores.where("passed").agg(F.avg("tin").alias("tin_mean"), F.coalesce(F.percentile("tin", F.lit(0.5)), F.lit(0.0)).alias("tin_median"), F.stddev_pop("tin").alias("tin_sd"), F.count("*").alias("n_passed"))


def known_introns(tx_exons: DataFrame) -> DataFrame:
    """Annotated introns."""
    return intervals.gaps(tx_exons.select("tx_id", "tid", "s", "e"), ["tx_id"], ["tid"]).where("s < e").select("tid", "s", "e").distinct()
