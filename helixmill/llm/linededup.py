"""Operator 9 [native]: deletion of repeated line runs by a suffix array over line ids.

A line is a line with words and the blank lines after it. A run is a sequence of lines of one
document. A line is deleted if it lies in a run of at least `min_words` words that also starts
earlier, in the order of doc_id and then of lines: the first copy stays, later copies go whole.

Only lines that occur twice, in stretches of at least `min_words` words without a gap, can lie in
such a run. Each stretch is a sequence of line ids, read forward and backward. Its suffixes are
sorted by distributed prefix doubling: a suffix's rank by its first 2^(k+1) lines is its rank by
the first 2^k, and how many suffixes of that rank have a smaller one 2^k lines further on. Ranks
are places in the suffix array, so a group's neighbour is the group at its rank plus its size. The
longest common prefix of neighbours, in words, cuts the array into intervals: in an interval all
suffixes share at least `min_words` words. The earliest suffix of an interval is the first copy;
each other one is a later copy of the shortest run of `min_words` words from there. Maximal
repeated runs are the unions of the shortest runs that begin (forward) or end (backward) at their
lines, so these unions go. A shortest run has at most `min_words` lines, which bounds the doubling.

Texts are sorted once each. A copy of a whole text in a later document goes whole, if it has
`min_words` words. Counts meet in partial aggregates, a group's members are told apart by sums over
ranges of ranks, and names are joined on two saved sides, of which adaptive execution can split a
hot one: no line, run or text needs one task.

Only DataFrame functions run. Rows: null text stays null and has no lines; empty and blank texts
stay as they are. Rows that share doc_id and text are one document and get the same text; rows of
one doc_id and other texts are ordered by a hash of the text. A null doc_id comes before all
others. An empty table gives an empty table. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, saved

#: Fixed value: a new line begins at a line break before a line with words.
BREAK = r"\n(?=[^\S\n]*\S)"
#: Ranges of ranks over which sums are taken first (as a power of two), and rounds of pruning. They change no result.
RANGES, PRUNINGS = 10, 2


def units(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), BREAK)


def text_id(text: Column) -> list[Column]:
    """A text's 128-bit id."""
    return [F.xxhash64(text).alias("m1"), F.xxhash64(F.lit(7), text).alias("m2")]


def line_table(docs: DataFrame) -> DataFrame:
    """The text's id, idx, words, and the 128-bit line id (a, b) of each line with words."""
    text = F.col("text").cast("string")
    lines = docs.where(text.isNotNull()).select(*text_id(text), F.posexplode(units(text)).alias("idx", "s"))
    trimmed = F.btrim(F.col("s"), F.lit(" \t\r\n"))
    return lines.select("m1", "m2", "idx", F.regexp_count("s", F.lit(r"\S+")).alias("words"), F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(7), trimmed).alias("b")).where("words > 0")


def repeated(rows: DataFrame) -> DataFrame:
    """The rows whose line occurs at two or more places of different texts or of one. Copies of a text count as one."""
    place = F.xxhash64("m1", "m2", "idx")
    many = saved(rows.groupBy("a", "b").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("a", "b"))
    return rows.join(many, ["a", "b"]).dropDuplicates(["m1", "m2", "idx"])


def stretches(rows: DataFrame, min_words: int) -> DataFrame:
    """The rows that lie in stretches of consecutive lines of min_words words or more, with their stretch's `part`."""
    text = Window.partitionBy("m1", "m2")
    parted = rows.withColumn("part", F.col("idx") - F.row_number().over(text.orderBy("idx")))
    whole = F.sum("words").over(Window.partitionBy("m1", "m2", "part"))
    return parted.withColumn("whole", whole).where(F.col("whole") >= min_words).select("m1", "m2", "idx", "words", "a", "b", "part")


def sequences(rows: DataFrame) -> DataFrame:
    """sid (even: forward, odd: backward), the text's id, the place `first` of the stretch, and its lines in reading order."""
    line = F.struct("idx", "a", "b", "words")
    ordered = rows.groupBy("m1", "m2", "part").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # within one text
    numbered = saved(ordered.withColumn("n", 2 * F.monotonically_increasing_id()).drop("part"))
    first = F.col("lines")[0]["idx"].alias("first")
    return numbered.select(F.col("n").alias("sid"), "m1", "m2", first, "lines").unionByName(numbered.select((F.col("n") + 1).alias("sid"), "m1", "m2", first, F.reverse("lines").alias("lines")))


def suffixes(seqs: DataFrame, min_words: int) -> DataFrame:
    """sid, i, a, b of each suffix, and `need`: how many lines its first min_words words take (null where it has fewer)."""
    rows = seqs.select("sid", F.posexplode("lines").alias("i", "l")).select("sid", "i", "l.a", "l.b", "l.words")
    run = Window.partitionBy("sid")
    upto = F.sum("words").over(run.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    cum = rows.withColumn("before", upto - F.col("words"))
    ahead = run.orderBy("before").rangeBetween(0, min_words - 1)
    return cum.select("sid", "i", "a", "b", F.when(F.sum("words").over(ahead) >= min_words, F.count("*").over(ahead).cast("int")).alias("need"))


def places(groups: DataFrame, within: list[str], by: list[str], bucket: Column) -> DataFrame:
    """groups with `below`: the sum of n over the groups of the same `within` that come before in the order of `by`.

    Sums are taken over buckets (an increasing function of `by`) first, so a group of many members
    is dealt over as many tasks as it has buckets.
    """
    rows = groups.withColumn("bucket", bucket)
    sums = rows.groupBy(*within, "bucket").agg(F.sum("n").alias("s"))
    over = Window.partitionBy(*within).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # about 2^RANGES rows, twice that in the first round
    base = sums.select(*within, "bucket", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("base"))
    here = Window.partitionBy(*within, "bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, [*within, "bucket"]).withColumn("below", F.col("base") + F.coalesce(F.sum("n").over(here), F.lit(0))).drop("bucket", "base")


def suffix_ranks(rows: DataFrame, longest: int) -> DataFrame:
    """sid, i, need and r: how many suffixes are smaller by their first lines, `longest` of them or more."""
    side = F.pmod("sid", F.lit(2)).cast("int").alias("side")
    lines = rows.groupBy(side, "a", "b").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    first = places(lines, ["all"], ["side", "a", "b"], F.col("side") * (1 << RANGES) + F.shiftright("a", 64 - RANGES))
    ranks = saved(first.select("side", "a", "b", F.col("below").alias("r")))
    now = saved(rows.withColumn("side", side).join(ranks, ["side", "a", "b"]).select("sid", "i", "need", "r"))
    total, groups = now.count(), ranks.count()
    shift = max(0, total.bit_length() - RANGES)
    step = 1
    while step < longest:
        after = F.coalesce(F.lead("r", step).over(Window.partitionBy("sid").orderBy("i")), F.lit(-1).cast("long"))  # an end comes before all
        paired = saved(now.withColumn("after", after))
        split = paired.groupBy("r", "after").agg(F.count("*").alias("n"))
        finer = saved(places(split, ["r"], ["after"], F.shiftright("after", shift)).select("r", "after", (F.col("r") + F.col("below")).alias("finer")))
        new = finer.count()
        if new == groups:  # no group has split, so none ever will
            break
        old, now = now, saved(paired.join(finer, ["r", "after"]).select("sid", "i", "need", F.col("finer").alias("r")))
        for t in (old, paired, finer):
            forget(t)
        groups, step = new, 2 * step
    return now


def intervals(ranks: DataFrame, seqs: DataFrame, longest: int, min_words: int) -> DataFrame:
    """r and interval: the groups of the suffix array by the interval, of common prefixes of min_words words or more, that they lie in."""
    heads = ranks.groupBy("r").agg(F.count("*").alias("n"), F.max("need").alias("need"), F.min(F.struct("sid", "i")).alias("at"))
    shown = heads.select("r", "n", "need", F.col("at.sid").alias("sid"), F.col("at.i").alias("i")).where("need is not null").join(seqs.select("sid", "lines"), "sid")
    lines = F.transform(F.slice("lines", F.col("i") + 1, 2 * longest), lambda x: F.struct(x.a.alias("a"), x.b.alias("b"), x.words.alias("w")))
    groups = saved(shown.select("r", (F.col("r") + F.col("n")).alias("next"), lines.alias("l")))
    x, y = groups.select("next", F.col("l").alias("x")), groups.select("r", F.col("l").alias("y"))
    both = y.join(x, y.r == x.next, "left")
    same = F.zip_with("x", "y", lambda p, q: F.coalesce((p.a == q.a) & (p.b == q.b), F.lit(False)))
    lcp = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size("y"))
    shared = F.aggregate(F.slice("y", F.lit(1), lcp.cast("int")), F.lit(0).cast("long"), lambda s, l: s + l.w)
    cuts = both.select("r", F.when(F.col("x").isNull() | (shared < min_words), F.col("r")).alias("cut"))
    # the interval of a group is the last cut up to it, over ranges of ranks
    shift = 16
    parted = saved(cuts.withColumn("bucket", F.shiftright("r", shift)))
    last = parted.groupBy("bucket").agg(F.max("cut").alias("top"))
    carried = last.select("bucket", F.max("top").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))  # a row for each 2^16 lines
    here = Window.partitionBy("bucket").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    return parted.join(carried, "bucket").select("r", F.coalesce(F.max("cut").over(here), "carried").alias("interval"))


def owners(docs: DataFrame) -> DataFrame:
    """For each text its id, the first document `doc` that has it (null comes first), and whether others have it too."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", *text_id(F.col("text").cast("string")))
    some = rows.groupBy("m1", "m2").agg(F.bool_or(F.col("doc_id").isNull()).alias("lone"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    several = (F.col("lone") & F.col("lo").isNotNull()) | (F.col("lo") != F.col("hi"))
    return some.select("m1", "m2", F.when(~F.col("lone"), F.col("lo")).alias("doc"), F.coalesce(several, F.lit(False)).alias("several"))


def later_copies(docs: DataFrame, first: DataFrame, min_words: int = 50) -> DataFrame:
    """The text's id and idx of each line to delete, of the first document with that text."""
    rows = saved(line_table(docs))
    for _ in range(PRUNINGS):
        old, rows = rows, saved(stretches(repeated(rows), min_words).drop("part"))
        forget(old)
    seqs = saved(sequences(stretches(rows, min_words)))
    ends = saved(suffixes(seqs, min_words))
    longest = ends.agg(F.max("need")).first()[0] or 0
    if not longest:
        return seqs.where("false").select("m1", "m2", F.col("first").alias("idx"))
    ranks = suffix_ranks(ends, longest)
    found = ranks.where("need is not null").join(saved(intervals(ranks, seqs, longest, min_words)), "r")
    text = seqs.join(first, ["m1", "m2"]).select("sid", "m1", "m2", "doc", "first", F.size("lines").alias("len"))
    back = F.col("sid") % 2 == 1
    anchor = F.when(back, F.col("first") + F.col("len") - 1 - F.col("i")).otherwise(F.col("first") + F.col("i"))
    placed = saved(found.join(text, "sid").select("interval", "m1", "m2", "need", back.alias("back"), F.struct("doc", "m1", "m2", anchor.alias("idx")).alias("place")))
    earliest = saved(placed.groupBy("interval").agg(F.min("place").alias("origin")))
    copies = placed.join(earliest, "interval").where("place > origin")
    low = F.when(F.col("back"), F.col("place.idx") - F.col("need") + 1).otherwise(F.col("place.idx"))
    return copies.select("m1", "m2", F.explode(F.sequence(low, low + F.col("need") - 1)).alias("idx")).distinct()


def line_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with later copies of repeated runs cut out of `text`, and __hm_lines, __hm_deleted: how many lines it had and lost."""
    first = saved(owners(docs))
    gone = later_copies(docs, first, min_words).groupBy("m1", "m2").agg(F.collect_list("idx").alias("gone"))
    known = first.join(gone, ["m1", "m2"], "left").where("several or gone is not null")
    known = known.select(F.col("m1").alias("__hm_m1"), F.col("m2").alias("__hm_m2"), F.col("doc").alias("__hm_doc"), F.col("gone").alias("__hm_gone"))
    text = F.col("text").cast("string")
    m1, m2 = text_id(text)
    both = docs.join(known, (m1 == F.col("__hm_m1")) & (m2 == F.col("__hm_m2")), "left")
    both = both.withColumn("__hm_units", units(text))  # a column of its own: the lambda below must not split again
    lines = F.col("__hm_units")
    head = F.when(F.get(lines, F.lit(0)).rlike(r"\S"), 0).otherwise(1)  # the first unit may be blank
    copy = F.col("__hm_m1").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("__hm_doc"))
    whole = F.when(F.regexp_count(text, F.lit(r"\S+")) >= min_words, F.sequence(head, F.size(lines) - 1))
    both = both.withColumn("__hm_lost", F.when(copy, whole).otherwise(F.col("__hm_gone")))
    lost = F.col("__hm_lost")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    cut = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    n = F.when(text.isNull() | ~text.rlike(r"\S"), 0).otherwise(F.size(lines) - head)
    return both.select(
        *[F.when(lost.isNull(), text).otherwise(cut).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        n.cast("long").alias("__hm_lines"),
        F.when(lost.isNull(), 0).otherwise(F.size(lost)).cast("long").alias("__hm_deleted"),
    )


def result(docs: DataFrame) -> DataFrame:
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", "text", F.col("__hm_lines").alias("n_lines"), F.col("__hm_deleted").alias("n_deleted"))


def without_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with later copies cut out; a document that lost all its lines goes."""
    out = line_dedup(docs, min_words)
    return out.where("__hm_deleted = 0 or __hm_deleted < __hm_lines").select(*[F.col(f"`{c}`") for c in docs.columns])


#: The query's rows: runs are named by their joined lines, and all windows are compared.
SQL = r"""
WITH pieces AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
marked AS (SELECT doc_id, pos, s, regexp_matches(s, '\S') AS has, count(*) FILTER (WHERE regexp_matches(s, '\S')) OVER (PARTITION BY doc_id ORDER BY pos) AS unit FROM pieces),
lines AS (SELECT doc_id, unit, trim(s, chr(32) || chr(9) || chr(13)) AS t, len(regexp_extract_all(s, '\S+')) AS w FROM marked WHERE has),
cum AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY unit) AS upto, sum(w) OVER (PARTITION BY doc_id ORDER BY unit) - w AS before FROM lines),
ahead AS (SELECT doc_id, unit, unit AS lo, max(unit) OVER f AS hi, sum(w) OVER f AS n, string_agg(t, chr(10)) OVER f AS run FROM cum WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
behind AS (SELECT doc_id, unit, min(unit) OVER f AS lo, unit AS hi, sum(w) OVER f AS n, string_agg(t, chr(10)) OVER f AS run FROM cum WINDOW f AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
runs AS (SELECT *, 0 AS side FROM ahead WHERE n >= 50 UNION ALL SELECT *, 1 FROM behind WHERE n >= 50),
later AS (SELECT doc_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY side, md5(run), len(run) ORDER BY doc_id, unit) AS k FROM runs) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS unit FROM later),
kept AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY pos) AS text FROM marked WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = marked.doc_id AND gone.unit = marked.unit) GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_deleted
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN sizes USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
