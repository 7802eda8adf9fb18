"""Operator 5: SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set if over half of its shingles' XXH64 values have it set. Two
fingerprints link at `max_bits` or fewer differing bits. The 64 bits are cut into segments; linked
fingerprints differ by at most max_bits // segments bits in one of them. Each distinct fingerprint
is looked up under all segment values in that small Hamming ball, and the matches are verified over
all 64 bits. Connected components of the links give the groups.

Only distinct fingerprints are linked, so exact copies never make pairs. Rows: null or wordless
text has fingerprint zero and is linked like any other. Texts of fewer words than a shingle have
one shingle of all words. Repeated rows (the same doc_id) each keep their row. A null doc_id keeps
its row and names no component unless all of its group are null. An empty table gives an empty
table. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, saved, small_batches

SEED, BITS = 42, 64
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16
# They change no result: texts sampled for common shingles, how many of those are kept, the longest list of texts that meet pair by pair at once and the most rounds before, and ids broadcast.
SAMPLE, COMMON, LONG_LIST, ROUNDS, BROADCAST_ROWS = 10_000, 200_000, 20, 4, 500_000
#: How many shingles of their prefixes two texts must share to be compared, and the ratio of the set sizes that one bucket holds. They change no result.
SHARED, BUCKET = 8, 1.25


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased (A-Z) words, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    hash64 = xxhash.xxh64_intdigest
    return np.fromiter((hash64(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive runs of hashes, how often each of the 64 bits is set."""
    out = np.zeros((len(sizes), BITS), np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for a in range(0, len(hashes), CHUNK):
        b = min(a + CHUNK, len(hashes))
        bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(edges, a, "right") - 1, np.searchsorted(edges, b, "left")
        inside = [k for k in range(first, last) if sizes[k]]
        at = np.maximum(edges[inside], a) - a
        out[inside] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return out


def fingerprints_of(texts: list[str | None], width: int) -> np.ndarray:
    return prints_of([shingle_hashes(t, width) for t in texts])


def prints_of(parts: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(p) for p in parts], np.int64)
    counts = bit_counts(np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes)
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """`key` and the fingerprint `fp` (its 64 bits as a long) of each row."""
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("fp", T.LongType(), False)])
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                fp = fingerprints_of(part.column(1).to_pylist(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return source.mapInArrow(run, schema)


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """Lowest bit and width of each segment."""
    edges = [round(k * BITS / segments) for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def ball(width: int, radius: int) -> list[int]:
    """All patterns of at most `radius` bits out of `width`."""
    return [sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(width), r)]


def segments_for(n: int, max_bits: int = 4) -> int:
    """The number of segments, of those with balls of one bit or more, with the least work for n fingerprints: lookups and the candidates that they fetch by chance."""

    def work(segments: int) -> float:
        each = [len(ball(w, max_bits // segments)) for _, w in segment_bounds(segments)]
        return sum(x / 2 + n * x / 2 / 2.0**w for x, (_, w) in zip(each, segment_bounds(segments), strict=True))

    return min(range(2, max(3, max_bits)), key=work) if max_bits > 1 else 2


def links(fps: DataFrame, max_bits: int = 4, segments: int | None = None) -> DataFrame:
    """Pairs a, b of the distinct fingerprints `fp` that differ in 1 to max_bits bits; each pair at least once.

    Of two segment values that differ, the one with more of the differing bits set does the lookup;
    at a tie both do, and one result is kept. So about half of each ball is enumerated.
    """
    segments = max(2, segments or segments_for(fps.count(), max_bits))
    radius = max_bits // segments
    parts = segment_bounds(segments)
    value = lambda low, width: F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit((1 << width) - 1))
    entry = F.array(*[F.struct(F.lit(k).cast("byte").alias("seg"), value(*p).alias("key")) for k, p in enumerate(parts)])
    index = fps.select(F.col("fp").alias("b"), F.inline(entry))
    def lookups(k: int, low: int, width: int) -> Column:
        flips = F.array(*[F.lit(m).cast("long") for m in ball(width, radius)])
        own = value(low, width)
        shared = lambda m: 2 * F.bit_count(own.bitwiseAND(m))
        more = F.filter(flips, lambda m: shared(m) >= F.bit_count(m))
        return F.transform(more, lambda m: F.struct(F.lit(k).cast("byte").alias("seg"), own.bitwiseXOR(m).alias("key"), (shared(m) == F.bit_count(m)).alias("tie")))

    probe = fps.select(F.col("fp").alias("a"), F.inline(F.concat(*[lookups(k, *p) for k, p in enumerate(parts)])))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = probe.join(index, (probe.seg == index.seg) & (probe.key == index.key) & (~F.col("tie") | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")) & (near <= max_bits))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (its component's smallest node) for the nodes of the edges a < b.

    Alternates large-star and small-star steps until no edge changes; each step moves edges to
    smaller ends and never makes more of them. Hubs are joined, never gathered.
    """
    now = saved(edges)
    mark = None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_least, "b").select(F.explode(F.array(F.struct("m", F.col("b").alias("v")), F.struct("m", F.col("a").alias("v")))).alias("e"))
        before, now = now, saved(small.select(F.col("e.m").alias("a"), F.col("e.v").alias("b")).where("a < b").distinct())
        forget(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4, segments: int | None = None) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of each row."""
    prints = saved(fingerprints(docs, key, text, width))
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(nodes.select("fp"), max_bits, segments))
    grouped = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = saved(grouped.join(named, "root").select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint as 16 hex digits and component_id."""
    got = near_duplicates(docs)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingled(rows: DataFrame, width: int, common: np.ndarray | None = None) -> DataFrame:
    """rows (the last column is the text) with, in place of the text, its fingerprint fp, the number n of its distinct shingles, and hs: their hashes, or with `common` the prefix of these, and z: their sketch."""
    names = rows.columns[:-1]
    made = [T.StructField("fp", T.LongType(), False), T.StructField("n", T.IntegerType(), False), *[T.StructField(c, T.ArrayType(T.LongType(), False), False) for c in (["hs"] if common is None else ["hs", "z"])]]
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(common)  # at most COMMON longs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                hashes = [shingle_hashes(t, width) for t in part.column(len(names)).to_pylist()]
                fp = prints_of(hashes).view(np.int64)
                sets = [np.unique(h).view(np.int64) for h in hashes]
                sizes = pa.array([len(s) for s in sets], pa.int32())
                kept = sets if late is None else [prefix_of(s, late) for s in sets]
                lists = {"hs": kept} | ({} if late is None else {"z": [sketch_of(s) for s in sets]})
                arrays = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x))) for x in lists.values()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(fp), sizes, *arrays], names=[*names, "fp", "n", *lists])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *made]))


def sketch_of(s: np.ndarray) -> np.ndarray:
    """A bit for each class of hashes, set if the set has an odd number of that class; as many classes as the next power of two from the set's size, 64 at least."""
    classes = max(64, 1 << max(0, len(s) - 1).bit_length())
    odd = (np.bincount(s & (classes - 1), minlength=classes) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def apart(x: str, y: str) -> Column:
    """Bits in which two sketches differ, the longer one folded to the other's length: never more than the shingles that only one of the sets has."""
    width = F.least(F.size(x), F.size(y))
    folded = lambda z: F.when(F.size(z) <= width, F.col(z)).otherwise(F.zip_with(F.slice(z, F.lit(1), width), F.slice(z, width + 1, width), lambda a, b: a.bitwiseXOR(b)))
    return F.aggregate(F.zip_with(folded(x), folded(y), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, bits: total + bits)


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Hashes of shingles that many texts (id, text) have, by a sample. They only order the prefixes; no result depends on them."""
    share = min(1.0, SAMPLE / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < round(share * (1 << 20))).dropDuplicates(["id"])
    often = shingled(some, width).select(F.explode("hs").alias("h")).groupBy("h").count().where("count >= 4")
    return np.sort(np.array([r.h for r in often.orderBy(F.desc("count"), "h").limit(COMMON).collect()], np.int64))


def prefix_of(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + SHARED shingles in an order that is the same for all texts: common ones last."""
    if not len(s):
        return s
    late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
    return np.concatenate([s[~late], s[late]])[: len(s) - (4 * len(s) + 4) // 5 + SHARED]


def joined_groups(known: DataFrame, edges: DataFrame) -> DataFrame:
    """known (id and its group c) after edges a, b between ids join groups."""
    a, b = (known.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    between = edges.join(a, "a").join(b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    roots = components(between)
    return saved(known.join(roots, known.c == roots.node, "left").select("id", F.coalesce("root", "c").alias("c")))


def shared_lists(nodes: DataFrame) -> DataFrame:
    """h, id, n and pos: the texts that share a shingle of their prefixes, at its place there, for the first of all shingles that the same texts share.

    Texts that are near copies share many shingles, and one of them is enough to meet. The order of
    shingles is one for all texts, so the first is the first in each.
    """
    own = F.slice("hs", F.lit(1), F.col("n") - whole(F.col("n")) + 1)
    rows = nodes.select("id", "n", F.posexplode(own).alias("pos", "h")).withColumn("pos", F.col("pos") + 1)
    lists = rows.groupBy("h").agg(F.count("*").alias("size"), F.sum("pos").alias("places"), F.bit_xor("id").alias("x"), F.bit_xor(F.xxhash64("id")).alias("y")).where("size > 1")
    kept = saved(lists.groupBy("size", "x", "y").agg(F.min_by("h", F.struct("places", "h")).alias("h")).select("h"))
    return saved(rows.join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, "h"))


def whole(n: Column) -> Column:
    """Four fifths, rounded up."""
    return F.floor((4 * n + 4) / 5).cast("int")


def meetings(rows: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sides to join on h and bucket: rows, and the larger sets that may be similar to them.

    Two sets that first share a shingle at place p of n and q of m share at most the n - p + 1 and
    m - q + 1 from there, and need four ninths of n + m. So a larger set asks only for the sizes that
    leave it enough, in buckets of sizes: texts that have no more than a common passage in common
    never meet, however many have it. `rows` and `others` may have sketches z.
    """
    bucket = lambda n: F.floor(F.log(n.cast("double")) / math.log(BUCKET)).cast("int")
    index = others.select("h", bucket(F.col("n")).alias("bucket"), F.col("id").alias("other"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("c").alias("d"), *([F.col("z").alias("y")] if "z" in others.columns else []))
    top = F.least(F.col("n"), F.floor(9 * (F.col("n") - F.col("pos") + 1) / 4).cast("int") - F.col("n"))
    asks = rows.withColumn("top", top).where(F.col("top") >= whole(F.col("n"))).withColumn("bucket", F.explode(F.sequence(bucket(whole(F.col("n"))), bucket(F.col("top")))))
    return asks, index


def with_similar(known: DataFrame, nodes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """known (id and its group c) after all texts of Jaccard similarity 0.8 or more over their shingle sets are linked.

    nodes has id, its smallest doc_id, n, hs (the prefix) and z (the sketch) of each text; rows doc_id, id, text.
    Two such sets share SHARED shingles of their prefixes (or, if they are smaller, four fifths of
    their shingles), so each pair is found, and the whole sets verify it. Only one of two such sets
    has at most a ninth of n + m shingles, so texts whose sketches differ in more bits make no pair
    where they meet: copies of one text that are too far from each other are many. Pairs of one group need no
    link. Where pair by pair would be much work, all texts first meet one text of each list: the one
    that has fewest shingles of its own before it, as the text has from which the others were copied,
    or in later rounds any. So a group of near copies becomes one without all its pairs.
    """
    lists = shared_lists(nodes)
    # the larger set asks; of equal sizes the larger id does
    enough = (4 * (F.col("n") + F.col("m")) <= 9 * (F.col("n") - F.col("pos") + 1)) & (4 * (F.col("n") + F.col("m")) <= 9 * (F.col("m") - F.col("q") + 1))
    meet = (F.col("c") != F.col("d")) & enough & (5 * F.col("m") >= 4 * F.col("n"))
    close = 9 * apart("z", "y") <= F.col("n") + F.col("m")
    sketches = nodes.select("id", "z")
    larger = (F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("id") > F.col("other")))

    def spread(groups: DataFrame) -> DataFrame:
        """The rows, with their groups, of lists in more than one group."""
        now = lists.join(groups, "id")
        several = now.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h")
        return saved(now.join(several, "h"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = saved(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
        x, y = (nodes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("hs").alias(f"h{c}")) for c in "ab")
        likely = F.size(F.array_intersect("ha", "hb")) >= F.least(F.lit(SHARED), whole(F.col("na")), whole(F.col("nb")))
        pairs = saved(pairs.join(x, "a").join(y, "b").where(likely).select("a", "b"))
        ids = saved(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(nodes.select("id", "doc_id"), "id"))
        few = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        sets = saved(shingled(rows.join(few, ["doc_id", "id"], "left_semi").select("id", "text"), width).select("id", "n", "hs").dropDuplicates(["id"]))
        x, y = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("hs").alias(f"h{c}")) for c in "ab")
        both = F.size(F.array_intersect("ha", "hb"))
        return pairs.join(x, "a").join(y, "b").where(5 * both >= 4 * (F.col("na") + F.col("nb") - both)).select("a", "b")

    now = spread(known)
    left = now.count()
    for turn in range(ROUNDS):
        asks, index = meetings(now, now)
        work = asks.groupBy("h", "bucket").agg(F.count("*").alias("x")).join(index.groupBy("h", "bucket").agg(F.count("*").cast("double").alias("y")), ["h", "bucket"])
        if (work.agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0) < LONG_LIST * left:
            break
        order = F.struct((F.col("pos") / F.col("n")).alias("own"), F.xxhash64("id").alias("at")) if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)).alias("at"))
        first = now.groupBy("h").agg(F.min_by(F.struct("id", "n", "pos", "c"), order).alias("p"))
        others = first.select("h", F.col("p.id").alias("other"), F.col("p.n").alias("m"), F.col("p.pos").alias("q"), F.col("p.c").alias("d"))
        met = now.join(others, "h").where((F.col("c") != F.col("d")) & enough & (5 * F.least("n", "m") >= 4 * F.greatest("n", "m")))
        met = saved(met.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct())
        x, y = nodes.select("id", "n", "z"), nodes.select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("z").alias("y"))
        known = joined_groups(known, verified(met.join(x, "id").join(y, "other").where(close)))
        forget(met)
        before, now = now, spread(known)
        forget(before)
        last, left = left, now.count()
        if left > 0.95 * last:  # another round would join little more
            break
    drawn = now.join(sketches, "id")
    asks, index = meetings(drawn, drawn)
    on = (asks.h == index.h) & (asks.bucket == index.bucket) & meet & larger & close
    return joined_groups(known, verified(asks.join(index, on).select("id", "other")))


def one_of_each(docs: DataFrame, width: int = 5, max_bits: int = 4) -> DataFrame:
    """docs without all rows of each near-duplicate group but the one of smallest doc_id (of its rows of one text one; of its texts in the group the one of smallest hash). Rows without doc_id stay.

    Texts link at `max_bits` or fewer differing bits of their fingerprints, or at a Jaccard
    similarity of 0.8 or more over their sets of shingles, at any distance.
    """
    text = F.col("text").cast("string")
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("id"), text.alias("text"))
    made = saved(shingled(rows, width, common_shingles(rows.select("id", "text"), width)))
    nodes = saved(made.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("hs").alias("hs"), F.first("z").alias("z")))
    roots = components(links(nodes.select("fp").distinct(), max_bits))
    known = saved(nodes.join(roots, nodes.fp == roots.node, "left").select("id", F.coalesce("root", "fp").alias("c")))
    groups = made.select("doc_id", "id").join(with_similar(known, nodes, rows, width), "id")
    kept = groups.groupBy("c").agg(F.min(F.struct("doc_id", "id")).alias("k")).select("k.doc_id", F.col("k.id").alias("__hm_mark"))
    known = docs.where("doc_id is not null").withColumn("__hm_mark", F.xxhash64(text)).dropDuplicates(["doc_id", "__hm_mark"]).join(kept, ["doc_id", "__hm_mark"], "left_semi")
    return known.select(docs.columns).unionByName(docs.where("doc_id is null"))
