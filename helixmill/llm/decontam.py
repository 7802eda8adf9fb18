"""Operator 7 [native]: benchmark decontamination by a prefix-filtered set join.

A window is `size` consecutive words of an item (an item of fewer words is one window). A window
occurs in a document where all its words stand in order, so each of its words is necessary: its
prefix is one token, the rarest by the counts over all documents (then the longest word, then the
least). A window with a word that no document has is left out. Document words are joined with these
prefix tokens; the window's length and the token's place in it bound where it can lie; then the
words are compared one by one.

Only DataFrame functions run. The words of the documents are saved once; then they are counted (in
partial aggregates) and pass through one generator, join and filter without a shuffle. The windows are broadcast in parts of at most `PART_BYTES`; more windows mean
more passes, so any benchmark is matched whole.

Rows: null text has no words. Empty texts and items have none. A repeated document row is judged
each time; rows of one doc_id with other texts are judged apart; a null doc_id keeps its row.
Repeated items count once by item_id; an item without id counts no item but its words are hit.
An empty benchmark hits nothing; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, forget, saved

#: Fixed value: a word is a run of digits, letters a-z and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bound of one broadcast part, as the bytes of its windows' words.
PART_BYTES = 8 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """item_id and each window of the item, as `win` (words, space-joined) and `ws` (its words)."""
    words = items.select("item_id", words_of(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, size))).alias("ws"))
    return cut.select("item_id", F.array_join("ws", " ").alias("win"), "ws").distinct()


def word_table(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text, to tell rows of one doc_id apart) and words of each document row."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), words_of(text).alias("words"))


def token_counts(words: DataFrame, windows: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """How often each word of the windows stands in the documents, where it does."""
    tokens = saved(windows.select(F.explode("ws").alias("token")).distinct())
    spread = words.select(F.explode("words").alias("token"))
    size = tokens.agg(F.sum(F.octet_length("token") + 32)).first()[0] or 0
    if size <= part_bytes:
        return spread.join(F.broadcast(tokens), "token").groupBy("token").agg(F.count("*").alias("n"))
    return spread.groupBy("token").agg(F.count("*").alias("n")).join(tokens, "token")  # counted first: no word is hot


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each distinct window of counted words with its prefix token and the token's place `off` in it."""
    spread = windows.select("win", "ws").distinct().select("win", "ws", F.posexplode("ws").alias("off", "token"))
    order = F.struct("n", -F.length("token"), "token", "off")
    best = spread.join(counts, "token", "left").groupBy("win", "ws").agg(F.min_by(F.struct("token", "off"), order).alias("p"), F.bool_and(F.col("n").isNotNull()).alias("can"))
    return best.where("can").select("win", "ws", F.col("p.token").alias("token"), F.col("p.off").alias("off"))


def occurrences(words: DataFrame, patterns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row with null `win` for each document row, and one for each occurrence of a window.

    Columns doc_id, mark, n_words, start, stop, win. The row of the document itself comes from an
    empty word after its last one.
    """
    total = patterns.agg(F.sum(2 * F.octet_length("win") + 64)).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    own = words.sparkSession.createDataFrame([("", 0, None, [])], "token string, off int, win string, ws array<string>")
    out = None
    for k in range(parts):
        part = patterns.select("token", "off", "win", "ws")
        if parts > 1:
            part = part.where(F.pmod(F.xxhash64("win"), F.lit(parts)) == k)
        if k == 0:
            part = part.unionByName(own)
        spread = words.select("doc_id", "mark", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
        begin = F.col("pos") - F.col("off")
        fits = (begin >= 0) & (begin + F.size("ws") <= F.size("words")) & (F.slice("words", F.greatest(begin + 1, F.lit(1)), F.size("ws")) == F.col("ws"))
        hit = spread.join(F.broadcast(part), (F.col("word") == F.col("token")) & (F.col("win").isNull() | fits))
        hit = hit.select("doc_id", "mark", F.size("words").cast("long").alias("n_words"), begin.alias("start"), (begin + F.size("ws")).alias("stop"), "win")
        out = hit if out is None else out.unionByName(hit)
    return out


def covered(spans: Column) -> Column:
    """How many places the sorted spans (start, stop) cover."""
    step = lambda acc, s: F.struct(
        (acc.n + F.greatest(F.lit(0), s.stop - F.greatest(s.start, acc.top))).cast("long").alias("n"),
        F.greatest(acc.top, s.stop).alias("top"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("top")), step, lambda acc: acc.n)


def judge(docs: DataFrame, items: DataFrame, size: int = 8, least_items: int = 2, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, mark, n_words, n_hit, n_items, item_ids (sorted strings) and contaminated of each document row."""
    windows = saved(item_windows(items, size))
    words = saved(word_table(docs))
    patterns = saved(prefixes(windows, token_counts(words, windows, part_bytes)))
    found = saved(occurrences(words, patterns, part_bytes))
    forget(words)
    hits = found.where("win is not null")
    spans = hits.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("__hm_d"), F.col("mark").alias("__hm_m"), covered(F.col("spans")).alias("n_hit"))
    owners = windows.where("item_id is not null").select("win", F.col("item_id").cast("string").alias("item"))
    named = hits.select("doc_id", "mark", "win").distinct().join(owners, "win").select("doc_id", "mark", "item").distinct()
    named = named.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list("item")).alias("item_ids")).withColumnsRenamed({"doc_id": "__hm_e", "mark": "__hm_n"})
    both = found.where("win is null").join(spans, F.col("doc_id").eqNullSafe(F.col("__hm_d")) & (F.col("mark") == F.col("__hm_m")), "left")
    both = both.join(named, F.col("doc_id").eqNullSafe(F.col("__hm_e")) & (F.col("mark") == F.col("__hm_n")), "left")
    n_items = F.coalesce(F.size("item_ids"), F.lit(0)).cast("long")
    return both.select(
        "doc_id",
        "mark",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.when(F.col("item_ids").isNull(), F.lit(0).cast("long")).otherwise(n_items).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    ).withColumn("contaminated", F.col("n_items") >= least_items)


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    return judge(docs, items).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, items: DataFrame, size: int = 8, least_items: int = 1) -> DataFrame:
    """docs without the contaminated ones: those with windows of at least `least_items` items."""
    bad = judge(docs, items, size, least_items).where("contaminated").select(F.col("doc_id").alias("__hm_id"), F.col("mark").alias("__hm_mark")).distinct()
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__hm_id")) & (mark == F.col("__hm_mark")), "left_anti")


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(8, len(w)) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
sizes AS (SELECT DISTINCT n FROM win),
cut AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, cut.n, s, item_id FROM cut JOIN win USING (n, t)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
owner AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN owner USING (doc_id)
"""
