"""Operator 10: language identification by a linear-chain conditional random field.

Each word of a text (a run of letters, lower-cased) is labelled with a language. A word's features
are its affixes of one to three characters, its character n-grams of one to three, both hashed,
and its entry in a lexicon of frequent words of each language. Emission weights and transition
weights are learned together by stochastic gradient ascent of the conditional likelihood, whose
gradient takes expected counts from the forward-backward algorithm. A prediction runs
forward-backward over all words of the whole text; the posterior shares of the languages over its
words give the text's language (the largest, at a tie the first by name) and score (its share).

Training reads a bounded sample of labelled rows: at most `per_language` different rows of each of
the `most_languages` most frequent languages, of at most `MAX_BYTES` bytes of text each, by the
smallest hashes of (seed, doc_id). Repeated rows count once. Lexicon and weights come from that
sample. Everything else covers all rows and whole texts.

Rows: null text or text without a letter is `und` with score 0. A null or odd label trains
nothing. Without any training row all texts are `und`, and a filter rejects only texts without a
letter. With one language every other text has it. Repeated rows get equal results; a null doc_id
counts as held out. An empty table gives an empty table.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Hashed weights of n-grams and affixes; longest word part that features read from each end is the whole word.
BUCKETS = 1 << 16
#: Words of a block of the chain; texts and words held at a time. They change no result.
CHAIN, KEEP_WORDS, PART_WORDS = 64, 160_000, 80_000
#: Bounds of training: bytes of a row's text, and languages.
MAX_BYTES, MAX_LANGUAGES = 60_000, 200
UNKNOWN = "und"
_letters = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    return _letters(text.lower()) if text else []


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words, one after another, and how many each has."""
    marked = ["^" + w + "$" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = len(chars)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(n)  # characters from here to the word's end
    mix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        rolled = chars * mix
        found, owner = [], []
        for size in (1, 2, 3, 4):  # n-grams, the marks included: so affixes of one to three are among them
            if size > 1:
                rolled = rolled[: n - size + 1] if len(rolled) > n - size + 1 else rolled
                rolled = (rolled ^ (rolled >> np.uint64(29))) * mix + chars[size - 1 :][: len(rolled)]
            ok = left[: len(rolled)] >= size
            if size == 4:  # only those at a mark: affixes of three characters
                at_start = np.zeros(n, bool)
                at_start[starts] = True
                ok &= (at_start[: len(rolled)]) | (left[: len(rolled)] == 4)
            h = rolled[ok] + np.uint64(size)
            h = (h ^ (h >> np.uint64(31))) * mix
            found.append((h >> np.uint64(64 - 16)).astype(np.int32))
            owner.append(word[: len(rolled)][ok])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order], np.bincount(owners, minlength=len(words))


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[str, np.ndarray] = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each language: the mean of its hashed weights, and its lexicon entry."""
        if not words:
            return np.zeros((0, len(self.langs)))
        ids, sizes = _features(words)
        sums = np.add.reduceat(self.weights[ids], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        none = np.zeros(len(self.langs))
        return sums + np.array([self.lexicon.get(w, none) for w in words])


def posteriors(emit: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray, want_pairs: bool = False, want_before: bool = False):
    """Forward-backward over consecutive chains of `sizes` words: each word's label probabilities.

    Chains are cut into blocks of CHAIN words. The products of transfer matrices within all blocks
    are formed side by side, block by block messages follow, and then all words' messages, again
    side by side; so a long chain costs no more steps than a short one. want_pairs adds the
    expected counts of label pairs, want_before those of the label before each chain.
    """
    k = len(start)
    n = int(sizes.sum())
    if not n:
        return (np.zeros((0, k)), np.zeros((k, k))) if want_pairs else np.zeros((0, k))
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    t = np.exp(transitions - transitions.max())
    per = -(-sizes // CHAIN)
    chain = np.repeat(np.arange(len(sizes)), per)
    blocks = len(chain)
    first_block = np.cumsum(per) - per
    nth = np.arange(blocks) - first_block[chain]
    offset = (np.cumsum(sizes) - sizes)[chain] + nth * CHAIN
    length = np.minimum(CHAIN, sizes[chain] - nth * CHAIN)
    # transfer matrix of a block: from the label before it to its last label
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for s in range(int(length.max())):
        on = np.flatnonzero(length > s)
        m = (product[on] @ t) * e[offset[on] + s][:, None, :]
        product[on] = m / m.sum(axis=(1, 2), keepdims=True)
    # messages into each block, forward and backward; the label before a chain weighs exp(start) through t
    into = np.full((blocks, k), 1.0 / k)
    out_of = np.full((blocks, k), 1.0 / k)
    begin = np.exp(start - start.max())
    into[first_block[sizes > 0]] = begin / begin.sum()
    for s in range(1, int(per.max())):
        on = np.flatnonzero(nth == s)
        m = np.einsum("bi,bij->bj", into[on - 1], product[on - 1])
        into[on] = m / m.sum(axis=1, keepdims=True)
    left = per[chain] - 1 - nth
    for s in range(1, int(per.max())):
        on = np.flatnonzero(left == s)
        m = np.einsum("bij,bj->bi", product[on + 1], out_of[on + 1])
        out_of[on] = m / m.sum(axis=1, keepdims=True)
    ahead = np.empty((n, k))
    now = into.copy()
    before = np.empty((n, k))  # the message into each word, before t
    for s in range(int(length.max())):
        on = np.flatnonzero(length > s)
        at = offset[on] + s
        before[at] = now[on]
        m = (now[on] @ t) * e[at]
        m /= m.sum(axis=1, keepdims=True)
        ahead[at] = now[on] = m
    behind = np.empty((n, k))
    now = out_of.copy()
    for s in range(int(length.max()) - 1, -1, -1):
        on = np.flatnonzero(length > s)
        at = offset[on] + s
        behind[at] = now[on]
        m = (now[on] * e[at]) @ t.T
        now[on] = m / m.sum(axis=1, keepdims=True)
    p = ahead * behind
    p /= p.sum(axis=1, keepdims=True)
    if not want_pairs:
        return p
    joint = before[:, :, None] * t[None] * (e * behind)[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    inner = np.ones(n, bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    pairs = joint[inner].sum(axis=0)
    return (p, pairs, joint[~inner].sum(axis=(0, 2))) if want_before else (p, pairs)


def fit(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 7, per_step: int = 24, lexicon_size: int = 400) -> Crf:
    """Learns from whole texts that are labelled with one language each."""
    langs = sorted(set(labels))
    k = len(langs)
    model = Crf(langs, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return model
    docs = [(words_of(t), langs.index(x)) for t, x in zip(texts, labels, strict=True)]
    docs = [d for d in docs if d[0]]
    per = [Counter() for _ in langs]
    for w, y in docs:
        per[y].update(set(w))
    n_docs = np.maximum(1, np.bincount([y for _, y in docs], minlength=k))
    for y, c in enumerate(per):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]:
            if w not in model.lexicon:
                share = np.array([(per[z][w] + 0.5) / (n_docs[z] + 1) for z in range(k)])
                model.lexicon[w] = np.log(share / share.mean())
    rng = np.random.default_rng(seed)
    square_w, square_t, square_s = np.full((BUCKETS, k), 1e-8, np.float32), np.full((k, k), 1e-8), np.full(k, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), per_step):
            part = [docs[i] for i in order[a : a + per_step]]
            number: dict[str, int] = {}
            seq = np.array([number.setdefault(w, len(number)) for d, _ in part for w in d])
            sizes = np.array([len(d) for d, _ in part])
            vocabulary = list(number)
            emit = model.emissions(vocabulary)
            p, pairs, before = posteriors(emit[seq], sizes, model.transitions, model.start, True, True)
            truth = np.zeros_like(p)
            truth[np.arange(len(seq)), np.repeat([y for _, y in part], sizes)] = 1
            per_word = np.stack([np.bincount(seq, (truth - p)[:, y], len(vocabulary)) for y in range(k)], axis=1)
            ids, counts = _features(vocabulary)
            spread = np.repeat(per_word / counts[:, None] / len(seq), counts, axis=0)
            grad = np.stack([np.bincount(ids, spread[:, y], BUCKETS) for y in range(k)], axis=1).astype(np.float32)
            square_w += grad * grad
            model.weights += rate * grad / np.sqrt(square_w)
            want = np.zeros((k, k))
            for (d, y), size in zip(part, sizes, strict=True):
                want[y, y] += size - 1
            g = (want - pairs) / len(seq) - 1e-3 * model.transitions
            led = np.exp(model.start[:, None] + model.transitions)  # the label before a chain is never seen: its share given the first label
            h = ((led / led.sum(axis=0))[:, [y for _, y in part]].sum(axis=1) - before) / len(part) - 1e-3 * model.start
            square_t += g * g
            square_s += h * h
            model.transitions += 0.1 * rate * g / np.sqrt(square_t)
            model.start += 0.1 * rate * h / np.sqrt(square_s)
    return model


class Tagger:
    """Scores texts with a model; keeps the emissions of known words."""

    def __init__(self, model: Crf):
        self.model = model
        self.clear()

    def clear(self) -> None:
        from collections import defaultdict

        self.number: dict[str, int] = defaultdict(count().__next__)
        self.table = np.zeros((0, len(self.model.langs)))

    def emissions(self, seq: np.ndarray) -> np.ndarray:
        if len(self.number) > len(self.table):
            from itertools import islice

            new = list(islice(self.number, len(self.table), None))
            self.table = np.concatenate([self.table, *(self.model.emissions(new[a : a + 50_000]) for a in range(0, len(new), 50_000))])
        return self.table[seq]

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """For each text the posterior share of each language; nan where it has no word."""
        out = np.full((len(texts), len(self.model.langs)), np.nan)
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if held:
                sizes = np.array([len(s) for _, s in held])
                p = posteriors(self.emissions(np.concatenate([s for _, s in held])), sizes, self.model.transitions, self.model.start)
                out[[i for i, _ in held]] = np.add.reduceat(p, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                held.clear()
            if len(self.number) > KEEP_WORDS:
                self.clear()

        total = 0
        for i, t in enumerate(texts):
            w = words_of(t)
            if w:
                held.append((i, np.fromiter(map(self.number.__getitem__, w), np.int64, len(w))))
                total += len(w)
            if total >= PART_WORDS:
                flush()
                total = 0
        flush()
        return out


def held_out(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def sample(docs: DataFrame, per_language: int = 120, seed: int = 7, most_languages: int = MAX_LANGUAGES) -> tuple[list[str], list[str]]:
    """At most per_language different training texts of each language, in the order of a hash of doc_id."""
    spark, text = docs.sparkSession, F.col("text").cast("string")
    usable = docs.where(F.col("lang").isNotNull() & text.isNotNull() & ~held_out("doc_id") & (F.octet_length(text) <= MAX_BYTES))
    known = usable.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit(seed), "doc_id").alias("place"), F.xxhash64(text).alias("mark"), text.alias("text"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counts:
        return [], []
    # about three times the rows wanted lie below these places; a rare language is read whole
    limits = spark.createDataFrame([(r.lang, min(2**63 - 1, int(-(2**63) + 3 * (per_language + 20) / r.n * 2**64))) for r in counts], "lang string, top long")
    near = known.join(F.broadcast(limits), "lang").where("place <= top").drop("top")  # at most most_languages rows
    first = Window.partitionBy("lang").orderBy("place", "mark")
    once = near.select("lang", "place", "mark").distinct()  # copies of a row meet in partial aggregates
    chosen = once.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).drop("n")
    rows = near.join(F.broadcast(chosen), ["lang", "place", "mark"]).groupBy("lang", "place", "mark").agg(F.first("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.lang, r.place, r.mark))
    return [r.text for r in rows], [r.lang for r in rows]


def train(docs: DataFrame, per_language: int = 120) -> Crf:
    return fit(*sample(docs, per_language))


def predict(docs: DataFrame, model: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats: bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        langs = tagger.model.langs
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                if langs:
                    share = tagger.shares(part.column(1).to_pylist())
                    none = np.isnan(share[:, 0])
                    best = np.where(none, 0, np.argmax(np.where(none[:, None], 0, share), axis=1))
                    names = [UNKNOWN if x else langs[b] for x, b in zip(none, best, strict=True)]
                    score = np.where(none, 0.0, np.clip(share[np.arange(len(best)), best], 0, 1))
                else:
                    names, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least_score: float = 0.4, per_language: int = 120) -> DataFrame:
    """docs without those of no letter or of no language with at least least_score of the words' weight."""
    model = train(docs, per_language)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).to_pylist()
            if tagger.model.langs:
                good = np.nan_to_num(tagger.shares(texts).max(axis=1), nan=0.0) >= least_score
            else:  # no language is known, so none can be rejected
                good = np.array([bool(words_of(t)) for t in texts], bool)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
