"""Operator 2: URL filters by rules and gradient-boosted trees on lexical features.

Host and path are cut from the url in Spark. Of the rules that fit, the longest decides. Other urls
get the verdict of boosted trees over length, depth, digit ratio, entropy, parameter counts and
suffix statistics (how often urls of the host's last one and two labels are blocked in training).
The trees learn from labelled urls: the query takes as labelled those that a rule decides, at most
`MAX_TRAIN` different ones by the smallest hashes of (url, page_id). Only their features and hashes
of their suffixes, some 60 bytes a row, reach the driver. All urls are judged.

Rows: a null url, or one without ://, has an empty host and path, no rule, and the trees' verdict.
Urls of any length are read whole. Repeated rows get equal results. Without labelled urls the trees
allow; with labels of one kind they give that kind. An empty table gives an empty table. Extra
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, small_batches

#: Bound of the training sample.
MAX_TRAIN = 20_000
#: The query's rules: verdict and host/path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def apply_rules(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """df with `rule` and `ruled`: the longest rule that fits host and path, and its verdict (null where none fits)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer one is asked first
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("ruled", verdict)


FEATURES = ["length", "depth", "digit_ratio", "entropy", "parameters", "host_length", "labels", "hyphens", "path_length", "upper", "suffix1", "suffix2"]


#: The features that need no suffix statistics.
OWN = len(FEATURES) - 2


def _suffixes(host: str) -> tuple[int, int]:
    """Hashes of the host's last label and its last two."""
    parts = host.rsplit(".", 2)
    return tuple(xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) >> 1 for x in (parts[-1], ".".join(parts[-2:])))


def own_features(urls: list[str | None], hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first OWN of FEATURES, and the suffix hashes, of each url."""
    out, suffixes = np.zeros((len(urls), OWN)), np.zeros((len(urls), 2), np.int64)
    for i, (url, host, path) in enumerate(zip(urls, hosts, paths, strict=True)):
        url = url or ""
        raw = np.frombuffer(url.encode("utf-8", "replace"), np.uint8)
        n = max(1, len(raw))
        share = np.bincount(raw, minlength=1)
        share = share[share > 0] / n
        query = url.partition("?")[2].partition("#")[0]
        digits = int(((raw >= 48) & (raw <= 57)).sum())
        upper = int(((raw >= 65) & (raw <= 90)).sum())
        out[i] = (len(url), sum(map(bool, path.split("/"))), digits / n, -(share * np.log2(share)).sum() + 0.0, sum(map(bool, query.split("&"))), len(host), host.count(".") + bool(host), url.count("-"), len(path), upper / n)
        suffixes[i] = _suffixes(host)
    return out.astype(np.float32).astype(np.float64), suffixes


def joined(own: np.ndarray, suffixes: np.ndarray, suffix: dict[int, float], base: float) -> np.ndarray:
    return np.hstack([own, np.array([[suffix.get(s, base) for s in row] for row in suffixes.tolist()]).reshape(-1, 2)])


def lexical(urls: list[str | None], hosts: list[str], paths: list[str], suffix: dict[int, float], base: float) -> np.ndarray:
    """One row of FEATURES for each url."""
    return joined(*own_features(urls, hosts, paths), suffix, base)


@dataclass
class Trees:
    """A sum of regression trees on the log odds of block; nodes as arrays."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    suffix: dict[int, float] = field(default_factory=dict)
    prior: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 5, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss with second-order gains over feature histograms."""
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1e-6
    model = Trees(float(np.log(mean / (1 - mean))))
    if len(y) < 2 * least or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, cut, left, right, value = [-1], [0.0], [0], [0], [0.0]
        open_ = [(0, np.arange(len(y)), 0)]
        while open_:
            node, rows, level = open_.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            value[node] = -rate * sg / (sh + ridge)
            if level == depth or len(rows) < 2 * least:
                margin[rows] += value[node]
                continue
            best = (1e-6, -1, 0)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                k = coded[rows, f]
                size = len(c) + 1
                lg, lh, ln = (np.cumsum(np.bincount(k, w, size))[:-1] for w in (g[rows], h[rows], None))
                gain = lg**2 / (lh + ridge) + (sg - lg) ** 2 / (sh - lh + ridge) - sg**2 / (sh + ridge)
                gain[(ln < least) | (len(rows) - ln < least)] = -1
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), f, at)
            if best[1] < 0:
                margin[rows] += value[node]
                continue
            _, f, at = best
            go = coded[rows, f] <= at
            feature[node], cut[node], value[node] = f, float(cuts[f][at]), 0.0
            for side, part in ((left, rows[go]), (right, rows[~go])):
                side[node] = len(feature)
                for a, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, 0.0)):
                    a.append(v)
                open_.append((side[node], part, level + 1))
        model.trees.append((np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value)))
    return model


def fit(rows: pd.DataFrame) -> Trees:
    """Trees from columns url, host, path, block (0 or 1)."""
    return learn(*own_features(list(rows.url), list(rows.host), list(rows.path)), rows.block.to_numpy(float))


def learn(own: np.ndarray, suffixes: np.ndarray, y: np.ndarray) -> Trees:
    prior = float(y.mean()) if len(y) else 0.0
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for row, b in zip(suffixes.tolist(), y, strict=True):
        for s in set(row):
            sums[s][0] += b
            sums[s][1] += 1
    suffix = {s: (a + 5 * prior) / (n + 5) for s, (a, n) in sums.items()}
    model = boost(joined(own, suffixes, suffix, prior), y)
    model.suffix, model.prior = suffix, prior
    return model


def parsed(urls: DataFrame, key: str, url: str) -> DataFrame:
    base = urls.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    return base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))


def judge(urls: DataFrame, model: Trees, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block) of each row."""
    ruled = apply_rules(parsed(urls, key, url), rules).select("page_id", "url", "host", "path", "rule", "ruled")
    small_batches(urls.sparkSession)
    shared = urls.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_TRAIN rows
    schema = T.StructType([ruled.schema["page_id"], *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            _, urls_, hosts, paths, rule, verdict = batch.columns
            x = lexical(urls_.to_pylist(), hosts.to_pylist(), paths.to_pylist(), m.suffix, m.prior)
            score = 1 / (1 + np.exp(-m.margin(x)))
            own = np.where(score > 0.5, "block", "allow")
            final = [v or o for v, o in zip(verdict.to_pylist(), own.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), hosts, paths, rule, pa.array(final), pa.array(score)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return ruled.mapInArrow(run, schema)


def train(labelled: DataFrame, most: int = MAX_TRAIN) -> Trees:
    """Trees from rows page_id, url, host, path, block: at most `most` different ones, by the smallest hashes."""
    place = F.xxhash64("url", "page_id")
    rows = labelled.select(place.alias("place"), "url", "host", "path", F.col("block").cast("float").alias("block"))
    n = rows.agg(F.approx_count_distinct("place", 0.02)).first()[0]
    share = min(1.0, 1.2 * (most + 200) / max(1, n))  # a few more rows than wanted lie below
    few = rows.where(F.col("place").cast("double") <= F.lit(-(2.0**63) + share * 2.0**64)).dropDuplicates(["place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, suffixes = own_features(*(c.to_pylist() for c in b.columns[1:4]))
            packed = [x.tobytes() + s.tobytes() for x, s in zip(own.astype(np.float32), suffixes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), b.column(4)], names=["place", "packed", "block"])

    got = few.mapInArrow(run, "place long, packed binary, block float").orderBy("place").limit(most).collect()
    raw = [bytes(r.packed) for r in got]
    own = np.array([np.frombuffer(r, np.float32, OWN) for r in raw], np.float64).reshape(-1, OWN)
    suffixes = np.array([np.frombuffer(r, np.int64, 2, 4 * OWN) for r in raw]).reshape(-1, 2)
    return learn(own, suffixes, np.array([r.block for r in got], float))


def filter_urls(urls: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Judges all urls; the trees learn from those that a rule decides."""
    rules = RULES if rules is None else rules
    ruled = apply_rules(parsed(urls, "page_id", "url"), rules).where("rule is not null").withColumn("block", F.col("ruled") == "block")
    return judge(urls, train(ruled), rules)
