"""Operator 4: exact top-k inner products by columnar branch-and-bound.

Vectors become integers, floor(scale * x). Rows are packed into blocks; a block holds its vectors
in vertical layout, a row for each dimension, as small integers where they fit. Blocks of queries
are broadcast in parts of at most PART_BYTES and a block; for each part, candidates are read once,
without a shuffle, and each task streams its blocks past the queries. Scores are accumulated some dimensions at a time. After each step the rest
of a score is at most the product of the remaining masses (norms over the dimensions to come) of
query and candidate; candidates whose bound is below the query's k-th score so far are dropped,
and the survivors are compacted before the next step. Nothing is left out that could be in the
result, so it is exact; the k best of all tasks are merged at the end, which is all that is
shuffled.

Rows: vectors that are null or hold null or non-finite components take no part. Only vectors of
one length are compared. Rows of one id are one candidate (the best of their scores) and one query
(of its valid vectors the one that sorts first). Ties go to the smaller id. A null id takes no part. Scores beyond a
long are set to its ends. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches

#: Candidates and queries of a block, dimensions of a step, bytes of queries of a broadcast part. They change no result.
BLOCK, QUERIES, STEP, PART_BYTES = 4096, 2048, 16, 16 << 20
#: Below this, all sums are exact in double precision.
EXACT = 2.0**53
LONG = 2**63


def integers(values: np.ndarray, scale: int = 256) -> np.ndarray:
    return np.floor(np.asarray(values, np.float64) * scale)


def _blocks(size: int, scale: int):
    """Packs rows (id, vector) into blocks: dims, kind, ids and floor(scale * x) by dimension, as bytes of that kind."""

    def pack(ids: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
        m = integers(np.array(rows, np.float64).reshape(len(rows), -1), scale)
        kind = next((c for c in ("i2", "i4") if np.abs(m).max(initial=0) <= np.iinfo(c).max), "f8")
        return pa.RecordBatch.from_pydict({"dims": pa.array([m.shape[1]], pa.int32()), "kind": [kind], "ids": [np.array(ids, np.int64).tobytes()], "cols": [np.ascontiguousarray(m.T).astype(kind).tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for batch in batches:
            ids, vectors = batch.column(0).to_pylist(), batch.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes nan
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for i, key in enumerate(ids):
                v = flat[ends[i] - sizes[i] : ends[i]]
                if key is None or not vectors[i].is_valid or not np.isfinite(v).all():
                    continue
                a, b = kept.setdefault(len(v), ([], []))
                a.append(key)
                b.append(v)
                if len(a) >= size:
                    yield pack(*kept.pop(len(v)))
        for a, b in kept.values():
            yield pack(a, b)

    return run


def _opened(dims: int, kind: str, ids: bytes, cols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and columns of a block."""
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(cols, kind).reshape(dims, len(own))


def merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, then smaller id; of one id the best."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    keep = np.sort(first)[:k]
    return ids[keep], scores[keep]


def _masses(cols: np.ndarray, edges: list[int]) -> np.ndarray:
    """For each step, the norm over the dimensions from there on; a little over, for rounding."""
    squares = np.array([np.square(cols[a:]).sum(axis=0) for a in edges]).reshape(len(edges), cols.shape[1])
    return np.sqrt(squares) * (1 + 1e-9)


def search_block(best: list[tuple[np.ndarray, np.ndarray]], qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int, step: int = STEP) -> None:
    """Moves the k best of candidates c (dimensions x rows) for each query into best."""
    dims = q.shape[0]
    edges = list(range(0, dims, step)) or [0]
    qm, cm = _masses(q, edges), _masses(c, edges)
    if dims and qm[0].max(initial=0) * cm[0].max(initial=0) * 4 >= EXACT:
        return _wide_block(best, qids, q, cids, c, k)
    a, b = edges[0], min(edges[0] + step, dims)
    first = q[a:b].T @ c[a:b]
    for i, qid in enumerate(qids):
        ids, scores = best[i]
        floor = scores[-1] if len(scores) >= k else -np.inf
        at, part = None, first[i]
        for s in range(1, len(edges)):
            alive = part + qm[s, i] * (cm[s] if at is None else cm[s][at]) * (1 + 1e-9) + 1e-6 >= floor
            if at is None:
                at = np.flatnonzero(alive)
                part = part[at]
            elif not alive.all():
                at, part = at[alive], part[alive]
            if not len(at):
                break
            d = slice(edges[s], min(edges[s] + step, dims))
            part = part + q[d, i] @ c[d][:, at]
        at = np.arange(len(cids)) if at is None else at
        good = (part >= floor) & (cids[at] != qid)
        at, part = at[good], part[good]
        if len(at) > 16 * k and len(np.unique(cids[at])) == len(at):  # a plain cut first
            least = np.partition(part, len(part) - k)[len(part) - k]
            at, part = at[part >= least], part[part >= least]
        if len(at):
            best[i] = merge(np.concatenate([ids, cids[at]]), np.concatenate([scores, part]), k)
    return None


def _wide_block(best, qids, q, cids, c, k) -> None:
    """The same for values too large for exact doubles: whole numbers of any size, no bounds."""
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    q, c = whole(q), whole(c)
    for i, qid in enumerate(qids):
        scores = np.array([sum(int(x) * int(y) for x, y in zip(q[:, i], c[:, j], strict=True)) for j in range(len(cids))], object)
        good = cids != qid
        ids, old = best[i]
        rows = sorted({int(a): b for a, b in sorted(zip([*ids, *cids[good]], [*map(int, old), *scores[good]], strict=True), key=lambda r: r[1])}.items(), key=lambda r: (-r[1], r[0]))[:k]
        best[i] = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], object)


def _searcher(shared, k: int):
    """Streams blocks of candidates past the broadcast blocks of queries; the k best of each query at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(dims, *_opened(dims, kind, ids, cols)) for dims, kind, ids, cols in shared.value]
        best = [[(np.zeros(0, np.int64), np.zeros(0))] * len(ids) for _, ids, _ in asked]
        for batch in batches:
            for dims, kind, ids, cols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cids, c = _opened(dims, kind, ids, cols)
                c = c.astype(np.float64)
                for own, (size, qids, q) in zip(best, asked, strict=True):
                    if size == dims:
                        search_block(own, qids, q.astype(np.float64), cids, c, k)
        for own, (_, qids, _) in zip(best, asked, strict=True):
            scores = [max(-LONG, min(LONG - 1, int(x))) for _, s in own for x in s]
            yield pa.RecordBatch.from_pydict({"query_id": np.repeat(qids, [len(a) for a, _ in own]), "vec_id": np.concatenate([a for a, _ in own]), "score": pa.array(scores, pa.int64())})

    return run


def search(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK, per_query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of df for each row of queries."""
    spark, schema = df.sparkSession, "dims int, kind string, ids binary, cols binary"
    small_batches(spark)
    pick = lambda d: d.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = saved(pick(df).mapInArrow(_blocks(block, scale), schema))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    once = pick(queries).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite).groupBy("id").agg(F.min("v").alias("v"))
    n = max(1, -(-once.count() // per_query_block))
    dealt = once.repartition(n, F.pmod(F.xxhash64("id"), F.lit(n)))
    asked = saved(dealt.mapInArrow(_blocks(per_query_block, scale), schema).withColumn("q", F.monotonically_increasing_id()))
    upto = F.sum(F.length("ids") + F.length("cols")).over(Window.orderBy("q"))  # a row of two numbers for each block of queries
    part_of = saved(asked.select("q", F.floor((upto - 1) / PART_BYTES).alias("part")))
    parts = [r.part for r in part_of.select("part").distinct().orderBy("part").collect()]
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for part in parts:
        blocks = [(r.dims, r.kind, bytes(r.ids), bytes(r.cols)) for r in asked.join(part_of.where(F.col("part") == part), "q").orderBy("q").collect()]
        found = found.unionByName(rows.mapInArrow(_searcher(spark.sparkContext.broadcast(blocks), k), "query_id long, vec_id long, score long"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digests(df: DataFrame) -> DataFrame:
    """The contract's search: the rows whose id is divisible by 50 against all."""
    return search(df, df.where("vec_id % 50 = 0"))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT * FROM e WHERE vec_id % 50 = 0) q JOIN e c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
