import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helixmill.llm import topk


def brute(rows, queries, k=5):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    ints = {}
    for i, v in rows:
        if i is not None and ok(v):
            ints.setdefault(i, []).append([math.floor(256 * float(x)) for x in v])
    first = {i: min(v for j, v in rows if j == i and ok(v)) for i in ints}
    out = []
    for i in sorted(q for q in ints if q in queries):
        a = [math.floor(256 * float(x)) for x in first[i]]
        scored = {}
        for j, vs in ints.items():
            s = [sum(x * y for x, y in zip(a, b)) for b in vs if len(b) == len(a)]
            if j != i and s:
                scored[j] = max(-(2**63), min(2**63 - 1, max(s)))
        for n, (j, s) in enumerate(sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:k]):
            out.append((i, n + 1, j, s))
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    return sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0"), **more).collect())


def test_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 40))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 6] * rng.choice([0.1, 1]) + rng.normal(size=40) * 0.2]) for k in range(700)]
    rows += [(k, rows[0][1]) for k in range(700, 760)]  # many ties
    rows += [(900, None), (950, [1.0, None]), (1000, [float("nan")] * 40), (1050, [float("inf")] + [0.0] * 39), (None, rows[1][1])]
    rows += [(1100, [1.0, 2.0]), (1101, [3.0, -4.0]), (1150, []), (1151, []), rows[50], rows[50], rows[7], (100, rows[3][1])]
    want = brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0})
    assert run(spark, rows) == want
    assert run(spark, rows, block=37, per_query_block=3) == want
    assert run(spark, [r for r in rows if r[1] is None]) == []


def test_values_beyond_doubles(spark):
    rows = [(0, [3e30, 1.0]), (1, [2e10, 5.0]), (2, [-1e30, 0.5]), (3, [1e9, 1e9]), (50, [1e7, 2e7])]
    assert run(spark, rows) == brute(rows, {0, 50})


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 60), st.integers(1, 7))
def test_bounds_lose_nothing(seed, dims, n, k):
    rng = np.random.default_rng(seed)
    c = np.floor(rng.normal(size=(dims, n)) * rng.choice([1, 100, 3000]))
    q = np.floor(rng.normal(size=(dims, 3)) * 100)
    best = [(np.zeros(0, np.int64), np.zeros(0))] * 3
    for a in range(0, n, 13):
        topk.search_block(best, np.array([0, 5, 999]), q, np.arange(a, min(a + 13, n)), c[:, a : a + 13], k, step=5)
    for i, qid in enumerate((0, 5, 999)):
        want = sorted(((-int(s), j) for j, s in enumerate(q[:, i] @ c) if j != qid))[:k]
        assert list(zip((-best[i][1]).astype(int).tolist(), best[i][0].tolist())) == want


def test_an_invalid_row_does_not_hide_a_valid_query(spark):
    inf, nan = float("inf"), float("nan")
    bad = [[None, 1.0], [-inf, 0.0], [nan, 0.0], None]
    rows = [(k, v) for k, v in enumerate(bad)] + [(k, [1.0, float(k)]) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, df, k=1).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(0, 1)] + [(k, 5) for k in range(1, 5)] + [(5, 4)]


def test_queries_in_several_parts_and_candidates_without_a_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in np.float32(rng.normal(size=6) * rng.choice([1, 200, 10**6]))]) for k in range(400)]
    want = brute(rows, {k for k in range(0, 400, 50)})
    for part in (16 << 20, 1):
        monkeypatch.setattr(topk, "PART_BYTES", part)
        assert run(spark, rows, block=50, per_query_block=3) == want
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plan = topk.search(df, df.where("vec_id % 50 = 0"))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("MapInArrow") :] if "MapInArrow" in plan else plan[plan.rindex("MapInPandas") :]
    assert "Exchange" not in below and "Join" not in plan
