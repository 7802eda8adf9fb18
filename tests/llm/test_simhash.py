import random

import numpy as np
import xxhash

from helixmill.llm import simhash


def brute(rows, width=4, bits=4):
    """Fingerprints and components by all pairs."""

    def print_of(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [print_of(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(rows))]
    low = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in set(roots)}
    return sorted((rows[i][0], format(prints[i], "016x"), low[roots[i]]) for i in range(len(rows)))


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(300)] + ["É", "ÀB", "x\x0by", "z z"]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            words = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 60, 400])))
        rows.append((k, text))
    return [*rows, (1000, None), (1001, ""), (1002, " \n\t"), (1003, rows[5][1]), (1003, rows[5][1])]


def test_matches_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted(tuple(r) for r in simhash.digests(df).collect())
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got) - 20


def test_links_at_each_distance(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 30)]
    values = set(base)
    for x in base:
        for r in range(1, 10):
            y = x & (2**64 - 1)
            for b in rng.choice(64, r, replace=False):
                y ^= 1 << int(b)
            values.add(y - 2**64 if y >= 2**63 else y)
    for bits, segments in ((4, None), (4, 2), (7, None), (8, 3), (0, None)):
        df = spark.createDataFrame([(v,) for v in values], "fp long")
        got = {tuple(r) for r in simhash.links(df, bits, segments).collect()}
        want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
        assert got == want


def test_long_chain_is_one_component(spark):
    n = 200
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)], "a long, b long")
    got = {tuple(r) for r in simhash.components(edges).collect()}
    assert got == {(k, 0) for k in range(1, n + 1)}


def test_one_of_each_and_empty(spark):
    rows = [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, "other words in this text here", "t"), (3, "other words in this text here", "t"), (None, "a b", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id or 0 for r in simhash.one_of_each(df).collect()) == [0, 1, 3]
    empty = df.limit(0)
    assert simhash.digests(empty).collect() == [] and simhash.one_of_each(empty).collect() == []


def test_bit_counts_over_chunks(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    h = np.random.default_rng(0).integers(0, 2**63, 40).astype(np.uint64)
    sizes = np.array([0, 3, 0, 20, 1, 16, 0])
    got = simhash.bit_counts(h, sizes)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for k in range(len(sizes)):
        assert got[k].tolist() == [sum(int(x) >> b & 1 for x in h[edges[k] : edges[k + 1]]) for b in range(64)]


def test_near_copies_of_similarity_four_fifths_go(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = []
    for group in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(4):
            copy = list(words)
            for at in rng.choice(120, int(rng.integers(1, 5)), replace=False):
                copy[at] = f"n{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(500 + k, rows[0][1] + f" tail{k} more{k}") for k in range(40)] + [(600, None), (601, ""), (602, "two words")]
    sets = {k: frozenset(simhash.shingle_hashes(t, 5).tolist()) for k, t in rows}
    prints = {k: int(simhash.fingerprints_of([t], 5)[0]) for k, t in rows}
    low = {k: k for k, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    apart = 0
    for i in low:
        for j in low:
            both = len(sets[i] & sets[j])
            bits = (prints[i] ^ prints[j]).bit_count()
            alike = both and 5 * both >= 4 * len(sets[i] | sets[j])
            apart += bool(alike and bits > 4)
            if i < j and (alike or bits <= 4):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    assert apart > 50
    want = sorted(k for k in low if find(k) == k)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for longest, common in ((50, 200_000), (3, 0)):
        monkeypatch.setattr(simhash, "LONG_LIST", longest)
        monkeypatch.setattr(simhash, "COMMON", common)
        assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == want


def test_each_group_keeps_a_row_though_an_id_has_two_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(3, a), (5, a), (3, a), (5, b), (7, b)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, a), (5, b)]


def test_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(0, 700))
        a = np.unique(rng.integers(-(2**63), 2**63, n))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(-(2**63), 2**63, int(rng.integers(0, 60)))]))
        x, y = (simhash.sketch_of(s).view(np.uint64) for s in (a, b))
        while len(x) != len(y):
            x, y = (z.reshape(2, -1)[0] ^ z.reshape(2, -1)[1] if len(z) > min(len(x), len(y)) else z for z in (x, y))
        assert sum(int(p).bit_count() for p in x ^ y) <= len(np.setxor1d(a, b))


def test_far_copies_of_one_text_make_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in range(300)]
    rows = []
    for k in range(60):  # pairs of copies are at a similarity of some 0.5
        copy = list(base)
        for at in rng.choice(300, 12, replace=False):
            copy[at] = f"n{rng.integers(1 << 40)}"
        rows.append((k, " ".join(copy)))
    rows += [(100 + k, t + " tail") for k, t in rows[:5]]
    made = []
    keep = simhash.saved

    def counted(df):
        table = keep(df)
        made.append((table.columns, table.count()))
        return table

    monkeypatch.setattr(simhash, "saved", counted)
    got = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == list(range(60))
    pairs = [n for columns, n in made if columns == ["a", "b"]]
    assert max(pairs) < 100  # of 1770 that share shingles
