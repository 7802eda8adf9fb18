import hashlib
import random
import re

import duckdb
import pytest

from helixmill.llm import decontam


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(decontam.WORD, low)


def brute(docs, items, size=8):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item_id, it in items:
            v = words(it)
            n = min(size, len(v))
            for s in range(len(v) - n + 1) if n else []:
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(item_id)
        found.discard(None)
        ids = sorted(map(str, found))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "É", "naïve", "x1", *[f"w{k}" for k in range(40)]]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 5, 8, 9, 20, 40]))) for k in range(12)]
    items += [(12, items[7][1]), (13, None), (14, ""), (15, "the the the the the the the the the the"), (None, say(12)), (10**12, items[3][1]), (7, items[7][1])]
    docs = []
    for k in range(60):
        parts = [say(rng.choice([0, 3, 30]))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            parts += [rng.choice(items)[1] or "", say(4)]
        docs.append((k, rng.choice([" ", "\n", ", "]).join(parts)))
    docs += [(100, None), (101, ""), (102, "!!"), (103, "the " * 500), (103, "the " * 500), (103, "other"), (None, items[5][1]), (None, None)]
    return docs, items


@pytest.mark.parametrize("part_bytes", [1 << 20, 900])
def test_matches_brute_force(spark, part_bytes):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, n_words int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.judge(d, i, part_bytes=part_bytes).collect()
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated) for r in got), key=str)
    assert rows == brute(docs, items)


def test_empty_tables_and_clean(spark):
    docs, items = fixture()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.digests(d.limit(0), i).collect() == []
    assert {r.n_hit for r in decontam.digests(d, i.limit(0)).collect()} == {0}
    bad = {b[0] for b in brute(docs, items) if b[3] >= 1}
    left = [r.doc_id for r in decontam.clean(d, i).collect()]
    assert sorted(map(str, left)) == sorted(str(x) for x, t in docs if brute([(x, t)], items)[0][3] == 0) and bad


def test_plan_is_native(spark):
    docs, items = fixture()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = decontam.digests(d, i)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_sql_agrees(spark, tmp_path):
    docs, items = fixture()
    docs, items = [d for d in docs if d[0] is not None and d[0] != 103], [i for i in items if i[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark(item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(con.execute(decontam.SQL).fetchall(), key=str) == brute(docs, items)


def test_ids_of_any_kind(spark):
    items = [(1, "one two three four five six seven eight nine")]
    rows = [("a", "x one two three four five six seven eight y"), (None, "one two three four five six seven eight nine"), ("-1", "clean words"), ("a", "clean"), (None, "clean")]
    d, i = spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(((r.doc_id, r.n_words, r.n_hit) for r in decontam.digests(d, i).collect()), key=str) == sorted([("a", 10, 8), (None, 9, 9), ("-1", 2, 0), ("a", 1, 0), (None, 1, 0)], key=str)
    assert sorted(((r.doc_id, r.text) for r in decontam.clean(d, i).collect()), key=str) == sorted([("-1", "clean words"), ("a", "clean"), (None, "clean")], key=str)
    ids = [(-1, rows[0][1]), (None, "clean words")]
    got = decontam.digests(spark.createDataFrame(ids, "doc_id long, text string"), i).collect()
    assert {(r.doc_id, r.n_hit) for r in got} == {(-1, 8), (None, 0)}


def test_prefixes_are_rare_in_the_documents(spark):
    items = spark.createDataFrame([(1, "p q r s t u v w")], "item_id long, text string")
    docs = spark.createDataFrame([(k, "p q r s u v w " * 3 + ("t" if k else "p q r s t u v w")) for k in range(9)] + [(99, "p p")], "doc_id long, text string")
    windows = decontam.item_windows(items, 8)
    counts = decontam.token_counts(decontam.word_table(docs), windows)
    assert {r.token: r.n for r in counts.collect()} == {r.token: r.n for r in decontam.token_counts(decontam.word_table(docs), windows, 1).collect()}
    assert [(r.token, r.off) for r in decontam.prefixes(windows, counts).collect()] == [("t", 4)]
    assert decontam.prefixes(windows, counts.where("token <> 'q'")).collect() == []
    assert {r.doc_id for r in decontam.digests(docs, items).collect() if r.n_hit} == {0}
