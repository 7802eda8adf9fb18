import random

import duckdb

from helixmill.llm import linededup


def split(text):
    """Lines with words, each with the blank lines after it; leading blank lines are a unit of no words."""
    out = []
    for line in text.split("\n"):
        if line.strip(" \t\r\n\x0b\x0c") or not out:
            out.append(line)
        else:
            out[-1] += "\n" + line
    return out


def brute(rows, min_words):
    docs = []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        docs.append((key, split(text)))
    strip = lambda s: s.strip(" \t\r\n")
    flat = [(d, i) for d, (_, u) in enumerate(docs) for i in range(len(u)) if u[i].split()]
    gone = set()
    for n, (d, i) in enumerate(flat):
        for e, j in flat[:n]:  # every earlier line where the same run may start
            length = words = 0
            u, v = docs[d][1], docs[e][1]
            while i + length < len(u) and j + length < len(v) and u[i + length].split() and strip(u[i + length]) == strip(v[j + length]):
                words += len(u[i + length].split())
                length += 1
            if words >= min_words:
                gone.update((d, i + k) for k in range(length))
    out = {}
    for d, (key, u) in enumerate(docs):
        lost = {i for x, i in gone if x == d}
        text = "\n".join(s for i, s in enumerate(u) if i not in lost)
        out[key] = (text, sum(bool(s.split()) for s in u), len(lost))
    return out


def corpus(seed):
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))) for _ in range(14)]
    rows = []
    for k in range(25):
        body = [rng.choice(lines) for _ in range(rng.choice([1, 4, 9, 20]))]
        if rows and rng.random() < 0.5:
            other = rng.choice(rows)[1].split("\n")
            a = rng.randrange(len(other))
            body[1:1] = other[a : a + rng.choice([1, 3, 8])]
        if rng.random() < 0.3:
            body.insert(rng.randrange(len(body) + 1), rng.choice(["", "  ", "\t"]))
        rows.append((k, "\n".join(body)))
    return [*rows, (50, ""), (51, " \n \n"), (52, "\n\n" + rows[3][1]), (None, rows[4][1]), (53, "a b c\n" * 30)]


def test_matches_brute_force(spark):
    for seed, least in ((1, 4), (2, 8), (3, 1), (4, 20)):
        rows = corpus(seed)
        df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, idx string, mark int")
        want = brute(rows, least)
        for r in linededup.line_dedup(df, least).collect():
            assert (r.text, r["__hm_lines"], r["__hm_deleted"]) == want[r.doc_id], (seed, r.doc_id)
            assert (r.idx, r.mark) == ("x", 1)
        assert any(x[2] for x in want.values())


def test_rows_without_text_copies_and_empty_tables(spark):
    passage = " ".join(f"t{k}" for k in range(60))
    rows = [(1, None), (2, passage), (3, "own\n" + passage + "\nlast"), (4, passage), (4, passage), (5, "short\nlines"), (6, "short\nlines")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in linededup.result(df).collect() if r.text is not None)
    assert got == [(2, passage, 1, 0), (3, "own\nlast", 3, 1), (4, "", 1, 1), (4, "", 1, 1), (5, "short\nlines", 2, 0), (6, "short\nlines", 2, 0)]
    assert sorted(r.doc_id for r in linededup.without_copies(df).collect()) == [1, 2, 3, 5, 6]
    assert linededup.result(df.limit(0)).collect() == []
    assert linededup.result(df.where("text is null")).collect()[0].text is None


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = linededup.result(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_repeated_rows_with_passages_of_short_lines(spark):
    passage = "\n".join(f"p{k} q{k} r{k} s{k}" for k in range(20))
    rows = [(1, "a\n" + passage), (1, "a\n" + passage), (2, passage + "\nb"), (3, "c\n" + passage), (3, "c\n" + passage), (None, "d d"), (None, "d d")]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in linededup.result(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id)
    assert got == [(1, rows[0][1], 21, 0)] * 2 + [(2, "b", 21, 20)] + [(3, "c", 21, 20)] * 2
    null = [(None, "d\n" + passage), (None, "d\n" + passage), (4, passage)]
    got = {(r.doc_id, r.n_deleted) for r in linededup.result(spark.createDataFrame(null, "doc_id long, text string")).collect()}
    assert got == {(None, 0), (4, 20)}


def test_copies_of_texts_and_runs_of_one_word(spark):
    rows = [(3, "x y\nz"), (1, "x y\nz"), (2, "\n\nx y\n\nz"), (None, "z"), (4, "q"), (4, "q"), (5, "x y\nq\nx y"), (6, "  \nq"), (7, "  \nq")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 2, 3, 4):
        want = brute([*dict.fromkeys(rows)], least)
        for r in linededup.line_dedup(df, least).collect():
            assert (r.text, r["__hm_lines"], r["__hm_deleted"]) == want[r.doc_id], (least, r.doc_id)


def test_ranks_are_places_in_the_suffix_array(spark):
    rng = random.Random(8)
    lines = [" ".join(rng.choice("ab") for _ in range(2)) for _ in range(3)]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.choice([3, 9, 30])))) for k in range(12)]
    table = linededup.line_table(spark.createDataFrame(rows, "doc_id long, text string"))
    seqs = linededup.saved(linededup.sequences(linededup.stretches(linededup.repeated(table), 1)))
    ends = linededup.saved(linededup.suffixes(seqs, 60))
    names = {r.sid: [(r.sid % 2, x.a, x.b) for x in r.lines] for r in seqs.collect()}
    got = {(r.sid, r.i): r.r for r in linededup.suffix_ranks(ends, 64).collect()}
    ordered = sorted((names[s][i:], s, i) for s, i in got)
    for n, (run, s, i) in enumerate(ordered):
        assert got[s, i] == next(k for k in range(n + 1) if ordered[k][0] == run)


def test_sql_agrees(spark):
    rows = [(k, t) for k, t in dict(corpus(9)).items() if k is not None]
    rows += [(200 + k, "\n".join([f"own {k}", *[f"long line of seven words no {j}" for j in range(k % 5 * 3)], "end"])) for k in range(30)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = sorted(tuple(r) for r in linededup.result(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "n_lines", "n_deleted").collect())
    assert sorted(con.execute(linededup.SQL).fetchall()) == got and any(r[3] for r in got)
