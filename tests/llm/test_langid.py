import itertools
import random
import zlib

import numpy as np

from helixmill.llm import langid

STEMS = {"aa": ["tion", "the", "ing", "wh"], "bb": ["ung", "sch", "ß", "keit"], "cc": ["eau", "oi", "é", "que"]}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(STEMS))
        words = ["".join(rng.choice(STEMS[lang]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(rng.choice([3, 30, 200]))]
        rows.append((k, " ".join(words).capitalize(), lang))
    return rows


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    k, sizes = 3, np.array([1, 4, 0, 6])
    e, t, s = rng.normal(size=(sizes.sum(), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    for chain in (2, 3, 64):
        langid.CHAIN = chain
        p, pairs = langid.posteriors(e, sizes, t, s, True)
        want, both, at = np.zeros_like(p), np.zeros((k, k)), 0
        for n in sizes:
            total = 0
            w, b = np.zeros((n, k)), np.zeros((k, k))
            for path in itertools.product(range(k), repeat=int(n)):
                if not path:
                    continue
                x = np.exp(sum(e[at + i, y] for i, y in enumerate(path)) + sum(t[a, c] for a, c in zip(path, path[1:])))
                x *= (np.exp(s) @ np.exp(t))[path[0]]
                total += x
                for i, y in enumerate(path):
                    w[i, y] += x
                for a, c in zip(path, path[1:]):
                    b[a, c] += x
            if n:
                want[at : at + n], both = w / total, both + b / total
            at += n
        assert np.allclose(p, want) and np.allclose(pairs, both)
    langid.CHAIN = 64


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "123 !!", "bb"), (None, rows[0][1], None), (1003, rows[0][1] * 50, None), (1003, rows[0][1] * 50, None)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in [*rows, *odd]], "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.digests(df).collect()
    assert len(got) == len(rows) + len(odd)
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.doc_id in lang and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len(held) > 30 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in got) and len({(r.lang_pred, r.score) for r in got if r.doc_id == 1003}) == 1
    kept = {r.doc_id for r in langid.keep_known(df).collect()}
    assert kept >= set(lang) and not kept & {1000, 1001, 1002}


def test_labels_source_and_ids_do_not_change_a_prediction(spark):
    model = langid.fit([r[1] for r in corpus()], [r[2] for r in corpus()])
    a = spark.createDataFrame([(1, "sch ung keit", "bb")], "doc_id long, text string, lang string")
    b = spark.createDataFrame([(9, "sch ung keit", "cc")], "doc_id long, text string, lang string")
    assert langid.predict(a, model).drop("doc_id").collect() == langid.predict(b, model).drop("doc_id").collect()


def test_code_switched_words():
    model = langid.fit([r[1] for r in corpus()], [r[2] for r in corpus()])
    tagger = langid.Tagger(model)
    share = tagger.shares(["tionwh " * 20 + "schkeit " * 20])[0]
    assert 0.3 < share[0] < 0.7 and 0.3 < share[1] < 0.7


def test_no_training_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.digests(df).collect()} == {"und"}
    assert langid.digests(df.limit(0)).collect() == [] and langid.keep_known(df.limit(0)).collect() == []
    assert [r.doc_id for r in langid.keep_known(df).collect()] == [1]  # without a model only texts without a letter go
    one = spark.createDataFrame([(k, "abc def", "xx") for k in range(12)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.digests(one).collect()} == {"xx"}


def test_repeated_rows_train_once(spark):
    rows = [(k, f"tion the wh {k}", "aa") for k in range(60)] + [(k, f"ung sch keit {k}", "bb") for k in range(60, 120)]
    hot = next(k for k, *_ in rows if zlib.crc32(str(k).encode()) % 4 != 2)
    copies = spark.range(4000).selectExpr(f"CAST({hot} AS LONG) AS doc_id", f"'{rows[hot][1]}' AS text", "'aa' AS lang")
    texts, labels = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(copies), 30)
    assert labels.count("aa") == labels.count("bb") == 30 and len(set(texts)) == 60
    many = spark.createDataFrame([(k, f"word {k}", f"l{k % 50}") for k in range(600)], "doc_id long, text string, lang string")
    assert len(set(langid.sample(many, 5, most_languages=7)[1])) == 7


def test_the_label_before_a_chain_is_learned():
    model = langid.fit([r[1] for r in corpus()], [r[2] for r in corpus()])
    assert np.abs(model.start).max() > 0 and np.isfinite(model.start).all()
    rng = np.random.default_rng(1)
    e, t, s = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    before = langid.posteriors(e, np.array([2, 3]), t, s, True, True)[2]
    want = np.zeros(3)
    for rows in (e[:2], e[2:]):
        w = np.zeros(3)
        for z, *path in itertools.product(range(3), repeat=len(rows) + 1):
            w[z] += np.exp(s[z] + t[z, path[0]] + sum(rows[i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        want += w / w.sum()
    assert np.allclose(before, want)
