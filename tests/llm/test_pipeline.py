"""The pipeline against a plain Python version of each stage."""

import random

from tokenizers import Tokenizer

import corpus_pipeline
from helixmill.llm import bpe, langid
from tests.llm import test_decontam, test_linededup, test_simhash

STEMS = {"aa": ["tion", "the", "ing", "wh"], "bb": ["ung", "sch", "ß", "keit"]}


def tables(seed=3):
    rng = random.Random(seed)
    say = lambda lang, n: " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(n))
    items = [(k, say("aa", 20)) for k in range(5)]
    passages = [say("aa", 60) for _ in range(3)]
    docs = []
    for k in range(70):
        lang = rng.choice(sorted(STEMS))
        lines = [say(lang, rng.choice([5, 30, 60])) for _ in range(rng.choice([1, 2, 4]))]
        kind = rng.random()
        if kind < 0.2:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(passages))
        elif kind < 0.3:
            lines.append(rng.choice(items)[1] + " " + say(lang, 9))
        elif kind < 0.5 and docs:
            words = docs[rng.randrange(len(docs))][1].split(" ")
            if kind < 0.4 and len(words) > 50:
                words[rng.randrange(len(words))] = "changed"
            lines = [" ".join(words)]
        docs.append((k, "\n".join(lines), lang, "s"))
    docs += [(100, None, "aa", "s"), (101, "12 34 !!", "aa", "s"), (102, "", None, "s")]
    return docs, items


def groups_of(rows, width=5, bits=4):
    """The smallest doc_id of each document's group: texts link at `bits` or fewer differing bits, or at a similarity of 0.8 or more of their sets of shingles."""
    prints = {i: int(f, 16) for i, f, _ in test_simhash.brute(rows, width)}
    sets = {}
    for i, t in rows:
        words = t.encode().lower().split()
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    low = {i: i for i, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in low:
        for j in low:
            both = len(sets[i] & sets[j])
            if i < j and ((prints[i] ^ prints[j]).bit_count() <= bits or (both and 5 * both >= 4 * len(sets[i] | sets[j]))):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    return {i: find(i) for i in low}


def test_stages_against_plain_python(spark, tmp_path):
    docs, items = tables()
    d = spark.createDataFrame([(*x, len(x[1] or "")) for x in docs], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = [(i, t) for i, t, *_ in docs]
    share = langid.Tagger(langid.train(d)).shares([t for _, t in kept])
    kept = [x for x, s in zip(kept, share) if s.max() >= 0.4]
    cut = test_linededup.brute(kept, 50)
    kept = [(i, cut[i][0]) for i, _ in kept if cut[i][2] == 0 or cut[i][2] < cut[i][1]]
    groups = groups_of(kept)
    kept = [(i, t) for i, t in kept if groups[i] == i]
    hits = {b[0]: b[3] for b in test_decontam.brute(kept, items)}
    kept = [(i, t) for i, t in kept if not hits[i]]

    assert {i: r.text for i, r in got.items()} == dict(kept)
    assert 10 < len(kept) < 65
    tok = Tokenizer.from_file(bpe.default_path())
    for i, t in kept:
        assert got[i].ids == tok.encode(t, add_special_tokens=False).ids and got[i].round_trip and got[i].n_tokens == len(got[i].ids)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs, items = tables(5)
    d = spark.createDataFrame([(*x, len(x[1] or "")) for x in docs], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
