import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixmill.llm import bpe, tokencount

TOK = Tokenizer.from_file(bpe.default_path())


def count(text):
    return len(TOK.encode(text, add_special_tokens=False).ids)


def apply(text, edits):
    for a, b, s in tokencount.ordered(edits, len(text)):
        text = text[:a] + s + text[b:]
    return text


ALPHABET = list("ab cdAB  \n\n\t'sre12é,.!<|>") + ["'re", "<|endoftext|>", "the ", " of", "<|end"]
PIECES = st.lists(st.sampled_from(ALPHABET), max_size=120).map("".join)


@settings(max_examples=250, deadline=None)
@given(PIECES, st.lists(st.tuples(st.integers(0, 200), st.integers(0, 9), st.lists(st.sampled_from(ALPHABET), max_size=4).map("".join)), max_size=6), st.sampled_from([1, 2, 5]))
def test_edits_in_sequence(text, edits, leaf):
    tokencount.LEAF, kept = leaf, tokencount.LEAF
    try:
        tree = tokencount.TokenTree(text, bpe.encoder(bpe.default_path()))
        assert tree.total == count(text)
        for a, n, s in edits:
            a = min(a, len(text))
            text = text[:a] + s + text[a + n :]
            tree.edit(a, a + n, s)
            assert tree.text == text and tree.total == count(text) and tree.length == len(text)
    finally:
        tokencount.LEAF = kept


@settings(max_examples=250, deadline=None)
@given(PIECES, st.lists(st.tuples(st.integers(0, 200), st.integers(0, 9), st.lists(st.sampled_from(ALPHABET), max_size=4).map("".join)), max_size=30), st.sampled_from([1, 2, 5]))
def test_edits_together(text, edits, leaf):
    tokencount.LEAF, kept = leaf, tokencount.LEAF
    try:
        tree = tokencount.TokenTree(text, bpe.encoder(bpe.default_path()))
        todo = tokencount.ordered([(a, a + n, s) for a, n, s in edits], len(text))
        tree.apply(todo)
        want = apply(text, [(a, a + n, s) for a, n, s in edits])
        assert tree.text == want and tree.total == count(want)
        tree.edit(0, 3, "x")
        assert tree.text == "x" + want[3:] and tree.total == count("x" + want[3:])
    finally:
        tokencount.LEAF = kept


def test_only_touched_regions_are_encoded_again():
    rng = random.Random(1)
    text = " ".join(rng.choice(["the", "of", "naïve", "x1", "don't"]) for _ in range(20000))
    tree = tokencount.TokenTree(text, bpe.encoder(bpe.default_path()))
    tree.edit(50_000, 50_003, " changed ")
    assert tree.encoded <= 4 * tokencount.LEAF
    assert tree.total == count(text[:50_000] + " changed " + text[50_003:])


def test_rows(spark):
    mail = "Write to ab.c@mail.example.com $$$ or +1 (555) 123-4567!!! now"
    rows = [(1, None, None), (2, "", []), (3, mail, None), (4, "one two three", [(4, 7, "2"), (0, 100, "all "), None, (None, 1, "x")]), (4, mail, [(3, 3, None)])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, e array<struct<start int, stop int, insert string>>, n_tokens string")
    for r, (_, text, edits) in zip(tokencount.recount(df, edits="e").collect(), rows, strict=True):
        text = text or ""
        assert (r.n_tokens, r.n_tokens_edited) == (count(text), count(apply(text, edits)))
    for r, (_, text, _) in zip(tokencount.digests(df).collect(), rows, strict=True):
        text = text or ""
        assert (r.n_tokens, r.n_tokens_edited) == (count(text), count(apply(text, tokencount.cleaning_edits(text))))
    assert tokencount.digests(df.limit(0)).collect() == []
