import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixmill.llm import bpe

TEXTS = [
    None,
    "",
    "aaaa aaaaa  aaaaaaa",
    "  x   y\n\n z　k  ",
    "it's we'LL they'll I'd",
    "日本語テキスト😀👍🏽 ok ½ ² Ⅷ _a_",
    "\x00\x01\x1c\x7f\x85",
    "a<|endoftext|>b<|endoftext|>",
    "The quick brown fox " * 3000,
    "the the the the",
]


def library():
    return Tokenizer.from_file(bpe.default_path())


def test_ids_and_round_trip(spark):
    rows = [(k, t, "x") for k, t in enumerate([*TEXTS, TEXTS[3]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tok = library()
    for r in bpe.decode(bpe.encode(df)).collect():
        want = tok.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == tok.decode(want, skip_special_tokens=False) == (r.text or "")
    for r in bpe.digests(df).collect():
        want = tok.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id][1] or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0)).collect() == []


def test_broken_bytes_decode_as_the_library_does(spark):
    tok = library()
    ids = tok.encode("日本😀", add_special_tokens=False).ids
    lists = [ids[:1], ids[1:], ids[:-1], [], None]
    got = bpe.decode(spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, ids array<int>")).collect()
    for r in got:
        assert r.decoded == tok.decode(r.ids or [], skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aabeht' \n.,'<|>endoftx12é²\x1c\x85\xa0")), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_any_text(texts):
    tok = library() if not hasattr(test_any_text, "tok") else test_any_text.tok
    test_any_text.tok = tok
    enc = bpe.encoder(bpe.default_path())
    for t in texts:
        assert enc.expand(enc.sequence(t)).tolist() == tok.encode(t, add_special_tokens=False).ids
