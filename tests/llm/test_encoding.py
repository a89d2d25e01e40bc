"""Corpus encoding against the public library and the lexicon against a dictionary."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import encoding as E
from quern.llm import lexicon as L

RANKS = E.load_ranks(f"{E.TOKENIZERS}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=E.WORD_PATTERN, mergeable_ranks=RANKS, special_tokens={})


TEXTS = ["", None, " ", "\n\n  \n", "hello world", "it's they'll I'd <|endoftext|>", "naïve café", "日本語のテキスト、これは。", "привет   мир", "a" * 5000, "x1y22z333", "👍🏽👩‍🌾", "\x00\x07", "tab\tend \r\n", "don''t", "​ mixed　"]


def test_encoding_equals_public(spark, public):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in E.encode_documents(df).collect()}
    assert got == {i: public.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    counted = {r["doc_id"]: r["n_tokens"] for r in E.encode_documents(df, lengths=True, keep=[F.col("ids")]).collect()}
    assert counted == {i: len(v) for i, v in got.items()}
    assert E.encode_documents(df.limit(0)).count() == 0


def test_repeated_rows_and_frequent_words(spark, public):
    text = "the lexicon knows these words and the merges know the rest zqxj"
    df = spark.createDataFrame([(1, text)] * 20, "doc_id long, text string")
    assert all(r["ids"] == public.encode_ordinary(text) for r in E.encode_documents(df).collect())


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_merges_equal_public(word):
    tiktoken = pytest.importorskip("tiktoken")
    enc = test_merges_equal_public.__dict__.setdefault("enc", tiktoken.Encoding("own", pat_str=E.WORD_PATTERN, mergeable_ranks=RANKS, special_tokens={}))
    assert E.merge_word(word, RANKS) == list(enc._core_bpe.encode_single_piece(word))


def test_lexicon_is_minimal_and_exact(tmp_path):
    rnd = random.Random(3)
    words = {bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 10))): tuple(rnd.randrange(5) for _ in range(rnd.randint(0, 3))) for _ in range(600)}
    p = tmp_path / "lex"
    p.write_bytes(L.compile_lexicon(words.items()))
    lex = L.Lexicon(str(p))
    for _ in range(3000):
        w = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 11)))
        assert lex.get(w) == (list(words[w]) if w in words else None)
    assert all(lex.get(w) == list(v) for w, v in words.items())
    # endings are shared: words that differ in their stem only need one tail
    p.write_bytes(L.compile_lexicon([(stem + b"ization", (i,)) for i, stem in enumerate([b"ab", b"cd", b"ef", b"gh"])]))
    assert L.Lexicon(str(p)).n_states == 1 + 4 + 8 - 4 + 4


def test_empty_lexicon(tmp_path):
    p = tmp_path / "lex"
    p.write_bytes(L.compile_lexicon([]))
    assert L.Lexicon(str(p)).get(b"x") is None


def test_builder_wants_order():
    b = L.Builder()
    b.add(b"b", (1,))
    with pytest.raises(ValueError):
        b.add(b"a", (2,))
