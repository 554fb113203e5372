import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm import hostile
from vicinity.llm import token_counts as C
from vicinity.sources.points import read_table


def library(pieces, byte_fallback):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


PIECES = C.pieces_of(C.default_path())
COUNT = library(PIECES, True)
CASES = ["", "a", "Hello world", " lead", "two  spaces", "trail ", "▁x", "a▁b", "日本語 𝒳𝒳 ß", "\n\nfoo\nbar", "<s> </s> <0x41>", "é" * 50, "   ", " ", "\t"]


def random_texts(n, seed):
    rng = random.Random(seed)
    alphabets = ["abcdefgh ", "the in an ", "日本é𝒳 x", "aaaa", "  \n\tab"]
    return ["".join(rng.choice(a) for _ in range(rng.choice([3, 10, 80, 400]))) for a in (rng.choice(alphabets) for _ in range(n))]


def test_counts_equal_the_library():
    u = C.load(C.default_path())
    for t in CASES + random_texts(1500, 1):
        assert u.of(t)[0] == COUNT(t), t[:60]


@pytest.mark.parametrize("seed", range(6))
def test_ties_and_unknowns_equal_the_library(seed):
    """Small vocabularies of whole scores, full of ties, with and without single characters."""
    rng = random.Random(seed)
    names = {"".join(rng.choice("▁ab") for _ in range(rng.randrange(1, 5))) for _ in range(12)}
    pieces = [("<unk>", 0.0), *((p, float(-rng.randrange(1, 4))) for p in sorted(names))]
    u, count = C.Unigram(pieces), library(pieces, False)
    for _ in range(300):
        t = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 25)))
        assert u.of(t)[0] == count(t), (t, pieces)


def test_hostile(spark):
    df = hostile.clashing(spark, "n_tokens", "_text")
    out = C.count_tokens(df)
    assert out.columns.count("n_tokens") == 1 and "_text" in out.columns
    assert sorted(map(repr, [(r.text, r.n_tokens) for r in out.collect()])) == sorted(map(repr, [(r.text, COUNT(r.text)) for r in df.collect()]))
    assert C.count_tokens(hostile.empty(spark)).collect() == []


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    assert all(r.n_tokens == COUNT(docs[r.doc_id]) for r in C.op5_token_counts(spark, sf).collect())


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(C, "CACHE_WORDS", 10)
    u = C.Unigram(PIECES[:2000])
    for i in range(200):
        u.of(f"word{i} again {'y' * 100}")
    assert len(u.new) + len(u.old) < 40
