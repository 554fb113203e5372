import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm import hostile
from vicinity.llm import bpe as B

LIBRARY = Tokenizer.from_file(B.default_path())
ALPHABETS = ["abcdefghij", "the in an re er", "aaaaab", "éèàüößÄÉ", "日本語中文字", "0123456789", "!?.,'\"#$%", "abcdefghijklmnopqrstuvwxyz", "a \n\t 　b", "ȺƁǄİΣς́e"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(a) for _ in range(rng.choice([5, 60, 65, 130, 300, 1000]))) for a in (rng.choice(ALPHABETS) for _ in range(n))]


CASES = [
    "", "Hello world", "a  b\n 12 don't 'Stuff", "été naïve", "x<|endoftext|>y", " ", "日本語 ß ﬁ İstanbul ΣΑΣ", "é café", "ªº²½µ ¼", "\x1c\x1f a\x85b\xa0c", "ǅ ǈ Ǆ",
    "'S 'T 'RE x'll", "<|startoftext|><|endoftext|>", "<| a", "ŉ ſ ẞ ŀ", "x'sy''t", "_-_ a_b", "ͅa", "K Å Å", "ȺȾƁa Ɓ",
]


def test_encoding_equals_the_library():
    bpe = B.load(B.default_path())
    for t in CASES + texts(1500, 1):
        assert np.frombuffer(bpe.encode(t), np.int32).tolist() == ids(t), t[:80]


def test_tree_of_one_long_word_equals_one_piece():
    bpe, rng = B.load(B.default_path()), random.Random(2)
    for word in ["a" * 20_000, "the" * 7000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))]:
        assert np.frombuffer(bpe.encode(word), np.int32).tolist() == ids(word)


def test_join_equals_encoding_the_whole():
    bpe, rng = B.load(B.default_path()), random.Random(3)
    for _ in range(500):
        s = [rng.choice("etaoinshr") for _ in range(rng.randrange(2, 40))]
        cut = rng.randrange(1, len(s))
        assert bpe.join(bpe.merge(s[:cut]), bpe.merge(s[cut:])) == bpe.merge(s) == bpe._merge_heap(s)


def test_leaves_of_long_documents(spark):
    """Small leaves, so that every cut falls somewhere: in words, spaces, special tokens."""
    long = [*texts(60, 4), *CASES, "<|endoftext|>" * 20, "word " * 200, "x" * 700, "a b" * 300, " " * 200]
    df = spark.createDataFrame(list(enumerate([*long, *long[:5]])), "doc_id long, text string")
    for split in (16, 64):
        got = {r.doc_id: (r.ids, r.decoded) for r in B.encode(df, carry=["doc_id"], split_chars=split, decoded="decoded").collect()}
        for i, t in enumerate([*long, *long[:5]]):
            want = ids(t)
            assert got[i] == (want, LIBRARY.decode(want, skip_special_tokens=False)), (split, t[:60])


def test_runs_over_many_leaves():
    """Words of letters that span leaves, with letters, marks, digits and contractions at their ends."""
    bpe, rng = B.load(B.default_path()), random.Random(6)
    for k in range(600):
        run = "".join(rng.choice("etaoinshrÉß") for _ in range(rng.randrange(40, 200)))
        text = rng.choice(["", "a ", "ab", "it'", "don't", "x1", "é", "日", "'s ", "<|endoftext|>", "<|"]) + run + rng.choice(["", "abc", "'s", "1", " z", "é!", "日", "ing'll go", "<|endoftext|>"])
        split = rng.choice([16, 17, 31])
        leaves = [B._leaf(bpe, text[i : i + split]) for i in range(0, len(text), split)]
        assert np.frombuffer(B._join_leaves(bpe, leaves), np.int32).tolist() == ids(text), (k, split, text)
    assert sum(leaf[3] is not None for leaf in leaves) > 0


@pytest.mark.parametrize("split", [100, B.SPLIT_CHARS])
def test_hostile(spark, split):
    df = hostile.clashing(spark, "ids", "_key", "_text", "key")
    out = B.encode(df, split_chars=split)
    assert out.columns.count("ids") == 1 and set(out.columns) == set(df.columns)
    rows = out.collect()
    assert sorted(map(repr, [(r.doc_id, r.text, r.ids) for r in rows])) == sorted(map(repr, [(r.doc_id, r.text, ids(r.text)) for r in df.collect()]))
    back = B.decode(out).collect()
    assert all(r.decoded == LIBRARY.decode(r.ids, skip_special_tokens=False) for r in back)
    assert B.encode(hostile.empty(spark)).collect() == []


def test_decode_of_odd_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [320, 10**6, -1, 49407]), (4, [320, None])], "doc_id long, ids array<int>")
    assert [r.decoded for r in B.decode(df).orderBy("doc_id").collect()] == ["", "", "a</w> <|endoftext|>", "a</w>"]


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in B.op7_bpe(spark, sf).collect():
        want = ids(docs[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()
