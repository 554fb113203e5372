import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import hostile
from vicinity.llm import minhash as M
from vicinity.llm import words as W
from vicinity.sources.points import read_table

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").split()
    if len(w) < 5:
        return Counter([tuple(w)]) if w else Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def jp(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in keys) for i in a if i in b)


def brute(rows):
    """Class (smallest id) of each (id, text), all pairs with a shingle in common compared."""
    sets = {i: shingles(t) for i, t in rows}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for ids in by.values() for k, b in enumerate(ids) for a in ids[:k]}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        n = len(sets[a].keys() & sets[b].keys())
        if n >= 0.5 * min(len(sets[a]), len(sets[b])) and jp(sets[a], sets[b]) >= 0.8 - 1e-12:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def classes(df):
    return {r.id: r.class_id for r in M.near_duplicates(df).collect()}


def test_documents_equal_brute_force(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    assert classes(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_of_variants_equal_brute_force(spark):
    """Variants of an original: many are near it and far from each other; repeated lines give weights."""
    rng, rows = random.Random(4), []
    vocabulary = [f"w{i}" for i in range(3000)]
    for _ in range(4):
        original = [rng.choice(vocabulary) for _ in range(150)] + ["again and again the same line"] * rng.choice([0, 6])
        for _ in range(40):
            text = list(original)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 12])):
                text[rng.randrange(150)] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_hot_group(spark):
    """A group of copies beyond a block: one class, whatever the number."""
    base = " ".join(f"word{i}" for i in range(120))
    rows = [(i, base + f" tail{i}" if i % 2 else base) for i in range(700)] + [(1000 + i, " ".join(f"other{i}x{k}" for k in range(30))) for i in range(50)]
    got = classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {got[i] for i in range(700)} == {0} and all(got[1000 + i] == 1000 + i for i in range(50))


def test_a_stray_among_many_copies_costs_in_proportion(spark):
    """Members of a hot bucket that are one class already meet the few others, not each other."""
    rows = [(7, 0, i, 0) for i in range(5000)] + [(7, 0, 9000 + i, 9000 + i) for i in range(3)] + [(8, 1, i, 0) for i in range(100)]
    placed = spark.createDataFrame(rows, "bucket long, band int, id long, component long")
    dealt = M._dealt(placed)
    assert dealt.count() == 5000 + 3 * (1 + -(-5000 // M.BLOCK)) and dealt.where("bucket = 8").count() == 0
    # Every pair across components meets in one pair of blocks.
    keyed = dealt.select("id", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    other = keyed.select(*[F.col(c).alias(f"{c}_") for c in keyed.columns])
    met = keyed.join(other, (F.col("i") == F.col("i_")) & (F.col("j") == F.col("j_")) & (F.col("component") < F.col("component_")) & F.expr("(block = i AND block_ = j) OR (block = j AND block_ = i)"))
    assert met.select("id", "id_").distinct().count() == 3 * 5000 + 3


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    a = {int(h): int(w) for h, w in zip(rng.integers(1, 2**62, 300), rng.integers(1, 5, 300), strict=True)}
    b = {h: w if rng.random() < 0.8 else w + 3 for h, w in a.items() if rng.random() < 0.9}
    sig, runs = [], 60
    agree = []
    for k in range(runs):
        sig = []
        for s in (a, b):
            h = W.mix(np.array(sorted(s), np.uint64) + np.uint64(k * 7919))
            sig.append(M.signatures(np.zeros(len(s), np.int64), h, np.array([s[x] for x in sorted(s)]), 1)[0])
        agree.append((sig[0] == sig[1]).mean())
    assert np.mean(agree) == pytest.approx(jp(Counter(a), Counter(b)), abs=0.02)


def test_exact_similarity_of_weighted_sets():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = {int(x): int(w) for x, w in zip(rng.integers(0, 60, 30), rng.integers(1, 6, 30), strict=True)}
        b = {int(x): int(w) for x, w in zip(rng.integers(0, 60, 30), rng.integers(1, 6, 30), strict=True)}
        arrays = [(np.array(sorted(s), np.uint64), np.array([s[x] for x in sorted(s)])) for s in (a, b)]
        assert M.similarity(*arrays[0], *arrays[1]) == pytest.approx(jp(Counter(a), Counter(b)))


def test_word_hashes_follow_words():
    texts = ["a b  c\ta", None, "", "b a", "x" * 9000 + " y", "é\né", "x" * 9000]
    data, offsets = W.utf8(pa.array(texts))
    hashes, first = W.word_hashes(data, offsets)
    got = [hashes[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]
    assert [len(g) for g in got] == [4, 0, 0, 2, 2, 2, 1]
    assert got[0][0] == got[0][3] == got[3][1] and got[0][1] == got[3][0] and got[4][0] == got[6][0] and got[5][0] == got[5][1]
    assert len({*got[0], *got[4], *got[5]}) == 6


def test_hostile(spark):
    docs = hostile.docs(spark)
    rows = M.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.class_id if r.class_id is not None else ("row", r.row), []).append(r)
    assert all(sum(r.kept for r in group) >= 1 for group in by.values())
    same = [r for r in rows if r.id in (9, 10)]
    assert {r.class_id for r in same} == {9} and sum(r.kept for r in same) == 1 and len(same) == 4
    assert {r.class_id for r in rows if r.id in (11, 12)} == {11}
    # No words: every row is a class of its own.
    assert all(r.kept and r.class_id == r.id for r in rows if r.id in (0, 1, 2))
    assert [r.kept for r in rows if r.id is None] == [True]


def test_deduplicate_keeps_columns(spark):
    docs = hostile.clashing(spark, "_row", "kept", "class_id")
    out = M.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == docs.count() - 4
    assert M.deduplicate(hostile.empty(spark)).collect() == [] and M.near_duplicates(hostile.empty(spark)).collect() == []
