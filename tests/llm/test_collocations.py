import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import hostile
from vicinity.llm import collocations as C
from vicinity.sources.points import read_table

SF = "/root/testdata/sf0.001"


def brute(rows, min_count, max_words=5, cover=100, top=2000):
    """``(lang, rank, phrase, a, l, r, n, score)`` of rows ``(text, lang)``."""
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang in f:
        cand = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= min_count}
        gone = {q for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= cover * cand[q := p[i : i + k]]}
        rows = []
        for p, a in cand.items():
            if p in gone:
                continue
            score, _, left, right = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k, f[lang][p[:k]], f[lang][p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def result(df, min_count, **options):
    return sorted(map(tuple, C.collocations(df, min_count=min_count, **options).collect()))


@pytest.mark.parametrize("min_count", [20, 100])
def test_equals_brute_force(spark, min_count):
    docs = read_table(spark, SF, "documents")
    got = result(docs, min_count)
    assert got == brute([(r.text, r.lang) for r in docs.collect()], min_count)
    assert got and (min_count > 20 or max(len(r[2].split()) for r in got) > 2)


def test_hostile_documents(spark):
    for docs in (hostile.docs(spark), hostile.clashing(spark, "words", "seg", "n", "word")):
        rows = [(r.text, r.lang) for r in docs.collect()]
        for min_count, cover, top in ((1, 100, 2000), (2, 50, 7)):
            assert result(docs, min_count, cover=cover, top=top) == brute(rows, min_count, cover=cover, top=top)
    assert result(hostile.empty(spark), 1) == []


def test_small_segments_and_a_hot_language(spark, monkeypatch):
    rows = [(f"the quick Brown fox {'jumps over' if i % 3 else 'sleeps'}, the quick brown dog; and\tthe\x0bquick brown fox", "en" if i % 5 else None) for i in range(300)]
    rows += [("ä b. ä b! ä B? c:d;e", "und"), (",,.", "de"), ("a" * 3000 + " b", "de")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    want = brute(rows, 3)
    assert result(df, 3) == want
    monkeypatch.setattr(C, "SEGMENT_BYTES", 200)
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    assert result(df, 3) == want
    monkeypatch.setattr(C, "_pair_keys", lambda size: ["head", "tail"])
    assert result(df, 3) == want


def test_repeats_overlap_within_a_piece(spark):
    rows = [("ha ha ha ha, ha ha", "x")] * 2
    got = {r[2]: r[3] for r in result(spark.createDataFrame(rows, "text string, lang string"), 1, cover=101)}
    assert got == {"ha ha": 8, "ha ha ha": 4, "ha ha ha ha": 2}


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000
    totals = spark.createDataFrame([("x", 5 * big)], "lang string, n long")
    one = spark.createDataFrame([(1, None, None, "x", ["a"], big, [big], [big])], "id long, head long, tail long, lang string, words array<string>, f long, heads array<long>, tails array<long>")
    two = spark.createDataFrame([(2, 1, 1, "x", ["a", "a"], big - 7, [big, big - 7], [big, big - 7])], one.schema)
    got = C.scored(totals, [one, two]).first()
    assert got.score == 1000 * (big - 7) * 5 * big // (big * big)


def test_pairs_are_counted_in_packed_buckets(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(C, "COUNTED", 1000)
    for size in (1, 40, C.ONE_KEY_IDS - 1):
        grams = np.unique(np.append(rng.integers(0, size, 30), size - 1))
        want, rows = Counter(), []
        for seg in range(3):
            pos = np.flatnonzero(rng.random(3000) < 0.8)
            code = rng.integers(0, len(grams), len(pos))
            rows.append((seg, np.diff(pos, prepend=0).astype("<i4").tobytes(), code.astype("<i4").tobytes(), grams.astype("<i8").tobytes()))
            want.update(int(grams[a]) * size + int(grams[b]) for p, a, q, b in zip(pos, code, pos[1:], code[1:], strict=False) if q == p + 1)
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["seg", "step", "code", "grams"])
        dealt = pa.Table.from_batches(C._dealt_pairs(size, 7)(iter([batch])))
        got = {}
        for bucket in set(dealt["bucket"].to_pylist()):
            counted = C._counted_pairs(size, 5)(dealt.filter(pa.compute.equal(dealt["bucket"], bucket)))
            got |= dict(zip(counted["pair"].to_pylist(), counted["f"].to_pylist(), strict=True))
        assert got == {p: f for p, f in want.items() if f >= 5} and got


def test_frequent_pairs_go_to_the_tasks_by_their_own_size(spark, monkeypatch):
    """Eight bytes a pair: counted at six times that, these were joined with all segments."""
    rng = np.random.default_rng(1)
    rows = [(" ".join(f"w{x}" for x in rng.integers(0, 20, 2000)), "x")]
    docs, want = spark.createDataFrame(rows, "text string, lang string"), brute(rows, 2, max_words=3)
    monkeypatch.setattr(C, "BROADCAST_BYTES", 8 * 20 * 20)
    monkeypatch.setattr(C, "_cogrouped", lambda first: pytest.fail("segments were joined"))
    assert result(docs, 2, max_words=3) == want


def test_known_words_of_one_hash(monkeypatch):
    keys = pa.array([b"x\na", b"x\nb", b"y\na"])
    for hashes in (None, lambda raw, starts, ends: np.zeros(len(starts), "u8")):
        if hashes is not None:
            monkeypatch.setattr(C.W, "span_hashes", hashes)
        known = C._by_hash(pa.array([b"y\na", b"x\na", b"z\na"]), np.array([7, 8, 9]))
        local, place = C._places(*C._raw(keys), *known[:2])
        assert dict(zip(local.tolist(), known[2][place].tolist(), strict=True)) == {0: 8, 2: 7}
