import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import hostile
from vicinity.llm import mixing as M
from vicinity.sources.points import read_table

SF = "/root/testdata/sf0.001"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Water-filling, one fixed source at a time."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + ([None] if None in sizes else [])
    weight = {n: 1 + i % 3 for i, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest, w = total - sum(fixed.values()), sum(weight[n] for n in names if n not in fixed)
        target = {n: fixed.get(n, rest * weight[n] / w if w else 0.0) for n in names}
        over = [n for n in names if n not in fixed and target[n] > 3 * sizes[n]]
        if not over:
            return target
        fixed.update({n: 3.0 * sizes[n] for n in over})


def check(rows, texts):
    sizes = defaultdict(int)
    for r in texts:
        sizes[r.source] += size(r.text)
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-5)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(r["size"] for r in rows) == sorted(size(r.text) for r in texts)


@pytest.mark.parametrize("source", ["hostile", "documents"])
def test_targets_are_met(spark, source):
    docs = hostile.docs(spark) if source == "hostile" else read_table(spark, SF, "documents")
    first = M.mix(docs).collect()
    check(first, docs.collect())
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(first, key=key) == sorted(M.mix(docs.repartition(5)).collect(), key=key)


def test_cap_and_small_sources(spark):
    rows = [(i, "w " * 400, "a") for i in range(50)] + [(100, "x y z", "b"), (101, "q " * 30, "c"), (102, "", "d"), (103, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(docs).collect()
    check(got, docs.collect())
    assert {r.id: r.taken for r in got}[100] == 9


def test_schedule_is_even_in_every_stretch(spark):
    rows = [(False, n, 100_000, w, i) for i, (n, w) in enumerate([("a", 10_000), ("b", 20_000), ("c", 70_000)])]
    src = spark.createDataFrame(rows, "no_source boolean, name string, source_size long, want long, _place long")
    slots = sorted(M.schedule(src, 100).collect(), key=lambda r: r.slot)
    assert len(slots) == 1000
    seen, share = Counter(), {"a": 0.1, "b": 0.2, "c": 0.7}
    for k, r in enumerate(slots[:990], 1):
        assert r["rank"] == seen[r.name]
        seen[r.name] += 1
        assert all(abs(seen[n] - k * p) <= 6 for n, p in share.items())


def test_no_words_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in M.mix(docs).collect()] == [(0, 0.0)] * 2
    assert M.mix(hostile.empty(spark)).collect() == []
    assert M.mixed_documents(hostile.empty(spark)).collect() == []


def test_mixed_documents_hold_the_words_taken(spark):
    docs = hostile.clashing(spark, "_row", "_size", "taken")
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    plan = M.mix(docs).groupBy("source").agg(F.sum("taken")).collect()
    got = Counter()
    for r in out.collect():
        got[r.source] += size(r.text)
        assert r.text is not None and r.taken == "kept taken"
    assert dict(got) == {r[0]: r[1] for r in plan if r[1]}


def three_sources(spark):
    rows = [(k * 3000 + i, " ".join(f"{n}{i}" for _ in range(5 + i % 37)), n, None) for k, n in enumerate("abc") for i in range(700 if n == "a" else 1500)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")


def assert_even(words, slack):
    """Each source holds its share of every beginning, and so of every stretch, within ``slack`` words."""
    total, seen, all_seen = Counter(), Counter(), 0
    for s, n in words:
        total[s] += n
    assert len(total) == 3
    for s, n in words:
        seen[s] += n
        all_seen += n
        assert all(abs(seen[k] - all_seen * total[k] / total.total()) <= slack for k in total)


def test_rows_of_the_mix_hold_the_sources_in_proportion(spark):
    docs = three_sources(spark)
    rows = sorted(M.mix_rows(docs).collect(), key=lambda r: (r.slot, r.at))
    assert_even([(r.source, r.words_to - r.words_from) for r in rows], 8 * M.MIN_BLOCK)
    taken, at, ranks = Counter(), 0, Counter()
    for k, r in enumerate(rows):
        # A slot is one block of one source, without gaps, and a source's slots follow their ranks.
        new = k == 0 or rows[k - 1].slot != r.slot
        assert new or (rows[k - 1].source, rows[k - 1]["rank"]) == (r.source, r["rank"])
        assert r.at == (0 if new else at) and r["rank"] == ranks[r.source] - (not new)
        at, taken[r.id] = r.at + r.words_to - r.words_from, taken[r.id] + r.words_to - r.words_from
        ranks[r.source] += new
    assert dict(taken) == {r.id: r.taken for r in M.mix(docs).collect() if r.taken}


def test_mixed_documents_stand_in_the_order_of_the_mix(spark, tmp_path):
    docs = three_sources(spark)
    M.mixed_documents(docs, slot_col="slot").write.parquet(f"{tmp_path}/m")
    files = sorted(f for f in (tmp_path / "m").iterdir() if f.name.startswith("part"))
    got = [r for f in files for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert [r.slot for r in got] == sorted(r.slot for r in got)
    # Beside the schedule's, a document that runs over the slots of its beginning.
    assert_even([(r.source, size(r.text)) for r in got], 8 * M.MIN_BLOCK + 3 * 41)
    assert_even([(r.source, size(r.text)) for r in M.mixed_documents(docs).collect()], 8 * M.MIN_BLOCK + 3 * 41)


def test_plan_has_no_python_and_no_cross_join(spark):
    plan = M.mix(read_table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)
