import re
import time
from collections import Counter

import pytest

from tests.llm import hostile
from vicinity.llm import quality as Q
from vicinity.sources.points import read_table

SF = "/root/testdata/sf0.001"


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(wins)
    covered = {i + j for i, x in enumerate(wins) if n[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stats = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    upper, lower = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
    letters = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7F]", x)) for x in w)
    bad = (
        100 * stats[2] > 10 * len(w) or 100 * stats[3] > 50 * len(lines) or stats[1] < 2 * len(w) or stats[1] > 15 * len(w)
        or 100 * t.count("!") > 30 * len(w) or upper > lower or 100 * letters < 50 * len(w)
    )
    return (*stats, failed, not failed and not bad)


COLS = [*Q.STATS, "base_failed", "kept"]


@pytest.mark.parametrize("source", ["hostile", "documents"])
def test_equals_brute_force(spark, source):
    docs = hostile.docs(spark) if source == "hostile" else read_table(spark, SF, "documents")
    got = sorted((r.text or "", *[r[c] for c in COLS]) for r in Q.quality(docs).collect())
    want = sorted((r.text or "", *brute(r.text)) for r in docs.collect())
    assert got == want


def test_clashing_names_and_columns(spark):
    df = hostile.clashing(spark, "kept", "_text", "N_WORDS")
    out = Q.quality(df)
    assert [c for c in out.columns if c.lower() == "kept"] == ["kept"] and dict(out.dtypes)["kept"] == "boolean"
    assert {"_text", "doc_id", "source"} <= set(out.columns) and "N_WORDS" not in out.columns
    assert out.count() == df.count()


def test_empty_table(spark):
    assert Q.quality(hostile.empty(spark)).collect() == []


def test_cascade_goes_by_rejection_per_cost(spark):
    rows = [(i, " ".join(f"word{k}{'!!' if i % 2 else ''}" for k in range(60))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r.name for r in Q.plan_cascade(df, sample_rows=10_000)]
    assert order[0] == "bangs" and sorted(order) == sorted(r.name for r in Q.RULES)
    # What rejects nothing follows, the cheapest first: rules over counted statistics before those over bytes.
    assert order[-1] == "letter_words"
    assert {(r.doc_id % 2, r.rejected_by) for r in Q.quality(df).collect()} == {(1, "bangs"), (0, None)}


def test_a_slow_rule_moves_back(spark):
    def slow(t):
        time.sleep(0.05)
        return t.stats["n_words"] % 2 == 0

    quick = Q.Rule("quick", lambda t: t.stats["n_words"] % 2 == 0)
    df = spark.createDataFrame([(i, " ".join(f"word{k}" for k in range(60 + i % 5))) for i in range(100)], "doc_id long, text string")
    for rules in ((Q.Rule("slow", slow), quick), (quick, Q.Rule("slow", slow))):
        assert [r.name for r in Q.plan_cascade(df, rules=rules, sample_rows=10_000)] == ["quick", "slow"]


def test_verdict_does_not_depend_on_the_order(spark):
    df = read_table(spark, SF, "documents")
    kept = [sorted(r.doc_id for r in Q.quality(df, rules=rules).where("kept").collect()) for rules in (Q.RULES, Q.RULES[::-1])]
    assert kept[0] == kept[1]


def test_one_slow_run_does_not_move_a_rule_back(spark):
    runs = []

    def hiccup(t):
        runs.append(1)
        if len(runs) == 1:
            time.sleep(0.2)
        return t.stats["n_words"] % 2 == 0

    def steady(t):
        time.sleep(0.02)
        return t.stats["n_words"] % 2 == 0

    df = spark.createDataFrame([(i, "word " * (60 + i % 2)) for i in range(50)], "doc_id long, text string").coalesce(1)
    rules = (Q.Rule("steady", steady), Q.Rule("hiccup", hiccup))
    assert [r.name for r in Q.plan_cascade(df, rules=rules, sample_rows=10_000)] == ["hiccup", "steady"]
