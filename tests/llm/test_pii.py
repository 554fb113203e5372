import re

import pytest
from pyspark.sql import functions as F

from tests.llm import hostile
from vicinity.llm import pii as P
from vicinity.sources.points import read_table

SF = "/root/testdata/sf0.001"
PLAIN = {k: re.compile(v, re.ASCII) for k, v in P.PLAIN.items()}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text or ""):
            t, d = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in t.split(".")),
                "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


CASES = [
    "a@b.com", "a@b.com_x@c.de x@y", "..@-.-", "1.2.3.4.5.6.7.8 999.1.1.1 0000000000000255.1.1.1", "+1 (017) 555-7713 +1 ((( +12",
    "4111 1111 1111 1111, 4111-1111-1111-1111 12345678901234567890", "é日本𝒳 a@b.co 𝒳 1.2.3.4", "a@b@c.d.e", "1" * 5000, "1 " * 3000,
    "a." * 3000 + "@" + "b." * 3000 + "c", "+" * 500 + "1" * 9, "a@b.c@d.e", "1.2.3.4." * 500, "x@y.z " * 500, "256.1.1.1 00.00.00.00 1.2.3.400",
]


def base(spans):
    return [(s.kind, s.start, s.end) for s in spans if s.base]


def test_base_spans_equal_brute_force(spark):
    df = hostile.docs(spark).unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(CASES)], "doc_id long, text string"), allowMissingColumns=True)
    for r in P.find(df).collect():
        assert base(r.spans) == brute(r.text), r.text[:80]


def test_documents_equal_brute_force(spark):
    for r in P.find(read_table(spark, SF, "documents")).collect():
        assert base(r.spans) == brute(r.text)


@pytest.fixture(scope="module")
def corpus(spark):
    """Numbers and addresses with and without cues, and matches that fail their check."""
    rows = [f"call me on phone (555) 234-{1000 + i} today" for i in range(30)] + [f"mail bob{i} (at) example (dot) com" for i in range(20)]
    rows += [f"isbn 111 111 {1000 + i}, order 012 012 {1000 + i}" for i in range(40)] + [f"version 999.{i}.300.1 of 1234567890123{i}" for i in range(40)]
    rows += [f"write to user{i}@mail.example.com or phone +1 (222) 333-{4000 + i}" for i in range(30)] + ["plain words without any data at all"] * 30
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_method_adds_spans_with_evidence_only(spark, corpus):
    kinds = {}
    for r in P.find(corpus).collect():
        assert base(r.spans) == brute(r.text)
        for s in r.spans:
            if not s.base:
                kinds.setdefault(s.kind, []).append(r.text[s.start : s.end])
    assert len(kinds["phone_local"]) == 30 and all(t.startswith("(555)") for t in kinds["phone_local"])
    assert "name" not in kinds


def test_em_rates_a_noisy_labeler_below_a_good_one():
    counts = {("ip", "11-", "123c"): 90, ("ip", "00-", "333c"): 90, ("ip", "10-", "123c"): 2, ("phone_local", "01-", "224c"): 2}
    scores = P.learn(counts)
    assert scores["ip|11-|123c"] > 0.9 > 0.1 > scores["ip|00-|333c"]
    assert P.learn({}) == {}


def test_redaction(spark):
    long = "word " * 3000 + "a@b.com " + "é𝒳 " * 3000 + "1.2.3.4 end"
    rows = [(1, "to a@b.com, 1.2.3.4!", 20), (2, None, 0), (3, "", 0), (4, long, len(long)), (5, "card +4111 1111 1111 1111 x", 9), (6, "nothing here", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in P.redact(df).collect()}
    assert got[1].text == "to <EMAIL>, <IP>!" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "" and got[6].n_chars == 12
    assert got[4].text == long.replace("a@b.com", "<EMAIL>").replace("1.2.3.4", "<IP>") and got[4].n_chars == len(got[4].text)
    assert "4111" not in got[5].text


def test_hostile_columns_and_empty(spark):
    df = hostile.clashing(spark, "spans", "_pii_text", "_pii_email")
    out = P.find(df)
    assert out.columns.count("spans") == 1 and {"_pii_text", "_pii_email", "doc_id"} <= set(out.columns) and out.count() == df.count()
    assert P.redact(df).columns == df.columns and P.redact(df).count() == df.count()
    assert P.find(hostile.empty(spark)).collect() == [] and P.redact(hostile.empty(spark)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = P.find(read_table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_given_tables_hold_no_candidate_of_an_added_kind(spark, sf):
    """What the SQL of ``op2_pii`` stands on, whatever scores a corpus gives."""
    found, names = P.candidates(read_table(spark, f"/root/testdata/{sf}", "documents"))
    assert found.where(" OR ".join(f"size(`{names[k]}`) > 0" for k in P.ADDED)).count() == 0


def test_a_piece_of_a_failed_phone_number_is_no_local_number(spark):
    texts = ["call +1 (415) 555-2671-0000-1111-22 now", "call (415) 555-2671 now", "call +1 (415) 555-2671 now"]
    found, names = P.candidates(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert {r.doc_id: r.n for r in found.select("doc_id", F.size(names["phone_local"]).alias("n")).collect()} == {0: 0, 1: 1, 2: 0}
