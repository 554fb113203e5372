import hashlib
from collections import Counter, defaultdict

import corpus_pipeline as C
from tests.llm import hostile, test_bpe, test_minhash, test_mixing, test_pii, test_quality
from vicinity.sources.points import read_table

SF = "/root/testdata/sf0.001"


def redacted(text):
    spans, out, at = sorted((a, b, k) for k, a, b in test_pii.brute(text)), [], 0
    merged = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2])
        else:
            merged.append((a, b, k))
    for a, b, k in merged:
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def check_mix(before, after):
    sizes, taken, texts = defaultdict(int), Counter(), defaultdict(list)
    for r in before:
        sizes[r.source] += test_mixing.size(r.text)
        texts[(r.doc_id, r.source)].append(r.text)
    want = test_mixing.brute_targets(dict(sizes))
    for r in after:
        taken[r.source] += test_mixing.size(r.text)
        # A copy of the document, or its beginning.
        assert any(t is not None and (t == r.text or t.startswith(r.text)) for t in texts[(r.doc_id, r.source)])
        if r.text not in texts[(r.doc_id, r.source)]:
            assert r.n_chars == len(r.text)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert max(Counter((r.doc_id, r.source, r.text) for r in after).values()) <= 3


def test_stages_equal_brute_force(spark, tmp_path):
    docs, columns = read_table(spark, SF, "documents"), read_table(spark, SF, "documents").columns
    rows = {}
    for k, (name, stage) in enumerate(C.STAGES):
        rows[name] = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(C.STAGES) - 1 or (docs.columns, docs.dtypes) == (columns, read_table(spark, SF, "documents").dtypes)
    start, rated, single, clean, mixed = (rows[n] for n, _ in C.STAGES)
    assert sorted(rated) == sorted(r for r in start if test_quality.brute(r.text)[-1])
    classes = test_minhash.brute([(r.doc_id, r.text) for r in rated])
    assert sorted(single) == sorted(r for r in rated if classes[r.doc_id] == r.doc_id)
    assert sorted((r.doc_id, r.text) for r in clean) == sorted((r.doc_id, redacted(r.text)) for r in single)
    check_mix(clean, mixed)
    want = Counter((r.doc_id, hashlib.sha256(" ".join(map(str, test_bpe.ids(r.text))).encode()).hexdigest()) for r in mixed)
    assert Counter((r.doc_id, r.ids_sha256) for r in docs.collect()) == want


def test_hostile_documents_pass_every_stage(spark):
    """Each stage on its own input, clashing columns included."""
    docs = hostile.clashing(spark, "kept", "ids", "spans", "_row", "taken", "size")
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        out.collect()
        assert name == "bpe" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_stage_order():
    assert [n for n, _ in C.STAGES] == ["quality", "near_dedup", "pii", "mixing", "bpe"] and C.ORACLE_SQL is None
