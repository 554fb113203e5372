import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm import hostile
from vicinity.llm import langid as L
from vicinity.sources.points import read_table

SF = "/root/testdata/sf0.01"


def test_windows_hold_every_byte():
    texts = [b"", b"a" * 127, b"b" * 128, b"c" * 300]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    windows, first = L.cut(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert first.tolist() == [0, 0, 1, 2, 5]
    for i, t in enumerate(texts):
        assert windows[first[i] : first[i + 1]].tobytes().rstrip(b"\0") == t


def plain_log_probs(net, window):
    """The network by its definition, place by place."""
    pooled = []
    for f in net.filters:
        w = len(f)
        values = [sum(f[j][window[p + j]].astype(float) for j in range(w)) for p in range(L.WINDOW - w + 1)]
        pooled.append(np.max(values, axis=0))
    z = np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.out.astype(float) + net.out_bias
    return z - z.max() - np.log(np.exp(z - z.max()).sum())


def test_network_equals_its_definition():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (600, L.WINDOW)).astype(np.uint8)
    net = L.train(windows, rng.integers(0, 3, 600), ["a", "b", "c"])
    got = net.log_probs(windows[:20], net.pairs())
    want = np.array([plain_log_probs(net, w) for w in windows[:20]])
    assert np.allclose(got, want, atol=1e-4)


def test_held_out_accuracy(spark):
    got = L.op11_language(spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r.doc_id: (r.lang, r.text) for r in read_table(spark, SF, "documents").collect()}
    rows = got.collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    for name in ({x[0] for x in truth.values()} - {None}):
        held = [r for r in rows if r.held_out and truth[r.doc_id][0] == name]
        right = sum(r.lang_pred == name for r in held)
        assert right >= 0.97 * len(held), (name, right, len(held))


def test_labels_of_the_held_out_fold_and_other_columns_play_no_part(spark):
    docs = read_table(spark, SF, "documents").limit(300)
    held = L.remainder(F.col("doc_id")) == 0
    net = L.fit(docs.where(~held))
    spoilt = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s")).withColumn("doc_id", F.col("doc_id"))
    other = L.fit(spoilt.where(~held))
    assert net.langs == other.langs and all(np.array_equal(a, b) for a, b in zip(net.filters, other.filters, strict=True))


def test_hostile_documents(spark):
    docs = hostile.clashing(spark, "lang_pred", "_read", "SCORE")
    net = L.fit(docs)
    out = L.predict(docs, net)
    assert out.count() == docs.count() and {"_read", "doc_id", "lang"} <= set(out.columns)
    for r in out.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (r.score == 0) == (not letters)
        assert not letters or r.lang_pred == "en"  # the only label


def test_no_labels_and_empty_table(spark):
    docs = hostile.docs(spark)
    assert L.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {(r.lang_pred, r.score) for r in L.predict(docs, None).collect()} == {("und", 0.0)}
    assert L.fit(hostile.empty(spark)) is None and L.predict(hostile.empty(spark), None).collect() == []


def test_short_and_long_texts_of_one_language_agree(spark):
    en = "the house of the old man and the sea that was in the wind with them "
    de = "das haus von dem alten mann und die see und der wind mit den kindern ist nicht "
    rows = [(f"{t * (1 + i % 4)} {i}", n) for i in range(200) for t, n in ((en, "en"), (de, "de"))]
    net = L.fit(spark.createDataFrame(rows, "text string, lang string"))
    probe = spark.createDataFrame([(en[:20], "en"), (de[:20], "de"), (en * 3000, "en"), (de * 3000, "de")], "text string, lang string")
    assert all(r.lang == r.lang_pred for r in L.predict(probe, net).collect())
