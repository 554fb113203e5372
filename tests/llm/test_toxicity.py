import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import hostile
from vicinity.llm import toxicity as X
from vicinity.sources.points import read_table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_folds(spark):
    labels = {r.doc_id: r.toxic for r in read_table(spark, SF, "labels").collect()}
    rows = X.op9_toxicity(spark, SF).collect()
    assert len(rows) == read_table(spark, SF, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.92
    toxic = [r.score for r in held if labels[r.doc_id]]
    clean = [r.score for r in held if not labels[r.doc_id]]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.9


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean words, and stems that only toxic texts use (in held-out texts with endings not seen before)."""
    words = ["stone", "river", "garden", "letter", "winter", "market", "window", "yellow"]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(words[(i * k + k) % 8] for k in range(1, 30))
        toxic = i % 4 == 0
        if toxic:
            ending = "zq" if zlib.crc32(str(i).encode()) % 5 == 0 else ["a", "en", "os"][i % 3]
            text += f" gruk{ending}, Gruk{ending}! "
        rows.append((i, text))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_stems_generalise_and_both_paths_agree(spark, corpus):
    docs, labels = corpus
    known = {r.doc_id: r.toxic for r in labels.collect()}
    one = {r.id: r.score for r in X.score_toxicity(docs, labels).collect()}
    two = {r.id: r.score for r in X.score_toxicity(docs, labels, limit=0).collect()}
    assert one == two
    assert all((s >= 0.5) == bool(known[i]) for i, s in one.items())


def test_held_out_labels_are_not_used(spark, corpus):
    docs, labels = corpus
    turned = labels.withColumn("toxic", F.when(X.remainder(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.id: r.score for r in X.score_toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_cross_fit_looks_at_no_held_out_label(spark, corpus):
    docs, labels = corpus
    held = X.remainder(F.col("doc_id")) == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (X.cross_fit(docs, x, [20.0], [1.5, 3.0]) for x in (labels, turned))
    assert one == two and set(one) == {(20.0, 1.5), (20.0, 3.0)} and all(0 <= v < 0.7 for v in one.values())


def test_words_of_every_labelled_remainder_count(spark, corpus):
    """A toxic stem met in remainder 1 alone is known."""
    docs, labels = corpus
    rows = [(1000 + i, "stone river blarg blarg blarg") for i in range(200)]
    ones = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 1]
    more = docs.unionAll(spark.createDataFrame([*ones, (5000, "stone river blarg blarg blarg")], docs.schema))
    known = labels.unionAll(spark.createDataFrame([(i, 1) for i, _ in ones], labels.schema))
    assert {r.id: r.score for r in X.score_toxicity(more, known).collect()}[5000] >= 0.5


def test_model_equals_brute_force(spark):
    texts = [("the cat sat", 0), ("the hat", 0), ("bad hat", 1), ("bad bat", 1), (None, 1), ("", 0)]
    n = (Counter(), Counter())
    for t, k in texts:
        for w in re.findall(r"[^\W\d_]+", t or ""):
            s = X.PAD * 4 + w + X.END
            n[k].update(s[i : i + 5] for i in range(len(s) - 4))
    seen = set(n[0]) | set(n[1])
    lower, level = [], seen
    for _ in range(4):
        c = Counter(g[1:] for g in level)
        lower.append(c)
        level = set(c)

    def shared(gram):
        c = lower[4 - len(gram)]
        under = [g for g in c if g[:-1] == gram[:-1]]
        below = shared(gram[1:]) if len(gram) > 1 else 1 / (len(under) + 1)
        return (c[gram] - X.DISCOUNT + X.DISCOUNT * len(under) * below) / sum(c[g] for g in under)

    def log_p(gram, k):
        mine, both = [g for g in n[k] if g[:4] == gram[:4]], [g for g in seen if g[:4] == gram[:4]]
        total = sum(n[0][g] + n[1][g] for g in both)
        pooled = (n[0][gram] + n[1][gram] - X.DISCOUNT + X.DISCOUNT * len(both) * shared(gram[1:])) / total
        own = sum(n[k][g] for g in mine)
        return math.log((max(n[k][gram] - X.DISCOUNT, 0) + (X.STRENGTH + X.DISCOUNT * len(mine)) * pooled) / (own + X.STRENGTH))

    X.ship(spark)
    got = {r.gram: r.llr / X.UNIT for r in X.model(spark.createDataFrame(texts, "text string, toxic int")).collect()}
    assert {g for g in got if len(g) == 5} == seen
    for g in seen:
        assert got[g] == pytest.approx(log_p(g, 1) - log_p(g, 0), abs=1e-6)
    by = defaultdict(list)
    for g in seen:
        by[g[:4]].append(g)
    for h, gs in by.items():
        left = [(X.STRENGTH + X.DISCOUNT * sum(n[k][g] > 0 for g in gs)) / (sum(n[k][g] for g in gs) + X.STRENGTH) for k in (0, 1)]
        assert got[h] == pytest.approx(math.log(left[1] / left[0]), abs=1e-6)


def test_hostile(spark):
    docs = hostile.clashing(spark, "score", "llr", "toxic")
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None), (99, 1), (6, 0), (13, 0), (14, 1), (9, 0), (9, 0)], "doc_id long, toxic int")
    for limit in (0, X.BROADCAST_SCORES):
        rows = X.score_toxicity(docs, labels, limit=limit).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in X.score_toxicity(docs, none).collect()} == {0.5}
    assert X.score_toxicity(hostile.empty(spark), labels).collect() == []


def test_both_models_come_out_of_the_same_jobs(spark, corpus):
    """Scoring took 89 jobs of 159 stages, and the driver kept the plans of all of them."""
    docs, labels = corpus
    spark.sparkContext.setJobGroup("toxicity-jobs", "jobs of one scoring")
    try:
        X.score_toxicity(docs, labels)
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("toxicity-jobs")) <= 65
    texts = docs.join(labels, "doc_id").withColumn("fold", (F.col("doc_id") % 3 != 0).cast("int"))
    both = X._models(texts, X.STRENGTH, 2)
    for m in (0, 1):
        alone = X.model(texts.where(F.col("fold") >= m).select("text", F.col("toxic").cast("int").alias("toxic")))
        assert {(r.gram, r.llr) for r in X._scores_of(both, m).collect()} == {(r.gram, r.llr) for r in alone.collect()}
