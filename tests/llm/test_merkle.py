import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import hostile
from vicinity.llm import merkle as M
from vicinity.sources.points import read_table

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """All levels above ``nodes``."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        i //= 8
    return out


def brute(rows):
    """``(id, leaf, subroot, root, proof, folded, verified)`` of rows ``(doc_id, text, lang, source, n_chars)``."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = h(*map(field, (doc_id, source, lang, n_chars, text)))
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        seen = h(*map(field, (doc_id, source, lang, n_chars, low))) if bad else leaf
        groups.setdefault(lang, []).append((doc_id, leaf, seen))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = climb([x[1] for x in groups[g]])
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (doc_id, leaf, seen) in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(top, k)
            node = seen
            for left, right in path:
                node = h(left, node, right)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], h(*[s for p in path for s in p]), node, node == top[-1][0]))
    return out


def result(docs):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    low = M.leaf([F.translate("text", M._UPPER, M._LOWER) if c == "text" else F.col(c) for c in M.COLUMNS])
    m = M.manifest(docs, carry={"seen": F.when(tampered, low)}).withColumn("end", M.fold(F.coalesce("seen", "leaf"), F.col("path")))
    rows = m.select("id", "leaf", "subroot", "root", M.proof_digest(F.col("path")).alias("p"), "end", (F.col("end") == F.col("root")).alias("ok")).collect()
    return sorted(map(tuple, rows), key=repr)


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = sorted(brute(rows), key=repr)
    assert result(docs) == want
    return want


def test_equals_brute_force(spark):
    want = check(read_table(spark, SF, "documents"))
    assert {x[-1] for x in want} == {True, False}


def test_hostile_documents(spark):
    check(hostile.docs(spark))
    check(hostile.clashing(spark, "g", "node", "pos", "path", "root", "members"))
    assert result(hostile.empty(spark)) == []


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 512, 513, 4096, 4097])
def test_sizes_around_full_runs_and_blocks(spark, n):
    check(spark.range(n).selectExpr("id * 3 as doc_id", "concat('Text ', id) as text", "'en' as lang", "'s' as source", "5L as n_chars"))


def test_many_groups_and_one_hot(spark):
    lang = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('l', id % 700) END"
    check(spark.range(3000).selectExpr("id as doc_id", "concat('T', id) as text", f"{lang} as lang", "CAST(NULL AS STRING) as source", "id as n_chars"))


def test_a_changed_text_shows_and_only_there(spark):
    docs = read_table(spark, SF, "documents")
    seen = M.leaf([F.concat("text", F.lit("!")) if c == "text" else F.col(c) for c in M.COLUMNS])
    m = M.manifest(docs, carry={"seen": F.when(F.col("doc_id") == 7, seen)})
    bad = m.where(M.fold(F.coalesce("seen", "leaf"), F.col("path")) != F.col("root")).select("id").collect()
    assert [r.id for r in bad] == [7]
