"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Shingles are five consecutive words (``[^\\x20\\x09-\\x0D]+``, as written),
weighted by their number in the text; a text of one to four words is a single
shingle. The similarity is the probability Jaccard of the weighted shingles,
``J_P = sum over common i of 1 / sum_j max(x_j / x_i, y_j / y_i)``, which is
the Jaccard similarity where weights are equal. Documents of similarity 0.8 or
more are linked, and a class is what links connect.

1. Texts of the same weighted shingles (exact copies among them) are one
   class from the start, by a 128-bit key; only one of them goes on.
2. Signatures: every shingle is a Poisson process of arrivals at a rate of its
   weight, each arrival hitting a random register; a register keeps its first
   arrival. A shingle stops once its next arrival is later than all registers
   of its text (early termination). Registers agree with probability ``J_P``.
3. Banding: ``BANDS`` bands of ``ROWS`` registers; a pair at 0.8 shares no
   bucket with probability below 1e-5.
4. Star round: in each bucket, members are checked against one leader, the
   member met in most buckets (the original rather than a variant). Pairs
   whose registers agree on less than ``ESTIMATE`` are far below 0.8 (five
   standard deviations); the rest are verified exactly.
5. Rest round: only buckets whose members are still in different components
   are looked at again, in blocks of bounded size, each pair across components
   once. A block compares the shingles of such pairs itself, the likeliest
   first, skips those whose components have met, and returns links only. So no
   group of copies is expanded into all its pairs, and no link between
   different components is given up.

Nothing is collected but counts. Hot keys are met by partial aggregation and
by joins that Spark can split; rows are numbered once in a written table.

Edge cases: null and empty texts have no shingles and are classes of their
own. Null ids sort last within a class. Repeated rows are copies. Columns of
the input stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm import words as W
from vicinity.llm.common import components, free_name, map_texts, quoted, ship, small_or_shuffled, sorted_runs
from vicinity.session import materialize
from vicinity.sources.points import read_table

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
ESTIMATE = 0.6
BLOCK = 256
_U = np.uint64
_BAND = W.stream(BANDS, 21)
_REGISTER = W.stream(ROWS, 22) | _U(1)
_ROUND = W.stream(1 << 14, 23)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, hash, weight)`` of the distinct shingles of each text, sorted by text and hash."""
    hashes, first = W.word_hashes(data, offsets)
    owner = W.owners(first)
    h, at = W.windows(hashes, owner, WORDS)
    text = owner[at]
    n_words = np.diff(first)
    for k in range(1, WORDS):
        few = np.flatnonzero(n_words == k)
        if len(few):
            with np.errstate(over="ignore"):
                one = sum((hashes[first[few] + j] * W.PLACE_IN_WINDOW[j] for j in range(k)), np.zeros(len(few), _U))
                h, text = np.concatenate([h, W.mix(one + _U(k))]), np.concatenate([text, few])
    if not len(h):
        return text, h, np.empty(0, np.int64)
    order = np.argsort(h, kind="stable")
    narrow = text[order].astype(np.uint16 if len(offsets) < 1 << 16 else np.int64)
    order = order[np.argsort(narrow, kind="stable")]
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    return text[start], h[start], np.diff(np.append(start, len(h)))


def signatures(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash registers (``n`` x ``REGISTERS`` shingle hashes) of the weighted shingles of ``n`` texts."""
    due = np.full(n * REGISTERS, np.inf)
    held = np.zeros(n * REGISTERS, _U)
    t, rate = np.zeros(len(h)), weight.astype(float)
    live_h, live_text, k = h, text, 0
    with np.errstate(over="ignore"):
        while len(live_h):
            salt = _ROUND[k & 16383] + _U(k >> 14)
            draw = W.mix(live_h ^ salt)
            t = t - np.log1p(-(draw >> _U(11)).astype(float) * 2.0**-53) / rate
            place = live_text * REGISTERS + (W.mix(draw + salt) % _U(REGISTERS)).astype(np.int64)
            hit = np.flatnonzero(t < due[place])
            hit = hit[np.argsort(-t[hit], kind="stable")]  # the earliest is written last
            due[place[hit]] = t[hit]
            held[place[hit]] = live_h[hit]
            latest = due.reshape(n, REGISTERS).max(axis=1)
            on = np.flatnonzero(t < latest[live_text])
            t, rate, live_h, live_text = t[on], rate[on], live_h[on], live_text[on]
            k += 1
    return held.reshape(n, REGISTERS)


def _sketch(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
    data, offsets = W.utf8(texts)
    for lo, hi in W.slices(offsets):
        n = hi - lo
        text, h, weight = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        some = np.zeros(n, bool)
        some[text] = True
        reg = signatures(text, h, weight, n)
        with np.errstate(over="ignore"):
            w = weight.astype(_U)
            edge = np.flatnonzero(np.diff(text, prepend=-1))
            key = np.zeros((n, 2), _U)
            for c in range(2):
                if len(edge):
                    key[text[edge], c] = np.add.reduceat(W.mix(W.mix(h + _U(101 + c)) + w * _U(0x9E3779B97F4A7C15)), edge)
            mixed = (reg.reshape(n, BANDS, ROWS) * _REGISTER).sum(axis=2, dtype=_U)
            bands = W.mix(mixed + _BAND)
        keys = pa.array([k.tobytes() if s else None for k, s in zip(key, some, strict=True)], pa.binary())
        sig = pa.array([r.tobytes() for r in (reg & _U(0xFFFFFFFF)).astype(np.uint32)], pa.binary())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.astype(np.int64).ravel()))
        yield lo, hi, [keys, sig, lists]


def _weighted(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
    data, offsets = W.utf8(texts)
    for lo, hi in W.slices(offsets):
        text, h, weight = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        cut = np.searchsorted(text, np.arange(hi - lo + 1))
        w = weight.astype(np.uint32)
        parts = list(zip(cut, cut[1:], strict=False))
        yield lo, hi, [pa.array([h[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([b"" if (w[a:b] == 1).all() else w[a:b].tobytes() for a, b in parts], pa.binary())]


def similarity(ha: np.ndarray, xa: np.ndarray | None, hb: np.ndarray, yb: np.ndarray | None) -> float:
    """``J_P`` of two weighted sets (sorted hashes; weights, or None where all are 1)."""
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    both = hb[at] == ha if len(hb) else np.zeros(len(ha), bool)
    common = int(both.sum())
    if not common:
        return 0.0
    if xa is None and yb is None:
        return common / (len(ha) + len(hb) - common)
    x = np.ones(len(ha)) if xa is None else xa.astype(float)
    y = np.ones(len(hb)) if yb is None else yb.astype(float)
    only_b = np.ones(len(hb), bool)
    only_b[at[both]] = False
    xc, yc = x[both], y[at[both]]
    ratio = xc / yc
    order = np.argsort(ratio, kind="stable")
    r = ratio[order]
    lo = np.searchsorted(r, r, side="left")
    x_from = np.concatenate([np.cumsum(xc[order][::-1])[::-1], [0]])[lo] + x[~both].sum()
    y_below = np.concatenate([[0], np.cumsum(yc[order])])[lo] + y[only_b].sum()
    return float((1 / (x_from / xc[order] + y_below / yc[order])).sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def weights(raw: bytes) -> np.ndarray | None:
        return np.frombuffer(raw, np.uint32) if raw else None

    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = []
        for ha, xa, hb, yb in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
            out.append(similarity(np.frombuffer(ha, _U), weights(xa), np.frombuffer(hb, _U), weights(yb)) >= THRESHOLD - 1e-12)
        keep = np.flatnonzero(np.array(out, bool))
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, REGISTERS)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose registers agree often enough."""
    for batch in batches:
        if batch.num_rows:
            share = (_sigs(batch.column(2)) == _sigs(batch.column(3))).mean(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(share >= ESTIMATE))


def _pairs_across(run: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, row, agreement)`` of near pairs across components in one block of a bucket, each in the first band that it shares only."""
    sig, ids, comp = _sigs(run["sig"]), run["id"].to_numpy(), run["component"].to_numpy()
    own, band, i, j = run["block"].to_numpy(), run["band"][0].as_py(), run["i"][0].as_py(), run["j"][0].as_py()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for lo in range(0, len(left), 32):
        part = left[lo : lo + 32]
        same = sig[part][:, None, :] == sig[right][None, :, :]
        agree = same.reshape(len(part), len(right), BANDS, ROWS).all(axis=3)
        share = same.mean(axis=2)
        ok = (agree.argmax(axis=2) == band) & (share >= ESTIMATE) & (comp[part][:, None] != comp[right][None, :])
        if i == j:
            ok &= ids[part][:, None] < ids[right][None, :]
        p, q = np.nonzero(ok)
        yield part[p], right[q], share[p, q]


KEYS = ["bucket", "i", "j"]


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each block that have a near partner in another component."""
    for run in sorted_runs(batches, KEYS):
        rows = np.unique(np.concatenate([np.concatenate(x[:2]) for x in _pairs_across(run)] or [np.empty(0, np.int64)]))
        if len(rows):
            yield from run.select([*KEYS, "id", "band", "block", "component", "sig"]).take(pa.array(rows)).combine_chunks().to_batches()


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join components, among the near pairs of each block, the likeliest first.

    A pair whose components have met already is not compared: it cannot change
    a class. So a block gives fewer links than it has components.
    """
    for run in sorted_runs(batches, KEYS):
        found = [np.concatenate(x) for x in zip(*_pairs_across(run), strict=True)]
        if not found or not len(found[0]):
            continue
        h = [np.frombuffer(x, _U) for x in run["h"].to_pylist()]
        w = [np.frombuffer(x, np.uint32) if x else None for x in run["w"].to_pylist()]
        ids, root = run["id"].to_pylist(), {}
        comp = run["component"].to_pylist()

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        out = []
        for k in np.lexsort((found[1], found[0], -found[2])).tolist():
            a, b = int(found[0][k]), int(found[1][k])
            x, y = top(comp[a]), top(comp[b])
            if x != y and similarity(h[a], w[a], h[b], w[b]) >= THRESHOLD - 1e-12:
                root[max(x, y)] = min(x, y)
                out.append((ids[a], ids[b]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def _sets(ids: DataFrame, texts: DataFrame, row: str, text_col: str) -> DataFrame:
    """Weighted shingles (``h``, ``w``) of the texts whose row is among ``ids``, written."""
    ids = materialize(ids.distinct(), "minhash-ids")
    wanted = texts.join(small_or_shuffled(ids, 16), row, "left_semi")
    return materialize(map_texts(wanted, text_col, "h binary, w binary", _weighted, [row]), "minhash-sets")


def _verified(pairs: DataFrame, texts: DataFrame, row: str, text_col: str) -> DataFrame:
    """The pairs (``a``, ``b`` are row numbers) of similarity 0.8 or more, written."""
    pairs = materialize(pairs, "minhash-pairs")
    sets = _sets(pairs.select(F.col("a").alias(row)).unionAll(pairs.select("b")), texts, row, text_col)
    one = sets.select(F.col(row).alias("a"), F.col("h").alias("ha"), F.col("w").alias("wa"))
    two = sets.select(F.col(row).alias("b"), F.col("h").alias("hb"), F.col("w").alias("wb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "wa", "hb", "wb")
    return materialize(both.mapInArrow(_verify, "a long, b long"), "minhash-links")


def _dealt(placed: DataFrame) -> DataFrame:
    """Members of buckets with several components, once for each pair of blocks that they meet in (``block``, ``other``).

    Pairs within the largest component of a bucket change nothing, so only the
    others are copied to all blocks, and its own members to the others' blocks:
    a stray among any number of copies costs one copy of each.
    """
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    top = F.max(F.struct("k", (-F.col("component")).alias("c")))
    mixed = sizes.groupBy("bucket").agg(top.alias("top"), F.sum("k").alias("all")).where("top.k < all")
    mixed = mixed.select("bucket", (-F.col("top.c")).alias("host"), F.expr(f"cast(ceil(top.k / {BLOCK}) as int)").alias("hosts"), F.expr(f"cast(ceil((all - top.k) / {BLOCK}) as int)").alias("guests"))
    left = placed.join(mixed, "bucket")
    left = left.withColumn("block", F.expr("cast(if(component = host, guests + pmod(xxhash64(id), hosts), pmod(xxhash64(id), guests)) as int)"))
    return left.withColumn("other", F.explode(F.expr("sequence(0, if(component = host, guests, guests + hosts) - 1)")))


def classes(docs: DataFrame, text_col: str = "text", row: str = "_row") -> DataFrame:
    """``(row, class)`` for every row of ``docs``, a written table with a unique long ``row``.

    ``class`` is the smallest row number of what links connect.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(row), F.col(quoted([text_col])[0]).alias("text"))
    sk = materialize(map_texts(texts, "text", "key binary, sig binary, bands array<long>", _sketch, [row]), "minhash-sketches")
    reps = sk.where("key is not null").groupBy("key").agg(F.min(row).alias("id"))
    member = materialize(sk.where("key is not null").select(F.col(row).alias("row"), "key").join(reps, "key").select("row", "id"), "minhash-members")
    one = sk.where("key is not null").join(member.where("row = id").select(F.col("id").alias(row)), row)

    # Buckets with two or more different texts.
    rows = one.select(F.col(row).alias("id"), F.posexplode("bands").alias("band", "bucket"))
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = materialize(rows.join(full, "bucket"), "minhash-buckets")
    met = rows.groupBy("id").agg(F.sum("n").alias("met"))
    led = rows.join(met, "id").groupBy("bucket").agg(F.max(F.struct(F.col("met"), (-F.col("id")).alias("id")))["id"].alias("lead"))
    star = rows.join(led, "bucket").where("id <> -lead").select((-F.col("lead")).alias("a"), F.col("id").alias("b")).distinct()
    sigs = materialize(one.select(F.col(row).alias("id"), "sig").join(met.select("id"), "id", "left_semi"), "minhash-signatures")

    def near(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
        both = with_a.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(_near, "a long, b long")

    links = _verified(near(star), texts, row, "text")
    comp = materialize(components(links), "minhash-components")

    # Buckets that still hold more than one component (two members were a star already).
    placed = rows.where("n > 2").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    left = _dealt(placed).join(sigs, "id")
    left = left.select("bucket", "band", "id", "component", "sig", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    spread = left.repartition(*KEYS).sortWithinPartitions(*KEYS)
    need = "bucket long, i int, j int, id long, band int, block int, component long, sig binary"
    open_rows = materialize(spread.mapInArrow(_needed, need), "minhash-open")
    sets = _sets(open_rows.select(F.col("id").alias(row)), texts, row, "text").withColumnRenamed(row, "id")
    blocks = open_rows.join(sets, "id").repartition(*KEYS).sortWithinPartitions(*KEYS)
    more = materialize(blocks.mapInArrow(_link, "a long, b long"), "minhash-links")
    # What the rest round joins are components: their links go between the first round's roots.
    at = [comp.select(F.col("id").alias(c), F.col("component").alias(f"root_{c}")) for c in ("a", "b")]
    joined = more.join(at[0], "a", "left").join(at[1], "b", "left")
    last = components(joined.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    placed = member.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = placed.join(last.select(F.col("id").alias("component"), F.col("component").alias("class")), "component", "left")
    placed = placed.select("row", F.coalesce("class", "component").alias("class"))
    return placed.unionAll(sk.where("key is null").select(F.col(row), F.col(row))).toDF("row", "class")


def _numbered(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """``docs`` written once with a unique row number (the same rows keep it after a lost executor)."""
    row = free_name(docs, "_row")
    return materialize(docs.select(*quoted(keep), F.monotonically_increasing_id().alias(row)), "minhash-input"), row


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row number, id, class_id, kept)`` of every document.

    ``class_id`` is the smallest id of the class; the row that has it (the
    first such row, if it repeats) is ``kept``.
    """
    tagged, row = _numbered(docs, list(dict.fromkeys([id_col, text_col])))
    return _judged(tagged, row, id_col, text_col)


def _judged(tagged: DataFrame, row: str, id_col: str, text_col: str) -> DataFrame:
    found = classes(tagged, text_col, row)
    ids = tagged.select(F.col(row).alias("row"), F.col(quoted([id_col])[0]).alias("id"))
    placed = materialize(found.join(ids, "row"), "minhash-classes")
    first = placed.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("first"))
    return placed.join(first, "class").select("row", "id", F.col("first.id").alias("class_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class of near duplicates, with the columns of ``docs``."""
    tagged, row = _numbered(docs, docs.columns)
    gone = materialize(_judged(tagged, row, id_col, text_col).where(~F.col("kept")).select(F.col("row").alias(row)), "minhash-dropped")
    return tagged.join(small_or_shuffled(gone, 16), row, "left_anti").select(*quoted(docs.columns))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", "kept")
