"""Phrase collocations by SETM relational mining.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words
``[^\\x20\\x09]+``. SETM keeps, for every phrase length k, the relation R_k of all
occurrences of frequent phrases, sorted by position, and

1. joins it with itself on piece and adjacent position: a phrase that starts at
   p and one that starts at p + 1 of the same piece overlap in all but their outer words, and
   make one of k + 1 words;
2. groups the joined occurrences by phrase and counts them;
3. semi-joins the occurrences with the frequent groups (at least ``MIN_COUNT``),
   which gives R_{k+1}, written before the next length.

A phrase of k + 1 words is the pair (its first k words, its last k words), both
of them frequent, so ids stay two numbers wide at any length and counts are exact.

Layout: R_k is a table with a row for each segment (whole texts of together
about ``SEGMENT_BYTES``, or one longer text) that holds the segment's occurrences as
two arrays: positions, ascending (kept as steps from one to the next), and phrases. A piece's words have
consecutive positions and pieces are one position apart, so the merge-join on
(piece, position + 1) compares neighbours in the sorted arrays. A segment gives
one row per distinct pair with its count, which Spark sums over all segments; a
pair has at most one row a segment, so no key is hot. Counted things are not rows of
Spark: a task's words, and its pairs as mixed numbers, are dealt to buckets by hash, and a
bucket's share of a task is one packed row. For the semi-join, the
frequent words and pairs go to the tasks if their counted size allows (``BROADCAST_BYTES``);
beyond, the segments' pairs are joined with them, and the ids that
survive meet their segment in a co-group. Both keep the same occurrences.

Scores: for a phrase with count a, cut after its first k words, l and r are the
counts of the two parts and n all words of the language; the score is the least
``floor(1000 a n / (l r))`` over the cuts, ties to the smallest k, in 38-digit decimals.
A phrase within a longer candidate of at least ``COVER`` percent of its count is
dropped. It is enough to look one word further: what lies between the two has
a count between theirs.

Edge cases: null and empty texts have no words; a null language is ``und``, and
so is one of that name; repeated rows count as often as they occur; a text of any
length is one segment with all its words; an empty table gives no rows. Ids and
extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.llm import words as W
from vicinity.llm.common import quoted, ship, small_or_shuffled
from vicinity.session import DROP_SHUFFLES, GROUP_LIMIT_CONF, allow_group_limit, materialize, scratch_path, session_conf
from vicinity.sources.points import number_rows, read_table

MIN_COUNT, MAX_WORDS, COVER, TOP = 100, 5, 100, 2_000
SEGMENT_BYTES = 4 << 20
#: Words of the segments, and occurrences of phrases, that a bucket holds about; occurrences that a task counts at once.
BUCKET_WORDS, BUCKET_PAIRS, COUNTED = 500_000, 2_000_000, 4_000_000
#: Frequent phrases are sent to the tasks up to this many bytes; beyond, segments are joined with them.
BROADCAST_BYTES = 32 << 20
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True

#: Columns of R_k, a row a segment: int32 steps between positions, int32 places in ``grams``, and the int64 ids there.
RELATION = "seg long, step binary, code binary, grams binary"


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``(positions, words, texts)`` of all words; positions skip one between pieces."""
    inside = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = inside & np.concatenate([[True], ~inside[:-1]]) if len(data) else inside
    begin |= inside & edge[:-1]
    starts = np.flatnonzero(begin)
    # Breaks before a word, text ends among them: a new piece starts where their number has grown.
    breaks = np.cumsum(_BREAK[data].astype(np.int64) + edge[:-1])[starts] if len(starts) else starts
    new = np.concatenate([[0], (np.diff(breaks) > 0).astype(np.int64)]) if len(starts) else starts
    pos = np.arange(len(starts)) + np.cumsum(new)
    kept = np.concatenate([[0], np.cumsum(inside)])
    ends = np.concatenate([kept[starts], kept[-1:]]).astype(np.int32 if kept[-1] < 2**31 else np.int64)
    raw = pa.py_buffer(_LOWER[data[inside]])
    kind = pa.binary() if ends.dtype == np.int32 else pa.large_binary()
    found = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(ends), raw])
    return pos, found, np.searchsorted(offsets, starts, side="right") - 1


def _bytes(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array([np.ascontiguousarray(values, kind).tobytes()], pa.binary())


def _steps(pos: np.ndarray) -> pa.Array:
    return _bytes(np.diff(pos, prepend=0), "<i4")


#: Columns of a segment: its occurrences, the distinct keys of language and word (bytes, int32 edges, int64 counts), and words per language.
SEGMENT = "step binary, code binary, keys binary, edges binary, n binary, kinds long, totals array<struct<lang: string, n: bigint>>"


def _key(lang: pa.Array, word: pa.Array) -> pa.Array:
    """Language and word as one value: no word holds a line feed."""
    return pc.binary_join_element_wise(lang.cast(pa.binary()), word.cast(pa.binary()), b"\n")


def _raw(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all keys end to end, and ``len(keys) + 1`` edges."""
    _, edges, data = keys.buffers()
    edges = np.frombuffer(edges, "<i4")[keys.offset : keys.offset + len(keys) + 1] if len(keys) else np.zeros(1, "<i4")
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[edges[0] : edges[-1]], edges - edges[0]


def _binaries(edges: np.ndarray, raw: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, "<i4")), pa.py_buffer(np.ascontiguousarray(raw))])


def _segments(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``SEGMENT`` of every segment."""

    def segment(texts: list[pa.Array], langs: list[pa.Array]) -> pa.RecordBatch:
        data, offsets = W.utf8(pa.chunked_array(texts))
        pos, found, owner = occurrences(data, offsets)
        lang = pa.concat_arrays(langs).dictionary_encode()
        word = found.dictionary_encode()
        n_lang = max(len(lang.dictionary), 1)
        spoken = lang.indices.to_numpy(zero_copy_only=False)[owner]
        both = word.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_lang + spoken
        keys, code, n = np.unique(both, return_inverse=True, return_counts=True)
        # Frequent words first: small numbers pack well.
        order = np.argsort(-n, kind="stable")
        keys, n, code = keys[order], n[order], np.argsort(order)[code]
        raw, edges = _raw(_key(lang.dictionary.take(pa.array(keys % n_lang)), word.dictionary.take(pa.array(keys // n_lang))))
        totals = np.bincount(spoken, minlength=len(lang.dictionary))
        totals = pa.StructArray.from_arrays([lang.dictionary, pa.array(totals[: len(lang.dictionary)], pa.int64())], ["lang", "n"])
        columns = [_steps(pos), _bytes(code, "<i4"), _bytes(raw, "u1"), _bytes(edges, "<i4"), _bytes(n, "<i8"), pa.array([len(keys)], pa.int64())]
        totals = pa.ListArray.from_arrays(pa.array([0, len(totals)], pa.int32()), totals)
        return pa.RecordBatch.from_arrays([*columns, totals], [x.split()[0] for x in SEGMENT.split(", ")[:7]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, size = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(0).slice(k, 1)
                more = len(text[0].as_buffer()) if text[0].is_valid else 0
                if texts and size + more > limit:
                    yield segment(texts, langs)
                    texts, langs, size = [], [], 0
                texts.append(text)
                langs.append(batch.column(1).slice(k, 1))
                size += more
        if texts:
            yield segment(texts, langs)

    return run


def _keys(rows: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and edges of a segment's keys."""
    return tuple(np.frombuffer(rows.column(c)[row].as_buffer(), kind) for c, kind in (("keys", "u1"), ("edges", "<i4")))


def _dealt_words(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A packed row ``(bucket, keys, sizes, n)`` for each segment and bucket of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw, edges = _keys(batch, k)
                if len(edges) < 2:
                    continue
                bucket = ((W.span_hashes(raw, edges[:-1].astype("i8"), edges[1:].astype("i8")) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("i4")
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(starts, len(bucket))
                dealt, at = _raw(_binaries(edges, raw).take(pa.array(order)))
                n = np.frombuffer(batch.column("n")[k].as_buffer(), "<i8")[order]
                columns = [pa.array(bucket[starts]), _binaries(at[ends], dealt), _binaries(ends * 4, np.diff(at).astype("<i4").view("u1")), _binaries(ends * 8, n.view("u1"))]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "sizes", "n"])

    return run


def _parts(rows: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)])


def _counted_words(min_count: int) -> Callable[[pa.Table], pa.Table]:
    """The frequent ``(lang, word, f)`` of a bucket."""

    def run(rows: pa.Table) -> pa.Table:
        sizes = _parts(rows, "sizes", "<i4")
        coded = _binaries(np.concatenate([[0], np.cumsum(sizes, dtype="i8")]), _parts(rows, "keys", "u1")).dictionary_encode()
        f = np.zeros(len(coded.dictionary), "i8")
        np.add.at(f, coded.indices.to_numpy(), _parts(rows, "n", "<i8"))
        often = np.flatnonzero(f >= min_count)
        both = [x.rsplit(b"\n", 1) for x in coded.dictionary.take(pa.array(often)).to_pylist()]
        lang, word = (pa.array([x[i] for x in both], pa.binary()) for i in (0, 1))
        return pa.table({"lang": lang.view(pa.string()), "word": word, "f": pa.array(f[often])})

    return run


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row ``(seg, local, key)`` for every key of the segments."""
    for batch in batches:
        for k in range(batch.num_rows):
            raw, edges = _keys(batch, k)
            n = len(edges) - 1
            if n > 0:
                columns = [pa.array(np.full(n, batch.column("seg")[k].as_py())), pa.array(np.arange(n)), _binaries(edges, raw)]
                yield pa.RecordBatch.from_arrays(columns, ["seg", "local", "key"])


def _relation(rows: pa.RecordBatch | pa.Table, row: int) -> tuple[np.ndarray, np.ndarray]:
    """``(positions, codes)`` of a segment."""
    step, code = (np.frombuffer(rows.column(c)[row].as_buffer(), "<i4") for c in ("step", "code"))
    return np.cumsum(step, dtype=np.int64), code


def _grams(rows: pa.RecordBatch | pa.Table, row: int) -> np.ndarray:
    return np.frombuffer(rows.column("grams")[row].as_buffer(), "<i8")


def _joined(pos: np.ndarray, code: np.ndarray, n_grams: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge-join of a segment's relation with itself on position + 1: ``(positions, pairs)``."""
    at = np.flatnonzero(np.diff(pos) == 1)
    return pos[at], code[at].astype(np.int64) * n_grams + code[at + 1]


#: Ids below this fit two in one 63-bit number.
ONE_KEY_IDS = 3_000_000_000


def _pair_keys(size: int) -> list[str]:
    """Columns that name a pair of ids below ``size``."""
    return ["pair"] if size < ONE_KEY_IDS else ["head", "tail"]


def _pairs(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every segment's distinct pairs of overlapping phrases, with counts; ids are below ``size``."""
    one = len(_pair_keys(size)) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grams = _grams(batch, k)
                pair = _joined(*_relation(batch, k), len(grams))[1]
                if not len(pair):
                    continue
                keys, n = np.unique(pair, return_counts=True)
                head, tail = grams[keys // len(grams)], grams[keys % len(grams)]
                seg = np.full(len(keys), batch.column("seg")[k].as_py())
                columns = [seg, np.arange(len(keys), dtype=np.int32), n.astype(np.int32), *([head * size + tail] if one else [head, tail])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["seg", "local", "n", *_pair_keys(size)])

    return run


#: Odd, so that products with it modulo a power of two can be undone.
_MIX = 0x9E3779B97F4A7C15


def _pair_bits(size: int) -> int:
    return max(1, (max(size, 1) ** 2 - 1).bit_length())


def _planes(values: np.ndarray) -> np.ndarray:
    """First bytes, then second bytes and so on: sorted or small numbers pack well."""
    return np.ascontiguousarray(values).view("u1").reshape(len(values), -1).T


def _whole(raw: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _dealt_pairs(size: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A packed row ``(bucket, pairs)`` of distinct pairs with counts, for each bucket and about ``COUNTED`` occurrences of a task."""
    bits = _pair_bits(size)
    mask, factor = np.uint64((1 << bits) - 1), np.uint64(_MIX)
    bounds = np.array([-(-(b << bits) // buckets) for b in range(buckets)], "u8")

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        mixed = np.concatenate(held) * factor & mask
        mixed.sort()
        starts = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]]))
        keys, n = mixed[starts], np.diff(starts, append=len(mixed)).astype("<u4")
        edges = np.append(np.searchsorted(keys, bounds), len(keys))
        full = np.flatnonzero(np.diff(edges))
        packed = [_planes(keys[edges[b] : edges[b + 1]]).tobytes() + _planes(n[edges[b] : edges[b + 1]]).tobytes() for b in full]
        return pa.RecordBatch.from_arrays([pa.array(full.astype("i4")), pa.array(packed, pa.binary())], ["bucket", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                pos, code = _relation(batch, k)
                grams, at = _grams(batch, k), np.flatnonzero(np.diff(pos) == 1)
                while len(at):
                    some, at = at[: COUNTED - n_held], at[COUNTED - n_held :]
                    held.append((grams[code[some]] * size + grams[code[some + 1]]).astype("u8"))
                    n_held += len(some)
                    if n_held == COUNTED:
                        yield dealt(held)
                        held, n_held = [], 0
        if held:
            yield dealt(held)

    return run


def _counted_pairs(size: int, min_count: int) -> Callable[[pa.Table], pa.Table]:
    """The frequent ``(pair, f)`` of a bucket."""
    bits = _pair_bits(size)
    mask, back = np.uint64((1 << bits) - 1), np.uint64(pow(_MIX, -1, 1 << bits))

    def run(rows: pa.Table) -> pa.Table:
        keys, n = [], []
        for x in rows.column("pairs"):
            raw = np.frombuffer(x.as_buffer(), "u1")
            m = len(raw) // 12
            keys.append(_whole(raw[: 8 * m], "<u8"))
            n.append(_whole(raw[8 * m :], "<u4"))
        keys, n = np.concatenate(keys), np.concatenate(n)
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        f = np.add.reduceat(n[order], starts, dtype="i8")
        often = f >= min_count
        return pa.table({"pair": pa.array((keys[starts[often]] * back & mask).astype("i8")), "f": pa.array(f[often])})

    return run


def _kept(seg: int, pos: np.ndarray, code: np.ndarray, local: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
    """R of the occurrences whose group ``code`` is among the surviving ones ``local``, with their new ids."""
    order = np.argsort(local)
    local, ids = local[order], ids[order]
    if not len(local) or not len(code):
        return None
    of = np.full(max(int(local[-1]), int(code.max())) + 1, -1, np.int32)
    of[local] = np.arange(len(local), dtype=np.int32)
    place = of[code]
    hit = place >= 0
    if not hit.any():
        return None
    return pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), _steps(pos[hit]), _bytes(place[hit], "<i4"), _bytes(ids, "<i8")], ["seg", "step", "code", "grams"])


_EMPTY = pa.schema([("seg", pa.int64()), *((c, pa.binary()) for c in ("step", "code", "grams"))]).empty_table()


def _groups(rows: pa.RecordBatch | pa.Table, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(positions, group of each, distinct pairs)`` after the join of a segment's R_k with itself."""
    pos, pair = _joined(*_relation(rows, row), len(_grams(rows, row)))
    keys, code = np.unique(pair, return_inverse=True)
    return pos, code, keys


def _cogrouped(first: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The next R of a segment from its rows and those of its groups that are frequent."""

    def run(key: tuple, rows: pa.Table, survivors: pa.Table) -> pa.Table:
        if not rows.num_rows or not survivors.num_rows:
            return _EMPTY
        pos, code = _relation(rows, 0) if first else _groups(rows, 0)[:2]
        out = _kept(key[0].as_py(), pos, code, *(survivors.column(c).to_numpy() for c in ("local", "id")))
        return _EMPTY if out is None else pa.Table.from_batches([out])

    return run


def _by_hash(keys: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``(hashes, keys, ids)`` in order of the hashes."""
    raw, edges = _raw(keys)
    hashes = W.span_hashes(raw, edges[:-1].astype("i8"), edges[1:].astype("i8"))
    order = np.argsort(hashes)
    return hashes[order], keys.take(pa.array(order)), ids[order]


def _places(raw: np.ndarray, edges: np.ndarray, hashes: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(local, place)``: the keys that are known, and where; ``known`` is in order of its ``hashes``."""
    keys = _binaries(edges, raw)
    if not len(hashes) or not len(keys):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    if (hashes[1:] == hashes[:-1]).any():  # known keys of one hash
        place = pc.index_in(keys, known)
        return np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False)), place.drop_null().to_numpy()
    mine = W.span_hashes(raw, edges[:-1].astype("i8"), edges[1:].astype("i8"))
    at = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
    local = np.flatnonzero(hashes[at] == mine)
    same = pc.equal(keys.take(pa.array(local)), known.take(pa.array(at[local]))).to_numpy(zero_copy_only=False)
    return local[same], at[local[same]]


def _first_in_place(frequent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """R_1 of the segments, with all frequent words at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, ids = frequent.value
        for batch in batches:
            for k in range(batch.num_rows):
                local, place = _places(*_keys(batch, k), hashes, known)
                out = _kept(batch.column("seg")[k].as_py(), *_relation(batch, k), local, ids[place])
                if out is not None:
                    yield out

    return run


def _next_in_place(frequent: Broadcast, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """R_{k+1} of the segments from their R_k, with all frequent pairs at hand, sorted: a pair's id is its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in batches:
            for k in range(batch.num_rows):
                grams = _grams(batch, k)
                pos, code, keys = _groups(batch, k)
                if not len(keys):
                    continue
                pair = grams[keys // len(grams)] * size + grams[keys % len(grams)]
                at = np.minimum(np.searchsorted(often, pair), len(often) - 1)
                local = np.flatnonzero(often[at] == pair)
                out = _kept(batch.column("seg")[k].as_py(), pos, code, local, at[local])
                if out is not None:
                    yield out

    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`materialize`, for rows that hold megabytes: their size is looked at row by row."""
    path = scratch_path(df.sparkSession, name)
    sizes = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1"}
    with session_conf(df.sparkSession, DROP_SHUFFLES):
        df.write.options(compression="zstd", **sizes).parquet(path)
    return df.sparkSession.read.parquet(path)


def _survivors(groups: DataFrame, frequent: DataFrame, keys: list[str]) -> DataFrame:
    """Semi-join of the segments' groups with the frequent ones, with their ids."""
    return groups.join(frequent.select(*keys, "id"), keys).select(F.col("seg").alias("seg"), F.col("local").cast("long").alias("local"), "id")


def mine(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """``(totals, frequent)``: words per language, and the frequent phrases of 1 to ``max_words`` words.

    ``frequent[k - 1]`` has ``(id, head, tail, lang, words, f, heads, tails)``: the ids of
    the first and last k - 1 words, and the counts of its first and of its last 1 to k words.
    """
    ship(df.sparkSession)
    lang = F.coalesce(F.col(quoted([lang_col])[0]).cast("string"), F.lit(UNKNOWN))
    spark = df.sparkSession
    segments = df.select(F.col(quoted([text_col])[0]).cast("string").alias("text"), lang.alias("lang")).mapInArrow(_segments(SEGMENT_BYTES), SEGMENT)
    segments = _written(segments.select(F.monotonically_increasing_id().alias("seg"), "*"), "setm-words")
    totals = segments.select(F.inline("totals")).where("n > 0").groupBy("lang").agg(F.sum("n").alias("n"))
    totals = materialize(totals, "setm-totals")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kinds = segments.agg(F.sum("kinds")).first()[0] or 0
    words = segments.select("keys", "edges", "n").mapInArrow(_dealt_words(max(parts, -(-kinds // BUCKET_WORDS))), "bucket int, keys binary, sizes binary, n binary")
    counted = words.groupBy("bucket").applyInArrow(_counted_words(min_count), "lang string, word binary, f long")
    first = number_rows(counted, ["lang", "word"], "id", 0).select(
        "id", F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("tail"),
        "lang", F.array(F.col("word").cast("string")).alias("words"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"), "word",
    )
    first = materialize(first, "setm-frequent")
    size = first.agg(F.sum(F.length("word") + F.octet_length("lang") + 21)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        t = first.select("lang", "word", "id").toArrow().combine_chunks()
        known = _key(*(pa.concat_arrays(t.column(c).chunks) if t.num_rows else pa.array([], pa.binary()) for c in (0, 1)))
        sent = spark.sparkContext.broadcast(_by_hash(known, t.column(2).to_numpy()))
        relation = segments.select("seg", "step", "code", "keys", "edges").mapInArrow(_first_in_place(sent), RELATION)
    else:
        words = segments.select("seg", "keys", "edges").mapInArrow(_word_rows, "seg long, local long, key binary")
        survivors = _survivors(words, first.withColumn("key", F.concat(F.col("lang").cast("binary"), F.lit(b"\n"), "word")), ["key"])
        relation = segments.select("seg", "step", "code").groupBy("seg").cogroup(survivors.groupBy("seg")).applyInArrow(_cogrouped(True), RELATION)
    buckets = max(parts, -(-int(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_PAIRS))
    frequent, n = [first.drop("word")], first.count()
    for _ in range(2, max_words + 1):
        relation = _written(relation, "setm-relation")
        keys = _pair_keys(n)
        pairs = relation.mapInArrow(_pairs(n), "seg long, local int, n int, " + ", ".join(f"{c} long" for c in keys))
        if keys == ["pair"]:
            dealt = relation.select("step", "code", "grams").mapInArrow(_dealt_pairs(n, buckets), "bucket int, pairs binary")
            groups = dealt.groupBy("bucket").applyInArrow(_counted_pairs(n, min_count), "pair long, f long")
            groups = groups.select("pair", F.expr(f"pair div {max(n, 1)}").alias("head"), F.expr(f"pair % {max(n, 1)}").alias("tail"), "f")
        else:
            groups = pairs.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
        before = frequent[-1]
        heads = before.select(F.col("id").alias("head"), "lang", F.col("words").alias("_first"), "heads")
        tails = before.select(F.col("id").alias("tail"), F.element_at("words", -1).alias("_last"), "tails")
        found = groups.join(heads, "head").join(tails, "tail").select(
            *([] if keys == ["head", "tail"] else keys), "head", "tail", "lang", F.concat("_first", F.array("_last")).alias("words"), "f",
            F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"),
        )
        found = materialize(number_rows(found, ["head", "tail"], "id", 0), "setm-frequent")
        frequent.append(found)
        before_n, n = n, found.count()
        if len(frequent) == max_words or not n:
            break
        if keys == ["pair"] and n * 8 <= BROADCAST_BYTES:
            t = found.select("head", "tail").toArrow()
            sent = spark.sparkContext.broadcast(np.sort(t.column(0).to_numpy() * before_n + t.column(1).to_numpy()))
            relation = relation.mapInArrow(_next_in_place(sent, before_n), RELATION)
        else:
            survivors = _survivors(pairs, found, keys)
            relation = relation.groupBy("seg").cogroup(survivors.groupBy("seg")).applyInArrow(_cogrouped(False), RELATION)
    return totals, frequent


def _cut(a: Column, n: Column, left: Column, right: Column) -> Column:
    """``floor(1000 a n / (l r))`` in whole numbers of up to 38 digits."""
    wide = [c.cast("decimal(19,0)") for c in (a * 1000, n, left, right)]
    return F.call_function("div", wide[0] * wide[1], wide[2] * wide[3]).cast("long")


def scored(totals: DataFrame, frequent: list[DataFrame], cover: int = COVER) -> DataFrame:
    """``(lang, words, phrase, a, l, r, n, score)`` of the candidates that no longer one covers."""
    out = []
    for k in range(2, len(frequent) + 1):
        rows = frequent[k - 1]
        if k < len(frequent):
            longer = frequent[k]
            for side in ("head", "tail"):
                most = longer.groupBy(F.col(side).alias("id")).agg(F.max("f").alias(f"_by_{side}"))
                rows = rows.join(most, "id", "left")
            most = F.greatest(F.coalesce("_by_head", F.lit(0)), F.coalesce("_by_tail", F.lit(0)))
            rows = rows.where(~((most > 0) & (100 * most >= cover * F.col("f"))))
        rows = rows.join(small_or_shuffled(totals, 64), "lang")
        cuts = []
        for j in range(1, k):
            left, right = F.col("heads")[j - 1], F.col("tails")[k - j - 1]
            cuts.append(F.struct(_cut(F.col("f"), F.col("n"), left, right).alias("score"), F.lit(j).alias("k"), left.alias("l"), right.alias("r")))
        least = F.array_min(F.array(*cuts))
        rows = rows.withColumn("_least", least)
        out.append(rows.select("lang", F.lit(k).alias("words"), F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "_least.l", "_least.r", "n", "_least.score"))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, cover: int = COVER, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: ``(lang, rank, phrase, a, l, r, n, score)``."""
    spark = df.sparkSession
    totals, frequent = mine(df, text_col, lang_col, min_count, max_words)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(totals, frequent, cover).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    before = spark.conf.get(GROUP_LIMIT_CONF, "1000")
    allow_group_limit(spark, top)
    try:
        return materialize(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "setm-top")
    finally:
        spark.conf.set(GROUP_LIMIT_CONF, before)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of every language."""
    return collocations(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    lead = [f"lead(word, {j}) over w as w{j}" for j in range(1, MAX_WORDS)]
    ctes = [
        r"p as (select coalesce(lang, 'und') as lang, doc, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[.,;:!?\x0A-\x0D]')) as piece from (select *, row_number() over () as doc from documents))",
        r"q as (select lang, row_number() over () as id, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p)",
        "o as (select lang, id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from q where len(ws) > 0)",
        f"x as (select lang, word as w0, {', '.join(lead)} from o window w as (partition by id order by i))",
        "t as (select lang, count(*) as n from o group by lang)",
    ]
    for k in range(1, MAX_WORDS + 1):
        phrase = "concat_ws(' ', " + ", ".join(f"w{j}" for j in range(k)) + ")"
        ctes.append(f"f{k} as materialized (select lang, {', '.join(f'w{j}' for j in range(k))}, {phrase} as phrase, count(*) as a from x where w{k - 1} is not null group by all having count(*) >= {MIN_COUNT})")
    parts = []
    for k in range(2, MAX_WORDS + 1):
        joins, cuts = [], []
        for j in range(1, k):
            on_l = " and ".join(f"l{j}.w{i} = c.w{i}" for i in range(j))
            on_r = " and ".join(f"r{j}.w{i} = c.w{i + j}" for i in range(k - j))
            joins.append(f"join f{j} l{j} on l{j}.lang = c.lang and {on_l} join f{k - j} r{j} on r{j}.lang = c.lang and {on_r}")
            cuts.append(f"{{'score': (1000::hugeint * c.a * n // (l{j}.a::hugeint * r{j}.a))::bigint, 'k': {j}, 'l': l{j}.a, 'r': r{j}.a}}")
        covered = ""
        for m in range(k + 1, MAX_WORDS + 1):
            for s in range(m - k + 1):
                same = " and ".join(f"y.w{i + s} = c.w{i}" for i in range(k))
                covered += f" and not exists (select 1 from f{m} y where y.lang = c.lang and {same} and 100 * y.a >= {COVER} * c.a)"
        parts.append(f"select c.lang, c.phrase, c.a, n, list_min([{', '.join(cuts)}]) as best from f{k} c join t on t.lang = c.lang {' '.join(joins)} where true{covered}")
    ctes.append("s as (" + "\nunion all ".join(parts) + ")")
    ctes.append("z as (select lang, phrase, a, best.l as l, best.r as r, n, best.score as score from s)")
    ctes.append("k as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z)")
    return "with " + ",\n".join(ctes) + f"\nselect lang, rank, phrase, a, l, r, n, score from k where rank <= {TOP}"


SQL = _sql()
