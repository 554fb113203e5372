"""BPE encoding and decoding of whole texts, exact, by tree concatenation.

The merges run in this module; the tokenizer file gives the vocabulary, the
merges and the splitting rules. A long unsplit text is never encoded in one
go:

* A document longer than ``split_chars`` becomes leaves that are encoded in
  parallel tasks. Around each join, the text between the last white space of
  the left leaf and the first of the right one is encoded again; the two sides
  agree from there on, because no rule of the tokenizer looks across white
  space. A leaf inside one very long word of letters is encoded as a part of
  it, and joined by growing windows as below.
* A run of symbols without a split (one very long word) is a tree as well:
  halves are encoded, then growing windows around the join, until the window
  starts and ends with the tokens that the two sides had there. A sequence
  of tokens whose neighbours each encode to themselves is the encoding of the
  whole, so the result is exact. Windows cost little, and time grows with the
  length, not its square.

Encoding equals the ``tokenizers`` library with ``add_special_tokens=False``
and no truncation or padding (texts of special tokens in a document are
special tokens, as they are there). Decoding equals its
``decode(ids, skip_special_tokens=False)`` for a file without a decoder:
tokens joined by one space.

Edge cases: a null or empty text gives no ids and decodes to the empty text;
null ids decode to the empty text; ids outside the vocabulary are left out.
Rows alike each get their result. Input columns named like an output column
give way.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.llm.common import free_name, map_texts, quoted, ship
from vicinity.sources.points import read_table

#: Longest document that one task encodes in one piece, longest run of symbols merged without a tree.
SPLIT_CHARS, LEAF_SYMBOLS = 1 << 15, 64
#: Words of each generation whose ids a Python worker remembers.
CACHE_WORDS = 150_000
#: Longest word that is remembered.
CACHE_CHARS = 64
NEVER = 1 << 60
#: Texts of code points below this take the rules compiled here; others take the library's normaliser and splitter.
PLAIN = 0x180


def byte_symbols() -> list[str]:
    """One printable character per byte: itself where it prints, else from 256 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printing else chr(next(spare)) for b in range(256)]


def _plain_class(kind: str) -> str:
    """Character class of the plain code points of a general category (as they are after lower-casing)."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == kind)


class Words(dict):
    """Word -> its ids as int32 bytes; a missing word is encoded.

    Two generations: when the new one is full it becomes the old one, and what
    is met again moves up, so frequent words stay and memory is bounded.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        self[word] = ids = self.encode(word) if ids is None else ids
        return ids

    def turn(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()


class Bpe:
    """Merges, vocabulary and splitting rules of one tokenizer file (BPE with word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._path, self._library = path, None
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: k for k, m in enumerate(merges)}
        self.end = model["end_of_word_suffix"] or ""
        self.symbol = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letter, number = _plain_class("L"), _plain_class("N")
        white = r"\t-\r \x85\xa0"
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{white}{letter}{number}]+")
        self.odd = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]|\u0130")
        self.all_letters = re.compile(f"[{letter}]+")
        self.table = {b: x for b, x in enumerate(self.symbol)}
        self.words = Words(lambda w: self.ids(w.encode().decode("latin-1").translate(self.table)))
        self.mapped = Words(self.ids)
        names = {**{i: t for t, i in self.vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.token = names
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())

    @property
    def library(self):
        """The library's normaliser and splitter, for texts beyond the plain code points."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge by rank, leftmost first among equals."""
        if len(symbols) > LEAF_SYMBOLS:
            return self._merge_heap(symbols)
        s, rank = list(symbols), self.ranks.get
        due = [rank(p, NEVER) for p in zip(s, s[1:], strict=False)]
        while due:
            low = min(due)
            if low == NEVER:
                break
            i = due.index(low)
            s[i] += s.pop(i + 1)
            del due[i]
            if i:
                due[i - 1] = rank((s[i - 1], s[i]), NEVER)
            if i < len(due):
                due[i] = rank((s[i], s[i + 1]), NEVER)
        return s

    def _merge_heap(self, symbols: list[str]) -> list[str]:
        """The same with a heap of pairs and a linked list, for long windows."""
        s, ranks, n = list(symbols), self.ranks, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if s[i] != left or j >= n or s[j] != right:
                continue
            s[i], s[j] = left + right, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := ranks.get((s[a], s[b]))) is not None:
                    heapq.heappush(heap, (r, a, s[a], s[b]))
        return [x for x in s if x]

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """Tokens of the whole from the tokens of its halves."""
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            window = self.merge([x for t in (*a, *b) for x in self.symbols_of(t)])
            left_done = k >= len(left) or window[0] == a[0]
            right_done = k >= len(right) or window[-1] == b[-1]
            if left_done and right_done:
                return [*left[: max(0, len(left) - k)], *window, *right[k:]]
            k *= 2

    def symbols_of(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def tree(self, symbols: list[str]) -> list[str]:
        """Encode ``symbols`` from the leaves up, joining neighbours level by level."""
        parts = [self.merge(symbols[i : i + LEAF_SYMBOLS]) for i in range(0, len(symbols), LEAF_SYMBOLS)]
        while len(parts) > 1:
            pairs = [self.join(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = pairs + (parts[-1:] if len(parts) % 2 else [])
        return parts[0] if parts else []

    def ids(self, word: str) -> bytes:
        """int32 bytes of the ids of one split word, given in byte symbols."""
        symbols = [*word[:-1], word[-1] + self.end]
        tokens = self.tree(symbols) if len(symbols) > LEAF_SYMBOLS else self.merge(symbols)
        return array("i", [self.vocab[t] for t in tokens if t in self.vocab]).tobytes()

    def token_ids(self, tokens: list[str]) -> bytes:
        return array("i", [self.vocab[t] for t in tokens]).tobytes()

    def tokens_of(self, ids: bytes) -> list[str]:
        return [self.token[i] for i in np.frombuffer(ids, np.int32).tolist()]

    def letters(self, text: str) -> str | None:
        """A text of plain letters in lower case; None for any other."""
        if self.odd.search(text) or not self.all_letters.fullmatch(low := text.lower()) or len(low) != len(text):
            return None
        return low

    def letters_at_end(self, text: str) -> str:
        return next((text[i + 1 :] for i in range(len(text) - 1, -1, -1) if not self.all_letters.fullmatch(text[i].lower())), text)

    def letters_at_start(self, text: str) -> str:
        return next((text[:i] for i, c in enumerate(text) if not self.all_letters.fullmatch(c.lower())), text)

    def letter_symbols(self, text: str) -> list[str]:
        return list(text.encode().decode("latin-1").translate(self.table))

    def _look_up(self, cache: Words, words: list[str]) -> bytes:
        cache.turn()
        if words and max(map(len, words)) > CACHE_CHARS:
            return b"".join([cache[w] if len(w) <= CACHE_CHARS else cache.encode(w) for w in words])
        return b"".join(map(cache.__getitem__, words))

    def encode_part(self, text: str) -> bytes:
        if not self.odd.search(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            return self._look_up(self.words, self.word.findall(text.lower()))
        normal = self.library.normalizer.normalize_str(text)
        return self._look_up(self.mapped, [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal) if w])

    def encode(self, text: str) -> bytes:
        """int32 bytes of the ids of a text."""
        if not any(t in text for t in self.special):
            return self.encode_part(text)
        parts = self.at_special.split(text)
        return b"".join(np.int32(self.special[p]).tobytes() if i % 2 else self.encode_part(p) for i, p in enumerate(parts) if p)


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The tokenizer of ``path``, read once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ids_array(parts: Sequence[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))


def _decoded(bpe: Bpe, lists: pa.ListArray) -> pa.Array:
    """Texts of lists of ids: tokens joined by a space."""
    flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(bpe.names)))
    tokens = pc.take(bpe.names, pc.if_else(known, flat, None))
    if tokens.null_count:
        there = tokens.is_valid().to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(there)])[offsets]
        tokens = tokens.filter(pa.array(there))
    # A few million tokens at a time, far from the 2 GB that one Arrow array of texts can hold.
    texts, lo = [], 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 22), side="right")) - 1)
        hi = min(hi, len(lists))
        part = pa.ListArray.from_arrays(pa.array(offsets[lo : hi + 1] - offsets[lo], pa.int32()), tokens.slice(offsets[lo], offsets[hi] - offsets[lo]))
        texts.append(pc.binary_join(part, " "))
        lo = hi
    return pa.concat_arrays(texts) if texts else pa.array([], pa.string())


WHITE = " \t\n\v\f\r"


def _leaf(bpe: Bpe, text: str) -> tuple[str, bytes | None, str, bytes | None]:
    """``(head, ids, tail, run)`` of a leaf.

    ``ids`` are those of what lies between the first and last white space. A
    leaf without white space has none; if it is letters only, a part of one
    long word, ``run`` has the ids of all but its last letter.
    """
    last = max(text.rfind(c) for c in WHITE)
    if last < 0:
        letters = bpe.letters(text)
        return text, None, "", bpe.token_ids(bpe.tree(bpe.letter_symbols(letters[:-1]))) if letters and len(letters) > 1 else None
    first = min(i for c in WHITE if (i := text.find(c)) >= 0)
    return text[:first], bpe.encode(text[first:last]), text[last + 1 :], None


def _close(bpe: Bpe, parts: Sequence[tuple[str, bytes | None]]) -> bytes:
    """Ids of text between two white spaces that leaves share; a run's tokens are joined, not made again."""
    runs = [k for k, (_, run) in enumerate(parts) if run is not None]
    whole = "".join([t for t, _ in parts])
    if not runs or any(run is None for _, run in parts[runs[0] : runs[-1] + 1]):
        return bpe.encode(whole)
    before, after = "".join([t for t, _ in parts[: runs[0]]]), "".join([t for t, _ in parts[runs[-1] + 1 :]])
    if bpe.odd.search(before) or bpe.odd.search(after) or any(t in whole for t in bpe.special):
        return bpe.encode(whole)
    # The word goes on to the left and right for as long as there are letters.
    cut = len(before) - len(bpe.letters_at_end(before))
    if before[:cut].endswith("'"):
        return bpe.encode(whole)  # perhaps a contraction: it takes letters of its own
    head, rest = before[cut:].lower(), bpe.letters_at_start(after)
    tokens = bpe.tree(bpe.letter_symbols(head))
    for text, run in parts[runs[0] : runs[-1] + 1]:
        tokens = bpe.join(tokens, bpe.tokens_of(run)) if tokens else bpe.tokens_of(run)
        tokens = bpe.join(tokens, bpe.merge(bpe.letter_symbols(text[-1:].lower())))
    # Its end has a symbol of its own: the last letter is joined anew.
    if rest:
        end = bpe.letter_symbols(rest.lower())
        tokens = bpe.join(tokens, bpe.tree([*end[:-1], end[-1] + bpe.end]))
    else:
        symbols = bpe.symbols_of(tokens[-1])
        last = bpe.merge([*symbols[:-1], symbols[-1] + bpe.end])
        tokens = bpe.join(tokens[:-1], last) if len(tokens) > 1 else last
    return b"".join([bpe.encode(before[:cut]), bpe.token_ids(tokens), bpe.encode(after[len(rest) :])])


def _join_leaves(bpe: Bpe, leaves: Sequence[tuple[str, bytes | None, str, bytes | None]]) -> bytes:
    """Ids of a document from its leaves in order: the text open at each join is encoded again."""
    out, parts = [], []
    for head, ids, tail, run in leaves:
        parts.append((head, run))
        if ids is not None:
            out += [_close(bpe, parts), ids]
            parts = [(tail, None)]
    return b"".join([*out, _close(bpe, parts)])


def encode(
    df: DataFrame, path: str | None = None, text_col: str = "text", carry: Sequence[str] | None = None, split_chars: int = SPLIT_CHARS, decoded: str | None = None
) -> DataFrame:
    """``df`` (or its columns ``carry``) with ``ids array<int>``, and their text as ``decoded`` if a name is given."""
    path = path or default_path()
    ship(df.sparkSession)
    text = F.col(quoted([text_col])[0])
    made = ["ids", *([decoded] if decoded else [])]
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() not in {m.lower() for m in made}]
    out = "ids array<int>" + (f", {quoted([decoded])[0]} string" if decoded else "")

    def results(bpe: Bpe, parts: list[bytes]) -> list[pa.Array]:
        ids = _ids_array(parts)
        return [ids, _decoded(bpe, ids)] if decoded else [ids]

    def whole(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        bpe = load(path)
        for lo in range(0, len(texts), 512):
            part = texts.slice(lo, 512).to_pylist()
            yield lo, lo + len(part), results(bpe, [bpe.encode(t) if t else b"" for t in part])

    long = F.coalesce(F.char_length(text), F.lit(0)) > split_chars
    short = map_texts(df.where(~long), text_col, out, whole, carry)

    # Long texts: each distinct one once, its leaves spread over tasks.
    key = free_name(df, "_key")
    texts = df.where(long).select(F.sha2(text, 256).alias("key"), text.alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    n = F.ceil(F.char_length("text") / split_chars).cast("int")
    leaves = texts.select("key", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("leaf"))
    leaves = leaves.select("key", "leaf", F.expr(f"substring(text, leaf * {split_chars} + 1, {split_chars})").alias("piece"))

    def leaf(pieces: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        bpe = load(path)
        for lo in range(0, len(pieces), 64):
            part = [_leaf(bpe, t) for t in pieces.slice(lo, 64).to_pylist()]
            yield lo, lo + len(part), [pa.array(c, k) for c, k in zip(zip(*part, strict=True), (pa.string(), pa.binary(), pa.string(), pa.binary()), strict=True)]

    spread = leaves.repartition("key", "leaf")
    encoded = map_texts(spread, "piece", "head string, part binary, tail string, run binary", leaf, ["key", "leaf"])

    def tree(table: pa.Table) -> pa.Table:
        bpe = load(path)
        rows = sorted(table.to_pylist(), key=lambda r: r["leaf"])
        ids = _join_leaves(bpe, [(r["head"], r["part"], r["tail"], r["run"]) for r in rows])
        return pa.Table.from_arrays([pa.array([rows[0]["key"]]), *results(bpe, [ids])], ["key", *made])

    joined = encoded.groupBy("key").applyInArrow(tree, f"key string, {out}").withColumnRenamed("key", key)
    # Sort-merge: a text that many rows share is a hot key, which Spark can split there.
    rest = df.where(long).select(*quoted(carry), F.sha2(text, 256).alias(key)).join(joined.hint("merge"), key)
    return short.unionByName(rest.select(*quoted([*carry, *made])))


def decode(df: DataFrame, path: str | None = None, ids_col: str = "ids", name: str = "decoded", carry: Sequence[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``carry``) with the text ``name`` of ``ids_col``."""
    path = path or default_path()
    ship(df.sparkSession)
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() != name.lower()]
    at = free_name(df, "_ids")
    source = df.select(F.coalesce(F.col(quoted([ids_col])[0]).cast("array<int>"), F.array().cast("array<int>")).alias(at), *quoted(carry))
    schema = T.StructType([*[f for f in source.schema if f.name != at], T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], _decoded(load(path), batch.column(0))], [f.name for f in schema])

    return source.mapInArrow(run, schema)


def digests(ids_col: str = "ids", decoded_col: str = "decoded") -> list[Column]:
    """Columns ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    return [
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col), 256).alias("decoded_sha256"),
    ]


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, carry=["doc_id"], decoded="decoded").select("doc_id", *digests())
