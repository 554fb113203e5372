"""Token counts by a Viterbi search that carries only score and count.

The tokenizer is a unigram model over the pieces and scores of a SentencePiece
file, as ``tokenizers.models.Unigram(..., byte_fallback=True)`` behind a
``Metaspace`` splitter (``prepend_scheme="always"``): spaces become ``▁``, a
text without one in front gets one, and each ``▁`` starts a word.

An Aho-Corasick automaton over all pieces lists, for each place of a word, the
pieces that end there. The dynamic program keeps the best score and the number
of tokens up to each place; tokens themselves are never made. Ties are the
library's: a later start replaces an earlier one only if its score is greater,
so among equals the longest last piece wins. A character that no piece of one
character covers may also be unknown, at ten below the lowest score; it counts
a token per byte if the vocabulary has all byte pieces, else one per run.

Words do not depend on each other, so each distinct word is counted once and
remembered (two bounded generations). Time is linear in the length of a word.

Edge cases: a null or empty text has no tokens and score 0. Repeated rows each
get their count. Input columns called like an output column give way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vicinity.llm.common import map_texts
from vicinity.sources.points import read_table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS, CACHE_CHARS = 150_000, 64


class Unigram:
    """Pieces and scores of a unigram tokenizer."""

    def __init__(self, pieces: Sequence[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.byte_fallback = all(f"<0x{b:02X}>" in names for b in range(256))
        self.new: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}

    def best(self, word: str) -> tuple[int, float]:
        """``(tokens, score)`` of the best path through a word."""
        n = len(word)
        score, count, run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(word)
        nxt = next(matches, None)
        for end in range(1, n + 1):
            top, tokens, single, unknown = None, 0, False, False
            # All pieces that end here, the longest first.
            while nxt is not None and nxt[0] == end - 1:
                length, value = nxt[1]
                here = value + score[end - length]
                single = single or length == 1
                if top is None or here > top:
                    top, tokens = here, count[end - length] + 1
                nxt = next(matches, None)
            if not single:
                here = self.unknown + score[end - 1]
                if top is None or here > top:
                    unknown = True
                    more = len(word[end - 1].encode()) if self.byte_fallback else int(not run[end - 1])
                    top, tokens = here, count[end - 1] + more
            score[end], count[end], run[end] = top, tokens, unknown
        return count[n], score[n]

    def of(self, text: str) -> tuple[int, float]:
        """``(tokens, score)`` of a text."""
        if not text:
            return 0, 0.0
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        words = text.replace(" ", SPACE).split(SPACE)
        # Without a space in front one is added; with one, what is before it is nothing.
        if not words[0]:
            words = words[1:]
        known, tokens, score = self.new, 0, 0.0
        for word in words:
            got = known.get(word)
            if got is None:
                got = self.old.get(word) or self.best(SPACE + word)
                if len(word) <= CACHE_CHARS:
                    known[word] = got
            tokens += got[0]
            score += got[1]
        return tokens, score


_LOADED: dict[str, Unigram] = {}


def pieces_of(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())]


def load(path: str) -> Unigram:
    if path not in _LOADED:
        _LOADED[path] = Unigram(pieces_of(path))
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(df: DataFrame, path: str | None = None, text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``carry``) with ``n_tokens`` and ``best_score`` of every text."""
    path = path or default_path()

    def run(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        unigram = load(path)
        for lo in range(0, len(texts), 512):
            part = [unigram.of(t) for t in texts.slice(lo, 512).to_pylist()]
            yield lo, lo + len(part), [pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.float64())]

    return map_texts(df, text_col, "n_tokens long, best_score double", run, carry)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every document, and the score of its best segmentation."""
    return count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
