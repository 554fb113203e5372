"""Quality rules as a short-circuit cascade.

Base statistics are counted over every whole text. The method's rules run
after the base test as a cascade: their cost (time taken) and selectivity are
measured on a sample, rules are ordered by conditional rejection per cost,
and a text stops at the first rule that rejects it. The order changes the
work, never the verdict, because a text is kept only if no rule rejects it.

Base statistics (words are ``[^\\x20\\x09-\\x0D]+``):

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols``
  (characters of ``[#*$%&|<>]``),
* ``n_dup_lines``: lines (split at newline) with a word that equal an earlier line,
* ``n_repeat_words``: words in three-word windows found twice or more in the text.

Edge cases: a null or empty text has no words and fails the base test
(``kept`` false). Repeated rows each get their own verdict. Input columns
named like an output column are replaced by the output.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm import words as W
from vicinity.llm.common import map_texts, ship
from vicinity.sources.points import read_table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Runs of a rule over a sampled slice, of which the least counts as its cost.
TIMED_RUNS = 3
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


class Texts:
    """One slice of texts: its bytes and what has been counted of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.stats: dict[str, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def only(self, rows: np.ndarray) -> Texts:
        """The texts at ``rows`` with the statistics counted so far."""
        lens = (self.offsets[1:] - self.offsets[:-1])[rows]
        offsets = np.concatenate([[0], np.cumsum(lens)])
        at = np.arange(offsets[-1]) + np.repeat(self.offsets[rows] - offsets[:-1], lens)
        out = Texts(self.data[at], offsets)
        out.stats = {k: v[rows] for k, v in self.stats.items()}
        return out

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes for which ``table`` holds, per text."""
        return W.per_text(table[self.data], self.offsets)


def base_stats(t: Texts) -> None:
    """Fill ``t.stats`` with the base statistics and ``n_lines`` (lines with a word)."""
    data, offsets = t.data, t.offsets
    starts, ends, first = W.word_spans(data, offsets)
    hashes, owner = W.span_hashes(data, starts, ends), W.owners(first)
    t.stats["n_words"] = np.diff(first)
    t.stats["word_chars"] = W.per_text(~W.SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    t.stats["n_symbols"] = t.count(SYMBOLS)
    wins, at = W.windows(hashes, owner, 3)
    twice, _ = W.repeated(W.with_owner(wins, owner[at]))
    covered = np.zeros(len(hashes) + 2, bool)
    for j in range(3):
        covered[at[twice] + j] = True
    t.stats["n_repeat_words"] = W.per_text(covered[: len(hashes)], first)
    # Lines: cut at newlines and at the edges of texts; only those with a word count.
    cuts = np.flatnonzero(data == 0x0A)
    begin = np.union1d(offsets[:-1], cuts + 1)
    begin = begin[begin < len(data)]
    stop = np.concatenate([begin[1:], [len(data)]]) if len(begin) else begin
    stop = stop - ((stop > begin) & (data[np.maximum(stop, 1) - 1] == 0x0A)) if len(begin) else stop
    n_in = np.searchsorted(starts, stop) - np.searchsorted(starts, begin)
    begin, stop = begin[n_in > 0], stop[n_in > 0]
    line_first = np.searchsorted(begin, offsets)
    lines = W.with_owner(W.span_hashes(data, begin, stop), W.owners(line_first))
    t.stats["n_lines"] = np.diff(line_first)
    t.stats["n_dup_lines"] = W.per_text(W.repeated(lines)[1], line_first)


def _bytes(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_UPPER = _bytes(bytes(range(65, 91)))
_LOWER = _bytes(bytes(range(97, 123)))
_BANG = _bytes(b"!")
_LETTER = _UPPER | _LOWER
_LETTER[128:] = True


def _letter_words(t: Texts) -> np.ndarray:
    """Words that hold a letter (ASCII letter or any character beyond ASCII)."""
    starts, ends, first = W.word_spans(t.data, t.offsets)
    seen = np.concatenate([[0], np.cumsum(_LETTER[t.data])])
    return W.per_text(seen[ends] > seen[starts], first)


@dataclass(frozen=True)
class Rule:
    """Rejects the texts for which ``test`` holds; what it costs is measured on the sample."""

    name: str
    test: Callable[[Texts], np.ndarray]


#: Limits in whole numbers, so that SQL states them alike.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda t: 100 * t.stats["n_symbols"] > 10 * t.stats["n_words"]),
    Rule("dup_lines", lambda t: 100 * t.stats["n_dup_lines"] > 50 * t.stats["n_lines"]),
    Rule("word_length", lambda t: (t.stats["word_chars"] < 2 * t.stats["n_words"]) | (t.stats["word_chars"] > 15 * t.stats["n_words"])),
    Rule("bangs", lambda t: 100 * t.count(_BANG) > 30 * t.stats["n_words"]),
    Rule("shouting", lambda t: t.count(_UPPER) > t.count(_LOWER)),
    Rule("letter_words", lambda t: 100 * _letter_words(t) < 50 * t.stats["n_words"]),
)


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    data, offsets = W.utf8(texts)
    for lo, hi in W.slices(offsets):
        yield lo, hi, Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def plan_cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2_000, seed: int = 7) -> list[Rule]:
    """Order ``rules`` by rejection per cost, estimated on about ``sample_rows`` texts.

    Each sampled text gives the set of rules that reject it, and each rule is
    timed over the sampled texts; the counts per set and the seconds per rule
    (at most ``2 ** len(rules)`` rows and one a rule) come to the driver, and the order is
    built greedily on what earlier rules leave over. Rules that reject nothing
    in the sample come last, cheapest first.
    """
    ship(docs.sparkSession)
    n = docs.count()
    if n == 0:
        return list(rules)

    def probe(batches):
        for batch in batches:
            for _, _, t in _slices(batch.column(0)):
                base_stats(t)
                t = t.only(np.flatnonzero(~base_failed(t.stats)))
                mask, spent = np.zeros(len(t), np.int64), np.zeros(len(rules), np.int64)
                for k, rule in enumerate(rules):
                    # The least of a few runs: one may have waited for a core, or touched new memory.
                    took = []
                    for _ in range(TIMED_RUNS):
                        began = time.perf_counter_ns()
                        out = rule.test(t)
                        took.append(time.perf_counter_ns() - began)
                    spent[k] = min(took)
                    mask |= out.astype(np.int64) << k
                # A text counts under its mask; the time of rule k stands under -1 - k.
                key = np.concatenate([mask, -1 - np.arange(len(rules))])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([np.ones_like(mask), spent]))], ["mask", "n"])

    part = docs.select(F.col(text_col).alias("text")).sample(False, min(1.0, sample_rows / n), seed)
    seen = {r["mask"]: r["n"] for r in part.mapInArrow(probe, "mask long, n long").groupBy("mask").agg(F.sum("n").alias("n")).collect()}
    left, order = [x for x in seen.items() if x[0] >= 0], []
    spent = [max(seen.get(-1 - k, 0), 1) for k in range(len(rules))]
    waiting = list(enumerate(rules))
    while waiting:

        def rank(item, left=left):
            k, _ = item
            return (-sum(n for mask, n in left if mask >> k & 1) / spent[k], spent[k], k)

        k, rule = best = min(waiting, key=rank)
        order.append(rule)
        waiting.remove(best)
        left = [x for x in left if not x[0] >> k & 1]
    return order


def judge(t: Texts, order: list[Rule]) -> tuple[np.ndarray, np.ndarray]:
    """``(base_failed, index of the rejecting rule or -1)``; each rule sees only what is still kept."""
    failed = base_failed(t.stats)
    by = np.full(len(t), -1)
    rows = np.flatnonzero(~failed)
    part = t.only(rows) if len(rows) < len(t) else t
    for k, rule in enumerate(order):
        if not len(rows):
            break
        out = rule.test(part)
        by[rows[out]] = k
        if out.any():
            rows, part = rows[~out], part.only(np.flatnonzero(~out))
    return failed, by


def quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2_000, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the base statistics, ``base_failed``, ``kept`` and ``rejected_by``."""
    order = plan_cascade(docs, text_col, rules, sample_rows)
    names = [r.name for r in order]

    def run(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for lo, hi, t in _slices(texts):
            base_stats(t)
            failed, by = judge(t, order)
            why = ["base" if f else names[k] if k >= 0 else None for f, k in zip(failed, by, strict=True)]
            stats = [pa.array(t.stats[c].astype(np.int64)) for c in STATS]
            yield lo, hi, [*stats, pa.array(failed), pa.array(~failed & (by < 0)), pa.array(why, pa.string())]

    return map_texts(docs, text_col, OUT, run, carry)


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, carry=["doc_id"]).drop("rejected_by")


SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, string_split(text, chr(10)) as l from d),
s as (select r, doc_id, len(w) as n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        length(regexp_replace(text, '[^!]', '', 'g')) as bangs,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) as uppers,
        length(regexp_replace(text, '[^a-z]', '', 'g')) as lowers,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) as letter_words,
        list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l, w from w),
g as (select r, unnest(range(1, n_words - 1)) as i, w from s where n_words >= 3),
h as (select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) as c from g),
q as (select r, count(distinct p) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from h where c > 1) group by r),
b as (select s.*, coalesce(q.n_repeat_words, 0) as n_repeat_words, len(l) - len(list_distinct(l)) as n_dup_lines from s left join q using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not (100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 50 * len(l)
    or word_chars < 2 * n_words or word_chars > 15 * n_words or 100 * bangs > 30 * n_words
    or uppers > lowers or 100 * letter_words < 50 * n_words) as kept
from f
"""
