"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes (the last one
filled up with zero bytes). Filters that are 2, 3 and 4 bytes wide run over a
window, each keeps its largest value (max pooling), and a softmax layer over
these values gives the log probability of every language. A text's log
probabilities are the sums over all of its windows, so a text of any length is
read whole, and what does not fit the language outvotes nothing but itself.

Training is done in numpy (Adam, cross entropy) on windows of labelled texts:
at most ``FIT_ROWS`` distinct texts of each language, those with the smallest
hashes, with at most ``FIT_WINDOWS`` windows of each, spread evenly. Half of the
training windows are cut to random lengths, so that short texts get
probabilities that are no surer than they should be. The seed is fixed and the
windows are sorted, so a fit on the same rows gives the same network.

To score, a filter's weights for two neighbouring bytes are laid out as one
table of all byte pairs, so a filter of four bytes costs two look-ups a place.

Edge cases: a text that is null or holds no letter (``\\p{L}``) is ``und`` with a
score of 0, as are all texts if nothing is labelled; with one labelled language
all others are that one with a score of 1. Rows that are labelled with null are
not learnt from. Equal texts get equal results. Columns of the input that are
named like the output give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.llm import words as W
from vicinity.llm.common import free_name, map_texts, quoted, ship
from vicinity.session import materialize
from vicinity.sources.points import read_table

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Distinct labelled texts of each language that the network is fitted on at most, and windows of each.
FIT_ROWS, FIT_WINDOWS = 2_000, 6
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.01, 7
#: Windows that are scored at once.
BLOCK = 256
UNKNOWN = "und"
HAS_LETTER = r"\p{L}"


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(windows, first)``: all texts in windows of ``WINDOW`` bytes, and the index of each text's first window."""
    lens = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(-(-lens // WINDOW))])
    out = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - offsets[:-1], lens)] = data
    return out.reshape(-1, WINDOW), first


@dataclass
class Network:
    """``filters[w]`` is ``(w, 256, FILTERS)``; ``out`` maps the pooled values to the languages."""

    langs: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """Per width, its weights as tables over two neighbouring bytes (and over one, where the width is odd)."""
        return [[(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(-1, FILTERS) if j + 1 < len(f) else f[j] for j in range(0, len(f), 2)] for f in self.filters]

    def log_probs(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Log probability of each language for every window."""
        out = np.empty((len(windows), len(self.langs)), np.float32)
        for lo in range(0, len(windows), BLOCK):
            x = windows[lo : lo + BLOCK].astype(np.intp)
            two = x[:, :-1] * 256 + x[:, 1:]
            pooled = []
            for f, parts in zip(self.filters, tables, strict=True):
                places = WINDOW - len(f) + 1
                total = None
                for k, table in enumerate(parts):
                    at = two if len(table) > 256 else x
                    value = table.take(at[:, 2 * k : 2 * k + places], axis=0, mode="clip")
                    total = value if total is None else np.add(total, value, out=total)
                pooled.append(total.max(axis=1))
            z = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            out[lo : lo + BLOCK] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str]) -> Network:
    """Fit a network to ``windows`` (n x ``WINDOW`` bytes) and ``labels`` (indices into ``langs``)."""
    rng = np.random.default_rng(SEED)
    n_all = FILTERS * len(WIDTHS)
    net = Network(
        langs, [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(n_all, np.float32),
        rng.normal(0, 0.1, (n_all, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32),
    )
    weights = [*net.filters, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    # Every language weighs the same, however many windows it has.
    share = 1.0 / np.maximum(np.bincount(labels, minlength=len(langs)), 1)
    share = (share / share[labels].mean()).astype(np.float32)
    step = 0
    for epoch in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            x, y = windows[rows].copy(), labels[rows]
            short = np.where(rng.random(len(rows)) < 0.5, rng.integers(4, WINDOW, len(rows)), WINDOW)
            x[np.arange(WINDOW) >= short[:, None]] = 0
            pooled, best = [], []
            for f in net.filters:
                places = WINDOW - len(f) + 1
                total = sum(f[j][x[:, j : j + places]] for j in range(len(f)))
                at = total.argmax(axis=1)
                best.append(at)
                pooled.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0])
            hidden = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y] -= 1
            p *= share[y][:, None] / len(rows)
            back = (p @ net.out.T) * (hidden > 0)
            grads = []
            for k, f in enumerate(net.filters):
                g = np.zeros_like(f)
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(f)):
                    seen = np.take_along_axis(x, best[k] + j, axis=1)
                    np.add.at(g[j], (seen, np.arange(FILTERS)), part)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, g, (m, v) in zip(weights, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``FIT_WINDOWS`` windows of each text, spread evenly over it."""
    for batch in batches:
        data, offsets = W.utf8(batch.column(1))
        windows, first = cut(data, offsets)
        owner, picked = [], []
        for i in range(batch.num_rows):
            n = int(first[i + 1] - first[i])
            at = np.unique(np.linspace(0, n - 1, min(n, FIT_WINDOWS)).astype(int)) + first[i]
            picked.append(at)
            owner += [i] * len(at)
        rows = np.concatenate(picked) if picked else np.empty(0, int)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array([windows[r].tobytes() for r in rows], pa.binary())], ["lang", "window"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network fitted on a bounded sample of ``labelled`` rows; ``None`` if none has a label and a letter."""
    spark = labelled.sparkSession
    ship(spark)
    text, lang = F.col(quoted([text_col])[0]).cast("string"), F.col(quoted([lang_col])[0]).cast("string")
    rows = labelled.select(lang.alias("lang"), text.alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(HAS_LETTER)).withColumn("h", F.xxhash64("text"))
    # Keys first: only hashes are sorted, and the texts of the few that are picked are read again.
    order = Window.partitionBy("lang").orderBy("h")
    keys = rows.select("lang", "h").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= FIT_ROWS).select("lang", "h")
    keys = materialize(keys, "langid-sample")
    texts = rows.join(F.broadcast(keys), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")
    sample = sorted((r.lang, bytes(r.window)) for r in texts.mapInArrow(_spread, "lang string, window binary").collect())
    if not sample:
        return None
    langs = sorted({s[0] for s in sample}, key=lambda s: s.encode())
    place = {name: k for k, name in enumerate(langs)}
    windows = np.frombuffer(b"".join(s[1] for s in sample), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([place[s[0]] for s in sample]), langs)


def predict(df: DataFrame, net: Network | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``carry``) with ``lang_pred`` and ``score``, over every window of every text."""
    kept = df.columns if carry is None else carry
    at = free_name(df, "_read")
    text = F.col(quoted([text_col])[0]).cast("string")
    read = df.withColumn(at, F.when(text.rlike(HAS_LETTER), text))

    def run(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        data, offsets = W.utf8(texts)
        known = texts.is_valid().to_numpy(zero_copy_only=False)
        tables = net.pairs() if net else []
        for lo, hi in W.slices(offsets):
            if net is None:
                yield lo, hi, [pa.array([UNKNOWN] * (hi - lo)), pa.array(np.zeros(hi - lo))]
                continue
            windows, first = cut(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            totals = np.concatenate([np.zeros((1, len(net.langs))), np.cumsum(net.log_probs(windows, tables), axis=0, dtype=np.float64)])
            sums = totals[first[1:]] - totals[first[:-1]]
            best = sums.argmax(axis=1)
            score = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            ok = known[lo:hi]
            yield lo, hi, [pa.array([net.langs[b] if k else UNKNOWN for b, k in zip(best, ok, strict=True)], pa.string()), pa.array(np.where(ok, score, 0.0))]

    return map_texts(read, at, "lang_pred string, score double", run, [c for c in kept if c != at])


def remainder(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a network fitted outside the held-out fifth."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder(F.col("doc_id")) == 0).alias("held_out"))
    net = fit(docs.where("NOT held_out"))
    return predict(docs, net, carry=["doc_id", "held_out"])
