"""Toxicity by class-conditional Kneser-Ney models.

Words are runs of letters in lower case; a model predicts each character of a
word (and its end) from the four before it. Each class (toxic, ordinary) has
its own counts of the top order; all that they back off to is shared: the
counts of both classes together, below them the continuation counts (distinct
characters seen before a gram) of both. A rare expression therefore has about
the same probability in both classes and says little, while a stem that only
toxic texts use says much, also with an ending not seen before.

For class k, discount D, strength S, context h (h' without its first
character), n without a class for both together:

    P_k(c | h) = (max(n_k(hc) - D, 0) + (S + D * types_k(h)) * P(c | h)) / (n_k(h) + S)
    P(c | h)   = (max(n(hc) - D, 0) + D * types(h) * P(c | h')) / n(h)

and continuation counts for n in the lower orders. A word's value is its log
likelihood ratio; a text's are the sums of its words' values, and of what they
have beyond ``HIGH``, per word and per root of the number of words. A logistic
curve over these turns them into a score from 0 to 1. Where neither class has
seen a gram, the shared part cancels, so scoring needs one number per seen
gram and one per seen context.

Labels are used only where ``crc32(id as text) mod 5`` is not 0. All labelled
texts of remainders 1 to 4 are counted, over all their words. The curve is fitted on a
bounded sample (``FIT_ROWS``) of remainder 1, with the values that a model of
remainders 2 to 4 gives it. ``STRENGTH`` and ``HIGH`` come from ``cross_fit``, which
uses remainders 1 to 4 only.

A gram's value is a whole number of millionths, so the sums are exact in any order.
The scores are broadcast to the tasks if their counted size allows;
otherwise the words of the texts are joined with them. Both give equal results.

Edge cases: a null or empty text has value 0 (its score is the curve there);
without labelled texts of both classes every score is the share of toxic
labels (0.5 if there are none); labels that repeat count once, as toxic if
any says so; null labels and labels of unknown ids are left out. Repeated
rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm.common import free_name, map_texts, quoted, ship, small_or_shuffled
from vicinity.llm.words import mix, stream
from vicinity.session import materialize
from vicinity.sources.points import read_table

ORDER, DISCOUNT, STRENGTH, HIGH = 5, 0.75, 20.0, 1.5
#: Values of grams and words are whole numbers of this part.
UNIT = 1_000_000
#: Rows that the logistic curve is fitted on at most.
FIT_ROWS = 20_000
#: Scores (16 bytes each) that are broadcast at most; more are joined.
BROADCAST_SCORES = 2_000_000
CACHE_WORDS, FLUSH_WORDS = 100_000, 150_000
LETTERS = re.compile(r"[^\W\d_]+")
PAD, END = "\x02", "\x03"
_U = np.uint64
_PLACE = stream(ORDER, 41) | _U(1)


def remainder(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def _grams(words: Sequence[str], width: int) -> list[str]:
    out = []
    for w in words:
        s = PAD * (ORDER - 1) + w + END
        out += [s[i : i + width] for i in range(len(s) - ORDER + 1)]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Top-order grams with their number per fold and class, summed over the words of many texts."""
    seen = [Counter() for _ in range(4)]

    def flush() -> pa.RecordBatch:
        grams = [Counter() for _ in seen]
        for own, words in zip(grams, seen, strict=True):
            for word, n in words.items():
                s = PAD * (ORDER - 1) + word + END
                for i in range(len(s) - ORDER + 1):
                    own[s[i : i + ORDER]] += n
            words.clear()
        keys = list(set().union(*grams))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([own[k] for k in keys], pa.int64()) for own in grams)], ["gram", "f0c0", "f0c1", "f1c0", "f1c1"])

    for batch in batches:
        for text, label, fold in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            seen[2 * fold + label].update(LETTERS.findall((text or "").lower()))
            if sum(map(len, seen)) > FLUSH_WORDS:
                yield flush()
    yield flush()


def _models(texts: DataFrame, strength: float, n_models: int) -> DataFrame:
    """``(gram, llr0, llr1)`` from ``(text, toxic, fold)``: of all rows, and (if ``n_models`` is 2) of those of fold 1.

    Both models come out of the same jobs; what a model has not seen is null. Every order is written
    before the next one reads it, so no plan holds more than one order's joins.
    """
    models = range(n_models)
    counted = texts.select("text", F.col("toxic").cast("int"), F.col("fold").cast("int")).mapInArrow(_count, "gram string, f0c0 long, f0c1 long, f1c0 long, f1c1 long")
    counts = [[F.sum(F.col(f"f0c{k}") + F.col(f"f1c{k}")).alias(f"n{k}_0") for k in (0, 1)], [F.sum(f"f1c{k}").alias(f"n{k}_1") for k in (0, 1)]]
    top = materialize(counted.groupBy("gram").agg(*[c for m in models for c in counts[m]]), "toxicity-grams")

    def kinds(m: int) -> Column:
        return F.count(F.when(F.col(f"n_{m}") > 0, 1))

    # Shared lower orders: continuation counts from the longest down, then P(c | h) from the shortest up.
    types = [top.select("gram", *[(F.col(f"n0_{m}") + F.col(f"n1_{m}")).alias(f"n_{m}") for m in models])]
    for _ in range(ORDER - 1):
        types.append(materialize(types[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(*[kinds(m).alias(f"n_{m}") for m in models]), "toxicity-types"))
    prob = None
    for grams in reversed(types[1:]):
        grams = grams.withColumn("h", F.expr("left(gram, char_length(gram) - 1)"))
        context = grams.groupBy("h").agg(*[F.sum(f"n_{m}").alias(f"all_{m}") for m in models], *[kinds(m).alias(f"kinds_{m}") for m in models])
        grams = grams.join(context, "h")
        if prob is None:
            # Shortest: an even share for what was never seen (as many characters as were, and one).
            lower = [F.lit(1.0) / (F.col(f"kinds_{m}") + 1) for m in models]
        else:
            grams = grams.withColumn("short", F.expr("substring(gram, 2)")).join(prob.select(F.col("gram").alias("short"), *[F.col(f"p_{m}").alias(f"lower_{m}") for m in models]), "short")
            lower = [F.col(f"lower_{m}") for m in models]
        share = [F.when(F.col(f"n_{m}") > 0, (F.col(f"n_{m}") - DISCOUNT + DISCOUNT * F.col(f"kinds_{m}") * lower[m]) / F.col(f"all_{m}")).alias(f"p_{m}") for m in models]
        prob = materialize(grams.select("gram", *share), "toxicity-shared")

    seen = top.withColumn("h", F.expr(f"left(gram, {ORDER - 1})"))
    sums = [F.sum(f"n{k}_{m}").alias(f"all{k}_{m}") for m in models for k in (0, 1)] + [F.sum(F.when(F.col(f"n{k}_{m}") > 0, 1).otherwise(0)).alias(f"kinds{k}_{m}") for m in models for k in (0, 1)]
    either = [F.count(F.when(F.col(f"n0_{m}") + F.col(f"n1_{m}") > 0, 1)).alias(f"kinds_{m}") for m in models]
    context = materialize(seen.groupBy("h").agg(*sums, *either), "toxicity-contexts")
    seen = seen.join(context, "h").withColumn("short", F.expr("substring(gram, 2)")).join(prob.withColumnRenamed("gram", "short"), "short")

    def left(k: int, m: int) -> Column:
        """Share of the context's mass that goes to the shared part."""
        return (strength + DISCOUNT * F.col(f"kinds{k}_{m}")) / (F.col(f"all{k}_{m}") + strength)

    def log_p(k: int, m: int) -> Column:
        pooled = (F.col(f"n0_{m}") + F.col(f"n1_{m}") - DISCOUNT + DISCOUNT * F.col(f"kinds_{m}") * F.col(f"p_{m}")) / (F.col(f"all0_{m}") + F.col(f"all1_{m}"))
        return F.log(F.greatest(F.col(f"n{k}_{m}") - DISCOUNT, F.lit(0.0)) / (F.col(f"all{k}_{m}") + strength) + left(k, m) * pooled)

    def value(there: Column, llr: Column, m: int) -> Column:
        return F.when(there, F.round(llr * UNIT).cast("long")).alias(f"llr{m}")

    full = [value(F.col(f"n0_{m}") + F.col(f"n1_{m}") > 0, log_p(1, m) - log_p(0, m), m) for m in models]
    part = [value(F.col(f"kinds_{m}") > 0, F.log(left(1, m)) - F.log(left(0, m)), m) for m in models]
    return materialize(seen.select("gram", *full).unionAll(context.select(F.col("h").alias("gram"), *part)), "toxicity-scores")


def _scores_of(models: DataFrame, m: int) -> DataFrame:
    """``(gram, llr)`` of one of the models."""
    return models.select("gram", F.col(f"llr{m}").alias("llr")).where("llr is not null")


def model(texts: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """``(gram, llr)`` from ``(text, toxic)``, in parts of ``UNIT``: of every seen gram, and (one character shorter) of every seen context."""
    return _scores_of(_models(texts.select("text", "toxic", F.lit(0).alias("fold")), strength, 1), 0)


def _hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` characters."""
    n = len(codes) - width + 1
    with np.errstate(over="ignore"):
        h = np.zeros(max(n, 0), _U)
        for j in range(width):
            h += (codes[j : j + n].astype(_U) + _U(1)) * _PLACE[j]
        return mix(h + _U(width))


class Scores:
    """The scores as sorted hashes, and the words met so far."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        there = self.keys[at] == h
        return np.where(there, self.values[at], 0), there

    def learn(self, words: list[str]) -> None:
        """Log likelihood ratio of each word."""
        text = "".join([PAD * (ORDER - 1) + w + END for w in words])
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        full, seen = self.look_up(_hashes(codes, ORDER))
        part, _ = self.look_up(_hashes(codes, ORDER - 1)[: len(full)])
        llr = np.where(seen, full, part)
        lens = np.array([len(w) for w in words]) + ORDER
        start = np.cumsum(lens) - lens
        total = np.concatenate([[0], np.cumsum(np.append(llr, np.zeros(ORDER - 1, np.int64)))])
        sums = total[start + lens - ORDER + 1] - total[start]
        self.new.update(zip(words, sums.tolist(), strict=True))

    def of(self, texts: list[str | None], high: float = HIGH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of the words' ratios, sum of what they have beyond ``HIGH``, and number of words of each text."""
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        missing = []
        for w in set().union(*found) - self.new.keys():
            if w in self.old:
                self.new[w] = self.old[w]
            else:
                missing.append(w)
        if missing:
            self.learn(sorted(missing))
        get = self.new.__getitem__
        n = np.array([len(ws) for ws in found], np.int64)
        values = np.fromiter((get(w) for ws in found for w in ws), np.int64, int(n.sum()))
        first = np.concatenate([[0], np.cumsum(n)])

        def total(v: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(v)])
            return (sums[first[1:]] - sums[first[:-1]]) / UNIT

        return total(values), total(np.maximum(values - round(high * UNIT), 0)), n


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores ``(gram, llr)`` with the hashes of the grams in their place."""
    for batch in batches:
        grams = batch.column(0).to_pylist()
        keys = np.zeros(len(grams), _U)
        for width in (ORDER - 1, ORDER):
            own = [i for i, g in enumerate(grams) if len(g) == width]
            if own:
                codes = np.frombuffer("".join([grams[i] for i in own]).encode("utf-32-le"), np.uint32)
                keys[own] = _hashes(codes, width)[::width]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(1)], ["key", "llr"])


def ratios(docs: DataFrame, scores: DataFrame, carry: Sequence[str], text_col: str = "text", limit: int = BROADCAST_SCORES, high: float = HIGH) -> DataFrame:
    """Columns ``carry`` with ``llr``, ``high`` (sums over the words) and ``n_words`` of every row."""
    spark = docs.sparkSession
    if scores.count() <= limit:
        table = scores.select("gram", "llr").mapInArrow(_hashed, "key long, llr long").toArrow()
        keys, values = table["key"].to_numpy().view(_U), table["llr"].to_numpy()
        order = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[order], values[order].astype(np.int64)))

        def score(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
            s = _worker_scores(sent)
            for lo in range(0, len(texts), 256):
                part = texts.slice(lo, 256).to_pylist()
                yield lo, lo + len(part), [pa.array(x) for x in s.of(part, high)]

        return map_texts(docs, text_col, "llr double, high double, n_words long", score, carry)
    return _joined_ratios(docs, scores, carry, text_col, high)


_SCORES: dict[int, Scores] = {}


def _worker_scores(sent) -> Scores:
    """The scores of a broadcast, with the words met, kept by a Python worker while it has the broadcast."""
    key = id(sent.value)
    if key not in _SCORES or _SCORES[key].keys is not sent.value[0]:
        _SCORES.clear()
        _SCORES[key] = Scores(*sent.value)
    return _SCORES[key]


def _joined_ratios(docs: DataFrame, scores: DataFrame, carry: Sequence[str], text_col: str, most: float) -> DataFrame:
    """The same by joins: words of texts, grams of distinct words, scores."""
    row = free_name(docs, "_row")
    tagged = materialize(docs.select(*quoted(list(dict.fromkeys([*carry, text_col]))), F.monotonically_increasing_id().alias(row)), "toxicity-input")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per = [Counter(LETTERS.findall((text or "").lower())) for text in batch.column(1).to_pylist()]
            own = [r for r, c in zip(batch.column(0).to_pylist(), per, strict=True) for _ in c]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([w for c in per for w in c], pa.string()), pa.array([n for c in per for n in c.values()], pa.int64())], ["row", "word", "n"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = batch.column(0).to_pylist()
            per = [_grams([w], ORDER) for w in ws]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, g in zip(ws, per, strict=True) for _ in g], pa.string()), pa.array([x for g in per for x in g], pa.string())], ["word", "gram"])

    used = materialize(tagged.select(F.col(row).alias("row"), F.col(quoted([text_col])[0]).cast("string")).mapInArrow(words, "row long, word string, n long"), "toxicity-words")
    parts = used.select("word").distinct().mapInArrow(grams, "word string, gram string").withColumn("h", F.expr(f"left(gram, {ORDER - 1})"))
    s = scores.select("gram", "llr")
    parts = parts.join(s, "gram", "left").join(s.select(F.col("gram").alias("h"), F.col("llr").alias("less")), "h", "left")
    value = parts.groupBy("word").agg(F.sum(F.coalesce("llr", "less", F.lit(0).cast("long"))).alias("value"))
    summed = used.join(value, "word").groupBy("row").agg(
        (F.sum(F.col("value") * F.col("n")) / UNIT).alias("llr"), (F.sum(F.greatest(F.col("value") - round(most * UNIT), F.lit(0).cast("long")) * F.col("n")) / UNIT).alias("high"), F.sum("n").alias("n_words")
    )
    out = tagged.join(summed.withColumnRenamed("row", row), row, "left")
    return out.select(*quoted(carry), F.coalesce("llr", F.lit(0.0)).alias("llr"), F.coalesce("high", F.lit(0.0)).alias("high"), F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"))


def _features(llr, high, n, root, bound):
    """The values that the curve is over; ``root`` and ``bound`` come with the arguments' kind (arrays or columns)."""
    return [10 * llr / n, llr / root(n), 10 * bound(high / n), bound(high / root(n))]


def fit_curve(llr: np.ndarray, high: np.ndarray, n: np.ndarray, toxic: np.ndarray, rounds: int = 100) -> list[float]:
    """Logistic weights of the values and of 1 (Newton steps, slight ridge)."""
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    w = np.array([0.0, 0.0, 0.0, 0.0, np.log(share / (1 - share))])
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return w.tolist()
    n = np.maximum(n, 1)
    x = np.stack([*_features(llr, high, n, np.sqrt, lambda v: np.minimum(v, 3.0)), np.ones(len(n))], axis=1)
    ridge = np.array([0.05, 0.05, 0.05, 0.05, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - toxic) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return np.round(w, 9).tolist()


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """``(id, text)`` of all rows, and ``(id, text, toxic, part)`` of the labelled ones outside the held-out part."""
    ship(docs.sparkSession)
    ident = F.col(quoted([id_col])[0])
    known = labels.select(ident.alias("id"), F.col(quoted([label_col])[0]).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    known = known.where(remainder(F.col("id")) != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known.withColumn("part", remainder(F.col("id"))), "toxicity-labels")
    texts = docs.select(ident.alias("id"), F.col(quoted([text_col])[0]).cast("string").alias("text"))
    return texts, texts.where(remainder(F.col("id")) != 0).join(small_or_shuffled(known, 24), "id")


def _sample(rows: DataFrame, scores: DataFrame, limit: int, high: float = HIGH):
    """Values of a bounded sample of labelled rows, as a pandas frame."""
    found = ratios(rows.select("text", "toxic", "id"), scores, ["toxic", "id"], limit=limit, high=high)
    return found.select("toxic", "llr", "high", "n_words", "id").orderBy(F.xxhash64("id"), "id", "llr", "n_words", "toxic").limit(FIT_ROWS).toPandas()


def cross_fit(docs: DataFrame, labels: DataFrame, strengths: Sequence[float], highs: Sequence[float], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[tuple[float, float], float]:
    """Mean log loss of every ``(strength, high)`` over remainders 1 to 4; the held-out fifth is not looked at.

    Each remainder gets its values from a model of the other three, and its
    scores from a curve that is fitted on the values of the other three.
    """
    _, labelled = _labelled(docs, labels, id_col, text_col, label_col)
    labelled = materialize(labelled, "toxicity-labelled")
    out = {}
    for strength in strengths:
        models = {part: model(labelled.where(F.col("part") != part).select("text", "toxic"), strength) for part in range(1, 5)}
        for high in highs:
            folds = {part: _sample(labelled.where(F.col("part") == part), scores, BROADCAST_SCORES, high) for part, scores in models.items()}
            losses = []
            for part, fold in folds.items():
                rest = [np.concatenate([f[c].to_numpy(float) for k, f in folds.items() if k != part]) for c in ("llr", "high", "n_words", "toxic")]
                w = np.array(fit_curve(*rest))
                llr, most, n, toxic = (fold[c].to_numpy(float) for c in ("llr", "high", "n_words", "toxic"))
                n = np.maximum(n, 1)
                x = np.stack([*_features(llr, most, n, np.sqrt, lambda v: np.minimum(v, 3.0)), np.ones(len(n))], axis=1)
                p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
                losses.append(-np.log(np.where(toxic == 1, p, 1 - p)))
            out[(strength, high)] = float(np.concatenate(losses).mean())
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = BROADCAST_SCORES) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``."""
    texts, labelled = _labelled(docs, labels, id_col, text_col, label_col)
    models = _models(labelled.withColumn("fold", (F.col("part") >= 2).cast("int")), STRENGTH, 2)
    sample = _sample(labelled.where("part = 1"), _scores_of(models, 1), limit)
    w = fit_curve(*(sample[c].to_numpy(float) for c in ("llr", "high", "n_words", "toxic")))
    scores = _scores_of(models, 0)
    out = ratios(texts, scores, ["id"], limit=limit)
    values = _features(F.col("llr"), F.col("high"), F.greatest(F.col("n_words"), F.lit(1)), F.sqrt, lambda v: F.least(v, F.lit(3.0)))
    value = sum((F.lit(a) * v for a, v in zip(w, values, strict=False)), F.lit(w[-1]))
    score = F.round(1 / (1 + F.exp(-F.greatest(F.least(value, F.lit(30.0)), F.lit(-30.0)))), 9)
    return out.select("id", (remainder(F.col("id")) == 0).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    scored = score_toxicity(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id")
