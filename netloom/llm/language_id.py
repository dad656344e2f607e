"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its words' character n-grams (UTF-8 bytes of each lower-cased word between marks, n of 1 to 4, hashed to
``BUCKETS``); a linear layer and a softmax give the language. Both layers are trained by stochastic gradient descent in numpy on about
``max_rows`` labelled texts (``bounded_by_class``, by a hash), and ``LEAST_ROWS`` of a rarer language, of ``MOST_LANGUAGES`` at most. A quarter of these is set
aside to calibrate: a temperature for the scores, and the rejection.

A softmax spreads over known languages alone, so it is as sure of a text in none of them. What is rejected is told by how well the n-grams suit the
language chosen: the mean log-probability of a text's n-grams by that language's own frequencies, against the mean of its texts set aside, times the root
of the number of words (``MOST_WORDS`` at most, as long texts vary too). Each language is left out in turn to see what its texts get under the others.
Where half of these get less than all but a share of ``LOSS`` of the known texts set aside, the bound lies a quarter of the way from the latter
to the former (``MARGIN``), and else at the latter. A language learned
from fewer than ``LEAST_ROWS`` texts rejects none, as its n-grams are too little known, and fewer than so many texts set aside set no bound.

As the mean and the layers are linear, the two are multiplied out into one small table (BUCKETS x languages, of fixed size) for the tasks that
predict, beside the table of log-probabilities; each distinct word of a batch is looked up once. Whole texts are read.

Texts that are null, empty or without a letter are ``und`` with score 0 and are rejected, and so are all if no row is labelled. Repeated rows and
ids are rows of their own, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.blocks import slices
from netloom.llm.memory import forget, release, tidy
from netloom.llm.sampling import bounded_by_class
from netloom.llm.words import Words, mix

BUCKETS, DIMENSIONS, ORDERS, MAX_ROWS, LEAST_ROWS = 1 << 14, 16, (1, 2, 3, 4), 2000, 50
EPOCHS, BATCH, RATE, SEED = 12, 16, 20.0, 7
#: Share of the known texts set aside that the rejection may cost, and how far the bound goes from there to what texts of unknown languages get; words that count for how sure it is; languages learned.
LOSS, MARGIN, MOST_WORDS, MOST_LANGUAGES = 0.001, 0.25, 50, 400
#: Bytes of text that a task looks at together.
AT_ONCE = 1 << 18
_K = np.uint64(0x9E3779B97F4A7C15)
RESULTS = ["lang_pred", "score", "rejected"]


def subwords(words: Words, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the words at ``index``: rows (place in index, bucket) of all their n-grams."""
    start, end = words.start[index], words.end[index]
    size = end - start + 2
    first = np.cumsum(size) - size
    chars = np.full(int(size.sum()), 1, np.uint64)  # 1 marks begin and end
    word = np.repeat(np.arange(len(index)), size)
    place = np.arange(len(chars)) - first[word]
    inner = (place > 0) & (place < size[word] - 1)
    chars[inner] = words.body[(start[word] + place - 1)[inner]]
    left = size[word] - place
    at, buckets, h = [], [], np.zeros(len(chars), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(chars), np.uint64)
        shifted[: max(len(chars) - n + 1, 0)] = chars[n - 1 :]
        h = h * _K + shifted + np.uint64(1)
        if n in ORDERS:
            ok = np.flatnonzero(left >= n)
            at.append(word[ok])
            buckets.append((mix(h[ok] + np.uint64(n)) >> np.uint64(64 - 14)).astype(np.int64))
    return np.concatenate(at), np.concatenate(buckets)


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and which of them each word is."""
    _, index, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    return index, which


@dataclass
class Languages:
    names: list[str]
    table: np.ndarray  # BUCKETS x languages: the logits of a text are the mean of its n-grams' rows, plus bias
    bias: np.ndarray
    temperature: float
    usual: np.ndarray  # BUCKETS x languages: log-probabilities of n-grams
    centre: np.ndarray  # their mean in texts of each language
    least: float  # how far below that a text may be

    def scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each text the probabilities of the languages, and how well its n-grams suit the likeliest."""
        n, m = len(words.counts), len(self.names)
        if not len(words) or not m:
            return np.full((n, m), 1.0 / max(m, 1)), np.zeros(n)
        index, which = distinct(words)
        at, bucket = subwords(words, index)
        grams = np.bincount(at, minlength=len(index))[which]
        total = np.maximum(np.bincount(words.doc, weights=grams, minlength=n), 1)

        def means(column: np.ndarray) -> np.ndarray:
            of_word = np.bincount(at, weights=column[bucket], minlength=len(index))
            return np.bincount(words.doc, weights=of_word[which], minlength=n) / total

        logits = np.stack([means(self.table[:, k]) for k in range(m)], axis=1) + self.bias
        best, mean = logits.argmax(axis=1), np.zeros(n)
        for k in np.unique(best).tolist():
            mean[best == k] = means(self.usual[:, k])[best == k]
        return softmax(logits / self.temperature), suits(mean, self.centre[best], words.counts)


def suits(mean: np.ndarray, centre: np.ndarray, words: np.ndarray) -> np.ndarray:
    """0 where a text's n-grams are as probable as usual, the less the stranger and the longer it is."""
    return (mean - centre) * np.sqrt(np.minimum(words, MOST_WORDS))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bags(rows: DataFrame) -> DataFrame:
    """lang, words, buckets, counts: how often each n-gram bucket is in each text, of bounded size however long the text."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", AT_ONCE):
                words = Words(piece.column("text"), lower=True)
                buckets, counts = [], []
                if len(words):
                    index, which = distinct(words)
                    at, bucket = subwords(words, index)
                    order = np.argsort(at, kind="stable")
                    edges, bucket = np.searchsorted(at[order], np.arange(len(index) + 1)), bucket[order]
                for i in range(len(piece)):
                    a, b = words.first[i], words.first[i + 1]
                    if a == b:
                        buckets.append(np.zeros(0, np.int32))
                        counts.append(np.zeros(0, np.int64))
                        continue
                    own, times = np.unique(which[a:b], return_counts=True)
                    grams = np.concatenate([bucket[edges[w] : edges[w + 1]] for w in own])
                    count = np.bincount(grams, weights=np.repeat(times, edges[own + 1] - edges[own]), minlength=BUCKETS)
                    held = np.flatnonzero(count)
                    buckets.append(held.astype(np.int32))
                    counts.append(count[held].astype(np.int64))
                yield pa.RecordBatch.from_pydict({"lang": piece.column("lang"), "words": pa.array(words.counts, pa.int64()), "buckets": pa.array(buckets, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int64()))})

    return rows.mapInArrow(tidy(fold), "lang string, words long, buckets array<int>, counts array<long>")


def train(rows: pa.Table, seed: int = SEED) -> Languages:
    lang = rows.column("lang").to_pylist()
    names = sorted(set(lang))
    if not names:
        return Languages([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 0.0)
    y = np.array([names.index(x) for x in lang])
    held = [(np.asarray(b, np.int64), np.asarray(c, float)) for b, c in zip(rows.column("buckets").to_pylist(), rows.column("counts").to_pylist(), strict=True)]
    xs = [(b, (c / max(c.sum(), 1)).astype(np.float32)) for b, c in held]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside, fit = (order[::4], np.setdiff1d(order, order[::4])) if len(y) >= 8 else (order, order)
    fit = np.union1d(fit, np.flatnonzero(np.isin(y, np.setdiff1d(y, y[fit]))))  # a language that is set aside whole is learned as well
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIMENSIONS, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    mean = lambda i: xs[i][1] @ e[xs[i][0]]
    steps, step = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(fit), max(1, -(-len(fit) // BATCH))):
            rate, step = RATE * (1 - step / steps), step + 1
            h = np.stack([mean(i) for i in part])
            g = softmax(h @ w + bias)
            g[np.arange(len(part)), y[part]] -= 1
            g /= len(part)
            back = g @ w.T
            w -= 0.1 * rate * h.T @ g
            bias -= 0.01 * rate * g.sum(axis=0)
            for i, d in zip(part, back, strict=True):
                e[xs[i][0]] -= rate * np.outer(xs[i][1], d)
    logits = np.stack([mean(i) for i in aside]) @ w + bias
    losses = [(-np.log(softmax(logits / t)[np.arange(len(aside)), y[aside]] + 1e-12).mean(), t) for t in np.geomspace(0.1, 10, 41)]
    temperature = float(min(losses)[1])
    usual, centre, least = calibrated(held, y, np.asarray(rows.column("words"), np.int64), fit, aside, np.stack([mean(i) for i in range(len(y))]) @ w + bias)
    return Languages(names, e @ w, bias, temperature, usual, centre, least)


def calibrated(held: list, y: np.ndarray, words: np.ndarray, fit: np.ndarray, aside: np.ndarray, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The log-probabilities of n-grams by language, their mean in its texts (none where it has too few), and the bound of the rejection, of the sample's rows (buckets and counts),
    their languages, numbers of words and logits. Log-probabilities come from ``fit``, the means and the bound from ``aside``."""
    m = logits.shape[1]
    mass = np.full((BUCKETS, m), 0.5)
    for i in fit:
        mass[held[i][0], y[i]] += held[i][1]
    usual = np.log(mass / mass.sum(axis=0)).astype(np.float32)
    some = np.array([c.sum() > 0 for _, c in held], bool)
    means = np.stack([c @ usual[b] / max(c.sum(), 1) for b, c in held])
    centre = np.zeros(m)
    for k in range(m):
        own = aside[(y[aside] == k) & some[aside]]
        own = own if len(own) else np.flatnonzero((y == k) & some)
        centre[k] = means[own, k].mean() if len(own) else 0.0
    centre[np.bincount(y[fit], minlength=m) < LEAST_ROWS] = -np.inf
    known = aside[some[aside] & (logits[aside].argmax(axis=1) == y[aside]) & np.isfinite(centre[y[aside]])]
    if len(known) < LEAST_ROWS:
        return usual, centre, -np.inf
    bound = float(np.quantile(suits(means[known, y[known]], centre[y[known]], words[known]), LOSS, method="lower"))
    strange = []
    for k in range(m if m > 1 else 0):
        own = np.flatnonzero((y == k) & some)
        others = logits[own].copy()
        others[:, k] = -np.inf
        best = others.argmax(axis=1)
        strange.append(suits(means[own, best], centre[best], words[own]))
    unknown = float(np.median(np.concatenate(strange))) if strange else np.inf
    return usual, centre, bound + MARGIN * min(unknown - bound, 0.0) if np.isfinite(unknown) else bound


def has_letter(words: Words, texts) -> np.ndarray:
    body = words.body
    ascii_letter = ((body >= 97) & (body <= 122)) | ((body >= 65) & (body <= 90))
    found = np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[words.offsets]) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in (texts[int(i)].as_py() or ""))
    return found


def guessed(model: Languages):
    """A column function: text -> RESULTS. Only the texts go to Python, a piece at a time; what else a row holds stays in Spark."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def piece(texts: pa.Array) -> pa.Array:
        words = Words(texts, lower=True)
        letters = has_letter(words, texts) & pc.is_valid(texts).to_numpy(zero_copy_only=False) & bool(model.names)
        p, suit = model.scores(words)
        best = p.argmax(axis=1) if model.names else np.zeros(len(p), int)
        score = np.where(letters, p.max(axis=1, initial=0.0), 0.0)
        names = pa.array(model.names or ["und"]).take(pa.array(best))
        return pa.StructArray.from_arrays([pc.if_else(pa.array(letters), names, "und"), pa.array(score), pa.array(~letters | (suit < model.least))], fields=list(kind))

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        for texts in batches:
            pieces = [piece(x.column(0)) for x in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", AT_ONCE)]
            release()
            yield pa.concat_arrays(pieces) if pieces else pa.array([], kind)

    return guess


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """All columns of ``docs`` but those named as results, and lang_pred, score, rejected."""
    found = guessed(model)(F.col("text").cast("string"))
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in RESULTS), *(found.getField(c).alias(c) for c in RESULTS))


def recognised(docs: DataFrame, model: Languages) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject. A model that has learned no language can't tell, and rejects none but texts that
    are null or without a letter."""
    text = F.col("text").cast("string")
    if not model.names:
        return docs.where(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    return docs.where(~guessed(model)(text).getField("rejected"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Languages:
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sample = bounded_by_class(rows, max_rows, LEAST_ROWS, MOST_LANGUAGES, "lang", "doc_id", "text")
    return train(bags(sample.select("lang", "text")).toArrow())


def language_id(spark: SparkSession, docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs, max_rows)
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(asked, model).drop("text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), max_rows=2000)
