"""A quality classifier: naive Bayes support vectors over n-gram indicators.

An n-gram is one or two words as they are written, or one to four word shapes in a row: the kinds of a word's first and last character, its length in
classes, and whether it repeats the word before. N-grams are hashed to ``BUCKETS``; a text's indicators say which it has, however often.

1. Class counts: of every labelled row to learn from, each task adds up in how many rows of either class each bucket is; the sums give the log-count
   ratio of each bucket, smoothed. All labelled rows count.
2. Support vectors: on about ``max_rows`` of these rows (by a hash of the id) indicators are scaled by the ratios to vectors of unit length, and a
   linear hinge-loss model is fitted by dual coordinate descent, then drawn towards the mean weight (``BLEND``), that is towards naive Bayes.
3. Margins of a quarter of the sample that the fit leaves out give a sigmoid from margins to probabilities; the model is then fitted on the whole sample.
4. Scores: weights and ratios are one table of BUCKETS numbers each, of fixed size, for the tasks. Whole texts are read, long ones in pieces.

Rows without an id, a label or with a null label teach nothing; an id with labels of both classes counts as class 0. Null and empty texts have no
indicators: they score what the sigmoid gives for the bias alone. Where no row is labelled all score 0.5, where all labels are equal the smoothed
share of label 1. Repeated rows are rows of their own, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.memory import release, tidy
from netloom.llm.runs import Runs, byte_set, pieces
from netloom.llm.sampling import bounded_sample
from netloom.llm.words import mix
from netloom.plans.joins import small

BITS = 17
BUCKETS, MAX_ROWS, SHAPES = 1 << BITS, 4000, 4
#: Smoothing of class counts, the cost of a margin violated, epochs of the descent, and the share of the fitted weights against their mean.
ALPHA, COST, EPOCHS, BLEND, SEED = 1.0, 1.0, 30, 0.75, 11
LEAST_SCORE = 0.3
WORD = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes and texts of a piece: a piece has a flag for each of its texts and buckets.
AT_ONCE, ROWS = 1 << 20, 128
_KIND = np.full(256, 4, np.uint64)  # marks
for _k, (_a, _b) in enumerate(((0x61, 0x7A), (0x41, 0x5A), (0x30, 0x39), (0x80, 0xFF))):
    _KIND[_a : _b + 1] = _k
_K = np.uint64(0x9E3779B97F4A7C15)


def ngrams(runs: Runs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts and buckets of all n-grams in a piece."""
    h = runs.hashes()
    size = (runs.end - runs.start).astype(np.uint64)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (runs.doc[1:] == runs.doc[:-1])
    length = (size > 1).astype(np.uint64) + (size > 3) + (size > 7) + (size > 15)
    shape = ((_KIND[runs.body[runs.start]] * np.uint64(8) + _KIND[runs.body[runs.end - 1]]) * np.uint64(8) + length) * np.uint64(2) + again
    left = runs.first[1:][runs.doc] - np.arange(len(h))
    for kind, codes, most in ((1, h, 2), (2, shape, SHAPES)):
        run = np.full(len(codes), kind, np.uint64)
        for n in range(1, most + 1):
            ok = np.flatnonzero(left >= n)
            run = run[: len(codes) - n + 1] * _K + codes[n - 1 :] if n <= len(codes) else run[:0]
            yield runs.doc[ok], (mix(run[ok] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)


def indicators(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of some texts of a batch after the other: the first, how many, and for each bucket that a text has, the text's place among them and the bucket."""
    flags = None
    for piece in pieces(texts, AT_ONCE, WORD, rows=ROWS):
        if not piece.begun:
            flags = np.zeros(len(piece) << BITS, bool)
        for doc, bucket in ngrams(Runs(piece, WORD)):
            flags[(doc << BITS) + bucket] = True
        if piece.ended:
            at = np.flatnonzero(flags)
            yield piece.first, len(piece), at >> BITS, at & (BUCKETS - 1)


@dataclass
class Model:
    weight: np.ndarray  # of a bucket's indicator, its ratio multiplied in
    square: np.ndarray  # its ratio squared
    bias: float
    slope: float
    shift: float

    def margins(self, n: int, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        length = np.sqrt(np.bincount(doc, weights=self.square[bucket], minlength=n))
        return np.bincount(doc, weights=self.weight[bucket], minlength=n) / np.where(length > 0, length, 1) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def ratios(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The log-count ratio of each bucket, from the numbers of rows of either class that have it."""
    p, q = ones + ALPHA, zeros + ALPHA
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators and the bias, by dual coordinate descent on the hinge loss: one dual variable in [0, cost] for each row, each step
    the exact minimum in its variable. ``rows``: the buckets of each; ``y``: 1 or -1. The bias is the weight of a further indicator, always 1."""
    w, bias, alpha = np.zeros(len(r)), 0.0, np.zeros(len(y))
    xs = [r[b] / max(float(np.sqrt((r[b] ** 2).sum())), 1e-12) for b in rows]
    norm = np.array([1.0 + float((x * x).sum()) for x in xs])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (float(xs[i] @ w[rows[i]]) + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * xs[i]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return BLEND * w + (1 - BLEND) * np.abs(w).mean(), bias


def sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of label 1 given a margin, by Newton steps on the likelihood of smoothed labels."""
    ones, zeros = int((y > 0).sum()), int((y < 0).sum())
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    theta = np.array([1.0, 0.0])
    loss = lambda t: float(np.logaddexp(0, x @ t).sum() - target @ (x @ t)) + 1e-3 * float(t @ t)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        gradient = x.T @ (p - target) + 2e-3 * theta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), gradient)
        size = 1.0
        while loss(theta - size * step) > loss(theta) and size > 1e-6:
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def train(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray) -> Model:
    """``rows``: the buckets of each row of the sample; ``y``: 1 or -1; ``r``: the ratios."""
    ones = int((y > 0).sum())
    if not ones or ones == len(y):
        share = (ones + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    aside = np.arange(len(y)) % 4 == 3
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False

    def fitted(own: np.ndarray) -> Model:
        w, bias = descend([rows[i] for i in np.flatnonzero(own)], y[own], r)
        return Model(w * r, r * r, bias, 1.0, 0.0)

    def margins(model: Model, own: np.ndarray) -> np.ndarray:
        held = [rows[i] for i in np.flatnonzero(own)]
        return model.margins(len(held), np.repeat(np.arange(len(held)), [len(b) for b in held]), np.concatenate([*held, np.zeros(0, np.int64)]))

    model = fitted(np.ones(len(y), bool))
    judged = aside if aside.any() else ~aside
    model.slope, model.shift = sigmoid(margins(fitted(~aside) if aside.any() else model, judged), y[judged])
    return model


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, the rows (label 0 or 1, text) of label 1 and of label 0 that have it: sums of tasks, at most BUCKETS rows in the end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy()
            for first, _, doc, bucket in indicators(batch.column(1)):
                for k in (0, 1):
                    total[k] += np.bincount(bucket[label[first + doc] == k], minlength=BUCKETS)
        held = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int32()), "zeros": total[0, held], "ones": total[1, held]})

    sums = rows.select("label", "text").mapInArrow(tidy(count), "bucket int, zeros long, ones long").groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    out = np.zeros((2, BUCKETS))
    for k, c in enumerate(("zeros", "ones")):
        out[k, sums.column("bucket").to_numpy()] = sums.column(c).to_numpy()
    return out[1], out[0]


def sampled(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets and labels (1 or -1) of a bounded sample, in the order of its ids; a row travels as BUCKETS bits, however long its text."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, doc, bucket in indicators(batch.column("text")):
                flags = np.zeros(n << BITS, bool)
                flags[(doc << BITS) + bucket] = True
                packed = np.packbits(flags.reshape(n, BUCKETS), axis=1)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, n), "label": batch.column("label").slice(first, n), "bits": pa.array([x.tobytes() for x in packed], pa.binary())})

    found = rows.select("doc_id", "label", "text").mapInArrow(tidy(bits), "doc_id long, label int, bits binary").toArrow()
    held = sorted(zip(found.column("doc_id").to_pylist(), found.column("label").to_pylist(), found.column("bits").to_pylist(), strict=True))
    order = np.random.default_rng(SEED).permutation(len(held))
    return [np.flatnonzero(np.unpackbits(np.frombuffer(held[i][2], np.uint8))) for i in order], np.array([2 * held[i][1] - 1 for i in order], np.int64)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    asked = docs.where(~held_out() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.col("quality") == 1).cast("int")).alias("label"))
    known = known.where(~held_out())
    rows = asked.join(small(known), "doc_id")
    ones, zeros = class_counts(rows)
    taken = bounded_sample(known, max_rows, "doc_id")
    return train(*sampled(asked.join(small(taken), "doc_id")), ratios(ones, zeros))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(model.margins(n, doc, bucket)) for _, n, doc, bucket in indicators(batch.column(2))]
            p = np.concatenate([*found, np.zeros(0)])
            release()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= LEAST_SCORE).astype(np.int32))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(score), "doc_id long, held_out boolean, score double, predicted int")


def quality_svm(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    return scored(docs, fit(docs, labels, max_rows))


def op12_quality_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_svm(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), max_rows=4000)
