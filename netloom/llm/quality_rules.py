"""Quality rules: learned decision lists over text statistics.

Statistics of every whole text come from one pass over the documents; labelled ones (about ``max_rows``, a ``bounded_sample`` by a hash)
train rules by sequential covering: a rule, a conjunction of thresholds that rejects, grows by the condition of highest information gain on
two thirds of the rows, once from each statistic, and is pruned from its end on the other third; of those precise enough there the one that
covers the most is taken, what it covers is set aside and the next one grows. The list becomes ordered Spark conditional expressions; a document that no rule rejects is kept.

Null and empty texts count no words and fail the base rule. Labels that are null or of unknown documents are left out; without two classes
there are no rules. Repeated rows and ids are rows of their own, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.blocks import slices
from netloom.llm.memory import tidy
from netloom.llm.sampling import bounded_sample
from netloom.llm.scratch import Scratch
from netloom.llm.words import Words, mix, windows

MAX_ROWS, MAX_RULES, MAX_CONDITIONS, PRECISION, LEAST_COVERED = 20_000, 8, 4, 0.98, 5
REPEAT_WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_digits", "n_lines"]
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = 1
_MARK = np.zeros(256, np.int64)
_MARK[list(b"!?")] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def repeated_words(words: Words, h: np.ndarray, n: int) -> np.ndarray:
    """Of each text, the words in windows of n words found twice or more in it."""
    out = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(words.left >= n)
    if len(at):
        key = mix(windows(h, n)[at] ^ (words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        again = at[counts[which] > 1]
        edges = np.zeros(len(words) + n + 1, np.int64)
        np.add.at(edges, again, 1)
        np.add.at(edges, again + n, -1)
        out[1:] = np.cumsum(np.cumsum(edges)[: len(words)] > 0)
    return np.diff(out[words.first])


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 8 << 20):
                words = Words(piece.column("text"))
                body, offsets = words.body, words.offsets
                raw = body.tobytes()
                total = lambda x, offsets=offsets: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
                inside = np.zeros(len(body) + 1, np.int64)
                np.add.at(inside, words.start, 1)
                np.add.at(inside, words.end, -1)
                within = np.cumsum(inside)[:-1] > 0
                columns = {
                    "doc_id": piece.column("doc_id"),
                    "n_words": words.counts,
                    "word_chars": total(within & ((body & 0xC0) != 0x80)),
                    "n_symbols": total(_SYMBOL[body]),
                    "n_dup_lines": np.array([repeated_lines(raw[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], np.int64),
                    "n_repeat_words": repeated_words(words, words.hashes(), REPEAT_WINDOW),
                    "n_upper": total(_UPPER[body]),
                    "n_letters": total(_LETTER[body]),
                    "n_marks": total(_MARK[body]),
                    "n_digits": total(_DIGIT[body]),
                    "n_lines": total(body == 10),
                }
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in columns.items()})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(count), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features() -> dict[str, Column]:
    """What rules may test, from the counts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "marks_per_word": F.col("n_marks") / words,
        "digits_per_word": F.col("n_digits") / words,
        "upper_share": F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / (F.col("n_lines") + 1),
        "words_per_line": words / (F.col("n_lines") + 1),
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > F.lit(self.threshold) if self.above else of[self.feature] <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    for c in rule:
        rows = rows & c.holds(x)
    return rows


def _gain(p0: int, n0: int, p1: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """FOIL's: positives kept times the bits saved on each."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p1 > 0, p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _best(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of highest gain on the rows."""
    p0, n0, best, found = int((rows & bad).sum()), int((rows & ~bad).sum()), 1e-9, None
    if not p0:
        return 0.0, None
    for name, v in x.items():
        order = np.argsort(v[rows], kind="stable")
        value, is_bad = v[rows][order], bad[rows][order]
        cut = np.flatnonzero(value[1:] > value[:-1])  # thresholds lie between neighbours
        p, n = np.cumsum(is_bad)[cut], np.cumsum(~is_bad)[cut]
        for above, gains in ((False, _gain(p0, n0, p, n)), (True, _gain(p0, n0, p0 - p, n0 - n))):
            if len(gains) and gains.max() > best:
                i = cut[int(gains.argmax())]
                best, found = float(gains.max()), Condition(name, above, float((value[i] + value[i + 1]) / 2))
    return best, found


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, seed: str) -> Rule:
    """A conjunction that begins with a condition on the feature ``seed``."""
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS and (rows & ~bad).any():
        _, found = _best(x if rule else {seed: x[seed]}, bad, rows)
        if found is None:
            break
        rule += (found,)
        rows = rows & found.holds(x)
    return rule


def _pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    """The beginning of the rule that does best on the rows."""
    worth: list[tuple[float, int]] = []
    for k in range(1, len(rule) + 1):
        on = _covers(rule[:k], x, rows)
        p, m = int((on & bad).sum()), int((on & ~bad).sum())
        worth.append(((p - m) / (p + m) if p + m else -1.0, -k))
    return rule[: -max(worth)[1]] if worth else ()


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """Rules in order, each for the rows that those before it leave. Each time a rule is grown from every feature, and of the pruned ones
    that are precise, on the rows for pruning and on all, that which covers the most is taken."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    left, rules = np.ones(n, bool), []
    while len(rules) < MAX_RULES and (left & bad).sum() >= LEAST_COVERED:
        best, chosen = LEAST_COVERED - 1, None
        for seed in x:
            rule = _pruned(_grow(x, bad, left & ~prune, seed), x, bad, left & prune)
            if not rule:
                continue
            on, whole = _covers(rule, x, left & prune), _covers(rule, x, left)
            precise = on.any() and (on & bad).sum() >= precision * on.sum() and (whole & bad).sum() >= precision * whole.sum()
            if precise and (whole & bad).sum() > best:
                best, chosen = int((whole & bad).sum()), rule
        if chosen is None:
            break
        rules.append(chosen)
        left &= ~_covers(chosen, x, left)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects, from 1, or 0."""
    of, out = features(), None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule:
            test = test & c.column(of)
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule, kept."""
    scratch = Scratch(spark, "quality")
    counts = scratch.keep(statistics(docs), "statistics")
    of = features()
    labelled = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = counts.join(labelled, "doc_id").select("doc_id", (F.col("quality") == 0).alias("bad"), *(v.alias(f"f_{k}") for k, v in of.items()))
    sample = bounded_sample(scratch.keep(rows, "labelled"), max_rows, *rows.columns).toPandas()
    sample = sample.sort_values(list(sample.columns), ignore_index=True).sample(frac=1.0, random_state=1)  # the same rows in the same order
    rules = learn({k: sample[f"f_{k}"].to_numpy(float) for k in of}, sample["bad"].to_numpy(bool)) if len(sample) else []
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    out = counts.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return scratch.close(out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
