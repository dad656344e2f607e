"""Language-model scores from a probabilistic suffix tree over words.

Symbols are the lower-cased (A-Z) words of a text, then one end. A context is up to ``depth`` preceding words of the same text. Level by level,
a retained context (and the empty one) is extended by one more word where the training texts hold the longer one ``min_count`` times, and
the longer one is retained if it tells more than its suffix: the leave-one-out gain

    sum over its next symbols w of c(s w) * log(((c(s w) - 1 + k q(w)) / (c(s) - 1 + k)) / q(w)),   q(w) = c(suffix w) / c(suffix)

exceeds ``min_gain`` nats. So a context whose next symbols differ from its suffix's by chance alone (each once) loses and is dropped.
Distributions are smoothed downwards, P(w | s) = (c(s w) + k P(w | suffix)) / (c(s) + k), with (c + 1) / (N + V + 1) at the root, and a
symbol is scored in the longest retained suffix of what precedes it.

The model lies in the shuffled sums of ``blocks``: each block of documents asks for the counts of its n-grams and for the gains of its
contexts, and scores itself with the answers. With the counts of words come numbers for them, without large gaps, and with the counts of
n-grams numbers for those that occur ``min_count`` times. A longer n-gram is asked for by the numbers of its context and its last word: few
bytes and no collisions (where the two need more than 64 bits, by a hash of them; words themselves are told apart by 64-bit hashes). No table of words or contexts reaches the driver or is broadcast; a hot context costs one entry
per next symbol and block.

Null texts count as empty: they hold the end alone. A null doc_id counts as text "". Repeated rows and ids are rows of their own, an empty
table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.blocks import answered, answers, decode, distinct, encode, pack, range_of, ranges, rows_of, summed, unpack, write_blocks
from netloom.llm.memory import tidy
from netloom.llm.scratch import Scratch
from netloom.llm.words import Words, mix

DEPTH, MIN_COUNT, SMOOTH, MIN_GAIN = 2, 16, 8.0, 4.0
FOLDS, HELD = 7, 2
_END = np.uint64(0x1D8AF06C3F5B9E27)
_K = np.uint64(0xD6E8FEB86659FD93)
#: Smaller than elsewhere: a block's symbols, n-grams and answers are in memory together.
BLOCK_BYTES, RANGE_BYTES = 2 << 20, 4 << 20
#: Gains are summed as integers of this unit, so that the order of adding doesn't matter.
UNIT = 1 << 16


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD for i in ids], bool)


def numbered(table: pa.Table) -> pa.Table:
    """A block's texts as numbers: its distinct symbols' hashes, the frequent ones first, and the numbers of all its symbols in these."""
    words = Words(table.column("text"), lower=True)
    n = len(words.counts)
    first = words.first + np.arange(n + 1)
    h = np.full(len(words) + n, _END, np.uint64)
    h[np.arange(len(words)) + words.doc] = words.hashes()
    vocabulary, _, number = distinct(h)
    often = np.bincount(number, minlength=len(vocabulary))
    rank = _ranks(often)
    return pa.table(
        {
            "doc_id": table.column("doc_id"),
            "size": pa.array(np.diff(first)),
            "symbols": _once(pack(rank[number]), n),
            "often": _once(pack(often), n),
            "vocabulary": _once(pack(np.diff(vocabulary, prepend=np.uint64(0))), n),
        }
    )


def counted_once(payload, n_ranges: int) -> bytes:
    """A block whose symbols have been counted: of their hashes only the order, which ``often`` tells, and the ranges are needed from now on."""
    table, tree = decode(payload), _Tree(payload)
    parts = np.diff(range_of(tree.key[tree.order], n_ranges), prepend=0)
    return encode(table.drop_columns("vocabulary").append_column("ranges", _once(pack(parts), len(table))))


def _once(raw: bytes, n: int) -> pa.Array:
    """What is the whole block's is held by its first row."""
    return pa.array([raw] + [b""] * (n - 1), pa.large_binary())


def _ranks(often: np.ndarray) -> np.ndarray:
    """The numbers of symbols sorted by hash: the frequent ones first."""
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


class _Tree:
    """A block's symbols and, level by level, its n-grams with their corpus-wide counts and the contexts that are retained."""

    def __init__(self, payload, n_ranges: int = 1):
        table = decode(payload)
        self.ids = table.column("doc_id").to_pylist()
        self.first = np.concatenate([[0], np.cumsum(table.column("size").to_numpy())])
        self.number = unpack(table.column("symbols")[0].as_py(), int(self.first[-1])).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.place = np.arange(len(self.number)) - self.first[self.doc]
        self.train = ~held_out(self.ids)[self.doc] if len(self.ids) else np.zeros(0, bool)
        n = int(self.number.max()) + 1
        self.order = _ranks(unpack(table.column("often")[0].as_py(), n).astype(np.int64))
        whole = "vocabulary" in table.schema.names
        key = np.cumsum(unpack(table.column("vocabulary" if whole else "ranges")[0].as_py(), n), dtype=np.uint64)
        self.key = np.empty(n, np.uint64)
        self.key[self.order] = key if whole else key << np.uint64(64 - (n_ranges.bit_length() - 1))
        self.gram = self.number  # of each position: the number of the n-gram that ends there, or -1
        self.at = np.arange(len(self.number))
        self.kept = np.ones(len(self.number), bool)  # of each position: its context of this level is retained
        self.depth = 0

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the level's n-grams, and how often each occurs here in training."""
        local = np.bincount(self.gram[self.at], weights=self.train[self.at], minlength=len(self.key))
        return self.key[self.order], local[self.order].astype(np.int64)

    def counted(self, found: pa.StructArray | None, n_ranges: int) -> None:
        count, credit, number = _told(found)
        self.count, self.credit, self.id = np.empty(len(self.key), np.int64), np.empty(len(self.key), bool), np.empty(len(self.key), np.int64)
        self.count[self.order], self.credit[self.order], self.id[self.order] = count, credit, number * n_ranges
        self.id += range_of(self.key, n_ranges)
        if not self.depth:
            self.word = self.id

    def climb(self, total: int, min_count: int, bits: tuple[int, int], n_ranges: int) -> None:
        """To the n-grams one longer, at positions whose context may be retained. ``bits``: of the numbers of contexts and of words."""
        below = self.gram
        before = np.full(len(below), -1)
        before[1:] = below[:-1]
        before[self.place == 0] = -1
        ok = self.kept & (before >= 0)
        ok[ok] = self.count[before[ok]] >= min_count
        at = np.flatnonzero(ok)
        key, index, number = distinct(_joined(self.id[before[at]], self.word[self.number[at]], *bits, n_ranges))
        context = before[at[index]]
        self.lower_key = _aligned(self.id, n_ranges)
        self.context_of, self.context_count = context, self.count[context]
        w_below = below[at[index]]  # the n-gram of the suffix and the symbol
        suffix_count = self.suffix_counts[at[index]] if self.depth else total
        self.q = self.count[w_below] / np.maximum(suffix_count, 1)
        suffix_counts = np.zeros(len(below), np.int64)
        suffix_counts[at] = self.count[before[at]]
        self.suffix_counts = suffix_counts  # of each position: how often its context of the new level occurs
        self.key, self.order = key, slice(None)
        gram = np.full(len(below), -1)
        gram[at] = number
        self.gram, self.at = gram, at
        self.depth += 1

    def group(self) -> None:
        """The level's n-grams by their contexts."""
        held = np.zeros(len(self.lower_key), bool)
        held[self.context_of] = True
        self.contexts, self.which = np.flatnonzero(held), (np.cumsum(held) - 1)[self.context_of]
        self.context_key = self.lower_key[self.contexts]
        self.context_order = np.argsort(self.context_key)

    def gains(self, smooth: float) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys of the contexts, and the gain of what this block has to tell of each."""
        tell = np.flatnonzero(self.credit & (self.count > 0))
        c, q, s = self.count[tell], self.q[tell], self.context_count[tell]
        gain = c * (np.log((c - 1 + smooth * q) / (s - 1 + smooth)) - np.log(q))
        whole = np.bincount(self.which[tell], weights=np.round(gain * UNIT), minlength=len(self.contexts)).astype(np.int64)
        return self.context_key[self.context_order], whole[self.context_order]

    def retain(self, found: list) -> None:
        retained = np.empty(len(self.contexts), bool)
        retained[self.context_order] = answered(found, 1)[0]
        kept = np.zeros(len(self.number), bool)
        kept[self.at] = retained[self.which][self.gram[self.at]]
        self.kept = kept


def _aligned(number: np.ndarray, n_ranges: int) -> np.ndarray:
    """A key of a number: its range, then its rank there."""
    x, r = number.astype(np.uint64), np.uint64(n_ranges.bit_length() - 1)
    return (x & np.uint64(n_ranges - 1)) << (np.uint64(64) - r) | x >> r


def _low(context_bits: int, word_bits: int, n_ranges: int) -> int | None:
    """The bits at the end of a key of both numbers that hold the word's rank: whole bytes, if these fit; None if the numbers don't."""
    r = n_ranges.bit_length() - 1
    rank = max(word_bits - r, 0)
    return next((x for x in (-(-rank // 8) * 8, rank) if r + context_bits + x <= 64), None)


def _joined(context: np.ndarray, word: np.ndarray, context_bits: int, word_bits: int, n_ranges: int) -> np.ndarray:
    """A key of both numbers: a range, the context, the word's rank in the word's range. The range is the word's, moved on by the context, so that the
    n-grams of a frequent context or word are spread over all ranges, and it tells, with the context, the word's range."""
    c, w = context.astype(np.uint64), word.astype(np.uint64)
    low = _low(context_bits, word_bits, n_ranges)
    if low is None:
        return mix(mix(c) * _K + w)
    r = np.uint64(n_ranges.bit_length() - 1)
    part = (w + mix(c)) & np.uint64(n_ranges - 1)
    return part << (np.uint64(64) - r) | c << np.uint64(low) | w >> r


class Model:
    """The rounds: 0 counts the symbols; for each level d, round 2 d - 1 counts its n-grams and round 2 d adds up its contexts' gains."""

    def __init__(self, depth: int, min_count: int, smooth: float, n_ranges: int):
        self.depth, self.min_count, self.smooth, self.n_ranges = depth, min_count, smooth, n_ranges
        self.total = self.distinct = 0
        self.bits: list[int] = []  # of the numbers of words, and of contexts of each length from 2 on

    def grown(self, row: dict, answered_rounds: int) -> _Tree:
        tree = _Tree(row["payload"], self.n_ranges)
        if not answered_rounds:
            return tree
        tree.keys()
        tree.counted(row["round0"], self.n_ranges)
        whole = answered_rounds > 2 * self.depth
        if whole:
            count = tree.count[tree.gram]
            tree.known = count > 0
            tree.base = (count + 1.0) / (self.total + self.distinct + 1)
            tree.p = tree.base.copy()
            tree.in_context = np.zeros(len(tree.p), bool)
        for d in range(1, self.depth + 1):
            tree.climb(self.total, self.min_count, (self.bits[d - 1], self.bits[0]), self.n_ranges)
            if answered_rounds < 2 * d:
                break
            tree.keys()
            tree.counted(row[f"round{2 * d - 1}"], self.n_ranges)
            tree.group()
            if answered_rounds < 2 * d + 1:
                break
            tree.retain(row[f"round{2 * d}"])
            if not whole:
                continue
            at = np.flatnonzero(tree.kept)
            tree.in_context[at] = True
            tree.p[at] = (tree.count[tree.gram[at]] + self.smooth * tree.p[at]) / (tree.suffix_counts[at] + self.smooth)
        return tree

    def ask(self, k: int):
        def asked(row: dict) -> tuple:
            tree = self.grown(row, k)
            keys, values = tree.gains(self.smooth) if k and k % 2 == 0 else tree.keys()
            return keys, [values]

        return asked


def _count(least: int | None):
    """Of each entry the sum of its key, doubled, and one more for the one entry of a key that may speak for it; and the number of the key among
    those of the range that sum up to ``least``, from 1 on, the most frequent first. Nothing is numbered if that is None."""

    def add(keys: np.ndarray, values: list) -> list:
        each, first, which = distinct(keys)
        totals = np.bincount(which, weights=values[0], minlength=len(each)).astype(np.int64) if values[0].sum() < 1 << 53 else summed(keys, values[0])[first]
        whole, often = totals[which] * 2, totals >= (np.inf if least is None else least)
        whole[first] += 1
        number = np.zeros(len(each), np.int64)
        number[np.argsort(np.where(often, -totals, 1), kind="stable")[: often.sum()]] = np.arange(often.sum()) + 1
        return [whole, number[which]]

    return add


def _spoken_for(results: list, which: np.ndarray, first: np.ndarray) -> list:
    """What ``_count`` told a bundle, for each of its senders' entries: one of those of a key may speak for it where the bundle's may."""
    whole, number = results
    out = whole[which] & ~1
    out[first] = whole
    return [out, number[which]]


def _by_count(whole: np.ndarray, size: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the numbered entries (``some``) of some parts in which their numbers ascend: by part, then the most frequent first, then by key;
    and where the first of each part stands."""
    part, count = np.repeat(np.arange(len(size)), size)[some], whole[some] >> 1
    width = int(count.max(initial=0)).bit_length()
    if width + len(size).bit_length() < 63:
        order = np.argsort((part << width) + ((1 << width) - 1 - count), kind="stable")
    else:
        order = np.lexsort((-count, part))
    return some[order], np.flatnonzero(np.diff(part, prepend=-1))


def _steps(results: list, size: np.ndarray) -> list:
    """Instead of the numbers of ``_count`` their steps in the order in which they ascend: a byte or two, where a number has three. In a part that
    holds several ranges, told apart in a later stage, steps may go down or stay; 0 is no number, so these are one less."""
    whole, number = results
    order, first = _by_count(whole, size, np.flatnonzero(number))
    ascending = number[order]
    step = np.diff(ascending, prepend=0)
    step[first] = ascending[first]
    out = np.zeros(len(number), np.int64)
    out[order] = step - (step <= 0)
    return [whole, out]


def _numbers(results: list, size: np.ndarray) -> list:
    """The numbers of their steps."""
    whole, step = results
    order, first = _by_count(whole, size, np.flatnonzero(step))
    run = np.cumsum(step[order] + (step[order] < 0))
    before = np.where(first > 0, run[first - 1], 0)
    out = np.zeros(len(step), np.int64)
    out[order] = run - np.repeat(before, np.diff([*first, len(run)]))
    return [whole, out]


_CODE = (_steps, _numbers)


def _told(found: pa.StructArray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both, number = answered(found, 2, _CODE) if found is not None and len(found) else answered(found, 2)
    return both >> 1, both & 1 > 0, number


def _tells(min_gain: float):
    """Whether the sum of a context's gains exceeds ``min_gain``: all that a block needs to know of it."""

    def add(keys: np.ndarray, values: list) -> list:
        return [summed(keys, values[0]) > min_gain * UNIT]

    return add


def suffix_tree_scores(spark: SparkSession, docs: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, smooth: float = SMOOTH, min_gain: float = MIN_GAIN, spare_bits: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_in_context (symbols scored in a retained context).

    Keys of a context and a word are exact while their numbers have 64 bits together, ``spare_bits`` for each included, and hashes beyond that."""
    scratch = Scratch(spark, "suffix_tree")
    blocks = write_blocks(scratch, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), block_bytes=BLOCK_BYTES, convert=numbered, deal=False)
    n_ranges, rows = ranges(blocks, RANGE_BYTES), blocks
    model = Model(depth, min_count, smooth, n_ranges)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in batch.column(1):
                count, credit, number = _told(found.values)
                told = count[credit & (count > 0)]
                yield pa.RecordBatch.from_pydict({"n": pa.array([int(told.sum())], pa.int64()), "v": pa.array([len(told)], pa.int64()), "most": pa.array([int(number.max(initial=0))], pa.int64())})

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]], pa.int64()), "payload": pa.array([counted_once(row["payload"], n_ranges)], pa.binary())})

    for k in range(2 * depth + 1):
        counts = k == 0 or k % 2 == 1
        least = 0 if k == 0 else min_count if k < 2 * depth - 1 else None  # the longest n-grams are no contexts and need no numbers
        plain = _low(model.bits[k // 2], model.bits[0], n_ranges) or 0 if k % 2 else 0
        found = answers(scratch, rows, n_ranges, model.ask(k), 1, f"round{k}", _count(least) if counts else _tells(min_gain), 2 if counts else 1, plain, _spoken_for if counts else None, _CODE if counts else None)
        if counts:
            n, v, most = found.mapInArrow(tidy(totals), "n long, v long, most long").agg(F.sum("n"), F.sum("v"), F.max("most")).first()
            model.bits.append(((int(most or 0) + 1) * n_ranges).bit_length() + spare_bits)
            if k == 0:
                model.total, model.distinct = int(n or 0), int(v or 0)
                rows = scratch.bucketed(blocks.mapInArrow(tidy(shorten), "block long, payload binary"), "numbers", "block", deal=False)
                scratch.drop("blocks")
        rows = rows.join(found, "block", "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                tree = model.grown(row, 2 * depth + 1)
                n = len(tree.ids)
                add = lambda x, doc=tree.doc, n=n: np.bincount(doc, weights=x, minlength=n)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(tree.ids, pa.int64()),
                        "held_out": pa.array(held_out(tree.ids)),
                        "n_tokens": pa.array(np.diff(tree.first), pa.int64()),
                        "n_known": pa.array(add(tree.known).astype(np.int64)),
                        "train_tokens": pa.array(np.full(n, model.total), pa.int64()),
                        "base_score": pa.array(add(np.log10(tree.base))),
                        "score": pa.array(add(np.log10(tree.p))),
                        "n_in_context": pa.array(add(tree.in_context).astype(np.int64)),
                    }
                )

    return scratch.close(rows.mapInArrow(tidy(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_in_context long"))


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), depth=2, min_count=16, smooth=8.0, min_gain=4.0)
