"""Packing of tokenised documents into fixed windows by the sum-of-squares rule.

Documents are dealt by a hash to shards of about ``SHARD_BYTES`` of text, whose number follows the corpus and its rows; a group of equal rows is
spread over shards by the partitions it is read from. In a shard a document longer than a
window fills whole windows first; what remains of it is placed online: into the fill level that leaves the least sum of squares of the numbers
of partially filled windows by level, which are kept in an array of levels. At the end of a shard its partial windows are closed by cutting the
pieces of the emptiest into the gaps of the fullest, so that one partial window per shard is padded at most.

Tokens are encoded where the text is read, each distinct word of a worker once: the tokenizer splits at white space, so a text's ids are its words'
(``WordIds`` raises for a tokenizer that doesn't).
Null and empty texts have the end id alone. Repeated rows and ids are documents of their own, an empty table gives an empty result, other
columns are ignored; equal documents are placed in the order of their ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.blocks import slices
from netloom.llm.memory import remembered, tidy, tidy_group
from netloom.llm.token_counts import load_tokenizer, tokenizer_path
from netloom.llm.words import Words

WINDOW, END, SHARD_BYTES = 2048, 1, 16 << 20
#: What a row counts besides its text when shards are sized: a table of empty texts has shards as well.
ROW_BYTES = 64
#: Words a worker remembers the ids of; beyond that it forgets all and begins anew.
REMEMBERED = 1_500_000
#: Words handed to the tokenizer at once.
AT_ONCE = 4000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """The ids of words by their hash, encoded when first met."""

    def __init__(self, path: str):
        self.model = load_tokenizer(path)
        encode = lambda text: self.model.encode(text, add_special_tokens=False).ids
        if encode("one  two\n\tthree four ") != [i for word in ("one", "two", "three", "four") for i in encode(word)]:
            raise ValueError(f"{path}: ids of a text are not those of its words, so they can't be packed word by word")
        self.forget()

    @classmethod
    def of(cls, path: str) -> WordIds:
        return remembered(("ids of words", path), lambda: cls(path))

    def forget(self) -> None:
        self.hash, self.first, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def places(self, h: np.ndarray, words: Words, index: np.ndarray) -> np.ndarray:
        """Where each of the sorted distinct hashes stands; ``index`` is a word of each."""
        if len(self.hash) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.hash, h)
        unknown = np.ones(len(h), bool)
        within = at < len(self.hash)
        unknown[within] = self.hash[at[within]] != h[within]
        if unknown.any():
            body, which = words.body.tobytes(), index[unknown]
            texts = [body[a:b].decode() for a, b in zip(words.start[which].tolist(), words.end[which].tolist(), strict=True)]
            lists = [x.ids for part in range(0, len(texts), AT_ONCE) for x in self.model.encode_batch(texts[part : part + AT_ONCE], add_special_tokens=False)]
            size = np.array([len(x) for x in lists], np.int32)
            first = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.array([i for x in lists for i in x], np.uint32)])
            where = at[unknown]
            self.hash = np.insert(self.hash, where, h[unknown])
            self.first, self.size = np.insert(self.first, where, first), np.insert(self.size, where, size)
            at = np.searchsorted(self.hash, h)
        return at

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin."""
        words = Words(texts)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(words.counts) + 1, np.int64)
        h, index, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = self.places(h, words, index)[which]
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        spread = np.repeat(self.first[at] - ends[:-1], size) + np.arange(ends[-1])
        return self.ids[spread], ends[words.first]


def tokenised(docs: DataFrame, path: str, shards: int) -> DataFrame:
    """shard, doc_id, width, ids: unsigned integers of ``width`` bytes, without the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WordIds.of(path)
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                ids, first = model.encode(piece.column("text"))
                ids = ids.astype(np.uint16 if model.model.get_vocab_size() <= 1 << 16 else np.uint32)
                rows = [ids[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"shard": piece.column("shard"), "doc_id": piece.column("doc_id"), "width": pa.array(np.full(len(rows), ids.itemsize), pa.int32()), "ids": pa.array(rows, pa.binary())})

    # rows that are equal in all are told apart by where they are read
    shard = F.pmod(F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.spark_partition_id()), F.lit(shards)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("shard", shard)
    return rows.mapInArrow(tidy(encode, remembers=True), "shard int, doc_id long, width int, ids binary")


class Windows:
    """Partially filled windows by fill level, for the sum-of-squares rule."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # of open windows at each level
        self.open: dict[int, list[int]] = {}
        self.held: list[list[tuple[int, int, int]]] = []  # pieces (document, start, length) of each window

    def full(self, piece: tuple[int, int, int]) -> None:
        self.held.append([piece])

    def place(self, doc: int, start: int, length: int) -> None:
        n, size = self.count, self.size
        after = n[length : size + 1].copy()  # level h goes to h + length
        after[-1] = 0  # a full window is not counted
        cost = 2 * after + 1
        cost[-1] = 0
        cost -= 2 * n[: size - length + 1] - 1
        cost[n[: size - length + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * n[length] + 1  # a new window
        level = len(cost) - 1 - int(np.argmin(cost[::-1]))  # the fullest of the best
        if level:
            window = self.open[level].pop()
            n[level] -= 1
        else:
            window = len(self.held)
            self.held.append([])
        self.held[window].append((doc, start, length))
        if level + length < size:
            n[level + length] += 1
            self.open.setdefault(level + length, []).append(window)

    def close(self) -> None:
        """Fills the partial windows up, fullest first, with pieces of the emptiest; one stays partial at most."""
        part = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        fill = {w: sum(p[2] for p in self.held[w]) for w in part}
        a, b = 0, len(part) - 1
        while a < b:
            gap = self.size - fill[part[a]]
            if not gap:
                a += 1
                continue
            if not self.held[part[b]]:
                b -= 1
                continue
            doc, start, length = self.held[part[b]].pop()
            took = min(gap, length)
            self.held[part[a]].append((doc, start, took))
            fill[part[a]] += took
            fill[part[b]] -= took
            if took < length:
                self.held[part[b]].append((doc, start + took, length - took))
        self.held = [w for w in self.held if w]


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """A row per piece (PIECES). Sequences are numbered by shard and, without gaps, in the shard."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    shards = max(1, int(total) // SHARD_BYTES)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        shard = table.column("shard")[0].as_py()
        width, rows = table.column("width")[0].as_py(), table.column("ids")
        doc_ids, sizes = table.column("doc_id"), np.array([len(x.as_buffer()) // width + 1 for x in rows], np.int64)
        windows = Windows(window)
        for i, n in enumerate(sizes.tolist()):
            whole = n - n % window
            for start in range(0, whole, window):
                windows.full((i, start, window))
            if n > whole:
                windows.place(i, whole, n - whole)
        windows.close()
        out = []
        for k, held in enumerate(windows.held):
            offset = 0
            for doc, start, length in held:
                out.append((doc, start, length, (shard << 32) + k, offset))
                offset += length
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*out, strict=True))
        crc, order = np.zeros(len(doc), np.int64), np.argsort(doc, kind="stable")
        held, ids = -1, None
        for j in order.tolist():
            if doc[j] != held:
                held = int(doc[j])
                ids = np.append(np.frombuffer(rows[held].as_buffer(), np.uint16 if width == 2 else np.uint32), end).astype("<u4")
            crc[j] = zlib.crc32(ids[start[j] : start[j] + length[j]].tobytes())
        names = [c.split()[0] for c in PIECES.split(", ")]
        columns = [doc_ids.take(pa.array(doc)), start, length, crc, sizes[doc], sequence, offset]
        return pa.table(dict(zip(names, [c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], strict=True)))

    return tokenised(docs, path, shards).groupBy("shard").applyInArrow(tidy_group(pack), PIECES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"), window=2048, end=1)
