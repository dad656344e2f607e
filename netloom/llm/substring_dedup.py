"""Exact substring deduplication by level-wise doubling.

Words are ``[^\\x20\\x09-\\x0D]+``. The ladder of lengths ends at ``window`` and halves downwards (35: 9, 18, 35). A window of the first
length is a candidate everywhere; one of the next length is a candidate only where the two shorter windows that cover it both repeat in the
corpus; until the last length is reached or no candidate survives. Repeats are counted over the whole corpus, the same text included, by the
rounds of ``blocks``: a key's range adds up and answers, so no text moves and no repeated passage gathers anywhere.

Nulls and empty texts have no words and come back with zeros and the digest of the empty string; repeated rows and ids are rows of their
own (each repeats the other's windows); an empty table gives an empty result; other columns are ignored. Windows are compared by 64-bit
hashes (shorter levels by 48 bits, which only adds candidates).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.blocks import answered, answers, decode, ranges, rows_of, summed, write_blocks
from netloom.llm.memory import tidy
from netloom.llm.scratch import Scratch
from netloom.llm.words import Words, extended, windows

#: No level is shorter than this: windows of fewer words repeat by chance.
SHORTEST = 8


def ladder(window: int) -> list[int]:
    """Lengths, each at most twice the one before, up to ``window``."""
    lengths = [window]
    while (lengths[0] + 1) // 2 >= SHORTEST:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


class _Levels:
    """Hashes and candidates of one block, level by level."""

    def __init__(self, texts, lengths: list[int]):
        self.words, self.lengths = Words(texts), lengths
        self.hash = windows(self.words.hashes(), lengths[0]) if len(self.words) else np.zeros(0, np.uint64)
        self.at = np.flatnonzero(self.words.left >= lengths[0])
        self.level = 0

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of the candidates, their counts here, and which of them each candidate has."""
        h = self.hash[self.at]
        if self.level < len(self.lengths) - 1:
            h = h & ~np.uint64(0xFFFF)
        keys, which, counts = np.unique(h, return_inverse=True, return_counts=True)
        return keys, counts, which

    def repeat(self, flags: np.ndarray, which: np.ndarray) -> np.ndarray:
        """True at the starts of windows of this level that repeat."""
        out = np.zeros(len(self.words), bool)
        out[self.at] = flags[which].astype(bool)
        return out

    def climb(self, repeats: np.ndarray) -> None:
        """To the next level, with the windows that both halves allow."""
        step = self.lengths[self.level + 1] - self.lengths[self.level]
        self.hash = extended(self.hash, step)
        self.level += 1
        further = np.zeros(len(repeats), bool)
        further[: max(len(repeats) - step, 0)] = repeats[step:]
        self.at = np.flatnonzero(repeats & further & (self.words.left >= self.lengths[self.level]))


def _climbed(row: dict, lengths: list[int], upto: int) -> _Levels:
    levels = _Levels(decode(row["payload"]).column("text"), lengths)
    for k in range(upto):
        _, _, which = levels.keys()
        levels.climb(levels.repeat(answered(row[f"level{k}"], 1)[0], which))
    return levels


def _covered(starts: np.ndarray, window: int) -> np.ndarray:
    edges = np.zeros(len(starts) + window + 1, np.int32)
    at = np.flatnonzero(starts)
    edges[at] += 1
    edges[at + window] -= 1
    return np.cumsum(edges)[: len(starts)] > 0


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 35, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept_text``): each text without the words that a window of ``window`` words covers
    whose words also start anywhere else."""
    scratch, lengths = Scratch(spark, "substring"), ladder(window)
    blocks = write_blocks(scratch, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    n_ranges, rows = ranges(blocks), blocks

    def merge(keys: np.ndarray, values: list) -> list:
        return [summed(keys, values[0]) > 1]

    for k in range(len(lengths)):

        def ask(row: dict, k: int = k) -> tuple:
            keys, counts, _ = _climbed(row, lengths, k).keys()
            return keys, [counts]

        found = answers(scratch, rows, n_ranges, ask, 1, f"level{k}", merge, 1)
        rows = rows.join(found, "block", "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                table = decode(row["payload"])
                levels = _climbed(row, lengths, len(lengths) - 1)
                _, _, which = levels.keys()
                starts = levels.repeat(answered(row[f"level{len(lengths) - 1}"], 1)[0], which)
                gone, first = _covered(starts, window), levels.words.first
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                body, a, b = levels.words.body.tobytes(), levels.words.start, levels.words.end
                kept = []
                for i, n in enumerate(removed):
                    if n == 0:
                        o = levels.words.offsets
                        kept.append(b" ".join(body[o[i] : o[i + 1]].split()))
                    else:
                        at = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                        kept.append(b" ".join([body[x:y] for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True)]))
                out = {"doc_id": table.column("doc_id").combine_chunks(), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
                if with_text:
                    out["kept_text"] = pa.array([x.decode() for x in kept], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return scratch.close(rows.mapInArrow(tidy(clean), schema))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), window=35)


ORACLES = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(l[i : i + 34], ' ')) AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) - 33)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM starts WHERE h IN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM hit),
tokens AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS j FROM w),
kept AS (SELECT t.doc_id, count(*) AS n, string_agg(t.word, ' ' ORDER BY t.j) AS text FROM tokens t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.j = g.j WHERE g.j IS NULL GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(len(l) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
}
