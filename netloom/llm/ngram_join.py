"""Near duplicates: the Jaccard join of word n-gram sets with adaptive multi-match prefixes.

A text's set: the distinct ``shingle``-word shingles of its words (A-Z lower-cased); the whole sequence as one where it has fewer words;
empty, and linked with nothing, without words or text. Two texts link when 100 * intersection >= ``percent`` * union.

1. Corpus-wide document frequencies of all shingles (by 48 bits of their hashes) come back to each block of documents (``blocks``). A shingle of one document alone
   links nothing; a document keeps its other shingles, rarest first.
2. Each document chooses the length of its prefix: a prefix lengthened by l - 1 shingles need only be probed for partners that share l of
   them. The choice is the l of least estimated cost, postings read plus candidates to verify, from the frequencies. Of two documents
   with l and m, a pair within the threshold shares min(l, m) prefix shingles at least, as the order is the same for all.
3. Documents with equal sets are one class from here on; only a representative goes on.
4. Stars first: for each prefix shingle the representatives are verified against one of them, the one whose shingles are the most common in
   the mean (in a group of edited copies, the one nearest the original), so a group of g copies costs g pairs. Connected ones are joined.
5. All pairs that are left, in different components, are then joined by prefix shingles, the smaller's prefix cut to what partners of its size
   need. Those that share enough of them, and have enough left after the last for the threshold, are verified. Nothing is capped: pairs
   inside a component can't change it, and all others are tested.

Rows come back as they went in: nulls in any column, repeated rows and repeated ids are rows of their own, a null doc_id counts as no id when
the smallest of a component is taken, an empty table gives an empty result, other columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.blocks import ROWS, answered, answers, decode, ranges, rows_of, summed, write_blocks
from netloom.llm.components import components
from netloom.llm.memory import tidy
from netloom.llm.scratch import Scratch
from netloom.llm.words import Words, mix, windows

#: The longest multi-match considered, and what verifying a candidate costs against reading a posting.
MOST_MATCHES, VERIFY_COST = 8, 0.25
#: Smaller than elsewhere: a block's sets, frequencies and prefixes are in memory together.
BLOCK_BYTES, RANGE_BYTES = 2 << 20, 4 << 20
TABLE = "rid long, doc_id long, n long, sig_a long, sig_b long, central float, matches int, indexed int, prefix array<long>, shared array<long>"


class _Sets:
    """The shingle sets of a block: ``h`` sorted by hash with ``doc`` its text, each pair once; ``n`` the sizes."""

    def __init__(self, texts, shingle: int):
        words = Words(texts, lower=True)
        h, counts = words.hashes(), words.counts
        long = np.flatnonzero(words.left >= shingle)
        short = np.flatnonzero((counts > 0) & (counts < shingle))
        whole = np.array([_whole(h[words.first[i] : words.first[i + 1]]) for i in short], np.uint64)
        h = np.concatenate([windows(h, shingle)[long], whole]) if len(h) else np.zeros(0, np.uint64)
        doc = np.concatenate([words.doc[long], short]).astype(np.int64)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.h, self.doc = h[once], doc[once]
        self.n = np.bincount(self.doc, minlength=len(counts))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begins = np.ones(len(self.h), bool)
        key = self.h >> np.uint64(16) << np.uint64(16)
        begins[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(begins)
        return key[at], np.diff([*at, len(self.h)]), np.cumsum(begins) - 1


def _whole(h: np.ndarray) -> np.uint64:
    out = np.array([len(h)], np.uint64)
    for x in h:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x)
    return out[0]


def chosen(n: int, alone: int, df: np.ndarray, percent: int) -> tuple[int, int, int]:
    """For a set of n shingles, ``alone`` of them in no other document and the rest with sorted frequencies ``df``: how many matches to
    ask for, how many of the rest are in the prefix for that, and how many for partners that are not smaller."""
    least = -(-percent * n // 100)
    of_equals = -(-2 * percent * n // (100 + percent))
    ells = np.arange(1, max(1, min(MOST_MATCHES, least)) + 1)
    sizes = np.clip(n - least + ells - alone, 0, len(df))
    reads = np.concatenate([[0], np.cumsum(df - 1.0)])[sizes]
    best = int(np.argmin(reads + VERIFY_COST * reads / ells))
    return int(ells[best]), int(sizes[best]), int(np.clip(n - of_equals + ells[best] - alone, 0, len(df)))


def document_sets(scratch: Scratch, blocks: DataFrame, shingle: int, percent: int) -> DataFrame:
    """A row per document; ``prefix`` and ``shared`` are null where no partner can be found."""

    def ask(row: dict) -> tuple:
        keys, counts, _ = _Sets(decode(row["payload"]).column("text"), shingle).keys()
        return keys, [counts]

    def merge(keys: np.ndarray, values: list) -> list:
        return [summed(keys, values[0])]

    df = answers(scratch, blocks, ranges(blocks, RANGE_BYTES), ask, 1, "df", merge, 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                table = decode(row["payload"])
                sets = _Sets(table.column("text"), shingle)
                _, _, which = sets.keys()
                freq = answered(row["df"], 1)[0][which] if len(which) else np.zeros(0, np.int64)
                order = np.lexsort((sets.h, freq, sets.doc))
                h, freq = sets.h[order], freq[order]
                first = np.concatenate([[0], np.cumsum(sets.n)])
                a = np.concatenate([[np.uint64(0)], np.cumsum(mix(h), dtype=np.uint64)])[first]
                b = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])[first]
                tokens = h.view(np.int64)
                central = np.concatenate([[0.0], np.cumsum(np.log2(freq.astype(float)))])[first]
                alone = np.concatenate([[0], np.cumsum(freq < 2)])[first]
                matches, indexed, prefix, shared = [], [], [], []
                for i, n in enumerate(sets.n.tolist()):
                    own = int(alone[i + 1] - alone[i])
                    x, y = int(first[i]) + own, int(first[i + 1])
                    ell, size, index = chosen(n, own, freq[x:y], percent) if n else (0, 0, 0)
                    matches.append(ell)
                    indexed.append(index)
                    prefix.append(tokens[x : x + size] if size else None)
                    shared.append(tokens[x:y] if size else None)
                rid = row["block"] * ROWS + np.arange(len(sets.n))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid, pa.int64()),
                        table.column("doc_id").cast(pa.int64()).combine_chunks(),
                        pa.array(sets.n, pa.int64()),
                        pa.array(np.diff(a).view(np.int64)),
                        pa.array(np.diff(b).view(np.int64)),
                        pa.array((np.diff(central) / np.maximum(sets.n, 1)).astype(np.float32)),
                        pa.array(matches, pa.int32()),
                        pa.array(indexed, pa.int32()),
                        pa.array(prefix, pa.list_(pa.int64())),
                        pa.array(shared, pa.list_(pa.int64())),
                    ],
                    names=[c.split()[0] for c in TABLE.split(", ")],
                )

    return scratch.keep(blocks.join(df, "block", "left").mapInArrow(tidy(rows), TABLE), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that link; ``sets``: rid, n, shared."""
    left = sets.select(F.col("rid").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("s_a"))
    right = sets.select(F.col("rid").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return (
        pairs.join(left, "a").join(right, "b").withColumn("both", both).where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")
    )


def grouped(scratch: Scratch, blocks: DataFrame, shingle: int, percent: int) -> DataFrame:
    """rid, doc_id, n, comp (of documents that have words; a number of the group) of all documents of the blocks."""
    sets = document_sets(scratch, blocks, shingle, percent)

    # equal sets: the signature tells them apart from others
    key = ["n", "sig_a", "sig_b"]
    classes = scratch.keep(sets.where("n > 0").groupBy(*key).agg(F.min("rid").alias("rep")), "classes")
    reps = scratch.keep(sets.where("prefix is not null").join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", "n", "central", "matches", "indexed", "prefix", "shared"), "reps")
    full = reps.select("rid", "n", "shared")
    postings = scratch.keep(reps.select("rid", "n", F.size("shared").alias("held"), "central", "matches", "indexed", F.posexplode("prefix").alias("pos", "token")), "postings")

    # stars
    # sizes n of which ``most`` at most are common can link
    near = lambda n_a, n_b, most: (F.lit(100 + percent) * most >= F.lit(percent) * (n_a + n_b))
    hubs = postings.groupBy("token").agg(F.max(F.struct("central", "rid", F.col("n").alias("hub_n"), F.col("held").alias("hub_held"))).alias("h"), F.count(F.lit(1)).alias("size")).where("size > 1").select("token", F.col("h.rid").alias("hub"), "h.hub_n", "h.hub_held")
    hubs = scratch.keep(hubs, "hubs")  # here and below: a join of two written tables, in which Spark can split a key that many rows share
    stars = (
        postings.join(hubs, "token")
        .where((F.col("hub") != F.col("rid")) & near(F.col("n"), F.col("hub_n"), F.least("held", "hub_held")))
        .select(F.least("hub", "rid").alias("a"), F.greatest("hub", "rid").alias("b"))
        .distinct()
    )
    tried = scratch.keep(stars, "stars")
    edges = scratch.keep(verified(tried, full, percent), "star_edges")
    joined = components(scratch, edges, "first")

    # what stars leave: pairs across components that share enough of their prefixes
    placed = postings.join(joined.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    placed = scratch.keep(placed, "placed")
    open_tokens = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
    still = placed.join(open_tokens, "token", "left_semi")
    # the smaller of a pair shares within the shorter prefix that suffices for partners of its size or more
    columns = ("rid", "n", "held", "pos", "matches", "comp")
    one = still.where("pos < indexed").select("token", *(F.col(c).alias(f"{c}_a") for c in columns))
    two = still.select("token", *(F.col(c).alias(f"{c}_b") for c in columns))
    # after the last match of the prefixes no more can be common than either has left
    left = F.least(F.col("held_a") - F.col("pos_a"), F.col("held_b") - F.col("pos_b")) - 1
    # of sets of these sizes, each match lies in the prefixes that this pair needs
    within = [F.col(f"held_{x}") - F.col(f"pos_{x}") + F.col(f"matches_{x}") - 1 for x in "ab"] + [F.col("held_a"), F.col("held_b")]
    smaller = F.struct("n_a", "rid_a") < F.struct(F.col("n_b").alias("n_a"), F.col("rid_b").alias("rid_a"))
    rest = (
        one.join(two, "token")
        .where(smaller & (F.col("comp_a") != F.col("comp_b")) & near(F.col("n_a"), F.col("n_b"), F.least(*within)))
        .groupBy(F.col("rid_a").alias("x"), F.col("rid_b").alias("y"), "n_a", "n_b")
        .agg(F.count(F.lit(1)).alias("common"), F.min(F.least("matches_a", "matches_b")).alias("least"), F.min(left).alias("left"))
        .where((F.col("common") >= F.col("least")) & near(F.col("n_a"), F.col("n_b"), F.col("common") + F.col("left")))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .join(tried, ["a", "b"], "left_anti")
    )
    more = scratch.keep(verified(rest, full, percent), "more_edges")
    last = components(scratch, edges.union(more), "last")

    # back to all documents
    named = classes.join(last.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("comp", "rep").alias("comp"))
    named = scratch.keep(named, "class_names")
    return scratch.keep(sets.select("rid", "doc_id", *key).join(named, key, "left").select("rid", "doc_id", "n", "comp"), "named")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links lead to."""
    scratch = Scratch(spark, "ngram_join")
    blocks = write_blocks(scratch, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), block_bytes=BLOCK_BYTES)
    rows = grouped(scratch, blocks, shingle, percent)
    lowest = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("lowest"))
    lowest = scratch.keep(lowest, "lowest")
    result = rows.join(lowest, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id"))
    return scratch.close(result)


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, whole, but of each group of near duplicates only that of the smallest doc_id (null last; of equal ids the
    first written). Documents without words have no duplicates. The blocks that were compared are read again for the answer."""
    scratch = Scratch(spark, "keep_one")
    blocks = write_blocks(scratch, docs, block_bytes=BLOCK_BYTES)
    rows = grouped(scratch, blocks, shingle, percent)
    best = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")).select("best.rid")
    kept = best.union(rows.where("comp is null").select("rid"))
    kept = kept.select(F.floor(F.col("rid") / ROWS).alias("block"), F.pmod("rid", F.lit(ROWS)).cast("int").alias("at")).groupBy("block").agg(F.sort_array(F.collect_list("at")).alias("kept"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                yield from decode(row["payload"]).take(pa.array(row["kept"], pa.int64())).to_batches()

    return scratch.close(blocks.join(kept, "block").mapInArrow(tidy(answer), docs.schema))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=5, percent=75)


ORACLES = {
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(l[i : i + 4], ' ')) AS h FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, 2))) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT w.doc_id, count(s.h) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n p1 ON p1.doc_id = a JOIN n p2 ON p2.doc_id = b WHERE 100 * k >= 75 * (p1.n + p2.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
}
