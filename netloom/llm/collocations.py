"""Phrases that occur together more often than their parts would by chance, for each language, by weighted acyclic automata.

Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces and these at spaces and tabs into words. Within a language (null: ``und``), n
counts words and f(phrase) the contiguous occurrences of a phrase within pieces, overlaps included. Candidates are phrases of 2 to 5 words with
a = f >= ``least``. Cut after its first k words a candidate scores floor(1000 * a * n / (f(first part) * f(rest))); its lowest score counts, of
equal ones that of the smallest k. A candidate goes if it lies inside a longer one with 100 * f(longer) >= ``inside`` * a; of the others each
language's first ``most`` stay, by score, a and phrase.

1. The documents are written once as blocks of word numbers, each with its own words and their counts; the counts are summed by language and word, and
   words with ``least`` occurrences are numbered, the most frequent first. A rarer word ends a phrase like a mark, as no candidate holds it.
2. Each block's windows of up to five words are sorted and built into automata whose ways weigh how often the block has them (``automata``), one for
   each range of sequences. The ranges end at quantiles of a sample of windows, so a frequent word or pair is spread over as many ranges as it
   fills, and a window that a third of all texts hold is one way in a block's automaton, whatever its weight.
3. A range's automata are united: weights are summed depth by depth and light ways left at once. Ways that cross the end of a range come out of
   both ranges and are summed once more.
4. Parts are looked up by composing the candidates with the counts: joins of their first and last parts with the ways that spell them.
   Extensions of a phrase by one word tell whether it lies in a longer one: if any longer phrase has the share of its occurrences that is
   asked, so has the one between them that is one word longer.

Products are of decimals of 38 digits, so scores are exact. The blocks of a long text overlap by four words and are read in pieces. Null and empty texts have no words, repeated rows
are texts of their own, null languages and the language ``und`` are one, other columns are ignored, an empty table gives an empty result. Within a
block a word is known by 64 bits of a hash of it and its language; equal states of an automaton by 64 bits of a hash of their arcs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.automata import LENGTH, build, columns_of, cuts, decode, encode, keys_of, sort_order, union
from netloom.llm.blocks import pack, unpack
from netloom.llm.memory import release, tidy, tidy_group
from netloom.llm.ranking import first_rows
from netloom.llm.runs import Runs, byte_set, pieces
from netloom.llm.scratch import Scratch
from netloom.llm.words import mix
from netloom.operators.index import dense_index
from netloom.plans.joins import small

LEAST, MOST, INSIDE = 100, 2000, 100
#: Words in a block, bytes of a piece; one window of so many is sampled for the ends of ranges; windows of a range in the mean.
BLOCK_WORDS, AT_ONCE, EVERY, RANGE_WINDOWS = 700_000, 1 << 20, 1 << 12, 1 << 20
_BREAK = byte_set(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))
_WORD = ~(_BREAK | byte_set((0x20, 0x20), (0x09, 0x09)))
_BLOCK = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("starts", pa.int64()), ("tokens", pa.binary()), ("words", pa.list_(pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])))])
PARTS = "fan binary, label binary, weight binary, target binary"


class _Words:
    """Words gathered for a block: ``keys`` tell word and language, ``ends`` whether no phrase goes on from the word before."""

    def __init__(self):
        self.keys, self.ends, self.known, self.size = [], [], {}, 0

    def add(self, keys: np.ndarray, ends: np.ndarray, word) -> None:
        """``word(i)``: language and text of the piece's word i."""
        each, at = np.unique(keys, return_index=True)
        for k, i in zip(each.tolist(), at.tolist(), strict=True):
            if k not in self.known:
                self.known[k] = word(i)
        self.keys.append(keys)
        self.ends.append(ends)
        self.size += len(keys)

    def row(self, block: int, rest: int) -> tuple[pa.RecordBatch, _Words]:
        """The block, and the next one, which begins with the last ``rest`` words: here they only end windows."""
        keys, ends = np.concatenate(self.keys), np.concatenate(self.ends)
        each, which = np.unique(keys, return_inverse=True)
        n = np.bincount(which, minlength=len(each))
        order = np.argsort(-n, kind="stable")
        number = np.empty(len(each), np.int64)
        number[order] = np.arange(len(each))
        starts = len(keys) - rest
        counted = np.bincount(which[:starts], minlength=len(each))[order]
        lang, word = zip(*(self.known[k] for k in each[order].tolist()), strict=True)
        words = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(counted)], ["lang", "word", "n"])
        tokens = pack(number[which] << 1 | ends)
        out = pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(keys)]), pa.array([starts]), pa.array([tokens], pa.binary()), pa.ListArray.from_arrays([0, len(words)], words)], schema=_BLOCK)
        after = _Words()
        if rest:
            after.keys, after.ends, after.size = [keys[starts:]], [ends[starts:]], rest
            after.known = {k: self.known[k] for k in keys[starts:].tolist()}
        return out, after


def blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows block, size, starts, tokens (of each word twice its number in the block, and 1 if a phrase can't go on to it), words by number."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held = TaskContext.get().partitionId(), 0, _Words()
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            salt = np.array([hash_of(x) for x in names], np.uint64)
            ended = True  # whether a mark or a text's end stands before the next word
            for piece in pieces(batch.column(1), AT_ONCE, _WORD, lower=True):
                runs = Runs(piece, _WORD)
                marks = np.concatenate([[0], np.cumsum(_BREAK[piece.body])])
                ended = ended if piece.begun else True
                if len(runs):
                    at = marks[runs.start]
                    ends = np.ones(len(runs), bool)
                    ends[1:] = (at[1:] != at[:-1]) | (runs.doc[1:] != runs.doc[:-1])
                    ends[0] = ended or bool(at[0])
                    lang = of[piece.first + runs.doc]
                    held.add(mix(runs.hashes() ^ salt[lang]), ends, lambda i, lang=lang, runs=runs: (names[lang[i]], runs.text(i)))
                    ended = bool(marks[-1] != at[-1])
                else:
                    ended = ended or bool(marks[-1])
                if held.size >= block_words:
                    out, held = held.row((part << 20) + k, 0 if piece.ended else LENGTH - 1)
                    k += 1
                    yield out
                    release()
        if held.size:
            yield held.row((part << 20) + k, 0)[0]

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(fold), "block long, size long, starts long, tokens binary, words array<struct<lang:string,word:string,n:long>>")


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode())


def windows(row: dict) -> list[np.ndarray]:
    """The block's windows of two words or more: columns of the words' numbers (from 1), padded with 0."""
    tokens = unpack(row["tokens"], row["size"]).astype(np.int64)
    table = np.zeros(int(tokens.max(initial=0) // 2) + 1, np.int32)
    table[row["local"]] = row["id"]
    own = table[tokens >> 1]
    n = len(own)
    stop = np.where((tokens & 1 > 0) | (own == 0), np.arange(n), n)
    after = np.append(np.minimum.accumulate(stop[::-1])[::-1], n)[1:]
    left = np.where(own > 0, after - np.arange(n), 0)
    at = np.flatnonzero(left[: row["starts"]] >= 2)
    own, left = np.concatenate([own, np.zeros(LENGTH, np.int32)]), left[at].astype(np.int32)
    return [np.where(left > k, own[at + k], np.int32(0)) for k in range(LENGTH)]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(batch)):
        ids = batch.column("ids")[i].values
        yield {c: batch.column(c)[i].as_py() for c in ("size", "starts", "tokens")} | {c: ids.field(c).to_numpy() for c in ("local", "id")}


def sampled(rows: DataFrame) -> DataFrame:
    """c0 .. c4: distinct ones of every EVERY-th window."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                columns = windows(row)
                first = min(EVERY // 2, len(columns[0]) // 2)
                yield pa.RecordBatch.from_pydict({f"c{k}": pa.array(c[first::EVERY], pa.int32()) for k, c in enumerate(columns)})

    return rows.mapInArrow(tidy(take), ", ".join(f"c{k} int" for k in range(LENGTH))).distinct()


def bounds_of(samples: DataFrame, partitions: int) -> list[list[int]]:
    """The first windows of all ranges but the first: at most one for each partition, or for RANGE_WINDOWS windows where that is more."""
    order = [f"c{k}" for k in range(LENGTH)]
    ranked = dense_index(samples, order, "place")
    n = ranked.count()
    ranges = max(1, min(n, max(partitions, n * EVERY // RANGE_WINDOWS)))
    step = -(-n // ranges) if n else 1
    return [[r[c] for c in order] for r in ranked.where((F.col("place") % step == 0) & (F.col("place") > 0)).orderBy("place").collect()]


def automata_of(rows: DataFrame, shared) -> DataFrame:
    """range, sizes and the parts of the automaton of each block and range."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = keys_of(list(np.array(shared.value, np.int64).reshape(-1, LENGTH).T))
        for batch in batches:
            for row in _rows(batch):
                keys = keys_of(windows(row))
                order = sort_order(keys)
                keys = [k[order] for k in keys]
                edges = np.concatenate([[0], cuts(keys, bounds), [len(order)]])
                columns = columns_of(keys)
                del keys, order
                out: dict[str, list] = {c: [] for c in ("range", "sizes", "fan", "label", "weight", "target")}
                for j in np.flatnonzero(np.diff(edges)).tolist():
                    sizes, parts = encode(build([c[edges[j] : edges[j + 1]] for c in columns]))
                    for c, x in zip(out, (j, sizes, *parts), strict=True):
                        out[c].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), (pa.int32(), pa.list_(pa.int32()), *[pa.binary()] * 4), strict=True)], names=list(out))
                release()

    return rows.mapInArrow(tidy(send), f"range int, sizes array<int>, {PARTS}")


def united(sent: DataFrame, shared, least: int) -> DataFrame:
    """phrase (word numbers), a: all phrases of two words or more that occur ``least`` times or more."""

    def unite(table: pa.Table) -> pa.Table:
        k, bounds = table.column("range")[0].as_py(), shared.value
        automata = [decode(table.column("sizes")[i].as_py(), [table.column(c)[i].as_py() for c in ("fan", "label", "weight", "target")]) for i in range(len(table))]
        found = union(automata, least, bounds[k - 1] if k else None, bounds[k] if k < len(bounds) else None)[1:]
        ways = [pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.array(w.reshape(-1), pa.int32())) for w, _ in found]
        return pa.table({"phrase": pa.chunked_array(ways, pa.list_(pa.int32())), "a": pa.chunked_array([pa.array(a, pa.int64()) for _, a in found], pa.int64())})

    ways = sent.groupBy("range").applyInArrow(tidy_group(unite), "phrase array<int>, a long")
    return ways.groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def phrase_counts(scratch: Scratch, docs: DataFrame, least: int, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """words (id, lang, word, a, n) that occur ``least`` times, and phrases (phrase, a) of them that do."""
    spark = docs.sparkSession
    held = scratch.bucketed(blocks(docs, block_words), "blocks", "block", deal=False)
    local = held.select("block", F.posexplode("words").alias("local", "w")).select("block", "local", "w.lang", "w.word", "w.n")
    counts = scratch.keep(local.groupBy("lang", "word").agg(F.sum("n").alias("a")), "counts")
    totals = counts.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = dense_index(counts.where(F.col("a") >= least), [F.desc("a"), "lang", "word"], "id").withColumn("id", (F.col("id") + 1).cast("int"))
    words = scratch.keep(frequent.join(totals, "lang").select("id", "lang", "word", "a", "n"), "words")
    named = local.join(small(words.select("lang", "word", "id")), ["lang", "word"], "left")
    ids = named.groupBy("block").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("local", "id"))).alias("ids"))
    rows = held.select("block", "size", "starts", "tokens").join(scratch.bucketed(ids, "ids", "block"), "block")
    shared = spark.sparkContext.broadcast(bounds_of(sampled(rows), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return words, scratch.keep(united(automata_of(rows, shared), shared, least), "phrases")


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, most: int = MOST, inside: int = INSIDE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    scratch = Scratch(spark, "collocations")
    words, phrases = phrase_counts(scratch, docs, least, block_words)
    length = F.size("phrase")
    shorter = F.explode(F.array(F.slice("phrase", F.lit(1), length - 1), F.slice("phrase", F.lit(2), length - 1))).alias("phrase")
    longer = phrases.where(length > 2).select(shorter, "a").groupBy("phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, "phrase", "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(inside) * F.col("a"))).drop("longer")
    counts = phrases.union(words.select(F.array("id"), "a"))
    parts = kept.select("phrase", "a", F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    parts = parts.select("*", F.slice("phrase", F.lit(1), F.col("k")).alias("head"), F.slice("phrase", F.col("k") + 1, length - F.col("k")).alias("tail"))
    looked = parts.join(counts.select(F.col("phrase").alias("head"), F.col("a").alias("l")), "head").join(counts.select(F.col("phrase").alias("tail"), F.col("a").alias("r")), "tail")
    looked = looked.withColumn("first", F.element_at("phrase", 1)).join(words.select(F.col("id").alias("first"), "lang", "n"), "first")
    score = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    lowest = looked.withColumn("score", score).groupBy("phrase", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    scored = lowest.select("phrase", "lang", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a")]
    first = scratch.keep(first_rows(scored, ["lang"], order, most, ties=True).drop("rank"), "first")
    spelt = first.select("phrase", F.posexplode("phrase").alias("at", "id")).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x.word), " ").alias("text"))
    named = first.join(spelt, "phrase").select("lang", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
    ranked = first_rows(named, ["lang"], [*order, F.asc("phrase")], most)
    return scratch.close(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES = {
    "op13_collocations": rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
f AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)) GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND a >= 100),
o AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.lang = c.lang AND b.k > c.k AND 100 * b.a >= 100 * c.a AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
t AS (SELECT o.lang, o.phrase, o.a, x.k AS cut, array_to_string(string_split(o.phrase, ' ')[:x.k], ' ') AS head, array_to_string(string_split(o.phrase, ' ')[x.k + 1:], ' ') AS tail FROM o, (SELECT unnest([1, 2, 3, 4]) AS k) x WHERE x.k < o.k),
g AS (SELECT t.lang, t.phrase, t.a, l.a AS l, r.a AS r, n.n, CAST((1000 * CAST(t.a AS HUGEINT) * n.n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score, cut FROM t JOIN f l ON l.lang = t.lang AND l.phrase = t.head JOIN f r ON r.lang = t.lang AND r.phrase = t.tail JOIN n ON n.lang = t.lang),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) WHERE rank <= 2000"""
}
