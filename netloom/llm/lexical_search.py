"""Ranked lexical search: the documents of highest impact for each query text, by the Best Position Algorithm over impact lists.

Terms are the longest runs of ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased. With N the documents that hold a term, L
all occurrences of terms, n those of a document, df the documents that hold a term and tf its occurrences in one, a term weighs
w = floor(1000 * ln((2N + 2) / (2df + 1))), a document's m is 10 + (90nN div L), and its impact for the term is
w * ((1000000000 * tf) div (1000 * tf + 8m)); its score for a query is the sum over the query's distinct terms.

1. ``indexed`` reads the documents once. Each task writes blocks of them: the postings (document, tf) of the terms that any query has, by term, and
   the sizes from which N, L and df are summed over all documents.
2. ``Impacts`` orders a block's lists by impact and finds where a document stands in each (direct access). ``best`` reads the lists of a query
   from their tops in step; each document met is scored at once by direct access, and its places in the other lists count as seen. A list's best
   position is the last up to which all are seen; no document yet unseen scores above the sum of the impacts there. Reading stops when this sum is
   strictly below the k-th score, so that documents that tie with it are never left out. The k best of a query are carried from block to block of a
   task, so later blocks stop sooner, most before their first document.
3. The k best of each task are ranked, through salts of each query.

Documents stay where they are; the postings are written once and read once, and a task sends at most k rows for each query. Queries go to all tasks
in parts of ``MOST_BYTES`` of text at most (a longer query text is a part of its own), each of which is a pass over the documents.

Null texts hold no term, a null query text and one without terms find nothing. Repeated rows are documents of their own; of equal scores the smaller
doc_id comes first, a null id last. Repeated queries (id and text) count once, a repeated item_id with another text is a query of its own with
ranks of its own. An empty table of either gives an empty result, other columns are ignored. A term is known by 64 bits of its hash and its length.
Long texts are read in pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.memory import tidy
from netloom.llm.ranking import first_rows
from netloom.llm.runs import Runs, byte_set, pieces
from netloom.llm.scratch import Scratch

TERM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Results for each query; bytes of text of queries that go to the tasks together.
MOST, MOST_BYTES = 10, 4 << 20
#: Bytes of text in a block of documents and in a piece; places for direct access (terms times documents) in a block.
BLOCK_BYTES, AT_ONCE, CELLS = 8 << 20, 1 << 20, 1 << 24
#: Documents read from each list at first; then twice as many each time.
STEP = 16
INDEX = "doc_id array<long>, n array<long>, term array<int>, size array<int>, doc array<int>, tf array<int>, held long, total long"
_INDEX = pa.schema([(c.split()[0], pa.list_({"long": pa.int64(), "int": pa.int32()}[c[c.index("<") + 1 : -1]]) if "<" in c else pa.int64()) for c in INDEX.split(", ")])


def terms_of(texts) -> list[list[tuple[int, int]]]:
    """The distinct terms of each text: hash and length."""
    found: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    for piece in pieces(texts, AT_ONCE, TERM, lower=True):
        runs = Runs(piece, TERM)
        for d, h, size in zip(runs.doc.tolist(), runs.hashes().tolist(), (runs.end - runs.start).tolist(), strict=True):
            found[piece.first + d].append((h, size))
    return [sorted(set(x)) for x in found]


class Vocabulary:
    """The queries of a part, and the terms that they have, numbered in the order of their hashes."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        found = terms_of(pa.array(texts, pa.string()))
        every = sorted({x for t in found for x in t})
        self.hashes, self.sizes = np.array([h for h, _ in every], np.uint64), np.array([s for _, s in every], np.int64)
        number = {x: i for i, x in enumerate(every)}
        self.queries = [np.array([number[x] for x in t], np.int64) for t in found]

    def __len__(self) -> int:
        return len(self.hashes)

    def number(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each term, -1 where no query has it."""
        if not len(self) or not len(h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
        return np.where((self.hashes[at] == h) & (self.sizes[at] == size), at, -1)


class _Block:
    """Documents gathered for one row of the index."""

    def __init__(self):
        self.ids, self.n, self.keys, self.times, self.size, self.docs = [], [], [], [], 0, 0

    def add(self, ids: pa.Array, n: np.ndarray, begun: bool, doc: np.ndarray, term: np.ndarray, size: int) -> None:
        if begun:
            self.n[-1][-1] += n[0]
        else:
            self.ids.append(ids)
            self.n.append(n.astype(np.int64))
            self.docs += len(n)
        keys, times = np.unique(term << 32 | doc + (self.docs - len(n)), return_counts=True)
        self.keys.append(keys)
        self.times.append(times)
        self.size += size

    def row(self) -> pa.RecordBatch:
        keys, times, n = np.concatenate(self.keys), np.concatenate(self.times), np.concatenate(self.n)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        tf = np.add.reduceat(times, begins) if len(keys) else times
        term, size = np.unique(keys[begins] >> 32, return_counts=True)
        columns = [pa.concat_arrays(self.ids), n, term, size, keys[begins] & 0xFFFFFFFF, tf]
        columns = [pa.array([x], _INDEX.field(i).type) if isinstance(x, np.ndarray) else pa.ListArray.from_arrays([0, len(x)], x) for i, x in enumerate(columns)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], schema=_INDEX)


def indexed(docs: DataFrame, shared) -> DataFrame:
    """INDEX rows, one for each block of documents, of the terms of the broadcast vocabulary."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = shared.value, _Block()
        most = max(1024, CELLS // max(1, len(words)))
        for batch in batches:
            ids = batch.column(0)
            for piece in pieces(batch.column(1), AT_ONCE, TERM, rows=most, lower=True):
                if block.docs and not piece.begun and (block.size >= BLOCK_BYTES or block.docs + len(piece) > most):
                    yield block.row()
                    block = _Block()
                runs = Runs(piece, TERM)
                term = words.number(runs.hashes(), runs.end - runs.start)
                known = term >= 0
                block.add(ids.slice(piece.first, len(piece)), runs.counts, piece.begun, runs.doc[known], term[known], len(piece.body))
        if block.docs:
            yield block.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(fold), INDEX)


class Impacts:
    """The lists of a block: for each term its documents, those of the highest impact first (of equal ones in the order of the block)."""

    def __init__(self, row: dict, weight: np.ndarray, documents: int, occurrences: int):
        n, size, doc, tf = (np.asarray(row[c], np.int64) for c in ("n", "size", "doc", "tf"))
        if len(n) and int(n.max()) * documents * 90 >= 1 << 63:
            m = np.array([10 + 90 * int(x) * documents // occurrences for x in n], np.int64)
        else:
            m = 10 + 90 * n * documents // max(1, occurrences)
        term = np.repeat(np.asarray(row["term"], np.int64), size)
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((doc, -impact, term))
        self.docs, self.doc, self.impact = len(n), doc[order], impact[order]
        ends = np.cumsum(size).tolist()
        self.lists = {int(t): (e - int(s), e) for t, s, e in zip(row["term"], size, ends, strict=True)}
        self.places: dict[int, np.ndarray] = {}

    def place(self, term: int) -> np.ndarray:
        """Where each document stands in the term's list, -1 where it doesn't."""
        if term not in self.places:
            a, b = self.lists[term]
            self.places[term] = np.full(self.docs, -1, np.int32)
            self.places[term][self.doc[a:b]] = np.arange(b - a, dtype=np.int32)
        return self.places[term]

    def best(self, query: np.ndarray, least: int, offer) -> int:
        """Offers documents (places in the block, scores) of the query, beginning with the lists' tops. ``least``: the k-th score so far;
        ``offer`` returns it anew. Returns how many documents were scored."""
        terms = [t for t in query.tolist() if t in self.lists]
        spans = [self.lists[t] for t in terms]
        seen = [np.zeros(b - a + 1, bool) for a, b in spans]  # one place more, never seen
        position, depth, step, scored = [0] * len(terms), 0, STEP, 0
        longest = max((b - a for a, b in spans), default=0)
        met = np.zeros(self.docs, bool)
        bound = sum(int(self.impact[a]) for a, _ in spans)
        while bound and bound >= least and depth < longest:
            fresh = np.unique(np.concatenate([self.doc[a + depth : min(a + depth + step, b)] for a, b in spans]))
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            score = np.zeros(len(fresh), np.int64)
            for t, (a, b), been in zip(terms, spans, seen, strict=True):
                at = self.place(t)[fresh]
                held = at >= 0
                score[held] += self.impact[a:b][at[held]]
                been[at[held]] = True
            scored += len(fresh)
            least = offer(fresh, score)
            depth, step = depth + step, 2 * step
            bound = 0
            for i, ((a, b), been) in enumerate(zip(spans, seen, strict=True)):
                position[i] += int(np.argmin(been[position[i] :]))
                bound += int(self.impact[a + position[i] - 1]) if position[i] < b - a else 0
        return scored


class Best:
    """The k best documents of a query so far: highest scores first, then smallest ids, null ids last."""

    def __init__(self, most: int):
        self.most, self.score, self.id, self.null = most, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a document must reach to be one of them."""
        return int(self.score[-1]) if len(self.score) == self.most else 1

    def take(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> int:
        good = score >= self.least
        if good.any():
            score, ids, null = (np.concatenate(x) for x in ((self.score, score[good]), (self.id, ids[good]), (self.null, null[good])))
            order = np.lexsort((ids, null, -score))[: self.most]
            self.score, self.id, self.null = score[order], ids[order], null[order]
        return self.least


def found_in(index: DataFrame, shared, weight: list[int], documents: int, occurrences: int, most: int) -> DataFrame:
    """query (its number), item_id, doc_id, score: the best of each task."""
    schema = pa.schema([("query", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = shared.value, np.array(weight, np.int64)
        best = [Best(most) for _ in words.queries]
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].values for c in ("doc_id", "n", "term", "size", "doc", "tf")}
                null, ids = row["doc_id"].is_null().to_numpy(zero_copy_only=False), row["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
                impacts = Impacts({c: row[c].to_numpy(zero_copy_only=False) for c in row if c != "doc_id"}, w, documents, occurrences)
                for query, b in zip(words.queries, best, strict=True):
                    impacts.best(query, b.least, lambda at, score, b=b: b.take(score, ids[at], null[at]))
        for k, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), k)), pa.array([words.ids[k]] * len(b.score), pa.int64()), pa.array(b.id, mask=b.null), pa.array(b.score)], schema=schema)

    return index.mapInArrow(tidy(search), "query long, item_id long, doc_id long, score long")


def _parts(spark: SparkSession, queries: DataFrame) -> Iterator:
    """Broadcast vocabularies of the queries, each of bounded size."""
    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("octet_length(text) > 0").distinct()
    parts = 1 + int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // MOST_BYTES
    for part in range(parts):
        held = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        if held:
            yield spark.sparkContext.broadcast(Vocabulary([r["item_id"] for r in held], [r["text"] for r in held]))


def lexical_search(spark: SparkSession, docs: DataFrame, queries: DataFrame, most: int = MOST) -> DataFrame:
    """item_id, rank, doc_id, score of the ``most`` best documents of each of ``queries`` (item_id, text)."""
    scratch, found = Scratch(spark, "search"), []
    for part, shared in enumerate(_parts(spark, queries)):
        index = scratch.keep(indexed(docs, shared), f"index_{part}")
        documents, occurrences = (int(x or 0) for x in index.agg(F.sum("held"), F.sum("total")).first())
        df = index.select(F.explode(F.arrays_zip("term", "size")).alias("t")).groupBy("t.term").agg(F.sum("t.size").alias("df")).collect()
        weight = [0] * len(shared.value)
        for r in df:
            weight[r["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
        found.append(found_in(index, shared, weight, documents, occurrences, most).withColumn("part", F.lit(part)))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = first_rows(reduce(DataFrame.union, found), ["part", "query"], order, most)
    return scratch.close(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _terms(text: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


ORACLES = {
    "op11_lexical_search": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms('text')} AS t FROM documents),
whole AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_all, CAST(sum(len(t)) AS BIGINT) AS l_all FROM d),
q AS (SELECT DISTINCT item_id, unnest({_terms('text')}) AS term FROM benchmark),
o AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3, 4),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w, n_all, l_all FROM (SELECT term, count(*) AS df FROM o GROUP BY term), whole),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all)))) AS BIGINT) AS score FROM q JOIN o USING (term) JOIN w USING (term) GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
}
