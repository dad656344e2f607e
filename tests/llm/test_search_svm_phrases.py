"""Ranked search, the quality classifier and phrases against plain Python on small tables: nulls, empty and long texts, ties, repeated rows, empty tables,
clashing names."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, block long, rank int, score long, phrase string, term int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(n=300, seed=3):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgäöéñ") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    prose = lambda k: " ".join(rnd.choice(vocabulary).title() if rnd.random() < 0.1 else rnd.choice(vocabulary) for _ in range(k))
    texts = [None, "", " \n\t ", "--- !!", "one", prose(30000), "ab " * 5000, "日本 " * 20]
    texts += [prose(rnd.randint(1, 60)) + rnd.choice([".", ", new york city ", "\n", "! New York City hall; "]) + prose(rnd.randint(0, 9)) for _ in range(n)]
    rows = [(i, t, "xy"[i % 3 > 1] if i % 7 else None, "s", i, 1, 2, "p", 3) for i, t in enumerate(texts)]
    return rows + [rows[20], rows[20], (None, rows[21][1], "x", *[None] * 6), (20, "ab cd", "x", *[None] * 6)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def ranked(rows, queries, most):
    bags = [(doc, Counter(terms(text))) for doc, text in rows]
    n_all, l_all = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in sorted(set(queries), key=str):
        scores = []
        for doc, bag in bags:
            m = 10 + (90 * sum(bag.values()) * n_all) // l_all if l_all else 10
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if bag[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, k, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scores)[:most], 1)]
    return Counter(out)


def test_lexical_search(spark, docs, nothing, monkeypatch):
    from netloom.llm import lexical_search as L

    rows = corpus()
    queries = [(1, rows[40][1]), (2, "ab cd AB zzz"), (2, rows[41][1]), (3, None), (4, ""), (5, "?!"), (6, "nowhere"), (7, rows[20][1]), (7, rows[20][1]), (None, "new york"), (8, "日本 ab")]
    table = spark.createDataFrame([(*q, 5, "x") for q in queries], "item_id long, text string, rank int, query string")
    for most, block in ((10, L.BLOCK_BYTES), (3, 2000)):
        monkeypatch.setattr(L, "BLOCK_BYTES", block)
        found = L.lexical_search(spark, docs, table, most)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, found.collect())) == ranked([(r[0], r[1]) for r in rows], [q for q in queries if q[1]], most)
    monkeypatch.setattr(L, "MOST_BYTES", 64)  # several passes
    assert Counter(map(tuple, L.lexical_search(spark, docs, table, 3).collect())) == ranked([(r[0], r[1]) for r in rows], [q for q in queries if q[1]], 3)
    assert L.lexical_search(spark, nothing, table).count() == L.lexical_search(spark, docs, table.where("false")).count() == 0
    assert L.lexical_search(spark, docs.withColumn("text", F.lit(None).cast("string")), table).count() == 0


def test_best_positions_stop_before_the_ends_of_lists():
    from netloom.llm.lexical_search import Best, Impacts

    rnd = np.random.default_rng(5)
    n, lists = 4000, 4
    doc = [np.sort(rnd.choice(n, 3000, replace=False)) for _ in range(lists)]
    tf = [np.where(d < 30, 60, 1 + (rnd.random(len(d)) < 0.02)) for d in doc]
    row = {"n": np.full(n, 50), "term": np.arange(lists), "size": np.full(lists, 3000), "doc": np.concatenate(doc), "tf": np.concatenate(tf)}
    impacts, best = Impacts(row, np.array([900, 800, 700, 600]), n, 50 * n), Best(10)
    scored = impacts.best(np.arange(lists), best.least, lambda at, score: best.take(score, at, np.zeros(len(at), bool)))
    whole = np.zeros(n, np.int64)
    for t, (a, b) in impacts.lists.items():
        whole[impacts.doc[a:b]] += impacts.impact[a:b]
    order = np.lexsort((np.arange(n), -whole))[:10]
    assert best.id.tolist() == order.tolist() and best.score.tolist() == whole[order].tolist()
    assert scored < n / 8
    assert impacts.best(np.arange(lists), int(whole.max()) * 9, None) == 0  # a later block of which nothing can be among the best


def test_pieces_of_long_texts():
    import pyarrow as pa

    from netloom.llm.runs import Runs, pieces
    from netloom.llm.words import _SPACE

    texts = ["a bb", None, "x" * 500 + " y", "c " * 300, "", "é" * 40 + " zz"]
    found = defaultdict(list)
    for piece in pieces(pa.array(texts), 64, ~_SPACE):
        runs = Runs(piece, ~_SPACE)
        h = runs.hashes()
        for i in range(len(runs)):
            found[piece.first + int(runs.doc[i])].append((runs.text(i), int(h[i])))
    assert [[w for w, _ in found[i]] for i in range(len(texts))] == [(t or "").split() for t in texts]
    assert len({h for l in found.values() for _, h in l}) == len({w for l in found.values() for w, _ in l})


def test_quality_svm(spark, docs, nothing):
    from netloom.llm.quality_svm import quality_svm

    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    good = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 80)))
    bad = [lambda: " ".join([rnd.choice(words)] * 40), lambda: " ".join(rnd.choice(words) + "&&&" for _ in range(30)), lambda: good().upper() + "!!"]
    rows = [(i, good() if i % 3 else bad[i % 9 // 3]()) for i in range(1500)]
    odd = [(9001, None), (9002, ""), (9003, "word " * 400_000), (None, "ab"), (5, rows[5][1]), (5, rows[5][1])]
    table = spark.createDataFrame([(*r, "n", 7) for r in rows + odd], "doc_id long, text string, label string, predicted int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(1500)] + [(7, 0, 0), (None, 1, 0), (9001, None, 0), (77_777, 1, 1)], "doc_id long, quality int, score int")
    found = quality_svm(spark, table, labels).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found if r["doc_id"] is not None)
    held = [r for r in found if r["held_out"] and r["doc_id"] < 1500]
    assert len(held) > 200 and sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in held) >= 0.98 * len(held)
    assert len({r["score"] for r in found if r["doc_id"] == 5}) == 1
    again = {(r["doc_id"], round(r["score"], 9)) for r in quality_svm(spark, table.repartition(5), labels.repartition(3)).collect()}
    assert again == {(r["doc_id"], round(r["score"], 9)) for r in found}
    assert quality_svm(spark, nothing, labels).count() == 0
    assert {r["score"] for r in quality_svm(spark, docs, labels.where("false")).collect()} == {0.5}
    assert {r["predicted"] for r in quality_svm(spark, table, labels.where("quality = 0 and doc_id > 100")).collect()} == {0}


def test_dual_coordinate_descent_finds_the_least_loss():
    """Its primal value is not above that of nearby weights."""
    from netloom.llm import quality_svm as Q

    rnd = np.random.default_rng(2)
    rows = [np.unique(rnd.integers(0, 40, 8)) for _ in range(120)]
    y = np.where(rnd.random(120) < 0.5, 1, -1)
    r = np.ones(40)
    blend, Q.BLEND = Q.BLEND, 1.0
    try:
        w, bias = Q.descend(rows, y, r, epochs=3000)
    finally:
        Q.BLEND = blend
    x = np.zeros((120, 41))
    for i, b in enumerate(rows):
        x[i, b] = 1 / math.sqrt(len(b))
    x[:, 40] = 1
    value = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    best = value(np.append(w, bias))
    assert all(best <= value(np.append(w, bias) + 0.05 * rnd.normal(size=41)) + 1e-2 for _ in range(200))


def phrases(rows, least, most, inside):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    c = {p: a for p, a in f.items() if len(p) >= 3 and a >= least}
    lost = set()
    for p, a in c.items():
        for i in range(1, len(p)):
            for j in range(i + 2, len(p) + 1):
                part = (p[0], *p[i:j])
                if len(part) < len(p) and 100 * a >= inside * c[part]:
                    lost.add(part)
    by = defaultdict(list)
    for p, a in c.items():
        if p not in lost:
            cut = [(1000 * a * n[p[0]] // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cut)
            by[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return Counter((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, found in by.items() for i, x in enumerate(sorted(found)[:most], 1))


@pytest.mark.parametrize("least, most, inside, block, even", [(5, 2000, 100, 1_200_000, 1 << 12), (4, 30, 60, 700, 5), (1, 50, 100, 300, 1)])
def test_collocations(spark, docs, monkeypatch, least, most, inside, block, even):
    from netloom.llm import collocations as C

    monkeypatch.setattr(C, "AT_ONCE", 1000)  # long texts in pieces, blocks that end within a text
    rows = corpus()
    monkeypatch.setattr(C, "EVERY", even)  # ranges as narrow as a window
    monkeypatch.setattr(C, "RANGE_WINDOWS", 1 << 20 if even > 1 else 50)
    if least == 1:
        rows = [r for r in rows if len(r[1] or "") < 500]
        docs = docs.where("text is null or length(text) < 500")
    found = C.collocations(spark, docs, least, most, inside, block).collect()
    assert Counter((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found) == phrases([(r[1], r[2]) for r in rows], least, most, inside)


def test_collocations_of_nothing_and_beyond_64_bits(spark, nothing):
    from netloom.llm.collocations import collocations

    assert collocations(spark, nothing).count() == 0
    assert spark.sql("SELECT (CAST(1000 AS DECIMAL(4, 0)) * CAST(10000000000001 AS DECIMAL(17, 0)) * CAST(99999999999999 AS DECIMAL(17, 0))) div (CAST(10000000000003 AS DECIMAL(19, 0)) * CAST(10000000000007 AS DECIMAL(19, 0))) AS x").first()[0] == 1000 * 10000000000001 * 99999999999999 // (10000000000003 * 10000000000007)


def test_automata():
    """Sorted sequences in, the same with their counts out, split at any bounds; equal ends are shared."""
    from netloom.llm.automata import build, cuts, decode, encode, keys_of, sort_order, union

    rnd = random.Random(1)
    seqs = [tuple(rnd.randint(1, 5) for _ in range(rnd.randint(2, 5))) for _ in range(3000)]
    count = Counter(s[:k] for s in seqs for k in range(1, len(s) + 1))
    bounds = sorted({tuple((*s, 0, 0, 0)[:5]) for s in seqs[:7]})
    parts = defaultdict(list)
    for shard in (seqs[:1000], seqs[1000:1100], seqs[1100:]):
        columns = list(np.array([(*s, 0, 0, 0)[:5] for s in shard]).T)
        order = sort_order(keys_of(columns))
        columns = [c[order] for c in columns]
        edges = [0, *cuts(keys_of(columns), keys_of(list(np.array(bounds).T))).tolist(), len(order)]
        assert edges == [sum(tuple(x) < b for x in zip(*columns, strict=True)) for b in [(0,), *bounds, (9,)]]
        for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b > a:
                parts[j].append(decode(*encode(build([c[a:b] for c in columns]))))
    found = Counter()
    for j, automata in parts.items():
        for ways, total in union(automata, 20, list(bounds[j - 1]) if j else None, list(bounds[j]) if j < len(bounds) else None):
            for way, n in zip(ways.tolist(), total.tolist(), strict=True):
                found[tuple(way)] += n
    assert {k: v for k, v in found.items() if v >= 20} == {k: v for k, v in count.items() if v >= 20}
    levels = build([np.array(c) for c in ([1, 1, 2, 2], [1, 2, 1, 2], [3, 3, 3, 3], [4, 4, 4, 4], [0, 0, 0, 0])])
    assert [len(x[0]) for x in levels] == [1, 1, 1, 1, 0]
