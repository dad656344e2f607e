"""The pipeline's stages on the smallest table, each against plain Python on what it was given."""

import os
import sys

import corpus_pipeline

sys.path.insert(0, os.path.dirname(__file__))


def test_stages(spark, sf):
    from tests_support import groups_of, leaks_of

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = (docs.collect(), docs.columns)
        docs = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == given[name][1]
        given[name] += (docs.collect(),)
    before, _, after = given["language"]
    assert len(after) >= 0.98 * len(before)
    before, _, after = given["near_copies"]
    groups = groups_of([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(min(g) for g in groups)
    before, _, after = given["decontaminated"]
    leaking = leaks_of([(r["doc_id"], r["text"]) for r in before], [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - leaking
    before, _, after = given["without_secrets"]
    assert {r["doc_id"]: len(r["text"]) for r in before} == {r["doc_id"]: len(r["text"]) for r in after}
    before, _, pieces = given["packed"]
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in before}


def test_stages_on_odd_tables(spark, sf):
    """Nulls, empty and long texts, repeated rows and ids, further columns with odd names; and no rows at all."""
    import re

    from test_llm import SCHEMA, corpus
    from tests_support import groups_of, leaks_of, packed_ids

    from netloom.llm.token_counts import tokenizer_path

    rows = corpus()
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    key = "AKIA" + "Q" * 16
    rows += [(800, f"before {items[0]} after", "a", "s1", 1, 1, 1, "k", 7), (801, f"a b c {key} d", "a", "s1", 1, 1, 1, "k", 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs.limit(0), sf).collect() == [] and stages[name](spark, docs, sf).columns == docs.columns
    assert stages["packed"](spark, docs.limit(0), sf).collect() == []
    text = lambda found: sorted(str((r["doc_id"], r["text"])) for r in found)
    plain = [(r[0], r[1]) for r in rows]
    recognised = stages["language"](spark, docs, sf).collect()
    lettered = [x for x in plain if re.search("[^\\W\\d_]", x[1] or "")]
    assert set(text(recognised)) <= {str(x) for x in lettered} and len(recognised) >= 0.9 * len(lettered)
    groups = groups_of([(i, t) for i, (_, t) in enumerate(plain)])
    best = lambda g: min(g, key=lambda i: (plain[i][0] is None, plain[i][0] or 0))
    assert text(stages["near_copies"](spark, docs, sf).collect()) == sorted(str(plain[best(g)]) for g in groups)
    leaking = leaks_of(plain, items)
    assert leaking == {800}
    assert text(stages["decontaminated"](spark, docs, sf).collect()) == sorted(str(x) for x in plain if x[0] != 800)
    hidden = stages["without_secrets"](spark, docs, sf).collect()
    assert text(hidden) == sorted(str((d, t and t.replace(key, "*" * len(key)))) for d, t in plain)
    pieces = stages["packed"](spark, docs, sf).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"]) for r in pieces) == packed_ids(plain, pieces, tokenizer_path("word_bpe_49k.json"))


def test_run_registered(spark, sf):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    given = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert pieces and {r["doc_id"] for r in pieces} < given
