"""What is kept on disk to be read in part: adjacency, positions, grams, edges by number, snapshots. Each against its plain form, with the files that it opens."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graph import made, numbered

from netloom.functions.permutation import Permutation, sides
from netloom.operators import adjacency, graph, layout, sampling, search, search_index, spatial, spatial_index
from netloom.operators.attributes import Attributes
from netloom.sources import store
from netloom.sources.clustered import files_read, merged, within, write_clustered


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def random_graph(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(600), rnd.randrange(600)) for _ in range(1500)] + [(7, rnd.randrange(600)) for _ in range(400)] + [(7, 7), (3, 3)]
    return numbered(spark, 620, pairs)


@pytest.fixture(scope="module")
def kept(random_graph):
    return adjacency.stored(random_graph, chunk=50, band_rows=40)


def test_intervals():
    assert merged([(5, 6), (1, 2), (3, 3), (9, 9)]) == [(1, 3), (5, 6), (9, 9)]
    assert merged([(0, 0), (10, 10), (12, 12), (40, 41)], 2) == [(0, 12), (40, 41)]


def test_clustered_reads(spark):
    table = write_clustered(spark.range(10_000).withColumnRenamed("id", "k"), f"{tempfile.mkdtemp()}/t", "k", 9_999, 10_000, band_rows=500)
    few = table.between([(17, 17), (5_000, 5_003)])
    assert [r[0] for r in few.orderBy("k").collect()] == [17, 5_000, 5_001, 5_002, 5_003]
    few.collect()
    whole = table.rows
    whole.collect()
    assert files_read(few)[0] <= 4 < 15 < files_read(whole)[0]
    asked = list(range(0, 9_999, 11))  # more than an expression holds
    assert rows(table.between([(k, k) for k in asked])) == sorted([(k,) for k in asked], key=str)
    assert table.between([]).isEmpty() and rows(table.among(spark.createDataFrame([(3,), (3,), (77_777,)], "k long"))) == [(3,)]
    assert rows(table.among(spark.range(0, 9_000, 3).withColumnRenamed("id", "k"))) == sorted([(k,) for k in range(0, 9_000, 3)], key=str)


def test_stored_rows_and_neighbours(spark, random_graph, kept):
    for node in (0, 3, 7, 599, 619):
        assert [tuple(r) for r in kept.row(node).collect()] == [tuple(r) for r in graph.row(random_graph, node).collect()]
        assert rows(kept.neighbours(node)) == rows(graph.neighbours(random_graph, node))
    degrees = {r["idx"]: r["degree"] for r in graph.total_degree(random_graph).collect()}
    assert [kept.degree(n).first()[0] for n in (3, 7, 619)] == [degrees[n] for n in (3, 7, 619)]
    assert rows(kept.neighbour_list(7, 5)) == rows(graph.neighbour_list(random_graph, 7, 5))
    pages = kept.table.rows.where("node = 7")
    assert pages.count() >= 8 and pages.agg(F.max("n")).first()[0] < 100  # a hub's arcs are in many rows
    one = kept.table.between([(3, 3)])
    one.collect()
    every = kept.table.rows
    every.collect()
    assert files_read(one)[0] <= 2 and files_read(every)[0] >= 8
    assert files_read(one)[1] < files_read(every)[1] / 4
    mask = graph.khop(random_graph, 3, 2).select(F.col("node").alias("idx"))
    assert rows(kept.induced(mask)) == rows(graph.induced(random_graph, mask).select("seq", "src", "dst"))


def test_stored_khop(spark, random_graph, kept):
    for seed, hops in ((3, 2), (7, 1), (0, 9), (610, 3), (99_999, 2), (-1, None)):
        assert rows(kept.khop(seed, hops)) == rows(graph.khop(random_graph, seed, hops or 1).select("node", "parent", "hop"))


def test_khop_has_no_cap_and_goes_both_ways(spark):
    """A chain of 14 hops, and then a crowd whose last members are found by asking them (bottom-up)."""
    chain = [(i, i + 1) for i in range(14)]
    crowd = [(14, 100 + i) for i in range(60)] + [(100 + i, 200 + i % 5) for i in range(60)] + [(200 + i, 300) for i in range(5)]
    g = numbered(spark, 301, chain + crowd)
    g = graph.Graph(g.nodes.where("idx < 15 OR idx BETWEEN 100 AND 159 OR idx BETWEEN 200 AND 204 OR idx = 300"), g.edges)
    found = adjacency.stored(g).khop(0)
    assert {r["node"]: r["hop"] for r in found.collect()} == {**{i: i for i in range(15)}, **{100 + i: 15 for i in range(60)}, **{200 + i: 16 for i in range(5)}, 300: 17}
    assert rows(found) == rows(graph.khop(g, 0, 20).select("node", "parent", "hop"))
    assert {r["hop"] for r in graph.khop(g, 0, 7).collect()} == set(range(8))


def test_spatial_index(spark):
    rnd = random.Random(6)
    points = [(i, rnd.random() * 4000, rnd.random() ** 3 * 4000) for i in range(5000)] + [(5000, float("nan"), 3.0)]
    p = spark.createDataFrame(points, "idx long, x float, y float")
    for positions in (p.where("idx < 5000"), p, p.where("false")):
        grid, index = spatial.build_grid(positions), spatial_index.indexed(positions, band_rows=80)
        for box in ((1000, 50, 1400, 300), (0, 0, 4000, 4000), (3999, 3990, 9999, 9999), (-50, -50, 60, 1), (5000, 5000, 6000, 6000), (17, 17, 17, 17)):
            assert rows(index.nodes_in_rect(*box)) == rows(spatial.nodes_in_rect(grid, positions, *box))
            assert index.visible_count(*box).first() == spatial.visible_count(grid, positions, *box).first()
        assert [tuple(r) for r in index.nodes_in_rect(0, 0, 2000, 900, cap=30).collect()] == [tuple(r) for r in spatial.nodes_in_rect(grid, positions, 0, 0, 2000, 900, cap=30).collect()]
        for x, y, radius in ((1000, 50, 90), (3900, 3900, 400), (-5, -5, 50), (2000, 20, 0.001)):
            assert rows(index.pick(x, y, radius)) == rows(spatial.pick(grid, positions, x, y, radius))
    index = spatial_index.indexed(p.where("idx < 5000"), band_rows=80)
    part, whole = index.within(1000, 1000, 1400, 1400), index.table.rows
    part.collect(), whole.collect()
    (files, held), (all_files, n) = files_read(part), files_read(whole)
    assert files <= 0.15 * all_files and held <= 0.1 * n  # of an area of one hundredth


def test_covering_is_exact_where_it_may_be():
    for box in ((0, 0, 7, 7), (1, 2, 5, 6), (3, 3, 3, 3), (0, 0, 0, 7)):
        z = lambda x, y: sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(3))
        inside = {z(x, y) for x in range(box[0], box[2] + 1) for y in range(box[1], box[3] + 1)}
        assert {k for a, b in spatial_index.covering(*box, bits=3) for k in range(a, b + 1)} == inside
        assert inside <= {k for a, b in spatial_index.covering(*box, bits=3, most=4) for k in range(a, b + 1)}


def test_search_index(spark, monkeypatch):
    monkeypatch.setattr(search_index, "WIDTH", 16)
    monkeypatch.setattr(search_index, "FIRST_ROWS", 1)
    rnd = random.Random(4)
    names = ["".join(rnd.choice("abAB1é") for _ in range(rnd.randint(1, 9))) for _ in range(300)] + ["", "Needle in hay", "x'y%z_"]
    nodes = spark.createDataFrame(list(enumerate(names)), "idx long, id string")
    index = search_index.indexed(nodes, band_rows=20)
    for query in ("a", "B", "ab", "aBa", "abab", "1éa", "needle", "NEEDLE IN HAY", "x'y%z_", "zzz", "", "éé", "a1b1"):
        for limit in (3, 50):
            assert [tuple(r) for r in index.search(query, limit).collect()] == [tuple(r) for r in search.search_nodes(nodes, query, limit).collect()], (query, limit)
    held = index.held("nee")
    held.collect()
    whole = index.grams.rows
    whole.collect()
    assert files_read(held)[0] <= 2 < files_read(whole)[0] and held.count() == 1


@pytest.mark.parametrize("size", [1, 2, 3, 7, 97, 1000, 4999])
def test_permutation_is_a_bijection(spark, size):
    p = Permutation(size, 5)
    a, b = sides(size)
    assert size <= a * b < size + a
    places = p.walked(np.arange(size))
    assert sorted(places.tolist()) == list(range(size)) and p.walked(places.copy(), back=True).tolist() == list(range(size))
    if size == 97:
        df = sampling.ranked(spark.range(size).withColumnRenamed("id", "seq"), size, seed=5)
        assert [r["place"] for r in df.orderBy("seq").collect()] == places.tolist()
        assert df.where("place < 10").count() == 10
        assert df.withColumn("back", p.number(F.col("place"))).where("back <> seq").isEmpty()
        assert places.tolist() != Permutation(size, 6).walked(np.arange(size)).tolist()


def test_beginnings_of_orders_are_samples(spark):
    m = 3000
    edges = write_clustered(spark.range(m).select(F.col("id").alias("seq"), (F.col("id") * 7).alias("src")), f"{tempfile.mkdtemp()}/e", "seq", m - 1, m, band_rows=100)
    order = {r["place"]: r["seq"] for r in sampling.ranked(edges.rows, m).collect()}
    assert {r["place"]: r["seq"] for r in sampling.first_places(edges, m, 40).collect()} == {k: order[k] for k in range(40)}
    hits = np.histogram([order[k] for k in range(600)], bins=6, range=(0, m))[0]
    assert hits.min() > 60  # about 100 each


def test_many_intervals_are_read_without_a_test_of_each(spark):
    """More intervals than a filter names: a row meets those of its band, and not one after another."""
    m = 30_000
    table = write_clustered(spark.range(m).select(F.col("id").alias("seq")), f"{tempfile.mkdtemp()}/e", "seq", m - 1, m, band_rows=500)
    rnd = random.Random(4)
    asked = [(x, x + rnd.randrange(4)) for x in rnd.sample(range(-5, m), 700)] + [(9_000, 11_000)]
    found = table.between(asked)
    assert rows(found) == rows(spark.createDataFrame(sorted({(x,) for a, b in asked for x in range(max(a, 0), min(b, m - 1) + 1)}), "seq long"))
    drawn = sampling.first_places(table, m, 500)
    assert {r["place"]: r["seq"] for r in drawn.collect()} == dict(enumerate(Permutation(m).walked(np.arange(500), back=True).tolist()))
    for df in (found, drawn):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    far = 1 << 40  # beyond the bands
    assert table.between([(2 * x, 2 * x) for x in range(300)] + [(m - 2, far), (far + 9, 2 * far)]).count() == 302
    inside = [(i, i + i % 3) for i in range(0, 600, 5)]
    for k in (1, 2, 3, 7, 120):
        hit = spark.range(-3, 610).where(within(F.col("id"), inside[:k]))
        assert [r["id"] for r in hit.orderBy("id").collect()] == [x for a, b in inside[:k] for x in range(a, b + 1)]


def test_swapped_samples(spark):
    assert sorted(sampling.swapped(50, 50, 3)) == list(range(50)) == sorted(sampling.swapped(50, 99, 3))
    assert sampling.swapped(10**12, 300, 3)[:40] == sampling.swapped(10**12, 40, 3)
    assert len(set(sampling.swapped(10**12, 3000))) == 3000 and sampling.swapped(5, 0) == []
    plain, draws = list(range(30)), sampling.swapped(30, 30, 9)
    again = sampling.swapped(30, 12, 9)
    assert draws[:12] == again and sorted(draws) == plain
    m = 20_000
    edges = write_clustered(spark.range(m).select(F.col("id").alias("seq"), (F.col("id") * 7).alias("src")), f"{tempfile.mkdtemp()}/e", "seq", m - 1, m, band_rows=200)
    found = sampling.sample_stored(edges, m, 12, 9)
    assert {r["draw"]: (r["seq"], r["src"]) for r in found.collect()} == {i: (x, 7 * x) for i, x in enumerate(sampling.swapped(m, 12, 9))}
    few, whole = edges.between([(x, x) for x in sampling.swapped(m, 12, 9)]), edges.rows
    few.collect(), whole.collect()
    assert files_read(few)[0] <= 24 and files_read(whole)[0] >= 60


def test_snapshots(spark, monkeypatch):
    """What fails between data and manifest leaves the graph as it was; a reader of the old one goes on."""
    root = tempfile.mkdtemp()
    store.write_graph(spark, made(spark, [(1, 2), (2, 3)]), root, "g", "g")
    before = store.read_tables(spark, f"{root}/g")
    whole = store.write_manifest

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "write_manifest", fail)
    with pytest.raises(RuntimeError):
        store.write_graph(spark, made(spark, [(5, 6), (6, 7), (7, 8)]), root, "g", "g")
    assert store.manifest_of(spark, f"{root}/g")["edges"] == 2 and store.verify_graph(spark, f"{root}/g").where("not ok").isEmpty()
    monkeypatch.setattr(store, "write_manifest", whole)
    store.write_graph(spark, made(spark, [(5, 6), (6, 7), (7, 8)]), root, "g", "g")
    assert before.edges.count() == 2 and [r["id"] for r in before.nodes.orderBy("idx").collect()] == ["n1", "n2", "n3"]
    assert store.read_tables(spark, f"{root}/g").edges.count() == 3
    assert rows(store.read_adjacency(spark, f"{root}/g").khop(0)) == [(0, None, 0), (1, 0, 1), (2, 1, 2), (3, 2, 3)]
    assert rows(store.read_nodes(spark, f"{root}/g").between([(1, 2)])) == [(1, "n6"), (2, "n7")]
    assert rows(store.read_edges(spark, f"{root}/g").between([(2, 2)]).select("src", "dst")) == [(2, 3)]
    assert store.remove_old(spark, f"{root}/g") == 2 and store.verify_graph(spark, f"{root}/g").where("not ok").isEmpty()
    with pytest.raises(ValueError):
        store.read_tables(spark, f"{root}/none")


def test_attribute_names_never_clash(spark):
    nodes = spark.createDataFrame([(0, "a", 3), (1, "b", 1), (2, "c", 0)], "idx long, id string, degree long")
    table = spark.createDataFrame([("a", 1, 2, 3, 4, 5), ("a", 0, 9, 9, 9, 9), ("b", 7, 7, 7, 7, 7), (None, 1, 1, 1, 1, 1)], "id string, _key int, _rank int, degree int, degree_1 int, `x.y` int")
    a = Attributes(nodes).attach(table, "id")
    assert a.joined.columns == ["idx", "degree", "_key", "_rank", "degree_2", "degree_1", "x.y"]
    assert rows(a.joined) == [(0, 3, 0, 9, 9, 9, 9), (1, 1, 7, 7, 7, 7, 7), (2, 0, None, None, None, None, None)]


def test_pairs_within(spark, monkeypatch):
    rnd = random.Random(8)
    points = [(i, rnd.gauss(0, 1) * 20, rnd.gauss(0, 1) * 20) for i in range(300)] + [(i, 5.0, 5.0) for i in range(300, 340)] + [(400, float("nan"), 0.0), (401, None, 1.0), (402, float("inf"), 1.0)]
    expected = sorted((a, b) for a, x, y in points[:340] for b, u, v in points[:340] if a < b and (x - u) ** 2 + (y - v) ** 2 <= 9)
    table = spark.createDataFrame(points, "idx long, x double, y double")
    for most in (2000, 3):  # crowded cells are split
        monkeypatch.setattr(spatial, "CELL_ROWS", most)
        assert sorted((r["a"], r["b"]) for r in spatial.pairs_within(table, 3.0).collect()) == expected


def _rows_dealt(plan):
    """Rows that the shuffles of a collected query wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _rows_dealt(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _rows_dealt(plan.plan())
    own = plan.metrics().get("shuffleRecordsWritten") if kind == "ShuffleExchangeExec" else None
    children = plan.children()
    return (own.get().value() if own is not None and own.isDefined() else 0) + sum(_rows_dealt(children.apply(i)) for i in range(children.size()))


def test_pairs_within_deals_few_copies(spark, monkeypatch):
    """Pairs at exactly the radius, across tiles and in batches of a few rows; of each position less than two rows are dealt."""
    n, expected = 40, set()
    for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1), (2, 0), (0, 2)):
        expected |= {tuple(sorted((y * n + x, (y + dy) * n + x + dx))) for x in range(n) for y in range(n) if 0 <= x + dx < n and 0 <= y + dy < n}
    table = spark.range(n * n).select(F.col("id").alias("idx"), (F.col("id") % n - 7.0).alias("x"), (F.floor(F.col("id") / n) - 7.0).alias("y"))
    for most, batch in ((2000, 10_000), (2000, 7), (2, 50)):
        monkeypatch.setattr(spatial, "CELL_ROWS", most)
        monkeypatch.setattr(spatial, "MOST_MET", batch)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found = spatial.pairs_within(table, 2.0)
            pairs = [(r["a"], r["b"]) for r in found.collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(pairs) == len(set(pairs)) and set(pairs) == expected
        if most == 2000:
            assert n * n <= _rows_dealt(found._jdf.queryExecution().executedPlan()) < 2 * n * n
    points = [(i, 1e300 * (i % 3 - 1), 1e17 + 9 * i) for i in range(9)] + [(9, 0.0, 0.0), (10, 3.0, 0.0)]
    near = sorted((a, b) for a, x, y in points for b, u, v in points if a < b and (x - u) * (x - u) + (y - v) * (y - v) <= 16)
    huge = spark.createDataFrame(points, "idx long, x double, y double")
    assert sorted((r["a"], r["b"]) for r in spatial.pairs_within(huge, 4.0).collect()) == near


def test_mean_distance_is_bounded(spark):
    rnd = random.Random(9)
    points = [(rnd.gauss(0, 1) * 9 + 100 * (i % 3), rnd.random() * 50) for i in range(400)] + [(1.0, 1.0)] * 5
    exact = sum(((a - c) ** 2 + (b - d) ** 2) ** 0.5 for i, (a, b) in enumerate(points) for c, d in points[:i]) / (len(points) * (len(points) - 1) / 2)
    for levels in (None, 3):
        low, high = layout.mean_distance(spark.createDataFrame(points, "x double, y double"), levels).first()
        assert low - 1e-9 <= exact <= high + 1e-9
        assert levels or high - low < 0.06 * exact
    assert layout.mean_distance(spark.createDataFrame(points[:1], "x double, y double")).first()["low"] is None
