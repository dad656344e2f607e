"""Literal graphs, invariants, and the parts that no table query covers."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from netloom.functions import lod, styling
from netloom.functions.draws import with_draw
from netloom.operators import attributes, coarsen, graph, layout, search, spatial
from netloom.operators.attributes import Attributes, OneOf, Range, Style
from netloom.operators.index import dense_index
from netloom.plans.lineage import cut
from netloom.sources import edges as sources
from netloom.sources import generate, mapping, store
from netloom.sources.clustered import files_read
from netloom.streaming import ingest


def made(spark, pairs):
    rows = [(i, f"n{a}", f"n{b}", 1.0) for i, (a, b) in enumerate(pairs)]
    return graph.intern(spark.createDataFrame(rows, "seq long, source string, target string, weight double"))


def numbered(spark, n, pairs):
    nodes = spark.range(n).select(F.col("id").alias("idx"), F.concat(F.lit("n"), "id").alias("id"))
    return graph.Graph(nodes, spark.createDataFrame([(i, a, b, 1.0) for i, (a, b) in enumerate(pairs)], "seq long, src long, dst long, weight double"))


def test_first_seen_order(spark):
    g = made(spark, [(5, 2), (2, 9), (5, 5), (1, 9)])
    assert [r["id"] for r in g.nodes.orderBy("idx").collect()] == ["n5", "n2", "n9", "n1"]
    assert [(r["src"], r["dst"]) for r in g.edges.orderBy("seq").collect()] == [(0, 1), (1, 2), (0, 0), (3, 2)]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_dense_index_any_partitioning(spark, parts):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k")).repartition(parts)
    assert [r["k"] for r in dense_index(df, ["k"], "i").orderBy("i").collect()] == sorted(i * 37 % 101 for i in range(100))


def test_degrees_and_neighbours(spark):
    g = numbered(spark, 4, [(0, 1), (0, 2), (1, 2), (3, 0), (2, 2)])
    assert [r["degree"] for r in graph.total_degree(g).orderBy("idx").collect()] == [3, 2, 4, 1]
    assert {r["idx"] for r in graph.neighbours(g, 0).collect()} == {1, 2, 3}
    assert {r["idx"] for r in graph.neighbours(g, 2).collect()} == {0, 1}
    assert graph.total_degree(g).agg(F.sum("degree")).first()[0] == 2 * 5


def test_khop(spark):
    path = numbered(spark, 6, [(i, i + 1) for i in range(5)])
    for hops in (0, 1, 2, 3):
        found = {r["node"]: r["parent"] for r in graph.khop(path, 0, hops).collect()}
        assert found == {0: None, **{i: i - 1 for i in range(1, hops + 1)}}
    star = numbered(spark, 9, [(0, i) for i in range(1, 9)])
    assert tuple(graph.listed(graph.khop(star, 0, 1), 3).first()) == (8, 3)
    apart = numbered(spark, 4, [(0, 1), (2, 3)])
    assert {r["node"] for r in graph.khop(apart, 0, 5).collect()} == {0, 1}
    assert graph.khop(apart, 99, 2).isEmpty()
    # the first edge by stored row decides, not the lowest parent
    tie = numbered(spark, 4, [(0, 2), (0, 1), (2, 3), (1, 3)])
    assert {r["node"]: r["parent"] for r in graph.khop(tie, 0, 2).collect()}[3] == 1


def test_symmetrize(spark):
    g = numbered(spark, 2, [(0, 1), (0, 1), (1, 0), (1, 1)])
    assert {tuple(r) for r in graph.symmetrize(g.edges).collect()} == {(0, 1, 3.0), (1, 0, 3.0)}


def test_labels_and_hierarchy(spark):
    star = numbered(spark, 201, [(0, i) for i in range(1, 201)])
    labels = coarsen.propagate(graph.symmetrize(star.edges), star.nodes)
    sizes = [r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 32 and sum(sizes) == 201
    g = generate.planted(spark, 400, 3000, 20, 0.95)
    nodes = spark.range(400).select(F.col("id").alias("idx"))
    levels = coarsen.build_hierarchy(g.withColumn("weight", F.lit(None).cast("double")), nodes, target=60)
    counts = [x["n"] for x in levels]
    assert len(counts) > 1 and all(b * 20 <= a * 19 for a, b in zip(counts, counts[1:]))
    for fine, coarse in zip(levels, levels[1:]):
        assert fine["parent"].count() == fine["n"]
        assert fine["parent"].agg(F.max("coarse")).first()[0] == coarse["n"] - 1
        assert fine["parent"].groupBy("coarse").count().agg(F.max("count")).first()[0] <= 32
        again = coarsen.contract(fine["sym"], fine["parent"])
        assert again.exceptAll(coarse["sym"]).isEmpty()


def test_propagation_in_order(spark):
    """Planted groups: at least as much weight inside labels as the synchronous form has, never above the cap, the same each time."""
    import random

    rnd = random.Random(12)
    pairs = [(20 * c + rnd.randrange(20), 20 * c + rnd.randrange(20)) for c in range(4) for _ in range(90)] + [(rnd.randrange(80), rnd.randrange(80)) for _ in range(12)]
    g = numbered(spark, 82, pairs)
    sym = cut(graph.symmetrize(g.edges))
    found = coarsen.colours(sym, g.nodes)
    colour = {r["node"]: r["colour"] for r in found.collect()}
    assert set(colour) == set(range(82)) and all(colour[r["src"]] != colour[r["dst"]] for r in sym.collect())

    def inside(labels):
        of = {r["node"]: r["label"] for r in labels.collect()}
        assert len(of) == 82 and max(map(list(of.values()).count, set(of.values()))) <= 32
        return sum(r["weight"] for r in sym.collect() if of[r["src"]] == of[r["dst"]]), of

    ordered, labels = inside(coarsen.propagate_in_order(sym, g.nodes, sweeps=2))
    assert ordered >= inside(coarsen.propagate(sym, g.nodes, sweeps=2))[0]
    assert inside(coarsen.propagate_in_order(sym.repartition(3), g.nodes, sweeps=2))[1] == labels
    star = numbered(spark, 60, [(i, 0) for i in range(1, 60)])
    sizes = coarsen.propagate_in_order(graph.symmetrize(star.edges), star.nodes, sweeps=1).groupBy("label").count()
    assert sizes.agg(F.max("count")).first()[0] <= 32


def test_registered_hierarchies_keep_the_operators_rounds(monkeypatch):
    import inspect
    from types import SimpleNamespace

    from netloom.plans import catalogue

    class Asked(Exception):
        pass

    def asked(f):
        def spy(*args, **named):
            bound = inspect.signature(f).bind(*args, **named)
            bound.apply_defaults()
            raise Asked(bound.arguments)

        return spy

    monkeypatch.setattr(catalogue.tables, "geography", lambda *_: SimpleNamespace(edges=None, nodes=None))
    monkeypatch.setattr(coarsen, "build_hierarchy", asked(coarsen.build_hierarchy))
    with pytest.raises(Asked) as found:
        catalogue.hierarchy_levels(None, "")
    assert (found.value.args[0]["sweeps"], found.value.args[0]["max_levels"]) == (coarsen.SWEEPS, coarsen.MAX_LEVELS)


def test_draws(spark):
    rows = with_draw(spark.range(4), 42, F.col("id"), "u").orderBy("id").collect()
    assert [r["u"] for r in rows] == [0.6011037519201636, 0.44829055899754167, 0.8524657934904099, 0.6697340414393693]
    assert with_draw(spark.range(1), 0, F.col("id"), "u").first()["u"] == 0.26642920868471265


def test_force_steps_separate_cliques(spark):
    n = 12
    pairs = [(i, j) for c in (0, n) for i in range(c, c + n) for j in range(i + 1, c + n)] + [(0, n)]
    g = numbered(spark, 2 * n, pairs)
    sym, p = graph.symmetrize(g.edges), layout.disc_positions(g.nodes)
    for i in range(6):
        p = layout.force_step(sym, p, 2 * n, layout.step_size(2 * i, 12, 2 * n, True))
    health = layout.health(p).first()
    assert health["bad"] == 0 and not health["collapsed"] and health["min_x"] >= 0 and health["max_x"] <= layout.WORLD
    ratio = layout.separation(p, p.select("idx", F.floor(F.col("idx") / n).alias("community"))).first()
    assert ratio["inter"] > 2 * ratio["intra"]
    assert layout.fingerprint(layout.disc_positions(g.nodes, 1)).first() != layout.fingerprint(layout.disc_positions(g.nodes, 2)).first()
    assert [layout.steps_of(i, 5, 10) for i in (4, 3, 2, 1, 0)] == [300, 150, 75, 40, 40] and layout.steps_of(0, 2, 11, 10) == 0


def test_spatial(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 10.0, 10.0), (3, 5.0, 5.0), (4, 5.0, 5.0)], "idx long, x float, y float")
    grid = spatial.build_grid(p)
    assert spatial.pick(grid, p, 5.1, 5.0, 1.0).first()["idx"] == 3
    assert spatial.pick(grid, p, 6.0, 5.0, 1.0).isEmpty()  # the radius is exclusive
    assert {r["idx"] for r in spatial.nodes_in_rect(grid, p, 5, 5, 10, 10).collect()} == {2, 3, 4}
    assert spatial.visible_count(grid, p, 100, 100, 200, 200).first()["n"] == 0
    bad = spatial.build_grid(p.withColumn("x", F.lit(float("nan")).cast("float")))
    assert (bad.x, bad.y) == (0.0, 0.0)
    camera = spatial.Camera.fit(0, 0, 100, 100, 800, 600)
    moved = camera.zoomed(2, 100, 100)
    assert moved.world(100, 100) == pytest.approx(camera.world(100, 100))
    assert camera.pan(10, 0).x == pytest.approx(camera.x - 10 / camera.zoom)


def test_search_stops_early(spark):
    ids = ["xa"] * 0 + ["ba", "ca", "ab", "da", "ac"]
    nodes = spark.createDataFrame([(i, s) for i, s in enumerate(ids)], "idx long, id string")
    found = search.search_nodes(nodes, "A", 2)
    assert [(r["idx"], r["prefix"], r["truncated"]) for r in found.collect()] == [(0, False, True), (1, False, True)]
    assert search.search_nodes(nodes, "").isEmpty() and search.search_nodes(nodes, "zz").isEmpty()
    assert not search.search_nodes(nodes, "ab").first()["truncated"]


def test_attributes(spark):
    nodes = spark.createDataFrame([(i, f"n{i}", i) for i in range(5)], "idx long, id string, degree long")
    rows = [("n0", "red", 1.0, 7), ("n1", "red", None, 8), ("n1", "blue", 3.0, 9), (None, "red", 4.0, 1), ("ghost", "green", 5.0, 2), ("n2", "blue", 2.0, 3)]
    a = Attributes(nodes).attach(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "key string, colour string, score double, degree int, n int"), "key", ["n"])
    assert tuple(a.report().first()) == (6, 3, 2, 2)
    assert a.columns == ["degree", "colour", "score", "degree_1", "n"]
    assert a.joined.count() == 5 and a.joined.where("idx = 1").first()["colour"] == "red"
    assert {r["idx"] for r in a.matching([Range("score", 1, 2)]).collect()} == {0, 2}
    assert a.matching([OneOf("colour", ())]).isEmpty() and a.matching([Range("score", float("inf"), 2)]).count() == 5
    assert [tuple(r) for r in a.top_values("colour").collect()] == [("red", 2), ("blue", 1)]
    assert a.histogram("score").agg(F.sum("n")).first()[0] == 2 and a.histogram("colour").isEmpty()
    styled = {r["idx"]: r for r in a.styled(Style("colour", "score", [Range("degree", 0, 2)])).collect()}
    assert styled[4]["style"] >> 24 == 0 and not styled[4]["visible"] and styled[0]["c"] == 1.0
    assert styled[1]["s"] == -1.0 and styled[1]["style"] >> 24 == styling.NEUTRAL_SIZE
    assert {r["slot"] for r in a.legend("colour").collect()} == {1, 2}
    assert Attributes(nodes).attach(spark.createDataFrame(rows, "key string, a string, b double, c int"), "missing").key == "key"


def test_styling_and_lod(spark):
    one = spark.range(1)
    at = lambda c: one.select(c).first()[0]
    assert at(styling.sequential(F.lit(0.0))) == styling.rgb("#184f95") and at(styling.sequential(F.lit(1.0))) == styling.rgb("#cde2fb")
    assert at(styling.sequential(F.lit(float("nan")))) == styling.rgb(styling.NEUTRAL)
    assert at(styling.size_code(F.lit(0.0))) == 1 and at(styling.size_code(F.lit(1.0))) == 255
    assert tuple(at(lod.limits(F.lit(10), F.lit(20), F.lit(float("nan")), F.lit(-1.0)))) == (10, 20)
    assert tuple(at(lod.limits(F.lit(5_000_000), F.lit(9_000_000), F.lit(1.0), F.lit(0.5)))) == (500_000, 150_000)


def test_mapping_guesses():
    assert mapping.sniff("a;b;c,d") == ";" and mapping.sniff("abc") == "," and mapping.sniff("a\tb") == "\t"
    assert mapping.guess("when;source;target;weight\n2020;a;b;1.5\n") == mapping.Mapping(";", True, 1, 2, 3)
    assert mapping.guess("a,b\n1,2\n").header and not mapping.guess("1,2\nb,c\n").header
    assert mapping.records('"ab"cd,x\r\n\r\n,\n"a""b","c\nd"\nlast', ",") == [["abcd", "x"], ["", ""], ['a"b', "c\nd"], ["last"]]
    assert mapping.records("a,b\nc,", ",", complete=False) == [["a", "b"]]
    with pytest.raises(ValueError):
        mapping.Mapping(source=1, target=1).checked(3)
    with pytest.raises(ValueError):
        mapping.Mapping().checked(1)
    assert mapping.Mapping(weight=9).checked(3).weight is None


def test_read_records(spark):
    folder = tempfile.mkdtemp()
    with open(f"{folder}/e.csv", "w") as f:
        f.write('s,t,w\na,b,1\n\n"x,y","q""r"tail,2.5\nragged\nb,c,1f\n,d,inf\nc,c, 3 \r\n')
    records, counts = sources.read_records(spark, f"{folder}/e.csv", mapping.Mapping(",", True, 0, 1, 2))
    assert [tuple(r)[1:] for r in records.orderBy("seq").collect()] == [("a", "b", 1.0), ("x,y", 'q"rtail', 2.5), ("", "d", float("inf")), ("c", "c", 3.0)]
    assert tuple(counts.first()) == (6, 2)
    assert sources.guess_mapping(spark, f"{folder}/e.csv") == mapping.Mapping(",", True, 0, 1, 2)
    with open(f"{folder}/m.csv", "w") as f:
        f.write('s,t\n"a\nb",c\nd,\n')
    # a field that goes on in the next line is noticed, and rows are numbered without gaps
    records, counts = sources.read_records(spark, f"{folder}/m.csv", mapping.Mapping())
    assert [tuple(r)[:3] for r in records.collect()] == [(0, "a\nb", "c")] and tuple(counts.first()) == (2, 1)
    with open(f"{folder}/q.csv", "w") as f:
        f.write('s,t\n5" pipe,c\nd,e\n')  # a quote inside a field opens none
    assert [tuple(r)[1:3] for r in sources.read_records(spark, f"{folder}/q.csv", mapping.Mapping())[0].orderBy("seq").collect()] == [('5" pipe', "c"), ("d", "e")]


def test_mapping_is_guessed_from_the_first_file(spark):
    """Scans take the largest files first: neither these nor an empty file are the beginning."""
    folder = f"{tempfile.mkdtemp()}/a dir [1]%41"
    os.mkdir(folder)
    for name, text in (("part-0", ""), ("part-1 +", "w;to;from\n1;b;a\n"), ("part-2", "2;d;c\n" * 5000), ("part-3", "3;f;e\n" * 9000)):
        with open(f"{folder}/{name}.csv", "w") as f:
            f.write(text)
    path = folder.replace("[", "\\[").replace("]", "\\]")
    assert sources.guess_mapping(spark, path) == mapping.Mapping(";", True, 2, 1, 0)
    first = sources.beginning(spark.read.text(path), next(f for f in spark.read.text(path).inputFiles() if "part-1" in f))
    assert [r["value"] for r in first.collect()] == ["w;to;from", "1;b;a"] and files_read(first)[0] == 1
    records, counts = sources.read_records(spark, path)
    assert tuple(counts.first()) == (14_001, 0)
    assert [tuple(r) for r in records.where("seq in (1, 2, 5001, 5002, 14001)").orderBy("seq").collect()] == [(1, "a", "b", 1.0), (2, "c", "d", 2.0), (5001, "c", "d", 2.0), (5002, "e", "f", 3.0), (14001, "e", "f", 3.0)]


def test_attributes_from_csv(spark):
    folder = tempfile.mkdtemp()
    with open(f"{folder}/a.csv", "w") as f:
        f.write('id,score,kind\nn0,1.5,"a ""b"", c"\nn1,,x\n')
    t = attributes.read_attributes(spark, f"{folder}/a.csv")
    assert t.dtypes == [("id", "string"), ("score", "double"), ("kind", "string")]
    assert [tuple(r) for r in t.orderBy("id").collect()] == [("n0", 1.5, 'a "b", c'), ("n1", None, "x")]


def test_lists_pages_and_visible_edges(spark):
    hub = numbered(spark, 40, [(0, i) for i in range(1, 40)] + [(5, 0), (7, 7)])
    assert [r["idx"] for r in graph.neighbour_list(hub, 0, 3).collect()] == [1, 2, 3] and graph.neighbours(hub, 0).count() == 39
    pages = graph.adjacency_pages(hub, 10).where("src = 0").orderBy("page").collect()
    assert [len(r["neighbours"]) for r in pages] == [10, 10, 10, 9] and sum((r["neighbours"] for r in pages), []) == list(range(1, 40))
    styled = hub.nodes.select("idx", F.col("idx").isin(0, 5, 6).alias("visible"))
    assert sorted(tuple(r) for r in attributes.visible_edges(hub.edges, styled).select("src", "dst").collect()) == [(0, 5), (0, 6), (5, 0)]


def test_unnumbered_graphs_are_the_same(spark):
    rows = spark.createDataFrame([(3, "a", "b"), (1, "c", "a"), (2, None, "x"), (5, "b", "b"), (4, "", "c")], "at long, s string, t string")
    g = graph.intern(sources.from_table(rows, F.col("s"), F.col("t"), None, ["at"]))
    u = graph.intern_unnumbered(*sources.unnumbered(rows, F.col("s"), F.col("t"), None, ["at"]))
    assert sorted(map(tuple, graph.total_degree(g).collect())) == sorted(map(tuple, u.nodes.collect()))
    assert sorted(map(tuple, g.edges.select("src", "dst").collect())) == sorted(map(tuple, u.edges.select("src", "dst").collect()))
    assert {tuple(r) for r in graph.degrees_by_id(rows.select(F.col("s").alias("source"), F.col("t").alias("target")).dropna()).collect()} == {("a", 2), ("b", 3), ("c", 2), ("", 1)}


def test_checksum_ignores_the_order_of_rows(spark):
    rows = [(0, 1, 1.0), (1, 0, 1.0), (2, 1, 0.5)]
    one, two, three = (coarsen.checksum(spark.createDataFrame(r, "src long, dst long, weight double")).first() for r in (rows, rows[::-1], rows[:2] + [(2, 1, 0.25)]))
    assert one == two and one["arcs"] == three["arcs"] and one["hash"] != three["hash"]
    assert coarsen.checksum(spark.createDataFrame([], "src long, dst long, weight double")).first()["arcs"] == 0


def test_generated_graph_through_ingest(spark):
    edges, path = generate.planted(spark, 50, 400, 5), tempfile.mkdtemp() + "/csv"
    generate.write_csv(edges, path)
    records, counts = sources.read_records(spark, path, mapping.Mapping(header=False))
    assert tuple(counts.first()) == (400, 0)
    assert [tuple(r) for r in records.orderBy("seq").select("seq", "source", "target").collect()] == [(r["seq"], f"n{r['src']}", f"n{r['dst']}") for r in edges.orderBy("seq").collect()]


def test_repulsion_of_near_cells_is_that_of_all_pairs(spark):
    at = [(1000.0 + 32 * i + 3 * j, 2000.0 + 32 * j + 5 * i) for i in range(3) for j in range(3)]  # one node a cell, none more than two cells apart
    p = spark.createDataFrame([(i, *v) for i, v in enumerate(at)], "idx long, x float, y float")
    strength = layout.WORLD**2 / 9
    for r in layout.repulsion(p, 9).collect():
        x, y = at[r["idx"]]
        pairs = [(x - a, y - b, (x - a) ** 2 + (y - b) ** 2 + layout.SOFTEN) for j, (a, b) in enumerate(at) if j != r["idx"]]
        assert r["fx"] == pytest.approx(sum(strength * dx / d for dx, _, d in pairs), abs=1e-6) and r["fy"] == pytest.approx(sum(strength * dy / d for _, dy, d in pairs), abs=1e-6)
    empty = layout.repulsion(p.where("idx < 0"), 0)
    assert empty.isEmpty()


def test_store(spark):
    root = tempfile.mkdtemp()
    g = made(spark, [(1, 2), (2, 3), (1, 2)])
    id = store.graph_id("my graph.csv", 10, 20)
    assert id == "my_graph.csv-10-20" and store.export_stem("a.b.csv", 7) == "a.b-seed7" and store.sample_id(1, 2) == "sample-1x2"
    assert store.list_graphs(spark, root) == []
    store.write_graph(spark, g, root, "my graph.csv", id, skipped=1)
    os.makedirs(f"{root}/unfinished")
    assert [m["id"] for m in store.list_graphs(spark, root)] == [id]
    assert store.verify_graph(spark, f"{root}/{id}").where("not ok").isEmpty()
    p = layout.square_positions(g.nodes, 7)
    assert store.load_positions(spark, f"{root}/{id}", 7) is None
    store.save_positions(p, f"{root}/{id}", 7)
    assert store.load_positions(spark, f"{root}/{id}", 7).count() == 3
    store.save_attributes(spark, p, f"{root}/{id}", "p", "idx")
    assert store.manifest_of(spark, f"{root}/{id}")["attributes"] == {"name": "p", "key": "idx"}
    assert store.manifest_of(spark, f"{root}/{id}")["nodes"] == 3
    with open(f"{root}/source.csv", "w") as f:
        f.write("a,b\n")
    os.utime(f"{root}/source.csv", (1, 1))
    assert store.is_fresh(spark, f"{root}/{id}", f"{root}/source.csv") and not store.is_fresh(spark, f"{root}/unfinished", f"{root}/source.csv")
    os.utime(f"{root}/source.csv", (4e9, 4e9))
    assert not store.is_fresh(spark, f"{root}/{id}", f"{root}/source.csv")
    os.utime(f"{root}/source.csv", (1, 1))
    store.write_manifest(spark, f"{root}/{id}", store.manifest_of(spark, f"{root}/{id}") | {"version": 0})
    assert not store.is_fresh(spark, f"{root}/{id}", f"{root}/source.csv")
    store.export_positions(g, p, f"{root}/out")
    assert [r["id"] for r in spark.read.csv(f"{root}/out", header=True).collect()] == ["n1", "n2", "n3"]


def test_generators(spark):
    g = generate.scale_free(spark, 300, 1500).cache()
    assert g.count() == 1500 and g.where("src = dst or dst is null or src >= 300 or dst >= 300 or dst < 0").isEmpty()
    top = g.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").count().agg(F.max("count")).first()[0]
    assert top > 4 * 2 * 1500 / 300
    c = generate.planted(spark, 400, 2000, 10, 0.9)
    inside = c.where(F.floor(F.col("src") / 40) == F.floor(F.col("dst") / 40)).count()
    assert 0.85 * 2000 < inside and c.where("src = dst").isEmpty()
    a = generate.node_attributes(spark, 100)
    assert a.count() == 110 and a.where("id like 'ghost%'").count() == 10
    assert generate.csv_bytes(spark.createDataFrame([(0, 1), (10, 2)], "src long, dst long")).first()[0] == len("source,target\nn0,n1\nn10,n2\n")
    with pytest.raises(ValueError):
        generate.check_spec(10, 5)


def test_streaming(spark):
    base = tempfile.mkdtemp()
    schema = "seq long, source string, target string"
    total = []
    for k in range(2):
        rows = [(i, f"n{i % (3 + k)}", f"n{(i * 2 + 1) % 5}") for i in range(k * 10, k * 10 + 10)]
        total += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        q = ingest.stream_edges(spark, f"{base}/in", schema, f"{base}/out", f"{base}/checkpoint")
        q.awaitTermination(120)
    nodes = ingest.read(spark, f"{base}/out", "nodes", "idx long, id string, batch int")
    assert sorted(r["idx"] for r in nodes.collect()) == list(range(5))
    names = {r["idx"]: r["id"] for r in nodes.collect()}
    expected = {}
    for _, a, b in total:
        for x in (a, b):
            expected[x] = expected.get(x, 0) + 1
    assert {names[r["idx"]]: r["degree"] for r in ingest.degrees(spark, f"{base}/out").collect()} == expected
