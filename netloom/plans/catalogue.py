"""Registered queries over the given tables and the SQL that each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import lod, styling
from netloom.functions.draws import with_draw
from netloom.operators import adjacency, coarsen, graph, layout, sampling, search, search_index, spatial, spatial_index
from netloom.operators.attributes import Attributes, OneOf, Range, Style, read_attributes, visible_edges
from netloom.plans import sql
from netloom.plans.lineage import cut, folder
from netloom.plans.sql import q
from netloom.sources import tables
from netloom.sources.clustered import write_clustered
from netloom.sources.edges import from_table, read_records, validity
from netloom.sources.mapping import Mapping

SEED = 42
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in names})


# --- ingest and the dictionary


@query(q("SELECT idx, id FROM nodes"))
def node_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return tables.supply_nodes(spark, d).select("idx", "id")


@query(q("SELECT seq, src, dst, weight FROM edges"))
def edge_list_indexed(spark: SparkSession, d: str) -> DataFrame:
    return tables.supply(spark, d).edges


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE user_id IS NULL OR event_type IS NULL) AS BIGINT) AS skipped, CAST(count(value) AS BIGINT) AS weighted FROM events")
def record_validity(spark: SparkSession, d: str) -> DataFrame:
    return validity(tables.table(spark, d, "events"), F.col("user_id"), F.col("event_type"), F.col("value"))


@query(sql.WEB + "SELECT idx, id FROM nodes")
def web_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return tables.web(spark, d).nodes


@query(sql.VISITS + "SELECT src, dst, count(*) AS n, round(sum(weight), 4) AS weight FROM edges GROUP BY src, dst")
def visit_weights(spark: SparkSession, d: str) -> DataFrame:
    return tables.visits(spark, d).edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(q("SELECT s.id, n.idx FROM (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'x' || s_suppkey FROM supplier) s LEFT JOIN nodes n ON s.id = n.id"))
def dictionary_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = tables.table(spark, d, "supplier")
    return graph.lookup(tables.supply(spark, d), keys.select(F.concat(F.lit("s"), "s_suppkey").alias("id")).union(keys.select(F.concat(F.lit("x"), "s_suppkey"))))


# --- degrees and neighbourhoods


@query(q("SELECT n.idx, n.id, coalesce(c.k, 0) AS degree FROM nodes n LEFT JOIN (SELECT src, count(*) AS k FROM edges GROUP BY src) c ON n.idx = c.src"))
def out_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_degree(tables.supply(spark, d))


@query(q("SELECT n.idx, n.id, n.degree FROM degrees n"))
def total_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.total_degree(tables.supply(spark, d))


@query(q("SELECT id, degree FROM degrees ORDER BY degree DESC, id LIMIT 12"))
def degree_top12(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees_by_id(tables.supply_rows(spark, d)).orderBy(F.desc("degree"), "id").limit(12)


@query(q("SELECT idx, k AS degree, CAST(coalesce(sum(k) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT n.idx, count(e.src) AS k FROM nodes n LEFT JOIN edges e ON n.idx = e.src GROUP BY n.idx)"))
def row_offsets(spark: SparkSession, d: str) -> DataFrame:
    return graph.offsets(tables.supply(spark, d))


@query(q("SELECT seq, dst FROM edges WHERE src = 0"))
def adjacency_row(spark: SparkSession, d: str) -> DataFrame:
    return graph.row(tables.supply(spark, d), 0)


@query(q("SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY seq) AS neighbours FROM edges GROUP BY src"))
def adjacency_lists(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(tables.supply(spark, d)).select("src", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query(q("SELECT DISTINCT CASE WHEN src = 5 THEN dst ELSE src END AS idx FROM edges WHERE (src = 5 OR dst = 5) AND src <> dst"))
def neighbours_1hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(tables.supply(spark, d), 5)


@query(sql.khop(sql.SUPPLY, 0, 2) + "SELECT node, parent, CAST(hop AS BIGINT) AS hop FROM reached")
def khop_parents_2(spark: SparkSession, d: str) -> DataFrame:
    return _long(graph.khop(tables.supply(spark, d), 0, 2), "hop")


@query(sql.khop(sql.GEO, 3, 4) + "SELECT node, parent, CAST(hop AS BIGINT) AS hop FROM reached")
def khop_parents_4(spark: SparkSession, d: str) -> DataFrame:
    return _long(graph.khop(tables.geography(spark, d), 3, 4), "hop")


@query(sql.khop(sql.GEO, 3, 3) + "SELECT CAST(count(*) AS BIGINT) AS total, CAST(least(count(*), 100) AS BIGINT) AS listed FROM reached WHERE hop > 0")
def khop_total_and_cap(spark: SparkSession, d: str) -> DataFrame:
    return _long(graph.listed(graph.khop(tables.geography(spark, d), 3, 3), 100), "total", "listed")


@query(sql.khop(sql.SUPPLY, 0, 1) + "SELECT seq, src, dst FROM edges WHERE src IN (SELECT node FROM reached) AND dst IN (SELECT node FROM reached)")
def isolate_edges(spark: SparkSession, d: str) -> DataFrame:
    g = tables.supply(spark, d)
    return graph.induced(g, graph.khop(g, 0, 1).select(F.col("node").alias("idx"))).select("seq", "src", "dst")


@query(q("SELECT src, seq // 4096 AS page, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY seq) AS neighbours FROM edges GROUP BY 1, 2"))
def adjacency_pages(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency_pages(tables.supply(spark, d), 4096).select("src", "page", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query(q("SELECT DISTINCT CASE WHEN src = 0 THEN dst ELSE src END AS idx FROM edges WHERE (src = 0 OR dst = 0) AND src <> dst ORDER BY idx LIMIT 100"))
def neighbours_capped(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbour_list(tables.supply_links(spark, d), 0, 100)


@query(q("SELECT e.seq, e.src, e.dst FROM edges e JOIN degrees a ON e.src = a.idx JOIN degrees b ON e.dst = b.idx WHERE a.degree >= 28 AND b.degree >= 28"))
def edges_visible(spark: SparkSession, d: str) -> DataFrame:
    g = tables.supply(spark, d)
    styled = Attributes(graph.total_degree(g)).styled(Style(filters=[Range("degree", 28, 1e18)]))
    return visible_edges(g.edges, styled).select("seq", "src", "dst")


@query(q("SELECT 0 AS level, count(*) AS arcs, bit_xor(h) AS hash FROM (SELECT CAST('0x' || substr(md5(src || ',' || dst || ',' || CAST(floor(weight * 1048576) AS BIGINT)), 1, 15) AS BIGINT) AS h FROM sym) UNION ALL SELECT 1, count(*), bit_xor(CAST('0x' || substr(md5(src || ',' || dst || ',' || CAST(floor(weight * 1048576) AS BIGINT)), 1, 15) AS BIGINT)) FROM (SELECT src % 50 AS src, dst % 50 AS dst, sum(weight) AS weight FROM sym WHERE src % 50 <> dst % 50 GROUP BY 1, 2)"))
def level_checksum(spark: SparkSession, d: str) -> DataFrame:
    g = tables.supply_links(spark, d)
    sym = graph.symmetrize(g.edges)
    coarse = coarsen.contract(sym, g.nodes.select(F.col("idx").alias("node"), (F.col("idx") % 50).alias("coarse")))
    one, two = (coarsen.checksum(s).withColumn("level", F.lit(i)) for i, s in enumerate((sym, coarse)))
    return one.union(two)


# --- the same over an adjacency on disk


@query(ORACLES["adjacency_row"])
def stored_row(spark: SparkSession, d: str) -> DataFrame:
    return adjacency.stored(tables.supply(spark, d)).row(0)


@query(ORACLES["neighbours_1hop"])
def stored_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return adjacency.stored(tables.supply(spark, d)).neighbours(5)


@query(ORACLES["neighbours_capped"])
def stored_neighbours_capped(spark: SparkSession, d: str) -> DataFrame:
    return adjacency.stored(tables.supply(spark, d)).neighbour_list(0, 100)


@query(ORACLES["khop_parents_2"])
def stored_khop_2(spark: SparkSession, d: str) -> DataFrame:
    return _long(adjacency.stored(tables.supply(spark, d)).khop(0, 2), "hop")


@query(ORACLES["khop_parents_4"])
def stored_khop_4(spark: SparkSession, d: str) -> DataFrame:
    return _long(adjacency.stored(tables.geography(spark, d)).khop(3, 4), "hop")


@query(sql.recursive(sql.SEQUELS) + """, arcs AS (SELECT src AS f, dst AS t FROM edges UNION ALL SELECT dst, src FROM edges),
reached AS (SELECT idx AS node, CAST(NULL AS BIGINT) AS parent, CAST(0 AS BIGINT) AS hop FROM nodes WHERE id = 'n3' UNION ALL SELECT a.t, r.node, r.hop + 1 FROM reached r JOIN arcs a ON a.f = r.node WHERE a.t <> coalesce(r.parent, -1))
SELECT node, parent, hop FROM reached""")
def khop_to_the_end(spark: SparkSession, d: str) -> DataFrame:
    """All that a nation's customers' orders lead to, however many hops away."""
    g = tables.sequels(spark, d)
    seed = g.nodes.where("id = 'n3'").select("idx").first()
    return _long(adjacency.stored(g).khop(seed[0] if seed else -1), "hop")


@query(ORACLES["isolate_edges"])
def stored_isolate_edges(spark: SparkSession, d: str) -> DataFrame:
    a = adjacency.stored(tables.supply(spark, d))
    return a.induced(a.khop(0, 1).select(F.col("node").alias("idx")))


# --- symmetric graphs, labels, contraction


@query(q("SELECT src, dst, weight FROM sym"))
def symmetrize(spark: SparkSession, d: str) -> DataFrame:
    return graph.symmetrize(tables.supply_links(spark, d).edges)


@query(q("SELECT CAST(count(*) AS BIGINT) AS arcs, CAST(sum(n) AS BIGINT) AS ends FROM (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM edges WHERE src <> dst UNION ALL SELECT dst, src FROM edges WHERE src <> dst) GROUP BY src, dst)"))
def symmetrize_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return graph.symmetrize(tables.supply_links(spark, d).edges, weighted=False).agg(F.count(F.lit(1)).alias("arcs"), F.sum("weight").cast("long").alias("ends"))


@query(q("SELECT node, label, weight FROM (SELECT src AS node, dst AS label, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM sym) WHERE r = 1"))
def lpa_one_round(spark: SparkSession, d: str) -> DataFrame:
    g = tables.supply_links(spark, d)
    labels = g.nodes.select(F.col("idx").alias("node"), F.col("idx").alias("label"))
    return coarsen.strongest(coarsen.votes(graph.symmetrize(g.edges), labels))


@query(q("SELECT n.idx AS node, c.coarse FROM nodes n JOIN (SELECT label, row_number() OVER (ORDER BY min(idx)) - 1 AS coarse FROM (SELECT idx, idx * 7919 % 101 AS label FROM nodes) GROUP BY label) c ON n.idx * 7919 % 101 = c.label"))
def compact_labels(spark: SparkSession, d: str) -> DataFrame:
    return coarsen.compact(tables.supply_nodes(spark, d).select(F.col("idx").alias("node"), (F.col("idx") * 7919 % 101).alias("label")))


@query(q("SELECT a.src % 50 AS src, a.dst % 50 AS dst, sum(a.weight) AS weight FROM sym a WHERE a.src % 50 <> a.dst % 50 GROUP BY 1, 2"))
def contract_clusters(spark: SparkSession, d: str) -> DataFrame:
    g = tables.supply_links(spark, d)
    return coarsen.contract(graph.symmetrize(g.edges), g.nodes.select(F.col("idx").alias("node"), (F.col("idx") % 50).alias("coarse")))


@query()
def hierarchy_levels(spark: SparkSession, d: str) -> DataFrame:
    g = tables.geography(spark, d)
    levels = coarsen.build_hierarchy(g.edges, g.nodes, target=200)
    parts = [x["sym"].agg(F.lit(i).alias("level"), F.lit(x["n"]).alias("nodes"), F.count(F.lit(1)).alias("arcs")) for i, x in enumerate(levels)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT unnest(['one parent', 'cap', 'dense', 'shrinks', 'weights', 'ends', 'several levels']) AS \"check\", true AS ok")
def hierarchy_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Of the hierarchy of a forest above the target, built in the order of colours, whether all holds that must."""
    g = tables.geography(spark, d)
    return coarsen.invariants(coarsen.build_hierarchy(g.edges, g.nodes, target=50, in_order=True), target=50)


@query(sql.GEO + "SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS bare, CAST(0 AS BIGINT) AS clashes FROM nodes")
def proper_colours(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, those without a colour, and arcs whose ends have the same one."""
    g = tables.geography(spark, d)
    sym = cut(graph.symmetrize(g.edges))
    found = coarsen.colours(sym, g.nodes)
    a, b = (found.select(F.col("node").alias(c), F.col("colour").alias(f"of_{c}")) for c in ("src", "dst"))
    same = sym.join(a, "src").join(b, "dst").agg(F.count_if(F.col("of_src") == F.col("of_dst")).alias("clashes"))
    return found.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("colour").isNull()).alias("bare")).join(same, F.lit(True))


# --- attributes


def _attributes(spark: SparkSession, d: str) -> Attributes:
    return Attributes(tables.supply_nodes(spark, d)).attach(tables.part_attributes(spark, d), "id", ["p_brand", "p_type", "p_size", "p_retailprice"])


@query(sql.attrs("SELECT idx, degree, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM joined"))
def attr_left_join(spark: SparkSession, d: str) -> DataFrame:
    return _long(_attributes(spark, d).joined, "p_size")


@query(sql.attrs("SELECT (SELECT count(*) FROM attrs) AS n_rows, (SELECT count(*) FROM nodes WHERE id IN (SELECT id FROM attrs)) AS matched, (SELECT count(*) FROM attrs a WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = a.id)) AS unmatched, (SELECT count(*) - count(DISTINCT id) FROM attrs) AS duplicates"))
def attr_join_report(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).report().withColumnRenamed("rows", "n_rows")


@query(sql.attrs("SELECT 'degree' AS \"column\", CAST(min(degree) AS DOUBLE) AS low, CAST(max(degree) AS DOUBLE) AS high, count(*) FILTER (WHERE degree IS NULL) AS nulls FROM joined UNION ALL SELECT 'p_size', min(p_size), max(p_size), count(*) FILTER (WHERE p_size IS NULL) FROM joined UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice), count(*) FILTER (WHERE p_retailprice IS NULL) FROM joined"))
def attr_profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).profile_numeric()


@query(sql.attrs("SELECT 'p_brand' AS \"column\", count(DISTINCT p_brand) AS \"distinct\", count(*) FILTER (WHERE p_brand IS NULL) AS nulls FROM joined UNION ALL SELECT 'p_type', count(DISTINCT p_type), count(*) FILTER (WHERE p_type IS NULL) FROM joined"))
def attr_profile_categorical(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).profile_categorical()


@query(sql.attrs("SELECT p_type AS value, count(*) AS n FROM joined WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 12"))
def attr_top_values(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).top_values("p_type")


@query(sql.attrs("SELECT b.bin, coalesce(h.n, 0) AS n FROM (SELECT range AS bin FROM range(24)) b LEFT JOIN (SELECT CAST(least(23, floor((p_retailprice - lo) / ((hi - lo) / 24))) AS BIGINT) AS bin, count(*) AS n FROM joined, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM joined) WHERE p_retailprice IS NOT NULL GROUP BY 1) h ON b.bin = h.bin"))
def attr_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).histogram("p_retailprice")


@query(sql.attrs("SELECT idx FROM joined WHERE CAST(p_size AS DOUBLE) BETWEEN 10 AND 20"))
def filter_range(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).matching([Range("p_size", 10, 20)])


@query(sql.attrs("SELECT idx FROM joined WHERE p_brand IN ('Brand#11', 'Brand#23')"))
def filter_in(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).matching([OneOf("p_brand", ("Brand#11", "Brand#23"))])


@query(sql.attrs("SELECT idx FROM joined WHERE degree BETWEEN 20 AND 35 AND p_size BETWEEN 1 AND 25"))
def filter_and(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).matching([Range("degree", 20, 35), Range("p_size", 1, 25)])


@query(sql.attrs("SELECT idx FROM joined WHERE false"))
def filter_empty_in(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).matching([OneOf("p_brand", ())])


@query(sql.attrs("SELECT idx FROM joined"))
def filter_nan_noop(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).matching([Range("p_size", float("nan"), 20)])


@query(sql.attrs("SELECT degree, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM joined WHERE idx = 1"))
def node_card(spark: SparkSession, d: str) -> DataFrame:
    return _long(_attributes(spark, d).card(1), "p_size")


@query(sql.attrs(f"SELECT idx, t AS c, CAST(-1.0 AS DOUBLE) AS s, CAST({sql.ramp('t')} | (52 << 24) AS BIGINT) AS style, true AS visible FROM (SELECT idx, coalesce((p_retailprice - lo) / (hi - lo), -1.0) AS t FROM joined, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM joined))"))
def style_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).styled(Style(colour="p_retailprice"))


@query(sql.attrs(f"SELECT idx, CAST(place AS DOUBLE) AS c, s, {sql.category('place')} | ({sql.size('s')} << 24) AS style, true AS visible FROM (SELECT idx, coalesce(list_position((SELECT list(p_type ORDER BY n DESC, p_type) FROM (SELECT p_type, count(*) AS n FROM joined WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, p_type LIMIT 3)), p_type), 0) AS place, (degree - lo) / (hi - lo) AS s FROM joined, (SELECT CAST(min(degree) AS DOUBLE) AS lo, CAST(max(degree) AS DOUBLE) AS hi FROM joined))"))
def style_categorical(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).styled(Style(colour="p_type", size="degree"))


@query(sql.attrs(f"SELECT idx, CAST(-1.0 AS DOUBLE) AS c, CAST(-1.0 AS DOUBLE) AS s, CAST({styling.rgb(styling.NEUTRAL)} | (CASE WHEN p_size BETWEEN 10 AND 20 THEN 52 ELSE 0 END << 24) AS BIGINT) AS style, coalesce(p_size BETWEEN 10 AND 20, false) AS visible FROM joined"))
def style_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).styled(Style(filters=[Range("p_size", 10, 20)]))


@query(sql.attrs(f"SELECT idx, CAST(CASE WHEN idx % 3 = 0 THEN style ELSE style & 16777215 END AS BIGINT) AS style FROM (SELECT idx, {styling.rgb(styling.NEUTRAL)} | (52 << 24) AS style FROM joined)"))
def style_masked(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).styled(Style()).select("idx", styling.masked(F.col("style"), F.col("idx") % 3 == 0).alias("style"))


@query(sql.attrs("SELECT CASE WHEN r <= 3 THEN r ELSE 0 END AS slot, CASE WHEN min(r) <= 3 THEN min(p_type) ELSE 'other (' || count(*) || ' more values)' END AS value, CASE CASE WHEN r <= 3 THEN r ELSE 0 END WHEN 1 THEN '#3987e5' WHEN 2 THEN '#d95926' WHEN 3 THEN '#199e70' ELSE '#6b6b78' END AS hex, CAST(sum(n) AS BIGINT) AS n FROM (SELECT p_type, n, row_number() OVER (ORDER BY n DESC, p_type) AS r FROM (SELECT p_type, count(*) AS n FROM joined WHERE p_type IS NOT NULL GROUP BY 1)) GROUP BY 1, 3"))
def legend(spark: SparkSession, d: str) -> DataFrame:
    return _long(_attributes(spark, d).legend("p_type"), "slot")


@query(sql.attrs("SELECT idx FROM joined WHERE p_size BETWEEN 1 AND 25 INTERSECT SELECT CASE WHEN src = 0 THEN dst ELSE src END FROM edges WHERE src = 0 OR dst = 0"))
def isolate_and_filter(spark: SparkSession, d: str) -> DataFrame:
    a = _attributes(spark, d)
    return a.matching([Range("p_size", 1, 25)]).join(graph.neighbours(tables.supply_links(spark, d), 0), "idx", "left_semi")


@query(sql.attrs("SELECT 'p_size' AS \"column\", CAST(min(p_size) AS DOUBLE) AS low, CAST(max(p_size) AS DOUBLE) AS high, count(*) FILTER (WHERE p_size IS NULL) AS nulls FROM joined UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice), count(*) FILTER (WHERE p_retailprice IS NULL) FROM joined"))
def attr_csv_profile(spark: SparkSession, d: str) -> DataFrame:
    """Attributes written as CSV and read back with inferred types."""
    path = folder(spark, "attributes")
    tables.part_attributes(spark, d).write.csv(path, header=True, quote='"', escape='"')
    read = read_attributes(spark, path)
    return Attributes(tables.supply_nodes(spark, d)).attach(read, "id", ["p_brand", "p_type", "p_size", "p_retailprice"]).profile_numeric().where(F.col("column") != "degree")


# --- search


def _search(text: str, limit: int) -> str:
    return q(f"""SELECT idx, id, prefix, (SELECT count(*) FROM hits WHERE idx <= (SELECT s FROM stop)) > {limit} OR (SELECT s FROM stop) < (SELECT max(idx) FROM nodes) AS truncated
        FROM hits WHERE idx <= (SELECT s FROM stop) ORDER BY prefix DESC, idx LIMIT {limit}""", f""",
        hits AS (SELECT idx, id, starts_with(lower(id), lower('{text}')) AS prefix FROM nodes WHERE contains(lower(id), lower('{text}'))),
        stop AS (SELECT coalesce(min(idx), (SELECT max(idx) FROM nodes)) AS s FROM (SELECT idx FROM (SELECT idx, row_number() OVER (PARTITION BY prefix ORDER BY idx) AS r FROM hits) WHERE r = {limit}))""")


@query(_search("S1", 50))
def search_prefix(spark: SparkSession, d: str) -> DataFrame:
    return search.search_nodes(tables.supply_nodes(spark, d), "S1", 50)


@query(_search("77", 50))
def search_infix(spark: SparkSession, d: str) -> DataFrame:
    return search.search_nodes(tables.supply_nodes(spark, d), "77", 50)


@query(_search("p1", 20))
def search_truncated(spark: SparkSession, d: str) -> DataFrame:
    return search.search_nodes(tables.supply_nodes(spark, d), "p1", 20)


def _indexed(spark: SparkSession, d: str) -> search_index.SearchIndex:
    return search_index.indexed(tables.supply_nodes(spark, d))


@query(_search("S1", 50))
def stored_search_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d).search("S1", 50)


@query(_search("77", 50))
def stored_search_infix(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d).search("77", 50)


@query(_search("p1", 20))
def stored_search_truncated(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d).search("p1", 20)


@query(_search("P112", 50))
def stored_search_longer(spark: SparkSession, d: str) -> DataFrame:
    """More characters than a gram has."""
    return _indexed(spark, d).search("P112", 50)


# --- draws and positions


@query(q("SELECT k AS idx, u FROM u", sql.draws("SELECT idx AS k FROM nodes", SEED)))
def mulberry_draws(spark: SparkSession, d: str) -> DataFrame:
    return with_draw(tables.supply_nodes(spark, d).select("idx"), SEED, F.col("idx"), "u")


@query(q("SELECT idx, x, y FROM pos", sql.POSITIONS))
def square_positions(spark: SparkSession, d: str) -> DataFrame:
    return layout.square_positions(tables.supply_nodes(spark, d), SEED)


@query(q("SELECT idx, round(CAST(CAST(2048 + cos(a.u * 2 * pi()) * sqrt(b.u) * 1024 AS FLOAT) AS DOUBLE), 3) AS x, round(CAST(CAST(2048 + sin(a.u * 2 * pi()) * sqrt(b.u) * 1024 AS FLOAT) AS DOUBLE), 3) AS y FROM nodes n JOIN u a ON a.k = 2 * n.idx JOIN u b ON b.k = 2 * n.idx + 1", sql.draws("SELECT 2 * idx AS k FROM nodes UNION ALL SELECT 2 * idx + 1 FROM nodes", SEED)))
def disc_positions(spark: SparkSession, d: str) -> DataFrame:
    placed = layout.disc_positions(tables.supply_nodes(spark, d), SEED)
    return placed.select("idx", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in ("x", "y")))


@query(q(f"SELECT n.idx, CAST(p.x + (a.u - 0.5) * {2048 / 10.0} AS FLOAT) AS x, CAST(p.y + (b.u - 0.5) * {2048 / 10.0} AS FLOAT) AS y FROM nodes n JOIN pos p ON p.idx = n.idx % 100 JOIN w a ON a.k = 2 * n.idx JOIN w b ON b.k = 2 * n.idx + 1", sql.POSITIONS + sql.draws("SELECT 2 * idx AS k FROM nodes UNION ALL SELECT 2 * idx + 1 FROM nodes", SEED ^ (layout.GOLDEN % (1 << 32)), "w")))
def prolongate(spark: SparkSession, d: str) -> DataFrame:
    g = tables.supply_links(spark, d)
    return layout.prolongate(g.nodes.select(F.col("idx").alias("node"), (F.col("idx") % 100).alias("coarse")), layout.square_positions(g.nodes, SEED), 100, 1, SEED)


# --- space


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Positions, written, as the grid and the search both read them."""
    return cut(layout.square_positions(tables.supply_nodes(spark, d), SEED))


@query(q("SELECT cell, count(*) AS n FROM placed GROUP BY cell", sql.POSITIONS + sql.GRID))
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    p = _placed(spark, d)
    return spatial.counted(spatial.build_grid(p), p)


@query(q("SELECT count(*) AS n FROM placed, grid WHERE cx BETWEEN greatest(0, floor((1000 - x0) / side)) AND floor((2000 - x0) / side) AND cy BETWEEN greatest(0, floor((500 - y0) / side)) AND floor((1800 - y0) / side)", sql.POSITIONS + sql.GRID))
def visible_count(spark: SparkSession, d: str) -> DataFrame:
    p = _placed(spark, d)
    return spatial.visible_count(spatial.build_grid(p), p, 1000, 500, 2000, 1800)


@query(q("SELECT idx FROM pos WHERE x BETWEEN 1000 AND 2000 AND y BETWEEN 500 AND 1800", sql.POSITIONS))
def nodes_in_rect(spark: SparkSession, d: str) -> DataFrame:
    p = _placed(spark, d)
    return spatial.nodes_in_rect(spatial.build_grid(p), p, 1000, 500, 2000, 1800)


@query(q("SELECT idx FROM placed WHERE x BETWEEN 1000 AND 2000 AND y BETWEEN 500 AND 1800 ORDER BY cell, idx LIMIT 40", sql.POSITIONS + sql.GRID))
def nodes_in_rect_capped(spark: SparkSession, d: str) -> DataFrame:
    p = _placed(spark, d)
    return spatial.nodes_in_rect(spatial.build_grid(p), p, 1000, 500, 2000, 1800, cap=40)


@query(q("SELECT a.idx AS a, b.idx AS b, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 3) AS d2 FROM p a JOIN p b ON a.idx < b.idx AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 3600", sql.POSITIONS + ", p AS (SELECT idx, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM pos)"))
def pairs_within(spark: SparkSession, d: str) -> DataFrame:
    return spatial.pairs_within(_placed(spark, d), 60.0).select("a", "b", F.round("d2", 3).alias("d2"))


@query(q("SELECT idx, d2 FROM (SELECT idx, (CAST(x AS DOUBLE) - 2000) * (CAST(x AS DOUBLE) - 2000) + (CAST(y AS DOUBLE) - 2100) * (CAST(y AS DOUBLE) - 2100) AS d2 FROM pos) WHERE d2 < 300 * 300 ORDER BY d2, idx LIMIT 1", sql.POSITIONS))
def pick_nearest(spark: SparkSession, d: str) -> DataFrame:
    p = _placed(spark, d)
    return spatial.pick(spatial.build_grid(p), p, 2000, 2100, 300)


@query(ORACLES["nodes_in_rect"])
def stored_rect(spark: SparkSession, d: str) -> DataFrame:
    return spatial_index.indexed(_placed(spark, d)).nodes_in_rect(1000, 500, 2000, 1800)


@query(ORACLES["nodes_in_rect_capped"])
def stored_rect_capped(spark: SparkSession, d: str) -> DataFrame:
    return spatial_index.indexed(_placed(spark, d)).nodes_in_rect(1000, 500, 2000, 1800, cap=40)


@query(ORACLES["visible_count"])
def stored_visible_count(spark: SparkSession, d: str) -> DataFrame:
    return spatial_index.indexed(_placed(spark, d)).visible_count(1000, 500, 2000, 1800)


@query(ORACLES["pick_nearest"])
def stored_pick(spark: SparkSession, d: str) -> DataFrame:
    return spatial_index.indexed(_placed(spark, d)).pick(2000, 2100, 300)


# --- forces


@query(q("SELECT idx, round(fx, 3) AS fx, round(fy, 3) AS fy FROM pull", sql.POSITIONS + sql.SPRINGS))
def force_springs(spark: SparkSession, d: str) -> DataFrame:
    g = tables.supply_links(spark, d)
    pull = layout.springs(graph.symmetrize(g.edges), layout.square_positions(g.nodes, SEED), g.nodes.count())
    return pull.select("idx", F.round("fx", 3).alias("fx"), F.round("fy", 3).alias("fy"))


@query(q("SELECT idx, round(fx, 2) AS fx, round(fy, 2) AS fy FROM push", sql.POSITIONS + sql.REPULSION))
def force_repulsion(spark: SparkSession, d: str) -> DataFrame:
    g = tables.supply_links(spark, d)
    push = layout.repulsion(layout.square_positions(g.nodes, SEED), g.nodes.count())
    return push.select("idx", F.round("fx", 2).alias("fx"), F.round("fy", 2).alias("fy"))


@query(q("SELECT idx, round(CAST(CAST(greatest(0, least(4096, x + tx * m)) AS FLOAT) AS DOUBLE), 2) AS x, round(CAST(CAST(greatest(0, least(4096, y + ty * m)) AS FLOAT) AS DOUBLE), 2) AS y FROM (SELECT *, CASE WHEN sqrt(tx * tx + ty * ty) > 1e-9 THEN least(sqrt(tx * tx + ty * ty), 50.0) / sqrt(tx * tx + ty * ty) ELSE 0 END AS m FROM (SELECT p.idx, CAST(p.x AS DOUBLE) AS x, CAST(p.y AS DOUBLE) AS y, coalesce(a.fx, 0) + b.fx + 0.03 * (2048 - p.x) AS tx, coalesce(a.fy, 0) + b.fy + 0.03 * (2048 - p.y) AS ty FROM pos p LEFT JOIN pull a ON p.idx = a.idx JOIN push b ON p.idx = b.idx))", sql.POSITIONS + sql.SPRINGS + sql.REPULSION))
def force_step(spark: SparkSession, d: str) -> DataFrame:
    g = tables.supply_links(spark, d)
    moved = layout.force_step(graph.symmetrize(g.edges), layout.square_positions(g.nodes, SEED), g.nodes.count(), 50.0)
    return moved.select("idx", F.round(F.col("x").cast("double"), 2).alias("x"), F.round(F.col("y").cast("double"), 2).alias("y"))


@query(q("SELECT count(*) AS n, CAST(0 AS BIGINT) AS bad, CAST(min(x) AS DOUBLE) AS min_x, CAST(max(x) AS DOUBLE) AS max_x, round(avg(CAST(x AS DOUBLE)), 6) AS avg_x, CAST(min(y) AS DOUBLE) AS min_y, CAST(max(y) AS DOUBLE) AS max_y, round(avg(CAST(y AS DOUBLE)), 6) AS avg_y, greatest(max(x) - min(x), max(y) - min(y)) < 1 AS collapsed FROM pos", sql.POSITIONS))
def layout_health(spark: SparkSession, d: str) -> DataFrame:
    return layout.health(_placed(spark, d)).withColumns({c: F.round(c, 6) for c in ("avg_x", "avg_y")})


@query(q("SELECT round(a.intra, 6) AS intra, round(b.inter, 6) AS inter, round(b.inter / a.intra, 6) AS ratio FROM (SELECT avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS intra FROM pl JOIN c USING (community)) a, (SELECT avg(sqrt((p.mx - r.mx) ** 2 + (p.my - r.my) ** 2)) AS inter FROM c p JOIN c r ON p.community < r.community) b", sql.POSITIONS + ", pl AS (SELECT idx % 40 AS community, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM pos), c AS (SELECT community, avg(x) AS mx, avg(y) AS my FROM pl GROUP BY community)"))
def separation(spark: SparkSession, d: str) -> DataFrame:
    p = _placed(spark, d)
    return layout.separation(p, p.select("idx", (F.col("idx") % 40).alias("community"))).select(*(F.round(c, 6).alias(c) for c in ("intra", "inter", "ratio")))


@query(q("SELECT count(*) AS n, true AS bounded, true AS close FROM pos", sql.POSITIONS))
def separation_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mean distance of all nodes, each a group of its own, lies between the bounds that need no pairs, and these within 2 % of it."""
    p = _placed(spark, d)
    found = layout.separation(p, p.select("idx", F.col("idx").alias("community")), most_groups=100)
    exact = layout.separation(p, p.select("idx", F.col("idx").alias("community"))).select(F.col("inter").alias("exact"))
    inside = F.col("exact").between(F.col("inter_low") - 1e-9, F.col("inter_high") + 1e-9)
    return found.join(exact, F.lit(True)).select(F.lit(p.count()).alias("n"), inside.alias("bounded"), (F.abs(F.col("inter") / F.col("exact") - 1) < 0.02).alias("close"))


@query(q("SELECT count(*) AS n, bit_xor(CAST('0x' || substr(md5(idx || ',' || CAST(floor(CAST(x AS DOUBLE) * 1048576) AS BIGINT) || ',' || CAST(floor(CAST(y AS DOUBLE) * 1048576) AS BIGINT)), 1, 15) AS BIGINT)) AS hash FROM pos", sql.POSITIONS))
def layout_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return layout.fingerprint(_placed(spark, d))


# --- levels of detail and samples


@query(q("SELECT idx, CASE WHEN n <= 0 THEN 0 ELSE CAST(least(greatest(ceil(1000000 * c / f), least(4096, n)), n) AS BIGINT) END AS nodes, CASE WHEN n <= 0 THEN 0 ELSE CAST(greatest(least(4096, m), least(least(m, 300000), ceil(300000 * c / f))) AS BIGINT) END AS edges FROM (SELECT idx, n, m, greatest(least(f, 1), 1.0 / greatest(n, 1)) AS f, CASE WHEN c > 0 THEN c ELSE 1 END AS c FROM (SELECT idx, CAST(idx * 1000 AS DOUBLE) AS n, CAST(degree * 5000 AS DOUBLE) AS m, degree / 40.0 AS f, (idx % 11) / 3.0 AS c FROM degrees))"))
def lod_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.supply_nodes(spark, d)
    found = lod.limits(F.col("idx") * 1000, F.col("degree") * 5000, F.col("degree") / 40.0, (F.col("idx") % 11) / 3.0)
    return rows.select("idx", found.alias("l")).select("idx", "l.nodes", "l.edges")


@query(q("SELECT idx, coalesce(round(CASE WHEN fit > 0 THEN least(1200, 4096 * zoom) * least(800, 4096 * zoom) / fit END, 9), 1) AS coverage FROM (SELECT idx, degree / 100.0 AS zoom, least(1200, 4096 * 0.2) * least(800, 4096 * 0.2) AS fit FROM degrees)"))
def screen_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.supply_nodes(spark, d)
    return rows.select("idx", F.round(lod.coverage(F.col("degree") / 100.0, F.lit(0.2), F.lit(4096.0), F.lit(4096.0), F.lit(1200), F.lit(800)), 9).alias("coverage"))


@query(q(f"SELECT seq, src, dst, weight FROM edges ORDER BY md5('{SEED}:' || seq), seq LIMIT 500"))
def edge_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_edges(tables.supply(spark, d).edges, 500, SEED)


def _edges_by_seq(spark: SparkSession, d: str):
    """Edges on disk by seq, and how many there are."""
    edges = cut(tables.supply(spark, d).edges.select("seq", "src", "dst"))
    m = edges.count()
    return write_clustered(edges, folder(spark, "edges"), "seq", max(m - 1, 0), m), m


@query(sql.recursive(q("SELECT seq, place FROM edges JOIN placed_at ON n = seq", sql.permuted("SELECT count(*) FROM edges", SEED))))
def edge_order(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(tables.supply(spark, d).edges.select("seq"))
    return sampling.ranked(edges, edges.count(), seed=SEED)


@query(sql.recursive(q("SELECT seq, src, dst, place FROM edges JOIN placed_at ON n = seq WHERE place < 500", sql.permuted("SELECT count(*) FROM edges", SEED))))
def edge_order_beginning(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_places(*_edges_by_seq(spark, d), 500, SEED)


@query(sql.recursive(q("SELECT idx, id, place FROM nodes JOIN placed_at ON n = idx", sql.permuted("SELECT count(*) FROM nodes", SEED + 1))))
def node_rank(spark: SparkSession, d: str) -> DataFrame:
    nodes = cut(tables.supply_nodes(spark, d).select("idx", "id"))
    return sampling.ranked(nodes, nodes.count(), "idx", SEED + 1)


@query(sql.recursive(q("SELECT j AS draw, seq, src, dst FROM edges JOIN drawn ON pick = seq", sql.swaps("SELECT count(*) FROM edges", 400, SEED))))
def edge_sample_stored(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_stored(*_edges_by_seq(spark, d), 400, SEED)


@query(q("SELECT CAST(14 + sum(4 + length(CAST(src AS VARCHAR)) + length(CAST(dst AS VARCHAR))) AS BIGINT) AS bytes FROM edges"))
def csv_size(spark: SparkSession, d: str) -> DataFrame:
    from netloom.sources.generate import csv_bytes

    return csv_bytes(tables.supply_links(spark, d).edges)


@query(q("SELECT seq, 'n' || src AS source, 'n' || dst AS target FROM edges"))
def csv_through_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Edges written as delimited files and read back as records, in the same order."""
    from netloom.sources.generate import write_csv

    path = folder(spark, "csv")
    write_csv(tables.supply(spark, d).edges, path)
    return read_records(spark, path, Mapping(header=False))[0].select("seq", "source", "target")


# --- generators of the size of the given graph, stored graphs


@query(
    q(
        "SELECT seq, src, CASE WHEN dst = src THEN (src + 1) % n ELSE dst END AS dst FROM ends_of",
        sql.draws("SELECT 3 * seq + unnest([0, 1, 2]) AS k FROM edges", 0x5EED)
        + """, sized AS (SELECT count(*) AS n, greatest(1, count(*) // 40) AS size FROM nodes),
homes AS (SELECT e.seq, n, size, CAST(floor(a.u * n) AS BIGINT) AS src, b.u AS v, c.u AS w FROM edges e JOIN u a ON a.k = 3 * e.seq JOIN u b ON b.k = 3 * e.seq + 1 JOIN u c ON c.k = 3 * e.seq + 2, sized),
widths AS (SELECT *, least(src // size, 39) AS home FROM homes),
ends_of AS (SELECT seq, n, src, CAST(CASE WHEN w < 0.92 THEN home * size + floor(v * CASE WHEN home = 39 THEN n - 39 * size ELSE size END) ELSE floor(v * n) END AS BIGINT) AS dst FROM widths)
""",
    )
)
def planted_edges(spark: SparkSession, d: str) -> DataFrame:
    """A graph of planted communities with as many nodes and edges as the given one."""
    from netloom.sources.generate import planted

    return planted(spark, tables.supply_nodes(spark, d).count(), tables.supply_rows(spark, d).count())


@query(
    q(
        """SELECT CASE WHEN i >= n THEN 'ghost' || (i - n) ELSE 'n' || i END AS id, CASE WHEN i >= n THEN 'c0' ELSE 'c' || least(i // size, 11) END AS community,
round(a.u, 4) AS score, CASE WHEN i >= n THEN 'hub' ELSE ['hub', 'bridge', 'leaf'][CAST(floor(b.u * 3) AS BIGINT) + 1] END AS kind FROM places JOIN u a ON a.k = 2 * i JOIN u b ON b.k = 2 * i + 1""",
        """, places AS (SELECT unnest(range((SELECT count(*) FROM nodes) + 10)) AS i, (SELECT count(*) FROM nodes) AS n, (SELECT greatest(1, count(*) // 12) FROM nodes) AS size)
"""
        + sql.draws("SELECT 2 * i + unnest([0, 1]) AS k FROM places", 0xA771B),
    )
)
def generated_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of as many nodes as the given graph has, and rows of no node."""
    from netloom.sources.generate import node_attributes

    return node_attributes(spark, tables.supply_nodes(spark, d).count())


@query(q("SELECT 'nodes' AS \"check\", count(*) AS expected, count(*) AS found, true AS ok FROM nodes UNION ALL SELECT 'edges', count(*), count(*), true FROM edges UNION ALL SELECT 'dangling', 0, 0, true"))
def stored_graph_checks(spark: SparkSession, d: str) -> DataFrame:
    """The graph written as a snapshot, and its tables checked against the manifest."""
    from netloom.sources import store

    root = folder(spark, "graphs")
    store.write_graph(spark, tables.supply(spark, d), root, "supply", "supply")
    return store.verify_graph(spark, f"{root}/supply")


@query(q("SELECT id, x, y FROM nodes JOIN pos USING (idx)", sql.POSITIONS))
def exported_positions(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates written as delimited text and read back as 32-bit numbers: the text is exact."""
    from netloom.sources import store

    graph, path = tables.supply_links(spark, d), folder(spark, "export")
    store.export_positions(graph, layout.square_positions(graph.nodes, SEED), path)
    return spark.read.csv(path, header=True, quote='"', escape='"', schema="id string, x float, y float")


@query(q("SELECT seq + 1 AS seq, 's' || l_suppkey AS source, 'p' || l_partkey AS target, CAST(l_quantity AS DOUBLE) AS weight FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity) - 1 AS seq FROM lineitem)"))
def csv_guessed(spark: SparkSession, d: str) -> DataFrame:
    """Records written under a header in another order and with another delimiter, and read by what the file's beginning says; row 0 is the header."""
    path = folder(spark, "guessed")
    edges = from_table(*tables.lines_of(spark, d))
    lines = edges.select("seq", F.concat_ws(";", "weight", "target", "source").alias("value")).union(spark.createDataFrame([(-1, "Value;to;From")], "seq long, value string"))
    lines.repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(path)
    return read_records(spark, path)[0].withColumn("weight", F.col("weight").cast("double"))
