"""Parts of the SQL that queries are compared with."""

from __future__ import annotations

from netloom.functions import styling


def _graph(records: str) -> str:
    return f"""WITH e0 AS ({records}),
ends AS (SELECT s AS id, 2 * seq AS pos FROM e0 UNION ALL SELECT d, 2 * seq + 1 FROM e0),
nodes AS (SELECT CAST(row_number() OVER (ORDER BY min(pos)) - 1 AS BIGINT) AS idx, id FROM ends GROUP BY id),
edges AS (SELECT e0.seq, a.idx AS src, b.idx AS dst, e0.w AS weight FROM e0 JOIN nodes a ON e0.s = a.id JOIN nodes b ON e0.d = b.id)
"""


SUPPLY = _graph("SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity) - 1 AS BIGINT) AS seq, 's' || l_suppkey AS s, 'p' || l_partkey AS d, CAST(l_quantity AS DOUBLE) AS w FROM lineitem")
GEO = _graph("SELECT CAST(row_number() OVER (ORDER BY s, d) - 1 AS BIGINT) AS seq, s, d, CAST(NULL AS DOUBLE) AS w FROM (SELECT 'n' || n_nationkey AS s, 'r' || n_regionkey AS d FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)")
SEQUELS = _graph("SELECT CAST(row_number() OVER (ORDER BY s, d) - 1 AS BIGINT) AS seq, s, d, CAST(NULL AS DOUBLE) AS w FROM (SELECT coalesce('o' || lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey), 'c' || o_custkey) AS s, 'o' || o_orderkey AS d FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)")
VISITS = _graph("SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS seq, 'u' || user_id AS s, event_type AS d, CAST(value AS DOUBLE) AS w FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL")
WEB = _graph("SELECT CAST(row_number() OVER (ORDER BY page_id, n) - 1 AS BIGINT) AS seq, url AS s, href AS d, CAST(NULL AS DOUBLE) AS w FROM (SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) AS n FROM (SELECT page_id, url, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages)) WHERE url IS NOT NULL")
_MORE = """, degrees AS (SELECT n.idx, n.id, coalesce(c.k, 0) AS degree FROM nodes n LEFT JOIN (SELECT idx, count(*) AS k FROM (SELECT src AS idx FROM edges UNION ALL SELECT dst FROM edges) GROUP BY idx) c ON n.idx = c.idx),
sym AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM edges WHERE src <> dst UNION ALL SELECT dst, src, weight FROM edges WHERE src <> dst) GROUP BY src, dst)
"""


def q(select: str, more: str = "") -> str:
    """A query over the supply graph: nodes, edges, degrees and sym."""
    return SUPPLY + _MORE + more + select


def attrs(select: str) -> str:
    return q(select, """, attrs AS (SELECT 'p' || p_partkey AS id, p_brand, p_type, p_size, p_retailprice FROM part),
joined AS (SELECT n.idx, n.degree, a.p_brand, a.p_type, a.p_size, a.p_retailprice FROM degrees n LEFT JOIN (SELECT * FROM attrs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY p_brand, p_type, p_size, p_retailprice) = 1) a ON n.id = a.id)
""")


def khop(base: str, seed: int, hops: int) -> str:
    """``reached`` (node, parent, hop), level by level."""
    out = base + f""", arcs AS (SELECT src AS f, dst AS t, src AS r, seq FROM edges WHERE src <> dst UNION ALL SELECT dst, src, src, seq FROM edges WHERE src <> dst),
h0 AS (SELECT idx AS node, CAST(NULL AS BIGINT) AS parent, 0 AS hop FROM nodes WHERE idx = {seed})"""
    for k in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(k))
        out += f""",
h{k} AS (SELECT t AS node, f AS parent, {k} AS hop FROM (SELECT a.t, a.f, row_number() OVER (PARTITION BY a.t ORDER BY a.r, a.seq) AS n FROM arcs a JOIN h{k - 1} p ON a.f = p.node WHERE a.t NOT IN (SELECT node FROM ({seen}))) WHERE n = 1)"""
    return out + ", reached AS (" + " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(hops + 1)) + ")\n"


def draws(counters: str, seed: int, name: str = "u") -> str:
    """A table ``name`` (k, u) of draws."""
    m = 1 << 32
    return f""", {name}1 AS (SELECT k, ({seed} + (k + 1) * 1831565813) % {m} AS a FROM ({counters})),
{name}2 AS (SELECT k, CAST((CAST(xor(a, a >> 15) AS HUGEINT) * (a | 1)) % {m} AS BIGINT) AS t FROM {name}1),
{name}3 AS (SELECT k, xor(CAST((t + (CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61)) % {m}) % {m} AS BIGINT), t) AS t FROM {name}2),
{name} AS (SELECT k, xor(t, t >> 14) / 4294967296.0::DOUBLE AS u FROM {name}3)
"""


def permuted(size: str, seed: int, rounds: int = 6) -> str:
    """``placed_at`` (n, place): where each of the numbers below ``size`` (a scalar query) stands in the keyed order."""
    out = f""", root AS (SELECT m, CAST(greatest(1, floor(sqrt(m))) AS BIGINT) AS s FROM (SELECT ({size}) AS m)),
ab AS (SELECT a, (m + a - 1) // a AS b, m FROM (SELECT m, unnest(range(s, 2 * s + 1)) AS a FROM root) ORDER BY ((m + a - 1) // a) * a - m, a LIMIT 1),
x0 AS (SELECT x, x // b AS l, x % b AS r FROM (SELECT unnest(range(a * b)) AS x, b FROM ab))
"""
    for i in range(rounds):
        out += draws("SELECT unnest(range(greatest(a, b))) AS k FROM ab", (seed + i * 0x9E3779B9) % (1 << 32), f"f{i}")
        own, other, side = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        out += f", x{i + 1} AS (SELECT x, {other}, CAST(({own} + floor(u * {side})) % {side} AS BIGINT) AS {own} FROM x{i} JOIN f{i} ON k = {other}, ab)\n"
    return out + f""", p AS (SELECT x, l * b + r AS y FROM x{rounds}, ab),
walk AS (SELECT x AS n, y FROM p, ab WHERE x < m UNION ALL SELECT w.n, p.y FROM walk w JOIN p ON p.x = w.y, ab WHERE w.y >= m),
placed_at AS (SELECT n, y AS place FROM walk, ab WHERE y < m)
"""


def swaps(size: str, k: int, seed: int) -> str:
    """``drawn`` (j, pick): the first ``k`` steps of a shuffle of the numbers below ``size``, with a map of the places that were swapped."""
    return draws(f"SELECT unnest(range({2 * k})) AS k", seed, "g") + f""", z AS (SELECT a.k // 2 AS j, a.k // 2 + CAST((CAST(a.u * 4294967296 AS HUGEINT) * 4294967296 + CAST(b.u * 4294967296 AS HUGEINT)) * (m - a.k // 2) // 18446744073709551616 AS BIGINT) AS spot FROM g a JOIN g b ON b.k = a.k + 1, (SELECT ({size}) AS m) WHERE a.k % 2 = 0),
drawn AS (SELECT j, spot AS pick, MAP([spot], [j]) AS moved FROM z WHERE j = 0
    UNION ALL SELECT z.j, coalesce(map_extract(d.moved, z.spot)[1], z.spot), map_concat(d.moved, MAP([z.spot], [coalesce(map_extract(d.moved, z.j)[1], z.j)])) FROM drawn d JOIN z ON z.j = d.j + 1)
"""


def recursive(query: str) -> str:
    return query.replace("WITH ", "WITH RECURSIVE ", 1)


POSITIONS = draws("SELECT 2 * idx AS k FROM nodes UNION ALL SELECT 2 * idx + 1 FROM nodes", 42) + """, pos AS (SELECT n.idx, CAST(a.u * 4096 AS FLOAT) AS x, CAST(b.u * 4096 AS FLOAT) AS y FROM nodes n JOIN u a ON a.k = 2 * n.idx JOIN u b ON b.k = 2 * n.idx + 1)
"""
GRID = """, grid AS (SELECT axis, x0, y0, greatest(x1 - x0, y1 - y0, 1e-6) / axis AS side FROM (SELECT greatest(1, least(1024, CAST(floor(sqrt(count(*) / 2)) AS BIGINT))) AS axis, CAST(min(x) AS DOUBLE) AS x0, CAST(min(y) AS DOUBLE) AS y0, CAST(max(x) AS DOUBLE) AS x1, CAST(max(y) AS DOUBLE) AS y1 FROM pos)),
placed AS (SELECT idx, x, y, cx, cy, cy * axis + cx AS cell FROM (SELECT idx, x, y, axis, CAST(least(greatest(floor((x - x0) / side), 0), axis - 1) AS BIGINT) AS cx, CAST(least(greatest(floor((y - y0) / side), 0), axis - 1) AS BIGINT) AS cy FROM pos, grid))
"""
SPRINGS = """, rowlen AS (SELECT src AS idx, count(*) AS d FROM sym GROUP BY src),
scale AS (SELECT (SELECT count(*) FROM sym) / CAST(count(*) AS DOUBLE) * (4096 / sqrt(count(*))) AS k FROM nodes),
pull AS (SELECT s.src AS idx, sum((CAST(b.x AS DOUBLE) - a.x) * w) AS fx, sum((CAST(b.y AS DOUBLE) - a.y) * w) AS fy FROM (SELECT sym.src, sym.dst, scale.k * least(weight, 8) / sqrt((i.d + 1) * (j.d + 1)) AS w FROM sym, scale, rowlen i, rowlen j WHERE sym.src = i.idx AND sym.dst = j.idx) s JOIN pos a ON s.src = a.idx JOIN pos b ON s.dst = b.idx GROUP BY s.src)
"""
REPULSION = """, cellof AS (SELECT idx, CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py, CAST(least(greatest(floor(x / 32), 0), 127) AS BIGINT) AS fx, CAST(least(greatest(floor(y / 32), 0), 127) AS BIGINT) AS fy, CAST(least(greatest(floor(x / 256), 0), 15) AS BIGINT) AS gx, CAST(least(greatest(floor(y / 256), 0), 15) AS BIGINT) AS gy FROM pos),
fine AS (SELECT fx AS cx, fy AS cy, count(*) AS k, sum(round(px * 2048)) / 2048 AS sx, sum(round(py * 2048)) / 2048 AS sy FROM cellof GROUP BY 1, 2),
coarse AS (SELECT gx AS cx, gy AS cy, count(*) AS k, sum(round(px * 2048)) / 2048 AS sx, sum(round(py * 2048)) / 2048 AS sy FROM cellof GROUP BY 1, 2),
whole AS (SELECT sum(k) AS k, sum(sx) AS sx, sum(sy) AS sy FROM coarse),
strength AS (SELECT 4096.0 * 4096.0 / count(*) AS g FROM pos),
nearby AS (SELECT c.idx, c.px, c.py, f.cx // 8 AS gx, f.cy // 8 AS gy, CASE WHEN f.cx = c.fx AND f.cy = c.fy THEN f.k - 1 ELSE f.k END AS k, CASE WHEN f.cx = c.fx AND f.cy = c.fy THEN f.sx - c.px ELSE f.sx END AS sx, CASE WHEN f.cx = c.fx AND f.cy = c.fy THEN f.sy - c.py ELSE f.sy END AS sy FROM cellof c JOIN fine f ON f.cx BETWEEN c.fx - 2 AND c.fx + 2 AND f.cy BETWEEN c.fy - 2 AND c.fy + 2),
taken AS (SELECT idx, gx, gy, sum(k) AS k, sum(sx) AS sx, sum(sy) AS sy FROM nearby GROUP BY 1, 2, 3),
midway AS (SELECT c.idx, c.px, c.py, g.k AS bk, g.sx AS bx, g.sy AS by_, g.k - coalesce(t.k, 0) - own AS k, g.sx - coalesce(t.sx, 0) - own * c.px AS sx, g.sy - coalesce(t.sy, 0) - own * c.py AS sy FROM (SELECT *, fx // 8 AS hx, fy // 8 AS hy FROM cellof) c JOIN coarse g ON g.cx BETWEEN c.hx - 2 AND c.hx + 2 AND g.cy BETWEEN c.hy - 2 AND c.hy + 2 CROSS JOIN LATERAL (SELECT CASE WHEN g.cx = c.hx AND g.cy = c.hy THEN 1 ELSE 0 END AS own) LEFT JOIN taken t ON t.idx = c.idx AND t.gx = g.cx AND t.gy = g.cy),
far AS (SELECT m.idx, any_value(m.px) AS px, any_value(m.py) AS py, any_value(w.k) - sum(bk) AS k, any_value(w.sx) - sum(bx) AS sx, any_value(w.sy) - sum(by_) AS sy FROM midway m, whole w GROUP BY m.idx),
bodies AS (SELECT idx, px, py, k, sx, sy FROM nearby UNION ALL SELECT idx, px, py, k, sx, sy FROM midway UNION ALL SELECT idx, px, py, k, sx, sy FROM far),
push AS (SELECT idx, sum(CASE WHEN k > 0 THEN dx * g * k / (dx * dx + dy * dy + 0.01) ELSE 0 END) AS fx, sum(CASE WHEN k > 0 THEN dy * g * k / (dx * dx + dy * dy + 0.01) ELSE 0 END) AS fy FROM (SELECT idx, k, CASE WHEN k > 0 THEN px - sx / k END AS dx, CASE WHEN k > 0 THEN py - sy / k END AS dy, g FROM bodies, strength) GROUP BY idx)
"""


def ramp(t: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {styling.rgb(c)}" for i, c in enumerate(styling.SEQUENTIAL))
    return f"CASE WHEN {t} < 0 THEN {styling.rgb(styling.NEUTRAL)} ELSE CASE CAST(least(5, floor(least(greatest({t}, 0), 1) * 6)) AS BIGINT) {cases} END END"


def category(place: str) -> str:
    return f"CASE {place} " + " ".join(f"WHEN {i} THEN {styling.rgb(c)}" for i, c in enumerate(styling.CATEGORICAL, 1)) + f" ELSE {styling.rgb(styling.NEUTRAL)} END"


def size(t: str) -> str:
    return f"CAST(CASE WHEN {t} < 0 THEN 52 ELSE 1 + floor(least(greatest({t}, 0), 1) * 254 + 0.5) END AS BIGINT)"
