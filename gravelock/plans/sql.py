"""The same queries in DuckDB SQL, written from their meaning: graphs are bit masks, loops recursive tables."""

from gravelock.plans.queries import ROUNDS

X = """
x AS (SELECT n_nationkey::INT AS id, (1 + n_nationkey // 2)::INT AS g,
      CASE WHEN n_nationkey % 2 = 0 THEN list_sort(list_distinct([(1 + n_nationkey // 2) // 2, (1 + n_nationkey // 2) // 3])) ELSE [n_nationkey // 2] END AS req,
      1 + (n_nationkey * 7 % 90)::DOUBLE / 10 AS cvss FROM nation WHERE n_nationkey < 16),
m AS (SELECT *, list_sum(list_transform(req, lambda r: 1::BIGINT << r))::BIGINT AS rm, 1::BIGINT << g AS gm, cvss / 10 AS p FROM x),
"""
#: s: the removed exploit, or -1.
SCEN = X + "scen AS (SELECT -1 AS s UNION ALL SELECT id FROM x),\n"
STATES = SCEN + """
reach AS (SELECT s, 1::BIGINT AS mask FROM scen
          UNION SELECT r.s, r.mask | m.gm FROM reach r JOIN m ON (r.mask & m.rm) = m.rm AND (r.mask & m.gm) = 0 AND m.id <> r.s WHERE (r.mask & 256) = 0),
moves AS (SELECT r.s, r.mask AS src, r.mask | m.gm AS dst, m.id, m.p FROM reach r JOIN m ON (r.mask & m.rm) = m.rm AND (r.mask & m.gm) = 0 AND m.id <> r.s WHERE (r.mask & 256) = 0),
ok AS (SELECT s, mask FROM reach WHERE (mask & 256) <> 0 UNION SELECT v.s, v.src FROM ok JOIN moves v ON v.s = ok.s AND v.dst = ok.mask),
e AS (SELECT v.s, src, dst, max(p) AS p, list_sort(list(v.id)) AS ids FROM moves v JOIN ok a ON a.s = v.s AND a.mask = src JOIN ok b ON b.s = v.s AND b.mask = dst GROUP BY v.s, src, dst),
tot AS (SELECT s, src, sum(p) AS t FROM e GROUP BY s, src),
"""
#: D: what can come true, N: of that, what the goal needs.
KEPT = SCEN + """
d AS (SELECT s, 0 AS i, 1::BIGINT AS mask FROM scen
      UNION ALL SELECT d.s, d.i + 1, d.mask | coalesce(bit_or(m.gm), 0) FROM d LEFT JOIN m ON (d.mask & m.rm) = m.rm AND m.id <> d.s WHERE d.i < 9 GROUP BY d.s, d.i, d.mask),
dd AS (SELECT s, mask AS dm FROM d WHERE i = 9),
n AS (SELECT s, 0 AS i, dm & 256 AS mask, dm FROM dd
      UNION ALL SELECT n.s, n.i + 1, n.mask | coalesce(bit_or(m.rm), 0), n.dm FROM n LEFT JOIN m ON (n.dm & m.rm) = m.rm AND m.id <> n.s AND (m.gm & n.mask) <> 0 WHERE n.i < 9 GROUP BY n.s, n.i, n.mask, n.dm),
nn AS (SELECT s, dm, mask FROM n WHERE i = 9),
kx AS (SELECT nn.s, m.* FROM nn JOIN m ON (nn.dm & m.rm) = m.rm AND m.id <> nn.s AND (m.gm & nn.mask) <> 0),
kf AS (SELECT nn.s, f.f FROM nn, range(0, 9) f(f) WHERE (nn.mask >> f.f) & 1 = 1),
"""


def shown(mask: str) -> str:
    return f"array_to_string(list_filter(range(0, 9), lambda b: ({mask} >> b) & 1 = 1), ',')"


def ranked(score: str, of: str) -> str:
    """score: SQL for (s, score)."""
    return f"""sc AS ({score})
SELECT CASE WHEN s >= 0 THEN s END::INT AS removed_exploit, round(score, 6) AS score, (row_number() OVER (ORDER BY round(score, 9), s) - 1)::INT AS rank FROM sc"""


def with_(ctes: str, rest: str) -> str:
    return f"WITH RECURSIVE {ctes}{rest}"


DEP_E = "de AS (SELECT unnest(req)::INT AS src, (9 + id)::INT AS dst FROM x UNION ALL SELECT (9 + id)::INT, g FROM x)"
TRADE = """
pairs AS (SELECT least(c_nationkey, s_nationkey) AS src, greatest(c_nationkey, s_nationkey) AS dst, count(*) AS n
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
          WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
t AS (SELECT src, dst FROM pairs WHERE n > (SELECT median(n) FROM pairs)),
"""
SUMS = TRADE + """
u AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t),
l AS (SELECT a.n_regionkey AS ls, b.n_regionkey AS ld FROM u JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst),
r AS (SELECT DISTINCT n_regionkey AS c FROM nation),
k AS (SELECT c, sum((ls = c AND ld = c)::INT) AS win, sum((ls = c AND ld <> c)::INT) AS cut, sum((ls = c)::INT) AS vol, sum((ls <> c AND ld <> c)::INT) AS beyond, count(*) AS al FROM r, l GROUP BY c)
"""
VEC = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS vec FROM embeddings), lv AS (SELECT id, label, unnest(vec) AS v, unnest(range(1, len(vec) + 1)) AS pos FROM v),\n"
PLACED = """
pl0 AS (SELECT n_nationkey AS node_id, n_nationkey % 5 AS layer, n_regionkey AS cluster FROM nation WHERE NOT (n_nationkey % 5 = 2 AND n_regionkey = 1)),
pl AS (SELECT *, layer::DOUBLE AS x, (row_number() OVER (PARTITION BY layer ORDER BY node_id) - 1) - (count(*) OVER (PARTITION BY layer) - 1)::DOUBLE / 2 AS y FROM pl0),
"""
ZONES = PLACED + """
z0 AS (SELECT DISTINCT cluster, layer FROM pl),
z1 AS (SELECT *, CASE WHEN layer - lag(layer) OVER (PARTITION BY cluster ORDER BY layer) > 1 THEN 1 ELSE 0 END AS new FROM z0),
z AS (SELECT cluster, layer, sum(new) OVER (PARTITION BY cluster ORDER BY layer)::BIGINT AS zone FROM z1)
"""
TWO = """
ra AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1 AS a,
       row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey * 7919 % 1009, s_suppkey) - 1 AS b FROM supplier)
"""
SIZES = "sz AS (SELECT s_suppkey, (s_suppkey * 37 % 20000)::INT AS n_nodes, s_acctbal FROM supplier)"
MASS = """w AS (SELECT e.s, e.src, e.dst, e.p / tot.t AS w FROM e JOIN tot USING (s, src)),
mass AS (SELECT s, 0 AS i, mask, 1::DOUBLE AS v FROM ok WHERE mask = 1
         UNION ALL SELECT w.s, mass.i + 1, w.dst, sum(mass.v * w.w) FROM mass JOIN w ON w.s = mass.s AND w.src = mass.mask GROUP BY w.s, mass.i, w.dst),
"""

SQL: dict[str, str] = {
    "dep_nodes": with_(X, "f AS (SELECT range::INT AS f FROM range(0, 9)) SELECT f AS node_id, 'proposition' AS kind, f AS id_proposition, NULL::INT AS id_exploit, f = 8 AS is_goal FROM f UNION ALL SELECT (9 + id)::INT, 'exploit', NULL, id, false FROM x"),
    "dep_edges": with_(X, f"{DEP_E} SELECT src, dst FROM de"),
    "useful_exploits": with_(X, "need AS (SELECT 5::BIGINT AS f UNION SELECT unnest(x.req) FROM need JOIN x ON x.g = need.f) SELECT id AS id_exploit, g AS granted FROM x WHERE g IN (SELECT f FROM need)"),
    "useless_nodes_removed": with_(KEPT.replace("scen AS (SELECT -1 AS s UNION ALL SELECT id FROM x)", "scen AS (SELECT 3 AS s)").replace("FROM nation WHERE n_nationkey < 16", "FROM nation WHERE n_nationkey < 16 AND n_nationkey <> 15"), "z AS (SELECT 1) SELECT 'proposition' AS kind, f::INT AS id FROM kf UNION ALL SELECT 'exploit', id FROM kx"),
    "prune_leave_one_out": with_(KEPT, "z AS (SELECT 1) SELECT CASE WHEN s >= 0 THEN s END::INT AS removed_exploit, 'proposition' AS kind, f::INT AS id FROM kf UNION ALL SELECT CASE WHEN s >= 0 THEN s END, 'exploit', id FROM kx"),
    "node_probability": with_(X, "z AS (SELECT 1) SELECT (9 + id)::INT AS node_id, round(cvss / 10, 6) AS probability FROM x"),
    "branch_nodes": with_(X, f"{DEP_E} SELECT src AS node_id, count(*) AS n_out FROM de WHERE src < 9 GROUP BY src HAVING count(*) > 1"),
    "state_nodes": with_(STATES, f"z AS (SELECT 1) SELECT {shown('mask')} AS state, (bit_count(mask) - 1)::INT AS level, (mask & 256) <> 0 AS is_goal FROM reach WHERE s = -1"),
    "state_edges": with_(STATES, f"z AS (SELECT 1) SELECT {shown('src')} AS src, {shown('dst')} AS dst, array_to_string(ids, ',') AS ids_exploits FROM e WHERE s = -1"),
    "edge_probability": with_(STATES, f"z AS (SELECT 1) SELECT {shown('src')} AS src, {shown('dst')} AS dst, round(p, 6) AS probability FROM e WHERE s = -1"),
    "state_prune": with_(STATES, f"z AS (SELECT s, src, count(*) AS n FROM e GROUP BY s, src) SELECT CASE WHEN ok.s >= 0 THEN ok.s END::INT AS removed_exploit, {shown('ok.mask')} AS state, (ok.mask & 256) <> 0 AS is_goal, coalesce(z.n, 0)::INT AS n_edges FROM ok LEFT JOIN z ON z.s = ok.s AND z.src = ok.mask"),
    "rank_pagerank": with_(
        STATES,
        f"""size AS (SELECT s, count(*) AS n FROM ok GROUP BY s),
w AS (SELECT e.s, e.src, e.dst, 0.85::DOUBLE * e.p / tot.t AS w FROM e JOIN tot USING (s, src) UNION ALL SELECT ok.s, ok.mask, 1, CASE WHEN tot.t IS NULL THEN 0.85 ELSE 0.15 END::DOUBLE FROM ok LEFT JOIN tot ON tot.s = ok.s AND tot.src = ok.mask),
pr AS (SELECT ok.s, 0 AS i, ok.mask, 1::DOUBLE / n AS r FROM ok JOIN size USING (s)
       UNION ALL SELECT w.s, pr.i + 1, w.dst, sum(pr.r * w.w) FROM pr JOIN w ON w.s = pr.s AND w.src = pr.mask WHERE pr.i < {ROUNDS} GROUP BY w.s, pr.i, w.dst),
"""
        + ranked(f"SELECT s, sum(r) AS score FROM pr WHERE i = {ROUNDS} AND (mask & 256) <> 0 GROUP BY s", "pr"),
    ),
    "rank_kuehlmann_ref": with_(STATES, ranked("SELECT DISTINCT s, 0::DOUBLE AS score FROM ok", "ok")),
    "rank_kuehlmann_fwd": with_(
        STATES,
        MASS
        + """hit AS (SELECT s, i, sum(CASE WHEN (mask & 256) <> 0 THEN v ELSE 0 END) AS g FROM mass GROUP BY s, i),
last AS (SELECT s, max(i) + 1 AS n FROM mass GROUP BY s),
"""
        + ranked("SELECT last.s, sum(pow(0.85::DOUBLE, k.k) * hit.g) * 0.15::DOUBLE / 0.85::DOUBLE AS score FROM last JOIN hit ON hit.s = last.s, range(1, 100) k(k) WHERE k.k <= last.n AND hit.i <= k.k GROUP BY last.s", "hit"),
    ),
    "rank_prob_path": with_(STATES, MASS + ranked("SELECT s, sum(v) AS score FROM mass WHERE (mask & 256) <> 0 GROUP BY s", "mass")),
    "rank_value_iteration_state": with_(
        STATES,
        f"""vi AS (SELECT s, 0 AS i, mask, 0::DOUBLE AS v FROM ok
       UNION ALL SELECT a.s, a.i + 1, a.mask, CASE WHEN max(e.p) IS NULL THEN 1::DOUBLE ELSE max(0.9::DOUBLE * (e.p * b.v + (1 - e.p) * a.v)) END
       FROM vi a LEFT JOIN e ON e.s = a.s AND e.src = a.mask LEFT JOIN vi b ON b.s = e.s AND b.mask = e.dst WHERE a.i < {ROUNDS} GROUP BY a.s, a.i, a.mask),
"""
        + ranked(f"SELECT s, v AS score FROM vi WHERE i = {ROUNDS} AND mask = 1", "vi"),
    ),
    "rank_value_iteration_dep": with_(
        KEPT,
        f"""nd AS (SELECT s, f::INT AS k FROM kf UNION ALL SELECT s, 100 + id FROM kx),
e AS (SELECT s, unnest(req)::INT AS src, (100 + id)::INT AS dst, 1::DOUBLE AS p FROM kx UNION ALL SELECT s, (100 + id)::INT, g, p FROM kx),
vi AS (SELECT s, 0 AS i, k, 0::DOUBLE AS v FROM nd
       UNION ALL SELECT a.s, a.i + 1, a.k, CASE WHEN max(e.p) IS NULL THEN 1::DOUBLE ELSE max(0.9::DOUBLE * (e.p * b.v + (1 - e.p) * a.v)) END
       FROM vi a LEFT JOIN e ON e.s = a.s AND e.src = a.k LEFT JOIN vi b ON b.s = e.s AND b.k = e.dst WHERE a.i < {ROUNDS} GROUP BY a.s, a.i, a.k),
"""
        + ranked(f"SELECT s, v AS score FROM vi WHERE i = {ROUNDS} AND k = 0", "vi"),
    ),
    "rank_exact": with_(
        SCEN,
        "o AS (SELECT range AS o, true AS f0 FROM range(0, 65536)),\n"
        + "".join(f"o{g} AS (SELECT *, ((o >> {2 * g - 2}) & 1 = 1 AND f{g // 2} AND f{g // 3}) OR ((o >> {2 * g - 1}) & 1 = 1 AND f{g - 1}) AS f{g} FROM {'o' if g == 1 else f'o{g - 1}'}),\n" for g in range(1, 9))
        + "c AS (SELECT o, product(CASE WHEN (o >> id) & 1 = 1 THEN p ELSE 1 - p END) AS w FROM o8, m WHERE f8 GROUP BY o),\n"
        + ranked("SELECT scen.s, sum(c.w / (1 - coalesce(m.p, 0))) AS score FROM scen LEFT JOIN m ON m.id = scen.s JOIN c ON scen.s < 0 OR (c.o >> greatest(scen.s, 0)) & 1 = 0 GROUP BY scen.s", "c"),
    ),
    "ppce": f"WITH {TWO} SELECT x.s_nationkey, round(avg(((x.a - y.a) * (x.b - y.b) < 0)::INT::DOUBLE), 6) AS ppce FROM ra x JOIN ra y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey GROUP BY x.s_nationkey",
    "top_overlap": f"WITH {TWO}, n AS (SELECT s_nationkey, ceil(count(*)::DOUBLE / 3) AS top FROM ra GROUP BY 1) SELECT s_nationkey, round(sum((a < top AND b < top)::INT) / max(top), 6) AS overlap FROM ra JOIN n USING (s_nationkey) GROUP BY s_nationkey",
    "matrix_mean_pivot": 'SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = \'F\'), 4) AS "F", round(avg(l_quantity) FILTER (l_linestatus = \'O\'), 4) AS "O" FROM lineitem GROUP BY l_returnflag',
    "modularity": f"WITH {SUMS} SELECT round(sum(win::DOUBLE / al - pow((al - beyond)::DOUBLE / al, 2)), 6) AS modularity FROM k",
    "modularity_newman": f"WITH {SUMS} SELECT round(sum(win::DOUBLE / al - pow(vol::DOUBLE / al, 2)), 6) AS modularity FROM k",
    "conductance": f"WITH {SUMS} SELECT round(avg(cut::DOUBLE / least(vol, al - vol)), 6) AS conductance FROM k",
    "coverage": f"WITH {SUMS} SELECT round(avg(win::DOUBLE / al), 6) AS coverage FROM k",
    "graph_silhouette": with_(
        TRADE,
        """u AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t),
h AS (SELECT n_nationkey AS a, n_nationkey AS b, 0 AS d FROM nation UNION SELECT h.a, u.dst, h.d + 1 FROM h JOIN u ON u.src = h.b WHERE h.d < 24),
dist AS (SELECT a, b, min(d) AS d FROM h GROUP BY a, b),
p AS (SELECT x.n_nationkey AS a, x.n_regionkey AS ca, y.n_regionkey AS cb, avg(coalesce(d, 0)) AS m FROM nation x, nation y LEFT JOIN dist ON dist.a = x.n_nationkey AND dist.b = y.n_nationkey GROUP BY 1, 2, 3),
q AS (SELECT a, max(m) FILTER (ca = cb) AS own, min(m) FILTER (ca <> cb) AS other FROM p GROUP BY a)
SELECT round(avg(CASE WHEN greatest(own, other) > 0 THEN (other - own) / greatest(own, other) ELSE 0 END), 6) AS silhouette FROM q""",
    ),
    "silhouette_l2": f"WITH {VEC} p AS (SELECT a.id, a.label AS la, b.label AS lb, avg(list_distance(a.vec, b.vec)) AS m FROM v a JOIN v b ON a.id <> b.id GROUP BY 1, 2, 3), q AS (SELECT id, max(m) FILTER (la = lb) AS own, min(m) FILTER (la <> lb) AS other FROM p GROUP BY id) SELECT round(avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END), 5) AS silhouette FROM q",
    "calinski_harabasz": f"WITH {VEC} c AS (SELECT label, pos, avg(v) AS c, count(*) AS n FROM lv GROUP BY 1, 2), g AS (SELECT pos, avg(v) AS m FROM lv GROUP BY 1), b AS (SELECT sum(n * pow(c - m, 2)) AS b FROM c JOIN g USING (pos)), w AS (SELECT sum(pow(v - c, 2)) AS w FROM lv JOIN c USING (label, pos)), k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM v) SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS calinski_harabasz FROM b, w, k",
    "davies_bouldin": f"WITH {VEC} c AS (SELECT label, pos, avg(v) AS c FROM lv GROUP BY 1, 2), d AS (SELECT id, label, sqrt(sum(pow(v - c, 2))) AS d FROM lv JOIN c USING (label, pos) GROUP BY 1, 2), s AS (SELECT label, avg(d) AS s FROM d GROUP BY 1), x AS (SELECT a.label AS i, b.label AS j, sqrt(sum(pow(a.c - b.c, 2))) AS d FROM c a JOIN c b ON a.pos = b.pos AND a.label <> b.label GROUP BY 1, 2), r AS (SELECT i, max((p.s + q.s) / d) AS r FROM x JOIN s p ON p.label = i JOIN s q ON q.label = j GROUP BY i) SELECT round(avg(r), 5) AS davies_bouldin FROM r",
    "common_neighbours": f"WITH {TRADE} z AS (SELECT 1) SELECT a.src AS i, b.dst AS j, count(*)::DOUBLE AS value FROM t a JOIN t b ON a.dst = b.src GROUP BY 1, 2",
    "adamic_adar": f"WITH {TRADE} g AS (SELECT k, count(*) AS d FROM (SELECT src AS k FROM t UNION ALL SELECT dst FROM t) GROUP BY k) SELECT a.src AS i, b.dst AS j, round(sum(1::DOUBLE / d), 6) AS value FROM t a JOIN t b ON a.dst = b.src JOIN g ON g.k = a.dst GROUP BY 1, 2",
    "katz": with_(X, f"{DEP_E}, k AS (SELECT src AS i, dst AS j, 0.1::DOUBLE AS v, 1 AS n FROM de UNION ALL SELECT k.i, de.dst, sum(k.v * 0.1::DOUBLE), k.n + 1 FROM k JOIN de ON de.src = k.j GROUP BY k.i, de.dst, k.n) SELECT i, j, round(sum(v), 9) AS value FROM k GROUP BY i, j"),
    "ppr_similarity": with_(X, f"{DEP_E}, o AS (SELECT dst, count(*) AS n FROM de GROUP BY dst), k AS (SELECT range::INT AS i, range::INT AS j, 0.5::DOUBLE AS v, 0 AS n FROM range(0, 25) UNION ALL SELECT k.i, de.dst, sum(k.v * 0.5::DOUBLE / o.n), k.n + 1 FROM k JOIN de ON de.src = k.j JOIN o ON o.dst = de.dst GROUP BY k.i, de.dst, k.n) SELECT i, j, round(sum(v), 9) AS value FROM k GROUP BY i, j"),
    "layers_state": with_(STATES, f"z AS (SELECT 1) SELECT {shown('mask')} AS state, (bit_count(mask) - 1)::INT AS layer FROM reach WHERE s = -1"),
    "layers_dependency": with_(X, f"{DEP_E}, k AS (SELECT 8 AS node, 0 AS far UNION SELECT de.src, k.far + 1 FROM k JOIN de ON de.dst = k.node), f AS (SELECT node, max(far) AS far FROM k GROUP BY node) SELECT node::INT AS node_id, ((SELECT max(far) FROM f) - far)::INT AS layer FROM f"),
    "reposition": f"WITH {PLACED} a AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY cluster, node_id) AS n FROM pl), b AS (SELECT layer, y, row_number() OVER (PARTITION BY layer ORDER BY y DESC, node_id) AS n FROM pl) SELECT a.node_id, a.layer, a.cluster, b.y FROM a JOIN b ON a.layer = b.layer AND a.n = b.n",
    "zones": f"WITH {ZONES} SELECT cluster, zone, layer FROM z",
    "zone_points": f"WITH {ZONES}, s AS (SELECT node_id, layer, cluster, x * 2.5::DOUBLE AS x, y * 1.5::DOUBLE AS y FROM pl), "
    "crowd AS (SELECT min(layer) AS l FROM (SELECT layer FROM s GROUP BY layer HAVING count(*) > 1)), one AS (SELECT y FROM s, crowd WHERE layer = l), "
    "ax AS (SELECT (SELECT min(x) FROM s WHERE x > (SELECT min(x) FROM s)) - (SELECT min(x) FROM s) AS h, (SELECT min(y - (SELECT min(y) FROM one)) FROM one WHERE y > (SELECT min(y) FROM one)) AS v), "
    "m AS (SELECT s.*, z.zone, min(s.layer) OVER zz AS first, max(s.layer) OVER zz AS last, row_number() OVER (PARTITION BY cluster, s.layer ORDER BY y) AS low, row_number() OVER (PARTITION BY cluster, s.layer ORDER BY y DESC) AS top FROM s JOIN z USING (cluster, layer) WINDOW zz AS (PARTITION BY cluster, z.zone)), "
    "p AS (SELECT cluster, zone, 0 AS side, -y AS k, x - 0.2::DOUBLE * h AS x, y FROM m, ax WHERE layer = first UNION ALL SELECT cluster, zone, 1, layer, x, y - 0.3::DOUBLE * v FROM m, ax WHERE low = 1 "
    "UNION ALL SELECT cluster, zone, 2, y, x + 0.2::DOUBLE * h, y FROM m, ax WHERE layer = last UNION ALL SELECT cluster, zone, 3, -layer, x, y + 0.3::DOUBLE * v FROM m, ax WHERE top = 1) "
    "SELECT cluster, zone, (row_number() OVER (PARTITION BY cluster, zone ORDER BY side, k) - 1)::INT AS nth, round(x, 6) AS x, round(y, 6) AS y FROM p",
    "axis_distances": f"WITH {PLACED} xs AS (SELECT DISTINCT x FROM pl ORDER BY x LIMIT 2), one AS (SELECT min(layer) AS l FROM (SELECT layer FROM pl GROUP BY layer HAVING count(*) > 1)), h AS (SELECT y FROM pl, one WHERE layer = l) SELECT max(x) - min(x) AS horizontal, (SELECT min(abs(y - (SELECT min(y) FROM h))) FROM h WHERE y <> (SELECT min(y) FROM h)) AS vertical FROM xs",
    "dataset_buckets": f"WITH {SIZES}, b AS (SELECT *, CASE WHEN n_nodes < 1000 THEN 0 WHEN n_nodes < 10000 THEN 1 ELSE 2 END AS set FROM sz), c AS (SELECT *, row_number() OVER (PARTITION BY set ORDER BY s_suppkey) AS n FROM b) SELECT s_suppkey, n_nodes, set FROM c WHERE n <= [40, 40, 20][set + 1]",
    "dataset_ith": f"WITH {SIZES} SELECT s_suppkey, n_nodes FROM sz ORDER BY n_nodes, s_suppkey LIMIT 1 OFFSET 7",
    "histogram_groups": "WITH h AS (SELECT 'm' || (s_suppkey % 3) AS method, CASE WHEN s_suppkey - 1 < 40 THEN 'Small' WHEN s_suppkey - 1 < 80 THEN 'Medium' ELSE 'Large' END AS \"group\", CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS value FROM supplier WHERE s_suppkey - 1 < 100) SELECT method, \"group\", round(coalesce(avg(value), 0), 4) AS mean FROM h GROUP BY method, \"group\"",
    "exploit_labels": "SELECT doc_id, doc_id || ': ' || array_to_string(list_slice(string_split(text, ' '), 1, 20), ' ') AS label FROM documents",
    "sanitize": "SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS name FROM part",
}
