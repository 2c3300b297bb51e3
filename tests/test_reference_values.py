"""Known values of small graphs, the source formats, and properties of random graphs."""

import base64
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from gravelock.operators import clustering as c
from gravelock.operators import dependency as dep
from gravelock.operators import ranking
from gravelock.operators import state as st
from gravelock.operators.datasets import generated, random_spec, swept
from gravelock.operators.kernels import METHODS, Chain, Risk, Spec, exact_risk, expanded, path_probability, pruned_dependency, pruned_states, scores
from gravelock.plans.queries import shared_checkpoints
from gravelock.sources import graphs as g
from gravelock.streaming.rerank import rank_stream

#: A graph of five facts and six exploits: (id, granted, required, cvss); fact 0 is initial, fact 4 the goal.
MOVES = [(1, 1, [0], 7), (2, 2, [1], 3), (3, 3, [1], 4), (4, 4, [2], 2), (5, 4, [3], 1), (6, 2, [0], 9)]


def node_link() -> str:
    facts = [{"id": i, "id_proposition": i} for i in range(5)]
    moves = [{"id": 4 + x, "id_exploit": x} for x, *_ in MOVES]
    links = [{"source": r, "target": 4 + x} for x, _, need, _ in MOVES for r in need] + [{"source": 4 + x, "target": got} for x, got, *_ in MOVES]
    return json.dumps({
        "directed": True, "multigraph": False, "graph": {}, "nodes": facts + moves, "links": links,
        "propositions": {str(i): {"text": f"fact {i}", "initial": i == 0} for i in range(5)},
        "exploits": {str(x): {"text": f"move {x}", "granted_proposition": got, "required_propositions": need, "cve_id": None, "cvss": cvss} for x, got, need, cvss in MOVES},
        "goal_proposition": 4, "goal_nodes": [4], "type": "dependency",
    })


#: One exploit (2) from facts 3 and 4 to the goal 1, another (5) from 4 to 3; arcs run against the edges.
XML = """<attack_graph><arcs>
<arc><src>1</src><dst>2</dst></arc><arc><src>2</src><dst>3</dst></arc><arc><src>2</src><dst>4</dst></arc>
<arc><src>3</src><dst>5</dst></arc><arc><src>5</src><dst>4</dst></arc></arcs><vertices>
<vertex><id>1</id><fact>goal</fact><metric>0</metric><type>OR</type></vertex><vertex><id>2</id><fact>move</fact><metric>0</metric><type>AND</type></vertex>
<vertex><id>3</id><fact>middle</fact><metric>0</metric><type>OR</type></vertex><vertex><id>4</id><fact>start</fact><metric>1</metric><type>LEAF</type></vertex>
<vertex><id>5</id><fact>first</fact><metric>0</metric><type>AND</type></vertex><vertex><id>6</id><fact>x</fact><metric>0</metric><type>OTHER</type></vertex></vertices></attack_graph>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("graphs")
    (path / "small.json").write_text(node_link())
    (path / "other.xml").write_text(XML)
    return path


@pytest.fixture(scope="module")
def small(folder):
    return str(folder / "small.json")


#: PageRank, forward sums, value iteration (states, facts) and risk, by removed exploit (fixed values).
KNOWN = {
    None: (0.00162056, 0.22810935, 0.57209729, 0.46348614, 0.206992),
    1: (0.00107109, 0.235875, 0.5720521, 0.4633622, 0.18),
    2: (0.00162056, 0.22810935, 0.57209729, 0.46348941, 0.20296),
    3: (0.00138293, 0.21643125, 0.57209729, 0.46344414, 0.1842),
    4: (0.00153348, 0.17187858, 0.31972853, 0.23300616, 0.028),
    5: (0.00161351, 0.22665046, 0.57209729, 0.46344414, 0.1842),
    6: (0.00150123, 0.20138397, 0.40479778, 0.29510821, 0.06832),
}


def test_known_scores_and_ranks(spark, small):
    specs = g.load(spark, small)
    got = ranking.ranked(ranking.scored(specs, *METHODS)).collect()
    by = {(r.method, r.removed_exploit): r for r in got}
    for e, want in KNOWN.items():
        for m, v in zip(("pagerank", "kuehlmann_forward", "value_iteration_state", "value_iteration_dependency", "homer"), want, strict=True):
            assert abs(by[m, e].score - v) < 1e-7
        assert by["kuehlmann", e].score == 0 and abs(by["probabilistic_path", e].score - 1) < 1e-9
        assert abs(by["homer", e].score - by["exact", e].score) < 1e-12
    order = sorted(KNOWN, key=lambda e: by["homer", e].rank)
    assert order == [4, 6, 1, 3, 5, 2, None]
    assert {r.position for r in ranking.table(ranking.ranked(ranking.scored(specs, "homer"))).collect()} == set(range(7))
    m = {(r.method_a, r.method_b): r.value for r in ranking.matrix(ranking.ranked(ranking.scored(specs, "homer", "pagerank"))).collect()}
    assert m["homer", "homer"] == 0 and m["homer", "pagerank"] == m["pagerank", "homer"] and 0 <= m["homer", "pagerank"] <= 1
    with pytest.raises(ValueError):
        ranking.scored(specs, "no such method")


def test_kept_nodes_are_those_of_the_file(spark, small):
    kept = dep.kept(g.load(spark, small).withColumn("removed_exploit", F.lit(None).cast("int"))).first()
    on_disk = g.node_links(spark, small).first()
    assert sorted(kept.facts) == sorted(x.id_proposition for x in on_disk.nodes if x.id_proposition is not None)
    assert sorted(kept.moves) == sorted(x.id_exploit for x in on_disk.nodes if x.id_exploit is not None)
    n = g.summary(spark, small)
    assert n.columns == ["state_path", "dependency_path", "n_nodes", "set"]


def test_xml_and_uploads(spark, folder, small):
    row = g.load(spark, str(folder / "other.xml")).first()
    assert row.goal == 1 and [p.id_proposition for p in row.propositions] == [1, 3, 4] and [p.initial for p in row.propositions] == [False, False, True]
    assert [(x.id_exploit, x.granted, x.required, x.cvss) for x in row.exploits] == [(2, 1, [3, 4], None), (5, 3, [4], None)]
    spec = Spec.of(row.goal, row.propositions, row.exploits)
    states = expanded(spec)
    assert (len(states.masks), len(states.edges)) == (3, 2) and math.isnan(spec.exploits[0].p)
    assert g.load(spark, str(folder)).count() == 2
    up = spark.createDataFrame([("u", k, f"data:text/{k};base64," + base64.b64encode(x.encode()).decode()) for k, x in (("json", node_link()), ("xml", XML))], "graph_id string, extension string, contents string")
    assert {len(r.exploits) for r in g.uploaded(up).collect()} == {6, 2}
    with pytest.raises(Exception, match="no reader"):
        g.parse(spark.createDataFrame([("u", "txt", "")], "graph_id string, extension string, content string")).collect()


def test_round_trip_and_stream(spark, small, tmp_path):
    shared_checkpoints(spark)
    specs = g.load(spark, small)
    nodes, edges = dep.nodes(specs), dep.edges(specs)
    assert (nodes.count(), edges.count()) == (11, 12)
    out = g.to_node_link(specs, nodes, edges, "dependency")
    g.save(out, f"{tmp_path}/saved")
    back = g.parse(out.selectExpr("graph_id", "'json' AS extension", "value AS content")).first()
    assert back.exploits == specs.first().exploits and back.goal == specs.first().goal
    assert len(json.loads(out.first().value)["nodes"]) == 11
    states, moves = st.expand(specs)
    n = st.numbered_states(states)
    key = n.selectExpr("state", "node_id")
    e = moves.join(key.toDF("src", "s"), "src").join(key.toDF("dst", "d"), "dst").selectExpr("graph_id", "s AS src", "d AS dst", "ids_exploits")
    j = json.loads(g.to_node_link(specs, n.withColumnRenamed("state", "ids_propositions"), e, "state").first().value)
    assert len(j["nodes"]) == 10 and len(j["links"]) == 11 and len(j["goal_nodes"]) == 4
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(node_link())
    rank_stream(spark, f"{tmp_path}/in", f"{tmp_path}/ranks", f"{tmp_path}/state", "homer").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/ranks").count() == 7
    done = spark.createDataFrame([("one",)], "graph_id string")
    assert g.unfinished(specs.selectExpr("'one' AS graph_id").union(specs.selectExpr("'two'")), done, "graph_id").first().graph_id == "two"


def test_known_cluster_metrics(spark, small):
    shared_checkpoints(spark)
    link = g.node_links(spark, small).selectExpr("explode(links) AS l").selectExpr("l.source AS src", "l.target AS dst")
    both = c.undirected(link)
    label = {**dict.fromkeys((0, 1, 5, 10), 0), **dict.fromkeys((2, 4, 6, 8), 1), **dict.fromkeys((3, 7, 9), 2)}
    a = spark.createDataFrame(list(label.items()), "node int, cluster int")
    for measure, want in ((c.modularity, 0.0555556), (lambda b, x: c.modularity(b, x, "newman"), 0.3229167), (c.coverage, 0.2222222), (c.conductance, 0.3333333), (c.graph_silhouette, 0.4979798)):
        assert abs(measure(both, a).first()[0] - want) < 1e-6
    found = c.spectral(link.selectExpr("'g' AS graph_id", "src", "dst")).drop("graph_id").toDF("node", "cluster")
    assert c.modularity(both, found).first()[0] > 0.1
    assert [r.cluster for r in c.cluster_table(a).collect()] == [0, 1, 2]


def test_exploit_list_and_draws(spark, tmp_path):
    rows = [{"cve_id": f"c{i}", "text": "N/A" if i == 3 else f"t{i}", "cvss": 0.0 if i == 4 else 5.0} for i in range(8)]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    x = g.exploit_list(spark, str(tmp_path / "list.json"))
    assert x.count() == 6
    a, b = (sorted(map(tuple, g.drawn(x, 20, seed=3).collect())) for _ in range(2))
    assert len(a) == 20 and a == b


@given(s.integers(0, 10_000), s.integers(3, 11))
@settings(max_examples=40, deadline=None)
def test_properties_of_random_graphs(seed, n):
    d = random_spec(n, seed)
    spec = Spec.of(d["goal"], d["propositions"], d["exploits"])
    full = expanded(spec)
    assert len(set(full.masks)) == len(full.masks)
    for (a, b), xs in full.edges.items():
        assert full.masks[b].bit_count() == full.masks[a].bit_count() + 1 and xs
    props, exploits = pruned_dependency(spec)
    assert props >> spec.goal & 1
    chain = Chain(pruned_states(full, None))
    assert abs(path_probability(chain) - 1) < 1e-9
    best = exact_risk(spec, props, exploits)
    for x in spec.exploits:
        left = pruned_dependency(spec, x.id)
        states = pruned_states(full, x.id)
        assert (states is None) == (not left[0] >> spec.goal & 1)
        if states:
            assert exact_risk(spec, *left) <= best + 1e-12
            again = expanded(Spec(spec.goal, spec.propositions, spec.initial, [y for y in spec.exploits if y.id != x.id]))
            assert set(again.masks) <= set(states.masks)
    assert scores(spec, [None], ["random"], seed=1) == scores(spec, [None], ["random"], seed=1)


def test_generated_graphs_repeat_and_sweeps_survive(spark):
    a, b = (generated(spark, 5, seed=2).orderBy("graph_id").collect() for _ in range(2))
    assert a == b and {len(r.exploits) for r in a} == {15, 16, 17, 18, 19}
    r = swept([("x", 1), ("x", 0)], lambda m, p: 1 / p)
    assert r[0][2] == 1 and math.isnan(r[1][2])
    x = c.spectral_vectors(np.ones((5, 5)) - np.eye(5), 3)
    assert x.shape == (5, 2)
