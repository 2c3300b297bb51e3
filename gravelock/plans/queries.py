"""The registered queries: name -> (session, folder of the tables) -> result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelock.functions.text import exploit_label, sanitised
from gravelock.operators import clustering as c
from gravelock.operators import datasets
from gravelock.operators import dependency as dep
from gravelock.operators import embedding as emb
from gravelock.operators import layout, ranking
from gravelock.operators import state as st
from gravelock.plans import views as v
from gravelock.shared import shared_checkpoints
from gravelock.sources.graphs import ith

#: Iterations of the iterative scores, fixed so that SQL can do the same.
ROUNDS = 50


def csv(array: str) -> F.Column:
    return F.array_join(F.col(array).cast("array<string>"), ",")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def nodes(spark, d):
    return dep.nodes(v.v1(spark, d)).drop("graph_id")


def edges(spark, d):
    return dep.edges(v.v1(spark, d)).drop("graph_id")


def useful(spark, d):
    return dep.useful_exploits(v.v1(spark, d, goal=5)).select(F.explode("exploits").alias("x")).select("x.id_exploit", "x.granted")


def without(kept: DataFrame) -> DataFrame:
    both = F.concat(F.transform("facts", lambda i: F.struct(F.lit("proposition").alias("kind"), i.alias("id"))), F.transform("moves", lambda i: F.struct(F.lit("exploit").alias("kind"), i.alias("id"))))
    return kept.select("removed_exploit", F.explode(both).alias("n")).select("removed_exploit", "n.kind", "n.id")


def useless(spark, d):
    """The join form of the fixpoint, after two exploits are gone."""
    s = v.v1(spark, d).withColumn("exploits", F.filter("exploits", lambda x: ~x["id_exploit"].isin(3, 15)))
    n = dep.all_nodes(s).withColumn("is_initial", F.coalesce(F.col("id_proposition") == 0, F.lit(False)))
    need = s.select("graph_id", F.explode("exploits").alias("x")).select("graph_id", "x.id_exploit", F.size("x.required").alias("n_required"))
    need = n.join(need, ["graph_id", "id_exploit"]).select("graph_id", "node_id", "n_required")
    left, _ = dep.useless_removed(n, dep.all_edges(s), need)
    return left.select("kind", F.coalesce("id_proposition", "id_exploit").alias("id"))


def states(spark, d):
    found, _ = st.expand(v.v1(spark, d))
    return found.select(csv("state").alias("state"), "level", "is_goal")


def state_edges(spark, d):
    _, found = st.expand(v.v1(spark, d))
    return found.select(csv("src").alias("src"), csv("dst").alias("dst"), csv("ids_exploits").alias("ids_exploits"))


def edge_probability(spark, d):
    s = v.v1(spark, d)
    return rounded(st.edge_probabilities(st.expand(s)[1], s).select(csv("src").alias("src"), csv("dst").alias("dst"), "probability"))


def state_prune(spark, d):
    return st.kept_states(dep.scenarios(v.v1(spark, d))).select("removed_exploit", csv("state").alias("state"), "is_goal", "n_edges")


def rank(method: str, **how) -> Callable:
    def query(spark, d):
        return rounded(ranking.ranked(ranking.scored(v.v1(spark, d), method, **how)).select("removed_exploit", "score", "rank"))

    return query


def rank_many(spark, d):
    """Value iteration over a graph for each supplier, all scenarios in one job."""
    r = ranking.ranked(ranking.scored(v.v1n(spark, d), "value_iteration_dependency", tol=-1, max_iter=ROUNDS))
    return rounded(r.select("graph_id", "removed_exploit", "score", "rank"))


def ppce(spark, d):
    return rounded(ranking.disagreement(*v.two_rankings(spark, d), ["s_suppkey"], within=["s_nationkey"]))


def top_overlap(spark, d):
    return rounded(ranking.top_overlap(*v.two_rankings(spark, d), ["s_suppkey"], within=["s_nationkey"]))


def matrix_mean(spark, d):
    return rounded(ranking.mean_matrix(v.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", ["F", "O"]), 4)


def on_trade(measure) -> Callable:
    return lambda spark, d: rounded(measure(c.undirected(v.trade(spark, d)), v.regions(spark, d)))


def on_vectors(measure) -> Callable:
    return lambda spark, d: rounded(measure(v.vectors(spark, d)), 5)


def kmeans_sweep(spark, d):
    k, score, found = c.sweep(v.vectors(spark, d), 2, 15, "ch")
    return found.groupBy("label").agg(F.count("*").alias("n")).withColumns({"k": F.lit(k), "score": F.lit(score)})


def spectral(method: str) -> Callable:
    return lambda spark, d: c.spectral(v.trade(spark, d).withColumn("graph_id", F.lit("trade")), method)


def similarity(of) -> Callable:
    return lambda spark, d: rounded(of(v.trade(spark, d)).select("i", "j", "value"))


def katz(spark, d):
    return rounded(emb.katz(dep.edges(v.v1(spark, d))), 9)


def ppr(spark, d):
    s = v.v1(spark, d)
    return rounded(emb.personal_page_rank(dep.edges(s), dep.nodes(s).select(F.col("node_id").alias("node"))), 9)


def hope(spark, d):
    s = v.v1(spark, d)
    return emb.hope(emb.katz(dep.edges(s)), dep.nodes(s).select(F.col("node_id").alias("node")))


def deep_walk(spark, d):
    return emb.deep_walk(c.undirected(v.trade(spark, d)), v.regions(spark, d))


def sage(spark, d):
    return emb.graph_sage(v.trade(spark, d).withColumn("graph_id", F.lit("trade")))


def layers_state(spark, d):
    found, _ = st.expand(v.v1(spark, d))
    return layout.state_layers(found).select(csv("state").alias("state"), "layer")


def layers_dependency(spark, d):
    s = v.v1(spark, d)
    return layout.dependency_layers(dep.nodes(s), dep.edges(s)).drop("graph_id")


def reposition(spark, d):
    return layout.repositioned(v.placed(spark, d)).select("node_id", "layer", "cluster", "y")


def zones(spark, d):
    return layout.zones(v.placed(spark, d)).select(F.col("cluster"), F.col("zone"), "layer")


def zone_points(spark, d):
    p = layout.zone_points(v.placed(spark, d).withColumns({"x": F.col("x") * 2.5, "y": F.col("y") * 1.5}))
    return p.select("cluster", "zone", F.posexplode("points").alias("nth", "p")).select("cluster", "zone", "nth", "p.x", "p.y")


def axes(spark, d):
    return layout.axis_distances(v.placed(spark, d)).drop("graph_id")


def buckets(spark, d):
    return datasets.size_classes(v.sizes(spark, d), order=("s_suppkey",)).select("s_suppkey", "n_nodes", "set")


def nth_size(spark, d):
    return ith(v.sizes(spark, d).select("s_suppkey", "n_nodes"), 7, "n_nodes", "s_suppkey")


def histogram(spark, d):
    s = v.sizes(spark, d).selectExpr("s_suppkey - 1 AS position", "concat('m', s_suppkey % 3) AS method", "CASE WHEN s_suppkey % 4 = 0 THEN double('NaN') ELSE s_acctbal END AS value")
    return rounded(datasets.histogram(s, "position", "value", "method"), 4)


def labels(spark, d):
    return v.table(spark, d, "documents").select("doc_id", exploit_label(F.col("doc_id"), F.col("text")).alias("label"))


def names(spark, d):
    return v.table(spark, d, "part").select("p_partkey", sanitised(F.col("p_name")).alias("name"))


def generator(spark, d):
    g = datasets.generated(spark, 20)
    return g.select("graph_id", "goal", F.size("propositions").alias("n_facts"), F.size("exploits").alias("n_exploits"))


def generated_sizes(spark, d):
    """Random graphs, expanded, in size classes."""
    n = st.kept_states(datasets.generated(spark, 12, most=18).withColumn("removed_exploit", F.lit(None).cast("int")))
    return datasets.size_classes(n.groupBy("graph_id").agg(F.count("*").cast("int").alias("n_nodes")))


Query = Callable[[SparkSession, str], DataFrame]
FIXED = {"tol": -1, "max_iter": ROUNDS}

_QUERIES: dict[str, Query] = {
    "dep_nodes": nodes, "dep_edges": edges, "useful_exploits": useful, "useless_nodes_removed": useless,
    "prune_leave_one_out": lambda s, d: without(dep.kept(dep.scenarios(v.v1(s, d)))),
    "node_probability": lambda s, d: rounded(dep.node_probabilities(v.v1(s, d)).drop("graph_id")),
    "branch_nodes": lambda s, d: dep.branch_nodes(v.v1(s, d)).drop("graph_id"),
    "state_nodes": states, "state_edges": state_edges, "edge_probability": edge_probability, "state_prune": state_prune,
    "rank_pagerank": rank("pagerank", **FIXED), "rank_kuehlmann_ref": rank("kuehlmann"), "rank_kuehlmann_fwd": rank("kuehlmann_forward"),
    "rank_value_iteration_state": rank("value_iteration_state", **FIXED), "rank_value_iteration_dep": rank("value_iteration_dependency", **FIXED),
    "rank_prob_path": rank("probabilistic_path"), "rank_homer": rank("homer"), "rank_exact": rank("exact"), "rank_random": rank("random"), "rank_many": rank_many,
    "ppce": ppce, "top_overlap": top_overlap, "matrix_mean_pivot": matrix_mean,
    "modularity": on_trade(c.modularity), "modularity_newman": on_trade(lambda b, a: c.modularity(b, a, "newman")),
    "conductance": on_trade(c.conductance), "coverage": on_trade(c.coverage), "graph_silhouette": on_trade(c.graph_silhouette),
    "silhouette_l2": on_vectors(c.silhouette), "calinski_harabasz": on_vectors(c.calinski_harabasz), "davies_bouldin": on_vectors(c.davies_bouldin),
    "kmeans_sweep": kmeans_sweep, "spectral1": spectral("sweep"), "spectral2": spectral("bisect"),
    "common_neighbours": similarity(emb.common_neighbours), "adamic_adar": similarity(emb.adamic_adar), "katz": katz, "ppr_similarity": ppr,
    "hope": hope, "deepwalk": deep_walk, "graphsage": sage,
    "layers_state": layers_state, "layers_dependency": layers_dependency, "reposition": reposition, "zones": zones, "zone_points": zone_points, "axis_distances": axes,
    "dataset_buckets": buckets, "dataset_ith": nth_size, "histogram_groups": histogram, "exploit_labels": labels, "sanitize": names,
    "generator": generator, "generated_sizes": generated_sizes,
}


def _ready(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shared_checkpoints(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _ready(q) for name, q in _QUERIES.items()}
