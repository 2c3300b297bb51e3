"""State graphs: sets of true facts, by breadth-first joins (one large graph) or a map over graphs (many small ones)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravelock.operators.dependency import useful_exploits
from gravelock.operators.kernels import Spec, bits, expanded, pruned_states

MAX_LEVELS = 200


def start(specs: DataFrame) -> Column:
    return F.array_sort(F.transform(F.filter("propositions", lambda p: p["initial"]), lambda p: p["id_proposition"]))


def is_goal(state: Column) -> Column:
    return F.array_contains(state, F.col("goal"))


def expand(specs: DataFrame, max_levels: int = MAX_LEVELS) -> tuple[DataFrame, DataFrame]:
    """(graph_id, state, level, is_goal) and (graph_id, src, dst, ids_exploits) of all states, by levels of set size.

    A state's size fixes its level, so only states of one level can coincide, and no table of all seen
    states is joined. Each level is checkpointed: one job a level, lineage of one step.
    """
    s = useful_exploits(specs).select("graph_id", "goal", start(specs).alias("state"), "exploits")
    moves = s.select("graph_id", "goal", F.explode("exploits").alias("x")).select("graph_id", "goal", "x.id_exploit", "x.granted", "x.required")
    level = s.select("graph_id", "state", is_goal(F.col("state")).alias("is_goal")).checkpoint()
    states, edges = level.withColumn("level", F.lit(0)), None
    for k in range(1, max_levels + 1):
        able = (F.size(F.array_except("required", "state")) == 0) & ~F.array_contains("state", F.col("granted"))
        e = level.where("NOT is_goal").join(moves, "graph_id").where(able)
        e = e.select("graph_id", "goal", F.col("state").alias("src"), F.array_sort(F.array_union("state", F.array("granted"))).alias("dst"), "id_exploit")
        e = e.groupBy("graph_id", "goal", "src", "dst").agg(F.array_sort(F.collect_list("id_exploit")).alias("ids_exploits")).checkpoint()
        level = e.select("graph_id", F.col("dst").alias("state"), is_goal(F.col("dst")).alias("is_goal")).distinct()
        if not e.take(1):
            return states, edges if edges is not None else e.drop("goal")
        states = states.unionByName(level.withColumn("level", F.lit(k)))
        edges = e.drop("goal") if edges is None else edges.unionByName(e.drop("goal"))
    raise RuntimeError(f"more than {max_levels} levels")


def numbered_states(states: DataFrame) -> DataFrame:
    """states with node_id: the start is 0."""
    return states.withColumn("node_id", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.size("state"), "state")) - 1)


def edge_probabilities(edges: DataFrame, specs: DataFrame) -> DataFrame:
    """edges with probability: the largest of the edge's exploits."""
    x = specs.select("graph_id", F.explode("exploits").alias("x")).select("graph_id", F.col("x.id_exploit").alias("id"), F.col("x.cvss").alias("cvss"))
    e = edges.select("graph_id", "src", "dst", F.explode("ids_exploits").alias("id")).join(x, ["graph_id", "id"])
    return e.groupBy("graph_id", "src", "dst").agg((F.max("cvss") / 10).alias("probability"))


STATES = "graph_id string, removed_exploit int, node_id int, state array<int>, is_goal boolean, n_edges int"


def kept_states(runs: DataFrame, max_states: int = 1_000_000) -> DataFrame:
    """STATES for rows of dependency.scenarios(): states left without an exploit, and the edges that leave each."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in found:
            out = []
            for r in f.itertuples():
                s = Spec.of(r.goal, r.propositions, r.exploits)
                removed = None if pd.isna(r.removed_exploit) else int(r.removed_exploit)
                left = pruned_states(expanded(s, max_states), removed)
                if left:
                    leaving = pd.Series([a for a, _ in left.edges], dtype="int").value_counts().to_dict()
                    out += [(r.graph_id, removed, i, sorted(s.propositions[b] for b in bits(m)), left.is_goal(i), leaving.get(i, 0)) for i, m in enumerate(left.masks)]
            yield pd.DataFrame(out, columns=["graph_id", "removed_exploit", "node_id", "state", "is_goal", "n_edges"]).astype({"removed_exploit": "Int32"})

    return runs.select("graph_id", "goal", "propositions", "exploits", "removed_exploit").mapInPandas(run, STATES)
