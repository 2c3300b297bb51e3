"""Dependency graphs: facts and exploits as nodes. Native: arrays of one graph's exploits, joins between tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravelock.operators.kernels import Spec, bits, pruned_dependency


def all_nodes(specs: DataFrame) -> DataFrame:
    """graph_id, node_id, kind, id_proposition, id_exploit, is_goal: facts first, then exploits, numbered in their order."""
    facts = specs.select("graph_id", F.posexplode("propositions").alias("node_id", "p"), "goal")
    facts = facts.select("graph_id", "node_id", F.lit("proposition").alias("kind"), F.col("p.id_proposition"), F.lit(None).cast("int").alias("id_exploit"), (F.col("p.id_proposition") == F.col("goal")).alias("is_goal"))
    moves = specs.select("graph_id", F.size("propositions").alias("n"), F.posexplode("exploits").alias("i", "x"))
    return facts.union(moves.select("graph_id", F.col("n") + F.col("i"), F.lit("exploit"), F.lit(None).cast("int"), "x.id_exploit", F.lit(False)))


def all_edges(specs: DataFrame) -> DataFrame:
    """graph_id, src, dst (node ids of all_nodes): required fact -> exploit -> granted fact, each once."""
    at = lambda p: F.array_position(F.transform("propositions", lambda q: q["id_proposition"]), p).cast("int") - 1
    d = specs.select("graph_id", F.size("propositions").alias("n"), "propositions", F.posexplode("exploits").alias("i", "x"))
    d = d.select("graph_id", (F.col("n") + F.col("i")).alias("node"), at(F.col("x.granted")).alias("granted"), F.transform(F.array_distinct("x.required"), at).alias("required"))
    return d.select("graph_id", F.explode("required").alias("src"), F.col("node").alias("dst")).union(d.select("graph_id", "node", "granted"))


def useful_exploits(specs: DataFrame) -> DataFrame:
    """specs with the exploits only from which the goal can be reached backwards (as many rounds as exploits do)."""
    grow = lambda need: F.array_union(need, F.flatten(F.transform(F.filter("exploits", lambda x: F.array_contains(need, x["granted"])), lambda x: x["required"])))
    need = F.aggregate(F.sequence(F.lit(0), F.size("exploits")), F.array("goal"), lambda a, _: grow(a))
    d = specs.withColumn("_need", need)
    return d.withColumn("exploits", F.filter("exploits", lambda x: F.array_contains("_need", x["granted"]))).drop("_need")


def scenarios(specs: DataFrame) -> DataFrame:
    """specs with removed_exploit: null (nothing removed) and each exploit in turn."""
    ids = F.concat(F.array(F.lit(None).cast("int")), F.transform("exploits", lambda x: x["id_exploit"]))
    return specs.withColumn("removed_exploit", F.explode(ids))


KEPT = "graph_id string, removed_exploit int, facts array<int>, moves array<int>, goal_reachable boolean"


def kept(runs: DataFrame) -> DataFrame:
    """KEPT for rows of scenarios(): what is left of each graph when an exploit goes. A map without a shuffle."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in found:
            out = []
            for r in f.itertuples():
                removed = None if pd.isna(r.removed_exploit) else int(r.removed_exploit)
                s = Spec.of(r.goal, r.propositions, r.exploits)
                props, exploits = pruned_dependency(s, removed)
                out.append((r.graph_id, removed, [s.propositions[b] for b in bits(props)], [x.id for x in exploits], bool(props >> s.goal & 1)))
            g = pd.DataFrame(out, columns=["graph_id", "removed_exploit", "facts", "moves", "goal_reachable"])
            yield g.astype({"removed_exploit": "Int32"})

    return runs.select("graph_id", "goal", "propositions", "exploits", "removed_exploit").mapInPandas(run, KEPT)


def nodes(specs: DataFrame) -> DataFrame:
    """The nodes of the dependency graph: all_nodes without the useless ones."""
    k = kept(specs.withColumn("removed_exploit", F.lit(None).cast("int"))).select("graph_id", "facts", "moves")
    return all_nodes(specs).join(k, "graph_id").where(F.array_contains("facts", F.col("id_proposition")) | F.array_contains("moves", F.col("id_exploit"))).drop("facts", "moves")


def edges(specs: DataFrame) -> DataFrame:
    n = nodes(specs)
    e = all_edges(specs)
    for end in ("src", "dst"):
        e = e.join(n.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_semi")
    return e.select("graph_id", "src", "dst")


def useless_removed(nodes_: DataFrame, edges_: DataFrame, required: DataFrame, checkpoint: bool = True) -> tuple[DataFrame, DataFrame]:
    """The same fixpoint as joins, for graphs too large for one task, all keyed by graph_id.

    nodes_: graph_id, node_id, kind, is_goal, is_initial; required: graph_id, node_id, n_required.
    Each round drops, at once, facts without use or source and exploits that lost a fact; tables are
    checkpointed each round, and one count decides whether to go on.
    """
    n = nodes_.join(required, ["graph_id", "node_id"], "left")
    e = edges_
    while True:
        into = e.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("n_in"))
        out = e.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("n_out"))
        d = n.join(into, ["graph_id", "node_id"], "left").join(out, ["graph_id", "node_id"], "left").fillna(0, ["n_in", "n_out"])
        no_source = ~F.col("is_initial") & (F.col("n_in") == 0)
        fact = (~F.col("is_goal") & (F.col("n_out") == 0)) | no_source
        move = (F.col("n_out") == 0) | (F.col("n_in") != F.col("n_required"))
        d = d.withColumn("_drop", F.when(F.col("kind") == "proposition", fact).otherwise(move)).drop("n_in", "n_out")
        d = d.checkpoint() if checkpoint else d
        if not d.where("_drop").take(1):
            return d.drop("_drop", "n_required"), e
        n = d.where("NOT _drop").drop("_drop")
        for end in ("src", "dst"):
            e = e.join(n.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_semi")
        e = e.checkpoint() if checkpoint else e


def node_probabilities(specs: DataFrame) -> DataFrame:
    """graph_id, node_id, probability of exploit nodes."""
    x = specs.select("graph_id", F.explode("exploits").alias("x")).select("graph_id", "x.id_exploit", (F.col("x.cvss") / 10).alias("probability"))
    return nodes(specs).where("kind = 'exploit'").join(x, ["graph_id", "id_exploit"]).select("graph_id", "node_id", "probability")


def branch_nodes(specs: DataFrame) -> DataFrame:
    """graph_id, node_id, n_out of facts that more than one exploit needs."""
    out = edges(specs).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("n_out")).where("n_out > 1")
    return nodes(specs).where("kind = 'proposition'").join(out, ["graph_id", "node_id"]).select("graph_id", "node_id", "n_out")


def merged_goal(specs: DataFrame) -> DataFrame:
    """All facts that no exploit needs become the first of them, the goal; it takes over what they were granted by."""
    needed = F.flatten(F.transform("exploits", lambda x: x["required"]))
    d = specs.withColumn("_needed", needed).withColumn("_sinks", F.filter(F.transform("propositions", lambda p: p["id_proposition"]), lambda p: ~F.array_contains("_needed", p)))
    d = d.withColumn("goal", F.array_min("_sinks"))
    to = lambda x: F.when(F.array_contains("_sinks", x["granted"]), F.col("goal")).otherwise(x["granted"])
    return d.withColumn("exploits", F.transform("exploits", lambda x: x.withField("granted", to(x)))).drop("_needed", "_sinks")


def numbered(column: Column, by: list[str]) -> Column:
    """A dense index from 0 within a graph, for matrices."""
    return F.row_number().over(Window.partitionBy("graph_id", *by).orderBy(column)) - 1
