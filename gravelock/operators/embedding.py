"""Node similarities as sparse (i, j, value) tables, and embeddings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gravelock.shared import written


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse matrix product by join and sum."""
    x = a.select("i", F.col("j").alias("k"), F.col("value").alias("x"))
    y = b.select(F.col("i").alias("k"), "j", F.col("value").alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("value"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    a = adjacency(edges)
    return product(a, a)


def adamic_adar(edges: DataFrame) -> DataFrame:
    """Two-hop ways, each weighted by 1 / degree (in and out) of its middle."""
    a = adjacency(edges)
    degree = edges.select(F.explode(F.array("src", "dst")).alias("k")).groupBy("k").agg(F.count("*").alias("d"))
    scaled = a.join(degree, a["i"] == degree["k"]).select("i", "j", (F.col("value") / F.col("d")).alias("value"))
    return product(a, scaled)


def series(base: DataFrame, step: DataFrame, max_terms: int = 200, tol: float = 0.0) -> DataFrame:
    """base + base step + base step^2 + ..., until a term is empty (always so without cycles) or all at most tol.

    One job and table for each term.
    """
    term = written(base)
    terms = [term]
    for _ in range(max_terms):
        term = written(product(term, step).where(F.abs("value") > tol))
        if not term.take(1):
            break
        terms.append(term)
    else:
        raise RuntimeError("the series does not end; give a tolerance")
    out = terms[0]
    for t in terms[1:]:
        out = out.union(t)
    return out.groupBy("i", "j").agg(F.sum("value").alias("value"))


def katz(edges: DataFrame, beta: float = 0.1, tol: float = 0.0) -> DataFrame:
    a = adjacency(edges).withColumn("value", F.lit(beta))
    return series(a, a, tol=tol)


def personal_page_rank(edges: DataFrame, nodes: DataFrame, alpha: float = 0.5, tol: float = 0.0) -> DataFrame:
    """(1-alpha) (I - alpha P)^-1, P being the adjacency over its column sums. nodes: node."""
    into = edges.groupBy("dst").agg(F.count("*").alias("n"))
    p = edges.join(into, "dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), (alpha / F.col("n")).alias("value"))
    one = nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0 - alpha).alias("value"))
    return series(one, p, tol=tol)


SIMILARITIES = {"cn": common_neighbours, "katz": katz, "ppr": personal_page_rank, "aa": adamic_adar}


def hope(similarity: DataFrame, nodes: DataFrame, dim: int = 16) -> DataFrame:
    """node, vec: [U sqrt(s) | V sqrt(s)] of the dim/2 largest singular values of a similarity table; a dense
    kernel, for graphs of some thousand nodes. Signs are fixed by the largest entry of each U column."""
    ids = nodes.select("node").distinct()
    rows = similarity.select(F.array(F.col("i").cast("double"), F.col("j").cast("double"), "value").alias("e")).groupBy().agg(F.collect_list("e").alias("e"))
    all_ = ids.groupBy().agg(F.array_sort(F.collect_list(F.col("node").cast("int"))).alias("ids")).crossJoin(rows)

    def run(found):
        for f in found:
            for r in f.itertuples():
                ids = np.array(r.ids)
                s = np.zeros((len(ids), len(ids)))
                for i, j, v in r.e:
                    s[np.searchsorted(ids, int(i)), np.searchsorted(ids, int(j))] += v
                u, w, vt = np.linalg.svd(s)
                k = min(dim // 2, len(ids))
                sign = np.sign(u[np.abs(u[:, :k]).argmax(axis=0), np.arange(k)])
                x = np.hstack([u[:, :k] * sign * np.sqrt(w[:k]), vt[:k].T * sign * np.sqrt(w[:k])])
                yield pd.DataFrame({"node": ids, "vec": list(x)})

    return all_.mapInPandas(run, "node int, vec array<double>")


def walks(both: DataFrame, starts: DataFrame, length: int = 80, per_node: int = 10, seed: int = 1) -> DataFrame:
    """walk_id, walk (array of nodes): random walks on undirected edges. Neighbour lists are joined once a step;
    the choice is a hash of walk, step and seed, so lost tasks repeat it."""
    near = both.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("near"))
    w = starts.select("node", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("nth"))
    w = w.select(F.concat_ws(":", "node", "nth").alias("walk_id"), F.col("node").alias("at"), F.array("node").alias("walk"))
    for k in range(1, length):
        pick = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "walk_id"), F.size("near").cast("long")).cast("int")
        w = w.join(near, w["at"] == near["src"], "left").withColumn("at", F.get("near", pick)).select("walk_id", "at", F.when(F.col("at").isNull(), F.col("walk")).otherwise(F.concat("walk", F.array("at"))).alias("walk"))
        if k % 10 == 0:
            w = w.checkpoint()
    return w.select("walk_id", "walk")


def deep_walk(both: DataFrame, starts: DataFrame, dim: int = 16, length: int = 80, window: int = 5, per_node: int = 10, seed: int = 1) -> DataFrame:
    """node (as text), vec: skip-gram over random walks."""
    w = walks(both, starts, length, per_node, seed).select(F.transform("walk", lambda x: x.cast("string")).alias("walk"))
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=0, seed=seed, inputCol="walk", outputCol="out").fit(w)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("vec"))


def graph_sage(edges: DataFrame, dim: int = 16, epochs: int = 50, rate: float = 0.01, seed: int = 1) -> DataFrame:
    """graph_id, node, vec for undirected edges (graph_id, src, dst): two mean-aggregating layers over identity
    features, trained without labels to tell neighbours from random nodes; a kernel for each graph, with all
    neighbours in place of samples, and ids numbered first, so gaps do no harm."""

    def of(f: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([f.src, f.dst]))
        n, rng = len(ids), np.random.default_rng(seed)
        i, j = np.searchsorted(ids, f.src.to_numpy()), np.searchsorted(ids, f.dst.to_numpy())
        a = np.zeros((n, n))
        a[i, j] = a[j, i] = 1
        mean = a / np.maximum(a.sum(axis=1, keepdims=True), 1)
        w = [rng.normal(0, 1 / math.sqrt(s), (s, dim)) for s in (2 * n, 2 * dim)]
        state = [(np.zeros_like(x), np.zeros_like(x)) for x in w]
        first = np.hstack([np.eye(n), mean])
        for t in range(1, epochs + 1):
            z = first @ w[0]
            h = np.maximum(z, 0)
            both = np.hstack([h, mean @ h])
            out = both @ w[1]
            g = np.zeros_like(out)
            for other, sign in ((j, 1.0), (rng.integers(0, n, len(i)), -1.0)):
                s = (out[i] * out[other]).sum(axis=1)
                d = (-sign / (1 + np.exp(np.clip(sign * s, -30, 30)))) / max(1, len(i))
                np.add.at(g, i, d[:, None] * out[other])
                np.add.at(g, other, d[:, None] * out[i])
            back = g @ w[1].T
            gh = (back[:, :dim] + mean.T @ back[:, dim:]) * (z > 0)
            for k, grad in enumerate((first.T @ gh, both.T @ g)):
                m, v = state[k]
                m[:] = 0.9 * m + 0.1 * grad
                v[:] = 0.999 * v + 0.001 * grad**2
                w[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        h = np.maximum(first @ w[0], 0)
        return pd.DataFrame({"graph_id": f.graph_id.iloc[0], "node": ids, "vec": list(np.hstack([h, mean @ h]) @ w[1])})

    return edges.select("graph_id", F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")).groupBy("graph_id").applyInPandas(of, "graph_id string, node int, vec array<double>")


def numbered(nodes: DataFrame) -> DataFrame:
    """graph_id, node_id, index: 0.. within each graph, for matrices."""
    return nodes.withColumn("index", F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1)
