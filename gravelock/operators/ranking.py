"""Ranking exploits by what is left without them: all graphs and scenarios in one job, and rankings compared."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gravelock.operators.dependency import scenarios
from gravelock.operators.kernels import METHODS, Spec, scores

#: Methods by kind of graph, as an interactive user is offered them.
OFFERED = {"state": ("pagerank", "kuehlmann", "value_iteration_state", "probabilistic_path"), "dependency": ("homer", "value_iteration_dependency")}
SCORES = "graph_id string, method string, removed_exploit int, score double"


def scored(specs: DataFrame, *methods: str, seed: int = 0, tol: float = 1e-4, max_iter: int = 10_000) -> DataFrame:
    """SCORES: of each graph without an exploit, for every exploit and none. Scenarios are dealt evenly over the
    cluster, as they cost far more than their rows; a graph travels once for each."""
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"no such method: {sorted(unknown)}")

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in found:
            out = []
            for r in f.itertuples():
                s = Spec.of(r.goal, r.propositions, r.exploits)
                removed = None if pd.isna(r.removed_exploit) else int(r.removed_exploit)
                out += [(r.graph_id, *x) for x in scores(s, [removed], list(methods), seed, tol, max_iter)]
            yield pd.DataFrame(out, columns=["graph_id", "method", "removed_exploit", "score"]).astype({"removed_exploit": "Int32"})

    runs = scenarios(specs).select("graph_id", "goal", "propositions", "exploits", "removed_exploit")
    n = int(specs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(n).mapInPandas(run, SCORES)


def ranked(scores_: DataFrame) -> DataFrame:
    """With rank: from 0, the least score (the most valuable removal) first; ties by exploit, none removed first."""
    by = Window.partitionBy("graph_id", "method").orderBy(F.round("score", 9), F.col("removed_exploit").asc_nulls_first())
    return scores_.withColumn("rank", F.row_number().over(by) - 1)


def table(ranking: DataFrame) -> DataFrame:
    """position, exploit, score as they are shown."""
    return ranking.select("graph_id", "method", F.col("rank").alias("position"), F.coalesce(F.col("removed_exploit").cast("string"), F.lit("None")).alias("exploit"), F.format_string("%.2e", "score").alias("shown"))


def disagreement(a: DataFrame, b: DataFrame, on: list[str], rank: str = "rank", within: list[str] | None = None) -> DataFrame:
    """ppce: the share of unordered pairs of keys that two rankings put in opposite order, for each group of `within`.

    Counted over pairs: a join of each group with itself on the smaller key.
    """
    within = within or []
    both = a.select(*within, *on, F.col(rank).alias("ra")).join(b.select(*within, *on, F.col(rank).alias("rb")), [*within, *on])
    key = F.struct(*on)
    x = both.select(*within, key.alias("k1"), F.col("ra").alias("ra1"), F.col("rb").alias("rb1"))
    y = both.select(*within, key.alias("k2"), F.col("ra").alias("ra2"), F.col("rb").alias("rb2"))
    pairs = (x.join(y, within) if within else x.crossJoin(y)).where("k1 < k2")
    apart = ((F.col("ra1") - F.col("ra2")) * (F.col("rb1") - F.col("rb2")) < 0).cast("double")
    return pairs.groupBy(*within).agg(F.avg(apart).alias("ppce"))


def top_overlap(a: DataFrame, b: DataFrame, on: list[str], rank: str = "rank", share: int = 3, within: list[str] | None = None) -> DataFrame:
    """overlap: the share of the first ceil(n / `share`) keys that two rankings have in common."""
    within = within or []
    n = a.groupBy(*within).agg(F.ceil(F.count("*") / share).alias("top"))
    both = a.select(*within, *on, F.col(rank).alias("ra")).join(b.select(*within, *on, F.col(rank).alias("rb")), [*within, *on])
    both = both.join(n, within) if within else both.crossJoin(F.broadcast(n))
    return both.groupBy(*within, "top").agg((F.sum(((F.col("ra") < F.col("top")) & (F.col("rb") < F.col("top"))).cast("double")) / F.col("top")).alias("overlap")).drop("top")


def matrix(ranking: DataFrame, measure=disagreement) -> DataFrame:
    """method_a, method_b, value per graph, symmetric, from a table of ranked scores; the same method: 0 or 1."""
    methods = [r[0] for r in ranking.select("method").distinct().orderBy("method").collect()]  # a handful
    keyed = ranking.withColumn("key", F.coalesce("removed_exploit", F.lit(-1)))
    same = 0.0 if measure is disagreement else 1.0
    out = ranking.select("graph_id").distinct().select("graph_id", F.explode(F.array(*map(F.lit, methods))).alias("method_a")).select("graph_id", "method_a", F.col("method_a").alias("method_b"), F.lit(same).alias("value"))
    for i, a in enumerate(methods):
        for b in methods[i + 1 :]:
            v = measure(keyed.where(F.col("method") == a), keyed.where(F.col("method") == b), ["key"], within=["graph_id"]).toDF("graph_id", "value")
            out = out.unionByName(v.withColumns({"method_a": F.lit(a), "method_b": F.lit(b)})).unionByName(v.withColumns({"method_a": F.lit(b), "method_b": F.lit(a)}))
    return out


def mean_matrix(values: DataFrame, rows: str, columns: str, value: str, names: list, group: str | None = None) -> DataFrame:
    """Means of a long table as a matrix, for each group."""
    return values.groupBy(*([group] if group else []), rows).pivot(columns, names).agg(F.avg(value))


def timed_by_branches(times: DataFrame, branches: DataFrame, limit: float = 3600.0) -> DataFrame:
    """Times (inf: stopped) against the number of branch facts, by that number."""
    n = branches.groupBy("graph_id").agg(F.count("*").alias("n_branches"))
    t = times.withColumn("seconds", F.when(F.col("seconds") == float("inf"), limit).otherwise(F.col("seconds")))
    return t.join(n, "graph_id", "left").fillna(0, ["n_branches"]).orderBy("n_branches", "graph_id")
