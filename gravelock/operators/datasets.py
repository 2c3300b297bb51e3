"""Data sets of graphs: random graphs, size classes, and the groups of reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gravelock.schema import SPECS

#: Chances of 1, 2, 3 required facts and of 1, 2, 3 uses of a fact; the chance of a new fact.
REQUIRED, USES, NEW = (0.45, 0.3, 0.25), (0.45, 0.35, 0.2), 0.4
#: Size classes: below these numbers of states, and how many graphs each takes.
BOUNDS, ROOM = (1000, 10_000), (40, 40, 20)


def random_spec(n_exploits: int, seed: int, required: tuple = REQUIRED, uses: tuple = USES, new: float = NEW, cvss: list | None = None) -> dict:
    """One random graph. Its facts without use all become the goal. With a fourth entry, `required` starts at 0."""
    rng = np.random.default_rng(seed)
    counts = range(0, len(required)) if len(required) > 3 else range(1, len(required) + 1)
    facts: list[bool] = []  # whether initial
    left: list[int] = []

    def add(initial: bool) -> int:
        facts.append(initial)
        left.append(int(rng.choice(range(1, len(uses) + 1), p=uses)))
        return len(facts) - 1

    exploits = []
    for i in range(n_exploits):
        open_ = [f for f in range(len(facts)) if left[f]]
        if len(open_) >= n_exploits - i:
            new = 0.0  # for good: from here on only open facts are used, while there are any
        need: list[int] = []
        for _ in range(int(rng.choice(counts, p=required))):
            choice = [f for f in open_ if left[f] and f not in need]
            if not choice or rng.random() < new:
                f = add(True)
            else:
                f = int(rng.choice(choice))
            left[f] -= 1
            need.append(f)
        score = float(rng.choice(cvss)) if cvss else float(rng.integers(33, 99)) / 10
        exploits.append({"id_exploit": i, "granted": add(False), "required": sorted(need), "cvss": score, "text": f"exploit {i}", "cve_id": None})
    used = {f for x in exploits for f in x["required"]}
    sinks = [f for f in range(len(facts)) if f not in used]
    for x in exploits:
        if x["granted"] in sinks:
            x["granted"] = sinks[0]
    return {"goal": sinks[0], "propositions": [{"id_proposition": i, "text": f"fact {i}", "initial": x} for i, x in enumerate(facts)], "exploits": exploits}


def generated(spark: SparkSession, n: int, seed: int = 1, least: int = 15, most: int = 30, **how) -> DataFrame:
    """n random specs, from `least` to `most` exploits in turn; graph k depends on (seed, k) only."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in found:
            yield pd.DataFrame([{"graph_id": f"g{k}", **random_spec(least + k % (most - least + 1), seed * 1_000_003 + k, **how)} for k in f["id"]], columns=["graph_id", "goal", "propositions", "exploits"])

    return spark.range(n).mapInPandas(run, SPECS)


def size_classes(sizes: DataFrame, size: str = "n_nodes", order: tuple[str, ...] = ("graph_id",), bounds: tuple = BOUNDS, room: tuple = ROOM) -> DataFrame:
    """With set, the size class, for the first graphs of each class up to its room."""
    which = F.when(F.col(size) < bounds[0], 0).when(F.col(size) < bounds[1], 1).otherwise(2)
    d = sizes.withColumn("set", which)
    nth = F.row_number().over(Window.partitionBy("set").orderBy(*order))
    return d.withColumn("_n", nth).where(F.col("_n") <= F.get(F.array(*map(F.lit, room)), F.col("set"))).drop("_n")


def histogram(values: DataFrame, position: str, value: str, series: str, room: tuple = ROOM) -> DataFrame:
    """series, group, mean: means of Small, Medium and Large graphs by position, NaN left out; 0 where there is none. What lies beyond the room of all three is left out."""
    group = F.when(F.col(position) < room[0], "Small").when(F.col(position) < room[0] + room[1], "Medium").otherwise("Large")
    return values.where(F.col(position) < sum(room)).withColumn("group", group).groupBy(series, "group").agg(F.coalesce(F.avg(F.when(~F.isnan(value), F.col(value))), F.lit(0.0)).alias("mean"))


def bars(groups: DataFrame, series: str) -> DataFrame:
    """width and offset of each series' bar within a group."""
    n = groups.select(series).distinct().count()
    nth = F.dense_rank().over(Window.partitionBy("group").orderBy(series)) - 1
    return groups.withColumns({"width": F.lit(1 / (n + 1)), "offset": (nth - (n - 1) / 2) / (n + 1)})


def swept(grid: list[tuple[str, object]], apply) -> list[tuple[str, object, float]]:
    """(method, parameter, result) for each of a grid; what fails is NaN."""
    out = []
    for method, parameter in grid:
        try:
            out.append((method, parameter, float(apply(method, parameter))))
        except Exception:  # noqa: BLE001  a failed run is a result of the sweep
            out.append((method, parameter, float("nan")))
    return out
