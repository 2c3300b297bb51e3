"""Layers, positions and zones of drawn graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def state_layers(states: DataFrame) -> DataFrame:
    """graph_id, state, layer: facts beyond those of the start."""
    least = F.min(F.size("state")).over(Window.partitionBy("graph_id"))
    return states.select("graph_id", "state", (F.size("state") - least).alias("layer"))


def dependency_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, layer: the longest way to the goal, counted back from the farthest node.

    One checkpointed job for each level; a cycle is an error.
    """
    front = nodes.where("is_goal").select("graph_id", "node_id", F.lit(0).alias("far")).checkpoint()
    seen = front
    for k in range(1, 10_000):
        up = front.select("graph_id", F.col("node_id").alias("dst"))
        front = edges.select("graph_id", "src", "dst").join(up, ["graph_id", "dst"]).select("graph_id", F.col("src").alias("node_id"), F.lit(k).alias("far")).distinct().checkpoint()
        if not front.take(1):
            break
        seen = seen.union(front).groupBy("graph_id", "node_id").agg(F.max("far").alias("far"))
    else:
        raise RuntimeError("the graph has a cycle")
    most = F.max("far").over(Window.partitionBy("graph_id"))
    return seen.select("graph_id", "node_id", (most - F.col("far")).alias("layer"))


def positions(layers: DataFrame, node: str = "node_id") -> DataFrame:
    """x by layer, y spread evenly within the layer, around 0."""
    own = Window.partitionBy("graph_id", "layer")
    nth, n = F.row_number().over(own.orderBy(node)), F.count("*").over(own)
    return layers.withColumns({"x": F.col("layer").cast("double"), "y": (nth - 1) - (n - 1) / 2})


def layers_by_x(placed: DataFrame) -> DataFrame:
    return placed.withColumn("layer", F.dense_rank().over(Window.partitionBy("graph_id").orderBy("x")) - 1)


def repositioned(placed: DataFrame, node: str = "node_id") -> DataFrame:
    """In each layer the nodes, by cluster, take the layer's heights from the top."""
    own = ["graph_id", "layer"]
    a = placed.withColumn("_n", F.row_number().over(Window.partitionBy(*own).orderBy("cluster", node))).drop("y")
    b = placed.select(*own, "y", F.row_number().over(Window.partitionBy(*own).orderBy(F.col("y").desc(), node)).alias("_n"))
    return a.join(b, [*own, "_n"]).drop("_n")


def axis_distances(placed: DataFrame) -> DataFrame:
    """graph_id, horizontal (between the first two layers; null with one), vertical (least in the first layer of
    several nodes; inf if there is none)."""
    xs = placed.select("graph_id", "x").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("graph_id").orderBy("x")))
    x = xs.groupBy("graph_id").agg((F.max(F.when(F.col("_n") == 2, F.col("x"))) - F.max(F.when(F.col("_n") == 1, F.col("x")))).alias("horizontal"))
    crowd = placed.groupBy("graph_id", "layer").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("y")).alias("ys")).where("n > 1")
    top = F.max_by("y", F.struct(-F.col("layer"), "y"))
    first = crowd.groupBy("graph_id").agg(F.min("layer").alias("layer"))
    d = placed.join(first, ["graph_id", "layer"])
    d = d.join(d.groupBy("graph_id").agg(top.alias("y0")), "graph_id").groupBy("graph_id").agg(F.min(F.when(F.col("y") != F.col("y0"), F.abs(F.col("y") - F.col("y0")))).alias("vertical"))
    return x.join(d, "graph_id", "left").withColumn("vertical", F.coalesce("vertical", F.lit(float("inf"))))


def zones(placed: DataFrame) -> DataFrame:
    """graph_id, cluster, zone, layer for each layer that a cluster is in: adjacent layers are one zone."""
    d = placed.select("graph_id", "cluster", "layer").distinct()
    own = Window.partitionBy("graph_id", "cluster").orderBy("layer")
    new = F.coalesce((F.col("layer") - F.lag("layer").over(own) > 1).cast("int"), F.lit(0))
    return d.withColumn("_new", new).withColumn("zone", F.sum("_new").over(own)).drop("_new")


def zone_points(placed: DataFrame, wide: float = 0.2, high: float = 0.3, node: str = "node_id") -> DataFrame:
    """graph_id, cluster, zone, points: the outline of each zone. Down the nodes of its first layer, each moved left;
    along the lowest node of each layer, moved down; up the nodes of its last layer, moved right; back along the
    highest node of each layer, moved up. Margins are shares of the axis distances (with one layer: no margin)."""
    d = zones(placed).join(placed.select("graph_id", "cluster", "layer", "x", "y", F.col(node).alias("_node")), ["graph_id", "cluster", "layer"])
    nodes = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "_node", "x")))  # from the top
    d = d.groupBy("graph_id", "cluster", "zone", "layer").agg(nodes.alias("nodes"))
    d = d.groupBy("graph_id", "cluster", "zone").agg(F.array_sort(F.collect_list(F.struct("layer", "nodes"))).alias("l")).join(axis_distances(placed), "graph_id", "left")
    right, up = wide * F.coalesce("horizontal", F.lit(0.0)), high * F.col("vertical")
    point = lambda n, dx=F.lit(0.0), dy=F.lit(0.0): F.struct(F.round(n["x"] + dx, 6).alias("x"), F.round(dy - n["down"], 6).alias("y"))
    left_side = F.transform(F.element_at("l", 1)["nodes"], lambda n: point(n, -right))
    bottom = F.transform("l", lambda e: point(F.element_at(e["nodes"], -1), dy=-up))
    right_side = F.transform(F.reverse(F.element_at("l", -1)["nodes"]), lambda n: point(n, right))
    top = F.reverse(F.transform("l", lambda e: point(F.element_at(e["nodes"], 1), dy=up)))
    return d.select("graph_id", "cluster", "zone", F.concat(left_side, bottom, right_side, top).alias("points"))
