"""Graphs and other inputs made from the test tables, the same on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAST, GOAL = 16, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spec(rows: DataFrame, by: str, goal: int, cvss: str) -> DataFrame:
    granted = "1 + n_nationkey div 2"
    required = f"CASE WHEN n_nationkey % 2 = 0 THEN array_sort(array_distinct(array(cast(({granted}) div 2 AS int), cast(({granted}) div 3 AS int)))) ELSE array(cast(n_nationkey div 2 AS int)) END"
    x = rows.where(f"n_nationkey < {LAST}").selectExpr(f"{by} AS graph_id", f"named_struct('id_exploit', cast(n_nationkey AS int), 'granted', cast({granted} AS int), 'required', {required}, 'cvss', {cvss}, 'text', n_name, 'cve_id', cast(null AS string)) AS x")
    facts = F.transform(F.sequence(F.lit(0), F.lit(GOAL)), lambda i: F.struct(i.cast("int").alias("id_proposition"), F.concat(F.lit("fact "), i.cast("string")).alias("text"), (i == 0).alias("initial")))
    return x.groupBy("graph_id").agg(F.array_sort(F.collect_list("x")).alias("exploits")).select("graph_id", F.lit(goal).alias("goal"), facts.alias("propositions"), "exploits")


def v1(spark: SparkSession, sf_dir: str, goal: int = GOAL) -> DataFrame:
    """One graph of nine facts and sixteen exploits, two for each fact."""
    return _spec(table(spark, sf_dir, "nation"), "'v1'", goal, "cast(1 + (n_nationkey * 7 % 90) / 10.0 AS double)")


def v1n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each supplier, with other scores."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier").select("s_suppkey"))
    return _spec(rows, "cast(s_suppkey AS string)", GOAL, "cast(1 + ((n_nationkey * 7 + s_suppkey) % 90) / 10.0 AS double)")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src < dst: nations whose customers and suppliers trade more than the median pair."""
    read = lambda n: table(spark, sf_dir, n)
    # Lines are counted by order and supplier keys before nations are known, so the large join is the only one.
    lines = read("lineitem").join(read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))
    c = lines.join(read("customer").selectExpr("c_custkey AS o_custkey", "c_nationkey AS cn"), "o_custkey").join(read("supplier").selectExpr("s_suppkey AS l_suppkey", "s_nationkey AS sn"), "l_suppkey")
    pairs = c.where("cn <> sn").groupBy(F.least("cn", "sn").alias("src"), F.greatest("cn", "sn").alias("dst")).agg(F.sum("n").alias("n"))
    return pairs.crossJoin(F.broadcast(pairs.agg(F.expr("percentile(n, 0.5)").alias("m")))).where("n > m").select("src", "dst")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("cluster"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in five layers, clusters by region."""
    from gravelock.operators.layout import positions

    d = table(spark, sf_dir, "nation").select(F.lit("n").alias("graph_id"), F.col("n_nationkey").alias("node_id"), (F.col("n_nationkey") % 5).alias("layer"), F.col("n_regionkey").alias("cluster"))
    # Layer 2 loses region 1, so that its zone is broken.
    return positions(d.where("NOT (layer = 2 AND cluster = 1)"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "cast(s_suppkey * 37 % 20000 AS int) AS n_nodes", "s_acctbal")


def two_rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers of each nation by balance, and by a scrambled key."""
    s = table(spark, sf_dir, "supplier")
    order = lambda by: s.selectExpr("s_nationkey", "s_suppkey", f"row_number() OVER (PARTITION BY s_nationkey ORDER BY {by}, s_suppkey) - 1 AS rank")
    return order("s_acctbal"), order("s_suppkey * 7919 % 1009")
