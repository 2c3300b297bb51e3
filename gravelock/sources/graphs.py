"""Graph files: node-link JSON, attack-graph XML, data-set summaries and exploit lists, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelock.schema import EXPLOIT_LIST, NODE_LINK, SUMMARY

XML = "struct<arcs:struct<arc:array<struct<src:int,dst:int>>>,vertices:struct<vertex:array<struct<id:int,fact:string,type:string>>>>"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def spec_of(g: Column) -> list[Column]:
    """The columns of a spec from a node-link struct; ids ascend, as the files list them."""
    props = F.array_sort(F.transform(F.map_entries(g["propositions"]), lambda e: F.struct(e["key"].cast("int").alias("id_proposition"), e["value"]["text"].alias("text"), e["value"]["initial"].alias("initial"))))
    exploits = F.array_sort(
        F.transform(
            F.map_entries(g["exploits"]),
            lambda e: F.struct(e["key"].cast("int").alias("id_exploit"), e["value"]["granted_proposition"].alias("granted"), F.array_sort(F.array_distinct(e["value"]["required_propositions"])).alias("required"), e["value"]["cvss"].alias("cvss"), e["value"]["text"].alias("text"), e["value"]["cve_id"].alias("cve_id")),
        )
    )
    return [g["goal_proposition"].alias("goal"), props.alias("propositions"), exploits.alias("exploits")]


def texts(spark: SparkSession, path: str) -> DataFrame:
    """graph_id (the file's name without its extension), extension, content: a row for each file."""
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return d.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("graph_id"), extension(name).alias("extension"), F.col("value").alias("content"))


def parse(contents: DataFrame) -> DataFrame:
    """specs from rows of (graph_id, extension, content); an unknown extension is an error."""
    known = F.when(F.col("extension").isin("json", "xml"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("no reader for extension "), F.coalesce("extension", F.lit("null")))))
    rows = contents.withColumn("content", known)
    json = rows.where("extension <> 'xml'").select("graph_id", F.from_json("content", NODE_LINK).alias("g"))
    return json.select("graph_id", *spec_of(F.col("g"))).unionByName(from_xml(rows.where("extension = 'xml'")))


def load(spark: SparkSession, path: str) -> DataFrame:
    return parse(texts(spark, path))


def node_links(spark: SparkSession, path: str) -> DataFrame:
    """The files' own columns (nodes, links, ...) as they are, with graph_id."""
    return texts(spark, path).where("extension = 'json'").select("graph_id", F.from_json("content", NODE_LINK).alias("g")).select("graph_id", "g.*")


def uploaded(df: DataFrame) -> DataFrame:
    """specs from rows of (graph_id, extension, contents), contents being a data address: base64 after the comma."""
    body = F.decode(F.unbase64(F.element_at(F.split("contents", ","), 2)), "UTF-8")
    return parse(df.select("graph_id", "extension", body.alias("content")))


def from_xml(rows: DataFrame) -> DataFrame:
    """AND vertices are exploits, OR and LEAF propositions (LEAF: initial); an arc runs from dst to src.

    The goal is the only proposition without a successor; none or several are an error. cvss is null.
    """
    g = rows.select("graph_id", F.from_xml("content", XML).alias("g"))
    arcs = g.select("graph_id", F.explode("g.arcs.arc").alias("a")).select("graph_id", F.col("a.dst").alias("src"), F.col("a.src").alias("dst"))
    vertices = g.select("graph_id", F.explode("g.vertices.vertex").alias("v")).select("graph_id", "v.*").where(F.col("type").isin("AND", "OR", "LEAF"))
    into = arcs.groupBy("graph_id", F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("required"))
    out = arcs.groupBy("graph_id", F.col("src").alias("id")).agg(F.min("dst").alias("granted"))
    all_ = vertices.join(into, ["graph_id", "id"], "left").join(out, ["graph_id", "id"], "left")
    is_exploit = F.col("type") == "AND"
    sinks = F.collect_list(F.when(~is_exploit & F.col("granted").isNull(), F.col("id")))
    prop = F.when(~is_exploit, F.struct(F.col("id").alias("id_proposition"), F.col("fact").alias("text"), (F.col("type") == "LEAF").alias("initial")))
    exploit = F.when(is_exploit, F.struct(F.col("id").alias("id_exploit"), "granted", "required", F.lit(None).cast("double").alias("cvss"), F.col("fact").alias("text"), F.lit(None).cast("string").alias("cve_id")))
    d = all_.groupBy("graph_id").agg(sinks.alias("sinks"), F.array_sort(F.collect_list(prop)).alias("propositions"), F.array_sort(F.collect_list(exploit)).alias("exploits"))
    goal = F.when(F.size("sinks") == 1, F.get("sinks", F.lit(0))).otherwise(F.raise_error(F.lit("a graph needs exactly one proposition without a successor")))
    return d.select("graph_id", goal.alias("goal"), "propositions", "exploits")


def to_node_link(specs: DataFrame, nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(graph_id, value): one JSON text for each graph, readable by load()."""
    state = kind == "state"
    node = F.struct(F.col("node_id").alias("id"), *(["ids_propositions"] if state else ["id_proposition", "id_exploit"]))
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"), F.array_sort(F.collect_list(F.when(F.col("is_goal"), F.col("node_id")))).alias("goal_nodes"))
    link = F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), *(["ids_exploits"] if state else []))
    e = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(link)).alias("links"))
    props = F.map_from_entries(F.transform("propositions", lambda p: F.struct(p["id_proposition"].cast("string"), F.struct(p["text"].alias("text"), p["initial"].alias("initial")))))
    exploits = F.map_from_entries(F.transform("exploits", lambda x: F.struct(x["id_exploit"].cast("string"), F.struct(x["text"].alias("text"), x["granted"].alias("granted_proposition"), x["required"].alias("required_propositions"), x["cve_id"].alias("cve_id"), x["cvss"].alias("cvss")))))
    d = specs.join(n, "graph_id").join(e, "graph_id", "left")
    return d.select("graph_id", F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), "nodes", "links", props.alias("propositions"), exploits.alias("exploits"), F.col("goal").alias("goal_proposition"), "goal_nodes", F.lit(kind).alias("type"))).alias("value"))


def save(texts_: DataFrame, path: str) -> None:
    """A folder for each graph_id, with one text file of a line; folders are made as needed."""
    texts_.repartition("graph_id").write.partitionBy("graph_id").mode("append").text(path)


def exploit_list(spark: SparkSession, path: str) -> DataFrame:
    """Exploits with a text and a score (what a fetched list must be filtered by)."""
    return spark.read.schema(EXPLOIT_LIST).json(path, multiLine=True).where("text <> 'N/A' AND cvss > 0")


def drawn(exploits: DataFrame, n: int, seed: int) -> DataFrame:
    """n exploits drawn with replacement, in random order: (nth, cve_id, text, cvss)."""
    numbered = exploits.select(F.row_number().over(_all_by("cve_id")).alias("_nth"), "*")
    picks = exploits.sparkSession.range(n).join(F.broadcast(numbered.agg(F.count("*").alias("_size"))))
    picks = picks.select(F.col("id").alias("nth"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("_size")) + 1).alias("_nth"))
    return picks.join(numbered, "_nth").drop("_nth")


def _all_by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(*columns)


def summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY).json(path, multiLine=True)


def ith(summary_: DataFrame, i: int, size: str = "n_nodes", *ties: str) -> DataFrame:
    """The i-th row (from 0) by size; ties by the columns given. Only i + 1 rows travel, not the table."""
    order = [size, *ties]
    return summary_.orderBy(*order).limit(i + 1).orderBy(*[F.col(c).desc() for c in order]).limit(1)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def unfinished(wanted: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What a resumed batch still has to do."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")
