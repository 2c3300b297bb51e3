"""Graphs that arrive as files are ranked as they come; each micro-batch is one job, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gravelock.operators.ranking import ranked, scored
from gravelock.sources.graphs import extension, parse


def rank_stream(spark: SparkSession, source: str, target: str, checkpoint: str, *methods: str) -> StreamingQuery:
    """Watches a folder of graph files; appends rankings to Parquet under target, a folder for each batch, so that a
    batch that is run again replaces itself. Ends when all present files are done."""
    files = spark.readStream.format("text").option("wholetext", True).load(source)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = files.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("graph_id"), extension(name).alias("extension"), F.col("value").alias("content"))

    def batch(df: DataFrame, n: int) -> None:
        ranked(scored(parse(df), *methods)).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
