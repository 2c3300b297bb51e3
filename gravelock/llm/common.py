"""Shared pieces: reading the documents, and tables in the folder that the whole cluster sees."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for every operator here: a maximal run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text, null read as empty, without any other column that is not asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on one machine (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="gravelock-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gravelock/{uuid.uuid4().hex}/{name}"


#: While a table is stored: Spark deletes the query's shuffle files when it ends; batches for Python stay small.
WHILE_STORED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives lost executors. The shuffle files of the plan go at once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    was = {k: spark.conf.get(k) for k in WHILE_STORED}
    try:
        for k, v in WHILE_STORED.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(spark: SparkSession, at: str) -> None:
    """Deletes a folder of the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing that is still to run reads it."""
    for t in tables:
        removed(t.sparkSession, t.stored_at)


def word_array(text: Column) -> Column:
    """The words of a text, in order (no Python involved)."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def batches(found: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """(batch, doc_ids, texts) for each part of `rows` rows: few texts are Python objects at a time."""
    for whole in found:
        for at in range(0, whole.num_rows, rows):
            b = whole.slice(at, rows)
            yield b, b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        pa.default_memory_pool().release_unused()
