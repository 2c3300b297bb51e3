"""Tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder: the context's, else spark.checkpoint.dir, else (on one machine) one of our own."""
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    if set_.isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="gravelock-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """df by way of Parquet: like checkpoint(), but what it reads is a plain file scan of known size."""
    spark = df.sparkSession
    path = f"{shared_checkpoints(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
