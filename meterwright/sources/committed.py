"""Tables that are needed more than once: written to the shared folder and read back."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where none is named, a session on one machine gets a
    temporary one, and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return _own_dir()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def committed(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once: what follows reads committed files, so neither its reads nor a lost executor's work are repeated.

    The files stay until the folder is cleared, as checkpoints do.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
