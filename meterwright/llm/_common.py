"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words: space and the ASCII controls tab to carriage return.
WORD_SPACE = "\\x20\\x09-\\x0D"
#: Most keys that are held to be common, and the share of all rows above which a key is one of them.
MOST_COMMON = 10_000
#: Rows up to which a side of a join may be broadcast after it has been counted; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000


@functools.cache
def _local_shared_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a fresh folder under /tmp; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return _local_shared_dir()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later steps start from
    committed files, so a lost executor costs no more than the step that runs."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Gives freed memory back to the system, as Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(work):
    """A batch function that leaves no freed memory behind when its task ends."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            release_memory()

    return run


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are at most ``limit``, else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def common_keys(counts: DataFrame, n: str, total: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Keys with their numbers of rows -> (common ones, others): a common one has more than ``total / most`` of all
    ``total`` rows, so there are fewer than ``most``, and no other one is a large group of a shuffle."""
    common = F.col(n) * (most or MOST_COMMON) > total
    return counts.where(common), counts.where(~common)


def join_counted(rows: DataFrame, side: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined by ``key`` with ``side``, which has one row a key and in ``n`` its number of rows: common keys are
    sent to all tasks, so that their rows do not meet in one."""
    common, others = common_keys(side, n, total)
    common = F.broadcast(common)
    return rows.join(common, key).unionByName(rows.join(common, key, "left_anti").join(others, key))


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that none of ``columns`` has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{WORD_SPACE}]+", -1)
    # white space at an end leaves an empty part there
    return (
        F.size(parts)
        - F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
        - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    ).cast("long")


def hex_digest(text: Column) -> Column:
    """Lower-case SHA-256 of the UTF-8 form."""
    return F.sha2(text.cast("binary"), 256)
