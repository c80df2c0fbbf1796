"""A derived table that follows its source files.

The table is partitioned by ``part``, a hash of the file's path, and a manifest
says for each file which state of it (time, size) was derived, by which version
of the derivation. A refresh reads changed files only. It writes the parts they are in
anew, with the rows of the other files of those parts taken over, by dynamic
partition overwrite; the files of all other parts stay as they are. Rows of files
that are gone stay until their version is changed by hand: results outlive their sources.

The order of writing makes it safe to be stopped: parts first, then the
manifest, which is a new run each time and is read as the highest complete one. What was written
without its manifest is derived again.

Listing and manifest have one row a file and are compared on the driver, where a listing is in
any case; rows of the table never come there.

Defined results: a file that lost all its rows leaves none behind, an unchanged listing writes
nothing, another version derives every file that is there again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import NamedTuple

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import Listed, file_system, list_files, read_lines

MANIFEST = "path string, mtime long, size long, version int, run long"


class Refreshed(NamedTuple):
    """Files that were derived, files whose results were taken as they are, and the parts that were written."""

    derived: int
    unchanged: int
    parts: list[int]


def part_of(path: str, parts: int) -> int:
    return zlib.crc32(path.encode()) % parts


def _exists(path: str) -> bool:
    system, inner, _ = file_system(path)
    return system.get_file_info(inner).type != FileType.NotFound


def manifest(spark: SparkSession, table: str) -> DataFrame:
    """The state of each file as of the last complete refresh."""
    if not _exists(f"{table}/manifest/_SUCCESS"):
        return spark.createDataFrame([], MANIFEST)
    runs = spark.read.schema(MANIFEST).parquet(f"{table}/manifest")
    return runs.join(F.broadcast(runs.agg(F.max("run").alias("run"))), "run", "left_semi")


def read_refreshed(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(f"{table}/rows").drop("part")


def incremental_refresh(spark: SparkSession, patterns: list[str], table: str, derive: Callable[[DataFrame], DataFrame], version: int, parts: int = 64) -> Refreshed:
    """Brings ``table`` up to date. ``derive`` makes rows of lines (path, mtime, size, line_no, raw) and has to keep ``path``."""
    listing = {f.path: f for f in list_files(patterns)}
    known = {r["path"]: r for r in manifest(spark, table).collect()}  # one row a file

    def same(f: Listed) -> bool:
        was = known.get(f.path)
        return was is not None and (was["mtime"], was["size"], was["version"]) == (f.mtime, f.size, version)

    changed = sorted(p for p, f in listing.items() if not same(f))
    if not changed:
        return Refreshed(0, len(listing), [])
    touched = sorted({part_of(p, parts) for p in changed})
    rows = derive(read_lines(spark, patterns if len(changed) == len(listing) else changed))
    rows = rows.withColumn("part", (F.crc32(F.col("path").cast("binary")) % parts).cast("int"))
    if _exists(f"{table}/rows"):
        old = spark.read.parquet(f"{table}/rows").where(F.col("part").isin(touched))
        gone = spark.createDataFrame([(p,) for p in changed], "path string")
        rows = rows.unionByName(old.join(gone, "path", "left_anti").select(*rows.columns), allowMissingColumns=True)
    # written aside first: a table is not overwritten while it is read
    run = max((r["run"] for r in known.values()), default=0) + 1
    aside = f"{table}/aside/{run}"
    rows.write.mode("overwrite").partitionBy("part").parquet(aside)
    staged = spark.read.schema(rows.schema).parquet(aside)
    staged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{table}/rows")
    filled = {r["part"] for r in staged.select("part").distinct().collect()}  # at most ``parts``
    for part in set(touched) - filled:
        if _exists(f"{table}/rows/part={part}"):
            system, inner, _ = file_system(f"{table}/rows/part={part}")
            system.delete_dir(inner)
    states = {p: (r["mtime"], r["size"], r["version"]) for p, r in known.items()}
    states |= {p: (f.mtime, f.size, version) for p, f in listing.items()}
    spark.createDataFrame([(p, *s, run) for p, s in states.items()], MANIFEST).coalesce(1).write.mode("append").parquet(f"{table}/manifest")
    system, inner, _ = file_system(f"{table}/aside")
    system.delete_dir(inner)
    return Refreshed(len(changed), len(listing) - len(changed), touched)
