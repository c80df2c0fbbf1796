"""As-of joins by union and running last value: one sort per key, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_before(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: dict[str, str], order: list[str] = ()) -> DataFrame:
    """``left`` with the payload of the last row of ``right`` at or before its time.

    payload maps columns of ``right`` to names in the result. Rows of equal time
    on the right are taken in order of ``order``; the last one counts.
    """
    held = F.struct(*[F.col(c).alias(n) for c, n in payload.items()])
    tie = F.struct(*[F.col(c) for c in order]) if order else F.lit(None)
    marks = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), tie.alias("_tie"), held.alias("_held"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    rows = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(marks.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(marks.schema["_held"].dataType).alias("_held"), F.struct(*left.columns).alias("_row"))
    upto = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(rows).withColumn("_last", F.last("_held", ignorenulls=True).over(upto)).where("_side = 1")
    return both.select("_row.*", *[F.col(f"_last.{n}").alias(n) for n in payload.values()])
