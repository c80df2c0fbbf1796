"""Limit windows: stated, merged, split, anchored by activity, or by jittered resets. All per account or lane."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import last_before
from .ledger import all_tokens

FIVE_HOURS = 5 * 3600
HOUR = 3600
JITTER = 120


def hour_floor(ts: Column) -> Column:
    """W18."""
    return ts - ts % HOUR


def distinct_starts(starts: DataFrame) -> DataFrame:
    """U3."""
    return starts.where("start is not null").distinct()


def merge_intervals(starts: DataFrame, keys: list[str], length: int = FIVE_HOURS) -> DataFrame:
    """Windows of ``length`` from each start; those that overlap merge, those that touch stay apart."""
    order = Window.partitionBy(*keys).orderBy("start")
    before = F.max(F.col("start") + length).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = distinct_starts(starts).withColumn("before", before)
    marked = marked.withColumn("island", F.sum(F.when(F.col("before").isNull() | (F.col("start") >= F.col("before")), 1).otherwise(0)).over(order))
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), (F.max("start") + length).alias("end")).drop("island")


def split_intervals(starts: DataFrame, keys: list[str], length: int = FIVE_HOURS) -> DataFrame:
    """A window ends after ``length``, or where the next one starts."""
    following = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    return distinct_starts(starts).withColumn("end", F.least(F.col("start") + length, following))


def assign_stated_window(rows: DataFrame, windows: DataFrame, keys: list[str], time: str = "ts_s") -> DataFrame:
    """Adds win, the start of the disjoint window that holds the row, or null."""
    held = last_before(rows, windows, keys, time, "start", {"start": "_start", "end": "_end"})
    return held.withColumn("win", F.when(F.col(time) < F.col("_end"), F.col("_start"))).drop("_start", "_end")


def anchored_blocks(rows: DataFrame, keys: list[str], length: int = FIVE_HOURS, time: str = "ts_s") -> DataFrame:
    """Adds block: each block starts at its first row and lasts ``length``."""
    return last_before(rows, anchors(rows, keys, length, time), keys, time, "start", {"start": "block"})


def anchors(rows: DataFrame, keys: list[str], length: int = FIVE_HOURS, time: str = "ts_s") -> DataFrame:
    """The starts of W3's blocks, in order of time along the distinct seconds of each key.

    The walk holds one start and no list, whatever the stretch: a round-the-clock account costs no more memory than
    another one. One key is walked by one task, as each block's start needs the one before; it has at most 86,400 seconds a day. Rows without a
    time are in no block.
    """
    seconds = rows.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("long").alias("start")).distinct()
    order = seconds.repartition(*keys).sortWithinPartitions(*keys, "start")
    return order.mapInArrow(_walk(keys, length), order.schema)


def _walk(keys: list[str], length: int):
    """Sorted (keys, start) -> the rows in which a block starts."""

    def work(batches):
        key, until = None, None
        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            found = []
            for k, (now, t) in enumerate(zip(own, batch.column("start").to_pylist(), strict=True)):
                if until is None or now != key or t >= until:
                    found.append(k)
                    key, until = now, t + length
            if found:
                yield batch.take(pa.array(found))

    return work


def window_or_block(rows: DataFrame, windows: DataFrame, keys: list[str], length: int = FIVE_HOURS, time: str = "ts_s") -> DataFrame:
    """Stated windows first; the rows outside them fall in anchored blocks. Adds win and stated."""
    held = assign_stated_window(rows, windows, keys, time)
    blocks = anchors(held.where("win is null"), keys, length, time)
    both = last_before(held, blocks, keys, time, "start", {"start": "_block"}).withColumn("stated", F.col("win").isNotNull())
    return both.withColumn("win", F.coalesce("win", "_block")).drop("_block")


def hour_to_window(rows: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Assignment by the row's hour, as older logs have it."""
    hours = rows.select(*keys, hour_floor(F.col("ts_s")).alias("hour")).distinct()
    mapped = window_or_block(hours, windows, keys, FIVE_HOURS, "hour").select(*keys, "hour", "win", "stated")
    return rows.withColumn("hour", hour_floor(F.col("ts_s"))).join(mapped, [*keys, "hour"], "left")


def jitter_windows(samples: DataFrame, keys: list[str], jitter: int = JITTER) -> DataFrame:
    """Resets at most ``jitter`` apart are one window; it is active until its end or the next one's start."""
    resets = samples.groupBy(*keys, "window_minutes", "resets_at").agg(F.count(F.lit(1)).alias("n"), F.max("used_percent").alias("most"))
    order = Window.partitionBy(*keys, "window_minutes").orderBy("resets_at")
    gap = F.col("resets_at") - F.lag("resets_at").over(order)
    marked = resets.withColumn("gap", gap).withColumn("w", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > jitter), 1).otherwise(0)).over(order))
    windows = marked.groupBy(*keys, "window_minutes", "w").agg(F.max("resets_at").alias("end"), F.sum("n").alias("samples"), F.max("most").alias("most"))
    windows = windows.withColumn("start", F.col("end") - F.col("window_minutes") * 60)
    after = F.lead("start").over(Window.partitionBy(*keys, "window_minutes").orderBy("start"))
    return windows.withColumn("active_end", F.least("end", after)).drop("w")


def started_windows(windows: DataFrame) -> DataFrame:
    """Windows in which something was used."""
    return windows.where("most > 0")


def rising_only(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples above every earlier one of their window."""
    before = F.max("used_percent").over(Window.partitionBy(*keys).orderBy("ts_s", "line").rowsBetween(Window.unboundedPreceding, -1))
    return samples.withColumn("before", before).where("before is null or used_percent > before").drop("before")


def samples_to_windows(samples: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Samples with their jitter window: the first one that ends at or after the stated reset less the jitter."""
    ends = windows.select(*keys, "window_minutes", F.col("end").alias("_e"), "start", "end", "active_end")
    flipped = samples.withColumn("_r", -F.col("resets_at"))
    marks = ends.withColumn("_m", -F.col("_e"))
    held = last_before(flipped, marks, [*keys, "window_minutes"], "_r", "_m", {"start": "start", "end": "end", "active_end": "active_end"})
    return held.drop("_r")


def used_in_span(samples: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """From the last value before a span (else its first inside) to the last value inside. Three as-of joins, so
    neither side is sent whole and no key's samples meet all of its spans."""
    values = samples.select(*keys, "ts_s", "line", "used_percent", (-F.col("ts_s")).alias("_neg"), (-F.col("line")).alias("_line"))
    ends = spans.withColumns({"_b": F.col("span_start") - 1, "_e": F.col("span_end") - 1, "_s": -F.col("span_start")})
    held = last_before(ends, values, keys, "_b", "ts_s", {"used_percent": "before"}, ["line"])
    held = last_before(held, values, keys, "_e", "ts_s", {"used_percent": "last_inside", "ts_s": "_last_at"}, ["line"])
    held = last_before(held, values, keys, "_s", "_neg", {"used_percent": "first_inside"}, ["_line"])
    held = held.where("_last_at >= span_start").withColumn("used", F.col("last_inside") - F.coalesce("before", "first_inside"))
    return held.select(*keys, "span_start", "span_end", "before", "first_inside", "last_inside", "used")


def tile_from_anchor(rows: DataFrame, anchor_s: int, length: int = FIVE_HOURS) -> DataFrame:
    """Floor tiles from an anchor where no window was recorded."""
    return rows.withColumn("win", (F.floor((F.col("ts_s") - anchor_s) / length) * length + anchor_s).cast("long"))


def window_rollup(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A7."""
    return rows.groupBy(*keys, "win").agg(
        F.sum("cost_e8").alias("cost_e8"), F.sum(all_tokens()).alias("tokens"), F.count(F.lit(1)).alias("calls"), F.count_distinct("sid").alias("sessions"), F.min("ts_s").alias("first_ts"), F.max("ts_s").alias("last_ts")
    )


def window_hour(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A8, long form: cost and tokens per window and hour."""
    return rows.groupBy(*keys, "win", hour_floor(F.col("ts_s")).alias("hour")).agg(F.sum("cost_e8").alias("cost_e8"), F.sum(all_tokens()).alias("tokens"))


def window_session_hour(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A9, long form."""
    return rows.groupBy(*keys, "win", "sid", hour_floor(F.col("ts_s")).alias("hour")).agg(F.sum("cost_e8").alias("cost_e8"), F.sum(all_tokens()).alias("tokens"), F.count(F.lit(1)).alias("calls"))


def parent_group_rollup(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A10: a main session with its agents, per window."""
    return rows.withColumn("grp", F.coalesce("parent", "sid")).groupBy(*keys, "win", "grp").agg(
        F.sum("cost_e8").alias("cost_e8"), F.sum(all_tokens()).alias("tokens"), F.count_distinct(F.when(F.col("parent").isNotNull(), F.col("sid"))).alias("agents")
    ).where("tokens > 0")


def active_hours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A42."""
    return rows.where("cost_e8 > 0").groupBy(*keys).agg(F.count_distinct(hour_floor(F.col("ts_s"))).alias("active_hours"))


def concurrency(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Most sessions in one second of each window."""
    each = rows.groupBy(*keys, "win", "ts_s").agg(F.count_distinct("sid").alias("n"))
    return each.groupBy(*keys, "win").agg(F.max("n").alias("peak"))
