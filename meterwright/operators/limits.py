"""Rate-limit logs, idle turns and limit-burn research."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def crossing_alert(log: DataFrame, levels: tuple[int, int] = (70, 90)) -> DataFrame:
    """Upward crossings of two levels against the previous reading of the session."""
    before = F.lag("pct_5h").over(Window.partitionBy("sid").orderBy("ts_s", "line"))
    low, high = levels
    rose = lambda x: (F.col("pct_5h") >= x) & (F.coalesce(F.col("_before"), F.lit(0.0)) < x)
    return log.withColumn("_before", before).withColumn("alert", F.when(rose(high), "danger").when(rose(low), "warn")).drop("_before")


def change_dedup(log: DataFrame, columns: list[str], keys: list[str] = ("sid",)) -> DataFrame:
    """Rows that differ from the last known values in some column."""
    order = Window.partitionBy(*keys).orderBy("ts_s", "line").rowsBetween(Window.unboundedPreceding, -1)
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.last(c, ignorenulls=True).over(order))
    return log.withColumn("_changed", changed).where("_changed").drop("_changed")


def backfill_first(log: DataFrame, column: str, keys: list[str] = ("sid",)) -> DataFrame:
    """The first row's missing value comes from the first known one."""
    order = Window.partitionBy(*keys).orderBy("ts_s", "line")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(order) == 1
    return log.withColumns({"_first": first, "_known": F.first(column, ignorenulls=True).over(whole)}).withColumn(column, F.when(F.col("_first"), F.coalesce(column, "_known")).otherwise(F.col(column))).drop("_first", "_known")


def export_log(log: DataFrame) -> DataFrame:
    """Readings of all sessions as one log: equal lines once, changes only, first resets filled in."""
    once = log.select("ts_s", "pct_5h", "reset_5h", F.lit("all").alias("grp"), F.xxhash64("pct_5h", "reset_5h").alias("line")).distinct()
    day = once.withColumn("day", F.floor(F.col("ts_s") / 86400))
    # the last value of the days before is carried over, so that days can be worked on apart
    ends = day.groupBy("day").agg(F.max_by("pct_5h", F.struct("ts_s", "line")).alias("end_pct"))
    carried = ends.withColumn("before_day", F.lag("end_pct").over(Window.orderBy("day"))).select("day", "before_day")  # one row a day
    order = Window.partitionBy("day").orderBy("ts_s", "line")
    known = day.join(F.broadcast(carried), "day").withColumn("_was", F.coalesce(F.lag("pct_5h").over(order), "before_day"))
    changes = known.where(~F.col("pct_5h").eqNullSafe(F.col("_was")))
    first = changes.agg(F.min(F.struct("ts_s", "line")).alias("f"))
    fill = day.agg(F.min_by("reset_5h", F.when(F.col("reset_5h").isNotNull(), F.struct("ts_s", "line"))).alias("fill"))
    return changes.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(fill)).select(
        "ts_s", "pct_5h", F.when((F.col("ts_s") == F.col("f.ts_s")) & (F.col("line") == F.col("f.line")), F.coalesce("reset_5h", "fill")).otherwise(F.col("reset_5h")).alias("reset_5h")
    )


def idle_gap(rows: DataFrame, limit: int = 3590) -> DataFrame:
    """Seconds since the last reply, for prompts that come ``limit`` or more after it."""
    order = Window.partitionBy("sid").orderBy("ts_s", "line").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == "reply", F.col("ts_s")), ignorenulls=True).over(order)
    return rows.withColumn("idle", F.col("ts_s") - last).where("kind = 'prompt' and idle >= %d" % limit)


def idle_turn_cost(rows: DataFrame, gap: int = 60, key: str = "sid") -> DataFrame:
    """Running cost within a stretch of calls at most ``gap`` seconds apart."""
    order = Window.partitionBy(key).orderBy("ts_s", "line")
    fresh = F.coalesce(F.col("ts_s") - F.lag("ts_s").over(order) > gap, F.lit(True)).cast("int")
    part = rows.withColumn("_fresh", fresh).withColumn("turn", F.sum("_fresh").over(order)).drop("_fresh")
    return part.withColumn("turn_cost_e8", F.sum("cost_e8").over(Window.partitionBy(key, "turn").orderBy("ts_s", "line")))


def in_burn_runs(samples: DataFrame, keys: list[str], pause: int = 7200, drop: float = 8.0, ahead: int = 3) -> DataFrame:
    """Adds run. A run ends at a pause of more than ``pause`` seconds, or at a fall of more than ``drop`` points that
    is confirmed: none of the next ``ahead`` readings comes back to within ``drop`` of the value before."""
    order = Window.partitionBy(*keys).orderBy("ts_s", "line")
    before = F.lag("used_percent").over(order)
    highest = F.max("used_percent").over(order.rowsBetween(0, ahead))
    marked = samples.withColumns({"_pause": F.col("ts_s") - F.lag("ts_s").over(order), "_fall": before - F.col("used_percent"), "_stays": highest < before - drop})
    fresh = F.col("_pause").isNull() | (F.col("_pause") > pause) | ((F.col("_fall") > drop) & F.col("_stays"))
    marked = marked.withColumn("_fresh", fresh.cast("int"))
    return marked.withColumn("run", F.sum("_fresh").over(order)).drop("_pause", "_fall", "_stays", "_fresh")


def burn_runs(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The runs with their times, readings, first and highest value."""
    at = F.struct("ts_s", "line")
    return in_burn_runs(samples, keys).groupBy(*keys, "run").agg(
        F.min("ts_s").alias("start"), F.max("ts_s").alias("end"), F.count(F.lit(1)).alias("readings"), F.min_by("used_percent", at).alias("first"), F.max("used_percent").alias("top")
    )


def burn_intervals(samples: DataFrame, keys: list[str], points: float = 5.0) -> DataFrame:
    """On the upper envelope of a run (W24) an interval is cut each time ``points`` have come together."""
    marked = in_burn_runs(samples, keys)
    within = Window.partitionBy(*keys, "run").orderBy("ts_s", "line")
    top = marked.withColumn("top", F.max("used_percent").over(within)).groupBy(*keys, "run", "top").agg(F.min("ts_s").alias("at"))
    steps = top.groupBy(*keys, "run").agg(F.array_sort(F.collect_list(F.struct("top", "at"))).alias("s"))
    cuts = F.aggregate(
        "s",
        F.array().cast("array<struct<top:double,at:bigint>>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x["top"] - F.element_at(acc, -1)["top"] >= points), F.concat(acc, F.array(x))).otherwise(acc),
    )
    # few steps in a run: the reading has at most a hundred values
    cut = steps.select(*keys, "run", F.posexplode(cuts).alias("n", "c"))
    after = Window.partitionBy(*keys, "run").orderBy("n")
    return cut.select(*keys, "run", F.col("c.at").alias("start"), F.lead("c.at").over(after).alias("end"), (F.lead("c.top").over(after) - F.col("c.top")).alias("rise")).where("end is not null")


def points_per_dollar(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """M3: one slope through the origin for each group: sum(xy) / sum(xx), x in dollars."""
    x = F.col("cost_e8") / 1e8
    return intervals.groupBy(*keys).agg(F.round(F.sum(x * F.col("rise")) / F.sum(x * x), 9).alias("points_per_usd"), F.count(F.lit(1)).alias("n"))


def foreign_usage_filter(intervals: DataFrame, most: float = 1.0) -> DataFrame:
    """Intervals that rise more than ``most`` points a dollar were not caused by these calls alone."""
    return intervals.where((F.col("cost_e8") > 0) & (F.col("rise") <= most * F.col("cost_e8") / 1e8))


def drop_near_resets(windows: DataFrame, resets: DataFrame, near: int = 3600) -> DataFrame:
    """Windows that start within ``near`` seconds of an announced reset go. Resets are given to the buckets of time
    around them, so the join is by equality and neither side has to be small."""
    bucket = lambda t: F.floor(t / max(near, 1)).cast("long")
    spread = resets.select("reset", F.explode(F.expr("sequence(-1, 1)")).alias("_d")).select("reset", (bucket(F.col("reset")) + F.col("_d")).alias("_bucket"))
    left = windows.withColumn("_at", bucket(F.col("start")))
    close = (left["_at"] == spread["_bucket"]) & (F.abs(left["start"] - spread["reset"]) <= near)
    return left.join(spread, close, "left_anti").drop("_at")


def exclude_event_days(windows: DataFrame, days: DataFrame, start: str = "start") -> DataFrame:
    """M4: windows that start on a day (since 1970) with an announced event go before a rate is fitted."""
    dated = windows.withColumn("_day", F.floor(F.col(start) / 86400).cast("long"))
    return dated.join(days.select(F.col("day").cast("long").alias("_day")).distinct(), "_day", "left_anti").select(*windows.columns)


def limit_ratio(windows: DataFrame, period: str) -> DataFrame:
    """Sum of short rises over sum of long rises, not the mean of ratios."""
    return windows.groupBy(period).agg(F.sum("rise_5h").alias("rise_5h"), F.sum("rise_7d").alias("rise_7d"), F.count(F.lit(1)).alias("windows")).withColumn("ratio", F.round(F.col("rise_5h") / F.col("rise_7d"), 6))


def gram_matrix(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """M1: X'X and X'y in one aggregate: i, j, value (j = -1 is the target)."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))] + [(i, -1) for i in range(len(features))]
    right = lambda j: F.col(target if j < 0 else features[j]).cast("double")
    sums = rows.agg(*[F.sum(F.col(features[i]).cast("double") * right(j)).alias(f"s{i}_{j if j >= 0 else 'y'}") for i, j in pairs])
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j if j >= 0 else 'y'}").alias("value")) for i, j in pairs]))
    return sums.select(cells.alias("c")).select("c.*")


def fit_nonneg(rows: DataFrame, features: list[str], target: str, steps: int = 20_000) -> dict[str, float]:
    """M1: non-negative least squares from the Gram matrix (features squared numbers meet on the driver, no rows)."""
    import numpy as np

    k = len(features)
    a, b = np.zeros((k, k)), np.zeros(k)
    for r in gram_matrix(rows, features, target).collect():
        if r["j"] < 0:
            b[r["i"]] = r["value"] or 0.0
        else:
            a[r["i"], r["j"]] = a[r["j"], r["i"]] = r["value"] or 0.0
    size = np.sqrt(np.maximum(np.diag(a), 1e-30))
    a, b = a / np.outer(size, size), b / size
    x, step = np.zeros(k), 1 / max(np.linalg.eigvalsh(a).max(), 1e-30)
    for _ in range(steps):
        new = np.maximum(x - step * (a @ x - b), 0)
        if np.abs(new - x).max() < 1e-13:
            break
        x = new
    return dict(zip(features, (x / size).tolist(), strict=True))


def hypothesis_errors(rows: DataFrame, predictions: dict[str, str], target: str) -> DataFrame:
    """M2: for each hypothesis (a SQL expression) the median error and the shares within 2 and 3 points."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("hypothesis"), F.abs(F.expr(e) - F.col(target)).alias("error")) for n, e in predictions.items()]))
    err = rows.select(each.alias("e")).select("e.*")
    share = lambda x: F.round(100.0 * F.avg((F.col("error") <= x).cast("int")), 4)
    return err.groupBy("hypothesis").agg(F.round(F.median("error"), 6).alias("median_error"), share(2).alias("within_2"), share(3).alias("within_3"))
