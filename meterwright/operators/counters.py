"""Cumulative counters turned into deltas, and limit samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counter_delta(rows: DataFrame, components: list[str], keys: list[str] = ("sid",), order: str = "line") -> DataFrame:
    """Deltas of ``total`` (a struct of components, or null) with ``last`` as fallback.

    A valid total is measured against the last valid one; if any component fell,
    or there was none, it is a fresh start. A row without a total counts its
    ``last`` once per gap. Adds delta_<component> and diagnostic.
    """
    ordered = Window.partitionBy(*keys).orderBy(order)
    total = lambda c: F.greatest(F.coalesce(F.col(f"total.{c}"), F.lit(0)), F.lit(0))
    last = lambda c: F.greatest(F.col(f"last.{c}"), F.lit(0))
    clean = F.when(F.col("total").isNotNull(), F.struct(*[total(c).alias(c) for c in components]))
    rows = rows.withColumn("_total", clean)
    rows = rows.withColumn("_base", F.last("_total", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_after", F.lag(F.col("total").isNotNull()).over(ordered))
    fell = F.lit(False)
    for c in components:
        fell = fell | (F.col(f"_total.{c}") < F.col(f"_base.{c}"))
    fresh = F.col("_base").isNull() | fell
    first_of_gap = F.coalesce(F.col("_after"), F.lit(True))

    def delta(c):
        started = F.least(F.coalesce(last(c), F.col(f"_total.{c}")), F.col(f"_total.{c}"))
        valid = F.when(fresh, started).otherwise(F.col(f"_total.{c}") - F.col(f"_base.{c}"))
        return F.when(F.col("_total").isNotNull(), valid).when(first_of_gap, F.coalesce(last(c), F.lit(0))).otherwise(0)

    diagnostic = (
        F.when(F.col("_total").isNotNull() & F.col("_base").isNotNull() & fell, "counter_reset")
        .when(F.col("_total").isNull() & first_of_gap, "missing_total_fallback")
        .when(F.col("_total").isNull(), "missing_total_suppressed")
    )
    return rows.withColumns({**{f"delta_{c}": delta(c) for c in components}, "diagnostic": diagnostic}).drop("_total", "_base", "_after")


def delta_row(rows: DataFrame) -> DataFrame:
    """Fresh input, and what is odd about the row."""
    over = F.col("delta_cached") > F.col("delta_input")
    return rows.withColumns(
        {"fresh": F.greatest(F.col("delta_input") - F.col("delta_cached"), F.lit(0)), "diagnostics": F.array_compact(F.array(F.when(over, "cached_exceeds_input"), F.col("diagnostic")))}
    )


def filled(rows: DataFrame, column: str, keys: list[str] = ("sid",), order: str = "line") -> DataFrame:
    """The last known value, carried over the rows after it."""
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def sparse(rows: DataFrame, column: str, keys: list[str] = ("sid",), order: str | list[str] = "line") -> DataFrame:
    """A value is written only where it changes."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_before", before).withColumn(column, F.when(~F.col(column).eqNullSafe(F.col("_before")), F.col(column))).drop("_before")


def session_totals(rows: DataFrame, components: list[str]) -> DataFrame:
    """The deltas of a session added up."""
    return rows.groupBy("sid").agg(*[F.sum(f"delta_{c}").alias(c) for c in components], F.count(F.lit(1)).alias("rows"))


def merge_limit_samples(samples: DataFrame) -> DataFrame:
    """Re-emitted samples collapse; one logical window over several sessions keeps the newest percent; samples without a limit stay apart by session."""
    seen = samples.dropDuplicates(["sid", "limit_id", "lane", "window_minutes", "resets_at", "ts_s", "used_percent"])
    owner = F.when(F.col("limit_id").isNull(), F.col("sid"))
    return seen.withColumn("owner", owner).groupBy("limit_id", "owner", "lane", "window_minutes", "resets_at").agg(
        F.max_by("used_percent", F.struct("ts_s", "line", "sid")).alias("used_percent"), F.max("ts_s").alias("ts_s"), F.count_distinct("sid").alias("sessions")
    )


def canonical_limits(samples: DataFrame) -> DataFrame:
    """The newest valid sample of every lane."""
    newest = Window.partitionBy("limit_id", "lane").orderBy(F.col("ts_s").isNotNull().desc(), F.desc("ts_s"), F.desc("line"), F.desc("sid"))
    return samples.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def longest_lane(samples: DataFrame) -> DataFrame:
    """A40."""
    return samples.groupBy("limit_id").agg(F.max_by("lane", F.struct("window_minutes", "lane")).alias("lane"), F.max("window_minutes").alias("window_minutes"))


def credit_equivalent(rows: DataFrame, card: DataFrame, credits_per_usd: float) -> DataFrame:
    """Rows (model, fresh, cached, output, written) priced by a card (id, fresh, cached, output): one row.

    Credits are exact when every model with tokens has a price, a lower bound
    when some have, unavailable when none has. The card has a few dozen rows.
    """
    ok = credits_per_usd is not None and credits_per_usd > 0 and credits_per_usd != float("inf")
    named = F.broadcast(card.select(F.col("id").alias("model"), *[F.col(c).alias(f"c_{c}") for c in ("fresh", "cached", "output")]))
    per = rows.withColumn("model", F.coalesce(F.when(F.trim("model") != "", F.col("model")), F.lit("unknown"))).groupBy("model").agg(*[F.sum(c).alias(c) for c in ("fresh", "cached", "output", "written")])
    per = per.withColumn("eligible", F.col("fresh") + F.col("cached") + F.col("output")).join(named, "model", "left")
    credits = (F.col("fresh") * F.col("c_fresh") + F.col("cached") * F.col("c_cached") + F.col("output") * F.col("c_output")) / 1e6
    priced = F.col("c_fresh").isNotNull()
    out = per.agg(
        F.coalesce(F.sum(F.when(priced, credits)), F.lit(0.0)).alias("credits"),
        F.coalesce(F.sum("eligible"), F.lit(0)).alias("eligible"),
        F.coalesce(F.sum(F.when(priced, F.col("eligible"))), F.lit(0)).alias("covered"),
        F.coalesce(F.sum("written"), F.lit(0)).alias("written"),
        F.array_sort(F.collect_set(F.when(~priced & (F.col("eligible") > 0), F.col("model")))).alias("unpriced"),
    )
    reason = F.when(F.lit(not ok), "invalid_config").when(F.col("eligible") == 0, "no_eligible_tokens").when(F.col("covered") == 0, "no_priced_models")
    status = F.when(reason.isNotNull(), "unavailable").when(F.size("unpriced") > 0, "lower_bound").otherwise("exact")
    usable = F.when(reason.isNull(), F.col("credits"))
    return out.select(status.alias("status"), reason.alias("reason"), usable.alias("credits"), (usable / (credits_per_usd if ok else 1.0)).alias("usd"), "eligible", "covered", "written", "unpriced")
