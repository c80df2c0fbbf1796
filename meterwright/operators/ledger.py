"""The ledger of billed calls: one row per request, copies counted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS = ("input", "cc", "cc5m", "cc1h", "cr", "out")


def last_chunk_per_request(rows: DataFrame) -> DataFrame:
    """A1: of the streamed chunks of one request in one file, the last line; rows without a request stay."""
    known = rows.where("req is not null and req <> ''")
    other = [c for c in rows.columns if c not in ("sid", "req")]
    last = known.groupBy("sid", "req").agg(F.max_by(F.struct(*other), "line").alias("last"))
    return last.select("sid", "req", "last.*").select(*rows.columns).unionByName(rows.where("req is null or req = ''"))


def drop_parent_replays(rows: DataFrame) -> DataFrame:
    """An agent's row goes if its parent session has the same request.

    A session's rows and its agents' rows of one request meet in one small
    group, so the rows are read once; rows without a request (null or blank) all stay and are dealt by line.
    """
    unknown = F.coalesce(F.col("req"), F.lit("")) == ""
    request = Window.partitionBy(F.coalesce("parent", "sid"), "req", F.when(unknown, F.col("line")))
    in_main = F.coalesce(F.max(F.col("parent").isNull()).over(request), F.lit(False))
    return rows.withColumn("_in_main", in_main).where(F.col("parent").isNull() | unknown | ~F.col("_in_main")).drop("_in_main")


def count_request_once(rows: DataFrame) -> DataFrame:
    """A4: a request belongs to the session that starts first (ties: by id); rows without a request all stay."""
    start = rows.groupBy(F.col("sid").alias("_sid")).agg(F.min("ts_s").alias("start"))
    unknown = F.coalesce(F.col("req"), F.lit("")) == ""
    # rows without a request are dealt by session and line, and none of them goes
    first = Window.partitionBy("req", F.when(unknown, F.struct("sid", "line"))).orderBy("start", "sid", "ts_s", "line")
    owned = rows.join(start, F.col("sid").eqNullSafe(F.col("_sid")), "left").withColumn("nth", F.row_number().over(first))
    return owned.where(unknown | (F.col("nth") == 1)).select(*rows.columns)


def rows_since(rows: DataFrame, cutoff_s: int) -> DataFrame:
    """To be used after the copies are settled."""
    return rows.where(F.col("ts_s") >= cutoff_s)


def drop_synthetic(rows: DataFrame) -> DataFrame:
    """Rows that no model was billed for."""
    return rows.where("model is null or model <> '<synthetic>'")


def cache_tiers(rows: DataFrame) -> DataFrame:
    """A write that is not split into tiers counts as the one-hour tier."""
    unsplit = (F.coalesce("cc5m", F.lit(0)) + F.coalesce("cc1h", F.lit(0)) == 0) & (F.coalesce("cc", F.lit(0)) > 0)
    return rows.withColumns({"cc5m": F.coalesce("cc5m", F.lit(0)), "cc1h": F.when(unsplit, F.col("cc")).otherwise(F.coalesce("cc1h", F.lit(0)))})


def all_tokens() -> Column:
    """usage_tokens."""
    return F.col("input") + F.col("cc") + F.col("cr") + F.col("out")


def context_tokens() -> Column:
    """what the call had in context."""
    return F.col("input") + F.col("cc") + F.col("cr")


def token_sums(*more: Column) -> list[Column]:
    return [*[F.sum(c).alias(c) for c in TOKENS], F.sum("cost_e8").alias("cost_e8"), *more]


def session_summary(rows: DataFrame) -> DataFrame:
    """A2: first and last time, calls, tokens and cost of every session."""
    return rows.groupBy("sid").agg(
        F.min("ts_s").alias("first_ts"), F.max("ts_s").alias("last_ts"), F.count(F.lit(1)).alias("calls"), *token_sums()
    )


def agent_effective_totals(rows: DataFrame) -> DataFrame:
    """A3: agents' totals without what they replay of their parents."""
    return drop_parent_replays(rows).where("parent is not null").groupBy("parent", "sid").agg(F.count(F.lit(1)).alias("calls"), *token_sums())


def token_breakdown(rows: DataFrame) -> DataFrame:
    """A5: tokens and cost of each component, in long form; needs the rates on the rows."""
    parts = {"input": "r_input", "cc5m": "r_cc5m", "cc1h": "r_cc1h", "cr": "r_cr", "out": "r_out"}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("tokens"), (F.col(c) * F.col(r)).alias("cost_e8")) for c, r in parts.items()]))
    return rows.select(each.alias("x")).select("x.*").groupBy("component").agg(F.sum("tokens").alias("tokens"), F.sum("cost_e8").alias("cost_e8"))


def report_summary(rows: DataFrame) -> DataFrame:
    """Totals, sessions and calendar days of the period."""
    day = F.to_date(F.timestamp_seconds("ts_s"))
    return rows.agg(
        F.sum("cost_e8").alias("cost_e8"),
        F.sum(all_tokens()).alias("tokens"),
        F.count(F.lit(1)).alias("calls"),
        F.count_distinct("sid").alias("sessions"),
        (F.datediff(F.max(day), F.min(day)) + 1).cast("long").alias("calendar_days"),
    )


def on_day():
    return F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd").alias("day")


def daily_cost(rated: DataFrame) -> DataFrame:
    """The day's cost by component, of calls with their rates (r_<component>)."""
    part = lambda *cs: F.sum(sum((F.col(c) * F.col(f"r_{c}") for c in cs), F.lit(0)))
    return rated.groupBy(on_day()).agg(
        F.sum("cost_e8").alias("cost_e8"), part("input").alias("input_e8"), part("cc5m", "cc1h").alias("write_e8"), part("cr").alias("read_e8"), part("out").alias("output_e8")
    )


def daily_tokens(rows: DataFrame) -> DataFrame:
    """The day's tokens and calls."""
    return rows.groupBy(on_day()).agg(F.sum(all_tokens()).alias("tokens"), F.count(F.lit(1)).alias("calls"))


def union_ledger(calls: DataFrame, **events: DataFrame) -> DataFrame:
    """Calls and events (by kind) as one stream of rows; events carry no cost and no tokens."""
    out = calls.select("sid", "ts_s", "line", F.lit("call").alias("kind"), "cost_e8", "input")
    for kind, rows in events.items():
        out = out.unionByName(rows.select("sid", "ts_s", "line", F.lit(kind).alias("kind")), allowMissingColumns=True)
    return out.fillna(0, ["cost_e8", "input"])


def vanished(before: DataFrame, known: DataFrame) -> DataFrame:
    """Sessions of one listing that are not in the other."""
    return before.select("sid").distinct().join(known.select("sid"), "sid", "left_anti")


def primary_model(rows: DataFrame) -> DataFrame:
    """The model with most calls of a session; the one seen first wins a tie."""
    per = rows.groupBy("sid", "model").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))
    return per.groupBy("sid").agg(F.max_by("model", F.struct("n", -F.col("first_line"))).alias("model"))


def union_hosts(first: DataFrame, codex: DataFrame) -> DataFrame:
    """Cumulative-counter rows under the ledger's schema: cached input is a read, writes are the one-hour tier, cost is unknown."""
    as_rows = codex.select(
        F.lit("codex").alias("host"),
        "sid",
        F.lit(None).cast("string").alias("parent"),
        "ts_s",
        "model",
        F.greatest(F.col("input") - F.col("cached"), F.lit(0)).alias("input"),
        F.col("cache_write").alias("cc"),
        F.lit(0).cast("long").alias("cc5m"),
        F.col("cache_write").alias("cc1h"),
        F.col("cached").alias("cr"),
        F.col("output").alias("out"),
        F.lit(0).cast("long").alias("cost_e8"),
        F.lit(True).alias("cost_unknown"),
    )
    return first.withColumn("cost_unknown", F.lit(False)).unionByName(as_rows, allowMissingColumns=True)
