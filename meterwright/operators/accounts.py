"""Accounts as a slowly changing dimension of the sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import last_before

#: Changes up to which the search over all sessions is a broadcast range join.
FEW_CHANGES = 100_000
#: Days of which each gets its own task in the search over all sessions.
DAY = 86400


def account_changes(rows: DataFrame) -> DataFrame:
    """Only real switches of a session stay."""
    before = F.lag("account").over(Window.partitionBy("sid").orderBy("ts_s", "line"))
    return rows.withColumn("before", before).where("before is null or before <> account").drop("before")


def account_in_session(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """The last change of the row's session at or before its time; an agent's row uses its parent's session."""
    keyed = rows.withColumn("_key", F.coalesce("parent", "sid"))
    named = changes.select(F.col("sid").alias("_key"), F.col("ts_s").alias("_at"), "account", "line")
    return last_before(keyed, named, ["_key"], "ts_s", "_at", {"account": "own_account"}, ["line"]).drop("_key")


def account_anywhere(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """The last change of any session at or before the row's time.

    There is no key to part by, so the rows are parted by day: each day up to
    the last one with a change starts with the last change before it. Later rows
    have the last change of all.
    """
    day = lambda c: F.floor(F.col(c) / DAY)
    marks = changes.select(day("ts_s").alias("_day"), F.col("ts_s").alias("_at"), "account", "line")
    ends = marks.groupBy("_day").agg(F.max_by("account", F.struct("_at", "line")).alias("account"))
    # one row a day with a change goes through this window
    until = ends.withColumn("_next", F.lead("_day").over(Window.orderBy("_day"))).where("_next is not null")
    carried = until.select(F.explode(F.sequence(F.col("_day") + 1, F.col("_next"))).alias("_day"), "account")
    carried = carried.select("_day", (F.col("_day") * DAY - 1).alias("_at"), "account", F.lit(-1).cast("long").alias("line"))
    last = F.broadcast(changes.agg(F.max(day("ts_s")).alias("_last_day"), F.max_by("account", F.struct("ts_s", "line")).alias("_last")))  # one row
    keyed = rows.withColumn("_day", day("ts_s"))
    held = last_before(keyed, marks.unionByName(carried), ["_day"], "ts_s", "_at", {"account": "any_account"}, ["line"]).crossJoin(last)
    later = F.when(F.col("_day") > F.col("_last_day"), F.col("_last"))
    return held.withColumn("any_account", F.coalesce("any_account", later)).drop("_day", "_last_day", "_last")


def assign_account(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """J4, then J5, then the current login (the last change of all)."""
    current = F.broadcast(changes.agg(F.max_by("account", F.struct("ts_s", "line")).alias("current")))  # one row
    known = account_anywhere(account_in_session(rows, changes), changes).crossJoin(current)
    return known.withColumn("account", F.coalesce("own_account", "any_account", "current")).drop("own_account", "any_account", "current")


def account_totals(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Sums per account, and which one is logged in."""
    current = F.broadcast(changes.agg(F.max_by("account", F.struct("ts_s", "line")).alias("current")))
    per = rows.groupBy("account").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("sid").alias("sessions"), F.sum("cost_e8").alias("cost_e8"), F.max("ts_s").alias("last_ts"))
    return per.crossJoin(current).withColumn("is_current", F.col("account") == F.col("current")).drop("current")
