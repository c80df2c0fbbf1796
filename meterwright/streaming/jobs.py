"""Stateful streams: limit logs, running costs, counters, arming and idle guards.

State lives per key in a value store; one small processor folds the rows of a
micro-batch, in order of time and line, through a step function.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.lines import tail_lines


class Fold(StatefulProcessor):
    """Folds each key's rows through ``step(state, row) -> (state, [output rows])``.

    With ``idle`` a timer fires that many milliseconds of event time after the
    last row that ``arms`` names, and ``on_idle(state)`` gives the outputs.
    """

    def __init__(self, key: str, columns: list[str], step: Callable, idle: int | None = None, arms: Callable | None = None, on_idle: Callable | None = None):
        self.key, self.columns, self.step, self.idle, self.arms, self.on_idle = key, columns, step, idle, arms, on_idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        out, last = [], None
        for row in pd.concat(list(rows)).sort_values(["ts_s", "line"]).to_dict("records"):
            state, new = self.step(state, row)
            out += new
            if self.arms and self.arms(row):
                last = row["ts_s"]
        self.state.update((json.dumps(state, default=float),))
        if self.idle is not None and last is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(last) * 1000 + self.idle)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=[self.key, *self.columns])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        yield pd.DataFrame([(key[0], *x) for x in self.on_idle(state)], columns=[self.key, *self.columns])

    def close(self) -> None:
        pass


def folded(rows: DataFrame, key: str, schema: str, step: Callable, time_mode: str = "none", **timer) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")][1:]
    return rows.groupBy(key).transformWithStateInPandas(Fold(key, columns, step, **timer), schema, "append", time_mode)


def limit_log_stream(log: DataFrame) -> DataFrame:
    """Readings that changed, resets written on change only, and crossings of 70 and 90."""

    def step(state, row):
        pct, reset = float(row["pct_5h"]), row["reset_5h"]
        reset = None if reset is None or reset != reset else int(reset)
        if state.get("pct") == pct:
            return state, []
        was = state.get("pct", 0.0)
        alert = "danger" if pct >= 90 > was else "warn" if pct >= 70 > was else None
        written = reset if reset is not None and reset != state.get("reset") else None
        return {"pct": pct, "reset": reset if reset is not None else state.get("reset")}, [(row["line"], row["ts_s"], pct, written, alert)]

    return folded(log, "sid", "sid string, line long, ts_s long, pct_5h double, reset_5h long, alert string", step)


def counter_delta_stream(counters: DataFrame) -> DataFrame:
    """The stream twin of W9 for one component: total and last may be null."""

    def step(state, row):
        number = lambda x: None if x is None or x != x else max(int(x), 0)
        total, last = number(row["total"]), number(row["last"])
        base, gap = state.get("base"), state.get("gap", False)
        if total is None:
            delta, why = (0, "missing_total_suppressed") if gap else (last or 0, "missing_total_fallback")
            return {"base": base, "gap": True}, [(row["line"], delta, why)]
        fresh = base is None or total < base
        delta = min(total if last is None else last, total) if fresh else total - base
        return {"base": total, "gap": False}, [(row["line"], delta, "counter_reset" if fresh and base is not None else None)]

    return folded(counters, "sid", "sid string, line long, delta long, diagnostic string", step)


def stale_sample_filter(samples: DataFrame, key: str = "window") -> DataFrame:
    """A reading not above the highest one of its window is late data."""

    def step(state, row):
        used = float(row["used_percent"])
        if used <= state.get("top", -1.0):
            return state, []
        return {"top": used}, [(row["line"], row["ts_s"], used)]

    return folded(samples, key, f"{key} string, line long, ts_s long, used_percent double", step)


def context_arm_stream(contexts: DataFrame, fire: float = 0.95, rearm: float = 0.5, tries: int = 3) -> DataFrame:
    """Fires once when the context passes 95 % of the threshold, arms again below 50 %, up to three times."""

    def step(state, row):
        share = row["context"] / row["threshold"]
        armed, fired = state.get("armed", True), state.get("fired", 0)
        if armed and share >= fire and fired < tries:
            return {"armed": False, "fired": fired + 1}, [(row["line"], row["ts_s"], fired + 1)]
        return {"armed": armed or share < rearm, "fired": fired}, []

    return folded(contexts, "sid", "sid string, line long, ts_s long, n long", step)


def idle_guard_stream(rows: DataFrame, idle: int = 3590) -> DataFrame:
    """One event per idle period: a timer of event time after the last reply. Needs a watermark on ``ts``."""

    def step(state, row):
        return ({"last": int(row["ts_s"]), "line": int(row["line"])} if row["kind"] == "reply" else state), []

    def on_idle(state):
        return [(state["line"], state["last"] + idle)] if "last" in state else []

    return folded(rows, "sid", "sid string, line long, idle_at long", step, "EventTime", idle=idle * 1000, arms=lambda r: r["kind"] == "reply", on_idle=on_idle)


def turn_cost_stream(calls: DataFrame, gap: str = "61 seconds", late: str = "10 minutes") -> DataFrame:
    """Cost of stretches of calls at most 60 seconds apart (a session window merges gaps below its length)."""
    return calls.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "sid").agg(F.sum("cost_e8").alias("cost_e8"), F.count(F.lit(1)).alias("calls"))


def running_turn_cost_stream(calls: DataFrame, gap: int = 60) -> DataFrame:
    """Each call with the running cost of its stretch, while the stretch is still open. Calls of a session come in order, as in its log."""

    def step(state, row):
        now = int(row["ts_s"])
        fresh = "last" not in state or now - state["last"] > gap
        turn, cost = state.get("turn", 0) + fresh, (0 if fresh else state["cost"]) + int(row["cost_e8"])
        return {"last": now, "turn": turn, "cost": cost}, [(row["line"], now, turn, cost)]

    return folded(calls, "sid", "sid string, line long, ts_s long, turn long, turn_cost_e8 long", step)


class SessionStart(StatefulProcessor):
    """Gives a session's rows the session's start. A row waits until the watermark has passed it: then all rows before it are there."""

    COLUMNS = ["sid", "req", "ts_s", "line", "start", "payload", "due"]
    SCHEMA = "sid string, req string, ts_s long, line long, start long, payload string, due timestamp"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "start long")
        self.waiting = handle.getListState("waiting", "req string, ts_s long, line long, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = self.start.get()[0] if self.start.exists() else None
        for some in rows:
            self.waiting.appendList([(r.req, int(r.ts_s), int(r.line), r.payload) for r in some.itertuples(index=False)])
            first = int(some["ts_s"].min())
            start = first if start is None else min(start, first)
            for ts in some["ts_s"].unique():
                self.handle.registerTimer(int(ts) * 1000)
        self.start.update((start,))
        yield pd.DataFrame(columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        ready, later = [r for r in rows if r[1] * 1000 <= now], [r for r in rows if r[1] * 1000 > now]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        start, due = self.start.get()[0], pd.Timestamp(now + 1, unit="ms")
        yield pd.DataFrame([(key[0], req, ts, line, start, payload, due) for req, ts, line, payload in ready], columns=self.COLUMNS)

    def close(self) -> None:
        pass


class RequestOwner(StatefulProcessor):
    """Of a request's copies the one of the session that starts first. Sessions are kept by id until the timer fires;
    ``hold`` milliseconds after that the request is forgotten, and copies until then go."""

    def __init__(self, hold: int):
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.copies = handle.getMapState("copies", "sid string", "start long, ts_s long, line long, payload string")
        self.settled = handle.getValueState("settled", "settled boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.settled.exists():
            for some in rows:
                for r in some.itertuples(index=False):
                    own, new = (r.sid or "",), (int(r.start), int(r.ts_s), int(r.line), r.payload)
                    if not self.copies.containsKey(own) or new[1:3] < tuple(self.copies.getValue(own))[1:3]:
                        self.copies.updateValue(own, new)
                    if not list(self.handle.listTimers()):
                        self.handle.registerTimer(max(int(r.ts_s) * 1000, timerValues.getCurrentWatermarkInMs()) + self.hold)
        yield pd.DataFrame(columns=["req", "payload"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.settled.exists():
            self.settled.clear()
        else:
            best = min((tuple(v)[0], tuple(k)[0], *tuple(v)[1:]) for k, v in self.copies.iterator())
            out = [(key[0], best[-1])]
            self.copies.clear()
            self.settled.update((True,))
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.hold)
        yield pd.DataFrame(out, columns=["req", "payload"])

    def close(self) -> None:
        pass


def request_once_stream(calls: DataFrame, late: str = "1 hour", hold_s: int = 3600) -> DataFrame:
    """Of a request's copies the one of the session that starts first (ties by id, time, line), as A4 has it in batch.

    ``calls`` has ts (timestamp), sid, req, ts_s, line. Rows may be ``late`` behind; a request is settled ``hold_s``
    seconds after its first copy, and copies that come after twice that are new requests. Rows without a request all stay.
    """
    marked = calls.withWatermark("ts", late)
    known = F.coalesce(F.col("req"), F.lit("")) != ""
    light = marked.where(known).select("ts", "sid", "req", "ts_s", "line", F.to_json(F.struct(*calls.columns)).alias("payload"))
    started = light.groupBy("sid").transformWithStateInPandas(SessionStart(), SessionStart.SCHEMA, "append", "EventTime", eventTimeColumnName="due")
    owned = started.groupBy("req").transformWithStateInPandas(RequestOwner(hold_s * 1000), "req string, payload string", "append", "EventTime")
    return owned.select(F.from_json("payload", calls.schema).alias("c")).select("c.*").unionByName(calls.where(~known))


def first_copy_stream(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first copy of each request to arrive, at once; who owns it is not asked."""
    return calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["req"])


def hourly_usage_stream(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Cost and tokens per hour, each hour once it is closed."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.sum("cost_e8").alias("cost_e8"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"))


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Reads what is unread since the checkpoint, writes it, and gives the whole output table."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


LINES, CURSORS = "path string, line_no long, raw string, batch long", "path string, lines long, batch long"


def ledger_append_stream(spark: SparkSession, patterns: list[str], out: str, checkpoint: str, split: int | None = None) -> None:
    """Appends to ``out/lines`` the lines (path, line_no, raw) that were added to the files since the last run.

    The source's offsets say which bytes a batch has; ``out/cursors`` says how many lines each file had after it. Both
    outputs of a batch go to folders of its number, which a batch that is run again overwrites: no line comes twice, whenever a run is stopped.
    """

    def append(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = session.createDataFrame([], CURSORS)
        if number:
            known = session.read.schema(CURSORS).parquet(f"{out}/cursors").where(F.col("batch") < number)
        before = known.groupBy("path").agg(F.max("lines").alias("before"))
        order = Window.partitionBy("path").orderBy("byte")
        nth = F.row_number().over(order) + F.coalesce("before", F.lit(0))
        lines = batch.join(before, "path", "left").select("path", nth.cast("long").alias("line_no"), "raw")
        lines.write.mode("overwrite").parquet(f"{out}/lines/batch={number}")
        done = session.read.parquet(f"{out}/lines/batch={number}").groupBy("path").agg(F.max("line_no").alias("lines"))
        done.write.mode("overwrite").parquet(f"{out}/cursors/batch={number}")

    query = tail_lines(spark, patterns, split).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def appended_lines(spark: SparkSession, out: str) -> DataFrame:
    """What ``ledger_append_stream`` has written, without blank lines."""
    return spark.read.schema(LINES).parquet(f"{out}/lines").where("raw <> ''").drop("batch")
