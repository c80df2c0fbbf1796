"""Queries of the reports, limits and turns, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import limits, pricing, report, turns, windows
from . import adapter
from .adapter import accounted, settled, sql
from .ledger_queries import _rates, _windowed, wsql
from .text_queries import SAMPLES

ALL = "input + cc + cr + out"
DAY_SPLIT = 19723 + 15
EDGE = "edge AS (SELECT min(ts_s) AS t0, max(ts_s) AS t1, max(ts_s) // 86400 - min(ts_s) // 86400 + 1 AS n_days FROM settled)"
WIN = ["account"]


def _points(spark, d):
    return settled(spark, d).select((F.col("input") + F.col("cc") + F.col("cr")).cast("double").alias("x"), (F.col("cost_e8") / 1e6).alias("y"), "model", "req", "line", F.col("req").alias("text"))


def _users(spark, d):
    """Every tenth row of a session is a user line."""
    return adapter.usage(spark, d).where("line % 10 = 0").select("sid", "line").distinct()


def _tagged(spark, d):
    rows = turns.call_cost_band(turns.first_crossing(settled(spark, d), pricing.pricing_table(spark)))
    rows = rows.withColumn("evt", F.array_compact(F.array("cost_tag", "ctx_tag")))
    return rows


def _turned(spark, d):
    return turns.turn_aggregate(turns.row_to_turn(_tagged(spark, d), _users(spark, d)))


USERS = "users AS (SELECT DISTINCT sid, line AS user_line FROM raw_usage WHERE line % 10 = 0)"
CROSS = [
    "x1 AS (SELECT s.*, p.context_window, CASE WHEN s.cost_e8 <= 0 AND s.input <= 0 THEN 0 WHEN (s.input + s.cc + s.cr) / p.context_window::DOUBLE >= 0.70 THEN 2 WHEN (s.input + s.cc + s.cr) / p.context_window::DOUBLE >= 0.35 THEN 1 ELSE 0 END AS lvl FROM settled s JOIN prices p USING (model))",
    "x2 AS (SELECT *, coalesce(max(lvl) OVER (PARTITION BY sid ORDER BY ts_s, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x1)",
    "tagged AS (SELECT *, CASE WHEN lvl > before THEN CASE WHEN lvl = 2 THEN 'ctx_danger' ELSE 'ctx_warn' END END AS ctx_tag, CASE WHEN cost_e8 >= 100000000 THEN 'cost_danger' WHEN cost_e8 >= 50000000 THEN 'cost_warn' END AS cost_tag FROM x2)",
]
TURNED = [
    USERS,
    *CROSS,
    "t1 AS (SELECT t.*, u.user_line AS turn FROM tagged t ASOF LEFT JOIN users u ON t.sid = u.sid AND t.line >= u.user_line)",
    "turned AS (SELECT sid, turn, sum(input)::BIGINT AS input, sum(cc)::BIGINT AS cc, sum(cr)::BIGINT AS cr, sum(out)::BIGINT AS out, sum(cost_e8)::BIGINT AS cost_e8, count(*)::BIGINT AS calls, arg_min(input + cc + cr, line) AS first_context, max(input + cc + cr) AS peak_context, bool_or(coalesce(ctx_tag = 'ctx_danger', false)) AS ctx_danger, bool_or(coalesce(ctx_tag = 'ctx_warn', false)) AS ctx_warn FROM t1 WHERE turn IS NOT NULL AND (cost_e8 > 0 OR input > 0) GROUP BY sid, turn)",
]
LOG = "log AS (SELECT 's' || (user_id % 10) AS sid, ts_s, k::DOUBLE AS pct_5h, CASE WHEN event_id % 8 = 0 THEN (ts_s // 18000 + 1) * 18000 END AS reset_5h, event_id AS line FROM ev WHERE event_type = 'view')"
#: Limit windows of one lane, used for range joins.
JIT = [
    SAMPLES,
    "q1 AS (SELECT lane, resets_at, coalesce(resets_at - lag(resets_at) OVER (PARTITION BY lane ORDER BY resets_at) > 120, true)::INT AS fresh FROM (SELECT DISTINCT lane, resets_at FROM samples))",
    "q2 AS (SELECT *, sum(fresh) OVER (PARTITION BY lane ORDER BY resets_at) AS w FROM q1)",
    'q3 AS (SELECT lane, max(resets_at) AS "end", max(resets_at) - 18000 AS start FROM q2 GROUP BY lane, w)',
    'jit AS (SELECT *, least("end", lead(start) OVER (PARTITION BY lane ORDER BY start)) AS active_end FROM q3)',
]


def _long_lived(spark, d):
    return windows.jitter_windows(adapter.limit_samples(spark, d), ["lane"])


def _turns(spark, d):
    return adapter.turns(spark, d)


QUERIES = {
    "a17_hour_profile": (
        lambda s, d: report.hour_profile(settled(s, d)),
        sql(
            "SELECT h::BIGINT AS hour, coalesce(floor(total / days + 0.5)::BIGINT, 0) AS mean, coalesce(floor(most + 0.5)::BIGINT, 0) AS most, coalesce(floor(total / greatest(n_days - (h < t0 % 86400 // 3600)::INT - (h > t1 % 86400 // 3600)::INT, 1) + 0.5)::BIGINT, 0) AS calendar_mean FROM range(24) r(h) CROSS JOIN edge LEFT JOIN per ON per.hour = h",
            EDGE,
            "cell AS (SELECT ts_s // 86400 AS day, ts_s % 86400 // 3600 AS hour, sum(cost_e8)::DOUBLE AS v FROM settled GROUP BY ALL)",
            "per AS (SELECT hour, sum(v) AS total, max(v) AS most, count(*) AS days FROM cell GROUP BY hour)",
        ),
    ),
    "a18_dow_profile": (
        lambda s, d: report.dow_profile(settled(s, d)),
        sql(
            "SELECT w::BIGINT AS dow, coalesce(floor(total / weeks + 0.5)::BIGINT, 0) AS mean, coalesce(floor(most + 0.5)::BIGINT, 0) AS most, coalesce(floor(total / greatest(cal, 1) + 0.5)::BIGINT, 0) AS calendar_mean FROM range(7) r(w) LEFT JOIN per ON per.dow = w LEFT JOIN cal ON cal.dow = w",
            EDGE,
            "cell AS (SELECT (ts_s // 86400 + 4) % 7 AS dow, CASE WHEN (t0 // 86400 + 4) % 7 = (t1 // 86400 + 4) % 7 AND (ts_s // 86400 + 4) % 7 = (t0 // 86400 + 4) % 7 AND ts_s // 604800 = t0 // 604800 THEN t1 // 604800 ELSE ts_s // 604800 END AS week, sum(cost_e8)::DOUBLE AS v FROM settled, edge GROUP BY ALL)",
            "per AS (SELECT dow, sum(v) AS total, max(v) AS most, count(*) AS weeks FROM cell GROUP BY dow)",
            "cal AS (SELECT dow, CASE WHEN same AND dow = d0 AND n >= 2 THEN n - 1 ELSE n END AS cal FROM (SELECT (day + 4) % 7 AS dow, count(*) AS n, any_value((t0 // 86400 + 4) % 7 = (t1 // 86400 + 4) % 7) AS same, any_value((t0 // 86400 + 4) % 7) AS d0 FROM (SELECT unnest(range(t0 // 86400, t1 // 86400 + 1)) AS day, t0, t1 FROM edge) GROUP BY 1))",
        ),
    ),
    "a19_hour_tokens": (
        lambda s, d: report.hour_profile(settled(s, d).withColumn("tokens", F.expr(ALL)), "tokens", scale_edges=False).select("hour", "mean", "most"),
        sql("SELECT h::BIGINT AS hour, coalesce(floor(total / days + 0.5)::BIGINT, 0) AS mean, coalesce(floor(most + 0.5)::BIGINT, 0) AS most FROM range(24) r(h) LEFT JOIN per ON per.hour = h", f"cell AS (SELECT ts_s // 86400 AS day, ts_s % 86400 // 3600 AS hour, sum({ALL})::DOUBLE AS v FROM settled GROUP BY ALL)", "per AS (SELECT hour, sum(v) AS total, max(v) AS most, count(*) AS days FROM cell GROUP BY hour)"),
    ),
    "a20_context_buckets": (
        lambda s, d: report.context_buckets(settled(s, d)),
        sql("SELECT *, floor(100.0::DOUBLE * n / sum(n) OVER () * 100 + 0.5) / 100 AS share FROM (SELECT CASE WHEN x < 250000 THEN '<250K' WHEN x < 350000 THEN '250-350K' WHEN x < 500000 THEN '350-500K' ELSE '>500K' END AS bucket, count(*)::BIGINT AS n, sum(cost_e8)::BIGINT AS cost_e8 FROM (SELECT *, input + cc + cr AS x FROM settled) GROUP BY 1)"),
    ),
    "a21_dominant_component": (
        lambda s, d: report.dominant_component(_rates(s, d)),
        sql("SELECT CASE WHEN i = m THEN 'input' WHEN o = m THEN 'output' WHEN w = m THEN 'cacheCreate' ELSE 'cacheRead' END AS component, count(*)::BIGINT AS n FROM (SELECT *, greatest(i, o, w, c) AS m FROM (SELECT input * r_input AS i, out * r_out AS o, cc5m * r_cc5m + cc1h * r_cc1h AS w, cr * r_cr AS c FROM settled JOIN prices USING (model) WHERE input + cc + cr > 0)) GROUP BY 1"),
    ),
    "a22_grid_density": (
        lambda s, d: report.grid_density(_points(s, d), 20).select("cx", "cy", "n", "x", "radius", "model"),
        sql(
            "SELECT cx, cy, sum(n)::BIGINT AS n, round(sum(sx) / sum(n))::BIGINT AS x, CASE WHEN sum(n) <= 1 THEN 2 WHEN sum(n) <= 5 THEN 4 WHEN sum(n) <= 20 THEN 7 ELSE 10 END AS radius, arg_max(model, (n, model)) AS model FROM (SELECT floor((x - x0) / ((x1 - x0) / 20))::BIGINT AS cx, floor((y - y0) / ((y1 - y0) / 20))::BIGINT AS cy, model, count(*) AS n, sum(x) AS sx FROM p, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p) GROUP BY 1, 2, 3) GROUP BY cx, cy",
            "p AS (SELECT (input + cc + cr)::DOUBLE AS x, cost_e8 / 1e6::DOUBLE AS y, model FROM settled)",
        ),
    ),
    "a23_grid_by_model": (
        lambda s, d: report.grid_density(_points(s, d).withColumn("grp", F.col("model")), 10, ["grp"]).select("grp", "cx", "cy", "n"),
        sql(
            "SELECT p.model AS grp, floor((x - x0) / ((x1 - x0) / 10))::BIGINT AS cx, floor((y - y0) / ((y1 - y0) / 10))::BIGINT AS cy, count(*)::BIGINT AS n FROM p JOIN (SELECT model, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY model) e USING (model) GROUP BY ALL",
            "p AS (SELECT (input + cc + cr)::DOUBLE AS x, cost_e8 / 1e6::DOUBLE AS y, model FROM settled)",
        ),
    ),
    "a24_linear_trend": (
        lambda s, d: report.linear_trend(_points(s, d)).select(F.round("slope", 9).alias("slope"), F.round("intercept", 4).alias("intercept"), "x0", "x1"),
        sql("SELECT round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 4) AS intercept, min(x) AS x0, max(x) AS x1 FROM (SELECT (input + cc + cr)::DOUBLE AS x, cost_e8 / 1e6::DOUBLE AS y FROM settled)"),
    ),
    "a25_attribution": (
        lambda s, d: report.attribution(settled(s, d), F.when(F.col("line") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("role"), F.col("line") % 3))),
        sql(
            " UNION ALL ".join(
                f"SELECT '{lv}' AS level, {nm} AS name, sum({ALL})::BIGINT AS total, sum(cost_e8)::BIGINT AS cost_e8, count(DISTINCT sid)::BIGINT AS sessions FROM settled {wh} GROUP BY 2"
                for lv, nm, wh in (("all", "'all'", ""), ("kind", "CASE WHEN parent IS NULL THEN 'main' ELSE 'agents' END", ""), ("role", "CASE WHEN line % 3 = 0 THEN 'unknown' ELSE 'role' || (line % 3) END", "WHERE parent IS NOT NULL"), ("model", "model", "WHERE parent IS NOT NULL"))
            )
        ),
    ),
    "a26_integrity": (
        # one call of the roles is counted twice
        lambda s, d: report.attribution_integrity(report.attribution(settled(s, d), F.lit(None).cast("string")).withColumn("total", F.col("total") + F.when(F.col("level") == "role", 1).otherwise(0))),
        sql(f"SELECT 'role' AS level, sum({ALL})::BIGINT AS expected, (sum({ALL}) + 1)::BIGINT AS got FROM settled WHERE parent IS NOT NULL"),
    ),
    "a27_limit_summary": (
        lambda s, d: report.limit_window_summary(_windowed(s, d), WIN),
        wsql(
            "SELECT w.account, w.win, sum(input)::BIGINT AS input, sum(out)::BIGINT AS output, sum(cc)::BIGINT AS cache_write, sum(cr)::BIGINT AS cache_read, floor(sum(cost_e8) / 1e8 * 100 + 0.5) / 100 AS cost, count(*)::BIGINT AS requests, count(DISTINCT sid)::BIGINT AS sessions, max(cr) AS peak_context, floor((max(ts_s) - min(ts_s)) / 60.0 + 0.5)::BIGINT AS active_minutes, string_agg(DISTINCT model, ',' ORDER BY model) AS models, any_value(peak)::BIGINT AS peak_sessions FROM windowed w JOIN peaks p ON w.account = p.account AND w.win = p.win GROUP BY w.account, w.win",
            "peaks AS (SELECT account, win, max(n) AS peak FROM (SELECT account, win, ts_s, count(DISTINCT sid) AS n FROM windowed GROUP BY ALL) GROUP BY account, win)",
        ),
    ),
    "a28_limit_total": (
        lambda s, d: report.limit_total_row(_windowed(s, d), "account"),
        sql("SELECT account, count(*)::BIGINT AS requests, count(DISTINCT sid)::BIGINT AS sessions, sum(cost_e8)::BIGINT AS cost_e8 FROM accounted GROUP BY ROLLUP (account)"),
    ),
    "a29_before_after": (
        lambda s, d: report.before_after(settled(s, d), DAY_SPLIT),
        sql(f"SELECT CASE WHEN day < {DAY_SPLIT} THEN 'before' ELSE 'after' END AS side, count(*)::BIGINT AS days, floor(avg(cost_e8) + 0.5)::BIGINT AS day_cost_e8, sum(tokens) FILTER (WHERE out >= 1000)::BIGINT AS tokens, sum(out) FILTER (WHERE out >= 1000)::BIGINT AS out FROM (SELECT ts_s // 86400 AS day, sum(cost_e8) AS cost_e8, sum({ALL}) AS tokens, sum(out) AS out FROM settled GROUP BY 1) GROUP BY 1"),
    ),
    "a31_seven_day_chunks": (
        lambda s, d: report.seven_day_chunks(settled(s, d)),
        sql("SELECT (n - 1) // 7 AS chunk, min(day) AS first_day, count(*)::BIGINT AS days, sum(cost_e8)::BIGINT AS cost_e8 FROM (SELECT day, cost_e8, row_number() OVER (ORDER BY day) AS n FROM (SELECT ts_s // 86400 AS day, sum(cost_e8) AS cost_e8 FROM settled GROUP BY 1)) GROUP BY 1"),
    ),
    "a32_projection": (
        lambda s, d: report.monthly_projection(settled(s, d), 31),
        sql("SELECT sum(cost_e8)::BIGINT AS cost_e8, any_value(n_days) AS n_days, CASE WHEN any_value(n_days) <= 31 THEN floor(sum(cost_e8)::DOUBLE * 30 / any_value(n_days))::BIGINT END AS month_e8 FROM settled, edge", EDGE),
    ),
    "a33_event_counts": (
        lambda s, d: report.event_counts(_tagged(s, d)),
        sql("SELECT tag, count(*)::BIGINT AS n, count(DISTINCT sid)::BIGINT AS sessions FROM (SELECT sid, cost_tag AS tag FROM tagged UNION ALL SELECT sid, ctx_tag FROM tagged) WHERE tag IS NOT NULL GROUP BY tag", *CROSS),
    ),
    "a44_thinking_rate": (
        lambda s, d: report.thinking_rate(settled(s, d).select("model", F.col("parent").isNotNull().alias("is_agent"), F.when(F.col("line") % 2 == 0, "high").otherwise("low").alias("effort"), (F.col("k") % 3 == 0).alias("has_thinking"))).select("model", "is_agent", "effort", "level", "n", "thinking", "rate"),
        sql("SELECT model, parent IS NOT NULL AS is_agent, CASE WHEN line % 2 = 0 THEN 'high' ELSE 'low' END AS effort, grouping(model, is_agent, effort)::BIGINT AS level, count(*)::BIGINT AS n, count(*) FILTER (WHERE k % 3 = 0)::BIGINT AS thinking, floor(100.0::DOUBLE * count(*) FILTER (WHERE k % 3 = 0) / count(*) * 100 + 0.5) / 100 AS rate FROM settled GROUP BY CUBE (model, is_agent, effort)"),
    ),
    "a45_output_per_call": (
        lambda s, d: report.output_per_call(settled(s, d).withColumn("has_thinking", F.col("k") % 3 == 0)),
        sql("SELECT model, count(*)::BIGINT AS n, sum(out)::BIGINT AS out FROM settled WHERE k % 3 <> 0 GROUP BY model"),
    ),
    "a48_reconcile": (
        lambda s, d: report.reconcile(windows.window_rollup(_windowed(s, d), WIN), _windowed(s, d).where("line % 50 <> 0").groupBy("account", "win").agg(F.sum("cost_e8").alias("cost_e8")), ["account", "win"], ["cost_e8"]),
        wsql("SELECT * FROM (SELECT account, win, sum(cost_e8)::BIGINT AS cost_e8, (sum(cost_e8) FILTER (WHERE line % 50 <> 0))::BIGINT AS cost_e8_other FROM windowed GROUP BY ALL) WHERE cost_e8 <> coalesce(cost_e8_other, 0)"),
    ),
    "a49_cache_read_share": (
        lambda s, d: report.cache_read_share(_rates(s, d)),
        sql("SELECT sum(cr * r_cr)::BIGINT AS read_e8, sum(cost_e8)::BIGINT AS cost_e8 FROM settled JOIN prices USING (model)"),
    ),
    "o3_top_sessions": (
        lambda s, d: report.top_sessions(settled(s, d)),
        sql("SELECT sid, sum(cost_e8)::BIGINT AS cost_e8 FROM settled GROUP BY sid ORDER BY cost_e8 DESC, sid LIMIT 15"),
    ),
    "o4_top_texts": (
        lambda s, d: report.top_texts(_points(s, d), ["model"]).select("model", "text", "rank"),
        sql("SELECT model, req AS text, row_number() OVER (PARTITION BY model ORDER BY cost_e8 DESC, req, line)::INT AS rank FROM settled QUALIFY rank <= 3"),
    ),
    "j8_row_to_turn": (
        lambda s, d: turns.row_to_turn(settled(s, d), _users(s, d)).select("sid", "req", "turn"),
        sql("SELECT t.sid, t.req, u.user_line AS turn FROM settled t ASOF LEFT JOIN users u ON t.sid = u.sid AND t.line >= u.user_line", USERS),
    ),
    "w13_first_crossing": (
        lambda s, d: turns.first_crossing(settled(s, d), pricing.pricing_table(s)).where("ctx_tag is not null").select("sid", "req", "ctx_tag"),
        sql("SELECT sid, req, ctx_tag FROM tagged WHERE ctx_tag IS NOT NULL", *CROSS),
    ),
    "w14_cost_band": (lambda s, d: turns.call_cost_band(settled(s, d)).select("sid", "req", "cost_tag"), sql("SELECT sid, req, cost_tag FROM tagged", *CROSS)),
    "w15_resume": (
        lambda s, d: turns.resume_heuristic(settled(s, d), adapter.account_changes(s, d)).where("resume").select("sid", "req"),
        sql(
            "SELECT sid, req FROM r2 WHERE seen = then_seen AND cc >= 10000 AND cc >= 2 * input AND ts_s - last_ts < 3600",
            "r0 AS (SELECT sid, req, ts_s, line, cc, input, 0 AS mark FROM settled UNION ALL SELECT sid, NULL, ts_s, line, NULL, NULL, 1 FROM changes)",
            "r1 AS (SELECT *, sum(mark) OVER (PARTITION BY sid ORDER BY ts_s, line) AS seen FROM r0)",
            "r2 AS (SELECT *, lag(ts_s) OVER w AS last_ts, coalesce(lag(seen) OVER w, 0) AS then_seen FROM r1 WHERE mark = 0 WINDOW w AS (PARTITION BY sid ORDER BY ts_s, line))",
        ),
    ),
    "a13_turn_aggregate": (
        lambda s, d: _turned(s, d).select("sid", "turn", "input", "cc", "cr", "out", "cost_e8", "calls", "first_context", "peak_context", "ctx_danger", "ctx_warn"),
        sql("SELECT * FROM turned", *TURNED),
    ),
    "a14_turn_alerts": (
        lambda s, d: turns.turn_alerts(_turned(s, d)).select("sid", "turn", "alert"),
        sql("SELECT sid, turn, concat_ws('+', CASE WHEN cost_e8 >= 250000000 THEN 'cost-danger' WHEN cost_e8 >= 80000000 THEN 'cost-warn' END, CASE WHEN ctx_danger THEN 'ctx-danger' WHEN ctx_warn THEN 'ctx-warn' END) AS alert FROM turned WHERE cost_e8 >= 80000000 OR ctx_danger OR ctx_warn", *TURNED),
    ),
    "j9_compact_merge": (
        lambda s, d: turns.merge_compact_agents(*_compact_sides(s, d)),
        sql(
            "SELECT m.sid, m.line, m.context, b.agent, coalesce(b.cost_e8, 0)::BIGINT AS cost_e8, coalesce(b.tokens, 0)::BIGINT AS tokens, coalesce(b.dropped_e8, 0)::BIGINT AS dropped_e8 FROM marks m LEFT JOIN best b ON m.sid = b.parent AND m.context = b.context",
            "marks AS (SELECT sid, line, k AS context FROM settled WHERE parent IS NULL)",
            f"agents AS (SELECT parent, k AS context, sid || '-' || line AS sid, {ALL} AS tokens, cost_e8 FROM settled WHERE parent IS NOT NULL)",
            "best AS (SELECT parent, context, arg_max(sid, (cost_e8, sid)) AS agent, max(cost_e8) AS cost_e8, arg_max(tokens, (cost_e8, sid)) AS tokens, sum(cost_e8) - max(cost_e8) AS dropped_e8 FROM agents GROUP BY parent, context)",
        ),
    ),
    "j11_nearest_row": (
        lambda s, d: turns.attach_nearest(adapter.settled(s, d).where("parent is not null").select("parent", "req", "ts_s"), adapter.settled(s, d).where("parent is null").withColumnRenamed("sid", "main").withColumnRenamed("parent", "p").withColumnRenamed("main", "parent"), "parent").select("parent", "req", "nearest"),
        sql(
            "SELECT i.parent, i.req, CASE WHEN b.ts_s IS NULL OR (a.ts_s - i.ts_s) < (i.ts_s - b.ts_s) THEN coalesce(a.line, b.line) ELSE b.line END AS nearest FROM items i ASOF LEFT JOIN mains b ON i.parent = b.sid AND i.ts_s >= b.ts_s ASOF LEFT JOIN mains a ON i.parent = a.sid AND i.ts_s <= a.ts_s",
            "items AS (SELECT parent, req, ts_s FROM settled WHERE parent IS NOT NULL)",
            "mains AS (SELECT sid, ts_s, line FROM settled WHERE parent IS NULL)",
        ),
    ),
    "j18_limit_usage": (
        lambda s, d: report.window_usage(settled(s, d), _long_lived(s, d)),
        sql(f"SELECT lane, start, sum(cost_e8)::BIGINT AS cost_e8, sum({ALL})::BIGINT AS tokens, count(*)::BIGINT AS requests, count(DISTINCT sid)::BIGINT AS sessions FROM settled JOIN jit ON ts_s >= start AND ts_s < active_end GROUP BY lane, start", *JIT),
    ),
    "w19_crossing_alert": (
        lambda s, d: limits.crossing_alert(adapter.ratelimit(s, d)).where("alert is not null").select("sid", "line", "alert"),
        sql("SELECT sid, line, CASE WHEN pct_5h >= 90 AND b < 90 THEN 'danger' ELSE 'warn' END AS alert FROM (SELECT *, coalesce(lag(pct_5h) OVER (PARTITION BY sid ORDER BY ts_s, line), 0) AS b FROM log) WHERE (pct_5h >= 90 AND b < 90) OR (pct_5h >= 70 AND b < 70)", LOG),
    ),
    "w20_change_dedup": (
        lambda s, d: limits.change_dedup(adapter.ratelimit(s, d), ["pct_5h"]).select("sid", "line", "pct_5h"),
        sql("SELECT sid, line, pct_5h FROM log QUALIFY coalesce(pct_5h <> lag(pct_5h) OVER (PARTITION BY sid ORDER BY ts_s, line), true)", LOG),
    ),
    "w21_backfill_reset": (
        lambda s, d: limits.backfill_first(adapter.ratelimit(s, d), "reset_5h").select("sid", "line", "reset_5h"),
        sql("SELECT sid, line, CASE WHEN row_number() OVER w = 1 THEN coalesce(reset_5h, first_value(reset_5h IGNORE NULLS) OVER (PARTITION BY sid ORDER BY ts_s, line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) ELSE reset_5h END AS reset_5h FROM log WINDOW w AS (PARTITION BY sid ORDER BY ts_s, line)", LOG),
    ),
    "s17_export_log": (
        lambda s, d: limits.export_log(adapter.ratelimit(s, d)).select("ts_s", "pct_5h", "reset_5h"),
        sql("SELECT ts_s, pct_5h, CASE WHEN row_number() OVER (ORDER BY ts_s) = 1 THEN coalesce(reset_5h, (SELECT arg_min(reset_5h, ts_s) FROM log WHERE reset_5h IS NOT NULL)) ELSE reset_5h END AS reset_5h FROM (SELECT * FROM log QUALIFY coalesce(pct_5h <> lag(pct_5h) OVER (ORDER BY ts_s, line), true))", LOG),
    ),
    "w22_idle_gap": (
        lambda s, d: limits.idle_gap(adapter.events(s, d).select(F.concat(F.lit("s"), "user_id").alias("sid"), "ts_s", F.col("event_id").alias("line"), F.when(F.col("event_type") == "click", "prompt").otherwise("reply").alias("kind"))).select("sid", "line", "idle"),
        sql("SELECT sid, line, ts_s - last AS idle FROM (SELECT 's' || user_id AS sid, event_id AS line, ts_s, event_type, max(CASE WHEN event_type <> 'click' THEN ts_s END) OVER (PARTITION BY user_id ORDER BY ts_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM ev) WHERE event_type = 'click' AND ts_s - last >= 3590"),
    ),
    "w23_idle_turn_cost": (
        lambda s, d: limits.idle_turn_cost(settled(s, d).withColumn("grp", F.col("user_id") % 10), 60, "grp").select("grp", "req", "turn_cost_e8"),
        sql("SELECT grp, req, sum(cost_e8) OVER (PARTITION BY grp, turn ORDER BY ts_s, line)::BIGINT AS turn_cost_e8 FROM (SELECT *, sum(fresh) OVER (PARTITION BY grp ORDER BY ts_s, line) AS turn FROM (SELECT *, user_id % 10 AS grp, coalesce(ts_s - lag(ts_s) OVER (PARTITION BY user_id % 10 ORDER BY ts_s, line) > 60, true)::INT AS fresh FROM settled))"),
    ),
    "m3_points_per_dollar": (
        lambda s, d: limits.points_per_dollar(settled(s, d).withColumn("rise", (F.col("k") % 9).cast("double")), ["model"]),
        sql("SELECT model, round(sum(x * y) / sum(x * x), 9) AS points_per_usd, count(*)::BIGINT AS n FROM (SELECT model, cost_e8 / 1e8::DOUBLE AS x, (k % 9)::DOUBLE AS y FROM settled) GROUP BY model"),
    ),
    "w26_foreign_usage": (
        lambda s, d: limits.foreign_usage_filter(settled(s, d).withColumn("rise", (F.col("k") % 2).cast("double"))).groupBy("model").agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT model, count(*)::BIGINT AS n FROM settled WHERE cost_e8 > 0 AND k % 2 <= cost_e8 / 1e8::DOUBLE GROUP BY model"),
    ),
    "j22_near_resets": (
        lambda s, d: limits.drop_near_resets(_long_lived(s, d).select("lane", "start"), adapter.stated_starts(s, d).select(F.col("start").alias("reset")).distinct(), 600),
        sql("SELECT lane, start FROM jit WHERE NOT EXISTS (SELECT 1 FROM starts WHERE abs(jit.start - starts.start) <= 600)", *JIT),
    ),
    "a46_limit_ratio": (
        lambda s, d: limits.limit_ratio(adapter.limit_samples(s, d).select("lane", F.col("used_percent").alias("rise_5h"), (F.col("line") % 7 + 1).cast("double").alias("rise_7d")), "lane"),
        sql("SELECT lane, sum(used_percent) AS rise_5h, sum(line % 7 + 1)::DOUBLE AS rise_7d, count(*)::BIGINT AS windows, round(sum(used_percent) / sum(line % 7 + 1), 6) AS ratio FROM samples GROUP BY lane", SAMPLES),
    ),
    "m1_gram_matrix": (
        lambda s, d: limits.gram_matrix(settled(s, d), ["input", "cc", "cr"], "k").select("i", "j", F.round("value", 0).alias("value")),
        sql(" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum({a}::DOUBLE * {b}::DOUBLE), 0) AS value FROM settled" for i, a, j, b in ((0, "input", 0, "input"), (0, "input", 1, "cc"), (0, "input", 2, "cr"), (1, "cc", 1, "cc"), (1, "cc", 2, "cr"), (2, "cr", 2, "cr"), (0, "input", -1, "k"), (1, "cc", -1, "k"), (2, "cr", -1, "k")))),
    ),
    "m2_hypotheses": (
        lambda s, d: limits.hypothesis_errors(settled(s, d).withColumn("rise", F.col("k").cast("double")), {"price": "cost_e8 / 1e6", "tokens": "(input + cc + cr + out) / 1e4"}, "rise"),
        sql(" UNION ALL ".join(f"SELECT '{n}' AS hypothesis, round(median(e), 6) AS median_error, round(100.0::DOUBLE * avg((e <= 2)::INT), 4) AS within_2, round(100.0::DOUBLE * avg((e <= 3)::INT), 4) AS within_3 FROM (SELECT abs({x} - k) AS e FROM settled)" for n, x in (("price", "cost_e8 / 1e6::DOUBLE"), ("tokens", f"({ALL}) / 1e4::DOUBLE")))),
    ),
    "t8_private_view": (
        lambda s, d: report.private_view(_turns(s, d).withColumn("sid", F.col("sid").cast("string")), ["sid"], ["text"]).select("sid", "line", "text"),
        "SELECT 'sid-' || substr(sha256(conv_id::VARCHAR), 1, 8) AS sid, turn AS line, '' AS text FROM conversations",
    ),
    "w30_group_turns": (
        lambda s, d: turns.group_turns(_turns(s, d)).select("sid", "turn", "from_line", "to_line", "role", "text", F.size("replies").cast("long").alias("replies")),
        "SELECT sid, turn, min(line) AS from_line, max(line) AS to_line, arg_min(role, line) AS role, arg_min(text, line) AS text, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS replies FROM (SELECT conv_id AS sid, turn AS line, role, text, sum((role IN ('user', 'system'))::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS turn FROM conversations) WHERE turn > 0 GROUP BY sid, turn",
    ),
    "t2_restore_view": (
        lambda s, d: turns.restore_view(turns.group_turns(_turns(s, d)), _turns(s, d).where("role = 'system' or line = 2"), keep=1).select("sid", "turn", F.array_join("replies", "\n").alias("replies")),
        "SELECT sid, turn, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (WHERE role = 'assistant'), '') AS replies FROM (SELECT conv_id AS sid, turn AS line, role, text, sum((role IN ('user', 'system'))::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS turn FROM conversations) JOIN (SELECT conv_id AS sid, max(turn) AS stop FROM conversations WHERE role = 'system' OR turn = 2 GROUP BY 1) USING (sid) WHERE turn > 0 GROUP BY sid, turn HAVING min(line) < any_value(stop)",
    ),
    "o6_budget_select": (
        lambda s, d: turns.budget_select(_turns(s, d).withColumn("tokens", F.char_length("text")), 1500, 10).select("sid", "line", F.col("used").cast("long").alias("used")),
        "SELECT sid, line, used FROM (SELECT conv_id AS sid, turn AS line, (sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC) + 10)::BIGINT AS used FROM conversations) WHERE used <= 1500",
    ),
    "t11_line_index": (
        lambda s, d: turns.text_line_index(_turns(s, d)),
        r"SELECT conv_id AS sid, turn AS line, role, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 120) AS head FROM conversations WHERE role IN ('user', 'assistant')",
    ),
    "o5_topic_turns": (
        lambda s, d: turns.topic_turns(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text"), s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query"), "text")).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best")),
        r"""WITH w AS (SELECT doc_id AS id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents),
        tf AS (SELECT id, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY ALL),
        q AS (SELECT DISTINCT item_id AS query, word FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM benchmark) WHERE word <> ''),
        df AS (SELECT word, count(*) AS df FROM tf WHERE word IN (SELECT word FROM q) GROUP BY word),
        s AS (SELECT query, id, round(sum(tf * ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1))), 6) AS score FROM tf JOIN df USING (word) JOIN q USING (word) GROUP BY query, id)
        SELECT query, least(count(*), 20)::BIGINT AS n, max(score) AS best FROM s GROUP BY query""",
    ),
}


def _compact_sides(spark, d):
    rows = settled(spark, d)
    marks = rows.where("parent is null").select("sid", "line", F.col("k").alias("context"))
    agents = rows.where("parent is not null").select("parent", F.col("k").alias("context"), F.concat("sid", F.lit("-"), "line").alias("sid"), F.expr(ALL).alias("tokens"), "cost_e8", "model")
    return marks, agents


def _near_sides(spark, d):
    rows = settled(spark, d)
    marks = rows.where("parent is null").select("sid", "ts_s", "line")
    agents = rows.where("parent is not null").select(F.col("parent").alias("sid"), "ts_s", F.concat("sid", F.lit("-"), "line").alias("agent"))
    return marks, agents
