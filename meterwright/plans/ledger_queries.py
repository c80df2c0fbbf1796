"""Queries on the ledger: dedup, prices, summaries, accounts and windows, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates
from ..operators import accounts, ledger, pricing, windows
from ..sources.committed import committed
from . import adapter
from .adapter import accounted, priced_usage, settled, sql, usage

SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in (*ledger.TOKENS, "cost_e8"))
ALL = "input + cc + cr + out"
CUTOFF = 1704067200 + 10 * 86400


def _windowed(spark, d):
    """Ledger rows in stated or anchored windows of their account. The rows are needed for the blocks and for what falls in
    them, and the windows by several aggregates, so both are computed once."""
    split = windows.split_intervals(adapter.stated_starts(spark, d), ["account"])
    rows = committed(accounted(spark, d), "accounted")
    return committed(windows.window_or_block(rows, split, ["account"]), "windowed")


def _chunks(spark, d):
    """Every call as three streamed chunks, the last with the final usage."""
    rows = usage(spark, d).drop("event_type", "user_id", "k")
    parts = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("chunk")
    grown = rows.select("*", parts)
    return grown.withColumns({"line": F.col("line") * 10 + F.col("chunk"), "out": F.expr("out * chunk div 3")}).drop("chunk")


def _rates(spark, d):
    return settled(spark, d).join(F.broadcast(pricing.pricing_table(spark)), "model")


SPLIT = """
split AS (SELECT account, start, least(start + 18000, lead(start) OVER (PARTITION BY account ORDER BY start)) AS "end"
          FROM (SELECT DISTINCT account, start FROM starts))"""
HELD = """
held AS (SELECT a.*, CASE WHEN a.ts_s < s."end" THEN s.start END AS win
         FROM accounted a ASOF LEFT JOIN split s ON a.account = s.account AND a.ts_s >= s.start)"""
#: Rows outside stated windows, block by block: a recursive walk from anchor to anchor.
WINDOWED = """
free AS (SELECT DISTINCT account, ts_s FROM held WHERE win IS NULL),
walk(account, anchor) AS (
  SELECT account, min(ts_s) FROM free GROUP BY account
  UNION ALL
  SELECT w.account, (SELECT min(f.ts_s) FROM free f WHERE f.account = w.account AND f.ts_s >= w.anchor + 18000)
  FROM walk w WHERE w.anchor IS NOT NULL),
anchors AS (SELECT account, anchor FROM walk WHERE anchor IS NOT NULL),
windowed AS (
  SELECT *, true AS stated FROM held WHERE win IS NOT NULL
  UNION ALL
  SELECT h.* REPLACE (a.anchor AS win), false FROM (SELECT * FROM held WHERE win IS NULL) h
  ASOF JOIN anchors a ON h.account = a.account AND h.ts_s >= a.anchor)"""


def wsql(body: str, *more: str) -> str:
    text = sql(body, SPLIT, HELD, WINDOWED, *more)
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES = {
    "a1_last_chunk": (
        lambda s, d: ledger.last_chunk_per_request(_chunks(s, d)).select("sid", "req", "line", "out"),
        sql("SELECT sid, req, max(line) * 10 + 3 AS line, arg_max(out, line)::BIGINT AS out FROM raw_usage GROUP BY sid, req"),
    ),
    "j1_parent_replays": (
        lambda s, d: ledger.drop_parent_replays(usage(s, d)).select("sid", "req", "ts_s", "line"),
        sql("SELECT sid, req, ts_s, line FROM no_replay"),
    ),
    "a4_request_once": (
        lambda s, d: settled(s, d).select("sid", "req", "ts_s", "line", "cost_e8"),
        sql("SELECT sid, req, ts_s, line, cost_e8 FROM settled"),
    ),
    "p3_rows_since": (
        lambda s, d: ledger.rows_since(settled(s, d), CUTOFF).select("sid", "req", "cost_e8"),
        sql(f"SELECT sid, req, cost_e8 FROM settled WHERE ts_s >= {CUTOFF}"),
    ),
    "p8_drop_synthetic": (
        lambda s, d: ledger.drop_synthetic(usage(s, d).withColumn("model", F.when(F.col("line") % 7 == 0, "<synthetic>").otherwise(F.col("model")))).groupBy("model").agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT model, count(*)::BIGINT AS n FROM raw_usage WHERE line % 7 <> 0 GROUP BY model"),
    ),
    "p19_cache_tiers": (
        lambda s, d: ledger.cache_tiers(usage(s, d).withColumns({"cc5m": F.when(F.col("line") % 2 == 0, F.col("cc5m")), "cc1h": F.when(F.col("line") % 2 == 0, F.col("cc1h"))})).groupBy("sid").agg(F.sum("cc5m").alias("cc5m"), F.sum("cc1h").alias("cc1h")),
        sql("SELECT sid, sum(CASE WHEN line % 2 = 0 THEN cc5m ELSE 0 END)::BIGINT AS cc5m, sum(CASE WHEN line % 2 = 0 THEN cc1h ELSE cc END)::BIGINT AS cc1h FROM raw_usage GROUP BY sid"),
    ),
    "j2_price_rows": (
        lambda s, d: priced_usage(s, d).select("sid", "req", "model", "cost_e8"),
        sql("SELECT sid, req, model, cost_e8 FROM usage"),
    ),
    "j3_unknown_models": (
        lambda s, d: pricing.unknown_models(usage(s, d).withColumn("model", F.when(F.col("line") % 11 == 0, F.concat("model", F.lit("-x"))).otherwise(F.col("model"))), pricing.pricing_table(s)),
        sql("SELECT model || '-x' AS model, count(*)::BIGINT AS n_rows FROM raw_usage WHERE line % 11 = 0 GROUP BY model"),
    ),
    "j23_reprice": (
        lambda s, d: pricing.reprice(settled(s, d), pricing.pricing_table(s), "claude-fable-5").groupBy("model").agg(F.sum("cost_e8").alias("cost_e8"), F.sum("repriced_e8").alias("repriced_e8")),
        sql("SELECT s.model, sum(cost_e8)::BIGINT AS cost_e8, sum(s.input * p.r_input + s.cc5m * p.r_cc5m + s.cc1h * p.r_cc1h + s.cr * p.r_cr + s.out * p.r_out)::BIGINT AS repriced_e8 FROM settled s, prices p WHERE p.model = 'claude-fable-5' GROUP BY s.model"),
    ),
    "s10_pricing_dim": (
        lambda s, d: settled(s, d).join(F.broadcast(pricing.pricing_table(s)), "model").groupBy("model", "r_input", "r_out", "context_window").agg(F.count(F.lit(1)).alias("calls")),
        sql("SELECT model, r_input::BIGINT AS r_input, r_out::BIGINT AS r_out, context_window::BIGINT AS context_window, count(*)::BIGINT AS calls FROM settled JOIN prices USING (model) GROUP BY ALL"),
    ),
    "a2_session_summary": (
        lambda s, d: ledger.session_summary(settled(s, d)),
        sql(f"SELECT sid, min(ts_s) AS first_ts, max(ts_s) AS last_ts, count(*)::BIGINT AS calls, {SUMS} FROM settled GROUP BY sid"),
    ),
    "a3_agent_totals": (
        lambda s, d: ledger.agent_effective_totals(priced_usage(s, d)),
        sql(f"SELECT parent, sid, count(*)::BIGINT AS calls, {SUMS} FROM no_replay WHERE parent IS NOT NULL GROUP BY parent, sid"),
    ),
    "a5_token_breakdown": (
        lambda s, d: ledger.token_breakdown(_rates(s, d)),
        sql(" UNION ALL ".join(f"SELECT '{c}' AS component, sum({c})::BIGINT AS tokens, sum({c} * r_{c})::BIGINT AS cost_e8 FROM settled JOIN prices USING (model)" for c in ("input", "cc5m", "cc1h", "cr", "out"))),
    ),
    "a6_report_summary": (
        lambda s, d: ledger.report_summary(settled(s, d)),
        sql(f"SELECT sum(cost_e8)::BIGINT AS cost_e8, sum({ALL})::BIGINT AS tokens, count(*)::BIGINT AS calls, count(DISTINCT sid)::BIGINT AS sessions, max(ts_s // 86400) - min(ts_s // 86400) + 1 AS calendar_days FROM settled"),
    ),
    "a35_primary_model": (
        lambda s, d: ledger.primary_model(settled(s, d)),
        sql("SELECT sid, model FROM (SELECT sid, model, count(*) AS n, min(line) AS f FROM settled GROUP BY sid, model) QUALIFY row_number() OVER (PARTITION BY sid ORDER BY n DESC, f) = 1"),
    ),
    "a15_daily_cost": (
        lambda s, d: ledger.daily_cost(_rates(s, d)),
        sql("SELECT strftime(to_timestamp(ts_s), '%Y-%m-%d') AS day, sum(cost_e8)::BIGINT AS cost_e8, sum(input * r_input)::BIGINT AS input_e8, sum(cc5m * r_cc5m + cc1h * r_cc1h)::BIGINT AS write_e8, sum(cr * r_cr)::BIGINT AS read_e8, sum(out * r_out)::BIGINT AS output_e8 FROM settled JOIN prices USING (model) GROUP BY 1"),
    ),
    "a16_daily_tokens": (
        lambda s, d: ledger.daily_tokens(settled(s, d)),
        sql(f"SELECT strftime(to_timestamp(ts_s), '%Y-%m-%d') AS day, sum({ALL})::BIGINT AS tokens, count(*)::BIGINT AS calls FROM settled GROUP BY 1"),
    ),
    "w17_account_changes": (
        lambda s, d: accounts.account_changes(adapter.account_changes(s, d)).select("sid", "ts_s", "account"),
        sql("SELECT sid, ts_s, account FROM changes QUALIFY coalesce(lag(account) OVER (PARTITION BY sid ORDER BY ts_s, line) <> account, true)"),
    ),
    "j4_account_session": (
        lambda s, d: accounts.account_in_session(settled(s, d), adapter.account_changes(s, d)).select("sid", "req", F.col("own_account").alias("account")),
        sql("SELECT sid, req, own AS account FROM in_session"),
    ),
    "j5_account_global": (
        lambda s, d: accounted(s, d).select("sid", "req", "account"),
        sql("SELECT sid, req, account FROM accounted"),
    ),
    "a34_account_totals": (
        lambda s, d: accounts.account_totals(accounted(s, d), adapter.account_changes(s, d)),
        sql("SELECT account, count(*)::BIGINT AS calls, count(DISTINCT sid)::BIGINT AS sessions, sum(cost_e8)::BIGINT AS cost_e8, max(ts_s) AS last_ts, account = (SELECT arg_max(account, ts_s) FROM changes) AS is_current FROM accounted GROUP BY account"),
    ),
    "w1_merge_intervals": (
        lambda s, d: windows.merge_intervals(adapter.stated_starts(s, d), ["account"]),
        sql(
            'SELECT account, min(start) AS start, max(start) + 18000 AS "end" FROM m2 GROUP BY account, island',
            "m1 AS (SELECT account, start, coalesce(start - lag(start) OVER w >= 18000, true)::INT AS fresh FROM (SELECT DISTINCT * FROM starts) WINDOW w AS (PARTITION BY account ORDER BY start))",
            "m2 AS (SELECT *, sum(fresh) OVER (PARTITION BY account ORDER BY start) AS island FROM m1)",
        ),
    ),
    "w2_split_intervals": (
        lambda s, d: windows.split_intervals(adapter.stated_starts(s, d), ["account"]),
        sql("SELECT * FROM split", SPLIT),
    ),
    "u3_distinct_starts": (lambda s, d: windows.distinct_starts(adapter.stated_starts(s, d)), sql("SELECT DISTINCT account, start FROM starts")),
    "j6_stated_window": (
        lambda s, d: windows.assign_stated_window(accounted(s, d), windows.split_intervals(adapter.stated_starts(s, d), ["account"]), ["account"]).select("sid", "req", "win"),
        sql("SELECT sid, req, win FROM held", SPLIT, HELD),
    ),
    "w3_anchored_blocks": (
        lambda s, d: _windowed(s, d).select("sid", "req", "account", "win", "stated"),
        wsql("SELECT sid, req, account, win, stated FROM windowed"),
    ),
    "j7_hour_to_window": (
        lambda s, d: windows.hour_to_window(accounted(s, d), windows.split_intervals(adapter.stated_starts(s, d), ["account"]), ["account"]).select("sid", "req", "hour", "win"),
        sql(
            "SELECT a.sid, a.req, a.ts_s - a.ts_s % 3600 AS hour, m.win FROM accounted a JOIN mapped m ON m.account = a.account AND m.hour = a.ts_s - a.ts_s % 3600",
            SPLIT,
            "hours AS (SELECT DISTINCT account, ts_s - ts_s % 3600 AS hour FROM accounted)",
            'hheld AS (SELECT h.*, CASE WHEN h.hour < s."end" THEN s.start END AS win FROM hours h ASOF LEFT JOIN split s ON h.account = s.account AND h.hour >= s.start)',
            "free AS (SELECT account, hour FROM hheld WHERE win IS NULL)",
            "walk(account, anchor) AS (SELECT account, min(hour) FROM free GROUP BY account UNION ALL SELECT w.account, (SELECT min(f.hour) FROM free f WHERE f.account = w.account AND f.hour >= w.anchor + 18000) FROM walk w WHERE w.anchor IS NOT NULL)",
            "mapped AS (SELECT account, hour, win FROM hheld WHERE win IS NOT NULL UNION ALL SELECT f.account, f.hour, a.anchor FROM free f ASOF JOIN (SELECT * FROM walk WHERE anchor IS NOT NULL) a ON f.account = a.account AND f.hour >= a.anchor)",
        ).replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "a7_window_rollup": (
        lambda s, d: windows.window_rollup(_windowed(s, d), ["account"]),
        wsql(f"SELECT account, win, sum(cost_e8)::BIGINT AS cost_e8, sum({ALL})::BIGINT AS tokens, count(*)::BIGINT AS calls, count(DISTINCT sid)::BIGINT AS sessions, min(ts_s) AS first_ts, max(ts_s) AS last_ts FROM windowed GROUP BY account, win"),
    ),
    "a8_window_hour": (
        lambda s, d: windows.window_hour(_windowed(s, d), ["account"]),
        wsql(f"SELECT account, win, ts_s - ts_s % 3600 AS hour, sum(cost_e8)::BIGINT AS cost_e8, sum({ALL})::BIGINT AS tokens FROM windowed GROUP BY ALL"),
    ),
    "a9_window_session_hour": (
        lambda s, d: windows.window_session_hour(_windowed(s, d), ["account"]),
        wsql(f"SELECT account, win, sid, ts_s - ts_s % 3600 AS hour, sum(cost_e8)::BIGINT AS cost_e8, sum({ALL})::BIGINT AS tokens, count(*)::BIGINT AS calls FROM windowed GROUP BY ALL"),
    ),
    "a10_parent_group": (
        lambda s, d: windows.parent_group_rollup(_windowed(s, d), ["account"]),
        wsql(f"SELECT account, win, coalesce(parent, sid) AS grp, sum(cost_e8)::BIGINT AS cost_e8, sum({ALL})::BIGINT AS tokens, count(DISTINCT CASE WHEN parent IS NOT NULL THEN sid END)::BIGINT AS agents FROM windowed GROUP BY ALL HAVING sum({ALL}) > 0"),
    ),
    "a42_active_hours": (
        lambda s, d: windows.active_hours(accounted(s, d), ["account"]),
        sql("SELECT account, count(DISTINCT ts_s // 3600)::BIGINT AS active_hours FROM accounted WHERE cost_e8 > 0 GROUP BY account"),
    ),
    "w18_hour_floor": (
        lambda s, d: settled(s, d).groupBy(windows.hour_floor(F.col("ts_s")).alias("hour")).agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT ts_s - ts_s % 3600 AS hour, count(*)::BIGINT AS n FROM settled GROUP BY 1"),
    ),
    "w8_tiles": (
        lambda s, d: windows.tile_from_anchor(settled(s, d), 1704070000).groupBy("win").agg(F.sum("cost_e8").alias("cost_e8")),
        sql("SELECT CAST(floor((ts_s - 1704070000) / 18000.0) AS BIGINT) * 18000 + 1704070000 AS win, sum(cost_e8)::BIGINT AS cost_e8 FROM settled GROUP BY 1"),
    ),
    "w33_concurrency": (
        lambda s, d: windows.concurrency(_windowed(s, d), ["account"]),
        wsql("SELECT account, win, max(n)::BIGINT AS peak FROM (SELECT account, win, ts_s, count(DISTINCT sid) AS n FROM windowed GROUP BY ALL) GROUP BY account, win"),
    ),
    "w4_jitter_windows": (
        lambda s, d: windows.jitter_windows(adapter.limit_samples(s, d), ["lane"]).drop("window_minutes", "most"),
        sql("SELECT lane, \"end\", samples, start, least(\"end\", lead(start) OVER (PARTITION BY lane ORDER BY start)) AS active_end FROM jit", *(JIT := [
            "samples AS (SELECT 's' || user_id AS sid, event_id AS line, ts_s, CASE WHEN event_id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS lane, (k + 1)::DOUBLE AS used_percent, (ts_s // 18000 + 1) * 18000 + event_id % 7 AS resets_at FROM ev WHERE event_type = 'view')",
            "j1 AS (SELECT lane, resets_at, count(*) AS n, max(used_percent) AS most, coalesce(resets_at - lag(resets_at) OVER (PARTITION BY lane ORDER BY resets_at) > 120, true)::INT AS fresh FROM samples GROUP BY lane, resets_at)",
            "j2 AS (SELECT *, sum(fresh) OVER (PARTITION BY lane ORDER BY resets_at) AS w FROM j1)",
            'jit AS (SELECT lane, max(resets_at) AS "end", sum(n)::BIGINT AS samples, max(resets_at) - 18000 AS start, max(most) AS most FROM j2 GROUP BY lane, w)',
        ])),
    ),
    "w5_started_windows": (
        lambda s, d: windows.started_windows(windows.jitter_windows(adapter.limit_samples(s, d).withColumn("used_percent", F.greatest(F.col("used_percent") - 60, F.lit(0.0))), ["lane"])).select("lane", "start", "most"),
        sql("SELECT lane, start, greatest(most - 60, 0) AS most FROM jit WHERE most > 60", *JIT),
    ),
    "w6_rising_only": (
        lambda s, d: windows.rising_only(adapter.limit_samples(s, d), ["lane", "resets_at"]).select("lane", "resets_at", "ts_s", "line", "used_percent"),
        sql("SELECT lane, resets_at, ts_s, line, used_percent FROM samples QUALIFY coalesce(used_percent > max(used_percent) OVER (PARTITION BY lane, resets_at ORDER BY ts_s, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)", *JIT),
    ),
    "u1_union_ledger": (
        lambda s, d: ledger.union_ledger(settled(s, d), account=adapter.account_changes(s, d)),
        sql("SELECT sid, ts_s, line, 'call' AS kind, cost_e8, input FROM settled UNION ALL SELECT sid, ts_s, line, 'account', 0, 0 FROM changes"),
    ),
    "u5_vanished": (
        lambda s, d: ledger.vanished(ledger.drop_parent_replays(usage(s, d)), settled(s, d)),
        sql("SELECT DISTINCT sid FROM no_replay WHERE sid NOT IN (SELECT sid FROM settled)"),
    ),
    "p12_visible": (
        lambda s, d: _two_hosts(s, d).where(predicates.visible(F.col("host"), F.col("shown_e8"), F.expr(ALL))).select("host", "sid", "line"),
        sql(f"SELECT CASE WHEN k % 2 = 0 THEN 'codex' ELSE host END AS host, sid, line FROM settled WHERE CASE WHEN k % 2 = 0 THEN {ALL} > 0 ELSE CASE WHEN k % 3 = 0 THEN 0 ELSE cost_e8 END > 0 END"),
    ),
}


def _two_hosts(spark, d):
    """Calls of two hosts, of which some cost nothing."""
    rows = settled(spark, d)
    return rows.withColumns({"host": F.when(F.col("k") % 2 == 0, "codex").otherwise(F.col("host")), "shown_e8": F.when(F.col("k") % 3 == 0, 0).otherwise(F.col("cost_e8"))})
