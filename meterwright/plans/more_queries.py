"""Queries of operators on sessions, markers, restores and limits that stand on the test tables by a rule of their own, with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import ledger, limits, report, restore, sessions, windows
from . import adapter
from .adapter import settled, sql, usage
from .report_queries import JIT, _long_lived
from .report_queries import QUERIES as REPORTS
from .text_queries import SAMPLES

ALL = "input + cc + cr + out"


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")


def _sids(s, d):
    return settled(s, d).select("sid").distinct()


def _commands(s, d):
    """Conversations in which every fifth user line is a command."""
    names = F.element_at(F.array(*map(F.lit, ["clear", "plugin:compact", "reload-plugins", "model", "help"])), (F.col("sid") % 5 + 1).cast("int"))
    asked = (F.col("role") == "user") & ((F.col("sid") + F.col("line")) % 5 == 0)
    return adapter.turns(s, d).withColumn("text", F.when(asked, F.concat(F.lit("<command-name>/"), names, F.lit("</command-name>"))).otherwise(F.col("text")))


COMMANDS = "commands AS (SELECT conv_id AS sid, turn AS line, role, CASE WHEN role = 'user' AND (conv_id + turn) % 5 = 0 THEN ['clear', 'compact', 'reload', 'model', 'other'][1 + conv_id % 5] END AS command FROM conversations)"


def _codex(s, d):
    ev = adapter.events(s, d).where("event_type = 'view'")
    return ev.select(
        F.concat(F.lit("c"), "user_id").alias("sid"), "ts_s", F.lit("codex-1").alias("model"), F.col("iv").alias("input"), (F.col("k") * 3).alias("cached"), F.col("k").alias("cache_write"), (F.col("iv") * 2).alias("output")
    )


def _restores(s, d):
    """Restores that name the sessions of ten users each."""
    rows = settled(s, d).where("parent is null")
    return rows.groupBy((F.col("user_id") % 10).alias("restore")).agg(F.array_sort(F.collect_set("sid")).alias("read"))


RESTORED = [
    "last_read AS (SELECT sid, arg_max(cr, (ts_s, line)) AS context FROM settled WHERE cr > 0 GROUP BY sid)",
    "named AS (SELECT DISTINCT user_id % 10 AS restore, sid FROM settled WHERE parent IS NULL)",
    "restored AS (SELECT restore, coalesce(sum(context), 0)::BIGINT AS context FROM named LEFT JOIN last_read USING (sid) GROUP BY restore)",
]


def _window_samples(s, d):
    """Readings that rise within five hours; those of some users fall."""
    v = adapter.limit_samples(s, d)
    up = (F.col("ts_s") % 18000 / 180).cast("double")
    return v.select("sid", "ts_s", "line", F.floor(F.col("ts_s") / 18000).alias("win"), F.when(F.col("sid").endswith("7"), 100 - up).otherwise(up).alias("pct_5h"), (F.col("ts_s") % 18000 / 1800).cast("double").alias("pct_7d"))


QUERIES = {
    "j1_blank_requests": (
        lambda s, d: ledger.drop_parent_replays(usage(s, d).withColumn("req", F.when(F.col("line") % 3 == 0, "").when(F.col("line") % 7 == 0, None).otherwise(F.col("req")))).select("sid", "req", "ts_s", "line"),
        sql(
            "SELECT sid, req, ts_s, line FROM blank u WHERE parent IS NULL OR coalesce(req, '') = '' OR NOT EXISTS (SELECT 1 FROM blank p WHERE p.parent IS NULL AND p.sid = u.parent AND p.req = u.req)",
            "blank AS (SELECT * REPLACE (CASE WHEN line % 3 = 0 THEN '' WHEN line % 7 = 0 THEN NULL ELSE req END AS req) FROM usage)",
        ),
    ),
    "a19_dow_tokens": (
        lambda s, d: report.dow_profile(settled(s, d).withColumn("tokens", F.expr(ALL)), "tokens"),
        REPORTS["a18_dow_profile"][1].replace("sum(cost_e8)", f"sum({ALL})"),
    ),
    "w24_burn_runs": (
        lambda s, d: limits.burn_runs(adapter.limit_samples(s, d), ["lane"]),
        sql(
            'SELECT lane, run::BIGINT AS run, min(ts_s) AS start, max(ts_s) AS "end", count(*)::BIGINT AS readings, arg_min(used_percent, (ts_s, line)) AS first, max(used_percent) AS top FROM runs GROUP BY lane, run',
            SAMPLES,
            "near AS (SELECT *, ts_s - lag(ts_s) OVER w AS pause, lag(used_percent) OVER w AS was, max(used_percent) OVER (PARTITION BY lane ORDER BY ts_s, line ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS ahead FROM samples WINDOW w AS (PARTITION BY lane ORDER BY ts_s, line))",
            "runs AS (SELECT *, sum((pause IS NULL OR pause > 7200 OR (was - used_percent > 8 AND ahead < was - 8))::INT) OVER (PARTITION BY lane ORDER BY ts_s, line) AS run FROM near)",
        ),
    ),
    "w7_used_in_span": (
        lambda s, d: windows.used_in_span(adapter.limit_samples(s, d), _long_lived(s, d).select("lane", F.col("start").alias("span_start"), F.col("active_end").alias("span_end")), ["lane"]),
        sql(
            "SELECT j.lane, j.start AS span_start, j.active_end AS span_end, arg_max(used_percent, (ts_s, line)) FILTER (WHERE ts_s < j.start) AS before, arg_min(used_percent, (ts_s, line)) FILTER (WHERE ts_s >= j.start) AS first_inside, arg_max(used_percent, (ts_s, line)) FILTER (WHERE ts_s >= j.start) AS last_inside, "
            "arg_max(used_percent, (ts_s, line)) FILTER (WHERE ts_s >= j.start) - coalesce(arg_max(used_percent, (ts_s, line)) FILTER (WHERE ts_s < j.start), arg_min(used_percent, (ts_s, line)) FILTER (WHERE ts_s >= j.start)) AS used FROM jit j JOIN samples s ON s.lane = j.lane AND s.ts_s < j.active_end GROUP BY ALL HAVING last_inside IS NOT NULL",
            *JIT,
        ),
    ),
    "m4_event_days": (
        lambda s, d: limits.exclude_event_days(_long_lived(s, d).select("lane", "start"), adapter.stated_starts(s, d).where("start % 7 = 0").select(F.floor(F.col("start") / 86400).alias("day"))),
        sql("SELECT lane, start FROM jit WHERE start // 86400 NOT IN (SELECT start // 86400 FROM starts WHERE start % 7 = 0)", *JIT),
    ),
    "p10_interactive": (
        lambda s, d: sessions.drop_non_interactive(_sids(s, d).withColumn("entrypoint", F.when(F.col("sid").endswith("3"), "sdk-cli").when(F.col("sid").endswith("4"), None).otherwise("cli")), "s3").select("sid"),
        sql("SELECT DISTINCT sid FROM settled WHERE sid NOT LIKE '%3' OR sid = 's3'"),
    ),
    "p11_restore_sessions": (
        lambda s, d: sessions.drop_restore_sessions(_sids(s, d).withColumn("skill_signature", F.when(F.col("sid").endswith("5"), F.concat(F.lit("skill:restore:"), "sid")).when(F.col("sid").endswith("6"), "other")), "restore:").select("sid"),
        sql("SELECT DISTINCT sid FROM settled WHERE sid NOT LIKE '%5'"),
    ),
    "p20_slash_command": (
        lambda s, d: _commands(s, d).where("role = 'user'").select("sid", "line", P.slash_command(F.col("text")).alias("command")),
        f"WITH {COMMANDS} SELECT sid, line, command FROM commands WHERE role = 'user'",
    ),
    "p22_injected": (
        lambda s, d: _docs(s, d).withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("  <environment_context>"), "text")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("# AGENTS.md"), "text")).otherwise(F.col("text"))).where(P.is_injected_context(F.col("text"))).select("doc_id"),
        "SELECT doc_id FROM documents WHERE doc_id % 4 < 2 AND text IS NOT NULL",
    ),
    "j12_session_project": (
        lambda s, d: sessions.session_project(
            _sids(s, d), _sids(s, d).where("sid like '%1' or sid like '%2'").withColumn("project", F.concat(F.lit("path-"), "sid")), _sids(s, d).where("sid like '%2' or sid like '%3'").withColumn("project", F.lit("listed"))
        ).select("sid", "project"),
        sql("SELECT DISTINCT sid, CASE WHEN sid LIKE '%1' OR sid LIKE '%2' THEN 'path-' || sid WHEN sid LIKE '%3' THEN 'listed' END AS project FROM settled"),
    ),
    "j16_restored_context": (lambda s, d: sessions.restored_context(_restores(s, d), settled(s, d)), sql("SELECT restore, context FROM restored", *RESTORED)),
    "a30_restore_savings": (
        lambda s, d: sessions.restore_savings(sessions.restored_context(_restores(s, d), settled(s, d)), s.createDataFrame([(50, 1000, 2500)], "r_cr long, r_cc1h long, r_out long")),
        sql("SELECT restore, context * 50 + context // 10 * 2500 AS best_e8, context * 1000 + context // 10 * 2500 AS worst_e8 FROM restored", *RESTORED),
    ),
    "a12_batch_groups": (
        lambda s, d: report.batch_groups(_docs(s, d).select(F.col("doc_id").alias("sid"), F.col("text").alias("first_text"), "source"), ["source"]),
        "SELECT source, regexp_replace(substr(text, 1, 80), '[0-9]+', '#', 'g') AS pattern, count(DISTINCT doc_id)::BIGINT AS sessions FROM documents GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2",
    ),
    "a41_compact_agents": (
        lambda s, d: sessions.compact_agent_aggregate(settled(s, d).withColumn("sid", F.when(F.col("parent").isNotNull(), F.concat(F.lit("agent-acompact-"), F.col("line") % 50)).otherwise(F.col("sid")))),
        sql(f"SELECT parent, 'agent-acompact-' || (line % 50) AS sid, arg_min(input + cc + cr, (ts_s, line)) AS context, sum(cost_e8)::BIGINT AS cost_e8, sum({ALL})::BIGINT AS tokens, count(*)::BIGINT AS calls FROM settled WHERE parent IS NOT NULL GROUP BY ALL"),
    ),
    "w12_fill_effort": (
        lambda s, d: sessions.fill_effort(adapter.turns(s, d).withColumn("text", F.when(F.col("line") % 3 == 1, F.concat(F.lit("Set effort level to "), F.when(F.col("sid") % 2 == 0, "High").otherwise("low"))).otherwise(F.col("text")))).select("sid", "line", "effort"),
        "SELECT conv_id AS sid, turn AS line, CASE WHEN turn >= 1 THEN CASE WHEN conv_id % 2 = 0 THEN 'high' ELSE 'low' END END AS effort FROM conversations",
    ),
    "w28_qualified_windows": (
        lambda s, d: sessions.qualified_windows(_window_samples(s, d)).select("win", "sid", F.round("rise_5h", 6).alias("rise_5h"), F.round("rise_7d", 6).alias("rise_7d"), "n"),
        sql(
            "SELECT win, sid, round(rise_5h, 6) AS rise_5h, round(rise_7d, 6) AS rise_7d, n FROM per WHERE NOT fell AND rise_5h >= 10 AND rise_7d >= 1 QUALIFY row_number() OVER (PARTITION BY win ORDER BY n DESC, sid) = 1",
            SAMPLES,
            "v AS (SELECT sid, ts_s, line, ts_s // 18000 AS win, CASE WHEN sid LIKE '%7' THEN 100 - ts_s % 18000 / 180.0::DOUBLE ELSE ts_s % 18000 / 180.0::DOUBLE END AS p5, ts_s % 18000 / 1800.0::DOUBLE AS p7 FROM samples)",
            "f AS (SELECT *, coalesce(p5 < lag(p5) OVER w OR p7 < lag(p7) OVER w, false) AS fell FROM v WINDOW w AS (PARTITION BY win, sid ORDER BY ts_s, line))",
            "per AS (SELECT win, sid, bool_or(fell) AS fell, max(p5) - min(p5) AS rise_5h, max(p7) - min(p7) AS rise_7d, count(*)::BIGINT AS n FROM f GROUP BY win, sid)",
        ),
    ),
    "w29_context_loss": (
        lambda s, d: sessions.context_loss_events(_commands(s, d)).select("sid", F.size("lines").cast("long").alias("n"), "last_event", "last_line"),
        f"WITH {COMMANDS}, e AS (SELECT sid, line, CASE WHEN command = 'clear' THEN 'clear' WHEN role = 'system' THEN 'compact' END AS event FROM commands) SELECT sid, count(*)::BIGINT AS n, arg_max(event, line) AS last_event, max(line) AS last_line FROM e WHERE event IS NOT NULL GROUP BY sid",
    ),
    "w31_turn_markers": (
        lambda s, d: restore.turn_markers(_commands(s, d).where("sid % 5 <> 0")).select("sid", "turn", "markers"),
        f"""WITH {COMMANDS},
        m AS (SELECT *, role = 'user' AND command IS NULL AS is_turn, CASE WHEN role = 'system' OR command = 'compact' THEN '+' WHEN command = 'reload' THEN '~' WHEN command = 'model' THEN '!' END AS marker FROM commands WHERE sid % 5 <> 0),
        g AS (SELECT *, min(line) FILTER (WHERE is_turn) OVER (PARTITION BY sid ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS turn FROM m),
        firsts AS (SELECT sid, turn, marker, min(line) AS line FROM g WHERE marker IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
        stacked AS (SELECT sid, turn, string_agg(marker, '' ORDER BY line) AS markers FROM firsts GROUP BY sid, turn)
        SELECT m.sid, m.line AS turn, coalesce(markers, CASE WHEN m.line = min(m.line) OVER (PARTITION BY m.sid) THEN '@' ELSE '' END) AS markers
        FROM m LEFT JOIN stacked ON m.sid = stacked.sid AND m.line = stacked.turn WHERE m.is_turn""",
    ),
    "u2_union_hosts": (
        lambda s, d: ledger.union_hosts(settled(s, d), _codex(s, d)).groupBy("host", "cost_unknown").agg(*[F.sum(c).alias(c) for c in ("input", "cc", "cc5m", "cc1h", "cr", "out", "cost_e8")], F.count(F.lit(1)).alias("n")),
        sql(
            "SELECT 'claude' AS host, false AS cost_unknown, sum(input)::BIGINT AS input, sum(cc)::BIGINT AS cc, sum(cc5m)::BIGINT AS cc5m, sum(cc1h)::BIGINT AS cc1h, sum(cr)::BIGINT AS cr, sum(out)::BIGINT AS out, sum(cost_e8)::BIGINT AS cost_e8, count(*)::BIGINT AS n FROM settled "
            "UNION ALL SELECT 'codex', true, sum(greatest(iv - 3 * k, 0))::BIGINT, sum(k)::BIGINT, 0, sum(k)::BIGINT, sum(3 * k)::BIGINT, sum(2 * iv)::BIGINT, 0, count(*)::BIGINT FROM ev WHERE event_type = 'view'"
        ),
    ),
    "t3_ledger_segments": (
        lambda s, d: sessions.ledger_segments(adapter.turns(s, d).withColumn("batch", F.floor(F.col("line") / 3))).select("sid", "batch", F.size("entries").cast("long").alias("n"), F.element_at("entries", 1)["line"].alias("first_line"), F.sha2(F.array_join(F.transform("entries", lambda e: e["text"]), "|"), 256).alias("texts")),
        "SELECT conv_id AS sid, turn // 3 AS batch, count(*)::BIGINT AS n, min(turn) AS first_line, sha256(string_agg(text, '|' ORDER BY turn)) AS texts FROM conversations GROUP BY ALL",
    ),
    "f1_call_cost": (
        lambda s, d: _sql_cost(s, d),
        sql("SELECT sid, line, cost_e8 FROM usage"),
    ),
}


def _sql_cost(s, d):
    """F1 in SQL."""
    from ..functions import scalars
    from ..operators import pricing

    scalars.register(s)
    rows = usage(s, d).join(F.broadcast(pricing.pricing_table(s)), "model")  # one row a model
    return rows.select("sid", "line", F.expr("call_cost_e8(input, cc5m, cc1h, cr, out, r_input, r_cc5m, r_cc1h, r_cr, r_out)").alias("cost_e8"))
