"""Queries on sessions, markers, restores and studies, with their DuckDB twins where SQL is short enough."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ledger, sessions, windows
from . import adapter
from .adapter import accounted, settled, sql
from .ledger_queries import HELD, SPLIT, _windowed, wsql
from .text_queries import SAMPLES, STRIP

ALL = "input + cc + cr + out"


def _sessions(spark, d):
    return ledger.session_summary(settled(spark, d))


def _split(spark, d):
    return windows.split_intervals(adapter.stated_starts(spark, d), ["account"])


def _turns(spark, d):
    return adapter.turns(spark, d)


def _tagged_samples(spark, d):
    s = adapter.limit_samples(spark, d)
    return s.withColumn("tag", F.when(F.col("line") % 6 == 0, F.concat(F.lit("t"), F.col("line") % 4)))


def _messages(spark, d):
    rows = accounted(spark, d)
    return rows.select("account", "ts_s", "line", F.col("req").alias("text"))


QUERIES = {
    "o1_list_sessions": (
        lambda s, d: sessions.list_sessions(_sessions(s, d), 10, 5).select("sid", "last_ts"),
        sql("SELECT sid, max(ts_s) AS last_ts FROM settled GROUP BY sid ORDER BY last_ts DESC, sid LIMIT 10 OFFSET 5"),
    ),
    "o2_current_session": (
        lambda s, d: sessions.current_session(_sessions(s, d), 1_800_000_000),
        sql("SELECT arg_max(sid, (m, sid)) AS sid, 1800000000 - max(m) AS age FROM (SELECT sid, max(ts_s) AS m FROM settled GROUP BY sid)"),
    ),
    "o7_session_order": (
        lambda s, d: sessions.session_order(_windowed(s, d).groupBy("account", "win", "sid").agg(F.sum("cost_e8").alias("cost_e8")).withColumn("type", F.when(F.col("sid").startswith("agent"), "programmatic").otherwise("main")), ["account", "win"]).select("account", "win", "sid", "place"),
        wsql("SELECT account, win, sid, row_number() OVER (PARTITION BY account, win ORDER BY sid LIKE 'agent%', c DESC, sid)::INT AS place FROM (SELECT account, win, sid, sum(cost_e8) AS c FROM windowed GROUP BY ALL)"),
    ),
    "u4_host_overlap": (
        lambda s, d: sessions.host_overlap(settled(s, d), settled(s, d).withColumn("sid", F.when(F.col("model").contains("opus"), F.col("sid")).otherwise(F.concat(F.lit("x"), "sid")))),
        sql("SELECT sid FROM settled INTERSECT SELECT CASE WHEN model LIKE '%opus%' THEN sid ELSE 'x' || sid END FROM settled"),
    ),
    "p2_scope_project": (
        lambda s, d: sessions.scope_project(s.read.parquet(f"{d}/documents.parquet"), "src1", "source").select("doc_id"),
        "SELECT doc_id FROM documents WHERE source = 'src1'",
    ),
    "p14_drop_sidechain": (
        lambda s, d: sessions.drop_sidechain(_turns(s, d).withColumn("is_sidechain", F.when(F.col("line") % 3 == 0, True))).select("sid", "line"),
        "SELECT conv_id AS sid, turn AS line FROM conversations WHERE turn % 3 <> 0",
    ),
    "j13_parent_link": (
        lambda s, d: sessions.parent_link(settled(s, d).select("sid", "parent").distinct()).select("sid", "parent", "orphan"),
        sql("SELECT sid, parent, parent IS NOT NULL AND parent NOT IN (SELECT sid FROM settled WHERE parent IS NULL) AS orphan FROM (SELECT DISTINCT sid, parent FROM settled)"),
    ),
    "s4_orphan_agents": (
        lambda s, d: _orphans(s, d),
        sql("SELECT sid, parent IS NOT NULL AS is_agent FROM (SELECT DISTINCT sid, parent FROM no_replay) WHERE parent IS NULL OR parent IN (SELECT sid FROM no_replay WHERE parent IS NULL)"),
    ),
    "s3_path_dims": (
        lambda s, d: _paths(s, d),
        "SELECT doc_id, source AS project, CASE WHEN doc_id % 2 = 0 THEN 'agent-a' || doc_id ELSE 's' || doc_id END AS sid, doc_id % 2 = 0 AS is_agent, CASE WHEN doc_id % 2 = 0 THEN 'wf-a' || doc_id END AS agent_id FROM documents",
    ),
    "j14_alerts": (
        lambda s, d: sessions.alerts_in_window(accounted(s, d).withColumn("alert", F.when(F.col("k") >= 90, "danger").otherwise("warn")), _split(s, d), ["account"]),
        sql("SELECT account, win, CASE WHEN k >= 90 THEN 'danger' ELSE 'warn' END AS alert, count(*)::BIGINT AS n FROM held WHERE win IS NOT NULL GROUP BY ALL", SPLIT, HELD),
    ),
    "j15_window_messages": (
        lambda s, d: sessions.window_messages(_messages(s, d), _split(s, d), ["account"]),
        sql("SELECT account, win, arg_min(req, (ts_s, line)) AS first_text, arg_max(req, (ts_s, line)) AS last_text, count(*)::BIGINT AS messages FROM held WHERE win IS NOT NULL GROUP BY account, win", SPLIT, HELD),
    ),
    "j17_blocked_samples": (
        lambda s, d: sessions.blocked_samples(accounted(s, d).withColumn("used_percent", F.col("k") + 1), _split(s, d), ["account"]),
        sql("SELECT account, win, count(*) FILTER (WHERE k >= 99)::BIGINT AS blocked, min(ts_s) FILTER (WHERE k >= 99) AS first_blocked FROM held WHERE win IS NOT NULL GROUP BY account, win", SPLIT, HELD),
    ),
    "j21_interval_usage": (
        lambda s, d: sessions.interval_usage(accounted(s, d), _split(s, d), ["account"]),
        sql(f"SELECT account, win, sum(cost_e8)::BIGINT AS cost_e8, sum({ALL})::BIGINT AS tokens, count(*)::BIGINT AS calls FROM held WHERE win IS NOT NULL GROUP BY account, win", SPLIT, HELD),
    ),
    "a43_period_overview": (
        lambda s, d: sessions.period_overview(settled(s, d)),
        sql(f"SELECT host, sum({ALL})::BIGINT AS tokens, count(DISTINCT sid)::BIGINT AS sessions, min(ts_s) AS first_ts, max(ts_s) AS last_ts FROM settled GROUP BY host"),
    ),
    "a47_highlights": (
        lambda s, d: sessions.usage_highlights(settled(s, d)),
        sql(" UNION ALL ".join(f"SELECT '{n}' AS what, arg_max(k, (v, -k)) AS which, max(v)::BIGINT AS cost_e8 FROM (SELECT {e} AS k, sum(cost_e8) AS v FROM settled GROUP BY 1)" for n, e in (("busiest_hour", "ts_s // 3600 % 24"), ("busiest_weekday", "(ts_s // 86400 + 4) % 7"), ("peak_day", "ts_s // 86400")))),
    ),
    "a11_programmatic": (
        lambda s, d: sessions.programmatic_bundle(_windowed(s, d), settled(s, d).select("sid").distinct().withColumn("programmatic", F.col("sid").endswith("3")), ["account"]),
        wsql(f"SELECT account, win, count(DISTINCT sid)::BIGINT AS sessions, sum(cost_e8)::BIGINT AS cost_e8, sum({ALL})::BIGINT AS tokens FROM windowed WHERE sid LIKE '%3' GROUP BY account, win"),
    ),
    "w27_nearest_tag": (
        lambda s, d: sessions.nearest_tag(_tagged_samples(s, d)).select("sid", "line", "tag"),
        sql(
            "SELECT x.sid, x.line, CASE WHEN a.tag IS NOT NULL AND (b.tag IS NULL OR a.ts_s - x.ts_s < x.ts_s - b.ts_s) THEN a.tag ELSE b.tag END AS tag FROM samples x ASOF LEFT JOIN tags b ON x.sid = b.sid AND x.ts_s >= b.ts_s ASOF LEFT JOIN tags a ON x.sid = a.sid AND x.ts_s <= a.ts_s",
            SAMPLES,
            "tags AS (SELECT sid, ts_s, 't' || (line % 4) AS tag FROM samples WHERE line % 6 = 0)",
        ),
    ),
    "w34_jump_study": (
        lambda s, d: sessions.jump_study(settled(s, d).withColumn("grp", F.col("user_id") % 3), adapter.limit_samples(s, d).withColumn("grp", F.regexp_extract("sid", r"\d+", 0).cast("long") % 3), "grp").select("grp", "line", "rise", F.col("other_calls").cast("long").alias("other_calls")),
        sql(
            "SELECT e.grp, e.line, (SELECT max(used_percent) FROM r WHERE r.grp = e.grp AND r.ts_s BETWEEN e.ts_s + 180 AND e.ts_s + 1800) - (SELECT max(used_percent) FROM r WHERE r.grp = e.grp AND r.ts_s <= e.ts_s) AS rise, (SELECT count(*) FROM c WHERE c.grp = e.grp AND c.ts_s BETWEEN e.ts_s + 180 AND e.ts_s + 1800)::BIGINT AS other_calls FROM c e WHERE cc >= 10000",
            SAMPLES,
            "c AS (SELECT *, user_id % 3 AS grp FROM settled)",
            "r AS (SELECT *, substr(sid, 2)::BIGINT % 3 AS grp FROM samples)",
        ),
    ),
    "m5_controlled_rate": (
        lambda s, d: sessions.controlled_rate(settled(s, d).select("req", (F.col("input") + F.col("cr")).alias("tokens"), F.col("k").cast("double").alias("rise"), (F.col("k") / 4).alias("known"))).select("req", F.round("rate", 9).alias("rate")),
        sql("SELECT req, CASE WHEN input + cr > 0 THEN round((k - k / 4.0::DOUBLE) / (input + cr) * 1e6, 9) END AS rate FROM settled"),
    ),
    "p23_first_last": (
        lambda s, d: sessions.first_and_last_message(_turns(s, d)),
        "SELECT conv_id AS sid, arg_min(t, turn) AS first_text, arg_max(t, turn) AS last_text, count(*)::BIGINT AS messages FROM (SELECT conv_id, turn, " + STRIP.format("text") + " AS t FROM conversations WHERE role = 'user') WHERE t <> '' GROUP BY conv_id",
    ),
}


def _orphans(spark, d):
    from ..sources import transcripts

    files = ledger.drop_parent_replays(adapter.usage(spark, d)).select("sid", "parent").distinct()
    files = files.withColumns({"project": F.lit("p"), "is_agent": F.col("parent").isNotNull()})
    return transcripts.drop_orphan_agents(files).select("sid", "is_agent")


def _paths(spark, d):
    from ..sources import transcripts

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    agent = F.concat(F.lit("/home/x/projects/"), "source", F.lit("/s1/subagents/workflows/wf/agent-a"), "doc_id", F.lit(".jsonl"))
    main = F.concat(F.lit("/home/x/projects/"), "source", F.lit("/s"), "doc_id", F.lit(".jsonl"))
    files = docs.withColumn("path", F.when(F.col("doc_id") % 2 == 0, agent).otherwise(main))
    return transcripts.with_path_dims(files).select("doc_id", "project", "sid", "is_agent", "agent_id")
