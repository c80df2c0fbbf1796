"""Golden values, invariants, and a sample of the registered queries against their DuckDB twins."""

import json
import numbers
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterwright.functions import predicates as P
from meterwright.functions import scalars as S
from meterwright.operators import accounts, counters, ledger, limits, pricing, report, turns, windows
from meterwright.plans import catalog
from meterwright.sources import transcripts

H = 3600
T = 1_700_000_000


def test_split_windows(spark):
    starts = spark.createDataFrame([("a", T), ("a", T + 2 * H)], "account string, start long")
    rows = spark.createDataFrame([("a", T + 600), ("a", T + 2 * H + 600), ("a", T + 4 * H)], "account string, ts_s long")
    split = windows.split_intervals(starts, ["account"])
    assert sorted(map(tuple, split.collect())) == [("a", T, T + 2 * H), ("a", T + 2 * H, T + 7 * H)]
    got = windows.assign_stated_window(rows, split, ["account"]).groupBy("win").count()
    assert sorted(map(tuple, got.collect())) == [(T, 1), (T + 2 * H, 2)]


def test_merge_windows_by_account(spark):
    one = spark.createDataFrame([("x", T), ("x", T + 3 * H)], "account string, start long")
    two = spark.createDataFrame([("x", T), ("y", T + 3 * H)], "account string, start long")
    assert [(r.start, r.end) for r in windows.merge_intervals(one, ["account"]).collect()] == [(T, T + 8 * H)]
    assert sorted(r.end - r.start for r in windows.merge_intervals(two, ["account"]).collect()) == [5 * H, 5 * H]
    touching = spark.createDataFrame([("x", T), ("x", T + 5 * H)], "account string, start long")
    assert windows.merge_intervals(touching, ["account"]).count() == 2


def test_jitter_windows(spark):
    resets = [T + 5 * H, T + 7 * H, T + 7 * H + 3]
    df = spark.createDataFrame([("p", 300, r, 10.0) for r in resets], "lane string, window_minutes long, resets_at long, used_percent double")
    got = windows.jitter_windows(df, ["lane"]).orderBy("start").collect()
    assert [(r.start, r.end, r.active_end) for r in got] == [(T, T + 5 * H, T + 2 * H + 3), (T + 2 * H + 3, T + 7 * H + 3, T + 7 * H + 3)]


def test_anchored_blocks_hold_their_rows(spark):
    rows = spark.createDataFrame([("a", T + k * 1700) for k in range(60)] + [("a", T + 60 * 1700 + 6 * H)], "account string, ts_s long")
    got = windows.anchored_blocks(rows, ["account"]).collect()
    assert all(r.block <= r.ts_s < r.block + 5 * H for r in got) and len(got) == 61


def test_counter_golden(spark):
    rows = [(1, (1000,), (1000,)), (2, (1000,), (999,)), (3, (1500,), (500,)), (4, (1000,), (100,)), (5, None, (50,)), (6, None, (999,)), (7, (1200,), None)]
    df = spark.createDataFrame([("s", n, t, x) for n, t, x in rows], "sid string, line long, total struct<input:long>, last struct<input:long>")
    got = [(r.delta_input, r.diagnostic) for r in counters.counter_delta(df, ["input"]).orderBy("line").collect()]
    assert got == [(1000, None), (0, None), (500, None), (100, "counter_reset"), (50, "missing_total_fallback"), (0, "missing_total_suppressed"), (200, None)]


def test_delta_row(spark):
    df = spark.createDataFrame([(100, 300, None)], "delta_input long, delta_cached long, diagnostic string")
    r = counters.delta_row(df).first()
    assert r.fresh == 0 and r.diagnostics == ["cached_exceeds_input"]


@pytest.mark.parametrize(
    ("rows", "divisor", "want"),
    [
        ([("m", 10**6, 10**6, 10**6, 0)], 25, ("exact", None, 610.0, 24.4)),
        ([("m", 10**6, 10**6, 10**6, 0), ("other", 500_000, 0, 0, 0)], 25, ("lower_bound", None, 610.0, 24.4)),
        ([("other", 5, 0, 0, 0)], 25, ("unavailable", "no_priced_models", None, None)),
        ([("m", 0, 0, 0, 9)], 25, ("unavailable", "no_eligible_tokens", None, None)),
        ([("m", 1, 0, 0, 0)], 0, ("unavailable", "invalid_config", None, None)),
    ],
)
def test_credits(spark, rows, divisor, want):
    card = spark.createDataFrame([("m", 100.0, 10.0, 500.0)], "id string, fresh double, cached double, output double")
    df = spark.createDataFrame(rows, "model string, fresh long, cached long, output long, written long")
    r = counters.credit_equivalent(df, card, divisor).first()
    assert (r.status, r.reason, r.credits, r.usd and round(r.usd, 6)) == want


def test_requests_count_once(spark):
    rows = [("A", None, 10, 1, "req_A"), ("A", None, 20, 2, "req_B"), ("B", None, 15, 1, "req_A"), ("B", None, 25, 2, "req_B"), ("B", None, 30, 3, "req_C"), ("B", None, 31, 4, None), ("B", None, 31, 5, None)]
    df = spark.createDataFrame(rows, "sid string, parent string, ts_s long, line long, req string")
    once = ledger.count_request_once(df)
    assert sorted((r.sid, r.req) for r in ledger.rows_since(once, 12).where("req is not null").collect()) == [("A", "req_B"), ("B", "req_C")]
    assert once.count() == 5 and ledger.count_request_once(once).count() == 5


def test_merge_samples(spark):
    rows = [("s1", 1, 10, "L", "p", 80.0), ("s2", 2, 20, "L", "p", 85.0), ("s1", 3, 10, None, "p", 1.0), ("s2", 4, 10, None, "p", 2.0)]
    df = spark.createDataFrame([(*r, 300, 99) for r in rows], "sid string, line long, ts_s long, limit_id string, lane string, used_percent double, window_minutes long, resets_at long")
    got = counters.merge_limit_samples(df).collect()
    assert sorted((r.limit_id or "", r.used_percent, r.sessions) for r in got) == [("", 1.0, 1), ("", 2.0, 1), ("L", 85.0, 2)]


def test_attribution_adds_up(spark):
    rows = [("m", None, 1350, "x"), ("agent-1", "m", 440, "y"), ("agent-2", "m", 390, "y"), ("agent-3", "m", 220, "x")]
    df = spark.createDataFrame([(s, p, n, 0, 0, 0, n, m) for s, p, n, m in rows], "sid string, parent string, input long, out long, cc long, cr long, cost_e8 long, model string")
    role = F.when(F.col("sid") == "agent-1", "researcher").when(F.col("sid") == "agent-2", "worker")
    parts = report.attribution(df, role)
    got = {(r.level, r.name): r.total for r in parts.collect()}
    assert got[("all", "all")] == 2400 and got[("kind", "main")] == 1350 and got[("kind", "agents")] == 1050
    assert (got[("role", "researcher")], got[("role", "worker")], got[("role", "unknown")]) == (440, 390, 220)
    assert report.attribution_integrity(parts).count() == 0


def test_grid_keeps_models_apart(spark):
    df = spark.createDataFrame([(1.0, 1.0, m) for m, n in (("a", 60), ("b", 40)) for _ in range(n)], "x double, y double, model string")
    assert sorted(r.n for r in report.grid_density(df.withColumn("grp", F.col("model")), 100, ["grp"]).collect()) == [40, 60]


def test_unknown_model_fails_the_job(spark):
    df = spark.createDataFrame([("nope",)], "model string")
    with pytest.raises(ValueError, match="nope"):
        pricing.require_priced(df, pricing.pricing_table(spark))


def test_texts(spark):
    text = "```\na\n``` x\n- a\n- b\n- c\n| h | i |\n|---|---|\n| 1 | 2 |\n"
    long = "word " * 200
    df = spark.createDataFrame([(text, long, "한국어 텍스트")], "t string, l string, k string")
    r = df.select(
        S.structure_counts(F.col("t")).alias("c"), S.abstract_structures(F.col("t")).alias("a"), S.truncate_user(F.col("l")).alias("u"), S.truncate_reply(F.col("l")).alias("r"), S.script_scale(F.col("k")).alias("s"), S.head_of(F.col("l"), 10).alias("h"), P.slash_command(F.lit("<command-name>/x:clear</command-name>")).alias("cmd")
    ).first()
    assert tuple(r.c) == (1, 1, 1) and r.a == "[Code] x\n[List][Table]"
    assert r.u.startswith("word") and "lines omitted" in r.u and len(r.u) < 530 and "[...truncated...]" in r.r
    assert r.s == 2 / 3 and r.h == "word word ..." and r.cmd == "clear"


def test_nonneg_fit(spark):
    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 3).cast("double").alias("c"))
    df = df.withColumn("y", 2 * F.col("a") + 0.5 * F.col("b") - 0.2 * F.col("c"))
    fit = limits.fit_nonneg(df, ["a", "b", "c"], "y")
    assert fit["c"] == 0 and abs(fit["a"] - 2) < 0.2 and fit["b"] > 0.2


def test_nearest_marker_takes_each_agent_once(spark):
    marks = spark.createDataFrame([("s", 100, 1), ("s", 150, 2), ("s", 9000, 3)], "sid string, ts_s long, line long")
    agents = spark.createDataFrame([("s", 110, "x"), ("s", 400, "y")], "sid string, ts_s long, agent string")
    assert sorted((r.line, r.agent) for r in turns.merge_nearest_once(marks, agents).collect()) == [(1, "x"), (2, "y")]


def test_nearest_marker_against_brute_force(spark):
    rng = random.Random(8)
    marks = [(s, rng.randrange(20_000), k) for k in range(60) for s in "ab"]
    agents = [(s, rng.randrange(20_000) // 50 * 50, f"{k:02d}") for k in range(80) for s in "ac"]
    want, free = [], sorted(agents, key=lambda a: a[1:])
    for s, ts, line in sorted(marks):
        best = min((a for a in free if a[0] == s), key=lambda a: (abs(a[1] - ts), a[1]), default=None)
        if best and abs(best[1] - ts) <= 600:
            free.remove(best)
            want.append((s, line, best[2]))
    got = turns.merge_nearest_once(spark.createDataFrame(marks, "sid string, ts_s long, line long"), spark.createDataFrame(agents, "sid string, ts_s long, agent string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_nearest_query_takes_all_main_rows(spark):
    from meterwright.plans import report_queries

    d = "/root/testdata/sf0.001"
    assert report_queries._near_sides(spark, d)[0].count() == report_queries.settled(spark, d).where("parent is null").count()


def test_transcripts(spark, tmp_path):
    root = tmp_path / "projects" / "p1"
    (root / "s1" / "subagents" / "workflows" / "wf_x").mkdir(parents=True)
    use = {"input_tokens": 5, "cache_creation_input_tokens": 7, "cache_read_input_tokens": 11, "output_tokens": 3}
    call = {"type": "assistant", "timestamp": "2026-01-02T03:04:05Z", "requestId": "r1", "message": {"model": "claude-opus-5", "usage": use, "content": [{"type": "text", "text": "hi"}, {"type": "tool_use"}]}}
    (root / "s1.jsonl").write_text("\n".join([json.dumps({"type": "user", "message": {"content": "hello"}}), "not json", "", json.dumps(call)]) + "\n")
    (root / "s1" / "subagents" / "agent-a1.jsonl").write_text(json.dumps(call) + "\n")
    (root / "s1" / "subagents" / "workflows" / "wf_x" / "agent-a1.jsonl").write_text(json.dumps(call) + "\n")
    (root / "s2").mkdir()
    files = [str(p) for p in root.rglob("*.jsonl")]
    lines = transcripts.scan_transcripts(spark, files)
    parsed = transcripts.with_path_dims(transcripts.parse_tolerant(transcripts.union_roots([lines, lines])))
    assert sorted(r.line_no for r in parsed.where("not is_agent").collect()) == [1, 4]
    assert sorted(r.agent_id for r in parsed.where("is_agent").collect()) == ["a1", "wf_x-a1"]
    assert transcripts.drop_orphan_agents(parsed).count() == 4 and {r.project for r in parsed.collect()} == {"p1"}
    texts = {r.t for r in parsed.where("not is_agent").select(transcripts.content_text(F.col("v")).alias("t")).collect()}
    assert texts == {"hello", "hi"}
    rows = ledger.cache_tiers(transcripts.usage_rows(parsed))
    r = rows.where("line = 4").first()
    assert (r.input, r.cc1h, r.cr, r.out, r.req, r.ts_s) == (5, 7, 11, 3, "r1", 1767323045)
    assert ledger.drop_parent_replays(rows).count() == 1


def test_pricing_file(spark, tmp_path):
    file = tmp_path / "prices.json"
    file.write_text(json.dumps({"models": {"m-1": {"input": 5, "cacheCreate5m": 6.25, "cacheCreate1h": 10, "cacheRead": 0.5, "output": 25, "contextWindow": 1000}}, "aliases": {"m": "m-1"}}))
    got = sorted(map(tuple, pricing.pricing_from_json(spark, str(file)).select("model", "r_cc5m", "context_window").collect()))
    assert got == [("m", 625, 1000), ("m-1", 625, 1000)]


def test_only_real_account_switches(spark):
    df = spark.createDataFrame([("s", 1, "a", 1), ("s", 2, "a", 2), ("s", 3, "b", 3), ("s", 4, "a", 4)], "sid string, ts_s long, account string, line long")
    assert sorted(r.ts_s for r in accounts.account_changes(df).collect()) == [1, 3, 4]


@pytest.mark.parametrize("name", ["a15_daily_cost", "j5_account_global", "w3_anchored_blocks", "w9_counter_delta", "a17_hour_profile", "a13_turn_aggregate", "s17_export_log", "j10_nearest_once", "w25_burn_intervals", "t1_compact_transcripts", "t5_tight_budgets", "t10_cut_tails"])
def test_twins_agree(spark, name):
    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in os.listdir(base):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{base}/{t}'")
    got = catalog.queries()[name](spark, base).toPandas()
    want = con.sql(catalog.oracle_sql()[name]).df()[list(got.columns)]
    rows = lambda f: sorted(tuple("" if pd.isna(x) else round(float(x), 6) if isinstance(x, numbers.Number) else str(x) for x in r) for r in f.itertuples(index=False))
    assert rows(got) == rows(want)
