"""Fixture tests of rollout files, side files, listings and the ledger's rules for copies."""

import json

from pyspark.sql import functions as F

from meterwright.operators import accounts, exports, ledger, windows
from meterwright.sources import transcripts

CALL = "sid string, parent string, req string, ts_s long, line long"


def rollout(spark, objects):
    df = spark.createDataFrame([("f", k + 1, json.dumps(o)) for k, o in enumerate(objects)], "path string, line_no long, raw string")
    return df.withColumn("v", F.parse_json("raw"))


def test_codex_rows_keep_their_lines(spark):
    message = lambda role, *texts: {"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"text": t} for t in texts]}}
    df = rollout(spark, [{"type": "session_meta", "payload": {"id": "a"}}, message("user", "x", "y"), message("assistant", "z"), message("developer", "d"), {"type": "response_item", "payload": {"type": "function_call", "name": "shell"}}, {"type": "compacted"}, {"other": 1}])
    got = sorted((r.line_no, r.role, r.text) for r in transcripts.normalize_codex(df).collect())
    assert got == [(1, "placeholder", None), (2, "user", "x\ny"), (3, "assistant", "z"), (4, "placeholder", None), (5, "tool", "shell"), (6, "system", None), (7, "placeholder", None)]


def test_codex_heads(spark):
    heads = [("f", 1, {"type": "session_meta", "payload": {"id": "a", "source": {"subagent": "review"}, "session_id": "t"}}), ("f", 2, {"type": "session_meta", "payload": {"id": "late"}}), ("g", 1, {"type": "session_meta", "payload": {"id": "b"}}), ("h", 1, {"type": "event_msg"})]
    df = spark.createDataFrame([(p, n, json.dumps(o)) for p, n, o in heads], "path string, line_no long, raw string").withColumn("v", F.parse_json("raw"))
    got = sorted((r.path, r.sid, r.thread, r.is_subagent) for r in transcripts.codex_rollouts(df).collect())
    assert got == [("f", "a", "t", True), ("g", "b", "b", False)]


def test_agents_side_files(spark, tmp_path):
    (tmp_path / "agent-1.meta.json").write_text('{\n "agentType": "explore",\n "description": "look", "more": 1\n}')
    (tmp_path / "agent-2.meta.json").write_text('{"description": "no kind"}')
    got = sorted((r.path.rsplit("/", 1)[1], r.agent_type, r.description) for r in exports.agent_meta(spark, [f"file://{tmp_path}/*.meta.json"]).collect())
    assert got == [("agent-1.meta.json", "explore", "look"), ("agent-2.meta.json", None, "no kind")]


def test_changed_files(spark):
    listing = spark.createDataFrame([("same", 1, 10), ("newer", 2, 10), ("longer", 1, 11), ("old version", 1, 10), ("new", 1, 1)], "path string, mtime long, size long")
    done = spark.createDataFrame([("same", 1, 10, 3), ("newer", 1, 10, 3), ("longer", 1, 10, 3), ("old version", 1, 10, 2)], "path string, mtime long, size long, version int")
    assert {r.path for r in transcripts.changed_files(listing, done, 3).collect()} == {"newer", "longer", "old version", "new"}


def test_vanished_sessions_count_in_their_period(spark):
    derived = spark.createDataFrame([("listed", 5), ("gone", 50), ("gone early", 5)], "sid string, last_ts long")
    listed = spark.createDataFrame([("listed",), ("listed",), ("new",)], "sid string")
    assert sorted(r.sid for r in transcripts.retained_sessions(derived, listed, 10).collect()) == ["gone", "listed"]


def test_workflow_journals_go(spark):
    paths = ["/p/s/workflows/w1/journal.jsonl", "/p/s/workflows/w1/agent-1.jsonl", "/p/journal.jsonl"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r.path for r in transcripts.drop_workflow_journals(df).collect()) == sorted(paths[1:])


def test_replays_of_the_parent_go(spark):
    rows = [("m", None, "r1", 1, 1), ("a", "m", "r1", 2, 1), ("a", "m", "r1", 3, 2), ("a", "m", "r2", 4, 3), ("b", "other", "r1", 5, 1), ("a", "m", None, 6, 4), ("m", None, None, 7, 2), ("m", None, None, 7, 2), ("m", None, "r1", 8, 3)]
    got = sorted((r.sid, r.line) for r in ledger.drop_parent_replays(spark.createDataFrame(rows, CALL)).collect())
    assert got == [("a", 3), ("a", 4), ("b", 1), ("m", 1), ("m", 2), ("m", 2), ("m", 3)]
    assert ledger.drop_parent_replays(spark.createDataFrame([], CALL)).count() == 0


def test_requests_count_once(spark):
    rows = [("late", None, "r", 5, 1), ("early", None, "r", 9, 7), ("early", None, "x", 1, 1), ("early", None, None, 2, 2), ("early", None, None, 2, 2), ("late", None, "", 6, 2), (None, None, "y", 3, 1), (None, None, None, 3, 2)]
    out = ledger.count_request_once(spark.createDataFrame(rows, CALL))
    got = sorted((r.sid or "-", r.req or "-", r.line) for r in out.collect())
    assert out.columns == ["sid", "parent", "req", "ts_s", "line"]
    assert got == [("-", "-", 2), ("-", "y", 1), ("early", "-", 2), ("early", "-", 2), ("early", "r", 7), ("early", "x", 1), ("late", "-", 2)]


def test_accounts_carry_over_days(spark):
    day = 86400
    changes = spark.createDataFrame([("s1", day + 10, "A", 1), ("s2", 4 * day + 5, "B", 1), ("s2", 4 * day + 5, "C", 2)], "sid string, ts_s long, account string, line long")
    times = [0, day + 9, day + 10, 2 * day, 3 * day + 1, 4 * day + 4, 4 * day + 5, 4 * day + 6, 9 * day]
    rows = spark.createDataFrame([(t,) for t in times], "ts_s long")
    got = [r.any_account for r in accounts.account_anywhere(rows, changes).orderBy("ts_s").collect()]
    assert got == [None, None, "A", "A", "A", "A", "C", "C", "C"]
    assert {r.any_account for r in accounts.account_anywhere(rows, changes.limit(0)).collect()} == {None}


def test_stated_windows_before_blocks(spark):
    rows = spark.createDataFrame([("a", t) for t in (5, 100, 101, 150, 210, 230, 400)], "account string, ts_s long")
    stated = spark.createDataFrame([("a", 100, 140)], "account string, start long, end long")
    got = [(r.ts_s, r.win, r.stated) for r in windows.window_or_block(rows, stated, ["account"], 100).orderBy("ts_s").collect()]
    assert got == [(5, 5, False), (100, 100, True), (101, 100, True), (150, 150, False), (210, 150, False), (230, 150, False), (400, 400, False)]
