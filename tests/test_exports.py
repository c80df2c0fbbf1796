"""Exports, alignment, agents' messages and block estimates on small fixtures."""

import json

from pyspark.sql import functions as F

from meterwright.operators import exports
from meterwright.sources import transcripts


def variants(spark, objects, **more):
    df = spark.createDataFrame([("f", k + 1, json.dumps(o)) for k, o in enumerate(objects)], "path string, line_no long, raw string")
    return df.withColumn("v", F.parse_json("raw"))


def test_block_tokens_and_images(spark):
    content = [{"type": "text", "text": "x" * 40}, {"type": "image"}, {"type": "tool_result", "content": [{"type": "text", "text": "y" * 8}]}, {"type": "tool_result", "content": "z" * 4}, {"type": "thinking", "thinking": "t" * 12}]
    df = variants(spark, [{"message": {"content": content}}, {"message": {"content": "w" * 20}}])
    got = df.select("line_no", exports.est_block_tokens(F.col("v")).alias("n"), exports.image_markers(F.col("v")).alias("i")).orderBy("line_no").collect()
    assert [r.n for r in got] == [10 + 2000 + 2 + 1 + 3, 5] and [r.i for r in got] == ["[Image]", ""]


def test_agent_messages(spark):
    call = lambda name, args: {"type": "response_item", "payload": {"type": "function_call", "name": name, "arguments": json.dumps(args)}}
    told = lambda text: {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"text": text}]}}
    df = variants(spark, [call("collaboration.spawn_agent", {"task": "do it", "agent_type": "w"}), call("shell", {"message": "no"}), told("Message Type: FINAL_ANSWER\ndone"), told("about Message Type: MESSAGE"), call("send_message", {})])
    got = sorted((r.line_no, r.direction, r.kind, r.peer, r.text) for r in exports.agent_messages(df).collect())
    assert got == [(1, "outgoing", "spawn_agent", "w", "do it"), (3, "incoming", "FINAL_ANSWER", None, "Message Type: FINAL_ANSWER\ndone")]


def test_alignment_is_monotone(spark):
    messages = spark.createDataFrame([("s", 1, "user", "a  b"), ("s", 2, "assistant", "hello"), ("s", 3, "user", "a b"), ("s", 4, "user", "none"), ("s", 5, "user", "")], "sid string, nth long, role string, text string")
    rows = spark.createDataFrame([("s", 3, "user", "a b c"), ("s", 5, "assistant", "hello you"), ("s", 9, "user", "a b"), ("s", 2, "assistant", "hello")], "sid string, line long, role string, head string")
    got = sorted((r.nth, r.line) for r in exports.align_messages(messages, rows).collect())
    assert got == [(1, 3), (2, 5), (3, 9)]


def test_window_export(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 10, 1, "s2", "r9"), ("a", 1, 11, 2, "s1", "r1"), ("b", 2, 12, 3, "s2", None)], "account string, win long, ts_s long, line long, sid string, req string")
    numbers = exports.write_window_exports(df, str(tmp_path), ["sid", "req"])
    assert {r.sid: r.number for r in numbers["sid"].collect()} == {"s2": 1, "s1": 2}
    back = spark.read.option("header", True).csv(str(tmp_path / "windows"))
    assert sorted((r.account, r.sid, r.req) for r in back.collect()) == [("a", "1", "1"), ("a", "2", "2"), ("b", "1", None)]
    exports.write_report_tables({"t": df}, str(tmp_path / "star"))
    assert spark.read.parquet(str(tmp_path / "star" / "t")).count() == 3


def test_credit_card(spark, tmp_path):
    file = tmp_path / "card.json"
    file.write_text(json.dumps({"meta": {"creditsPerUsd": 25}, "models": [{"id": "m", "fresh": 1, "cached": 0.5, "output": 2}, {"id": "m", "fresh": -1, "cached": 0, "output": 0}]}))
    card, checks = exports.credit_card(spark.read.option("multiLine", True).json(str(file)))
    assert card.count() == 2 and checks == {"valid": False, "credits_per_usd": 25.0, "duplicates": 1, "bad_rates": 1}


def test_alert_lines(spark):
    t = spark.createDataFrame([("s", 4, "x"), ("s", 6, "y")], "sid string, turn long, text string")
    m = spark.createDataFrame([("s", 4, "@@++~"), ("s", 6, "@")], "sid string, turn long, markers string")
    assert {r.turn: r.kinds for r in exports.alert_lines(t, m).collect()} == {4: "clear+autocompact+reload", 6: "start"}


def test_line_numbers_over_several_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join("\n" if k % 7 == 3 else '{"n": %d, "t": "%s"}\r\n' % (k, "é" * (k % 50)) for k in range(4000)), encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"n": 0}\nno json\n\n{"n": 3}', encoding="utf-8")
    (tmp_path / "c.jsonl").write_text("")
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = transcripts.scan_transcripts(spark, [f"file://{tmp_path}/*.jsonl"])
        assert lines.rdd.getNumPartitions() > 3
        got = lines.select(F.element_at(F.split("path", "/"), -1).alias("f"), "line_no", F.get_json_object("raw", "$.n").cast("int").alias("n"), "raw").collect()
        bad = {r.path.rsplit("/", 1)[1]: (r.lines, r.malformed) for r in transcripts.malformed_lines(lines).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    a = sorted((r.line_no, r.n) for r in got if r.f == "a.jsonl")
    assert a == [(k + 1, k) for k in range(4000) if k % 7 != 3]
    assert sorted((r.line_no, r.raw) for r in got if r.f == "b.jsonl") == [(1, '{"n": 0}'), (2, "no json"), (4, '{"n": 3}')]
    assert bad == {"a.jsonl": (len(a), 0), "b.jsonl": (3, 1)}


def test_ratelimit_log(spark, tmp_path):
    (tmp_path / "s1.csv").write_text("ts,5h,5h_reset,7d,7d_reset,alert,version\n2026-01-01T00:00:00Z,1.5,1767243600,2,1767600000,,1\n2026-01-01T00:01:00Z,2,,2,,warn,1\n2026-01-01T00:02:00Z,3,1767250000,3,,,1\n")
    (tmp_path / "s2.csv").write_text("ts,5h,5h_reset,7d,7d_reset,alert,version\n2026-01-01T00:00:30Z,9,,1,,,1\n")
    rows = transcripts.read_ratelimit_log(spark, [f"file://{tmp_path}/*.csv"]).collect()
    assert sorted((r.sid, r.ts_s % 86400, r.pct_5h, r.reset_5h, r.reset_7d, r.alert) for r in rows) == [
        ("s1", 0, 1.5, 1767243600, 1767600000, None), ("s1", 60, 2.0, 1767243600, 1767600000, "warn"), ("s1", 120, 3.0, 1767250000, 1767600000, None), ("s2", 30, 9.0, None, None, None)
    ]
